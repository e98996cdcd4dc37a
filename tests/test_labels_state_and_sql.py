"""Labels by a table of rules, sightings over a log and a stream, samples, functions of SQL, names of add-ons."""

import datetime as dt
import hashlib
import math
import re

import pytest
from kithgraph.functions import credits, labels, text, urls
from kithgraph.functions import sql as Q
from kithgraph.operators import checks, documents, evaluate
from kithgraph.plans.vocabulary import RULES
from kithgraph.streaming import ingest, sightings
from pyspark.sql import functions as F

CASES = {
    "Photography": ("photographer", "wedding_day", None, "head"), "Venue & Catering": ("venue,catering", "wedding_day", None, "compound"), "Ceremony Venue": ("venue", "ceremony", None, "head"),
    "Rehearsal Dinner": ("venue", "rehearsal_dinner", None, "phase_venue"), "Reception: Hair + Makeup": ("hair,makeup", "reception", None, "compound"), "HMU": ("hair,makeup", "wedding_day", None, "exact"),
    "Our HMU": ("hair,makeup", "wedding_day", None, "exact"), "Bride": ("", "wedding_day", "bride", "participant"), "Featured in": ("press_feature", "wedding_day", None, "press"), "The Team!": ("noise", "wedding_day", None, "noise"),
    "Chapel": ("venue", "ceremony", None, "phase_venue"), "Lead Second Shooter": ("second_shooter", "wedding_day", None, "head"), "Skywriting": ("other", "wedding_day", None, "unmatched"), "✨": ("noise", "wedding_day", None, "empty"), "": ("noise", "wedding_day", None, "empty"),
    "Photo and Photography": ("photographer", "wedding_day", None, "compound"), "Tent": ("tent", "wedding_day", None, "exact"), "Tent, Bar with Cake": ("tent,bar_service,cake", "wedding_day", None, "compound"), "Skywriting & Bar": ("bar_service", "wedding_day", None, "compound"),
}


def test_labels_by_rules(spark):
    df = spark.createDataFrame([*[(x,) for x in CASES], (None,), ("HMU",)], "label string")
    got = {r.label: (r.roles, r.event_context, r.participant, r.rule) for r in labels.classified(df, RULES).collect()}
    assert got == CASES
    assert {r.label: r.roles for r in labels.classified(df, []).collect()} == {x: "noise" if c[3] == "empty" else "other" for x, c in CASES.items()}


def test_rules_come_from_a_table(spark):
    df = spark.createDataFrame([(r.kind, r.pattern, r.value, i) for i, r in enumerate(RULES)], "kind string, pattern string, value string, rank int")
    assert labels.rules_of(df.orderBy(F.desc("rank"))) == RULES
    with pytest.raises(ValueError, match="kinds"):
        labels.rules_of(df.withColumn("kind", F.lit("guess")))
    first = [labels.Rule("head", "bar$", "one"), labels.Rule("head", "bar$", "two"), labels.Rule("exact", "x", "first"), labels.Rule("exact", "x", "second")]
    got = labels.classified(spark.createDataFrame([("Bar",), ("X",)], "label string"), first).collect()
    assert {r.label: r.roles for r in got} == {"Bar": "one", "X": "first"}


def test_label_coverage(spark):
    df = spark.createDataFrame([("Tent",)] * 3 + [("tent",), ("Bar",), ("who",), (None,)], "raw string")
    assert {r.rule: (r.labels, r.entries) for r in labels.label_coverage(df, "raw", RULES).collect()} == {"exact": (2, 4), "head": (1, 1), "unmatched": (1, 1)}


T = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def seen(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, key string, observed_at timestamp, content string")


def log(spark, path):
    return {(r.run_id, r.key): (r.is_first, r.changed) for r in sightings.log_of(spark, path).collect()}


def test_sightings_and_replays(spark, tmp_path):
    path = f"{tmp_path}/log"
    one = seen(spark, ("r1", "a", T[1], "x"), ("r1", "a", T[2], "later"), ("r2", "a", T[3], "y"), ("r1", "b", T[1], None), (None, "c", T[1], "z"), ("r1", None, T[1], "z"))
    two = seen(spark, ("r3", "a", T[4], "x"), ("r3", "b", T[4], ""), ("r3", "c", T[4], "new"), ("r2", "a", T[3], "y"))
    sightings.record(one, path)
    want = {("r1", "a"): (True, False), ("r2", "a"): (False, True), ("r1", "b"): (True, False)}
    assert log(spark, path) == want
    sightings.record(one, path)
    assert log(spark, path) == want and sightings.log_of(spark, path).count() == 3
    for _ in range(2):
        sightings.record(two, path)
    assert log(spark, path) == want | {("r3", "a"): (False, False), ("r3", "b"): (False, False), ("r3", "c"): (True, False)}
    assert sightings.log_of(spark, path).count() == 6


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    sightings.record(seen(spark, *[("r1", f"k{i}", T[1], "x") for i in range(500)]), path)
    mine = seen(spark, ("r2", "k7", T[2], "x")).select(sightings.bucket_of()).first()[0]
    files = [r.f for r in sightings.held(spark, path, [mine]).select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(f"/bucket={mine}/" in f for f in files)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", sightings.held(spark, path, [mine])._jdf.queryExecution().executedPlan().toString())


def test_stream_of_sightings_goes_on_after_a_restart(spark, tmp_path):
    source, path, checkpoint = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/check"
    rows = [("r1", "a", T[1], "x"), ("r1", "b", T[1], "y")]
    seen(spark, *rows).write.parquet(source)
    sightings.recorded(ingest.observations(spark, source), path, checkpoint).awaitTermination()
    seen(spark, ("r2", "a", T[2], "z"), *rows).write.mode("append").parquet(source)
    sightings.recorded(ingest.observations(spark, source), path, checkpoint).awaitTermination()
    sightings.recorded(ingest.observations(spark, source), path, f"{checkpoint}-lost").awaitTermination()  # all again
    assert log(spark, path) == {("r1", "a"): (True, False), ("r1", "b"): (True, False), ("r2", "a"): (False, True)} and sightings.log_of(spark, path).count() == 3


def test_changes_as_state(spark, tmp_path):
    source, checkpoint, out = f"{tmp_path}/in", f"{tmp_path}/check", f"{tmp_path}/out"

    def run():
        sightings.changes(ingest.observations(spark, source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r.run_id, r.key): (r.is_first, r.changed) for r in spark.read.parquet(out).collect()}

    seen(spark, ("r1", "a", T[1], "x"), ("r2", "a", T[2], "x"), (None, None, T[1], "x")).write.parquet(source)
    assert run() == {("r1", "a"): (True, False), ("r2", "a"): (False, False)}
    seen(spark, ("r3", "a", T[3], "y"), ("r3", "b", T[3], None)).write.mode("append").parquet(source)
    assert run() == {("r1", "a"): (True, False), ("r2", "a"): (False, False), ("r3", "a"): (False, True), ("r3", "b"): (True, False)}


def test_weighted_sample(spark):
    rows = [(i, "xy"[i % 2] if i % 7 else None, float(i % 5)) for i in range(400)] + [(900, "x", None), (901, "x", -1.0)]
    df = spark.createDataFrame(rows, "id long, s string, w double")
    got = evaluate.weighted_sample(df, "id", "s", "w", 9, 3).collect()
    u = lambda i: (int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    want = set()
    for s in ("x", "y", None):
        drawn = sorted((-math.log(u(i)) / w, i) for i, t, w in rows if t == s and w and w > 0)[:9]
        want |= {(i, s, n + 1) for n, (_, i) in enumerate(drawn)}
    assert {(r.id, r.s, r.draw) for r in got} == want
    assert "WindowGroupLimit" in evaluate.weighted_sample(df, "id", "s", "w", 9)._jdf.queryExecution().executedPlan().toString()


def test_inclusion_follows_weight(spark):
    df = spark.range(6000).select("id", (F.col("id") % 300).alias("s"), F.when(F.col("id") % 20 < 10, 1.0).otherwise(3.0).alias("w"), (F.col("id") % 20 < 10).alias("light"))
    got = evaluate.weighted_sample(df.withColumn("s", F.floor(F.col("id") / 20)), "id", "s", "w", 1).groupBy("light").count().collect()
    share = {r.light: r["count"] for r in got}
    assert 0.18 < share[True] / 300 < 0.32  # a quarter of the weight


def test_review_candidates(spark):
    results = spark.createDataFrame([(1, "REVIEW", 0.5, None), (2, "EXCLUDE", 0.95, "ad"), (3, "INCLUDE", 0.9, "spam"), (4, "INCLUDE", 0.6, "spam"), (5, "INCLUDE", None, "spam"), (6, "INCLUDE", 0.99, "spam")], "post_id long, decision string, confidence double, exclusion_reason string")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "post_id long")
    examples = spark.createDataFrame([("spam",)] * 5 + [("ad",)] * 2, "exclusion_reason string")
    got = {r.post_id: (r.score, r.reasons) for r in evaluate.review_candidates(results, one(3), one(6), examples).collect()}
    assert got == {1: (12.0, "review,boundary,coverage"), 2: (2.7, "coverage"), 4: (2.4, "boundary"), 6: (10.06, "disagreement")}


def test_functions_of_sql_are_the_column_functions(spark):
    Q.register(spark)
    rows = [("https://www.Venue.com/weddings/?utm_source=x#a", "The Ballroom seats 200", "Ballroom: 200 guests"), ("/x", "", "y"), (None, None, None), ("it's", "a 'quoted' \\ b", "p")]
    spark.createDataFrame(rows, "a string, b string, c string").createOrReplaceTempView("rows_of_test")
    plain = spark.table("rows_of_test")
    for name, own in {"kith_host": text.host, "kith_url_key": text.url_key, "kith_couple_key": text.couple_key, "kith_search_key": text.search_key, "kith_clock": text.clock, "kith_event_date": text.event_date, "kith_handle": text.handle}.items():
        for c in "abc":
            assert spark.sql(f"SELECT {name}({c}) AS x FROM rows_of_test").collect() == plain.select(own(F.col(c)).alias("x")).collect()
    assert spark.sql("SELECT kith_coverage(b, c) AS x FROM rows_of_test").collect() == plain.select(documents.coverage(F.col("b"), F.col("c")).alias("x")).collect()
    assert spark.sql("SELECT kith_url_score(a, true, b, 6D) AS x FROM rows_of_test").collect() == plain.select(urls.url_score(F.col("a"), F.lit(True), F.col("b"), F.lit(6.0)).alias("x")).collect()


def test_credits_through_sql_have_an_equal_plan(spark):
    Q.register(spark)
    posts = spark.createDataFrame([(1, "Best day\n Photo: @One and @Two.x\n• Venue | @three\nPlanner – nobody\nDJ-@four\nno label @five"), (2, None), (3, "")], "post_id long, caption string")
    posts.createOrReplaceTempView("posts_of_test")
    found = spark.sql("SELECT p.post_id, c.* FROM posts_of_test p, LATERAL kith_credits(p.caption) c")
    own = credits.credit_lines(posts)
    assert sorted(map(tuple, found.select(*own.columns).collect())) == sorted(map(tuple, own.collect()))
    direct = posts.select("post_id", F.explode(credits.credits_of(F.col("caption"))).alias("x")).select("post_id", "x.*")
    plan = lambda df: [line.split("(")[0].strip(" +-:*") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert [p.split()[0] for p in plan(found) if p] == [p.split()[0] for p in plan(direct) if p] and "Python" not in found._jdf.queryExecution().toString()


def test_similar_names_meet_on_prefixes(spark):
    names = ["Up", "Uplights", "Dan", "Dance floor", "dance Floor (large)", "Chair covers", "12 uplights", "Uplights 12 rental"]
    rows = [(1, i, n) for i, n in enumerate(names)] + [(2, 0, "!"), (2, 1, "x"), (2, 2, None), (3, 0, "x")]
    got = {(r.venue_id, r.id_a, r.id_b) for r in checks.similar_names(spark.createDataFrame(rows, "venue_id int, id int, name string")).collect()}
    assert got == {(1, 0, 1), (1, 0, 7), (1, 1, 7), (1, 2, 3), (1, 2, 4), (1, 3, 4), (1, 1, 6), (1, 6, 7), (2, 0, 1)}


def test_credits_read_their_captions_twice_and_match_each_part_once(spark):
    import contextlib
    import io

    from kithgraph.functions import credits
    from kithgraph.functions.labels import Rule

    posts = spark.createDataFrame([(1, "Photo: @one and @two\n💐 @bloom\nVenue | @hall - DJ: @mix"), (2, None)], "post_id long, caption string")
    found = credits.labelled_credits(posts, [Rule("head", "^photo$", "photographer"), Rule("head", "^venue$", "venue,hotel")])
    got = sorted((r.line_no, r.handle, r.role, r.rule) for r in found.collect())
    assert got == [(0, "one", "photographer", "head"), (0, "two", "photographer", "head"), (1, "bloom", "florist", "emoji"), (2, "hall", "hotel", "head"), (2, "hall", "venue", "head"), (2, "mix", "other", "unmatched")]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain("simple")
    assert plan.getvalue().split("== Initial Plan ==")[-1].count("Generate posexplode(split(") == 2
