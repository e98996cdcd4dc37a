import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import credits, places, text, urls
from kithgraph.operators import acquire, documents, entities, evaluate, evidence, helpers, serving
from kithgraph.plans.vocabulary import RULES
from kithgraph.sources import files, posts
from kithgraph.streaming import ingest


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [(" @Some.Name.. ", "some.name"), ("@", None), ("x", "x")])
def test_handle(spark, raw, want):
    assert one(spark, text.handle("r"), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2024-05-06T10:00", dt.date(2024, 5, 6)), ("5/6/24", dt.date(2024, 5, 6)), ("05.06.2024", dt.date(2024, 5, 6)), ("2/31/2024", None), ("13/1/2024", None), ("soon", None)])
def test_event_date(spark, raw, want):
    assert one(spark, text.event_date("r"), r=raw) == want


def test_event_date_needs_confidence(spark):
    assert one(spark, text.event_date("r", F.lit(0.79)), r="2024-05-06") is None


@pytest.mark.parametrize(("raw", "want"), [("Ben & Anna", "anna|ben"), ("Al & Bo", None), ("Ann and Zoe + Kim", None), ("Zoë Lee + Max Po", "max|zoë"), ("Ann & Mo", None)])
def test_couple_key(spark, raw, want):
    assert one(spark, text.couple_key("r"), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("5pm", "17:00"), ("12 AM", "00:00"), ("5:30 p.m.", "17:30"), ("17:30", "17:30"), ("noon", "12:00"), ("25:00", None), ("13pm", None)])
def test_clock(spark, raw, want):
    assert one(spark, text.clock("r"), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("https://a.b/?utm_source=x&id=1", "https://a.b/?id=1"), ("https://a.b/?id=1&fbclid=z", "https://a.b/?id=1"), ("https://a.b/?gclid=1&utm_medium=2", "https://a.b/"), ("https://a.b/c", "https://a.b/c")])
def test_tracking(spark, raw, want):
    assert one(spark, text.without_tracking("r"), r=raw) == want


def test_names(spark):
    assert one(spark, text.venue_name_key("r"), r="The Ivy on the Hill!") == "ivyonhill"
    assert one(spark, text.lead_name_key("r"), r="The “Ivy” (Room) - West") == "ivy room west"
    assert one(spark, text.search_key("r"), r="123 North Main Street, #4") == "123 n main st 4"
    assert one(spark, text.name_from_handle("r"), r="blue_moon.events") == "Blue Moon Events"
    assert one(spark, text.truncated("r", 5), r="abcdefgh") == "abcd…"
    assert one(spark, text.video_url("r"), r="https://youtu.be/abcdefghijk?t=1") == "https://www.youtube.com/watch?v=abcdefghijk"


def test_bounds_include_edges_and_leave_out_nan(spark):
    rows = spark.createDataFrame([(1, 41.35, -88.45), (2, 42.46, -88.0), (3, None, -88.0), (4, float("nan"), -88.0)], "id int, lat double, lng double")
    assert [r.id for r in rows.where(places.in_bounds(F.col("lat"), F.col("lng"))).collect()] == [1]


def test_credit_lines(spark):
    caption = "Best day\n Photo: @One and @Two.x\n• Venue | @three\nPlanner – nobody\nDJ-@four\nno label @five\n📸 @Six"
    rows = spark.createDataFrame([(1, caption), (2, None), (3, "")], "post_id int, caption string")
    got = {(r.post_id, r.line_no, r.role_raw, r.handle, r.role) for r in credits.credit_lines(rows).collect()}
    assert got == {(1, 1, "Photo", "one", "photographer"), (1, 1, "Photo", "two.x", "photographer"), (1, 2, "Venue", "three", "venue"), (1, 4, "DJ", "four", "dj")}
    assert [(r.line_no, r.handle, r.role) for r in credits.sign_credits(rows).collect()] == [(6, "six", "photographer")]
    assert credits.has_stack_raw(credits.credit_lines(rows)).count() == 1


def fold(posts, days, above):
    events = []
    for post, date, members in sorted(posts, key=lambda p: (p[1], p[0])):
        for e in events:
            if len(members & e[0]) / len(members | e[0]) > above and abs((date - e[1]).days) <= days:
                e[0] |= members
                e[2].append(post)
                break
        else:
            events.append([set(members), date, [post]])
    return {p: min(e[2]) for e in events for p in e[2]}


def test_greedy_events_equal_the_plain_fold(spark):
    rng = random.Random(4)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(120)), sorted(rng.sample(range(25), rng.randint(1, 4)))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, [1]), (901, dt.date(2024, 1, 1), [])], "id long, date date, members array<int>")
    got = {r.post_id: r.event_id for r in entities.greedy_events(df).collect()}
    assert got == fold([(i, d, set(m)) for i, d, m in rows], 21, 0.5) | {900: 900, 901: 901}


def test_greedy_bound_is_strict(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), [1, 2, 3]), (2, dt.date(2024, 1, 22), [1, 2, 4])], "id long, date date, members array<int>")
    assert len({r.event_id for r in entities.greedy_events(df).collect()}) == 2
    assert len({r.event_id for r in entities.greedy_events(df, inclusive=True).collect()}) == 1
    assert len({r.event_id for r in entities.greedy_events(df, days=20, inclusive=True).collect()}) == 2


def test_within_edits_equals_all_pairs(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(i, j, distance(names[i], names[j])) for i in range(60) for j in range(i + 1, 60) if distance(names[i], names[j]) <= 2}
    assert {tuple(r) for r in entities.within_edits(df, 2).collect()} == want


def test_reconciliation_levels(spark):
    schema = "id long, block long, date date, members array<int>"
    day = dt.date(2024, 5, 1)
    c = spark.createDataFrame([(1, 1, day, [1, 2, 3]), (2, 1, day, [1, 9]), (3, 2, day, [1]), (4, None, day, [1]), (5, 3, day, [1])], schema)
    e = spark.createDataFrame([(10, 1, dt.date(2024, 5, 15), [1, 2, 3, 4]), (11, 2, dt.date(2024, 9, 1), [7]), (12, 1, dt.date(2025, 5, 1), [1, 2, 3, 4])], schema)
    got = {r.candidate_id: (r.matched_event_id, r.level, r.confidence, r.venue_match) for r in entities.reconciled(c, e).collect()}
    assert got == {1: (10, "high", 0.8, True), 2: (10, "ambiguous", 0.4, True), 3: (None, "insufficient", 0.1, True), 5: (None, "insufficient", 0.1, False)}


def test_alias_signals(spark):
    rows = spark.createDataFrame([(1, "the.ivy", "Ivy", "https://ivy.com", None), (2, "the_ivy", "Ivy", "https://linktr.ee/x", "by @the.ivy"), (3, "oakhall", None, "https://www.ivy.com/", None), (4, "zzzzzz", None, None, None)], "id long, username string, full_name string, url string, biography string")
    got = {(r.id_a, r.id_b): (r.signals, r.tier) for r in entities.alias_signals(rows).collect()}
    assert got == {(1, 2): ("S1,S1b,S2,S4,S6", "T1"), (1, 3): ("S3", "T2")}


def test_helpers(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "c"), (None, 1, "d")], "k int, v int, x string")
    assert {r.x for r in helpers.latest_by(df, ["k"], [F.desc("v"), F.col("x")]).collect()} == {"a", "d"}
    assert one(spark, helpers.bands(F.col("n"), [0, 5], ["0", "1-5", "6+"]), n=6) == "6+"
    assert one(spark, helpers.capped_confidence(F.col("n")), n=3) == 0.95 and one(spark, helpers.capped_confidence(F.col("n")), n=2) == 0.8
    assert one(spark, helpers.jaccard(F.array(), F.array())) == 0.0


def test_candidate_score_and_prefilter(spark):
    roles = F.array(*map(F.lit, ["photographer", "venue", "planner", "venue"]))
    assert one(spark, evaluate.candidate_score(roles, F.col("c")), c="Chicago wedding") == 6 + 3 + 2 + 1 + 2
    assert one(spark, evaluate.candidate_score(roles, F.col("c")), c="Styled shoot, now booking, she said yes") == 6 + 3 + 2 - 4 - 3 - 2
    assert evaluate.escalation_band("0.5-0.8") == (0.5, 0.8) and evaluate.escalation_band(" ") is None
    with pytest.raises(ValueError):
        evaluate.escalation_band("0.8-0.5")


def test_priors(spark):
    prior = acquire.venue_prior(F.lit("museum"), F.col("f"), F.lit(100), F.lit("event_venue"))
    assert one(spark, prior, f=1_000) == 0.22 and one(spark, prior, f=30_000) == 0.1
    assert one(spark, acquire.vendor_prior(F.lit("planner"), F.col("y")), y=0.21) == 0.31
    assert one(spark, acquire.updated_prior(F.lit(0.2), F.lit(5), F.col("n")), n=25) == 0.2
    text_of = F.col("t")
    assert one(spark, acquire.disqualified(F.lit("ivy"), text_of, F.lit(False)), t="On Lake Michigan in Chicago") is None
    assert one(spark, acquire.disqualified(F.lit("ivy"), text_of, F.lit(False)), t="Detroit, Michigan") == "out_of_area"


def test_truth_conflicts(spark):
    posts_ = spark.createDataFrame([(1,), (2,), (3,)], "post_id long")
    log = "post_id long, {} string, at int, id long"
    labels = spark.createDataFrame([(1, "WEDDING", 1, 1), (2, "NOT_WEDDING", 1, 2)], log.format("decision"))
    human = spark.createDataFrame([(1, "NOT_WEDDING", 1, 3), (1, "THIS_VENUE", 0, 4)], log.format("verdict"))
    got = {r.post_id: (r.label, r.tier, r.retirement_candidate) for r in evidence.truth(posts_, labels, human, human.limit(0), posts_.where("post_id = 2"), posts_.limit(0), posts_).collect()}
    assert got == {1: ("conflicting", "gold", False), 2: ("not_wedding", "gold", True), 3: ("wedding", "bronze", False)}


def test_grounding(spark):
    pages = spark.createDataFrame([(1, "https://v.com/a/", "The hall seats 150 guests for dinner"), (1, "https://v.com/b", "Rental is $2,500 on Fridays in winter"), (2, "https://w.com/", "Rental costs nothing")], "entity_id int, url string, text string")
    quotes = [(1, 1, "hall seats 150 guests", "http://www.v.com/a"), (2, 1, "Rental is $2500 on Fridays", "https://v.com/a"), (3, 1, "hall seats 175 guests", "https://v.com/a"), (4, 1, "purple elephants dance nightly", "https://v.com/a"), (5, 1, "hall seats nobody here", "https://v.com/zz")]
    got = {r.quote_id: r.status for r in documents.grounding(spark.createDataFrame(quotes, "quote_id int, entity_id int, quote string, source_url string"), pages).collect()}
    assert got == {1: "pass", 2: "grounded_elsewhere", 3: "weak_quote", 4: "fail", 5: "source_not_crawled"}


def test_cost_estimate(spark):
    requests = spark.createDataFrame([(1, 7, 100, "sat", "summer", "hall", True), (2, 7, 40, "tue", "winter", "attic", False)], "request_id int, path_id int, guests int, day string, season string, space_id string, card boolean")
    fees = spark.createDataFrame([(7, "Hall", 1000.0, "hall", "sat", None, None), (7, "House", 4000.0, None, None, None, None), (7, "Lunch special", 9.0, None, None, None, None), (7, "Hourly", 100.0, None, "weekday", None, 5)], "path_id int, label string, amount double, space_id string, day string, season string, hours int")
    tiers = spark.createDataFrame([(7, 1, 50.0, None, None), (7, 2, 60.0, "sat", "summer")], "path_id int, tier_id int, per_guest double, day string, season string")
    minimums = spark.createDataFrame([(7, "guest_minimum", 50.0, None, None), (7, "fb_minimum", 6500.0, "sat", None)], "path_id int, kind string, amount double, day string, season string")
    rates = spark.createDataFrame([(7, 20.0, False, 10.0, False, 3.0)], "path_id int, service_pct double, service_on_all boolean, tax_pct double, tax_on_all boolean, card_pct double")
    a, b = documents.cost_estimate(requests, fees, tiers, minimums, rates).orderBy("request_id").collect()
    assert (a.venue, a.food, a.service, a.tax, a.card_fee, a.total, a.under_minimum, a.under_fb_minimum) == (1000.0, 6000.0, 1200, 720, 268, 9188.0, False, True)
    assert (b.venue, b.food, b.total, b.under_minimum, b.under_fb_minimum) == (4500.0, 2000.0, 4500 + 2000 + 400 + 240, True, False)


def test_serving(spark):
    with pytest.raises(ValueError):
        serving.checked_role("x' or 1=1")
    assert serving.checked_page(9_999, 0) == (500, 0)
    credit = spark.createDataFrame([(1, 5, 3), (1, 6, 9), (1, 7, 1)], "event_id int, account_id int, n_confirmations int")
    assert serving.rail(credit, 2).first().asDict() == {"event_id": 1, "rail": "6,5", "more": 1}


def test_robots_and_html(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/*.pdf$", False)], "host string, pattern string, allow boolean")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z.pdf"), ("h", "/z.pdfx"), ("g", "/a")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in urls.allowed(paths, rules).collect()} == {("h", "/a/x"): False, ("h", "/a/b/c"): True, ("h", "/z.pdf"): False, ("h", "/z.pdfx"): True, ("g", "/a"): True}
    assert urls.html_text("<p>A &amp; B<script>x</script></p><a href='/l'>C  D</a>") == ("A & B\nC D", ["/l"])
    assert urls.html_text(None) == ("", [])


def test_posts_from_items(spark):
    items = spark.createDataFrame([('{"shortCode": "A", "ownerUsername": "@Me.", "likesCount": -1, "commentsCount": 2, "inputUrl": "https://x/Seed/", "timestamp": "2024-01-02T03:04:05"}',), ('{"caption": "no code"}',), ('{"shortCode": "A", "z": 1}',)], "raw string")
    row = posts.from_items(items, ["seed"]).collect()
    assert len(row) == 1 and (row[0].owner, row[0].likes_count, row[0].comments_count, row[0].seed_username) == ("me", None, 2, "seed")


def test_table_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "k int, v string")
    order = [F.col("v")]
    assert {tuple(r) for r in files.inserted(old, new, ["k"], order).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in files.upserted(old, new, ["k"], order).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert {tuple(r) for r in files.updated(old, new.limit(1), ["k"], ["v"]).collect()} == {(1, "a"), (2, "B")}
    assert files.change_log(old, files.upserted(old, new, ["k"], order), ["k"]).count() == 2


def test_csv_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'he said "x", then\nleft'), (2, None)], "id int, note string")
    files.snapshot(rows, f"{tmp_path}/s")
    assert {tuple(r) for r in files.read_csv(spark, f"{tmp_path}/s", "id int, note string").collect()} == {(1, 'he said "x", then\nleft'), (2, None)}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").write.parquet(source)
    for i in range(2):
        ingest.ingest(ingest.observations(spark, source), out, f"{tmp_path}/c{i}", "k").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "b")} and spark.read.parquet(out).count() == 2


def test_watermarked_yield(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a", h) for h in range(3)], "ts timestamp, kind string, user_id int").write.parquet(f"{tmp_path}/in")
    q = ingest.windowed_yield(ingest.observations(spark, f"{tmp_path}/in"), "ts", "kind").writeStream.format("memory").queryName("yields").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.users) for r in spark.table("yields").collect()] == [(3, 3)]


def test_tables_that_are_rebuilt_or_frozen(spark, tmp_path):
    import pytest

    from kithgraph.operators import currency

    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(map(tuple, currency.rebuilt(first, path).collect())) == [(1, "a"), (2, None)]
    assert currency.rebuilt(first.where("k = 1"), path).count() == 1 and currency.rebuilt(first.limit(0), path).count() == 0
    mark = currency.frozen(first, f"{path}-frozen")
    assert mark == currency.frozen(first.orderBy("k", ascending=False), f"{path}-again") and mark.startswith("2:")
    with pytest.raises(Exception, match="exist"):
        currency.frozen(first, f"{path}-frozen")
    with pytest.raises(ValueError):
        currency.stale(first)


def test_labelled_credits_fan_out(spark):
    rows = spark.createDataFrame([(1, "Catering/Bar 🥗:@chic\nBride: @her\n👰🏻‍♀️ @dress\nVenue: @xx - Photo: @yy")], "post_id long, caption string")
    got = {(r.line_no, r.label, r.handle, r.role, r.participant) for r in credits.labelled_credits(rows, RULES).collect()}
    assert got == {
        (0, "Catering/Bar 🥗", "chic", "catering", None), (0, "Catering/Bar 🥗", "chic", "bar_service", None), (1, "Bride", "her", None, "bride"),
        (2, "👰🏻‍♀️", "dress", "wedding_dress", None), (3, "Venue", "xx", "venue", None), (3, "Photo", "yy", "photographer", None),
    }


def seeded_fold(seeds, posts, days, above):
    events = [{"d": d, "m": set(m), "seed": i, "posts": [], "c": None} for i, d, m in sorted(seeds)]
    for i, d, m, c in sorted(posts, key=lambda p: (p[1], p[0])):
        own = set(m)
        for e in events:
            if abs((d - e["d"]).days) <= days and len(own & e["m"]) / len(own | e["m"]) > above and not (c and e["c"] and c != e["c"]):
                break
        else:
            e = {"d": d, "m": set(), "seed": None, "posts": [], "c": None}
            events.append(e)
        if e["seed"] is not None and not e["posts"]:
            e["d"] = d
        e["m"] |= own
        e["c"] = e["c"] or c
        e["posts"].append(i)
    return {p: min(e["posts"]) if e["seed"] is None else e["seed"] for e in events for p in e["posts"]}


@pytest.mark.parametrize("seeds_n", [0, 40])
def test_greedy_events_with_seeds_and_couples_equal_the_plain_fold(spark, seeds_n):
    rng = random.Random(8)
    make = lambda i: (i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(150)), sorted(rng.sample(range(14), rng.randint(1, 3))))
    seeds, posts = [make(i) for i in range(seeds_n)], [(*make(i), rng.choice([None, "ann & bo", "cy & di"])) for i in range(160)]
    df = spark.createDataFrame(posts, "id long, date date, members array<int>, couple string")
    old = spark.createDataFrame(seeds, "id long, date date, members array<int>") if seeds else None
    got = {r.post_id: r.event_id for r in entities.greedy_events(df, seeds=old).collect()}
    assert got == seeded_fold(seeds, posts, 21, 0.5)


def test_tag_clusters(spark):
    rows = [(i, "ad", ["Sale", "shop"]) for i in range(1, 5)] + [(5, "ad", ["SALE"]), (6, "ad", ["other"]), (7, "spam", ["sale", "shop"]), (8, "ad", []), (9, "ad", None), (10, None, ["sale"])]
    df = spark.createDataFrame(rows, "id long, reason string, tags array<string>")
    assert [(r.cluster_id, r.reason, r.n_posts, r.posts) for r in entities.tag_clusters(df).collect()] == [(1, "ad", 4, [1, 2, 3, 4])]


def test_alike_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    make = lambda i: (i, None if i % 17 == 0 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)), rng.sample(range(9), rng.randint(0, 5)))
    a, b = [make(i) for i in range(120)], [make(i) for i in range(120)]
    frame = lambda x: spark.createDataFrame(x, "id long, date date, members array<int>")
    for above in (0.3, 0.5):
        got = {(r.id_a, r.id_b) for r in entities.alike_pairs(frame(a), frame(b), above=above).collect()}
        want = {(i, j) for i, d, m in a for j, e, n in b if d and e and m and n and abs((d - e).days) <= 21 and len(set(m) & set(n)) / len(set(m) | set(n)) > above}
        assert got == want and want
