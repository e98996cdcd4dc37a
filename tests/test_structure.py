"""Structural evidence: which source names a post's venue, conflicts, what captions say, and the cut to a batch."""

import datetime as dt

from kithgraph.operators import structure as S

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def found(spark, posts, entries=(), aliases=(), locations=(), extracted=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    accounts = df([(1, "Hall", "venue", True), (2, "barn", None, True), (3, "lens", "photographer", True), (4, "glam", None, False), (5, "hallevents", None, None)], "account_id long, username string, category string, is_venue boolean")
    entry = "post_id long, line_no int, handle string, role string, role_raw string, source string, extracted_at timestamp"
    return S.structural_evidence(df(posts, "post_id long, caption string, location_tag string, owner string"), df(entries, entry), accounts, df(aliases, "alias_id long, canonical_id long"), df(locations, "location_tag string, account_id long"), df(extracted, "post_id long, account_id long"))


def anchors(rows):
    return {r.post_id: (r.account_id, r.anchor_source, r.anchor_conflict) for r in rows.where("role = 'venue'").collect()}


def credit(post, line, handle, raw="Venue", source="credit_line", role="venue", at=T1):
    return (post, line, handle, role, raw, source, at)


def test_sources_in_order(spark):
    posts = [(i, "x", "Hall Tag" if i in (1, 2) else None, {1: "lens", 3: "BARN", 4: "lens", 7: "glam"}.get(i)) for i in range(1, 9)]
    entries = [credit(1, 5, "barn"), credit(4, 0, "barn", source="inline_at"), credit(4, 1, "hall", source="venue_hashtag"), credit(5, 0, "hall", source="venue_hashtag"), credit(8, 0, "nobody"), credit(99, 0, "hall")]
    got = anchors(found(spark, posts, entries, locations=[("Hall Tag", 1)], extracted=[(6, 2), (1, 2), (77, 1)]))
    assert got == {1: (2, "credit_line", False), 2: (1, "location_tag", False), 3: (2, "author", False), 4: (2, "inline_at", False), 5: (1, "venue_hashtag", False), 6: (2, "extracted", False)}


def test_labels_conflicts_and_aliases(spark):
    posts = [(i, None, None, None) for i in range(1, 5)]
    entries = [
        credit(1, 0, "hall", "Ceremony Venue"), credit(1, 3, "barn", "Reception"), credit(2, 0, "hall", "Church"), credit(2, 2, "barn", "Venue"), credit(3, 1, "hall"), credit(3, 2, "hallevents"),
        credit(4, 0, "hall", role="other", at=T2), credit(4, 0, "hall"), credit(4, 1, "glam", "Makeup", role="makeup"),
    ]
    rows = found(spark, posts, entries, aliases=[(5, 1)])
    assert anchors(rows) == {1: (2, "credit_line", True), 2: (2, "credit_line", True), 3: (1, "credit_line", False)}
    others = [tuple(r)[:6] for r in rows.where("role <> 'venue'").select("post_id", "account_id", "role", "role_raw", "line_no", "anchor_source").collect()]
    assert others == [(4, 4, "makeup", "Makeup", 1, None)]


def test_what_captions_say(spark):
    texts = ["Anna & Ben, tied the knot", "Lido Banquets & Events", "mr. & mrs. smith", "Mr. & Mrs. Smith gala", None, "a weddingish day", "Baby Shower"]
    rows = found(spark, [(i, t, "T", None) for i, t in enumerate(texts)], locations=[("T", 1)]).collect()
    got = {r.post_id: (r.has_couple_signal, r.couple_guess, r.has_wedding_keyword, r.has_other_event) for r in rows}
    assert got == {
        0: (True, "anna & ben", True, False), 1: (False, None, False, False), 2: (False, None, True, False), 3: (True, "mr. & mrs.", True, True), 4: (False, None, False, False),
        5: (False, None, False, False), 6: (False, None, False, True),
    }


def test_batch_is_the_whole_cut_to_its_posts(spark):
    posts = [(i, "x", "T", None) for i in range(6)]
    df = spark.createDataFrame(posts, "post_id long, caption string, location_tag string, owner string")
    seen = spark.createDataFrame([(0, "b1", True), (0, "b1", True), (1, "b1", False), (2, "b2", True), (3, "b1", True), (9, "b1", True)], "post_id long, batch_id string, is_first boolean")
    cut = [tuple(r) for r in S.first_of_batch(df, seen, "b1").collect()]
    assert sorted(r[0] for r in cut) == [0, 3]
    whole = {r for r in found(spark, posts, locations=[("T", 1)]).collect() if r.post_id in (0, 3)}
    assert set(found(spark, cut, locations=[("T", 1)]).collect()) == whole and len(whole) == 2
    assert found(spark, []).count() == 0


def test_entries_are_cut_before_they_are_sorted(spark):
    """Only entries of the posts are sorted for the latest of a line."""
    cols = {"posts": "post_id long, caption string, location_tag string, owner string", "entries": "post_id long, line_no int, handle string, role string, role_raw string, source string, extracted_at date", "accounts": "account_id long, username string, category string, is_venue boolean", "aliases": "alias_id long, canonical_id long", "locations": "location_tag string, account_id long", "extracted": "post_id long, account_id long"}
    plan = S.structural_evidence(*[spark.createDataFrame([], c) for c in cols.values()])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("Window"):
            below = [x.lstrip(" :+-") for x in lines[i + 1 :] if depth(x) > depth(line)]
            assert next(x for x in below if "Join" in x.split()[0]).startswith("ShuffledHashJoin")
    assert "Window" in plan
