"""Location tags, websites, ceremony and reception, role sets, readers, and sane spaces and capacities."""

import random

import pytest
from kithgraph.operators import locations as L
from kithgraph.operators import roles as R
from kithgraph.operators import spaces as S
from pyspark.sql import functions as F


def keys(spark, *names):
    return [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(L.name_key(F.col("n")).alias("k")).collect()]


def test_name_keys(spark):
    assert keys(spark, "The Ivy Room, Chicago", "LondonHouse Chicago IL", "Salvatore's Event Venue ", "Drury Lane (Events) Weddings", " the  Chicago", None) == ["ivy room", "londonhouse", "salvatores", "drury lane events", "", None]


def test_tag_venues(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    posts = df([("Ivy Room",)] * 5 + [("THE IVY ROOM Chicago",)] * 3 + [("Chicago",)] * 9 + [("Loft",)] * 2 + [("Photo Co",)] * 2 + [("Nobody",)] * 2 + [("By Hand",), ("Loft Chicago",), ("",), (None,), ("rare",)], "location_tag string")
    names = df([(1, "ivy room"), (2, "Loft"), (3, "Loft"), (4, "Photo Co"), (5, "Hall"), (6, "Chicago"), (7, None), (8, "  ")], "account_id long, name string")
    got = {r.tag: (r.posts, r.bucket, r.account_id, r.tier) for r in L.tag_venues(posts, names, df([(1,), (2,), (3,), (5,), (6,), (50,)], "account_id long"), df([(9, 5)], "alias_id long, canonical_id long"), df([("CHICAGO",)], "tag string"), df([("By Hand", 9), ("Ivy Room", 5)], "tag string, account_id long"), 8).collect()}
    assert got == {
        "Chicago": (9, "generic", None, None), "Ivy Room": (5, "confident", 1, "exact"), "THE IVY ROOM Chicago": (3, "confident", 1, "normalized"), "Loft": (2, "ambiguous", None, None), "Photo Co": (2, "matched_not_venue", None, None),
        "Nobody": (2, "no_match", None, None), "By Hand": (1, "no_match", 5, "hand_pass"), "Loft Chicago": (1, "ambiguous", None, None),
    }
    merged = L.tag_venues(posts, names, df([(2,), (3,)], "account_id long"), df([(3, 2)], "alias_id long, canonical_id long"), df([], "tag string"), df([], "tag string, account_id long"), 99)
    assert {r.tag: r.account_id for r in merged.where("bucket = 'confident'").collect()} == {"Loft": 2, "Loft Chicago": 2}


def test_websites(spark):
    rows = [
        (1, "https://linktr.ee/x", None, 200, "text/html", 900), (2, "http://v.com", "https://www.lnk.bio/v", 200, "text/html", 900), (3, "http://v.com", "https://v.com/", 200, "text/html; charset=utf-8", 900), (4, "http://v.com", None, 200, None, 399),
        (5, "http://v.com/a.pdf", None, 200, "application/pdf", None), (6, "http://v.com", None, 500, None, None), (7, "http://v.com", None, None, None, None), (8, "https://mylnk.bio.com", None, 200, "text/html", 900),
    ]
    df = spark.createDataFrame(rows, "account_id int, url string, final_url string, http_status int, content_type string, n_chars int")
    got = {r.account_id: (r.status, r.note) for r in L.website_status(df).collect()}
    assert got == {
        1: ("rejected", "collects links"), 2: ("rejected", "redirects to a page that collects links"), 3: ("verified", None), 4: ("js_shell", None), 5: ("verified", "no page: application/pdf"),
        6: ("unreachable", "HTTP 500"), 7: ("unreachable", "no answer"), 8: ("verified", None),
    }


CREDIT = "event_id long, account_id long, role string, event_context string"


def test_ceremony_and_reception(spark):
    two = lambda e: [(e, 10, "venue", "ceremony"), (e, 20, "venue", "reception"), (e, 10, "venue", "ceremony")]
    credits = spark.createDataFrame([*two(1), *two(2), *two(3), *two(4), *two(5), (5, 30, "venue", "reception"), (6, 10, "venue", "ceremony"), (6, 10, "venue", "reception"), (7, 10, "florist", "ceremony"), (7, 20, "venue", "reception")], CREDIT)
    events = spark.createDataFrame([(1, 10), (2, 20), (3, 10), (4, None), (5, 10)], "event_id long, venue_id long")
    facts = spark.createDataFrame([(3, "human_label"), (1, "structural_anchor"), (2, "gossip")], "event_id long, fact string")
    got = {r.event_id: (r.ceremony_id, r.reception_id, r.decision) for r in R.ceremony_splits(credits, events, facts).collect()}
    assert got == {1: (10, 20, "move"), 2: (10, 20, "no_move_needed"), 3: (10, 20, "protected_ceremony_only"), 4: (10, 20, "no_move_needed")}
    assert {r.event_id: (r.protected, r.by_human) for r in R.protections(facts).collect()} == {1: (True, False), 3: (True, True)}


def test_role_sets(spark):
    schema = "event_id long, account_id long, role string"
    existing = spark.createDataFrame([(1, 5, "dj"), (1, 5, "band"), (1, 6, "hotel"), (1, 7, "hotel"), (1, 8, "cake"), (2, 5, None)], schema)
    credits = spark.createDataFrame([(1, 5, "dj"), (1, 5, "mc"), (1, 6, "catering"), (1, 7, "accommodations"), (2, 5, "dj"), (1, 9, "venue")], schema)
    events = spark.createDataFrame([(1, 6), (2, None)], "event_id long, venue_id long")
    got = {(r.event_id, r.account_id): (r.to_insert, r.to_delete, r.unchanged) for r in R.role_differences(existing, credits, events).collect()}
    assert got == {(1, 5): (["mc"], ["band"], ["dj"]), (1, 6): (["catering"], [], []), (1, 7): ([], [], ["accommodations"]), (2, 5): (["dj"], [], [])}
    named = spark.createDataFrame([(1, 6, "venue"), (2, 6, "venue"), (2, 6, "bar"), (2, 5, "dj"), (2, 5, "dj")], schema)
    assert {(r.account_id, r.role): r.n for r in R.role_evidence(named, events).collect()} == {(6, "venue"): 3, (6, "bar"): 1, (5, "dj"): 1}


def test_readers(spark):
    rows = [("THIS_VENUE", "THIS_VENUE", 0.9, "author"), ("THIS_VENUE", "THIS_VENUE", 0.6, "author"), ("OTHER_VENUE", "THIS_VENUE", 0.95, None), ("NOT_WEDDING", "UNSURE", 0.9, None)]
    df = spark.createDataFrame(rows, "human string, model string, confidence double, source string")
    got = {(r.source, r.threshold): (r.n, r.said, r.right, r.precision, r.recall) for r in R.reader_agreement(df, [0.5, 0.8, 0.99]).collect()}
    assert got[("(all)", 0.5)] == (4, 3, 2, 0.666667, 1.0) and got[("(all)", 0.8)] == (4, 2, 1, 0.5, 0.5) and got[("(all)", 0.99)] == (4, 0, 0, None, 0.0)
    assert got[("author", 0.8)] == (2, 1, 1, 1.0, 0.5) and got[("(null)", 0.5)] == (2, 1, 0, 0.0, None)
    readings = spark.createDataFrame([(1, 7, " @Ivy.Room ", None), (2, 7, "other", "The Ivy Room Chicago"), (3, 7, "other", None), (4, 7, "", " "), (5, 8, "ivy.room", "x"), (6, 7, None, "Tree Studios")], "post_id long, venue_id long, handle_guess string, name_guess string")
    accounts = spark.createDataFrame([(7, "ivy.room", "Ivy Room"), (7, "ivy.room", "Tree Studios Hotel")], "account_id long, username string, name string")
    assert {r.post_id: r.match for r in R.attribution(readings, accounts).collect()} == {1: "handle_match", 2: "name_match", 3: "no_match", 4: "model_null", 5: "no_match", 6: "name_match"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def folded(name):
    return " ".join("".join(c for c in name.lower().strip() if c.isalnum() or c == " ").split(" ")).replace("  ", " ")


def one_by_one(names):
    into, kept = {}, []
    for i, n in sorted(names):
        same = next((k for k, m in kept if folded(m) == folded(n) or (min(len(folded(m)), len(folded(n))) >= 4 and (folded(m) in folded(n) or folded(n) in folded(m))) or edits(folded(m), folded(n)) <= 2), None)
        into[i] = i if same is None else same
        kept += [(i, n)] if same is None else []
    return into


@pytest.mark.parametrize("seed", range(2))
def test_small_venues_in_pairs_and_large_ones_on_pieces_find_the_same(spark, seed):
    rng = random.Random(seed)
    rows = [(v, p, "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 8))) if rng.random() < 0.95 else None) for v in (1, 2, None) for p in range(25)]
    spaces = spark.createDataFrame(rows, "venue_id long, place int, name string")
    found = lambda most: sorted(map(tuple, S.alike_names(spaces, most).collect()))
    assert found(256) == found(1) and len(found(256)) == len(set(found(256))) > 0


@pytest.mark.parametrize("seed", range(3))
def test_merged_spaces_are_read_one_by_one(spark, seed):
    rng = random.Random(seed)
    words = ["grand hall", "grand hal", "grnd hall", "the grand hall", "loft", "the loft", "lofts", "bar", "barn", "car", "east bar room", "Roof-top", "rooftop", "x", "", "garden terrace", "gardn terrace"]
    rows = [(v, i, rng.choice(words) + rng.choice(["", "", "s", " 1"])) for v in range(6) for i in range(14)]
    got = {(r.venue_id, r.place): r.into for r in S.merged_spaces(spark.createDataFrame(rows, "venue_id long, place int, name string")).collect()}
    assert got == {(v, i): k for v in range(6) for i, k in one_by_one([(i, n) for w, i, n in rows if w == v]).items()}


def test_sane_spaces_and_capacities(spark):
    spaces = [("v", 0, "hall", "Grand Hall"), ("v", 1, "hall2", "The Grand Hall!"), ("v", 2, "ws", "Wedding Venues"), ("v", 3, "king", "King Suite"), ("v", 4, "kb", "King Ballroom"), ("v", 5, "nn", None), ("w", 0, "only", "Only")]
    caps = [
        ("v", 0, "hall", "seated", 10, 300), ("v", 1, "hall2", "cocktail", 400, 100), ("v", 2, "gone", "seated", None, 50), ("v", 3, None, "dance", None, 700), ("v", 4, "hall", "dance", None, 300), ("v", 5, "kb", "dance", None, 400),
        ("v", 6, "kb", "seated", None, 0), ("v", 7, "kb", "seated", None, 6000), ("v", 8, "kb", "theater", None, 1500), ("w", 0, "only", "seated", None, 1200), ("w", 1, "whole_venue", "seated", None, None),
    ]
    kept, sane, issues = S.sane(spark.createDataFrame(spaces, "venue_id string, place int, id string, name string"), spark.createDataFrame(caps, "venue_id string, place int, space_id string, layout string, min int, max int"))
    assert sorted((r.venue_id, r.id) for r in kept.collect()) == [("v", "hall"), ("v", "kb"), ("v", "nn"), ("w", "only")]
    assert sorted((r.venue_id, r.place, r.space_id, r.min, r.max) for r in sane.collect()) == [("v", 0, "hall", 10, 300), ("v", 1, "hall", 100, 400), ("v", 2, "whole_venue", None, 50), ("v", 4, "hall", None, 300), ("v", 5, "kb", None, 400), ("v", 8, "kb", None, 1500), ("w", 0, "only", None, 1200)]
    assert sorted((r.venue_id, r.code, r.path) for r in issues.collect()) == [
        ("v", "capacity_gt_1000_named_room", "/capacities/kb:theater"), ("v", "capacity_gt_5000", "/capacities/kb:seated"), ("v", "capacity_min_max_swapped", "/capacities/hall:cocktail"), ("v", "capacity_non_positive", "/capacities/kb:seated"),
        ("v", "duplicate_space_merged", "/spaces/hall2"), ("v", "generic_space_name", "/spaces/ws"), ("v", "lodging_room_dropped", "/spaces/king"), ("v", "summed_rooms", "/capacities/whole_venue:dance"), ("v", "unknown_space_id", "/capacities/gone:seated"),
        ("w", "capacity_gt_1000", "/capacities/only:seated"),
    ]
