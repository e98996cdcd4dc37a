"""One-to-one matching, aligned spaces and compared clusterings against plain versions."""

import itertools
import random

import pytest
from kithgraph.operators import clusterings as C
from kithgraph.operators import entities as E
from kithgraph.operators import matching as M
from pyspark.sql import functions as F


def greedy(pairs):
    out, ls, rs = [], set(), set()
    best = {}
    for b, l, r, w in pairs:
        if None not in (b, l, r, w):
            best[b, l, r] = max(w, best.get((b, l, r), w))
    for (b, l, r), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if (b, l) not in ls and (b, r) not in rs:
            out.append((b, l, r, w))
            ls.add((b, l))
            rs.add((b, r))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matching_is_sequential(spark, seed):
    rng = random.Random(seed)
    n, ties = (30, 4) if seed % 2 else (12, 1000)
    pairs = [(rng.randrange(3), f"l{rng.randrange(n)}", f"r{rng.randrange(n)}", rng.randrange(ties) / 7) for _ in range(400)]
    pairs += [(0, f"l{i}", "r0", 1.0 + i) for i in range(n)] + [(None, "a", "b", 1.0), (1, None, "b", 1.0), (1, "a", "b", None), pairs[0]]
    df = spark.createDataFrame(pairs, "block long, left string, right string, weight double")
    assert sorted(tuple(r) for r in M.greedy_matching(df).collect()) == greedy(pairs)


def test_greedy_matching_of_a_chain(spark):
    """Each pair waits for the heavier one next to it."""
    pairs = [(0, f"l{i // 2 + i % 2:02}", f"r{i // 2:02}", 100.0 - i) for i in range(14)]
    df = spark.createDataFrame(pairs, "block long, left string, right string, weight double")
    assert sorted(tuple(r) for r in M.greedy_matching(df).collect()) == greedy(pairs)
    assert M.greedy_matching(df.limit(0)).count() == 0


def aligned(spark, golden, candidate):
    side = lambda rows: spark.createDataFrame([("v", *r) for r in rows], "venue_id string, id string, name string")
    return sorted((r.candidate_id, r.golden_id, r.rule) for r in M.aligned_spaces(side(golden), side(candidate)).collect())


def test_aligned_spaces(spark):
    assert aligned(spark, [("the-pavilion", "Pavilion"), ("loft", "Loft")], [("the_pavilion", "X"), ("Loft", "Y")]) == [("Loft", "loft", "id"), ("the_pavilion", "the-pavilion", "id")]
    two = [("grand-ballroom", "The Grand Ballroom"), ("foyer", "Grand Foyer")]
    assert aligned(spark, two, [("a", "Grand Ballroom"), ("b", "Ballroom, Grand"), ("c", "Rooftop")]) == [("a", "grand-ballroom", "name")]
    assert aligned(spark, two, [("a", "Grand Foyer"), ("b", "The Grand Ballroom!")]) == [("a", "foyer", "name"), ("b", "grand-ballroom", "name")]
    assert aligned(spark, [("loft", "Greenhouse Loft")], [("everything", "All of it")]) == [("everything", "loft", "single"), ("whole_venue", "loft", "whole_venue")]
    assert aligned(spark, [("loft", "Loft")], [("whole_venue", "Loft"), ("b", None), (None, "Loft")]) == [("whole_venue", "loft", "name")]
    assert aligned(spark, [("loft", "Loft")], [("a", "x"), ("b", "y")]) == [("whole_venue", "loft", "whole_venue")]
    assert aligned(spark, [], [("a", "x")]) == []


def test_name_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    words = ["hall", "grand", "loft", "room", "north", "south", "bar", "terrace"]
    rows = lambda p: [(i % 2, f"{p}{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    a, b = rows("a"), rows("b")
    df = lambda x: spark.createDataFrame(x, "block long, id string, name string")
    for least in (0.3, 0.5, 0.8):
        j = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
        want = sorted((v, i, k, round(j(n, m), 9)) for v, i, n in a for w, k, m in b if v == w and j(n, m) >= least)
        assert sorted((r.block, r.left, r.right, round(r.weight, 9)) for r in M.name_pairs(df(a), df(b), least).collect()) == want


def test_capacities_meet_by_aligned_space(spark):
    cap = "venue_id string, space_id string, layout string, max int"
    golden = spark.createDataFrame([("v", "loft", "seated", 100), ("v", "loft", "cocktail", 150), ("w", None, "seated", 80)], cap)
    candidate = spark.createDataFrame([("v", "greenhouse_loft", "seated", 100), ("v", None, "cocktail", 140), ("v", "roof", "seated", 20), ("w", "whole_venue", "seated", 80)], cap)
    alignment = spark.createDataFrame([("v", "greenhouse_loft", "loft"), ("v", "whole_venue", "loft")], "venue_id string, candidate_id string, golden_id string")
    assert sorted(tuple(r) for r in M.capacity_score(golden, candidate, alignment).collect()) == [("v", 2, 2, 1, 1), ("w", 1, 1, 1, 0)]


def plain(a, b):
    items = sorted(set(a) & set(b))
    ca, cb = {}, {}
    for i in items:
        ca.setdefault(a[i], set()).add(i)
        cb.setdefault(b[i], set()).add(i)
    pairs = list(itertools.combinations(items, 2))
    ta, tb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    both, n = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs), len(pairs)
    same = sum(s in cb.values() for s in ca.values())
    merges, splits = sum(len({a[i] for i in s}) > 1 for s in cb.values()), sum(len({b[i] for i in s}) > 1 for s in ca.values())
    moved = sum(len(s) - max(sum(b[i] == c for i in s) for c in cb) for s in ca.values())
    rand = round(sum((a[i] == a[j]) == (b[i] == b[j]) for i, j in pairs) / n, 9) if n else None
    e = ta * tb / n if n else 0
    adjusted = None if not n else 1.0 if both == ta == tb else round((both - e) / ((ta + tb) / 2 - e), 9)
    return (len(items), len(ca), len(cb), same, merges, splits, moved, ta, tb, both, rand, adjusted)


@pytest.mark.parametrize("seed", range(3))
def test_compared_clusterings(spark, seed):
    rng = random.Random(seed)
    a = {i: rng.randrange(6) for i in range(40)}
    b = {i: a[i] if i in a and rng.random() < 0.7 else rng.randrange(9) for i in range(3, 45)} if seed else dict(a)
    df = lambda x: spark.createDataFrame(sorted(x.items()), "item long, cluster long")
    row = C.compared(df(a), df(b)).first()
    assert tuple(row) == pytest.approx(plain(a, b), abs=1e-8)


def test_compared_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "item long, cluster long")
    assert tuple(C.compared(df([]), df([])).first())[-2:] == (None, None)
    assert tuple(C.compared(df([(1, 1)]), df([(1, 5)])).first())[-2:] == (None, None)
    assert C.compared(df([(1, 1), (2, 2)]), df([(1, 5), (2, 6)])).first().adjusted_rand == 1.0
    parts = sorted(tuple(r) for r in C.merged_clusters(df([(1, 1), (2, 2), (3, 3)]), df([(1, 9), (2, 9), (3, 8)])).collect())
    assert parts == [(9, 1, 1, 2, 2), (9, 2, 1, 2, 2)]
    assert tuple(C.sizes(df([(1, 1), (2, 1), (3, 2), (4, 4), (5, 4), (6, 4)])).first()) == (3, 1, 1, 1, 3)


def test_inclusive_fold_merges_what_the_strict_one_keeps(spark):
    posts = spark.createDataFrame([(1, "2024-01-01", ["a", "b"]), (2, "2024-01-02", ["a", "b", "c", "d"]), (3, "2024-01-03", ["x"])], "id long, date string, members array<string>").selectExpr("id", "to_date(date) AS date", "members")
    fold = lambda **how: E.greedy_events(posts, **how).selectExpr("post_id AS item", "event_id AS cluster")
    r = C.compared(fold(), fold(inclusive=True)).first()
    assert (r.clusters_a, r.clusters_b, r.merges, r.splits, r.same) == (3, 2, 1, 0, 1)


def test_rows_linked_to_none_are_in_no_component_and_folds_share_rows(spark):
    rows = [(i, f"2024-01-{1 + i % 9:02d}", [f"{i // 3}:a", f"{i // 3}:{i % 2}"]) for i in range(60)] + [(90, "2024-01-01", ["x"]), (91, None, ["x"]), (92, "2024-01-01", [])]
    posts = spark.createDataFrame(rows, "id long, date string, members array<string>").withColumn("date", F.to_date("date"))
    found = E.fold_rows(posts)
    assert {r.id for r in found.where("component_id is null").collect()} == {90, 91, 92}
    got = sorted(map(tuple, E.greedy_events(posts, inclusive=True).collect()))
    assert got == sorted(map(tuple, E.greedy_events(posts, inclusive=True, rows=found).collect())) and len(got) == 63
    alone = [E.greedy_events(posts.where(F.col("id").between(i, i + 2)), inclusive=True) for i in (0, 30)]  # components fold as if they were by themselves
    assert all(set(map(tuple, a.collect())) <= set(got) for a in alone)
