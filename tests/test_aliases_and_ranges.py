"""Alias signals, tiers and direction, and the ranges of what an event can cost."""

import itertools
import random

import pytest
from kithgraph.operators import aliases as A
from kithgraph.operators import ranges as R
from pyspark.sql import functions as F

ACCOUNT = "id long, username string, full_name string, url string, biography string, followers long, scraped boolean, category string, events long, in_scope boolean"


def account(i, username, full_name=None, url=None, biography=None, followers=None, scraped=False, category=None, events=0, in_scope=True):
    return (i, username, full_name, url, biography, followers, scraped, category, events, in_scope)


def proposed(spark, accounts, lines=(), readings=(), known=(), denied=(), apart=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = A.proposals(df(accounts, ACCOUNT), df(lines, "post_id long, line_id long, account_id long"), df(readings, "post_id long, anchor_id long, guess string"), df(known, "alias_id long, canonical_id long"), ["linktr.ee", "marriott.com"], list(denied), list(apart))
    return {(r.id_a, r.id_b): (r.signals, r.tier, r.canonical_id, r.section) for r in found.collect()}


def test_stems(spark):
    names = ["TheGeraghtyChicago", "geraghty_events", "lakesidepavilion", "pavilion", "salvageoneevents", "ivy.room", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(A.stem(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["geraghty", "geraghty", "lakeside", "pavion", "salvageone", "ivyroom", "", None]


def test_punctuation(spark):
    pairs = [("ivy.room", "ivyroom", "S1b"), ("venue.", "venue_", "S1b"), ("silverlake.cc", "silverlake_cc", "S1c"), ("same", "SAME", None), ("a", "b", None), ("..", "_", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", A.punctuation_signal(F.col("a"), F.col("b")).alias("got")).collect())


def test_signals_tiers_and_direction(spark):
    got = proposed(spark, [account(1, "ivy.room", "The Ivy Room", followers=10), account(2, "ivyroom", scraped=True)])
    assert got == {(1, 2): ("S1,S1b", "T1", 2, "proposal")}
    got = proposed(spark, [account(1, "silverlake.cc"), account(2, "silverlake_cc", full_name="Silver Lake")])
    assert got == {(1, 2): ("S1,S1c", "T2", 2, "proposal")}
    got = proposed(spark, [account(1, "alpha", "Grand Hall", category="venue"), account(2, "beta", " grand hall", category="venue", followers=5)])
    assert got == {(1, 2): ("S2", "T1", 2, "proposal")}
    got = proposed(spark, [account(1, "navyplace", url="navypier.org"), account(2, "shorehall", url="https://www.navypier.org/host-an-event", in_scope=False), account(3, "other", url="https://linktr.ee/a/"), account(4, "another", url="linktr.ee/a")])
    assert got == {(1, 2): ("S3b", "T2", 1, "proposal"), (3, 4): ("S3", "T3", 4, "proposal")}
    got = proposed(spark, [account(1, "main", biography="Events account: @main_parties"), account(2, "main_parties"), account(3, "sub", biography="managed by @grp.co and, some way further on the page, @third"), account(4, "grp.co"), account(5, "third")])
    assert got == {(1, 2): ("S4", "T1", 1, "proposal"), (3, 4): ("S4", "T3", 4, "related"), (3, 5): ("S4", "T3", 3, "proposal")}
    got = proposed(spark, [account(1, "rivermill_hall", followers=3), account(2, "rivermil_hall"), account(3, "ihchicago1"), account(4, "uhchicago2", followers=9)])
    assert got == {(1, 2): ("S6", "T2", 1, "proposal"), (3, 4): ("S6", "T3", 4, "proposal")}


def test_what_is_never_proposed(spark):
    base = [account(1, "ivy.room"), account(2, "ivyroom")]
    assert proposed(spark, base, known=[(1, 2)]) == {} and proposed(spark, base, known=[(1, 9), (2, 9)]) == {}
    assert proposed(spark, base, denied=["ivyroom"])[1, 2][3] == "related" and proposed(spark, base, apart=[("ivyroom", "ivy.room")])[1, 2][3] == "related"
    assert proposed(spark, [account(1, "st.marychurch"), account(2, "stmarychurch")])[1, 2][3] == "related"
    assert proposed(spark, [account(1, "ivy.room", biography="catering and planning"), account(2, "ivyroom")])[1, 2][3] == "related"
    assert proposed(spark, [account(1, "ivy.room", biography="Our venue offers catering"), account(2, "ivyroom")])[1, 2][3] == "proposal"
    assert proposed(spark, [account(1, "ivy.room", category="florist"), account(2, "ivyroom")])[1, 2][3] == "related"
    crowd = [account(i, f"place{i}", "One Name") for i in range(9)]
    assert proposed(spark, crowd) == {} and proposed(spark, [account(1, None), account(2, None)]) == {}


def test_credited_and_read_pairs(spark):
    rng = random.Random(2)
    lines = [(p, n, rng.randrange(12)) for p in range(40) for n in range(2) for _ in range(rng.randrange(4))] + [(99, 0, i) for i in range(40, 60)] + [(100, i, a) for i in range(3) for a in (1, 2)]
    sets = {}
    for p, n, a in lines:
        sets.setdefault((p, n), set()).add(a)
    posts = {}
    for (p, _), s in sets.items():
        for x, y in itertools.combinations(sorted(s), 2):
            posts.setdefault((x, y), set()).add(p)
    df = spark.createDataFrame([*lines, (None, 1, 1), (1, 1, None)], "post_id long, line_id long, account_id long")
    for least in (1, 2, 5):
        assert {(r.id_a, r.id_b): r.posts for r in A.supported_pairs(df, least).collect()} == {k: len(v) for k, v in posts.items() if len(v) >= least}
    two = [account(1, "alpha"), account(2, "beta"), account(3, "gamma")]
    got = proposed(spark, two, lines=[(p, 0, a) for p in range(5) for a in (1, 2)], readings=[(p, 1, " @Gamma") for p in (1, 2)] + [(3, 1, "@beta"), (4, 2, "@beta")])
    assert got == {(1, 2): ("S5", "T2", 1, "proposal"), (1, 3): ("S7", "T3", 1, "proposal")}


FEE = "venue_id long, path_id string, place int, label string, amount double, space_id string, day string, season string"
TIER = "venue_id long, path_id string, place int, tier_id string, name string, per_guest double, day string, season string"
PATH = "venue_id long, path_id string, min_guests int, max_guests int, space_id string"
RATE = "venue_id long, service_pct double, service_on_all boolean, tax_pct double, tax_on_all boolean"


def priced(spark, paths, fees=(), tiers=(), rates=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return R.priced_paths(df(paths, PATH), df(fees, FEE), df(tiers, TIER), df(rates, RATE))


def test_shown_ranges(spark):
    marchetti = [(1, "p", 0, "argento", "Argento", 200.0, "sun", None), (1, "p", 1, "platino", "Platino", 300.0, "sat", None)]
    london = [(2, "p", 0, "e", "Elegance", 150.0, None, None), (2, "p", 1, "o", "Opulence", 220.0, None, None)]
    one = [(3, "p", 0, "only", "All-Inclusive", 100.0, None, None)]
    paths = [(1, "p", 50, 425, "pavilion"), (2, "p", None, 190, "grand"), (3, "p", None, 300, "hall"), (4, "hall", None, 150, "hall"), (5, "none", None, None, None)]
    fees = [(4, "hall", 0, "Rental", 2100.0, None, None, None), (4, "hall", 1, "Early bird lunch special", 10.0, None, None, None), (4, "hall", 2, "x", None, None, None, None)]
    rows = {r.venue_id: tuple(r)[2:] for r in R.shown_range(priced(spark, paths, fees, marchetti + london + one)).collect()}
    assert rows[1] == (10_000.0, 127_500.0, "sun", "sat", "Argento", "Platino")
    assert rows[2] == (1_500.0, 190 * 220.0, None, None, "Elegance", "Opulence")
    assert rows[3] == (1_000.0, 30_000.0, None, None, None, None)
    assert rows[4] == (2100.0, 2100.0, None, None, None, None) and rows[5][:2] == (0.0, 0.0)


def test_extremes_find_what_a_rule_of_thumb_misses(spark):
    """The cheapest tier holds on no cheap day; a space's own fee takes the place of the whole venue's."""
    tiers = [(1, "a", 0, "t", "T", 100.0, None, None), (1, "a", 1, "t2", "T", 60.0, "weekday", "off"), (1, "a", 2, "u", "U", 90.0, "sat", None)]
    fees = [(1, "a", 0, "Whole", 5000.0, None, None, None), (1, "b", 0, "Whole", 900.0, None, None, None), (1, "b", 1, "Loft", 400.0, "loft", "sat", None), (1, "b", 2, "Deck", 99.0, "deck", None, None)]
    rates = [(1, 20.0, False, 10.0, True)]
    row = R.extremes(priced(spark, [(1, "a", 10, 20, "loft"), (1, "b", 10, 20, "loft"), (2, "c", 1, 2, None)], fees, tiers, rates)).collect()
    assert [tuple(r) for r in row] == [(1, 0.0, "b", 5000 + 2000 + 400 + 740.0, "a")]
    assert R.extremes(priced(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_extremes_equal_enumeration(spark, seed):
    rng = random.Random(seed)
    days, seasons, spaces = [None, "any", "weekday", "fri", "sat", "sun"], [None, "any", "peak", "off"], [None, "loft", "deck"]
    paths = [(v, p, rng.choice([None, 20]), rng.choice([None, 90]), rng.choice(spaces)) for v in range(5) for p in ("x", "y")]
    fees = [(v, p, i, "Fee", float(rng.randrange(900)), rng.choice(spaces), rng.choice(days), rng.choice(seasons)) for v, p, *_ in paths for i in range(rng.randrange(4))]
    tiers = [(v, p, i, f"t{i}", rng.choice("ab"), float(rng.randrange(20, 90)), rng.choice(days), rng.choice(seasons)) for v, p, *_ in paths for i in range(rng.randrange(4))]
    rates = [(v, 18.0, v % 2 == 0, 9.5, v % 3 == 0) for v in range(4)]
    fits = lambda d, s, day, season: (d in (None, "any", day) or (d == "weekday" and day in R.DAYS[:4])) and s in (None, "any", season)
    spec = lambda d, s: (0 if d in (None, "any") else 1 if d == "weekday" else 2) + (0 if s in (None, "any") else 1)
    half = lambda x: int(x + 0.5)
    want = {}
    for v, p, lo, hi, space in paths:
        fs, ts = [f for f in fees if f[:2] == (v, p)], [t for t in tiers if t[:2] == (v, p)]
        if not fs and not ts:
            continue
        _, sv, sa, tx, ta = next((r for r in rates if r[0] == v), (v, 0, False, 0, False))
        own = space is not None and any(f[5] == space for f in fs)
        for day, season in itertools.product(R.DAYS, R.SEASONS):
            venue = sum(f[4] for f in fs if fits(f[6], f[7], day, season) and (f[5] == space if f[5] is not None else not own))
            options = {}
            for t in sorted((t for t in ts if fits(t[6], t[7], day, season)), key=lambda t: (-spec(t[6], t[7]), t[2])):
                options.setdefault(t[4], t[5])
            least = lo or 10
            for price, guests in itertools.product(options.values() or [0.0], (least, max(hi or least, least))):
                food = price * guests
                service = half((food + (venue if sa else 0)) * sv / 100)
                total = round(venue + food + service + half((food + service + (venue if ta else 0)) * tx / 100), 2)
                want.setdefault(v, []).append(total)
    got = {r.venue_id: (r.low, r.high) for r in R.extremes(priced(spark, paths, fees, tiers, rates)).collect()}
    assert got == {v: (min(x), max(x)) for v, x in want.items()}


def test_names_within_edits_are_those_of_all_pairs(spark):
    import random

    from kithgraph.operators import entities

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(60)] + ["x" * n + t for n in (36, 37, 38, 39) for t in ("", "a", "ab", "abc", "bca")]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(99, None, 0)]
    names = spark.createDataFrame(rows, "id long, name string, block int")

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, line[0] = line[0], i + 1
            for j, y in enumerate(b):
                last, line[j + 1] = line[j + 1], min(line[j + 1] + 1, line[j] + 1, last + (x != y))
        return line[-1]

    for most in (1, 2):
        want = sorted((i, j, edits(a, b)) for i, a, x in rows for j, b, y in rows if i < j and a is not None and b is not None and x == y and edits(a, b) <= most)
        assert sorted(map(tuple, entities.within_edits(names, most).collect())) == want


def test_a_shared_beginning_brings_no_pairs_together(spark):
    from kithgraph.operators import entities

    names = spark.range(40).select("id", F.concat(F.lit("thehallofthelake"), F.md5(F.col("id").cast("string")).substr(1, 10)).alias("name"))
    keys = names.select("id", F.explode(entities.variants(F.col("name"), 2)).alias("v"))
    assert keys.groupBy("v").count().where("count > 1").isEmpty() and entities.within_edits(names, 2).isEmpty()
