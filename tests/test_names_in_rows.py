"""Names of a venue meet in its row: the same pairs as by joins, for venues of any size, and names move once."""

import random

from kithgraph.operators import checks


def test_names_meet_in_rows(spark):
    rng = random.Random(2)
    words = ["chair", "covers", "dance", "floor", "a", "the", "12", "(each)", "up", "uplights"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(25)]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(4)))])) for _ in range(160)]
    df = spark.createDataFrame(rows, "venue_id int, id long, name string")
    out = [sorted(tuple(r) for r in checks.similar_names(df, most).collect()) for most in (1_000, 30, 0)]
    assert out[0] == out[1] == out[2] and len(out[0]) > 50
    plan = checks.similar_names(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
