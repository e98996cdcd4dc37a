from test_aliases_and_ranges import FEE, PATH, RATE, TIER

from kithgraph import registry
from kithgraph.operators import ranges as R


def test_prices_of_odd_rows(spark):
    """Tiers without a name are one name, daytime fees are none, prices without a path belong to nobody."""
    paths = [(1, "a", 10, 20, None), (2, "b", 1, 1, "loft"), (3, "c", 5, None, None), (4, "d", 1, 1, None)]
    tiers = [(1, "a", 0, "t", None, 5.0, "any", None), (1, "a", 1, "u", None, 3.0, "any", "any"), (3, "c", 0, "t", "T", float("nan"), None, None), (3, "c", 1, "u", "U", 7.0, None, None), (9, "a", 0, "t", "T", 1.0, None, None), (None, "a", 0, "t", "T", 1.0, None, None)]
    fees = [(2, "b", 0, "Lunch", 50.0, "loft", None, None), (2, "b", 1, "Whole", 8.0, None, None, None), (4, "d", 0, None, 0.125, None, "mon", None), (4, "d", 1, "x", None, None, None, None)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = R.extremes(R.priced_paths(df(paths, PATH), df(fees, FEE), df(tiers, TIER), df([(2, 50.0, True, None, None)], RATE)))
    got = {r.venue_id: (r.low, str(r.high)) for r in found.collect()}
    assert got == {1: (50.0, "100.0"), 2: (0.0, "0.0"), 3: (35.0, "nan"), 4: (0.0, "0.13")}


def test_combinations_are_not_priced_by_lambda_functions(spark):
    """Each of the combinations filtered and searched the price lists by lambda functions; a task met its lists by joins."""
    plan = registry.queries()["doc14_cost_extremes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 4 and "exists(" not in plan
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 1
