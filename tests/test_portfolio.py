from kithgraph import registry
from kithgraph.operators import evidence as E


def test_portfolio_takes_own_before_tagged(spark):
    pair, hall = "Anna & Ben on their day", "a day at the old hall"
    posts = [("both", pair, 9), ("own", hall, 5), ("two", hall, 8), ("two", hall, 6), ("tagged", hall, None), ("nobody", hall, None), ("short", "  Anna & Ben      ", 4), ("none", None, 4)]
    tagged = [("both", 1), ("tagged", 7), ("tagged", 3), ("tagged", 3), ("short", 2), ("lost", 1)]
    found = E.portfolio(spark.createDataFrame(posts, "post_url string, caption string, account_id long"), spark.createDataFrame(tagged, "post_url string, account_id long"), spark.createDataFrame([("both",), ("both",), ("lost",)], "post_url string"))
    assert sorted(tuple(r) for r in found.collect()) == [("both", 9, "own_profile", True, True, True), ("own", 5, "own_profile", False, False, False), ("tagged", 3, "tagged", False, False, True), ("two", 6, "own_profile", False, False, False)]


def test_portfolio_holds_no_sorted_rows(spark):
    """A task holds numbers of its posts only: no sort, no join and no window, each of which held all rows of the task."""
    plan = registry.queries()["ev11_portfolio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Sort", "Join", "Window")) and plan.count("Exchange") == 1
