"""The four kinds of windows of the must-not rules share sorts."""

from kithgraph.operators import mustnot as N


def test_fewer_sorts_than_windows(spark):
    found = spark.createDataFrame([(1, "/a[0]/n", "string", "x"), (1, "/a[1]/n", "string", "X"), (1, "/k", "string", "v")], "doc_id long, path string, kind string, value string")
    rules = spark.createDataFrame([("twins", "twins", "/a[*]/n", "-", None, None, "/k", "v", None), ("listed", "one_of", "/a[*]/n", "x|y", None, None, None, None, None)], N.RULES)
    broken = N.violations(found, rules)
    assert broken._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 3
    assert sorted((r.rule_id, r.path) for r in broken.collect()) == [(x, p) for x in ("listed", "twins") for p in ("/a[0]/n", "/a[1]/n")]
