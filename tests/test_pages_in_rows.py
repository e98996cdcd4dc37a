"""Pages are parsed a few at a time: no Arrow batch of pages, each parsed once."""

from kithgraph.functions import urls as U


def test_page_texts_in_rows(spark):
    rows = [(1, "https://a", "<p>One <b>two</b></p><script>x</script><a href='/q'>three</a>"), (2, None, None), (None, "https://b", "")]
    got = U.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(((r.page_id, r.url, r.text, r.links) for r in got.collect()), key=str) == [(1, "https://a", "One two\nthree", ["/q"]), (2, None, "", []), (None, "https://b", "", [])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "Pandas" not in plan and "Arrow" not in plan
