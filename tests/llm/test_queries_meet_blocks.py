"""Copies of the queries go to the blocks by a shuffle: the driver holds none, however small their file is."""

from kithgraph.llm import topk


def test_copies_are_not_broadcast(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(0, 7), d -> cast((id * 37 + d * 11) % 19 - 9 AS float) / 64) AS embedding")
    index, n = topk.index(rows, 64, 50)
    asked, m = topk.chunks(rows.where("vec_id % 20 = 0"), 64, 5)
    index.write.parquet(f"{tmp_path}/index")
    asked.write.parquet(f"{tmp_path}/asked")
    found = topk.searched(spark.read.parquet(f"{tmp_path}/index"), spark.read.parquet(f"{tmp_path}/asked"), n, m, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == n * 20 * 3
