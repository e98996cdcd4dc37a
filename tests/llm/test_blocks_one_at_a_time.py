"""What a task of the resampling holds does not grow with the blocks: few of them in a row group, one of them with its gains."""

import glob

import pyarrow.parquet as pq
from kithgraph.llm import importance
from kithgraph.llm.common import Scratch


def test_few_blocks_are_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_CHARS", 40)
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "concat('alpha beta gamma ', id, ' delta') AS text")
    with Scratch(spark) as scratch:
        parsed = scratch(importance.blocks(docs, 1), "blocks", importance.TOGETHER)
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{scratch.paths[0].removeprefix('file:')}/*.parquet")]
        groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
        assert sum(groups) == 60 and max(groups) <= importance.TOGETHER
        words = importance.dictionary(parsed, parsed, 50)
        plan = importance.weights(parsed, words, importance.gains(words, 50))._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
