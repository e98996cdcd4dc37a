"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from kithgraph.llm import chat, clusters, decontaminate, fingerprints, importance, packing, pii, quality, repeats, simhash, store, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": simhash.op1_simhash,
        "op2_packing": packing.op2_packing,
        "op3_quality": quality.op3_quality,
        "op4_store": store.op4_store,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_warc": warc.op6_warc,
        "op7_chat": chat.op7_chat,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_repeats": repeats.op9_repeats,
        "op10_personal_data": pii.op10_personal_data,
        "op11_resampling": importance.op11_resampling,
        "op12_clusters": clusters.op12_clusters,
        "op13_top_k": topk.op13_top_k,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op5_decontamination": decontaminate.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_chat": chat.OP7_SQL,
        "op11_resampling": importance.OP11_SQL,
        "op12_clusters": clusters.OP12_SQL,
        "op13_top_k": topk.OP13_SQL,
    }
