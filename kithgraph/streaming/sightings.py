"""First observations and changes of keyed rows, over a log that is dealt by the hash of the key.

A batch reads only the partitions of the log that its keys fall into, and only adds files, so nothing that is written can be
lost by a run that is cut off. A sighting is named by its run and its key; one that is there already is not added again, so a
batch may run twice. For sources that never repeat a sighting, `changes` keeps the same as state of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kithgraph.operators.helpers import latest_by
from kithgraph.streaming.ingest import started

BUCKETS = 64
LOG = "run_id string, key string, observed_at timestamp, digest string, is_first boolean, changed boolean, bucket int"


def bucket_of(key: str = "key"):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def held(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """The log's rows in some partitions, without looking into the others; none where there is no log yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path).where(F.col("bucket").isin(buckets))


def record(batch: DataFrame, path: str) -> None:
    """Adds the sightings of a batch (run_id, key, observed_at, content) to the log (LOG) under a path.

    is_first: no other run has seen the key before; of several runs in a batch the one that is first by (observed_at, run_id).
    changed: the content's digest is another than that of the first sighting. A run's repeated sightings of a key count once,
    the first one. Null keys and runs are left out; null content is empty. Absence says nothing.
    """
    spark = batch.sparkSession
    rows = batch.where("run_id is not null and key is not null").select(F.col("run_id").cast("string").alias("run_id"), F.col("key").cast("string").alias("key"), F.col("observed_at").cast("timestamp").alias("observed_at"), F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256).alias("digest"))
    rows = latest_by(rows, ["run_id", "key"], [F.col("observed_at"), F.col("digest")]).withColumn("bucket", bucket_of())
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    log = held(spark, path, touched)
    new = rows.join(log.select("run_id", "key", "bucket"), ["run_id", "key", "bucket"], "left_anti")
    before = log.where("is_first").select("key", "bucket", F.col("digest").alias("old"))
    first = new.groupBy("key", "bucket").agg(F.min_by(F.struct("run_id", "digest"), F.struct("observed_at", "run_id")).alias("f"))
    told = new.join(before, ["key", "bucket"], "left").join(first, ["key", "bucket"])
    is_first = F.col("old").isNull() & (F.col("f.run_id") == F.col("run_id"))
    told = told.select("run_id", "key", "observed_at", "digest", is_first.alias("is_first"), (F.coalesce("old", "f.digest") != F.col("digest")).alias("changed"), "bucket")
    told.write.mode("append").partitionBy("bucket").parquet(path)


def recorded(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the log of a stream of sightings; a batch that is run again adds nothing."""
    return started(stream, lambda batch, _: record(batch, path), checkpoint, once)


def log_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path).drop("bucket")


def changes(stream: DataFrame) -> DataFrame:
    """(key, run_id, observed_at, is_first, changed) of a stream (run_id, key, observed_at, content), as state per key.

    The state is the first digest; it lives in the stream's state store, dealt by key, and is kept for good.
    """
    rows = stream.where("key is not null").select("run_id", F.col("key").cast("string").alias("key"), "observed_at", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256).alias("digest"))

    def tell(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(batches)).sort_values(["observed_at", "run_id"])
        old = state.get[0] if state.exists else None
        first = found["digest"].iloc[0] if old is None else old
        state.update((first,))
        is_first = [old is None and i == 0 for i in range(len(found))]
        yield pd.DataFrame({"key": key[0], "run_id": found["run_id"].tolist(), "observed_at": found["observed_at"].tolist(), "is_first": is_first, "changed": (found["digest"] != first).tolist()})

    out = "key string, run_id string, observed_at timestamp, is_first boolean, changed boolean"
    return rows.groupBy("key").applyInPandasWithState(tell, out, "digest string", "append", GroupStateTimeout.NoTimeout)
