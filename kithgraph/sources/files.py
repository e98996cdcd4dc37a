"""Files as sources and sinks: CSV, JSON, snapshots, and tables written by insert-or-ignore and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators.helpers import latest_by


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted fields, with a stated schema."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or objects over several lines, with a stated schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def snapshot(df: DataFrame, path: str) -> None:
    """A gzipped CSV snapshot, a file per partition."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip", quote='"', escape='"')


def inserted(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The target with new rows whose key it lacks; of new rows of one key the first stays."""
    first = latest_by(new, list(keys), list(order))
    return target.unionByName(first.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def upserted(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The target with new rows in place of old ones of the same key: one shuffle by key over both."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, list(keys), [F.desc("_new"), *order]).drop("_new")


def updated(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The target with columns from a source of one row per key, where it has one and the value is not null."""
    values = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = target.join(values, list(keys), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*target.columns)


def change_log(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that differ between two states, with both as JSON."""
    side = lambda df, name: df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
    both = side(before, "before").join(side(after, "after"), list(keys), "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
