"""Plan shapes that the views share: latest row per key, priority picks, first matches, canonical ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a total order; null keys form a group. Filter before for latest-within, after for latest-then."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def priority_pick(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key the row of the first source that has any, by `order` within a source: one shuffle in place of chained anti-joins."""
    every = None
    for i, source in enumerate(sources):
        part = source.withColumn("_priority", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return latest_by(every, keys, [F.col("_priority"), *order]).drop("_priority")


def first_match(left: DataFrame, right: DataFrame, on: str, by: Column, values: Sequence[str]) -> DataFrame:
    """Left rows with the values of the first right row per key (a left lateral join with LIMIT 1), aggregated before the join."""
    first = right.groupBy(on).agg(F.min_by(F.struct(*values), by).alias("_first"))
    return left.join(first, on, "left").select(*left.columns, *[F.col(f"_first.{v}").alias(v) for v in values])


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replaces ids by their canonical id, one hop. aliases: alias_id, canonical_id, one row per alias. Spark broadcasts it if it is small."""
    of = aliases.select(F.col("alias_id").alias(column), F.col("canonical_id").alias("_canonical"))
    return df.join(of, column, "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical").select(*df.columns)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows per stratum in the order of the MD5 of a key: the same sample on every run."""
    return latest_rank(df, [stratum], [F.md5(F.col(key).cast("string")), F.col(key)]).where(F.col("rn") <= n)


def latest_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds rn, the number of a row within its key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def round_robin(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, one of each group in turn; within a group by the MD5 of a key."""
    return latest_rank(df, [group], [F.md5(F.col(key).cast("string")), F.col(key)]).orderBy("rn", group).limit(n)


def bands(value: Column, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """The label of the band that a value falls into: labels[i] up to bounds[i] inclusive, the last label beyond."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(value <= bound, label)
    return out.otherwise(labels[-1])


def capped_confidence(n: Column) -> Column:
    """Confidence from n pieces of evidence: 0.5 and 0.15 for each, 0.95 at most."""
    return F.round(F.least(F.lit(0.5) + F.lit(0.15) * n, F.lit(0.95)), 6)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def top_share(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row: the total of a value and the share of its n largest rows. The top n are taken in each task before they meet."""
    top = df.select(F.col(value).alias("_v")).where("_v is not null").orderBy(F.desc("_v")).limit(n).agg(F.sum("_v").alias("_top"))
    return df.agg(F.sum(value).alias("total")).crossJoin(top).select("total", F.round(F.try_divide(F.col("_top"), F.col("total")), 6).alias("top_share"))


def checksum(df: DataFrame) -> DataFrame:
    """An order-independent checksum of a relation: rows, and the exclusive or and sum of row hashes, combined before they are moved."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    part = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long")
    return df.select(part.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"), F.coalesce(F.sum((F.col("h") % 1000003)), F.lit(0)).alias("sum_hash"))
