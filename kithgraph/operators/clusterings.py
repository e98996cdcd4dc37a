"""Two clusterings of the same items compared through their contingency counts, never through pairs of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.session import ensure_checkpoints


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, n): items in both. a and b: item, cluster, one row per item; items of one side only are left out."""
    return a.select("item", F.col("cluster").alias("cluster_a")).join(b.select("item", F.col("cluster").alias("cluster_b")), "item").groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("n"))


def pairs_of(n: Column) -> Column:
    """How many pairs n items make, as an exact decimal: clusters of billions overflow a long."""
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - 1) / 2).cast("decimal(38,0)")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row that tells how clustering b differs from a. Both: item, cluster.

    same: clusters with exactly the same items; merges: clusters of b that take items of several of a; splits: clusters
    of a whose items lie in several of b; moved: items that are not where most of their cluster of a went; together_a,
    together_b, together_both: pairs of items in one cluster; rand and adjusted_rand from these (null where the adjusted
    index has no range, as with a single item; 1 where both clusterings are all alone or all together). No items give zeros
    and null indices.
    """
    ensure_checkpoints(a.sparkSession)
    cells = contingency(a, b).checkpoint()
    by_a = cells.groupBy("cluster_a").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("n").alias("most"), F.min("cluster_b").alias("cluster_b"))
    by_b = cells.groupBy("cluster_b").agg(F.sum("n").alias("n_b"), F.count("*").alias("parts_b"))
    same = by_a.where("parts = 1").join(by_b.where("parts_b = 1"), "cluster_b").agg(F.count("*").alias("same"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    left = by_a.agg(zero(F.sum("n")).alias("items"), F.count("*").alias("clusters_a"), F.count_if(F.col("parts") > 1).alias("splits"), zero(F.sum(F.col("n") - F.col("most"))).alias("moved"), zero(F.sum(pairs_of(F.col("n")))).alias("together_a"))
    right = by_b.agg(F.count("*").alias("clusters_b"), F.count_if(F.col("parts_b") > 1).alias("merges"), zero(F.sum(pairs_of(F.col("n_b")))).alias("together_b"))
    both = cells.agg(zero(F.sum(pairs_of(F.col("n")))).alias("together_both"))
    row = left.crossJoin(right).crossJoin(both).crossJoin(same)  # four rows of one each
    x, y, z, every = (F.col(c).cast("double") for c in ("together_a", "together_b", "together_both", "_every"))
    expected = F.try_divide(x * y, every)
    adjusted = F.when((z == x) & (z == y) & (every > 0), F.lit(1.0)).otherwise(F.try_divide(z - expected, (x + y) / 2 - expected))
    rand = F.try_divide(every + 2 * z - x - y, every)
    row = row.withColumn("_every", pairs_of(F.col("items")))
    return row.select("items", "clusters_a", "clusters_b", "same", "merges", "splits", "moved", *[F.col(c).cast("long").alias(c) for c in ("together_a", "together_b", "together_both")], F.round(rand, 9).alias("rand"), F.round(adjusted, 9).alias("adjusted_rand"))


def merged_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cluster_b, cluster_a, n, n_b, parts): what each cluster of b that merges several of a is made of, a row per part."""
    cells = contingency(a, b)
    whole = cells.groupBy("cluster_b").agg(F.sum("n").alias("n_b"), F.count("*").alias("parts")).where("parts > 1")
    return cells.join(whole, "cluster_b").select("cluster_b", "cluster_a", "n", "n_b", "parts")


def sizes(clustering: DataFrame) -> DataFrame:
    """One row of a clustering (item, cluster): clusters, those of one, of two and of more items, and the largest."""
    each = clustering.groupBy("cluster").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singles"), F.count_if(F.col("n") == 2).alias("couples"), F.count_if(F.col("n") > 2).alias("larger"), F.max("n").alias("largest"))
