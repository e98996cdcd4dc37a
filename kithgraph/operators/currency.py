"""What is current, stale, frozen or of one batch: views over run logs, rebuilt tables, conditional deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.helpers import checksum, latest_by


def current(runs: DataFrame, key: str, at: str, tie: str, kind: Column | None = None) -> DataFrame:
    """The latest run of each key, of one kind if given (the filter comes first), ties by the larger `tie`."""
    rows = runs if kind is None else runs.where(kind)
    return latest_by(rows, [key], [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def stale(rows: DataFrame, behind: str | None = None, below: float | None = None, before: Column | None = None) -> DataFrame:
    """Current rows to be looked at again: of another version, of less confidence, or older. One condition at least."""
    tests = []
    if behind is not None:
        tests.append(F.col("version") != behind)
    if below is not None:
        tests.append(F.col("confidence") < below)
    if before is not None:
        tests.append(F.col("at") < before)
    if not tests:
        raise ValueError("give a version, a confidence or an age")
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    return rows.where(some)


def of_batch(posts: DataFrame, sightings: DataFrame, batch: Column, on: str) -> DataFrame:
    """Posts first seen in one batch. The semi-join comes before whatever is computed from the posts, so only they are parsed."""
    return posts.join(sightings.where(batch & F.col("is_first")).select(on).distinct(), on, "left_semi")


def deleted_without(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """What a delete of rows without a partner leaves."""
    return rows.join(others.select(on).distinct(), on, "left_semi")


def rebuilt(df: DataFrame, path: str) -> DataFrame:
    """Writes a table anew over what was there, and reads it: truncate and rebuild, or the refresh of a materialised view.

    Spark removes the old files before it runs the plan, so a plan that reads the path itself fails by its own check.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frozen(df: DataFrame, path: str) -> str:
    """Writes a set once and for all and returns its checksum as text; a second write fails."""
    df.write.mode("errorifexists").parquet(path)
    line = checksum(df.sparkSession.read.schema(df.schema).parquet(path)).first()
    return f"{line['n_rows']}:{line['xor_hash']}:{line['sum_hash']}"


def text_cache(pages: DataFrame, text: str, key: str) -> DataFrame:
    """Texts by the SHA-256 of their bytes, each once, with how many rows name it and the least of their keys."""
    rows = pages.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("address"), F.col(text).alias("text"), F.col(key).alias("key"))
    return rows.groupBy("address").agg(F.first("text").alias("text"), F.count("*").alias("n_refs"), F.min("key").alias("first_key"))


def content_corpus(scores: DataFrame, runs: DataFrame, posts: DataFrame, vendors: DataFrame, version: str) -> DataFrame:
    """Scored posts with their latest run of one version, the post and, if any, its vendor.

    scores: post_id, score; runs: post_id, run_id, version, decision, at; posts: post_id, vendor_id, posted_at;
    vendors: vendor_id, name.
    """
    now = current(runs, "post_id", "at", "run_id", F.col("version") == version).select("post_id", "decision", "at")
    return scores.join(now, "post_id").join(posts, "post_id").join(vendors, "vendor_id", "left")


def confirmed_content(golden: DataFrame, places: DataFrame) -> DataFrame:
    """Posts that a person included and whose place is confirmed."""
    return golden.where("decision = 'INCLUDE'").join(places.where("status = 'CONFIRMED'").select("post_id"), "post_id", "left_semi")
