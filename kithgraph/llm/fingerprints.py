"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text is normalised (NFKC), case-folded and has its white space folded; two chained xxhash64 values of that give a
128-bit key. Rows are grouped by key, and in buckets of several rows the canonical texts are compared byte by byte. A
bucket that holds different texts gets the SHA-256 as a suffix, so equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch, text_of, written

#: The public Unicode library that Spark ships for its collations.
NORMALIZER, CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space as one space, none at the ends. Null counts as empty."""
    folded = F.reflect(F.lit(CHARACTERS), F.lit("foldCase"), F.reflect(F.lit(NORMALIZER), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)), F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\p{Z}\s]+", " "))


def key_columns(canon: str, prefix: str = "") -> list[Column]:
    """The two halves of the wide key."""
    return [F.xxhash64(canon).alias(f"{prefix}a"), F.xxhash64(F.lit("wide"), F.col(canon)).alias(f"{prefix}b")]


def constant(values: list, kind: str) -> Column:
    """An array of constants, which the optimizer folds out of one string."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row with `next_text`, the text of the row that follows by ascending key; after the last comes the first.

    One shuffle: rows go by ranges of the key, whose bounds are sampled quantiles, and each range ends in a copy of the
    head of the range after it. Only one key per range passes through the driver and comes back as constants. Ties in the key are ordered by the hash of the text, null keys come first.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    step = max(1, math.isqrt(len(cuts)))  # bounds are looked up by block, then within the block
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)] + [[]]
    tops = [x[-1] for x in blocks if len(x) == step]
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col(key)))
    passed = below(constant(tops, "array<bigint>"))
    place = F.when(F.col(key).isNull(), 0).otherwise(passed * step + below(F.get(constant(blocks, "array<array<bigint>>"), passed)) + 1)
    rows = docs.withColumn("_range", place.cast("int"))
    heads = rows.groupBy("_range").agg(F.min(key).alias("head")).orderBy("_range").collect()  # a row per range
    if not heads:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    first, before = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, r in enumerate(heads):
        first[r["_range"]], before[r["_range"]] = r["head"], heads[i - 1]["_range"]
    is_head = F.get(constant(first, "array<bigint>"), F.col("_range")).eqNullSafe(F.col(key))
    copies = rows.where(is_head).withColumn("_range", F.get(constant(before, "array<int>"), F.col("_range")))
    order = Window.partitionBy("_range").orderBy("_copy", F.col(key).asc_nulls_first(), F.xxhash64(text))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    return both.withColumn("next_text", F.lead(text).over(order)).where(~F.col("_copy")).drop("_range", "_copy")


def mixed_buckets(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Of the buckets (a, b) of several rows, those whose canonical texts differ. texts: a, b, canon.

    Least and greatest texts are taken where the rows are, so of a group of copies one text per task is moved.
    """
    ends = texts.join(shared, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return ends.where("lo <> hi").select("a", "b", F.lit(True).alias("mixed"))


def fingerprint_of(a: Column, b: Column, mixed: Column, digest: Column) -> Column:
    """Both halves of the key as hex, and in a mixed bucket the digest of the canonical text."""
    plain = F.concat(F.lower(F.lpad(F.hex(a), 16, "0")), F.lower(F.lpad(F.hex(b), 16, "0")))
    return F.when(mixed, F.concat(plain, F.lit("-"), digest)).otherwise(plain)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole documents, of their edited texts, and how like they are (op8's contract).

    Nulls count as empty texts; empty texts and texts of white space share a fingerprint; very long texts are digested
    whole. Repeated rows each give a row; ties of doc_id go by the hash of the text, null ids come first; an empty table
    gives none. Columns other than doc_id and text are ignored, whatever their names. An exact digest knows only equal
    and different, so near_edited and near_next are 0 or 1.
    """
    base = docs.select("doc_id", text_of().alias("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = with_next(base, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    canon = rows.select("doc_id", "n_chars", "edited_sha256", *[canonical(F.col(c)).alias(f"{c}_canon") for c in ("text", "edited", "next_text")])
    like = lambda c: (F.col("text_canon") == F.col(c)).cast("double")
    ready = canon.select("doc_id", "n_chars", "edited_sha256", *key_columns("text_canon", "t"), *key_columns("edited_canon", "e"), F.sha2("text_canon", 256).alias("t_sha"), "edited_canon", like("edited_canon").alias("near_edited"), like("next_text_canon").alias("near_next"))
    hashed = written(ready, "fingerprints")
    with Scratch(docs.sparkSession) as keep:
        keys = hashed.select(F.col("ta").alias("a"), F.col("tb").alias("b")).unionAll(hashed.select("ea", "eb"))
        shared = keep(keys.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "shared-buckets")
        own = base.select(canonical(F.col("text")).alias("canon")).select(*key_columns("canon"), "canon")
        mixed = written(mixed_buckets(own.unionByName(hashed.select(F.col("ea").alias("a"), F.col("eb").alias("b"), F.col("edited_canon").alias("canon"))), shared), "mixed-buckets")
    of = lambda c: mixed.select(F.col("a").alias(f"{c}a"), F.col("b").alias(f"{c}b"), F.col("mixed").alias(f"{c}_mixed"))
    out = hashed.join(of("t"), ["ta", "tb"], "left").join(of("e"), ["ea", "eb"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_of(F.col("ta"), F.col("tb"), F.col("t_mixed"), F.col("t_sha")).alias("fingerprint"),
        fingerprint_of(F.col("ea"), F.col("eb"), F.col("e_mixed"), F.sha2("edited_canon", 256)).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see edited_fingerprints for nulls and other odd rows."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
