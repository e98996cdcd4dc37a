"""Importance resampling towards a target: documents whose n-grams are likelier in the target are likelier drawn.

Features are counted through a dictionary of distinct strings. Texts are parsed in blocks of documents; a block keeps its
own distinct strings once, with the counts of each document as (string, count) pairs. The blocks' strings are summed into the
dictionary of the corpus and the target, where each distinct string is hashed once; its buckets' sums give the gains. The
gains go back to the strings of each block by a join, in which a string occurs at most once a block however frequent it
is, and so to the documents' counts.

The draw is by Gumbel keys: the highest sums of weight and noise are a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch, text_of
from kithgraph.llm.decontaminate import LOWER, WORD, in_chunks

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Blocks that a task which writes or reads them holds at once.
TOGETHER = 4
BLOCK = (
    "block long, doc_id array<long>, n_words array<long>, n_features array<long>, first array<long>, code array<int>, n array<int>, "
    "word array<string>, total array<long>"
)
SCORED = "doc_id long, n_words long, n_features long, weight long"


def word_borders(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, the words' begins and ends, and the text of each word."""
    raw = [t.encode() for t in texts]
    whole = LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    turn = np.flatnonzero(np.diff(WORD[whole].view(np.int8), prepend=np.int8(0)))
    begin = turn[::2]
    text_end = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    return whole, begin, turn[1::2], np.searchsorted(text_end, begin, "right")


def grams(whole: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Every run of `size` consecutive words of one text, joined by one space, and its text."""
    length = end - begin
    if size == 1:
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(whole[WORD[whole]])), owner
    spaced = np.full(int((length + 1).sum()), 32, np.uint8)  # the words with one space after each
    at = np.concatenate([[0], np.cumsum(length + 1)])
    spaced[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = whole[WORD[whole]]
    runs = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, np.int64)
    span = at[runs + size] - 1 - at[runs]
    offsets = np.concatenate([[0], np.cumsum(span)]).astype(np.int64)
    data = spaced[np.repeat(at[runs] - offsets[:-1], span) + np.arange(int(span.sum()))] if len(runs) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(runs), pa.py_buffer(offsets), pa.py_buffer(data)), owner[runs]


def block_of(ids: list[int | None], texts: list[str], sizes: int) -> list:
    """One block's row after its number: documents, where their pairs begin, the pairs' codes and counts, the distinct strings and their totals."""
    whole, begin, end, owner = word_borders(texts)
    found = [grams(whole, begin, end, owner, s) for s in range(1, sizes + 1)]
    coded = pa.concat_arrays([x for x, _ in found]).dictionary_encode()
    text = np.concatenate([x for _, x in found])
    code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    pair, n = np.unique(text * max(1, distinct) + code, return_counts=True)
    code = pair % max(1, distinct)
    first = np.searchsorted(pair // max(1, distinct), np.arange(len(texts) + 1))
    total = np.bincount(code, n, distinct).astype(np.int64)
    count = lambda x: np.bincount(x, minlength=len(texts)).tolist()
    return [ids, count(owner), count(text), first.tolist(), code.astype(np.int32), n.astype(np.int32), coded.dictionary.cast(pa.string()), total]


def blocks(docs: DataFrame, sizes: int) -> DataFrame:
    """Documents in blocks (BLOCK), numbered by partition and place in it. Other partitions give other blocks: rows are to be written before they are read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.list_(pa.int32())] * 2, pa.list_(pa.string()), pa.list_(pa.int64())]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for part in in_chunks(texts, BLOCK_CHARS):
                row = [number, *block_of(ids[at : at + len(part)], part, sizes)]
                at, number = at + len(part), number + 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=BLOCK_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, BLOCK)


BLOCK_NAMES = ["block", "doc_id", "n_words", "n_features", "first", "code", "n", "word", "total"]


def string_totals(parsed: DataFrame, to: str) -> DataFrame:
    """(word, to): how often each distinct string occurs."""
    rows = parsed.select(F.explode(F.arrays_zip("word", "total")).alias("x")).select("x.word", "x.total")
    return rows.groupBy("word").agg(F.sum("total").alias(to))


def dictionary(parsed: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(word, bucket, s, t): the distinct strings of the corpus and the target, each hashed once, with their counts in both."""
    both = string_totals(parsed, "s").join(string_totals(target, "t"), "word", "full")
    return both.select("word", (F.crc32(F.col("word").cast("binary")) % buckets).cast("int").alias("bucket"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))


def gains(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that hold strings: at most `buckets` rows.

    floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) in doubles.
    """
    held = words.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    all_s, all_t = (float(x or 0) for x in words.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1.0) * F.lit(all_s + buckets)) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(parsed: DataFrame, words: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains joined back to the strings of each block and summed by document."""
    known = words.where("s > 0").join(F.broadcast(by_bucket), "bucket").select("word", "gain")  # at most one row a bucket is broadcast
    own = parsed.select("block", F.posexplode("word").alias("place", "word")).join(known, "word")
    both = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("gain") + (1 << 31))  # place and gain as one number: a quarter of a struct's bytes
    told = own.select(F.col("block").alias("of"), both.alias("told"))

    def run(told: pa.Table, block: pa.Table) -> pa.Table:
        both = told["told"].to_numpy()
        out = []
        for row in block.to_batches(max_chunksize=1):
            ids, n_words, n_features, first, code, n = (row.column(c)[0].values for c in BLOCK_NAMES[1:7])
            gain = np.zeros(len(both), np.int64)
            gain[both >> 32] = (both & 0xFFFFFFFF) - (1 << 31)
            first = first.to_numpy()
            upto = np.concatenate([[0], np.cumsum(gain[code.to_numpy()] * n.to_numpy())]) if len(gain) else np.zeros(1, np.int64)
            out.append(pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(upto[first[1:]] - upto[first[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]))
        return pa.Table.from_batches(out)

    # a block and its gains are in memory one at a time, the rest of a task's is sorted and may spill
    return told.groupBy("of").cogroup(parsed.select(*BLOCK_NAMES[:7]).groupBy("block")).applyInArrow(run, SCORED)


def noise(seed: int) -> Column:
    """1000 times a Gumbel variate from the first 32 bits of sha256(`seed:doc_id`), floored; a null id is the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_ranks(scratch: Scratch, rows: DataFrame, percent: int, least: int) -> DataFrame:
    """Adds `rank` to the floor(percent * N / 100) highest scores of the N rows of at least `least` words; others have null.

    Rows are dealt by ranges of (score, doc_id) and written; a row's rank is its place in its range after all rows of the
    ranges before, of which only one number each is broadcast.
    """
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    fit = scratch(rows.where(F.col("n_words") >= least).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in fit.groupBy("range").agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for part, n in sizes:
        before.append((part, total))
        total += n
    base = rows.sparkSession.createDataFrame(before, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = fit.join(F.broadcast(base), "range").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * total // 100, F.col("rank")))
    others = rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*others.columns).unionByName(others)


def resampled(docs: DataFrame, target: DataFrame, sizes: int = N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents (doc_id, text), drawn towards target (text).

    Features are runs of 1 to `sizes` words. Null and empty texts have no words and weight 0. Repeated rows count each and
    are ranked each; equal scores go to the smaller doc_id, null first. Very long texts are parsed whole, as a block of their
    own. Empty tables give no rows; an empty target gives every string the same prior. Other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        parsed = scratch(blocks(docs, sizes), "blocks", TOGETHER)
        goal = scratch(blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), sizes), "target", TOGETHER)
        words = scratch(dictionary(parsed, goal, buckets), "dictionary")
        scored = scratch(weights(parsed, words, gains(words, buckets)).withColumn("score", F.col("weight") + noise(seed)), "scores")
        return Scratch(spark)(with_ranks(scratch, scored, percent, least), "resampled")


def drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The documents that are drawn, with all their columns; documents of one id go together."""
    chosen = resampled(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["_drawn_id"]), "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark."""
    found = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = rf"""
WITH bits AS (
  SELECT i, list_reduce(list_concat([i], list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)
), crc AS (SELECT list(c ORDER BY i) AS c FROM bits),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
n AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, count(*) AS s, 0 AS t FROM dw GROUP BY word UNION ALL SELECT word, 0, count(*) FROM bw GROUP BY word) GROUP BY word),
h AS (
  SELECT word, n.s, n.t, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, crc.c[(xor(c, x) & 255) + 1]))) % {BUCKETS} AS bucket FROM n, crc
), k AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(((sum(h.t) + 1)::DOUBLE * (any_value(k.s) + {BUCKETS})::DOUBLE) / ((sum(h.s) + 1)::DOUBLE * (any_value(k.t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM h, k GROUP BY bucket
), x AS (SELECT r, sum(gain) AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (r)
), f AS (SELECT *, n_features >= {LEAST_WORDS} AS fit, count(*) FILTER (WHERE n_features >= {LEAST_WORDS}) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * total // 100 THEN place END AS rank FROM o
"""
