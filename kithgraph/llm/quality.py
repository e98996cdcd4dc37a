"""A quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are hashed words and word shapes (case, closing signs, length, repetition), weighted by their inverse
document frequencies over all documents. A truncated singular value decomposition of at most `most` labelled documents,
drawn by the hash of their id, gives the latent space. Every document is then compared with all labelled vectors, in
blocks of exact cosine products, and its K nearest vote with a power of their similarity. The labelled vectors are the
only thing broadcast: most x RANK floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import by_rows, packed_rows, text_of, unpacked_rows, with_columns_from, written

#: Bound of the labelled sample: its documents, and so the broadcast, never exceed it.
MOST = 8_192
#: Of the space: hashed features, latent dimensions; of the vote: neighbours and the power of their similarity.
FEATURES, RANK, K, POWER = 2_048, 64, 24, 8
THRESHOLD = 0.3
BLOCK, CHUNK_CHARS = 256, 250_000
SHAPES = 512
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str]) -> np.ndarray:
    """Counts of hashed features by text: the words, then the shapes of tokens, whose repetition of the last is a shape too."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= CHUNK_CHARS and end - at < BLOCK:
            n += len(texts[end])
            end += 1
        out[at:end] = counts(texts[at:end])
        at = end
    return out


def counts(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer((" ".join(t.replace("\0", " ") for t in texts) + " ").encode("utf-32-le"), np.uint32)
    edge = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    letter = np.zeros(len(codes), bool)
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    low = np.where(upper, codes + 32, codes)
    letter = (low >= 97) & (low <= 122) | (codes >= 0xC0)
    digit = (codes >= 48) & (codes <= 57)
    space = codes <= 32
    turn = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, stop = turn[::2], turn[1::2]
    if not len(begin):
        return np.zeros((len(texts), FEATURES), np.float32)
    row = np.searchsorted(edge, begin, "right") - 1
    size = stop - begin
    total = lambda x: np.add.reduceat(x, begin)  # noqa: E731  over a token and the blanks after it
    n_letter, n_upper, n_digit = total(letter.astype(np.int32)), total((upper & letter).astype(np.int32)), total(digit.astype(np.int32))
    value = np.where(letter | digit, (low.astype(np.uint64) + np.uint64(7)) * MULTIPLIER, np.uint64(0))
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(codes)]])))
    word = total((value ^ (value >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    word ^= word >> np.uint64(31)
    case = np.where(n_upper == 0, 0, np.where(n_upper == n_letter, 1, np.where(upper[begin], 2, 3)))
    kind = np.minimum(n_digit, 1) * 2 + np.minimum(size - n_letter - n_digit, 3) * 4 + (n_letter == 0)
    last, before = codes[stop - 1], codes[np.maximum(stop - 2, begin)]
    sign = lambda c, a: np.where((c < 128) & ~((c >= 48) & (c <= 57)) & ~((c | 32) >= 97) & (c > 32) | (c == 124), c, 0)  # noqa: E731,ARG005
    again = np.zeros(len(begin), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    shape = case + 4 * kind.astype(np.int64) + 128 * np.minimum(size, 15) // 4 + 1024 * again
    shape = (shape.astype(np.uint64) * np.uint64(131) + sign(last, begin).astype(np.uint64) * np.uint64(257) + sign(before, begin).astype(np.uint64)) * MULTIPLIER >> np.uint64(20)
    column = np.concatenate([(word % np.uint64(FEATURES - SHAPES)).astype(np.int64), FEATURES - SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64)])
    return np.bincount(np.concatenate([row, row]) * FEATURES + column, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents and, by feature, the documents that have it, over the whole table. One short row per task comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, having = 0, np.zeros(FEATURES, np.int64)
        for rows in batches:
            for i in range(0, len(rows), BLOCK):
                part = features(rows["text"].iloc[i : i + BLOCK].tolist())
                n, having = n + len(part), having + (part > 0).sum(0)
        yield pd.DataFrame({"n": [n], "having": [having.tolist()]})

    found = by_rows(docs.select("text"), count, "n long, having array<long>").select("n", F.posexplode("having").alias("i", "d"))
    rows = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()  # FEATURES rows
    having = np.zeros(FEATURES)
    for r in rows:
        having[r["i"]] = r["d"]
    return (rows[0]["n"] if rows else 0), having


class Model:
    """What scoring needs: weights, the latent space, the labelled vectors and their labels."""

    def __init__(self, counted: np.ndarray, labels: np.ndarray, n_docs: int, having: np.ndarray):
        """counted is used up: its memory holds the weighted features."""
        self.idf = np.log((1 + n_docs) / (1 + having)).astype(np.float32) + np.float32(0.1)
        x = counted
        for i in range(0, len(x), BLOCK):
            x[i : i + BLOCK] = self.weighted(x[i : i + BLOCK])
        rank = min(RANK, *x.shape)
        rng = np.random.default_rng(3)
        q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.space = np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)
        self.vectors, self.labels = self.unit(x @ self.space), labels.astype(np.float32)
        self.base = float(labels.mean())

    def weighted(self, counted: np.ndarray) -> np.ndarray:
        return self.unit(np.log1p(counted) * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def latent(self, counted: np.ndarray) -> np.ndarray:
        return self.unit(self.weighted(counted) @ self.space)

    def scores(self, counted: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, by similarity; texts without features get the share of all labels."""
        near = self.latent(counted) @ self.vectors.T
        k = min(K, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER + 1e-12
        voted = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.where(counted.sum(1) > 0, voted, self.base)


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 5; rows without doc_id count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0).cast("long"))


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model | None:
    """The model of at most `most` labelled documents that are not held out; None without any."""
    usable = labels.where("doc_id is not null and quality is not null").where(remainder() != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers

    def sparse(texts: list[str]) -> list[list]:
        return list(map(list, zip(*[(np.flatnonzero(c).tolist(), c[c > 0].tolist()) for i in range(0, len(texts), BLOCK) for c in features(texts[i : i + BLOCK])], strict=True)))

    counted = with_columns_from(rows, "text", lambda: sparse, "_at array<int>, _count array<float>").drop("text")
    having = document_frequencies(docs.select(text_of().alias("text")))
    found = written(counted, "labelled").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(most).select("_quality", "_at", "_count").toArrow()
    if not found.num_rows:
        return None
    table = np.zeros((found.num_rows, FEATURES), np.float32)
    lens = pc.list_value_length(found["_at"]).to_numpy()
    values = [pc.list_flatten(found[c]).to_numpy() for c in ("_at", "_count")]
    table[np.repeat(np.arange(len(lens)), lens), values[0]] = values[1]
    labels_ = found["_quality"].to_numpy()
    del found, values
    return Model(table, labels_, *having)


def with_score(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `_score` to documents with a text column that has no nulls. Without labels every score is 0.5."""
    model = fitted(docs, labels, most)
    if model is None:
        return docs.withColumn("_score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score():
        return lambda texts: [np.concatenate([shared.value.scores(features(texts[i : i + BLOCK])) for i in range(0, len(texts), BLOCK)]).round(6)]

    return with_columns_from(docs, "text", score, "_score double")


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """Per document its held_out flag, score and prediction (op3's contract).

    Null and empty texts get the share of label 1 among the sample; very long texts are counted whole. Repeated rows each
    give a row, a null doc_id counts as held out, labels without id or quality teach nothing, and of several labels of a
    document the larger counts. Ties among neighbours go by numpy's partition. An empty table gives no rows; without
    labels every score is 0.5. Columns but doc_id and text are ignored, whatever their names.
    """
    rows = with_score(docs.select("doc_id", text_of().alias("text")), labels, most)
    return rows.select("doc_id", (remainder() == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """The documents that the classifier does not reject; same columns, whatever their names. Odd rows as in scored."""
    rows = with_score(packed_rows(docs), labels, most)
    return unpacked_rows(rows.where(F.col("_score") >= THRESHOLD), docs)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see scored for nulls and other odd rows."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
