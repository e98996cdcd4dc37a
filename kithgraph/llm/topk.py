"""Exact top-k search by inner product over a bit-sliced index.

Rows lie in blocks, sorted by id. A block keeps every component as slices: bitmap b of component d holds bit b of all
rows' values, above the least value of the block. A query's scores are the sum of weighted slices; each set bit of a
weight adds the component's slices, shifted, and full adders over whole bitmaps bring all addends of one weight down to one
bitmap. What stands for a negative weight are the complements of the slices. The top k then fall out of the score's
slices, the most significant first: rows are in, out, or still level; those still level after the last slice have equal
scores, and the smallest ids among them fill what is left.

Blocks and chunks of queries meet in pairs, one join row each: a chunk goes to every block by a shuffle, never as a whole
to the driver. What a pair finds is at most k rows a query, merged by windows of bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch
from kithgraph.llm.vectors import matrix, whole_vectors

K, SCALE, EVERY = 20, 64, 20
#: Rows of a block and queries of a chunk: what one pair holds in memory.
ROWS, QUERIES = 16_384, 512
#: Blocks whose findings are merged in one group.
MERGE = 256
INDEX = "block int, n int, nulls int, ids binary, low array<long>, bits array<int>, slices binary"
CHUNK = "chunk int, n int, wide int, ids binary, vectors binary"
FOUND = "chunk int, at int, block int, query_id long, vec_id long, score long"


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least value of each component, the bits its range takes, and the bitmaps, one row per component and bit."""
    low = values.min(0)
    above = values - low
    bits = np.array([int(x).bit_length() for x in above.max(0)], np.int32)
    words = -(-len(values) // 64)
    maps = np.zeros((int(bits.sum()), 8 * words), np.uint8)
    at = 0
    for d, n in enumerate(bits.tolist()):
        for b in range(n):
            packed = np.packbits((above[:, d] >> b & 1).astype(np.uint8), bitorder="little")
            maps[at, : len(packed)] = packed
            at += 1
    return low, bits, maps.view(np.uint64)


class Index:
    """One block: its ids in order and the slices of its components, with their complements below them."""

    def __init__(self, ids: np.ndarray, nulls: int, low: np.ndarray, bits: np.ndarray, maps: np.ndarray):
        self.ids, self.nulls, self.low = ids, nulls, low
        self.slices = np.concatenate([maps, ~maps])
        self.dim = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.concatenate([np.arange(n) for n in bits.tolist()] or [np.zeros(0)]).astype(np.int64)
        self.most = (np.int64(1) << bits.astype(np.int64)) - 1
        self.words = maps.shape[1]
        self.valid = np.packbits(np.arange(64 * self.words) < len(ids), bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of all rows' scores, the least significant first, and what is to be added to them."""
        size = np.abs(query)
        base = int((query * self.low).sum()) - int((size * self.most)[query < 0].sum())
        below = np.where(query[self.dim] < 0, len(self.dim), 0)
        addends: dict[int, list[np.ndarray]] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            rows = np.flatnonzero(size[self.dim] >> i & 1)
            weight = self.bit[rows] + i
            for w in np.unique(weight).tolist():
                addends.setdefault(w, []).append((rows + below[rows])[weight == w])
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        while len(out) <= max(addends, default=-1) or carries:
            rows = addends.get(len(out))
            m = np.concatenate([self.slices[np.concatenate(rows)] if rows else np.zeros((0, self.words), np.uint64), *carries])
            carries = []
            while len(m) > 1:
                t = len(m) // 3
                if not t:
                    carries.append((m[0] & m[1])[None])
                    m = (m[0] ^ m[1])[None]
                    break
                a, b, c = m[:t], m[t : 2 * t], m[2 * t : 3 * t]
                x = a ^ b
                carries.append((a & b) | (x & c))
                m = np.concatenate([x ^ c, m[3 * t :]])
            out.append(m[0] if len(m) else np.zeros(self.words, np.uint64))
        return out, base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the k best rows besides those of an id (ties: first come), and their scores."""
        slices, base = self.scores(query)
        level = self.valid.copy()
        a, b = self.nulls + np.searchsorted(self.ids[self.nulls :], [own, own + 1])
        for i in range(a, b):
            level[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        taken = np.zeros_like(level)
        for s in reversed(slices):
            both = taken | (level & s)
            n = int(np.bitwise_count(both).sum())
            if n >= k:
                level &= s
            else:
                taken, level = both, level & ~s
        places = positions(taken)
        places = np.concatenate([places, positions(level)[: k - len(places)]])
        score = np.full(len(places), base, np.int64)
        for w, s in enumerate(slices):
            score += (s[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
        return places, score


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def dealt(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows dealt evenly into partitions of some `size`, and how many; a partition becomes one block."""
    n = max(1, -(-rows.count() // size))
    return rows.repartition(n), n


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, int, np.ndarray]:
    """The ids of a partition in order (nulls first, as zeros), the number of nulls, and the vectors in that order."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return np.zeros(0, np.int64), 0, np.zeros((0, 0), np.int64)
    rows = pa.Table.from_batches(parts)
    known = rows["vec_id"].is_valid().to_numpy(zero_copy_only=False)
    ids = rows["vec_id"].fill_null(0).to_numpy().astype(np.int64)
    order = np.lexsort((ids, known))
    return ids[order], int((~known).sum()), matrix(rows["v"])[order]


def index(rows: DataFrame, scale: int = SCALE, size: int = ROWS) -> tuple[DataFrame, int]:
    """The bit-sliced index of vectors (vec_id, embedding), a row per block, and the number of blocks."""
    spread, n = dealt(whole_vectors(rows, scale), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, values = gathered(batches)
        if len(ids):
            low, bits, maps = sliced(values)
            out = [[TaskContext.get().partitionId()], [len(ids)], [nulls], [ids.tobytes()], [low.tolist()], [bits.tolist()], [maps.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["block", "n", "nulls", "ids", "low", "bits", "slices"])

    return spread.mapInArrow(run, INDEX), n


def chunks(queries: DataFrame, scale: int = SCALE, size: int = QUERIES) -> tuple[DataFrame, int]:
    """Queries (vec_id, embedding) in chunks, a row each, and the number of chunks."""
    spread, n = dealt(whole_vectors(queries, scale).where("vec_id is not null"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, values = gathered(batches)
        if len(ids):
            out = [[TaskContext.get().partitionId()], [len(ids)], [values.shape[1]], [ids.tobytes()], [values.astype(np.int32).tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["chunk", "n", "wide", "ids", "vectors"])

    return spread.mapInArrow(run, CHUNK), n


def searched(blocks: DataFrame, asked: DataFrame, n_blocks: int, n_chunks: int, k: int) -> DataFrame:
    """The best k rows of every block for every query (FOUND). Each pair of a block and a chunk is one row of a keyed join.

    Where there are fewer blocks than tasks, the chunks of a block are dealt to several groups.
    """
    tasks = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(n_chunks, tasks // n_blocks))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = blocks.select("*", upto(groups).alias("group"))
    copies = asked.select(upto(n_blocks).alias("block"), (F.col("chunk") % groups).alias("group"), "chunk", F.col("n").alias("m"), "wide", F.col("ids").alias("asked"), "vectors")
    # what the copies come to is not seen in the size of the queries, so they must not be broadcast; the side that is held for a key is its one block
    pairs = copies.repartition(max(n_blocks, tasks), "block", "group").hint("merge").join(held.hint("merge"), ["block", "group"])
    pairs = pairs.select("block", "n", "nulls", "ids", "low", "bits", "slices", "chunk", "m", "wide", "asked", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for row in range(len(batch)):
                b, n, nulls, ids, low, bits, slices, chunk, m, wide, asked_ids, vectors = (batch.column(i)[row].as_py() for i in range(12))
                if b != block:
                    bits = np.array(bits, np.int32)
                    maps = np.frombuffer(slices, np.uint64).reshape(int(bits.sum()), -(-n // 64))
                    held, block = Index(np.frombuffer(ids, np.int64), nulls, np.array(low, np.int64), bits, maps), b
                values = np.zeros((m, len(held.low)), np.int64)  # components that one side lacks count as zero
                common = min(wide, len(held.low))
                values[:, :common] = np.frombuffer(vectors, np.int32).reshape(m, wide)[:, :common]
                out = []
                for at, (query, own) in enumerate(zip(values, np.frombuffer(asked_ids, np.int64).tolist(), strict=True)):
                    places, scores = held.top(query, own, k)
                    out.append((at, own, held.ids[places], places < held.nulls, scores))
                count = [len(x[4]) for x in out]
                each = lambda i, t: pa.array(np.repeat([x[i] for x in out], count), t)
                whole = lambda i: np.concatenate([x[i] for x in out])
                made = [pa.array(np.full(sum(count), chunk), pa.int32()), each(0, pa.int32()), pa.array(np.full(sum(count), b), pa.int32()), each(1, pa.int64()), pa.array(whole(2), pa.int64(), mask=whole(3)), pa.array(whole(4), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["chunk", "at", "block", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Found rows with their rank in a group, up to k: by score, then the smaller id, nulls first."""
    w = Window.partitionBy(*groups).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = ROWS, chunk: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest integer inner product of floor(scale * x).

    rows and queries: vec_id, embedding. Vectors that are null or hold a null or non-finite component take no part, as row or
    as query; queries without an id give none. A query's own rows are those of its id, repeats included. Other repeated rows
    are ranked each for itself, and a repeated query is answered as often as it occurs. Ties go to the smaller vec_id, null
    first. Of vectors of different lengths the shorter one's missing components count as zero. Fewer rows than k give all;
    empty tables give none. Other columns are ignored. A component beyond 2^24 after scaling fails the job.
    """
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        indexed, n = index(rows, scale, block)
        asked, m = chunks(queries, scale, chunk)
        found = scratch(searched(scratch(indexed, "index"), scratch(asked, "queries"), n, m, k), "found")
        while n > MERGE:
            n = -(-n // MERGE)
            found = scratch(best(found.withColumn("block", F.floor(F.col("block") / MERGE).cast("int")), ["chunk", "at", "block"], k).drop("rank"), "merged")
        out = best(found, ["chunk", "at"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return Scratch(spark)(out, "top")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every embedding whose id is divisible by 20, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
