"""Packing token ids into sequences of bounded length by multiway differencing.

Documents are cut into pieces: whole sequences first, then short pieces of what is left. The short pieces are dealt
into groups of bounded size, and each group is partitioned into near-equal windows by Karmarkar-Karp differencing:
the two partial partitions with the largest imbalance are merged, the fullest windows of one with the emptiest of the
other. If a window comes out above the capacity, the group is partitioned again into one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import bpe
from kithgraph.llm.common import by_rows, text_of, written

CAPACITY = 2048
#: Short pieces have at most this many tokens, so that windows of many pieces come out even.
PIECE = 256
#: Pieces in a group that is partitioned at once, on average.
GROUP = 768
END_ID = 1
#: Characters that are split at once: half of the encoder's own, as packing shares its workers with other stages.
CHUNK_CHARS = 300_000
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """The pieces of a document of n tokens as (start, length): full sequences, then pieces of at most `piece`."""
    full = n // capacity * capacity
    return [(a, capacity) for a in range(0, full, capacity)] + [(a, min(piece, n - a)) for a in range(full, n, piece)]


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Partitions item numbers into `ways` lists of near-equal size by Karmarkar-Karp differencing.

    A partial partition holds its non-empty lists by ascending size; all others count as empty. Of two, the fullest lists
    of one meet the emptiest of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = len(a) + len(b) - ways  # lists that can't stay apart
        if shared > 0:
            met = [(x + y, one + two) for (x, one), (y, two) in zip(a[:shared], reversed(b[:shared]), strict=True)]
            both = [*met, *a[shared:], *b[shared:]]
        else:
            both = a + b
        both.sort(key=itemgetter(0))
        heapq.heappush(heap, (-(both[-1][0] - (both[0][0] if len(both) == ways else 0)), count, both))
        count += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers by window: the fewest windows, from the least possible count up, that differencing keeps within capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        ways += 1


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids with their checksums.

    Null texts count as empty: only the end id. Very long texts are encoded whole. Repeated rows and null doc_ids are
    documents of their own; an empty table has no pieces. Columns but doc_id and text are ignored, whatever their names.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder(vocabulary)
        for rows in batches:
            out = []
            for doc, ids in zip(rows.doc_id.tolist(), encoder.encode(rows.text.tolist(), CHUNK_CHARS), strict=True):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                n = len(raw) // 4
                out += [(doc, a, m, zlib.crc32(raw[4 * a : 4 * (a + m)]), n) for a, m in cuts(n)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.forget()  # the worker stays for later stages, its cache need not

    return by_rows(docs.select(F.col("doc_id").cast("string"), text_of().alias("text")), cut, PIECES)


def packed(piece_rows: DataFrame) -> DataFrame:
    """Gives every piece a sequence and its offset there. Sequence ids are unique, not gapless.

    Equal lengths go in the order of their pieces; an empty table gives no rows. Full pieces are sequences by themselves.
    The others are numbered and dealt by the hash of the number, so neither
    equal documents nor null keys meet in one group.
    """
    rows = written(piece_rows.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == CAPACITY).withColumn("sequence_id", F.col("_n") * 2).withColumn("offset", F.lit(0).cast("long"))
    short = rows.where(F.col("length") < CAPACITY)
    groups = max(1, -(-short.count() // GROUP))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n", ignore_index=True)
        sizes, base = group["length"].tolist(), int(group["_group"].iloc[0]) << 21
        at, offset = [0] * len(sizes), [0] * len(sizes)
        for k, window in enumerate(windows(sizes)):
            filled = 0
            for i in window:
                at[i], offset[i] = 2 * (base + k) + 1, filled
                filled += sizes[i]
        return group.drop(columns="_group").assign(sequence_id=at, offset=offset)

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_n"), F.lit(groups)))
    filled = dealt.groupBy("_group").applyInPandas(fill, f"{PIECES}, _n long, sequence_id long, offset long")
    return full.unionByName(filled).drop("_n").withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; see pieces and packed for nulls and other odd rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
