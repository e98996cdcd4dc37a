"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks whose borders depend on content alone. A chunk is
addressed by its digest and stored once, in the row of the first document that has it; the row of every document holds
its recipe, the digests of its chunks in order. Rows lie in ascending doc_id order, file after file. A manifest has per
file the number of ids and the root of a Merkle tree over its documents, and the root over all files. Reading follows
the recipes, fetches chunks that other rows own, and verifies counts, checksums and roots.

The format is Parquet: store/part=N (doc_id, row, n_tokens, crc, digests, own, ids) and manifest (part, rows, tokens,
root). ids are the owned chunks' ids, little-endian, of `width` bytes; a vocabulary that needs more is refused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm import bpe
from kithgraph.llm.common import Scratch, by_rows, new_path, text_of, written

END_ID = 2
#: Of chunks: ids in the rolling window, mean ids between borders beyond the least, least and most ids.
ROLL, MEAN, LEAST, MOST = 16, 384, 128, 2_048
ENCODED = "doc_id string, n_tokens long, crc long, digests array<binary>, sizes array<int>, ids binary"
STORED = "doc_id string, row long, part int, n_tokens long, crc long, leaf binary, digests array<binary>, sizes array<int>, own array<int>, shared array<int>, ids binary"
PLACED = ["doc_id", "row", "n_tokens", "crc", "digests", "sizes", "ids", "foreign", "shared"]
MULTIPLIER = 0x9E3779B97F4A7C15


def borders(ids: np.ndarray) -> list[int]:
    """Where chunks end. A border follows an id whose window of ROLL ids hashes to a multiple of MEAN, LEAST to MOST ids after the last."""
    n = len(ids)
    out, last = [], 0
    if n > LEAST:
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        size, width = 1, n
        while size < ROLL:
            width -= size
            h = h[:width] * np.uint64(pow(MULTIPLIER, size, 2**64)) + h[size : size + width]
            size *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        for end in (np.flatnonzero((h >> np.uint64(20)) % np.uint64(MEAN) == 0) + ROLL).tolist():
            while end - last > MOST:
                last += MOST
                out.append(last)
            if end - last >= LEAST:
                out.append(end)
                last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out if out[-1:] == [n] else [*out, n]


def encoded(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> DataFrame:
    """The ids of each document with the end id, and its chunks. Null texts are empty."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = bpe.encoder(vocabulary).encode
        for rows in batches:
            out = []
            for doc, ids in zip(rows["doc_id"].tolist(), of(rows["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                raw, ends = ids.astype(f"<u{width}").tobytes(), borders(ids)
                digests = [address(raw[width * a : width * b]) for a, b in zip([0, *ends], ends, strict=False)]
                out.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), digests, np.diff([0, *ends]).tolist(), raw))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "crc", "digests", "sizes", "ids"])

    return by_rows(docs.select(F.col("doc_id").cast("string"), text_of().alias("text")), encode, ENCODED)


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves: pairs are hashed level by level, an odd last one goes up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def leaf(doc: str | None, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + (doc or "").encode() + b"\0" + b"".join(digests)).digest()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, width: int = 2) -> str:
    """Writes the store of all documents' ids and returns its root.

    Repeated rows are documents of their own and share their chunks; null doc_ids come first, ties go by row. Null and
    empty texts have the end id only; very long texts are chunked whole. An empty table gives a store without documents.
    Columns but doc_id and text are ignored, whatever their names. Only digests are grouped to find owners; a document's
    ids are moved once, to their place in the order. Owners are a written table, so that Spark can split a chunk that very
    many documents share.
    """
    if max(end_id, bpe.encoder(vocabulary).library.get_vocab_size() - 1) >= 256**width:
        raise ValueError(f"ids of this vocabulary need more than {width} bytes")
    with Scratch(docs.sparkSession) as keep:
        staged = keep(encoded(docs, vocabulary, end_id, width).withColumn("row", F.monotonically_increasing_id()), "encoded")
        uses = staged.select("row", F.posexplode("digests").alias("i", "digest"))
        range_of = keep(uses.groupBy("digest").agg(F.min("row").alias("owner"), F.max("row").alias("last")).where("owner <> last").drop("last"), "owners")
        met = uses.join(range_of, "digest")
        pick = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("i"))))
        notes = met.groupBy("row").agg(pick(F.col("row") != F.col("owner")).alias("foreign"), pick(F.col("row") == F.col("owner")).alias("shared"))
        notes = notes.join(staged.select("row", "doc_id"), "row").select(F.col("doc_id").cast("long").alias("key"), "row", "foreign", "shared")
        full = staged.withColumn("key", F.col("doc_id").cast("long"))
        both = full.withColumn("foreign", F.lit(None).cast("array<int>")).withColumn("shared", F.lit(None).cast("array<int>")).unionByName(notes, allowMissingColumns=True)
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, noted = TaskContext.get().partitionId(), (None, (), ())
            for rows in batches:
                out = []
                for doc, row, n, crc, digests, sizes, ids, foreign, shared in zip(*[rows[c].tolist() for c in PLACED], strict=True):
                    if foreign is not None:  # a note comes before its document
                        noted = (row, set(foreign), set(shared))
                        continue
                    away, asked = noted[1:] if noted[0] == row else ((), ())
                    ends = np.cumsum(sizes).tolist()
                    own, seen, held = [], set(), []
                    for i, (digest, end, size) in enumerate(zip(digests, ends, sizes, strict=True)):
                        if i not in away and digest not in seen:
                            own.append(i)
                            held.append(ids[width * (end - size) : width * end])
                            seen.add(digest)
                    out.append((doc, row, part, int(n), int(crc), leaf(doc, digests), list(digests), list(sizes), own, [i for i in own if i in asked], b"".join(held)))
                yield pd.DataFrame(out, columns=["doc_id", "row", "part", "n_tokens", "crc", "leaf", "digests", "sizes", "own", "shared", "ids"])

        ordered = both.repartitionByRange(parts, F.col("key").asc_nulls_first(), "row").sortWithinPartitions(F.col("key").asc_nulls_first(), "row", F.col("foreign").isNull())
        stored = by_rows(ordered.select(*PLACED), place, STORED)
        stored.write.option("compression", "zstd").parquet(f"{path}/store")
    lines = summary(docs.sparkSession.read.schema(T._parse_datatype_string(STORED)).parquet(f"{path}/store"))
    docs.sparkSession.createDataFrame(lines, "part int, rows long, tokens long, root string").coalesce(1).write.parquet(f"{path}/manifest")
    return merkle([bytes.fromhex(r[3]) for r in lines]).hex()


def summary(stored: DataFrame) -> list[tuple[int, int, int, str]]:
    """A line per file part: rows, ids and Merkle root. Leaves are folded in the tasks; a part is one file."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for rows in batches:
            for part, n, x in zip(rows["part"].tolist(), rows["n_tokens"].tolist(), rows["leaf"].tolist(), strict=True):
                line = found.setdefault(part, [0, []])
                line[0] += n
                line[1].append(x)
        yield pd.DataFrame([(p, len(xs), n, merkle(xs).hex()) for p, (n, xs) in found.items()], columns=["part", "rows", "tokens", "root"])

    ordered = stored.select("part", "row", F.col("doc_id").cast("long").alias("key"), "n_tokens", "leaf").repartition("part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "row")
    return sorted(tuple(r) for r in by_rows(ordered.select("part", "n_tokens", "leaf"), fold, "part int, rows long, tokens long, root string").collect())


def read(spark: SparkSession, path: str, width: int = 2, root: str | None = None) -> DataFrame:
    """The documents of a store: (doc_id, row, part, n_tokens, crc, ids), ids little-endian unsigned of 4 bytes.

    Documents that own all their chunks are decoded where they are read. The others' chunks are fetched by digest: only
    chunks that some other row names are moved. With a root, the manifest and all recipes are verified against it.
    """
    stored = spark.read.schema(T._parse_datatype_string(STORED)).parquet(f"{path}/store")
    if root is not None:
        lines = sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest").collect())
        if merkle([bytes.fromhex(r[3]) for r in lines]).hex() != root or summary(stored) != lines:
            raise ValueError("the store does not match its manifest")
    complete = F.size("own") == F.size("digests")
    wanted = stored.where(~complete).select("row", F.posexplode("digests").alias("i", "digest"), "own").where(~F.array_contains("own", F.col("i")))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for digests, sizes, own, shared, ids in zip(*[rows[c].tolist() for c in ("digests", "sizes", "own", "shared", "ids")], strict=True):
                held = owned(sizes, own, ids, width)
                out += [(digests[i], held[i]) for i in shared]
            yield pd.DataFrame(out, columns=["digest", "bytes"])

    chunks = by_rows(stored.where(F.size("shared") > 0).select("digests", "sizes", "own", "shared", "ids"), named, "digest binary, bytes binary")
    asked = written(wanted.select("row", "digest").distinct(), "asked-chunks")
    fetched = asked.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    whole = stored.where(complete).withColumn("fetched", F.lit(None).cast("array<struct<digest:binary,bytes:binary>>"))
    pieced = stored.where(~complete).join(fetched, "row", "left").select(*whole.columns)
    columns = ["doc_id", "row", "part", "n_tokens", "crc", "digests", "sizes", "own", "ids", "fetched"]

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, row, part, n, crc, digests, sizes, own, ids, more in zip(*[rows[c].tolist() for c in columns], strict=True):
                held = owned(sizes, own, ids, width)
                known = {x["digest"]: x["bytes"] for x in more} if more is not None else {}
                known |= {digests[i]: x for i, x in held.items()}
                raw = b"".join([known[d] for d in digests])
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                if len(wide) != 4 * n or zlib.crc32(wide) != crc or any(address(known[d]) != d for d in digests):
                    raise ValueError(f"document {doc}: the store gives other ids than were written")
                out.append((doc, row, part, n, crc, wide))
            yield pd.DataFrame(out, columns=["doc_id", "row", "part", "n_tokens", "crc", "ids"])

    return by_rows(whole.unionByName(pieced).select(*columns), assemble, "doc_id string, row long, part int, n_tokens long, crc long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def owned(sizes: list[int], own: list[int], ids: bytes, width: int) -> dict[int, bytes]:
    """The chunks that a row owns, by their number."""
    out, at = {}, 0
    for i in own:
        out[i] = ids[at : at + width * sizes[i]]
        at += width * sizes[i]
    return out


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before by (doc_id, row), to rows with part.

    Within a part by a window, whose partitions are the files; between parts by their totals, one number per file.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).join(F.broadcast(base.select("part", "_base")), "part").withColumn("start", F.col("_base") + F.col("_before"))


def op4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the store of all documents, reads it back, and tells what the read ids are."""
    import public_tokenizers

    path = new_path(spark, "store")
    root = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    told = read(spark, path, root=root).select("doc_id", "row", "part", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return with_starts(written(told, "read-back")).select("doc_id", "start", "n_tokens", "ids_crc32")
