"""Repeated passages: every byte that lies in a string of 400 bytes which also starts anywhere else in the corpus.

Texts are parsed at content-defined points: the anchor of a 400-byte window is the gram of its least rolling hash, so
equal windows have equal anchors at equal places, whatever surrounds them. Windows with one anchor and nearby starts
form a phrase. A phrase has two keys: the core, the bytes that all its windows share, and the whole, the bytes that any
of them has. Cores that occur once hold no repeat; wholes that occur twice are repeats from end to end. Only phrases
between the two are cut finer, from BLOCKS[0] windows down to one, where core and whole are the window itself, so the
answer is exact. Counting moves a few numbers per phrase; texts move only to the phrases' positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch, by_rows, text_of, with_columns_from, written

WINDOW, GRAM = 400, 64
#: Starts of windows that a phrase spans at most, by round.
BLOCKS = (128, 16, 1)
CHUNK_BYTES = 1_000_000
FURTHEST = WINDOW - GRAM
SEEDS = np.random.default_rng(5).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = np.random.default_rng(6).integers(0, 2**64, 256, np.uint64)
RECORD = "core long, whole long, k long, t int, base long, at long, n int, x int"


def mixed(i: int, a: np.ndarray, b: np.ndarray, c: int | np.ndarray = 0) -> np.ndarray:
    """One hash of two, in order; i picks the constants."""
    h = a * SEEDS[2 * i]
    h ^= h >> np.uint64(29)
    h += b * SEEDS[2 * i + 1]
    h ^= np.asarray(c, np.uint64) * SEEDS[40]
    h *= SEEDS[41]
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of all strings of 64, 256 and 400 bytes of a buffer, by where they start."""

    def __init__(self, raw: np.ndarray):
        h, sizes, size = BYTES[raw], {}, 1
        while size < 256:
            h = mixed(size.bit_length(), h[: max(0, len(h) - size)], h[size:])
            size *= 2
            if size in (16, 64, 128, 256):
                sizes[size] = h
        self.h64, self.h256 = sizes[64], h
        n = max(0, len(raw) - WINDOW + 1)
        self.h400 = mixed(10, mixed(11, h[:n], sizes[128][256 : 256 + n]), sizes[16][384 : 384 + n])


def anchors(h64: np.ndarray, n: int) -> np.ndarray:
    """The place of the leftmost least gram of each of the first n windows."""
    low = (h64 & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h64), dtype=np.uint64)
    size = 1
    while size * 2 <= FURTHEST + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = FURTHEST + 1 - size
    low = np.minimum(low[:n], low[rest : rest + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(raw: np.ndarray, place: np.ndarray, start: np.ndarray, block: int, hashes: Hashes | None = None) -> tuple[np.ndarray, ...]:
    """Phrases of given windows: core, whole, index of the first window's start, number of windows, distance to the anchor.

    start: starts of windows in raw, ascending; place: their anchors. Consecutive starts with one anchor and one block of
    distances are a phrase.
    """
    hashes = hashes or Hashes(raw)
    far = place - start
    part = far // block
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(place) != 0) | (np.diff(part) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, k = place[first], part[first]
    least, most = k * block, np.minimum(k * block + block - 1, FURTHEST)
    if block == 1:
        core = whole = hashes.h400[start[first]]
    else:
        core = mixed(12, hashes.h256[a - least], hashes.h256[a - most + WINDOW - 256], k.astype(np.uint64))
        whole = mixed(13, hashes.h400[start[first]], hashes.h400[start[last]], (last - first).astype(np.uint64))
    return core.view(np.int64), whole.view(np.int64), start[first], last - first + 1, far[first]


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in groups of bounded size as (index, offset, bytes); long texts in parts that share WINDOW - 1 bytes."""
    held, n = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), CHUNK_BYTES):
            part = t[at : at + CHUNK_BYTES + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if held and n + len(part) > CHUNK_BYTES:
                yield held
                held, n = [], 0
            held.append((i, at, part))
            n += len(part)
    if held:
        yield held


def all_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The phrases of whole texts, of BLOCKS[0] windows at most."""
    for rows in batches:
        keys, salts = rows["k"].to_numpy(), rows["t"].to_numpy()
        for group in segments([t.encode() for t in rows["text"]]):
            raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
            sizes = np.array([len(p) for _, _, p in group])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            hashes = Hashes(raw)
            within = np.ones(len(raw) - WINDOW + 1, bool)
            for end in edge[1:-1].tolist():
                within[max(0, end - WINDOW + 1) : end] = False
            start = np.flatnonzero(within)
            core, whole, at, n, x = phrases(raw, anchors(hashes.h64, len(within))[start], start, BLOCKS[0], hashes)
            which = np.searchsorted(edge, at, "right") - 1
            text = np.array([i for i, _, _ in group])[which]
            offset = np.array([o for _, o, _ in group])[which]
            yield pd.DataFrame({"core": core, "whole": whole, "k": keys[text], "t": salts[text], "base": 0, "at": at - edge[which] + offset, "n": n.astype(np.int32), "x": x.astype(np.int32)})


def finer(block: int):
    """From contexts (k, t, at, n, x, bytes of the phrase's windows) to phrases of at most `block` windows."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in range(0, len(rows), 2_000):
                part = rows.iloc[i : i + 2_000]
                raw = np.frombuffer(b"".join(part["bytes"]), np.uint8)
                n, size = part["n"].to_numpy(np.int64), part["n"].to_numpy(np.int64) + WINDOW - 1
                base = np.cumsum(size) - size
                which = np.repeat(np.arange(len(part)), n)
                within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = base[which] + within
                place = (base + part["x"].to_numpy(np.int64))[which]
                core, whole, at, m, x = phrases(raw, place, start, block)
                own = np.searchsorted(base, at, "right") - 1
                out.append(pd.DataFrame({"core": core, "whole": whole, "k": part["k"].to_numpy()[own], "t": part["t"].to_numpy()[own], "base": part["at"].to_numpy()[own], "at": part["at"].to_numpy()[own] + at - base[own], "n": m.astype(np.int32), "x": x.astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["core", "whole", "k", "t", "base", "at", "n", "x"])

    return cut


def judged(records: DataFrame, keep: Scratch) -> DataFrame:
    """Records of cores that occur more than once, with `repeated` (the whole does) and `open` (its windows must be looked at).

    records: a written table. Of equal wholes beside others of the same core, one stays open, so that the others find it.
    """
    shared = keep(records.groupBy("core").agg(F.count("*").alias("_c"), F.min("whole").alias("_lo"), F.max("whole").alias("_hi")).where("_c > 1"), "cores")
    kept = keep(records.join(shared, "core").withColumn("_id", F.xxhash64("k", "t", "at")), "phrases")
    wholes = keep(kept.groupBy("core", "whole").agg(F.count("*").alias("_w"), F.min("_id").alias("_one")).where("_w > 1").drop("_w"), "wholes")
    both = kept.join(wholes, ["core", "whole"], "left")  # both sides are plain tables, so a whole of very many copies is split
    repeated, mixed_core = F.col("_one").isNotNull(), F.col("_lo") != F.col("_hi")
    return both.select("k", "t", "base", "at", "n", "x", repeated.alias("repeated"), (mixed_core & (~repeated | (F.col("_id") == F.col("_one")))).alias("open"))


def contexts(opened: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The bytes of open phrases, as (k, t, at, n, x, bytes).

    texts: k, t, base (where the bytes start in their text) and raw. An open phrase names the base of the bytes that it
    was cut from. The phrases of one text are as many as its length allows.
    """
    spots = opened.dropDuplicates(["k", "t", "at"]).groupBy("k", "t", "base").agg(F.collect_list(F.struct("at", "n", "x")).alias("spots"))
    cut = F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["x"].alias("x"), F.substring(F.col("raw"), (s["at"] - F.col("base") + 1).cast("int"), s["n"] + (WINDOW - 1)).alias("bytes")))
    return written(texts.join(spots, ["k", "t", "base"]).select("k", "t", F.explode(cut).alias("s")).select("k", "t", "s.*"), name)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k, t, start, end) of repeated runs of windows; runs may overlap. docs: k, t, text.

    Rows of equal k and t are copies of one row: every window of theirs is repeated, so it does no harm that the bytes of
    an open phrase come twice.
    """
    texts = docs.select("k", "t", F.lit(0).cast("long").alias("base"), F.encode("text", "UTF-8").alias("raw"))
    records, spans = by_rows(docs.select("k", "t", "text"), all_phrases, RECORD), None
    for block, next_block in zip(BLOCKS, (*BLOCKS[1:], None), strict=True):
        with Scratch(docs.sparkSession) as keep:
            found = written(judged(keep(records, f"phrases-{block}"), keep), f"repeats-{block}")
        part = found.where("repeated").select("k", "t", F.col("at").alias("start"), (F.col("at") + F.col("n") + (WINDOW - 1)).alias("end"))
        spans = part if spans is None else spans.unionByName(part)
        if next_block:
            inside = contexts(found.where("open"), texts, f"repeats-bytes-{block}")
            texts = inside.select("k", "t", F.col("at").alias("base"), F.col("bytes").alias("raw"))
            records = by_rows(inside, finer(next_block), RECORD)
    return spans


def kept_of(text: str | None, spans: list | None) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, maximal removed runs, and the digest of what is kept."""
    raw = (text or "").encode()
    out, at, removed, runs = hashlib.sha256(), 0, 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if start > at or not runs:
            out.update(raw[at:start])
            runs += 1
            removed += end - start
        elif end > at:
            removed += end - at
        at = max(at, end)
    out.update(raw[at:])
    return len(raw), removed, runs, out.hexdigest()


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document what removing its repeats leaves (op9's contract), with the spans themselves.

    Null texts count as empty; texts under WINDOW bytes hold no repeat; very long texts go in overlapping parts. Repeated
    rows and equal texts are repeats of each other; null doc_ids keep their rows. An empty table gives none. Columns but
    doc_id and text are ignored, whatever their names.
    """
    base = docs.select("doc_id", text_of().alias("text"))
    rows = base.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("k"), F.hash("text").alias("t"))
    spans = repeated_spans(rows).distinct().groupBy("k", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = rows.join(spans, ["k", "t"], "left").select("doc_id", F.struct("text", "spans").alias("_both"))
    done = with_columns_from(met, "_both", lambda: lambda x: list(map(list, zip(*[kept_of(r["text"], r["spans"]) for r in x], strict=True))), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.drop("_both")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of all documents; see without_repeats for nulls and other odd rows."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
