"""Benchmark decontamination: a broadcast set of normalised test n-grams against the word windows of every document.

Words and windows become 64-bit hashes over whole batches in numpy; a window whose hash is in the set is compared word
by word before it counts. The set is broadcast only as far as its size is bounded: items are dealt into blocks of some
BLOCK_WORDS words, as many as a sum over the items asks for, and every block is scanned against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import packed_rows, text_of, unpacked_rows, with_columns_from, written

N = 10
#: Words of items that one broadcast set holds at most (about 100 bytes each).
BLOCK_WORDS = 1_000_000
CHUNK_BYTES = 500_000
MANY = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


class Words:
    """The words of a batch of texts: byte borders, hashes, and the first word of each text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.raw = LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
        word = WORD[self.raw]
        turn = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.begin, self.end = turn[::2], turn[1::2]
        self.text_at = np.concatenate([[0], np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))])
        self.first = np.searchsorted(self.begin, self.text_at)
        n = len(self.raw)
        up, down = powers(n)
        mixed = (self.raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * up[:n])])
        hashed = (sums[self.end] - sums[self.begin]) * down[self.begin]
        self.hashes = hashed ^ (hashed >> np.uint64(31))

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window of `size` words that starts at each word; only those within a text mean something."""
        count = max(0, len(self.hashes) - size + 1)
        out = np.zeros(count, np.uint64)
        for i in range(size):
            out = out * MANY + self.hashes[i : i + count]
        return out ^ (out >> np.uint64(33))

    def phrase(self, word: int, size: int) -> bytes:
        return b" ".join(self.raw[self.begin[i] : self.end[i]].tobytes() for i in range(word, word + size))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = [np.full(n + 1, x, np.uint64) for x in (0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 2**64))]
        for p in _POWERS:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    return _POWERS


class Grams:
    """The windows of some items: by window size, sorted hashes; by hash, the phrases and their items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.phrases: dict[tuple[int, bytes], list[int]] = {}
        sizes: dict[int, set[int]] = {}
        for item, text in items:
            words = Words([text])
            count = len(words.begin)
            if not count:
                continue
            size = min(n, count)
            for at, h in enumerate(words.windows(size).tolist()):
                owners = self.phrases.setdefault((size, words.phrase(at, size)), [])
                if item not in owners[-1:]:
                    owners.append(item)
                sizes.setdefault(size, set()).add(h)
        self.sizes = {size: np.array(sorted(found), np.uint64) for size, found in sizes.items()}


def scan(texts: list[str], grams: Grams) -> list[tuple[int, list[int], list[int]]]:
    """Of each text: its words, the numbers of hit words, and the items whose windows occur."""
    words = Words(texts)
    hit = np.zeros(len(words.begin) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for size, known in grams.sizes.items():
        hashes = words.windows(size)
        place = np.searchsorted(known, hashes)
        maybe = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes)
        text_of_word = np.searchsorted(words.first, maybe, "right") - 1
        for at, text in zip(maybe.tolist(), text_of_word.tolist(), strict=True):
            if at + size <= words.first[text + 1] and (owners := grams.phrases.get((size, words.phrase(at, size)))):
                hit[at] += 1
                hit[at + size] -= 1
                items[text].update(owners)
    marked = np.cumsum(hit[:-1]) > 0
    out = []
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        out.append((b - a, np.flatnonzero(marked[a:b]).tolist(), sorted(items[i])))
    return out


def in_chunks(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """Whole texts together up to a size; a longer text goes alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct items (item_id, text) in blocks of some BLOCK_WORDS words by a hash of the id, one at a time on the driver.

    Items without id or text are left out: they have no words or no name. A single item is never cut, so a block is
    bounded by BLOCK_WORDS and its longest item.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text")).where("item_id is not null and text <> ''").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * BLOCK_WORDS)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    rows = written(rows, "benchmark-blocks") if blocks > 1 else rows
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in rows.where(F.col("_block") == b).select("item_id", "text").collect()]


def with_hits(rows: DataFrame, benchmark: DataFrame, n: int = N, clean: bool = False) -> DataFrame:
    """Adds to rows with a text column its number of words, the numbers of hit words, the items that occur, and the text
    without the hit words if it is to be cleaned.

    Blocks of items are scanned one after the other over the same rows, so no row is moved or joined. Between two blocks the
    rows are written, and the block before is released on the driver and the executors.
    """
    out = rows.withColumn("_n_words", F.lit(0).cast("long")).withColumn("_hits", F.array().cast("array<int>")).withColumn("_items", F.array().cast("array<long>"))
    shared = None
    for block in item_blocks(benchmark):
        if shared is not None:
            out = written(out, "scanned")
            shared.destroy()
        shared = rows.sparkSession.sparkContext.broadcast(Grams(block, n))

        def search(shared=shared):
            def run(values: list[dict]) -> list[list]:
                found = [x for part in in_chunks([v["text"] for v in values]) for x in scan(part, shared.value)]
                own = [cleaned(v["text"], sorted({*v["hits"], *x[1]})) if clean else None for v, x in zip(values, found, strict=True)]
                return [[x[0] for x in found], [x[1] for x in found], [x[2] for x in found], own]

            return run

        seen = out.drop("_clean").withColumn("_both", F.struct("text", F.col("_hits").alias("hits")))
        out = with_columns_from(seen, "_both", search, "_n long, _hit array<int>, _item array<long>, _clean string").select(
            *rows.columns, F.col("_n").alias("_n_words"), F.array_union("_hits", "_hit").alias("_hits"), F.array_union("_items", "_item").alias("_items"), "_clean"
        )
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document what occurs in it of the benchmark (op5's contract).

    Null and empty texts have no words and no hits; very long texts are scanned whole; repeated rows each give a row; an
    empty table gives none; an empty benchmark hits nothing. Several rows of an item_id are one item with the windows of
    all. Columns but doc_id and text are ignored, whatever their names.
    """
    found = with_hits(docs.select("doc_id", text_of().alias("text")), benchmark)
    digest = F.sha2(F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ","), 256)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_hits").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        digest.alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"),
    )


def cleaned(text: str, hit: list[int]) -> str:
    """A text without its hit words: each run of them goes from its first word's start to its last word's end."""
    if not hit:
        return text
    raw, words = text.encode(), Words([text])
    out, at = [], 0
    for run in np.split(np.array(sorted(hit)), np.flatnonzero(np.diff(sorted(hit)) != 1) + 1):
        out.append(raw[at : words.begin[run[0]]])
        at = int(words.end[run[-1]])
    return b"".join([*out, raw[at:]]).decode()


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the words that windows of the benchmark cover; those with no word left are dropped. Same columns.

    Null and empty texts have no words and stay, as do repeated rows; very long texts are scanned whole; an empty table or
    an empty benchmark changes nothing. Other columns pass through, whatever their names.
    """
    done = with_hits(packed_rows(docs), benchmark, clean=True)
    return unpacked_rows(done.where((F.size("_hits") == 0) | (F.size("_hits") < F.col("_n_words"))), docs, "_clean")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; see contamination for nulls and other odd rows."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
