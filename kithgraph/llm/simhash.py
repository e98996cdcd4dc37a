"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a random vector of radius + 1 bits; each non-zero vector v gives the mask of the positions whose
product with v is odd. Whatever set of at most `radius` bits two fingerprints differ in, some v is orthogonal to all
their vectors, so under its mask the two agree: every pair within the radius meets in some table. Buckets of many
fingerprints are split by the same construction over their free bits until they are small, which keeps the guarantee.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm.common import Scratch, by_rows, packed_rows, text_of, unpacked_rows, with_columns_from, written

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Nodes in a bucket that one call compares; larger buckets are split, LEVELS times at most, which leaves a few free bits.
BUCKET = 4_096
LEVELS = 4


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of `size` words, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    words, h = text.encode().lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([h(joined, 42)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lens + 1) - 1
    begin = (end - lens)[: len(words) - size + 1].tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(begin, end[size - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set, as a signed 64-bit integer; none: zero."""
    n, total = len(hashes), np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        part = hashes[a : a + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, size: int = SHINGLE, to: str = "fp", hashes: Callable[[str, int], np.ndarray] = shingle_hashes) -> DataFrame:
    """Adds the fingerprint of the text column."""
    return with_columns_from(docs, "text", lambda: lambda texts: [[simhash(hashes(t, size)) for t in texts]], f"{to} long")


def masks(radius: int, bits: list[int], seed: int) -> list[int]:
    """The masks of a covering over some bit positions, as signed integers."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), len(bits))
    found = {sum(1 << b for b, m in zip(bits, vectors.tolist(), strict=True) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))}
    return sorted(m - (1 << 64) if m >> 63 else m for m in found)


def stars(found: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges from each fingerprint to the least of its component in the graph of pairs that differ in at most `most` bits.

    Memory is linear in the fingerprints: the links of one at a time are looked at.
    """
    rest, out = np.sort(found), []
    while len(rest):
        root, stack, rest = rest[0], [rest[0]], rest[1:]
        while stack and len(rest):
            # of a signed number, numpy counts the bits of the absolute value
            near = np.bitwise_count(rest.view(np.uint64) ^ np.int64(stack.pop()).view(np.uint64)) <= most
            out += [(int(x), int(root)) for x in rest[near]]
            stack += rest[near].tolist()
            rest = rest[~near]
    return out


def bucket_edges(nodes: DataFrame, radius: int, most: int, seed: int = 11) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints that differ in `most` bits, at most the radius.

    nodes: fp long, distinct. Buckets come from a count per key, pre-aggregated where the rows are; only rows of shared
    buckets are moved again. Each level has one covering of all positions, whose masks are added to those of the large
    buckets: a pair agrees outside its differing bits, which some mask of every level avoids. So masks are 31 constants a
    level, and after LEVELS a bucket holds few fingerprints, as they are distinct.
    """

    def linked(batches):
        import pandas as pd

        for rows in batches:
            out = [e for found in rows["found"] for e in stars(np.array(found, np.int64), most)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows, edges = nodes.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask")), None
    for depth in range(LEVELS):
        table = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius, list(range(BITS)), seed + depth))])
        rows = rows.select("fp", "path", "mask", F.explode(table).alias("x")).select("fp", (F.col("path") * 1024 + F.col("x.i")).alias("path"), F.col("mask").bitwiseOR(F.col("x.m")).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        small = sizes if depth == LEVELS - 1 else sizes.where(F.col("n") <= BUCKET)
        met = rows.select("fp", "path", "key").join(small.drop("n"), ["path", "key"])
        part = by_rows(met.groupBy("path", "key").agg(F.collect_list("fp").alias("found")).select("found"), linked, "a long, b long")
        edges = part if edges is None else edges.unionByName(part)
        large = sizes.where(F.col("n") > BUCKET)
        if depth == LEVELS - 1 or large.isEmpty():
            break
        rows = written(rows.join(large.drop("n"), ["path", "key"]).select("fp", "path", "mask"), "large-buckets")
    return to_least(edges)


def to_least(edges: DataFrame) -> DataFrame:
    """Edges with the same components, about one per node: each node and the others that it points to, to the least of those.

    A node points to one other per bucket at most, so what is gathered for a node is bounded by the number of masks.
    """
    held = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("others"))
    return held.select(F.explode(F.concat(F.array("a"), "others")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, own: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): the least node that it is connected to.

    Alternates large-star and small-star steps, each a written table, until nothing changes; the table before is deleted.
    Minima are aggregated before they are moved, so a node of many edges is no hot group. The result reads the last
    table, which goes with `own`.
    """
    spent = Scratch(edges.sparkSession)
    now = spent(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before, seen = None, mark(now)
    while seen != before:
        fresh = Scratch(edges.sparkSession)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spent(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")  # a plain table: the join can split a node of many edges
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        now = fresh(small.distinct(), "edges")
        before, seen = seen, mark(now)
        spent.clear()
        spent = fresh
    if own is not None:
        own.paths += spent.paths
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of docs: op1's contract.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows and ties each give a row. A null
    doc_id keeps its row; a component of nulls only has a null id. An empty table gives none. Very long texts are hashed
    whole. Columns but doc_id and text are ignored, whatever their names.
    """
    rows = written(with_fingerprint(docs.select("doc_id", text_of().alias("text")), size).select("doc_id", "fp"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(bucket_edges(nodes.select("fp"), radius, radius)).withColumnRenamed("node", "fp")
    first = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = first.join(least, "root").select("fp", "component_id")
    return rows.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see near_duplicates for nulls and other odd rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Of the pipeline's stage: sets of five-word shingles, linked at a Jaccard similarity of 4/5 or more.
STAGE_SHINGLE, LINK, OF = 5, 4, 5
#: Hot shingles come from one document in SAMPLE; at most HOT of them are broadcast. They set an order that all sets share, no more.
SAMPLE, HOT = 16, 400_000
#: The chance that a pair of similarity 0.8 shares no key, per set; 64-bit hashes collide more often.
MISS = 1e-12
#: 64-bit words of the parity sketch of a set.
SKETCH = 16
KEY = ["_k1", "_k2"]


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, STAGE_SHINGLE))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the hashes fall on it: two sets differ in at least as many hashes as sketches in bits."""
    at = (hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH)
    return np.packbits(np.bincount(at, minlength=64 * SKETCH) & 1, bitorder="little").view(np.int64)


def keys_of(hashes: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set in one order for all sets: by hash, hot ones last and the hottest at the end.

    Of a set of n, a set of similarity 0.8 lacks at most n / 5. So the first hash that both have is among the first
    n - ceil(0.8 n) + 1 for sure; and, as the order of the cold ones is random, among the first m of them but for a chance
    of (n / 5 cold)^m. The lesser number is taken, with that chance at MISS.
    """
    n, last = len(hashes), np.zeros(len(hashes), np.int64)
    if not n:
        return hashes.view(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        last = np.where(hot[at] == hashes, 1 + rank[at], 0)
    m, cold = n + LINK * -n // OF + 1, int((last == 0).sum())
    if OF * cold > n:
        m = min(m, int(np.ceil(np.log(MISS) / np.log(n / (OF * cold)))))
    return hashes[np.lexsort((hashes, last))][:m].view(np.int64)


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents of a sample, in order, and the rank of each by its documents."""
    some = docs.where(F.pmod("_k1", F.lit(SAMPLE)) == 0).select("text")
    sets = with_columns_from(some, "text", lambda: lambda texts: [[shingle_set(t).view(np.int64) for t in texts]], "sh array<long>")
    counts = sets.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "s").limit(HOT).toArrow()
    hot, n = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hot)
    return hot[order], n[order].astype(np.int64)


def sizes_fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return F.least(a, b) * OF >= F.greatest(a, b) * LINK


def may_be_alike(x: str, y: str) -> Column:
    """What the sizes and sketches of two sets leave possible: never false for a similarity of 0.8. The terms are few and compiled."""
    n = lambda side: F.col(f"{side}.n")
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return sizes_fit(n(x), n(y)) & (apart * (LINK + OF) <= n(x) + n(y))


def true_links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 0.8 or more.

    Sizes and sketches leave out pairs that cannot; for the rest the texts of their nodes are hashed again and compared.
    """
    traits = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", "sketch").alias(f"of_{c}"))
    pairs = keep(pairs.distinct().join(traits("a"), "a").join(traits("b"), "b").where(may_be_alike("of_a", "of_b")).select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select(*KEY, "text").join(nodes.select("node", *KEY).join(ends, "node", "left_semi"), KEY).dropDuplicates(["node"])
    sets = keep(with_columns_from(texts, "text", lambda: lambda ts: [[shingle_set(t).view(np.int64) for t in ts]], "sh array<long>").select("node", "sh"), "sets")

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("sh").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))  # in the plan: batches of pairs of whole sets would fill the memory beside the heap
    return keep(met.where(shared * (LINK + OF) >= (F.size("x") + F.size("y")) * LINK).select("a", "b"), "links")


def covered(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes by the covering: each fingerprint's nodes in a row, and fingerprints within the radius."""
    row = Window.partitionBy("fp").orderBy("n", "node")
    same = nodes.select(F.lag("node").over(row).alias("a"), F.col("node").alias("b")).where("a is not null")
    first = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    edges = bucket_edges(first.select("fp"), radius, radius).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def not_joined(shared: DataFrame, roots: DataFrame, nodes: DataFrame, keep: Scratch) -> DataFrame:
    """The rows (s, node, n, root, top, sketch) under keys of several roots; top is the most frequent root there."""
    rooted = shared.join(roots, "node", "left").select("s", "node", "n", F.coalesce("root", "node").alias("root"))
    counts = rooted.groupBy("s", "root").agg(F.count("*").alias("of"))
    top = counts.groupBy("s").agg(F.max(F.struct("of", "root"))["root"].alias("top"), F.count("*").alias("roots")).where("roots > 1").select("s", "top")
    return keep(rooted.join(top, "s").join(nodes.select("node", "sketch"), "node"), "not-joined")


def some_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row outside the top root with a few others under its key: the next members of the top root on
    both sides, and the next row, in a random order that differs from key to key."""
    draw, members = F.xxhash64("s", "node"), F.when(F.col("root") == F.col("top"), F.struct("node", "n", "root"))
    picks = []
    for order in (draw, draw.desc()):
        row = Window.partitionBy("s").orderBy(order, "node")
        picks += [F.last(members, True).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lag(F.struct("node", "n", "root")).over(row)]
    met = rest.withColumn("picks", F.array(*picks)).where("root <> top").select("node", "n", "root", F.explode("picks").alias("p"))
    return met.where(F.col("p").isNotNull() & (F.col("p.root") != F.col("root")) & sizes_fit(F.col("p.n"), F.col("n"))).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, keep: Scratch) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets of similarity 0.8 or more.

    docs: _k1, _k2, text. nodes: node, the key of one document, n, fp, sketch, keys. The covering proposes what is within
    its radius, and under each shared key a node's neighbours by size and in a random order; then, under keys that hold
    several roots still, some members of the most frequent one. True ones of these join groups of near copies at the cost
    of a chain. Last come all pairs under a key that those links have not joined. So a group is never gathered in one
    place, and a group of near copies is never compared with itself.
    """
    by_size, at_random = Window.partitionBy("s").orderBy("n", "node"), Window.partitionBy("s").orderBy(F.xxhash64("node", "s"), "node")
    held, one = nodes.select("node", "n", F.explode("keys").alias("s")), F.struct("node", "n")
    held = held.withColumn("before", F.lag(one).over(by_size)).withColumn("after", F.lead("node").over(by_size)).withColumn("drawn", F.lag(one).over(at_random))
    shared = keep(held.where("before is not null or after is not null").drop("after"), "shared-shingles")
    chain = shared.select("node", "n", F.explode(F.array("before", "drawn")).alias("p")).where(F.col("p").isNotNull() & sizes_fit(F.col("p.n"), F.col("n")))
    chain = chain.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
    to_root = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = keep(components(true_links(chain.unionByName(covered(nodes)), docs, nodes, keep), keep), "roots")
    more = true_links(some_pairs(not_joined(shared, roots, nodes, keep)), docs, nodes, keep)
    roots = keep(components(to_root(roots).unionByName(more), keep), "roots")
    rest = not_joined(shared, roots, nodes, keep)
    # of two roots under one s, one at least is not the most frequent there; the join tests a pair before it makes a row of it
    x, y = rest.alias("x"), rest.where("root <> top").alias("y")
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & may_be_alike("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return to_root(roots).unionByName(true_links(met, docs, nodes, keep))


def winners(docs: DataFrame) -> DataFrame:
    """One key of (_k1, _k2, doc_id, text) for each group of near-duplicates by five-word shingles at a similarity of 0.8 or more.

    Groups are the components of all pairs whose sets of shingles have that Jaccard similarity, verified on the whole
    sets. Of a group the row of the smallest doc_id wins, rows without one last, ties by key.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs))

    def make():
        import xxhash

        def run(texts: list[str]) -> list[list]:
            sets = [shingle_set(t) for t in texts]
            wide = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            return [wide[:, 0], wide[:, 1], [len(x) for x in sets], [simhash(x) for x in sets], [sketch(x) for x in sets], [keys_of(x, *hot.value) for x in sets]]

        return run

    with Scratch(docs.sparkSession) as keep:
        rows = keep(with_columns_from(docs, "text", make, "lo long, hi long, n long, fp long, sketch array<long>, keys array<long>").drop("text"), "stage-sets")
        same = rows.groupBy("lo", "hi").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "keys")])
        nodes = keep(same.withColumn("node", F.monotonically_increasing_id()).select("node", "first.*", "n", "fp", "sketch", "keys"), "stage-nodes")
        root = components(links(docs, nodes, keep), keep)
        first = nodes.select("node", F.struct("none", "doc_id", *KEY).alias("first")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return written(first.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2"), "winners")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates; same columns.

    Null texts are empty, and all of one group; so are texts of white space. Texts under five words are one shingle.
    Repeated rows are copies. A null doc_id loses to any other. Very long texts are compared whole. An empty table stays
    empty. Other columns pass through, whatever their names.
    """
    rows = packed_rows(docs, F.xxhash64("doc_id", text_of()).alias("_k1"), F.xxhash64(F.lit("wide"), "doc_id", text_of()).alias("_k2"))
    kept = winners(rows.select(*KEY, "doc_id", "text"))
    return unpacked_rows(rows.join(kept, KEY, "left_semi").dropDuplicates(KEY), docs)
