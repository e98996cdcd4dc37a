"""Resampling, clusters and top-k search against brute force, with odd rows; their SQL runs beside them on the test tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import frames
import numpy as np
import pytest
from compare import differences
from kithgraph.llm import clusters, importance, queries, topk
from kithgraph.llm.vectors import LIMIT

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_resampling", "op12_clusters", "op13_top_k"])
def test_query_equals_its_sql(spark, name):
    assert not differences(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


def features(text, sizes):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, sizes + 1) for i in range(len(words) - n + 1)]


def resampled(rows, target, sizes, buckets, seed, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, sizes)[1]))
    for text in target:
        t.update(map(bucket, features(text, sizes)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        words, own = features(text, sizes)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("sizes", [1, 2])
def test_resampling_is_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_CHARS", 500)
    docs, target = frames.documents(spark), spark.createDataFrame([("seven silver birds",), (None,), ("WORD7 word8",)], "text string")
    found = importance.resampled(docs, target, sizes=sizes, buckets=50, percent=60, least=3)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == resampled([(r[0], r[1]) for r in frames.ROWS], ["seven silver birds", None, "WORD7 word8"], sizes, 50, 2024, 60, 3)
    assert {r.doc_id for r in importance.drawn(docs, target, sizes=sizes, buckets=50, percent=60, least=3).select("doc_id").collect()} == {g[0] for g in got if g[5]}


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(frames.empty(spark), none).count() == 0
    rows = importance.resampled(frames.documents(spark), none, percent=100, least=0).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(frames.ROWS) + 1))


def test_grams_stay_within_texts():
    row = importance.block_of([1, 2, 3], ["A b  c", "", "c-é"], 2)
    assert row[1:3] == [[3, 0, 2], [5, 0, 3]]
    assert dict(zip(row[6].to_pylist(), row[7].tolist(), strict=True)) == {"a": 1, "b": 1, "c": 2, "é": 1, "a b": 1, "b c": 1, "c é": 1}


def vectors(spark, n=300, size=8, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, size).astype(np.float32)], 0) for i in range(n)]
    rows += [(i, rows[7][1], 1) for i in range(n, n + 120)]  # one vector with a large part of the rows
    odd = [(1001, None, 0), (1002, [float("nan")] * size, 0), (1003, [None] + [0.1] * (size - 1), 0), (1004, [float("inf")] * size, 0), (1005, [0.1] * (size + 2), 0), (1006, [], 0), (None, [0.25] * size, None), rows[3]]
    return rows + odd, spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "'x' AS v", "'y' AS cluster", "'z' AS block", "1 AS score", "2 AS chunk")


def whole(rows, scale, size=None):
    good = [(i, v) for i, v, _ in rows if v is not None and (size is None or len(v) == size) and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * x) for x in v]) for i, v in good]


def lloyd(points, k, rounds, seed):
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(points, key=lambda p: (name(p[0]), p[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in points]
        for c in set(own):
            members = [v for (_, v), o in zip(points, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return centroids, [(i, nearest(v)[1], nearest(v)[0]) for i, v in points]


@pytest.mark.parametrize(("k", "rounds", "scale"), [(16, 3, 64), (5, 4, 4), (1, 2, 64), (40, 3, 2)])
def test_clusters_are_lloyds(spark, k, rounds, scale):
    rows, df = vectors(spark)
    found, centroids = clusters.clustered(df, k, rounds, size=8, scale=scale, seed=3)
    want, labels = lloyd(whole(rows, scale, 8), k, rounds, 3)
    assert centroids == want
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(labels, key=repr)


def test_sort_means_looks_at_fewer():
    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (16, 8))
    points = (centers[rng.integers(0, 16, 2000)] + rng.integers(-9, 9, (2000, 8))).astype(np.int64)
    order = clusters.Order(centers)
    start = order.nearest(points, np.zeros(2000, np.int32))[0]
    again, distance, looked = order.nearest(points, start)
    gaps = ((points[:, None] - centers[None]) ** 2).sum(2)
    assert (again == gaps.argmin(1)).all() and (distance == gaps.min(1)).all() and looked < 4000


def test_clusters_of_few_or_no_vectors(spark):
    found, centroids = clusters.clustered(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [5.0, 5.0], 0)], VECTORS), 16, 3, size=2)
    assert len(centroids) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    assert clusters.clustered(spark.createDataFrame([], VECTORS))[0].count() == 0


def test_large_components_fail(spark):
    df = spark.createDataFrame([(20, [float(LIMIT)], 0)], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        topk.top_k(df, df).collect()


@pytest.mark.parametrize(("k", "block", "chunk", "scale", "merge"), [(20, 64, 7, 64, 3), (5, 1000, 1000, 3, 256), (1, 50, 100, 64, 2), (1000, 100, 10, 64, 2)])
def test_top_k_is_brute_force(spark, monkeypatch, k, block, chunk, scale, merge):
    monkeypatch.setattr(topk, "MERGE", merge)
    rows, df = vectors(spark)
    points, want = whole(rows, scale), []
    for q, v in points:
        if q is not None and q % 20 == 0:
            pad = lambda x: x + [0] * (12 - len(x))
            scores = sorted(((-sum(a * b for a, b in zip(pad(v), pad(x), strict=True)), -1 if i is None else i, i) for i, x in points if i != q), key=lambda s: s[:2])[:k]
            want += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(scores)]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k, scale, block, chunk)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(20, [1.0, -2.0], 0), (1, [0.0, 0.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 20")).collect()] == [(20, 1, 1, 0)]
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(df, none).count() == 0 and topk.top_k(none, df).count() == 0
