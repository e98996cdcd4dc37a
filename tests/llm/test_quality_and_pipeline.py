"""The classifier's votes against brute force, and the whole pipeline against a plain version of each stage."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from kithgraph.llm import quality
from kithgraph.llm.common import Scratch, new_path, shared_dir

public = pytest.importorskip("public_tokenizers")
WORDS = "river stone calm winter garden light morning story letter window quiet road harbour music orchard silver".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 400)) for _ in range(n)) + "."


def corpus():
    """Texts by id, and the ids of good ones; bad ones are shouting adverts."""
    rng = np.random.default_rng(12)
    good = {i: " ".join(sentence(rng, 12) for _ in range(6)) for i in range(60)}
    bad = {100 + i: f"BUY NOW!! item{i} $$$ CHEAP!! *** ### " * (6 + i % 3) for i in range(60)}
    return good, bad, rng


def test_votes_equal_brute_force(spark):
    good, bad, _ = corpus()
    docs = spark.createDataFrame([*good.items(), *bad.items(), (300, ""), (301, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in [*good, *bad]], "doc_id long, quality int, toxic int")
    taught = [i for i in [*good, *bad] if zlib.crc32(str(i).encode()) % 5]
    model = quality.fitted(docs, labels)
    n, having = quality.document_frequencies(docs.fillna(""))
    texts = {**good, **bad, 300: "", 301: ""}
    counted = {i: quality.features([t])[0] for i, t in texts.items()}
    assert n == len(texts) and (having == sum((c > 0).astype(int) for c in counted.values())).all()
    assert sorted(model.labels.tolist()) == sorted(float(i in good) for i in taught)

    def vector(c):
        x = np.log1p(c) * (np.log((1 + n) / (1 + having)) + 0.1)
        y = (x / max(np.sqrt((x * x).sum()), 1e-9)) @ model.space.astype(float)
        return y / max(np.sqrt((y * y).sum()), 1e-9)

    known = [(vector(counted[i]), float(i in good)) for i in taught]
    for r in quality.scored(docs, labels).collect():
        near = sorted(((float(vector(counted[r.doc_id]) @ v), y) for v, y in known), key=lambda x: -x[0])[: quality.K]
        weights = [(max(s, 0) ** quality.POWER, y) for s, y in near]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total and texts[r.doc_id] else np.mean([y for _, y in known])
        assert abs(r.score - want) < 1e-3, r.doc_id


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_the_whole_pipeline(spark, tmp_path):
    good, bad, rng = corpus()
    passage = sentence(rng, 14)
    near = {70: good[3] + " river1", 71: good[3], 72: " ".join(good[8].split()[:-4])}
    leaked = {80: good[20][:200] + " " + passage + " " + sentence(rng, 40)}
    private = {90: sentence(rng, 50) + " write to a.b@c.de or call +1 (312) 555-0199 now. " + sentence(rng, 30)}
    rows = [*good.items(), *bad.items(), *near.items(), *leaked.items(), *private.items(), (5, good[5]), (None, sentence(rng, 60)), (400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string, _k1 string")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i in [*good, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    want = {i: t for i, t in {**good, **leaked, **private}.items()}  # copies and adverts go
    want[80] = re.sub(re.escape(passage.rstrip(".")), "", want[80])
    want[90] = want[90].replace("a.b@c.de", "[EMAIL]").replace("+1 (312) 555-0199", "[PHONE]")
    assert set(got) - {None, 400} == set(want) and None in got
    for i, text in want.items():
        ids = np.array([*ids_of(text), 1], "<u4")
        at = 0
        for start, n, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids), i


def test_the_pipeline_of_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name, columns in [("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")]:
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "personal data", "packing"]


def test_scratch_tables_go(spark):
    import os

    with Scratch(spark) as keep:
        df = keep(spark.range(3).toDF("k"), "gone")
        path = keep.paths[0]
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path) and new_path(spark, "x").startswith(shared_dir(spark))
