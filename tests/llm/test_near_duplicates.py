"""The pipeline's near-duplicate stage against brute force over the sets of five-word shingles."""

import numpy as np

from kithgraph.llm import simhash


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect())


def least_of_groups(texts):
    """The least number of each component of the pairs with a similarity of 0.8 or more."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and similarity(texts[i], texts[j]) >= 0.8:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return sorted(set(label))


def edits(rng, low, high, count):
    """Pairs of a text and its copy with words appended, cut or changed, of a similarity between two bounds."""
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 10)))
    out = []
    while len(out) < 2 * count:
        base = [word() for _ in range(int(rng.integers(30, 300)))]
        n, kind = len(base), len(out) // 2 % 3
        if kind == 0:
            copy = base + [word() for _ in range(int(n * rng.uniform(0.05, 0.5)))]
        elif kind == 1:
            copy = base[int(n * rng.uniform(0.05, 0.4)) :]
        else:
            copy = [word() if rng.random() < rng.uniform(0.01, 0.08) else w for w in base]
        pair = [" ".join(base), " ".join(copy)]
        if low <= similarity(*pair) < high:
            out += pair
    return out


def test_no_near_copy_is_missed(spark):
    texts = edits(np.random.default_rng(7), 0.8, 0.9, 90)
    assert kept(spark, texts) == list(range(0, len(texts), 2)) == least_of_groups(texts)


def test_no_document_under_the_similarity_is_removed(spark):
    texts = edits(np.random.default_rng(8), 0.7, 0.8, 60)
    assert kept(spark, texts) == list(range(len(texts))) == least_of_groups(texts)


def test_documents_of_the_same_long_words(spark, monkeypatch):
    """One template with other short words in each, and near copies of some: their fingerprints of long words are equal."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(9)
    long = ["template", "sentence", "invoice", "customer", "delivery", "contract"]
    texts = [" ".join(w for i in range(60) for w in (long[i % 6], str(rng.integers(10, 99)))) for _ in range(60)]
    texts += [t + " 7" for t in texts[:10]] + [" ".join([*texts[20].split()[:119], str(i)]) for i in range(100, 130)]
    assert kept(spark, texts) == least_of_groups(texts)
