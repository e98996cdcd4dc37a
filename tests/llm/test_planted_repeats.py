import random

from kithgraph.llm import repeats


def test_planted_passages_are_removed_by_bytes_not_by_words(spark):
    """Of passages of 60 words in two documents each, those of 400 bytes go and shorter ones stay; clean documents lose nothing."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    prose = lambda words, n: " ".join(word(n) for _ in range(words))
    planted = {i: prose(60, 7 if i % 2 else 4) for i in range(40)}
    rows, long = [], {}
    for i, passage in planted.items():
        for half in (0, 1):
            rows.append((2 * i + half, f"{prose(90, 6)} {passage} {prose(90, 6)}"))
            long[2 * i + half] = len(passage) >= repeats.WINDOW
    rows += [(1000 + i, prose(240, 6)) for i in range(40)]
    found = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in found.items() if r.n_removed} == {k for k, x in long.items() if x} and sum(long.values()) == 40
    assert all(found[k].n_removed >= len(planted[k // 2]) for k, x in long.items() if x)
    assert all(found[k].n_bytes == len(text) for k, text in rows)
