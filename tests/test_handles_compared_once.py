"""Handles that many accounts share are compared once, and all their accounts still pair, with what else is said of them."""

from kithgraph.operators import aliases as A
from pyspark.sql import functions as F

ACCOUNT = "id long, username string, full_name string, url string, biography string, followers long, scraped boolean, category string, events long, in_scope boolean"


def test_shared_handles(spark, monkeypatch):
    names = ["northpier_hall", "northpier_hale", "southbank.room", "northpierhall"]
    rows = [(i, names[i % 4], None, None, None, 5 if i < 40 else None, False, None, 0, True) for i in range(80)]
    asked = []
    within = A.within_edits
    monkeypatch.setattr(A, "within_edits", lambda df, most: asked.append(df.count()) or within(df, most))
    lines = [(p, 0, a) for p in range(2) for a in (0, 41)]  # a pair of S6 that S5 tells of too
    df = spark.createDataFrame
    found = A.proposals(df(rows, ACCOUNT), df(lines, "post_id long, line_id long, account_id long"), df([], "post_id long, anchor_id long, guess string"), df([(1, 40)], "alias_id long, canonical_id long"), [], [], [])
    got = {(r.id_a, r.id_b): r.signals for r in found.collect()}
    assert asked == [4]
    edits = {(0, 1), (1, 0), (1, 3), (3, 1)}  # handles one or two edits apart that signs alone don't explain
    signs = {(0, 3), (3, 0)}
    want = {}
    for i in range(80):
        for j in range(i + 1, 80):
            k = (i % 4, j % 4)
            s6 = (i < 40) != (j < 40)
            codes = (["S1b"] if k in signs else []) + (["S5"] if (i, j) == (0, 41) else []) + (["S6"] if s6 and (k in edits or k in signs) else [])
            whole = [40 if x == 1 else x for x in (i, j)]
            if codes and whole[0] != whole[1]:
                want[i, j] = ",".join(codes)
    assert got == want
    assert found.groupBy("id_a", "id_b").count().where(F.col("count") > 1).isEmpty()
