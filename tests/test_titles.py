"""Titles search each pattern once a name and give what a plain version gives."""

import random
import re

from kithgraph.operators import checks as C
from pyspark.sql import functions as F

OUT = ["hair", "the", "black"]


def title(caption):
    if caption is None:
        return None
    text = caption.strip(" ")
    name = lambda w: len(w) >= 2 and w.lower() not in OUT
    cased = lambda w: w[:1].upper() + w[1:].lower() if w in (w.upper(), w.lower()) else w
    for p, n in ((C.POSSESSIVE, 2), (C.BOTH_MRS, 1), (C.SURNAME, 1), (C.BY_X, 2), (C.BY_SIGN, 2)):
        m = re.search(p, text, re.ASCII)
        if m and all(name(m[i + 1]) for i in range(n)):
            return f"{cased(m[1])} & {cased(m[2])}" if n == 2 else f"The {cased(m[1])}"
    return None


def test_couple_titles(spark):
    rng = random.Random(4)
    parts = ["Anna", "BEN", "o'brien", "hair", "The", "the", " and ", " AND ", "&", "+", " x ", " X ", "'s", "'S", "’s", " wedding", " Wedding", "Mr. ", "Mrs. ", "mrs ", " ", "\n", "1", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(3000)] + [(-1, None), (-2, "")]
    got = spark.createDataFrame(rows, "id int, caption string").select("caption", C.couple_title(F.col("caption"), OUT).alias("t"))
    assert [x for x in got.collect() if x.t != title(x.caption)] == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 8
