"""Small frames with the cases that every operator must bear."""

from __future__ import annotations

LONG = " ".join(f"word{i}" for i in range(3_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven silver birds sing softly near the old mill by the river " * 6

#: Nulls in any column, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, "Plain words of no importance at all, written by nobody for no one in particular.", "en", "src0", 80),
    (1, "Plain words of no importance at all, written by nobody for no one in particular.", "en", "src0", 80),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, LONG, "en", "src0", len(LONG)),
    (5, LONG + " tail", "en", "src0", len(LONG) + 5),
    (6, "start one " + PASSAGE + " end one", "en", "src2", None),
    (7, "another start " + PASSAGE + " another end", "fr", "src2", None),
    (8, "  \n\t ", "de", "src3", 4),
    (9, "ÀÉÎ mail me: a.b@c.de or +1 (312) 555-0199, card 4111 1111 1111 1111, ip 10.0.0.255 and 300.1.1.1", "fr", "src3", 100),
    (10, "\U0001f600 emoji \U0001f600 x@y.zz", "en", "src1", 15),
    (None, "no id here", "en", "src1", 10),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """The rows with columns whose names clash with what operators call theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, COLUMNS)
    for name in ("k", "t", "node", "fp", "row", "spans", "_score", "_hits", "_key", "start", "end", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def texts() -> dict:
    """doc_id -> text of the rows with an id; null as empty."""
    return {r[0]: r[1] or "" for r in ROWS if r[0] is not None}
