"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Each pattern starts only where a run of its first class starts, or where the last match ended, which gives the leftmost
non-overlapping matches in linear time however long the run. Positions come from splitting a text at its matches: the
lengths of the pieces and of the matches add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import packed_rows, text_of, unpacked_rows

#: The order of kinds, base kinds first, and the patterns.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words whose presence within CONTEXT characters before a span raises its score.
WORDS = {
    "email": ["mail", "contact"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile"],
    "iban": ["iban", "account", "bank"],
    "ssn": ["ssn", "social security"],
}
CONTEXT = 40
#: The score of a span that its pattern and checksum admit; a context word adds the bonus.
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS, LEAST = 0.3, 0.6
SPAN = "array<struct<start:int,end:int,kind:int,score:double>>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder by 97 of an account number with its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda acc, c: step(acc, c).cast("int"))


def admitted(kind: str, value: Column) -> Column:
    """Whether a proposed span passes its kind's checks."""
    if kind == "ip":
        small = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
        return F.forall(F.split(small, r"\."), lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        digits = digits_of(value)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind == "iban":
        return mod97(value) == 1
    return F.lit(True)


def proposals(kind: str, text: Column) -> Column:
    """All matches of a kind as an array of (start, end, value), in code points."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["n"]).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).cast("int").alias("start"), (acc["at"] + x["gap"] + x["n"]).cast("int").alias("end"), x["value"].alias("value")))).alias("out"),
    )
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def checked(kind: str, found: Column, text: Column) -> Column:
    """The proposals that checks and score admit, as spans with scores. Base kinds need only their checks."""
    near = lambda x: F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"])))
    bonus = lambda x: F.when(reduce(lambda a, b: a | b, [F.contains(near(x), F.lit(w)) for w in WORDS[kind]]), BONUS).otherwise(0.0)
    scored = F.transform(
        F.filter(found, lambda x: admitted(kind, x["value"])),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.round(F.lit(SCORES[kind]) + bonus(x), 2).alias("score")),
    )
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)


def with_spans(rows: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """Adds the sorted array of personal-data spans of a text column: (start, end, kind as a number in KINDS, score).

    Code points, end exclusive. Null and empty texts have none. A text without the sign that a kind needs is not
    searched for it.
    """
    out, col = rows, F.col(text)
    for kind in KINDS:
        might = F.contains(col, F.lit(NEEDS[kind])) if kind in NEEDS else col.rlike("[0-9]")
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        out = out.withColumn(f"_{kind}", F.coalesce(F.when(might, proposals(kind, col)), none))
    every = F.concat(*[checked(kind, F.col(f"_{kind}"), col).cast(SPAN) for kind in KINDS])
    order = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score")))
    sorted_ = F.transform(F.array_sort(order), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score")))
    return out.withColumn(to, sorted_).drop(*[f"_{kind}" for kind in KINDS])


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(marks, x["kind"] + 1))).alias("out"))
    )
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data per document (op10's contract).

    Null and empty texts have none; very long texts are searched whole. Repeated rows each give a row; spans of several
    kinds at one place are all listed, by start and kind. An empty table gives no rows. Columns but doc_id and text are
    ignored, whatever their names.
    """
    rows = with_spans(docs.select("doc_id", text_of().alias("text"))).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked and n_chars counted anew; same columns, whatever their names. Null texts become empty."""
    rows = with_spans(packed_rows(docs))
    return unpacked_rows(rows.withColumn("masked", redacted(F.col("text"), F.col("spans"))), docs, "masked")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see personal_data for nulls and other odd rows."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
