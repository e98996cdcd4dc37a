"""The label rules of the test tables' own captions, and rows of the given tables that carry sample texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.labels import Rule
from kithgraph.tables import table

RULES = [
    Rule("context", r"\brehearsal dinner\b", "rehearsal_dinner"), Rule("context", r"\breception\b", "reception"), Rule("context", r"\bceremony\b", "ceremony"),
    Rule("participant", "^brides?$", "bride"), Rule("participant", "^models?$", "model"), Rule("press", "^featured in$"), Rule("noise", "^(team|by)$"), Rule("phase", "chapel", "ceremony"),
    Rule("exact", "hmu", "hair,makeup"), Rule("exact", "tent", "tent"), Rule("qualifier", "^(our|lead) "), Rule("head", "^second shooter$", "second_shooter"), Rule("head", r"\bphoto(graphy|grapher)?$", "photographer"),
    Rule("head", r"\b(venue|hall)$", "venue"), Rule("head", r"\bplann(er|ing|ing co)$", "planner"), Rule("head", r"\b(floral design|florals)$", "florist"), Rule("head", r"\bcatering$", "catering"), Rule("head", r"\bbar$", "bar_service"),
    Rule("head", r"\bhair$", "hair"), Rule("head", r"\bmakeup$", "makeup"), Rule("head", r"\bcake$", "cake"), Rule("head", r"\bdj$", "dj"), Rule("head", r"\bband$", "band"), Rule("head", r"\bofficiant$", "officiant"),
    Rule("head", r"\b(lighting|draping)$", "lighting_production"), Rule("head", r"\btables$", "rentals"),
]


def spread(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every customer with every one of a few sample rows: the customers' columns and the rows' ones. The rows are constants.

    The table is small on disk for the work that its rows make, so it is dealt to as many tasks as a shuffle has.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    each = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(row, fields, strict=True)]) for row in rows])
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return customers.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.explode(each).alias("x")).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "x.*")
