"""The column functions and parsers as functions of SQL, scalar ones and ones that return tables, without Python workers.

Each is written out of the column expression that the DataFrame operators use, so both have one definition and one plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import credits, text, urls
from kithgraph.operators import documents

#: name -> (parameters, expression of them).
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "kith_handle": ("raw STRING", text.handle),
    "kith_slug": ("raw STRING", text.slug),
    "kith_display_name": ("business STRING, full STRING, username STRING", text.display_name),
    "kith_couple_key": ("raw STRING", text.couple_key),
    "kith_search_key": ("raw STRING", text.search_key),
    "kith_event_date": ("raw STRING", text.event_date),
    "kith_clock": ("raw STRING", text.clock),
    "kith_host": ("url STRING", text.host),
    "kith_url_key": ("url STRING", text.url_key),
    "kith_url_score": ("url STRING, from_nav BOOLEAN, anchor STRING, parent_score DOUBLE", urls.url_score),
    "kith_hashtags": ("caption STRING", text.hashtags),
    "kith_mentions": ("caption STRING", text.mentions),
    "kith_role": ("label STRING", lambda label: text.ordered_role(label, credits.ROLES)),
    "kith_roles_of": ("caption STRING", credits.roles_of),
    "kith_grounding_words": ("quote STRING", documents.words),
    "kith_coverage": ("quote STRING, page STRING", documents.coverage),
    "kith_price_issue": ("kind STRING, value DOUBLE, quote STRING", documents.price_issue),
}
#: name -> (parameters, columns, expression of an array of structs with them).
TABLES: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "kith_credits": ("caption STRING", "line_no INT, role_raw STRING, handle STRING, role STRING", credits.credits_of),
}
OPERATORS = r"(?<![\w`])(and|or|not|!|=|<=>|<=|>=|<|>|\+|-|\*|/|%|\|\||&|\||\^)(?=\()"


def sql_of(column: Column) -> str:
    """The SQL text of an expression: what Spark prints of it, with operators quoted that it prints as calls."""
    printed = column._jc.toString()
    parts = re.split(r"('(?:[^'\\]|\\.)*')", printed)
    return "".join(p if i % 2 else re.sub(OPERATORS, r"`\1`", p) for i, p in enumerate(parts))


def named(parameters: str) -> list[Column]:
    return [F.col(p.split()[0]) for p in parameters.split(", ")]


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session as temporary ones; their names. Registering again replaces them."""
    for name, (parameters, make) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {sql_of(make(*named(parameters)))}")
    for name, (parameters, columns, make) in TABLES.items():
        own = ", ".join(f"x.{c.split()[0]}" for c in columns.split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT {own} FROM (SELECT explode({sql_of(make(*named(parameters)))}) AS x)")
    return [*SCALARS, *TABLES]
