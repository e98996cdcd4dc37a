"""Parameterised queries behind pages: browsing, listing, profiles, events with their stacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import matches_any

#: The most rows of a page.
MOST_ROWS = 500


def checked_page(limit: int, offset: int) -> tuple[int, int]:
    """Bounds of a page: a limit from 1 to MOST_ROWS and an offset from 0."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return max(1, min(limit, MOST_ROWS)), offset


def checked_role(role: str | None) -> str | None:
    """A role as an identifier-like word; other input is refused."""
    if role is not None and not re.fullmatch(r"[A-Za-z_#0-9]{1,32}", role):
        raise ValueError(f"not a role: {role!r}")
    return role


def browse(accounts: DataFrame, credits: DataFrame, role: str | None = None, text: str | None = None, least: int = 0, limit: int = 50, offset: int = 0) -> DataFrame:
    """Accounts by their number of events, filtered by what is given; absent filters are left out of the plan.

    accounts: account_id, name, role. Accounts that no credit names count 0 events. The limit is a top-k, not a global sort.
    """
    limit, offset = checked_page(limit, offset)
    rows = accounts
    if checked_role(role) is not None:
        rows = rows.where(F.col("role") == role)
    if text:
        rows = rows.where(matches_any(text, ["name"]))
    n = credits.select("account_id", "event_id").distinct().groupBy("account_id").agg(F.count("*").alias("_n"))
    counted = rows.join(n, "account_id", "left").withColumn("n_events", F.coalesce("_n", F.lit(0))).drop("_n")
    return counted.where(F.col("n_events") >= least).orderBy(F.desc("n_events"), "account_id").offset(offset).limit(limit)


def listed(venues: DataFrame, counts: DataFrame, aliases: DataFrame, enough: int = 2, few: int = 1, unknown: str = "other") -> DataFrame:
    """Venues that a category page lists: in the metro, no alias, with `enough` events or `few` and a known kind."""
    rows = venues.join(aliases, "account_id", "left_anti").join(counts, "account_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    known = F.col("kind").isNotNull() & (F.col("kind") != unknown)
    return rows.where(F.col("in_metro") & ((F.col("n_events") >= enough) | ((F.col("n_events") >= few) & known)))


def stack_by_category(credits: DataFrame, categories: DataFrame, order: list[str]) -> DataFrame:
    """Per event its credits by category in a stated order: (event_id, categories as `category: account,account`).

    categories: role -> category. Roles without a category come last, under `other`.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
    rows = credits.join(F.broadcast(categories), "role", "left").withColumn("category", F.coalesce("category", F.lit("other"))).withColumn("_p", place)
    per = rows.groupBy("event_id", "_p", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_set("account_id")), lambda x: x.cast("string")), ",").alias("names"))
    lines = F.array_sort(F.collect_list(F.struct("_p", F.concat_ws(": ", "category", "names").alias("line"))))
    return per.groupBy("event_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("stack"))


def rail(credits: DataFrame, most: int, leave_out: int | None = None) -> DataFrame:
    """Per event the first `most` accounts by confirmations and how many more there are."""
    from kithgraph.operators.helpers import latest_rank

    rows = credits if leave_out is None else credits.where(F.col("account_id") != leave_out)
    ranked = latest_rank(rows, ["event_id"], [F.desc("n_confirmations"), F.col("account_id")])
    shown = F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "account_id"))))
    per = ranked.groupBy("event_id").agg(shown.alias("s"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return per.select("event_id", F.array_join(F.transform("s", lambda x: x["account_id"].cast("string")), ",").alias("rail"), "more")
