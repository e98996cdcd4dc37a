"""Roles of an event's accounts set right: ceremony and reception, hotels, differences of role sets, what protects an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What says that an event's venue is settled; the first two are people's words.
HUMAN, PROTECTION = ["human_verdict", "human_label"], ["human_verdict", "human_label", "structural_anchor", "extracted_anchor", "alias_account", "web_verified"]


def protections(facts: DataFrame) -> DataFrame:
    """(event_id, protected, by_human) of facts (event_id, fact): an event with any of the known facts is protected."""
    known = facts.where(F.col("fact").isin(PROTECTION))
    return known.groupBy("event_id").agg(F.lit(True).alias("protected"), F.bool_or(F.col("fact").isin(HUMAN)).alias("by_human"))


def ceremony_splits(credits: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:
    """(event_id, ceremony_id, reception_id, decision) of events with exactly one venue of the ceremony and another of the reception.

    credits: event_id, account_id, role, event_context; events: event_id, venue_id; facts: see protections. The venue moves to
    the reception's if it is the ceremony's now and no person has settled it (`move`); else it stays
    (`protected_ceremony_only`, `no_move_needed`). Several candidates on a side are no split. Repeated credits count once.
    """
    of = lambda context: F.when(F.col("event_context") == context, F.col("account_id"))
    sides = credits.where("role = 'venue'").groupBy("event_id").agg(*[f(of(c)).alias(f"{c}_{n}") for c in ("ceremony", "reception") for n, f in (("least", F.min), ("most", F.max))])
    one = sides.where("ceremony_least = ceremony_most and reception_least = reception_most and ceremony_least <> reception_least")
    rows = one.join(events.select("event_id", "venue_id"), "event_id", "left").join(protections(facts), "event_id", "left")
    decision = F.when(~F.col("venue_id").eqNullSafe(F.col("ceremony_least")), "no_move_needed").when(F.col("by_human"), "protected_ceremony_only").otherwise("move")
    return rows.select("event_id", F.col("ceremony_least").alias("ceremony_id"), F.col("reception_least").alias("reception_id"), decision.alias("decision"))


def hotel_role(account_id: Column, venue_id: Column) -> Column:
    """What an account credited as a hotel is: the event's venue, or where guests stay."""
    return F.when(account_id == venue_id, "venue").otherwise("accommodations")


def role_differences(existing: DataFrame, credits: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, account_id, to_insert, to_delete, unchanged): sorted roles of each account that the credits name on an event.

    existing and credits: event_id, account_id, role; events: event_id, venue_id. Roles of venues are never among them, but
    for `hotel`, which becomes venue or accommodations first. An account that the credits do not name on an event is left
    alone: not being mentioned takes nothing away. Null roles are none.
    """
    fixed = existing.join(events.select("event_id", "venue_id"), "event_id", "left")
    role = F.when(F.col("role") == "hotel", hotel_role(F.col("account_id"), F.col("venue_id"))).otherwise(F.col("role"))
    held = fixed.select("event_id", "account_id", role.alias("role")).where("role <> 'venue'").groupBy("event_id", "account_id").agg(F.collect_set("role").alias("held"))
    named = credits.where("role <> 'venue'").groupBy("event_id", "account_id").agg(F.collect_set("role").alias("named"))
    rows = named.join(held, ["event_id", "account_id"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    ordered = lambda c: F.array_sort(c)
    return rows.select("event_id", "account_id", ordered(F.array_except("named", "held")).alias("to_insert"), ordered(F.array_except("held", "named")).alias("to_delete"), ordered(F.array_intersect("held", "named")).alias("unchanged"))


def role_evidence(credits: DataFrame, events: DataFrame) -> DataFrame:
    """(account_id, role, n): events that credit an account with a role; for venues also those that it is the venue of."""
    credited = credits.select("event_id", "account_id", "role").distinct().select("account_id", "role")
    anchored = events.where("venue_id is not null").select(F.col("venue_id").alias("account_id"), F.lit("venue").alias("role"))
    known = credits.where("role = 'venue'").select("account_id").distinct()
    return credited.unionByName(anchored.join(known, "account_id", "left_semi")).groupBy("account_id", "role").agg(F.count("*").alias("n"))


def reader_agreement(readings: DataFrame, thresholds: list[float]) -> DataFrame:
    """(source, threshold, n, said, right, precision, recall): a reader's THIS_VENUE against people's, overall and by source.

    readings: human, model, confidence, source, one row each. `source` is (all) for the whole, (null) for none. Precision is of
    what the model says with at least the threshold's confidence, recall of what people say; null where there is none.
    """
    rows = readings.select(F.explode(F.array(F.lit("(all)"), F.coalesce("source", F.lit("(null)")))).alias("source"), "human", "model", "confidence")
    each = rows.select("source", "human", "model", "confidence", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    yes, said = F.col("human") == "THIS_VENUE", (F.col("model") == "THIS_VENUE") & (F.col("confidence") >= F.col("threshold"))
    per = each.groupBy("source", "threshold").agg(F.count("*").alias("n"), F.count_if(said).alias("said"), F.count_if(said & yes).alias("right"), F.count_if(yes).alias("true"))
    return per.select("source", "threshold", "n", "said", "right", F.round(F.try_divide("right", "said"), 6).alias("precision"), F.round(F.try_divide("right", "true"), 6).alias("recall"))


def attribution(readings: DataFrame, accounts: DataFrame) -> DataFrame:
    """(post_id, match): whether a reader that does not know the venue names it: handle_match, name_match, no_match, model_null.

    readings: post_id, venue_id, handle_guess, name_guess; accounts: account_id, username, name (several names an account). A
    handle counts if it is the venue's; a name if it is one of the venue's by its key.
    """
    from kithgraph.operators.locations import name_key

    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^@", "")
    of = accounts.groupBy(F.col("account_id").alias("venue_id")).agg(F.collect_set(F.lower("username")).alias("handles"), F.collect_set(name_key(F.col("name"))).alias("names"))
    rows = readings.join(of, "venue_id", "left")
    by_handle = F.coalesce(F.array_contains("handles", plain(F.col("handle_guess"))), F.lit(False))
    by_name = F.coalesce(F.array_contains("names", name_key(F.col("name_guess"))) & (name_key(F.col("name_guess")) != ""), F.lit(False))
    silent = (F.coalesce(F.trim("handle_guess"), F.lit("")) == "") & (F.coalesce(F.trim("name_guess"), F.lit("")) == "")
    return rows.select("post_id", F.when(silent, "model_null").when(by_handle, "handle_match").when(by_name, "name_match").otherwise("no_match").alias("match"))
