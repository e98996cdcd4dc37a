"""Decision rules as column expressions: gates, audits, verdict writes, re-anchoring, tiers, attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other events, and the words that make one a wedding after all.
OTHER_EVENTS = r"(?i)\b(mitzvah|quincea|sweet\s*16|birthday|corporate|baby shower|bridal shower|graduation|anniversary party|retirement|gala|networking|fundraiser|holiday party|prom|conference|expo|trade show|open house)\b"
WEDDING_WORDS = r"(?i)\b(wedding|bride|groom|newlywed|married)\b"
#: Kinds of venues by the first key that the text has.
VENUE_KINDS = [("country_club", ["country club", "golf"]), ("hotel", ["hotel", "resort", "inn"]), ("museum", ["museum", "gallery of art"]), ("farm_estate", ["farm", "barn", "estate", "winery", "vineyard"]), ("park_outdoor", ["park", "garden", "conservatory", "beach"]), ("restaurant", ["restaurant", "steak", "tavern", "bistro"]), ("event_space", ["loft", "hall", "ballroom", "venue", "events", "gallery", "studio", "rooftop", "space", "warehouse", "banquet", "center", "club", "room", "house"])]
NOT_WEDDING_SURE, THIS_VENUE_SURE, ROUNDUP_VENUES = 0.9, 0.8, 3


def is_other_event(caption: Column) -> Column:
    """A caption that names another event and no wedding."""
    return F.coalesce(caption.rlike(OTHER_EVENTS) & ~caption.rlike(WEDDING_WORDS), F.lit(False))


def venue_kind(text: Column) -> Column:
    """The kind of a venue by ordered keys; each key counts in the text as it is and with blanks, dots and underscores out of both."""
    low = F.lower(text)
    squashed = F.regexp_replace(low, r"[\s._]", "")
    out = None
    for kind, keys in VENUE_KINDS:
        hit = None
        for k in keys:
            one = F.contains(low, F.lit(k)) | F.contains(squashed, F.lit(k.replace(" ", "")))
            hit = one if hit is None else hit | one
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def gate(decision: Column, own: Column, corrected: Column, status: Column, near: Column, included: Column) -> tuple[Column, Column]:
    """Whether a reviewed candidate becomes an event: (its venue or null, why not or null)."""
    venue = F.when(decision == "WRONG_VENUE", corrected).otherwise(own)
    why = (
        F.when((decision == "WRONG_VENUE") & corrected.isNull(), "wrong_venue_no_correction").when(venue.isNull(), "no_venue_account")
        .when(F.coalesce(included, F.lit(0)) == 0, "no_included_posts").when(~F.coalesce((status == "CONFIRMED") | near, F.lit(False)), "place_unconfirmed")
    )
    return F.when(why.isNull(), venue), why


def audit(posts: DataFrame, events: DataFrame) -> DataFrame:
    """keep, retire or human per event. posts: event_id, verdict, confidence, human_label; events: event_id, venues, has_couple, has_word."""
    sure = lambda v, least: (F.col("verdict") == v) & (F.coalesce("confidence", F.lit(0.0)) >= least)
    yes = F.coalesce(F.col("human_label") == "WEDDING", F.lit(False)) | F.coalesce(sure("THIS_VENUE", THIS_VENUE_SURE), F.lit(False))
    no = F.coalesce(F.col("human_label") == "NOT_WEDDING", F.lit(False)) | F.coalesce(sure("NOT_WEDDING", NOT_WEDDING_SURE), F.lit(False))
    per = posts.groupBy("event_id").agg(F.bool_or(yes).alias("y"), F.bool_and(no).alias("n"))
    roundup = (F.col("venues") >= ROUNDUP_VENUES) & ~F.col("has_couple") & ~F.col("has_word")
    return events.join(per, "event_id", "left").select("event_id", F.when(F.col("y"), "keep").when(F.col("n") | roundup, "retire").otherwise("human").alias("decision"))


def verdict_write(verdict: Column, confidence: Column, corrected: Column, resolved: Column, anchored: Column, least: float) -> tuple[Column, Column]:
    """The verdict that is written, or why none is. A correction to an alias of the anchored venue means that venue."""
    skip = F.when(verdict == "UNSURE", "unsure").when(confidence < least, "below_threshold").when((verdict == "OTHER_VENUE") & corrected.isNull(), "other_venue_no_handle").when((verdict == "OTHER_VENUE") & resolved.isNull(), "other_venue_unresolved")
    folded = F.when((verdict == "OTHER_VENUE") & (resolved == anchored), "THIS_VENUE").otherwise(verdict)
    return F.when(skip.isNull(), folded), skip


def reanchored(protected: Column, own_is_venue: Column, credits: Column, tags: Column, venues: Column) -> tuple[Column, Column]:
    """(rule, new venue or null): a protected anchor stays, a venue stays; else the sole other credit, else the sole tag, if it is a venue; else people decide.

    credits, tags, venues: arrays of account ids.
    """
    sole = lambda a: F.when(F.size(F.array_distinct(a)) == 1, F.element_at(a, 1))
    pick = F.when(F.size(F.array_distinct(credits)) == 1, sole(credits)).when(F.size(F.array_distinct(tags)) == 1, sole(tags))
    good = F.coalesce(F.array_contains(venues, pick), F.lit(False))
    rule = F.when(protected, "protected").when(own_is_venue, "insert_credit").when(good & sole(credits).isNotNull(), "other_venue_credit").when(good, "location_tag").otherwise("human_queue")
    return rule, F.when(rule.isin("other_venue_credit", "location_tag"), pick)


def lead_tier(handle_known: Column, handle_named: Column, name_known: Column, ambiguous: Column, near: Column) -> tuple[Column, Column]:
    """(tier, whether to write) of a discovered venue: A by its handle, B by its unique name, else a near miss of B, else C."""
    a = handle_known & handle_named
    b = name_known & ~ambiguous
    return F.when(a, "A").when(b | ambiguous | near, "B").otherwise("C"), a | b


def attribution(guess: Column, actual: Column, guessed_name: Column, names: Column, said: Column) -> Column:
    """handle_match, name_match, model_null or no_match. names: array of the venue's names, all as keys."""
    by_name = F.coalesce((guessed_name != "") & F.array_contains(names, guessed_name), F.lit(False))
    return F.when(F.coalesce(guess == actual, F.lit(False)), "handle_match").when(by_name, "name_match").when(~said, "model_null").otherwise("no_match")


def review_order(queue: DataFrame, limit: int) -> DataFrame:
    """The review queue by nine keys: place, coverage, verdict, anchor, styled signal, count, candidate, date, url."""
    from kithgraph.operators.helpers import bands

    keys: Sequence[Column] = [
        F.when(F.col("place") == "CONFIRMED", 0).when(F.col("place") == "AMBIGUOUS", 1).otherwise(2), F.coalesce(bands(F.col("n"), [0, 5, 15], ["0", "1", "2", "3"]), F.lit("0")),
        F.coalesce(F.col("verdict").isin("NOT_WEDDING", "UNSURE"), F.lit(False)), F.col("anchor") == "author", F.col("styled"), F.coalesce("n", F.lit(0)), F.col("candidate_id"), F.col("posted").asc_nulls_last(), F.col("url"),
    ]
    return queue.orderBy(*keys).limit(limit)
