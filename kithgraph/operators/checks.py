"""Checks and labels by rule: results, enums, identities, titles, guest ranges, readiness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.operators.documents import OTHER_EVENT
from kithgraph.session import ensure_checkpoints

# Fixed values.
DECISIONS = ["INCLUDE", "EXCLUDE", "REVIEW"]
TIERS = ["prefilter", "cheap", "strong"]
HUMAN_LABELS = {"WEDDING": "INCLUDE", "NOT_WEDDING": "EXCLUDE", "UNSURE": "REVIEW"}
OLD_ROLES = {
    "venue": "venue", "planner": "planner", "photographer": "photographer", "videographer": "videographer",
    "florist": "florist", "hair": "hair", "makeup": "makeup", "dj": "dj", "band": "band", "musician": "live_music",
    "attire": "attire", "stationery": "stationery", "cake": "cake", "catering": "catering", "rentals": "rentals",
    "transportation": "transportation", "photobooth": "photo_booth", "officiant": "officiant", "hotel": "accommodations",
    "jeweler": "jewelry", "content_creator": "content_creator", "beauty_other": "beauty_services", "other": "other",
}
OTHER_TITLE = (
    r"(?i)(baby|bridal|wedding) shower|birthday|quincea|sweet 16|corporate|gala|retirement|anniversary party|bar mitzvah"
    r"|bat mitzvah|graduation|prom|networking|holiday party"
)
RECAP = r"(?i)wedding day|newlyweds|mr\.? (&|and) mrs|just married|tied the knot|said i do|our wedding|their wedding"
NAME_STOPS = ["the", "a", "an", "of", "or", "and", "for", "with", "per", "each", "min", "minimum", "package", "add", "ons", "on"]
SIMILAR_NAMES, LONGEST_TITLE = 0.6, 60
#: Names of a venue up to which they are compared in its row.
MOST_NAMES = 128
NAME = r"([A-Za-z][A-Za-z'’-]*)"
POSSESSIVE, BOTH_MRS, SURNAME = rf"(?i)\b{NAME}\s*(?:and|&|\+)\s*{NAME}'s\s+wedding\b", rf"(?i)\bMrs?\.?\s*(?:&|and)\s*Mrs\.?\s+{NAME}\b", r"\bthe\s+([A-Z][A-Za-z'’-]*)\s+wedding\b"
BY_X, BY_SIGN = rf"(?i)\b{NAME}\s+x\s+{NAME}\b", rf"(?i)\b{NAME}\s*(?:\+|&|and)\s*{NAME}\b"


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A value by a small table of constants; what it does not name gives the default, null without one."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, default)


def result_errors(decision: Column, tier: Column, confidence: Column, reason: Column, date: Column, date_confidence: Column) -> Column:
    """What is wrong with a classifier's result, as a sorted array of names; empty for a valid one."""
    outside = lambda x: ~F.coalesce(x.between(0, 1), F.lit(False))
    tests = {
        "decision": ~F.coalesce(decision.isin(DECISIONS), F.lit(False)), "tier": ~F.coalesce(tier.isin(TIERS), F.lit(False)),
        "confidence": outside(confidence), "no_reason": (decision == "EXCLUDE") & (F.coalesce(reason, F.lit("")) == ""),
        "date_confidence": date_confidence.isNotNull() & outside(date_confidence), "no_date": date_confidence.isNotNull() & date.isNull(),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(tests[k], F.lit(False)), k) for k in sorted(tests)]))


def enum_errors(values: DataFrame, allowed: DataFrame) -> DataFrame:
    """Values (doc_id, field, value) that their field's list (field, value) does not hold; fields without a list are free."""
    known = allowed.select("field").distinct()
    return values.where("value is not null").join(known, "field", "left_semi").join(allowed, ["field", "value"], "left_anti")


def other_event_title(caption: Column) -> Column:
    """The first short line without a handle that names an event other than a wedding; null where the text recaps a wedding."""
    lines = F.transform(F.split(caption, "\n"), lambda x: F.trim(x))
    titles = F.filter(lines, lambda x: (x != "") & (F.char_length(x) <= LONGEST_TITLE) & ~F.contains(x, F.lit("@")) & x.rlike(OTHER_TITLE))
    return F.when(~caption.rlike(RECAP), F.get(titles, F.lit(0)))


def name_word(word: Column) -> Column:
    """A name as it is written: words all in one case get a capital."""
    one_case = (word == F.upper(word)) | (word == F.lower(word))
    return F.when(one_case, F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000)))).otherwise(word)


def couple_title(caption: Column, blocked: list[str]) -> Column:
    """The couple that a caption names, by the most specific pattern that gives names: a possessive wedding, Mr and Mrs, the
    surname wedding, two names with an x, two names with a sign. Words of `blocked` are no names."""
    text = F.trim(caption)
    is_name = lambda w: (F.char_length(w) >= 2) & ~F.lower(w).isin(blocked)

    def by(pattern: str, word: str, n: int, title: Callable[[Column], Column]) -> Column:
        found = F.transform(F.array(*[F.regexp_extract(text, pattern, i + 1) for i in range(n)]), lambda w: F.when(is_name(w), name_word(w)))
        return F.when(low.rlike(word), F.get(F.transform(F.array(found), title), F.lit(0)))

    # a name that is null makes the title null; the searches for a word only spare those for names
    low = F.lower(text)
    pair, surname = lambda p, w: by(p, w, 2, lambda x: F.concat(x[0], F.lit(" & "), x[1])), lambda p, w: by(p, w, 1, lambda x: F.concat(F.lit("The "), x[0]))
    return F.coalesce(pair(POSSESSIVE, "'s\\s+wedding"), surname(BOTH_MRS, "mrs"), surname(SURNAME, "\\swedding"), pair(BY_X, "\\sx\\s"), pair(BY_SIGN, "and|[&+]"))


def identity_bucket(is_alias: Column, blocked: Column, umbrella: Column, events: Column, located: Column, in_metro: Column, venue_role: Column, status: Column, known: Column, fetched: Column) -> Column:
    """Why a venue is not listed; the first rule that holds wins."""
    none = events == 0
    return (
        F.when(is_alias, "merged_away").when(blocked, "not_a_venue").when(none & umbrella, "chain_brand")
        .when(~none & ~(located & in_metro), "geo_blocked").when(~none & ~venue_role, "mis_anchored").when(~none, "merged_away")
        .when(status == "dead", "dead_feed").when(known & (fetched == 0), "never_crawled").otherwise("no_identity")
    )


def guest_range(venues: DataFrame, capacities: DataFrame, headlines: DataFrame) -> DataFrame:
    """Least and most guests: stated values, else the least minimum of a layout and the headline.

    venues: venue_id, min_status, min_guests, max_guests (null if not stated); capacities: venue_id, condition, min, max;
    headlines: venue_id, headline, cocktail_only. A conflicting minimum is unknown. A stated maximum that is the figure of
    another kind of event, while the headline is lower, gives way to the headline.
    """
    other = F.coalesce(F.col("condition").rlike(OTHER_EVENT), F.lit(False))
    per = capacities.groupBy("venue_id").agg(F.min("min").alias("_least"), F.collect_set(F.when(other, F.col("max"))).alias("_other"))
    rows = venues.join(per, "venue_id", "left").join(headlines, "venue_id", "left")
    borrowed = F.coalesce(F.array_contains("_other", F.col("max_guests")) & (F.col("headline") < F.col("max_guests")), F.lit(False))
    stated = F.col("max_guests").isNotNull() & ~borrowed
    least = F.when(F.col("min_status") == "conflicting", F.lit(None)).when(F.col("min_status") == "stated", F.col("min_guests")).otherwise(F.col("_least"))
    measures = F.when(stated | F.coalesce("cocktail_only", F.lit(False)), "guests").otherwise("seated")
    return rows.select("venue_id", least.alias("min"), F.when(stated, F.col("max_guests")).otherwise(F.col("headline")).alias("max"), measures.alias("max_measures"))


def readiness(needs_review: Column, failures: Column, headline: Column, catering: Column, bar: Column, pricing: Column, verified: Column, paths: Column, has_estimate: Column) -> Column:
    """compare_ready, excellent (ready, and verified or with a priced path) or neither (null)."""
    ready = ~needs_review & (failures == 0) & headline.isNotNull() & (catering == "stated") & (bar == "stated") & (pricing == "stated")
    return F.when(ready & (verified | ((paths >= 1) & has_estimate)), "excellent").when(ready, "compare_ready")


def similar_names(names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """Pairs (venue_id, id_a, id_b) of a venue's add-ons whose names are one: equal or a prefix once normalised, or 0.6 of the
    lesser one's words in common. names: venue_id, id, name. Names move once, to their venue; those of a venue of at most `most` names
    are compared in its row. In larger ones names meet where one is what another begins with, or on a shared word, never all within a
    venue. An empty name begins all others. Null names are like no other.
    """
    ensure_checkpoints(names.sparkSession)
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"\(.*?\)", " "), r"[^a-z0-9]+", " "))
    words = F.array_distinct(F.filter(F.split("flat", " "), lambda t: (F.length(t) > 1) & ~t.isin(NAME_STOPS)))
    rows = names.where("venue_id is not null and id is not null and name is not null").select("venue_id", "id", flat.alias("flat")).repartition("venue_id")
    large = F.count("*").over(Window.partitionBy("venue_id")) > most
    venues = rows.withColumn("apart", F.when(large, F.struct("id", "flat"))).withColumn("words", F.when(F.col("apart").isNull(), words)).groupBy("venue_id", "apart").agg(F.collect_list(F.struct("id", "flat", "words")).alias("all"))
    shared, least = lambda a, b: F.size(F.array_intersect(a["words"], b["words"])), lambda a, b: F.least(F.size(a["words"]), F.size(b["words"]))
    begins = lambda a, b: F.startswith(a["flat"], b["flat"]) | F.startswith(b["flat"], a["flat"])
    alike = lambda a, b: (a["id"] < b["id"]) & (begins(a, b) | F.coalesce(F.try_divide(shared(a, b), least(a, b)) >= SIMILAR_NAMES, F.lit(False)))
    of = lambda a: F.transform(F.filter("all", lambda b: alike(a, b)), lambda b: F.struct(a["id"].alias("id_a"), b["id"].alias("id_b")))
    pairs = F.when(F.col("apart").isNull() & (F.size("all") > 1), F.array_distinct(F.flatten(F.transform("all", of))))
    found = venues.select("venue_id", "apart", pairs.alias("pairs")).where(F.col("apart").isNotNull() | (F.size("pairs") > 0)).checkpoint()
    out = found.where("apart is null").select("venue_id", F.inline("pairs"))
    rest = found.where("apart is not null").select("venue_id", "apart.*")
    return out if rest.isEmpty() else out.unionByName(similar_by_joins(rest.withColumn("words", words)))


def similar_by_joins(rows: DataFrame) -> DataFrame:
    """The same for venues of any size. rows: venue_id, id, flat, words."""
    side = lambda end: rows.select("venue_id", F.col("id").alias(f"id_{end}"), F.col("words").alias(f"words_{end}"))
    begins = rows.select("venue_id", F.col("id").alias("other"), F.explode(F.transform(F.sequence(F.lit(0), F.char_length("flat")), lambda n: F.substring(F.col("flat"), F.lit(1), n))).alias("flat"))
    prefix = rows.select("venue_id", "id", "flat").join(begins, ["venue_id", "flat"]).where("id <> other").select("venue_id", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    token = lambda end: side(end).withColumn("w", F.explode(f"words_{end}"))
    shared, least = F.size(F.array_intersect("words_a", "words_b")), F.least(F.size("words_a"), F.size("words_b"))
    met = token("a").join(token("b"), ["venue_id", "w"]).where("id_a < id_b").where(shared / least >= SIMILAR_NAMES)
    return prefix.unionByName(met.select("venue_id", "id_a", "id_b")).distinct()


def ship_report(attempts: DataFrame) -> DataFrame:
    """Per tier of the latest attempts: items, share for review, and what all their attempts cost, not the latest alone.

    attempts: item_id, attempt, tier, decision, cost.
    """
    per = attempts.groupBy("item_id").agg(F.max_by(F.struct("tier", "decision", "cost"), "attempt").alias("last"), F.sum("cost").alias("spent"), F.count("*").alias("tries"))
    return per.groupBy(F.col("last.tier").alias("tier")).agg(
        F.count("*").alias("items"), F.round(F.avg((F.col("last.decision") == "REVIEW").cast("double")), 6).alias("review_rate"),
        F.round(F.sum("last.cost"), 2).alias("latest_cost"), F.round(F.sum("spent"), 2).alias("true_cost"), F.sum("tries").alias("attempts"),
    )
