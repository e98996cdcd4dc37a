"""Steering acquisition: priors, qualification, ranking, realized yield, crossings, strategy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.helpers import bands

#: The weight of a prior in posts, and roles' priors per post.
PRIOR_WEIGHT = 25
ROLE_PRIORS = {"planner": 0.41, "dj": 0.42, "catering": 0.36, "florist": 0.31, "officiant": 0.36, "photo_booth": 0.26, "photographer": 0.23, "videographer": 0.21}
OTHER_PRIOR = 0.2
#: What a venue's features add to its prior.
BASE, FLOOR = 0.08, 0.01
TYPES = {"farm_estate": 0.04, "event_space": 0.04, "park_outdoor": 0.04, "museum": 0.04, "other": -0.04}
NO_TYPE, NO_FOLLOWERS = 0.03, 0.01
FOLLOWERS = [(50, -0.03), (150, -0.01), (400, 0.04), (5_000, 0.05), (20_000, -0.04)]
MANY_FOLLOWERS = -0.07
PLACES = {"event_venue": 0.03, "wedding_venue": 0.03, "banquet_hall": 0.03, "hotel": -0.06}
#: Places elsewhere, and landmarks here whose names hold such a place.
ELSEWHERE = r"(?i)\b(scottsdale|arizona|phoenix|panam[áa]|miami|florida|texas|austin|dallas|houston|nashville|denver|atlanta|boston|brooklyn|new york|nyc|california|los angeles|san diego|seattle|portland|maui|hawaii|fiji|anguilla|sorrento|italy|london|paris|toronto|vegas|charleston|savannah|milwaukee|wisconsin|indiana|michigan)\b"
LANDMARKS = r"(?i)\b(lake\s+michigan|michigan\s+(ave|avenue|av)\b|n(orth)?\s+michigan\s+ave|indiana\s+(ave|avenue)\b|new\s+york\s+st(reet)?\b)"
WORSHIP = r"(?i)\b(parish|church|cathedral|chapel|synagogue|mosque)\b"
TRADE = r"(?i)(photo|films?$|floral|flowers|makeup|hair|dj$|cater)"
UMBRELLA = r"(?i)(group|hospitality|collection|talent)$"
HERE = r"(?i)chicago|illinois|\bil\b"


def venue_prior(kind: Column, followers: Column, reviews: Column, place: Column) -> Column:
    """The expected events per post of a venue's feed, before it is measured; three decimals, FLOOR at least."""
    of_kind = F.when(kind.isNull(), NO_TYPE)
    for name, add in TYPES.items():
        of_kind = of_kind.when(kind == name, add)
    of_followers = F.when(followers.isNull(), NO_FOLLOWERS)
    for below, add in FOLLOWERS:
        of_followers = of_followers.when(followers < below, add)
    of_reviews = F.when(reviews.between(50, 1000), 0.02).when(reviews > 1000, -0.04).otherwise(0.0)
    of_place = F.when(place.isNull(), 0.0)
    for name, add in PLACES.items():
        of_place = of_place.when(place == name, add)
    total = F.lit(BASE) + of_kind.otherwise(0.0) + of_followers.otherwise(MANY_FOLLOWERS) + of_reviews + of_place.otherwise(0.0)
    return F.greatest(F.lit(FLOOR), F.round(total, 3))


def vendor_prior(role: Column, own: Column) -> Column:
    """A role's prior, averaged with the vendor's own yield where there is one."""
    base = F.when(role.isNull(), OTHER_PRIOR)
    for name, p in ROLE_PRIORS.items():
        base = base.when(role == name, p)
    base = base.otherwise(OTHER_PRIOR)
    return F.when(own.isNull(), base).otherwise(F.round((base + own) / 2, 3))


def updated_prior(prior: Column, events: Column, fetched: Column) -> Column:
    """The prior shrunk towards what was found; unchanged if nothing was fetched."""
    return F.when(fetched > 0, (PRIOR_WEIGHT * prior + events) / (PRIOR_WEIGHT + fetched)).otherwise(prior)


def status(fetched: Column, stacks: Column, candidates: Column) -> Column:
    """dead, promising or ambiguous."""
    none = (fetched >= 20) & (stacks == 0) & (candidates == 0)
    return F.when(none, "dead").when((fetched > 0) & ((stacks + candidates) / fetched >= 1 / 25), "promising").otherwise("ambiguous")


def disqualified(username: Column, text: Column, in_metro: Column) -> Column:
    """Why an account should not be crawled as a venue, by ordered rules; null if it may."""
    text = F.coalesce(text, F.lit(""))
    away = F.regexp_replace(text, LANDMARKS, " ").rlike(ELSEWHERE)
    return (
        F.when(username.rlike(UMBRELLA), "umbrella_brand").when(username.rlike(TRADE), "non_venue_trade").when(text.rlike(WORSHIP), "house_of_worship")
        .when(away, "out_of_area").when(F.coalesce(in_metro, F.lit(False)), F.lit(None).cast("string")).when(username.rlike(HERE) | text.rlike(HERE), F.lit(None).cast("string")).otherwise("no_local_evidence")
    )


def disqualified_vendor(text: Column) -> Column:
    """For vendors only a place elsewhere counts."""
    return F.when(F.regexp_replace(F.coalesce(text, F.lit("")), LANDMARKS, " ").rlike(ELSEWHERE), "out_of_area")


def ranked(targets: DataFrame, regime: str = "plain", limit: int = 100) -> DataFrame:
    """The best targets of a tier: plain by prior, `crossing` by nearness to the next band, `thin` by thin venues nearby. A top-k."""
    orders = {
        "plain": [F.desc("prior"), F.desc("n_events"), F.desc_nulls_last("followers"), F.col("account_id")],
        "crossing": [F.desc("n_events"), F.desc("prior"), F.desc_nulls_last("followers"), F.col("account_id")],
        "thin": [F.desc_nulls_last("near_cross"), F.desc_nulls_last("thin_venues"), F.desc("prior"), F.col("account_id")],
    }
    if regime not in orders:
        raise ValueError(f"no such regime: {regime}")
    rows = targets.where(F.col("n_events").between(1, 5)) if regime == "crossing" else targets
    return rows.orderBy(*orders[regime]).limit(limit)


def next_batch(frontier: DataFrame, hops: int, size: int) -> DataFrame:
    """The accounts to crawl next: pending, within the hops, by hops, priority and name."""
    return frontier.where((F.col("status") == "pending") & (F.col("hops") <= hops)).orderBy("hops", F.desc("priority"), "username").limit(size)


def expanded(credits: DataFrame, hops: int) -> DataFrame:
    """What newly credited accounts add to the frontier: priority and status by role; an account keeps its highest priority."""
    role = F.col("role")
    priority = F.when(role.isin("venue", "hotel"), 0.8).when(role.isin("planner", "photographer", "videographer"), 0.35).otherwise(0.1)
    rows = credits.select("account_id", priority.alias("priority")).groupBy("account_id").agg(F.max("priority").alias("priority"))
    return rows.select("account_id", F.lit(hops + 1).alias("hops"), "priority", F.when(F.col("priority") > 0.1, "pending").otherwise("skipped").alias("status"))


def coverage_band(n: Column) -> Column:
    return bands(n, [0, 5, 15, 49], ["0", "1-5", "6-15", "16-49", "50+"])


def crossings(baseline: DataFrame, created: DataFrame) -> DataFrame:
    """Venues that an arm's events lifted from 0 to 1 or more, or from 1-5 to 6 or more: (arm, venue_id, crossing, from, to).

    baseline: venue_id, n without any compared arm. created: arm, venue_id, n.
    """
    base = baseline.select("venue_id", F.col("n").alias("_b"))
    rows = created.where("n > 0").join(base, "venue_id", "left").withColumn("from_n", F.coalesce("_b", F.lit(0))).withColumn("to_n", F.coalesce("_b", F.lit(0)) + F.col("n"))
    kind = F.when(F.col("from_n") == 0, "0_to_1").when(F.col("from_n").between(1, 5) & (F.col("to_n") >= 6), "1_5_to_6")
    return rows.withColumn("crossing", kind).where("crossing is not null").select("arm", "venue_id", "crossing", "from_n", "to_n")


def strategy_yield(first_seen: DataFrame, truth: DataFrame, costs: DataFrame) -> DataFrame:
    """Posts, labels by tier, events per post and per unit of cost for each batch. first_seen: batch_id, post_id."""
    rows = first_seen.join(truth, "post_id").groupBy("batch_id").agg(
        F.count("*").alias("posts"), F.count_if((F.col("tier") == "gold") & (F.col("label") == "wedding")).alias("gold_w"), F.count_if((F.col("tier") == "gold") & (F.col("label") == "not_wedding")).alias("gold_nw"),
        F.count_if((F.col("tier") == "silver") & (F.col("label") == "wedding")).alias("silver_w"), F.count_if(F.col("tier") == "bronze").alias("bronze_w"), F.count_if(F.col("label") == "unknown").alias("unknown"),
    )
    w = F.col("gold_w") + F.col("silver_w")
    return rows.join(costs, "batch_id", "left").select(*rows.columns, F.round(w / F.col("posts"), 6).alias("per_post"), F.round(F.try_divide(w, F.nullif("cost", F.lit(0.0))), 6).alias("per_cost"))


def funnel(targets: DataFrame) -> DataFrame:
    """Per tier how many targets there were, were crawled, gave posts, stacks and events."""
    return targets.groupBy("tier").agg(F.count("*").alias("targets"), F.count_if("crawled").alias("crawled"), F.count_if(F.col("posts") > 0).alias("with_posts"), F.count_if(F.col("stacks") > 0).alias("with_stacks"), F.count_if(F.col("events") > 0).alias("with_events"))
