"""Classification scores, gates and evaluation reports, sampling and review queues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that candidate scores look for.
WEDDING = r"(?i)(wedding|bride|groom|bridal|engage(?:ment|d)?|fianc|nuptial|newlywed|getting married|ceremon|reception|elope|walked? down the aisle|married|honeymoon)"
LOCAL = r"(?i)chicago|chi[- ]?town|windy city|illinois\b|, il\b|\bil,"
EDITORIAL = r"(?i)(styled shoot|editorial shoot|styled editorial|creative team|for this (styled|editorial)|submission|feature[d]? on|as seen on|publication|collaborat(ive|ion))"
PROMO = r"(?i)(now booking|booking (now|\d+)|link in bio|dm (us|me) to book|inquire (now|today)|now accepting|book your (date|wedding)|now scheduling|limited dates|availability for)"
ENGAGEMENT = r"(?i)(she said yes|he said yes|the (proposal|question)|surprise proposal|just got engaged|newly engaged|our engagement|proposed)"
#: What each signal adds to the score.
PER_ROLE, MOST_ROLES = 2, 5
WEIGHTS = {"photo_and_venue": 3, "planner_and_photo": 2, "wedding": 1, "local": 2, "editorial": -4, "promo": -3, "engagement": -2}
#: Borders of the calibration buckets.
BUCKETS = [0.0, 0.5, 0.7, 0.85, 0.95, 1.01]


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def candidate_score(roles: Column, caption: Column, location: Column | None = None) -> Column:
    """The score of a post from its distinct vendor roles (an array) and its texts."""
    place = F.coalesce(location, F.lit("")) if location is not None else F.lit("")
    distinct = F.array_distinct(F.filter(F.coalesce(roles, F.array().cast("array<string>")), lambda r: r.isNotNull()))
    has = lambda r: F.array_contains(distinct, r)
    flags = {
        "photo_and_venue": has("photographer") & has("venue"), "planner_and_photo": has("planner") & has("photographer"), "wedding": says(caption, WEDDING),
        "local": says(caption, LOCAL) | says(place, LOCAL), "editorial": says(caption, EDITORIAL), "promo": says(caption, PROMO), "engagement": says(caption, ENGAGEMENT),
    }
    out = PER_ROLE * F.least(F.size(distinct), F.lit(MOST_ROLES))
    for name, flag in flags.items():
        out = out + F.when(flag, WEIGHTS[name]).otherwise(0)
    return out


#: Labels of credit lines that name a wedding trade, and destinations elsewhere.
TRADES = r"(?i)(photo|video|film|content creator|hair|makeup|hmu|florist|floral|bloom|flower|\bdj\b|\bband\b|musician|music|plan|venue|hotel|cater|cake|dessert|rental|decor|officiant|stationery|invitation|transport|limo|photobooth|jewel|\bring\b|dress|gown|\btux|bridal|attire|coordinat|design)"
DESTINATIONS = r"(?i)(santorini|greece|italy|tuscany|paris|france|mexico|cancun|tulum|riviera maya|jamaica|bahamas|dominican|hawaii|maui|kauai|oahu|napa|sonoma|miami|florida|new york city|\bnyc\b|manhattan|los angeles|california\b|malibu|colorado|aspen|vail|nashville|tennessee|charleston, south carolina|savannah, georgia|las vegas|denver|portugal|spain|bali|indonesia|thailand|dubai|morocco|scotland|ireland,|england,|london,(?!.*chicago)|costa rica|puerto rico)"


def prefilter(caption: Column, location: Column, credit_labels: Column, known_roles: Column, own_profile: Column) -> Column:
    """A confident exclusion with its reason, or null to ask further: not_wedding_related, destination_wedding, not_local."""
    labelled = F.exists(F.coalesce(credit_labels, F.array().cast("array<string>")), lambda x: x.rlike(TRADES))
    related = says(caption, WEDDING) | labelled | (F.coalesce(F.size(known_roles), F.lit(0)) > 0)
    away = says(location, DESTINATIONS) & ~says(location, LOCAL) & ~says(caption, LOCAL)
    return F.when(~related, "not_wedding_related").when(away & F.coalesce(own_profile, F.lit(False)), "destination_wedding").when(away, "not_local")


def escalation_band(spec: str | None) -> tuple[float, float] | None:
    """A band such as 0.5-0.8; none without a specification."""
    if not spec or not spec.strip():
        return None
    found = re.fullmatch(r"(\d*\.?\d+)-(\d*\.?\d+)", spec.strip())
    if not found:
        raise ValueError(f"not a band: {spec!r}")
    low, high = map(float, found.groups())
    if not (0 <= low <= high <= 1):
        raise ValueError(f"not a band within 0 and 1: {spec!r}")
    return low, high


def escalates(verdict: Column, confidence: Column, band: tuple[float, float] | None) -> Column:
    """Whether a result goes to the stronger tier: always if unsure, else within the band, ends included; never without a band."""
    if band is None:
        return F.lit(False)
    return F.coalesce((verdict == "UNSURE") | confidence.between(*band), F.lit(False))


def cascade(excluded: Column, cheap: Column, strong: Column) -> tuple[Column, Column]:
    """The decision of tiers and the tier that made it: a rule's exclusion, then the cheap model's, else the strong model's."""
    decision = F.when(excluded.isNotNull(), "EXCLUDE").when(cheap == "EXCLUDE", "EXCLUDE").otherwise(F.coalesce(strong, cheap))
    tier = F.when(excluded.isNotNull(), "deterministic").when((cheap == "EXCLUDE") | strong.isNull(), "cheap").otherwise("strong")
    return decision, tier


def creation(confidence: Column, styled: Column) -> Column:
    """What to do with an eligible candidate by its match's confidence; styled ones go to people."""
    return F.when(styled.isin("CONFIRMED", "LIKELY"), "HUMAN").when(confidence >= 0.7, "WOULD_ATTACH").when(confidence >= 0.5, "CREATE_WEAK_MATCH").otherwise("CREATE")


def confusion(rows: DataFrame) -> DataFrame:
    """(expected, actual, n) of rows with both."""
    return rows.where("expected is not null and actual is not null").groupBy("expected", "actual").agg(F.count("*").alias("n"))


def quality(rows: DataFrame, positive: str = "INCLUDE") -> DataFrame:
    """One row: n, precision, recall and F1 of the positive class; null where undefined."""
    e, a = F.col("expected") == positive, F.col("actual") == positive
    n = rows.where("expected is not null and actual is not null").agg(F.count("*").alias("n"), F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("n", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def per_class(rows: DataFrame) -> DataFrame:
    """Precision and recall per class, from the confusion counts: one aggregate over two sides."""
    n = confusion(rows)
    sides = n.select(F.explode(F.array(F.struct(F.col("expected").alias("c"), F.col("n").alias("e"), F.lit(0).cast("long").alias("a")), F.struct(F.col("actual").alias("c"), F.lit(0).cast("long").alias("e"), F.col("n").alias("a")))).alias("s"), F.when(F.col("expected") == F.col("actual"), F.col("n")).otherwise(0).alias("ok"))
    per = sides.groupBy(F.col("s.c").alias("class")).agg(F.sum("s.e").alias("expected"), F.sum("s.a").alias("predicted"), (F.sum("ok") / 2).cast("long").alias("correct"))
    return per.select("class", "expected", "predicted", "correct", F.round(F.try_divide("correct", "predicted"), 6).alias("precision"), F.round(F.try_divide("correct", "expected"), 6).alias("recall"))


def calibration(rows: DataFrame) -> DataFrame:
    """Per bucket of confidence how many results there are and how many are right."""
    bucket = F.when(F.col("confidence").isNull(), F.lit(None).cast("string"))
    for low, high in zip(BUCKETS, BUCKETS[1:], strict=False):
        bucket = bucket.when((F.col("confidence") >= low) & (F.col("confidence") < high), f"{low:.2f}-{high:.2f}")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def agreement(rows: DataFrame, by: str, top: int = 10) -> DataFrame:
    """Reviewers' agreement per value of a column, the most frequent values first."""
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    return per.orderBy(F.desc("n"), by).limit(top).select(by, "n", "same", F.round(F.col("same") / F.col("n"), 6).alias("share"))


def account_errors(rows: DataFrame, least: int) -> DataFrame:
    """Per account the share of posts included, for accounts of at least `least` posts, and whether it contradicts itself."""
    per = rows.groupBy("account_id").agg(F.count("*").alias("posts"), F.count_if(F.col("decision") == "INCLUDE").alias("included"))
    share = F.col("included") / F.col("posts")
    return per.where(F.col("posts") >= least).select("account_id", "posts", "included", F.round(share, 6).alias("rate"), share.between(0.2, 0.8).alias("mixed"))


def information_value(confidence: Column, disagrees: Column, reach: Column) -> Column:
    """How much a label of a row would tell: doubt, disagreement of sources, and reach on a log scale."""
    return F.round((1 - F.abs(confidence * 2 - 1)) + F.when(disagrees, 1.0).otherwise(0.0) + F.log10(1 + F.coalesce(reach, F.lit(0))) / 10, 6)


#: What makes a result worth a look: points and bounds.
DISAGREEMENT_POINTS, REVIEW_POINTS, DOUBT_POINTS, NEAR_BOUNDARY, FEW_EXAMPLES, EXAMPLE_POINTS = 10.0, 5.0, 6.0, 0.15, 5, 0.8


def review_candidates(results: DataFrame, labelled: DataFrame, disagreeing: DataFrame, examples: DataFrame) -> DataFrame:
    """(post_id, score, reasons): results that a person's look would teach most of, those with a reason only.

    results: post_id, decision, confidence, exclusion_reason, one row each; labelled and disagreeing: post_id; examples:
    exclusion_reason, a row for each labelled example. Sources that disagree, the classifier's own REVIEW, confidence near
    0.5, and exclusion reasons with fewer than five examples. Labelled posts are left out; a null reason is a reason of its
    own; a null confidence tells nothing.
    """
    per = examples.groupBy(F.coalesce("exclusion_reason", F.lit("(none)")).alias("reason")).agg(F.count("*").alias("n"))
    rows = results.join(labelled.select("post_id").distinct(), "post_id", "left_anti").join(disagreeing.select("post_id").distinct().withColumn("other", F.lit(True)), "post_id", "left")
    rows = rows.withColumn("reason", F.coalesce("exclusion_reason", F.lit("(none)"))).join(per, "reason", "left")
    away, n = F.abs(F.col("confidence") - 0.5), F.coalesce("n", F.lit(0))
    score = F.when(F.col("other"), DISAGREEMENT_POINTS).otherwise(0.0) + F.when(F.col("decision") == "REVIEW", REVIEW_POINTS).otherwise(0.0)
    score = score + F.coalesce((0.5 - F.least(away, F.lit(0.5))) * DOUBT_POINTS, F.lit(0.0)) + F.when(n < FEW_EXAMPLES, (FEW_EXAMPLES - n) * EXAMPLE_POINTS).otherwise(0.0)
    why = F.concat_ws(",", F.when(F.col("other"), "disagreement"), F.when(F.col("decision") == "REVIEW", "review"), F.when(away < NEAR_BOUNDARY, "boundary"), F.when(n < FEW_EXAMPLES, "coverage"))
    return rows.select("post_id", F.round(score, 6).alias("score"), why.alias("reasons")).where("reasons <> ''")


def weighted_sample(rows: DataFrame, key: str, stratum: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum drawn without replacement by weight, the same on every run: rows with their `draw` from 1.

    Each row's key is -ln(u) / weight with u from the MD5 of seed and key; the least keys are the sample. Every task keeps its
    own n least of each stratum before rows are moved, so neither a large stratum nor the whole is sorted. Rows with a
    null, zero or negative weight are never drawn; a null stratum is one; equal keys are drawn in the order of the key column.
    """
    from kithgraph.operators.helpers import latest_rank

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = rows.where(F.col(weight) > 0).withColumn("_draw", -F.log(u) / F.col(weight))
    return latest_rank(drawn, [stratum], [F.col("_draw"), F.col(key)]).where(F.col("rn") <= n).drop("_draw").withColumnRenamed("rn", "draw")


def labelling_queue(buckets: list[tuple[str, DataFrame]], sizes: dict[str, int]) -> DataFrame:
    """A frozen queue: of each bucket the first rows by hash; a post in several buckets stays in the first; ranked by hash."""
    from kithgraph.operators.helpers import latest_rank, priority_pick

    one = priority_pick([df.select("post_id", F.lit(name).alias("bucket")) for name, df in buckets], ["post_id"], [F.col("bucket")])
    size = F.coalesce(*[F.when(F.col("bucket") == n, s) for n, s in sizes.items()], F.lit(0))
    kept = latest_rank(one, ["bucket"], [F.md5(F.col("post_id").cast("string")), F.col("post_id")]).where(F.col("rn") <= size)
    return kept.select("post_id", "bucket", F.md5(F.concat(F.lit("queue:"), F.col("post_id").cast("string"))).alias("rank_key"))


def next_to_label(queue: DataFrame, labels: DataFrame, reviewer: str, n: int) -> DataFrame:
    """The next rows of a queue that a reviewer has not labelled."""
    return queue.join(labels.where(F.col("labeled_by") == reviewer), "post_id", "left_anti").orderBy("rank_key", "post_id").limit(n)


def unchanged(inputs: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Inputs whose hash a version has not seen yet."""
    return inputs.join(runs.where(F.col("version") == version).select("post_id", "input_hash"), ["post_id", "input_hash"], "left_anti")
