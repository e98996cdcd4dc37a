"""Structural evidence of posts: one venue each, by the first source that names any, and the other credits; whole or of one batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.evidence import COUPLE
from kithgraph.operators.helpers import latest_by

# Labels of worship, words of businesses that look like couples, words of weddings and of other events.
WORSHIP = r"(?i)ceremony|church|parish|chapel|cathedral|temple|synagogue|mosque"
BUSINESS = (
    r"(?i)\b(Events|Event|Catering|Photography|Photo|Films|Film|Designs|Design|Florals|Floral|Flowers|Banquets|Banquet|Studio|Studios|Co|Company|Weddings|Wedding|Hall|Room|Bar|Grill|Rentals|Decor"
    r"|Beauty|Hair|Makeup|Music|Sound|Booth|Bridal|Boutique|Group|Team|Cakes|Bakery|Planning|Entertainment|Lounge|Rooftop|Club|Hotel|Venue)\b"
)
WEDDING = r"(?i)\b(wedding|bride|groom|reception|ceremony|newlywed|married|mr\.? *& *mrs|i do|tied the knot|big day|vows?)\b"
OTHER_EVENT = (
    r"(?i)\b(mitzvah|quincea|sweet\s*16|birthday|corporate|baby shower|bridal shower|graduation|anniversary party|retirement|gala|networking|fundraiser|holiday party|prom|conference|expo|trade show|open house)\b"
)
SOURCES = ["credit_line", "location_tag", "author", "inline_at", "venue_hashtag", "extracted"]


def label_tier(label: Column) -> Column:
    """Which of several credited venues anchors a post: the reception's, a plain venue, a ceremony's, others."""
    return F.when(label.rlike("(?i)reception"), 0).when(label.rlike("(?i)venue") & ~label.rlike(WORSHIP), 1).when(label.rlike(WORSHIP), 2).otherwise(3)


def captions_say(caption: Column) -> dict[str, Column]:
    """What a caption says: a couple (not two words of businesses) and its names, a wedding, another event."""
    raw = F.nullif(F.regexp_extract(F.coalesce(caption, F.lit("")), COUPLE, 1), F.lit(""))
    couple = raw.isNotNull() & ~raw.rlike(BUSINESS)
    says = lambda p: F.coalesce(caption.rlike(p), F.lit(False))
    return {"has_couple_signal": F.coalesce(couple, F.lit(False)), "has_wedding_keyword": says(WEDDING), "couple_guess": F.when(couple, F.lower(raw)), "has_other_event": says(OTHER_EVENT)}


def structural_evidence(posts: DataFrame, entries: DataFrame, accounts: DataFrame, aliases: DataFrame, locations: DataFrame, extracted: DataFrame) -> DataFrame:
    """(post_id, account_id, role, role_raw, line_no, anchor_source, anchor_conflict, and what the caption says) of posts.

    posts: post_id, caption, location_tag, owner; entries: post_id, line_no, handle, role, role_raw, source, extracted_at;
    accounts: account_id, username, category, is_venue; aliases: alias_id, canonical_id; locations: location_tag, account_id;
    extracted: post_id, account_id. The latest entry of a line and handle counts. A post's venue is that of the first source
    that names one: a labelled credit (by tier, line, account), its location tag, its author if a venue and of no other
    category, a mention, a hashtag, a reading. Venues stand for their canonical account. Several credited venues are a
    conflict. Other roles are evidence as they are; `other` is none. All sources are one union with one pick per post. Entries
    are cut to the posts before they are sorted, by the posts' ids alone, and dealt to twice the usual tasks.
    """
    tasks = 2 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = entries.repartition(tasks, "post_id").join(posts.select("post_id").hint("shuffle_hash"), "post_id", "left_semi")
    last = latest_by(mine, ["post_id", "line_no", "handle"], [F.desc("extracted_at"), F.col("role"), F.col("role_raw"), F.col("source")])
    known = accounts.select("account_id", F.lower("username").alias("handle"), "category", "is_venue")
    credited = last.join(known.select("handle", "account_id"), "handle")
    whole = aliases.groupBy(F.col("alias_id").alias("account_id")).agg(F.min("canonical_id").alias("canonical"))
    row = lambda df, source, tier=F.lit(0), line=F.lit(None).cast("int"), raw=F.lit(None).cast("string"): df.select("post_id", "account_id", F.lit(SOURCES.index(source)).alias("rank"), tier.alias("tier"), line.alias("line_no"), raw.alias("role_raw"), F.lit(source).alias("anchor_source"))
    credit, told = F.col("source") == "credit_line", ["credit_line", "inline_at", "venue_hashtag"]
    rank = F.when(credit, SOURCES.index("credit_line")).when(F.col("source") == "inline_at", SOURCES.index("inline_at")).otherwise(SOURCES.index("venue_hashtag"))
    venues = credited.where((F.col("role") == "venue") & F.col("source").isin(told))
    named = venues.select("post_id", "account_id", rank.alias("rank"), F.when(credit, label_tier(F.coalesce("role_raw", F.lit("")))).otherwise(0).alias("tier"), "line_no", "role_raw", F.col("source").alias("anchor_source"))
    own = posts.select("post_id", F.lower("owner").alias("handle")).join(known, "handle").where((F.coalesce("is_venue", F.lit(False)) | (F.col("category") == "venue")) & F.coalesce(F.col("category") == "venue", F.lit(True)))
    sources = [named, row(posts.select("post_id", "location_tag").join(locations, "location_tag"), "location_tag"), row(own, "author"), row(extracted.join(posts.select("post_id"), "post_id", "left_semi"), "extracted")]
    every = reduce(DataFrame.unionByName, sources).join(whole, "account_id", "left").withColumn("account_id", F.coalesce("canonical", "account_id")).drop("canonical")
    torn = every.where("anchor_source = 'credit_line'").groupBy("post_id").agg((F.min("account_id") != F.max("account_id")).alias("torn"))
    one = every.groupBy("post_id").agg(F.min(F.struct("rank", "tier", F.coalesce("line_no", F.lit(0)).alias("at"), "account_id", "line_no", "role_raw", "anchor_source")).alias("x")).select("post_id", "x.*").join(torn, "post_id", "left")
    conflict = (F.col("anchor_source") == "credit_line") & F.coalesce("torn", F.lit(False))
    anchor = one.select("post_id", "account_id", F.lit("venue").alias("role"), "role_raw", "line_no", "anchor_source", conflict.alias("anchor_conflict"))
    others = credited.where("role not in ('other', 'venue')").select("post_id", "account_id", "role", "role_raw", "line_no", F.lit(None).cast("string").alias("anchor_source"), F.lit(None).cast("boolean").alias("anchor_conflict"))
    said = posts.select("post_id", *[c.alias(n) for n, c in captions_say(F.col("caption")).items()])
    return anchor.unionByName(others).join(said, "post_id")


def first_of_batch(posts: DataFrame, observations: DataFrame, batch: str) -> DataFrame:
    """The posts that a batch was the first to observe. observations: post_id, batch_id, is_first. The cut comes before any
    parsing, so a batch costs what its own posts cost."""
    return posts.join(observations.where(F.col("is_first") & (F.col("batch_id") == batch)).select("post_id"), "post_id", "left_semi")
