"""Which venue a location tag means, and which websites can be a venue's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.pages import SHELL_CHARS
from kithgraph.functions.text import host

# Endings that a name is also known without, and hosts of pages that only collect links.
ENDINGS = [" chicago il", " chicago", " il", " illinois", " hotel", " event venue", " events", " venue", " weddings", " wedding venue", ", chicago"]
LINK_HOSTS = [
    "lnk.bio", "linktr.ee", "beacons.ai", "bio.link", "campsite.bio", "milkshake.app", "taplink.cc", "solo.to", "linkin.bio", "allmylinks.com", "carrd.co", "msha.ke", "komi.io", "stan.store",
    "flowcode.com", "shorby.com", "withkoji.com", "later.com", "linkpop.com", "tap.bio",
]


def name_key(raw: Column) -> Column:
    """A name for comparison: lower case, without a leading 'the' and endings that say nothing, without punctuation."""
    plain = F.regexp_replace(F.lower(F.trim(raw)), "^the ", "")
    endings = "|".join(e.replace(" ", r"\s") for e in ENDINGS)
    bare = F.regexp_replace(plain, rf"(?:(?:{endings})\s*)+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[,.'’&\-()!]", ""), r"\s+", " "))


def tag_venues(posts: DataFrame, names: DataFrame, venues: DataFrame, aliases: DataFrame, generic: DataFrame, overrides: DataFrame, top: int) -> DataFrame:
    """(tag, posts, bucket, account_id, tier): what the `top` most frequent location tags mean.

    posts: location_tag; names: account_id, name (several names an account); venues: account_id; aliases: alias_id,
    canonical_id; generic: tag (places that are no venue, in any case); overrides: tag, account_id. A tag is looked up as
    it is, in any case, then by its key. Accounts stand for their canonical one. One venue among the accounts of that name is the
    answer (bucket confident), several are ambiguous, none is matched_not_venue, no name no_match. Where the names give no
    answer, an override does (tier hand_pass). Names are gathered to counts by key before they meet the tags, so a name
    that very many accounts share is one row. Null and empty tags and names are left out.
    """
    tags = posts.where("location_tag is not null and location_tag <> ''").groupBy(F.col("location_tag").alias("tag")).agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "tag").limit(top)
    whole = aliases.groupBy(F.col("alias_id").alias("account_id")).agg(F.min("canonical_id").alias("canonical"))
    to_whole = lambda df: df.join(whole, "account_id", "left").withColumn("account_id", F.coalesce("canonical", "account_id")).drop("canonical")
    named = to_whole(names.where("name is not null and trim(name) <> ''").select("account_id", "name"))
    named = named.join(venues.select("account_id").distinct().withColumn("is_venue", F.lit(True)), "account_id", "left")

    def by(key: Column, prefix: str) -> DataFrame:
        own = F.when(F.col("is_venue"), F.col("account_id"))
        rows = named.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min(own).alias(f"{prefix}_least"), F.max(own).alias(f"{prefix}_most"))
        return rows.withColumn(f"{prefix}_known", F.lit(True)).withColumnRenamed("key", f"{prefix}_key")

    rows = tags.withColumn("exact_key", F.lower(F.trim("tag"))).withColumn("key_key", name_key(F.col("tag")))
    rows = rows.join(by(F.lower(F.trim("name")), "exact"), "exact_key", "left").join(by(name_key(F.col("name")), "key"), "key_key", "left")
    rows = rows.join(generic.select(F.lower(F.trim("tag")).alias("exact_key")).distinct().withColumn("is_generic", F.lit(True)), "exact_key", "left")
    by_hand = to_whole(overrides.select("tag", "account_id")).groupBy("tag").agg(F.min("account_id").alias("by_hand"))
    rows = rows.join(by_hand, "tag", "left")
    tier = F.when(F.col("exact_known"), "exact").when(F.col("key_known"), "normalized")
    pick = lambda name: F.when(F.col("exact_known"), F.col(f"exact_{name}")).otherwise(F.col(f"key_{name}"))
    bucket = F.when(F.col("is_generic"), "generic").when(tier.isNull(), "no_match").when(pick("least").isNull(), "matched_not_venue").when(pick("least") != pick("most"), "ambiguous").otherwise("confident")
    rows = rows.withColumn("bucket", bucket).withColumn("found", F.when(bucket == "confident", pick("least")))
    return rows.select("tag", "posts", "bucket", F.coalesce("found", "by_hand").alias("account_id"), F.when(F.col("found").isNotNull(), tier).when(F.col("by_hand").isNotNull(), "hand_pass").alias("tier"))


def is_link_page(url: Column) -> Column:
    """Whether a URL lies on a host that only collects links, or on a host below it."""
    name = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [(name == h) | name.endswith("." + h) for h in LINK_HOSTS]), F.lit(False))


def website_status(probes: DataFrame) -> DataFrame:
    """(account_id, url, final_url, status, note): what a probe of each candidate website says.

    probes: account_id, url, final_url, http_status, content_type, n_chars (of the page's text). Pages that collect links are
    rejected, before and after redirection; no answer or a status of 400 and more is unreachable; what is no page of text
    is verified as it is; a page of fewer than 400 characters is a shell that a script fills.
    """
    answered = F.col("http_status").between(200, 399)
    page = F.coalesce(F.col("content_type").rlike("(?i)text/html") | (F.col("content_type") == ""), F.lit(True))
    status = (
        F.when(is_link_page(F.col("url")), "rejected").when(~F.coalesce(answered, F.lit(False)), "unreachable").when(is_link_page(F.col("final_url")), "rejected")
        .when(page & (F.coalesce("n_chars", F.lit(0)) < SHELL_CHARS), "js_shell").otherwise("verified")
    )
    note = (
        F.when(is_link_page(F.col("url")), "collects links").when(F.col("status") == "rejected", "redirects to a page that collects links")
        .when(F.col("status") == "unreachable", F.coalesce(F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("no answer"))).when((F.col("status") == "verified") & ~page, F.concat(F.lit("no page: "), F.col("content_type")))
    )
    return probes.withColumn("status", status).select("account_id", "url", F.when(F.col("status") != "unreachable", F.coalesce("final_url", "url")).alias("final_url"), "status", note.alias("note"))
