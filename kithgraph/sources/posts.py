"""Posts from scraped payloads and from two physical formats of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import handle


def known_count(n: Column) -> Column:
    """A count, null where the source hides it as a negative number."""
    return F.when(n >= 0, n)


def from_items(items: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """Scraper items (a JSON string `raw`) as post rows; items without a shortcode are left out, of repeated ones the first by raw text stays.

    The seed is the account whose name ends the input URL; the payload stays verbatim for later parsers.
    """
    at = lambda path: F.get_json_object("raw", path)
    ending = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(at("$.inputUrl"), F.lit("")), r"/+$", ""), r"([^/]+)$", 1))
    seed = F.when(ending.isin(*[s.lower() for s in seeds]), ending) if seeds else F.nullif(ending, F.lit(""))
    rows = items.select(
        at("$.shortCode").alias("shortcode"), at("$.url").alias("url"), handle(at("$.ownerUsername")).alias("owner"), at("$.caption").alias("caption"), at("$.timestamp").try_cast("timestamp").alias("posted_at"),
        known_count(at("$.likesCount").try_cast("int")).alias("likes_count"), known_count(at("$.commentsCount").try_cast("int")).alias("comments_count"),
        at("$.locationName").alias("location_tag"), at("$.type").alias("post_type"), seed.alias("seed_username"), F.sha2(F.coalesce(at("$.caption"), F.lit("")), 256).alias("caption_sha256"), "raw",
    ).where("shortcode is not null")
    return rows.groupBy("shortcode").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "shortcode"]), "raw").alias("x")).select("shortcode", "x.*")


def unified(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per post from two physical formats, as a union of disjoint branches through which filters push down.

    posts: url, staging_id, raw_format, raw, staging_raw, caption, posted_at, owner_id. A JSON null of a list is a SQL null.
    """

    def staged(payload: str, rows: DataFrame) -> DataFrame:
        v = F.parse_json(payload)
        at = lambda path, kind: F.try_variant_get(v, path, kind)
        return rows.select("url", at("$.caption_raw", "string").alias("caption"), at("$.post_timestamp", "string").try_cast("timestamp").alias("posted_at"), at("$.location_tag", "string").alias("location_tag"), F.lower(at("$.owner_username", "string")).alias("owner"), at("$.mentions", "array<string>").alias("mentions"), F.lit("staging").alias("corpus_source"))

    old = staged("raw", posts.where("staging_id is not null and raw_format = 'staging_v1'"))
    new = staged("staging_raw", posts.where("staging_id is not null and raw_format <> 'staging_v1'"))
    v = F.parse_json("raw")
    own = posts.where("staging_id is null").join(accounts.select(F.col("account_id").alias("owner_id"), "username"), "owner_id")
    public = own.select("url", "caption", "posted_at", F.try_variant_get(v, "$.locationName", "string").alias("location_tag"), F.lower("username").alias("owner"), F.coalesce(F.try_variant_get(v, "$.mentions", "array<string>"), F.array().cast("array<string>")).alias("mentions"), F.lit("public").alias("corpus_source"))
    return old.unionByName(new).unionByName(public)


def image_candidates(items: DataFrame, most: int = 5) -> DataFrame:
    """Image URLs of an item worth a look: none of videos, at most so many of a carousel, else the display image."""
    at = lambda path: F.get_json_object("raw", path)
    images = F.from_json(F.coalesce(at("$.images"), F.lit("[]")), "array<string>")
    chosen = F.when(F.lower(at("$.type")) == "video", F.array().cast("array<string>")).when(F.size(images) > 0, F.slice(images, 1, most)).otherwise(F.filter(F.array(at("$.displayUrl")), lambda x: x.isNotNull()))
    return items.select(at("$.shortCode").alias("shortcode"), chosen.alias("images"))
