"""Queries of samples for review, sightings over a log, and functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import sql as Q
from kithgraph.operators import evaluate as V
from kithgraph.plans.text import LABEL_SQL, ROLE_SQL, captions
from kithgraph.registry import query
from kithgraph.session import checkpoint_path
from kithgraph.streaming import sightings as S
from kithgraph.tables import table

REVIEW_SQL = """r AS (SELECT doc_id AS post_id, CASE WHEN n_chars < 400 THEN 'EXCLUDE' WHEN n_chars < 900 THEN 'REVIEW' ELSE 'INCLUDE' END AS decision, least(n_chars / 2000.0::DOUBLE, 1.0) AS c, CASE WHEN n_chars < 400 THEN lang END AS reason FROM documents),
    e AS (SELECT coalesce(CASE WHEN n_chars < 400 THEN lang END, '(none)') AS reason, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1),
    d AS (SELECT DISTINCT doc_id AS post_id FROM documents JOIN benchmark ON item_id = doc_id),
    x AS (SELECT r.post_id, decision, c, d.post_id IS NOT NULL AS other, coalesce(n, 0) AS n, r.reason FROM r LEFT JOIN e ON e.reason = coalesce(r.reason, '(none)') LEFT JOIN d ON d.post_id = r.post_id WHERE r.post_id NOT IN (SELECT doc_id FROM labels)),
    s AS (SELECT post_id, reason, round(CASE WHEN other THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN decision = 'REVIEW' THEN 5.0::DOUBLE ELSE 0 END + (0.5::DOUBLE - least(abs(c - 0.5::DOUBLE), 0.5::DOUBLE)) * 6.0::DOUBLE + CASE WHEN n < 5 THEN (5 - n) * 0.8::DOUBLE ELSE 0 END, 6) AS score,
      concat_ws(',', CASE WHEN other THEN 'disagreement' END, CASE WHEN decision = 'REVIEW' THEN 'review' END, CASE WHEN abs(c - 0.5::DOUBLE) < 0.15::DOUBLE THEN 'boundary' END, CASE WHEN n < 5 THEN 'coverage' END) AS reasons FROM x)"""


def results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as results by their length, and the candidates for a review among them."""
    docs = table(spark, d, "documents")
    reason = F.when(F.col("n_chars") < 400, F.col("lang"))
    rows = docs.select(F.col("doc_id").alias("post_id"), F.when(F.col("n_chars") < 400, "EXCLUDE").when(F.col("n_chars") < 900, "REVIEW").otherwise("INCLUDE").alias("decision"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("confidence"), reason.alias("exclusion_reason"))
    labels = table(spark, d, "labels")
    examples = docs.join(labels.where("toxic = 1"), "doc_id").select(reason.alias("exclusion_reason"))
    other = table(spark, d, "benchmark").select(F.col("item_id").alias("post_id")).join(rows.select("post_id"), "post_id", "left_semi")
    return rows, V.review_candidates(rows, labels.select(F.col("doc_id").alias("post_id")), other, examples)


@query("evl04_review_candidates", f"WITH {REVIEW_SQL} SELECT post_id, score, reasons FROM s WHERE reasons <> ''")
def evl04_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents as results: what a person should look at, with the reasons."""
    return results(spark, d)[1]


@query(
    "evl04_weighted_sample",
    f"""WITH {REVIEW_SQL}, w AS (SELECT s.post_id, score, coalesce(lang, '') AS lang FROM s JOIN documents ON doc_id = s.post_id WHERE reasons <> ''),
    k AS (SELECT *, -ln((CAST('0x' || substr(md5('7:' || post_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / score AS draw FROM w WHERE score > 0)
    SELECT post_id, lang, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY draw, post_id) AS INTEGER) AS draw FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY draw, post_id) <= 15""",
)
def evl04_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen candidates of each language, drawn by their scores."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = results(spark, d)[1].join(lang, "post_id").select("post_id", "lang", "score")
    return V.weighted_sample(rows, "post_id", "lang", "score", 15, seed=7)


@query(
    "stm01_sightings",
    """WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id || ':' || event_type AS key, ts, event_id, sha256(props) AS digest FROM events),
    o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY ts, digest) = 1), f AS (SELECT key, min_by(run_id, (ts, run_id)) AS run_id, min_by(digest, (ts, run_id)) AS digest FROM o GROUP BY key)
    SELECT o.run_id, o.key, o.ts AS observed_at, o.digest, o.run_id = f.run_id AS is_first, o.digest <> f.digest AS changed FROM o JOIN f USING (key)""",
)
def stm01_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Days as runs that sight users' kinds of event; the first half of the days comes twice, in batches of its own."""
    rows = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("run_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("observed_at"), F.col("props").alias("content"))
    middle = rows.agg(F.expr("percentile_approx(unix_date(to_date(run_id)), 0.5)")).first()[0]
    early = F.unix_date(F.to_date("run_id")) <= F.lit(middle)
    path = f"{checkpoint_path(spark)}/sightings-{uuid.uuid4().hex}"
    for batch in (rows.where(early), rows.where(~early), rows.where(early)):
        S.record(batch, path)
    return S.log_of(spark, path)


@query("sql_credits", f"SELECT l_orderkey AS post_id, {LABEL_SQL} AS role_raw, 'part' || CAST(l_partkey AS VARCHAR) AS handle, {ROLE_SQL} AS role, count(*) AS n FROM lineitem GROUP BY ALL")
def sql_credits(spark: SparkSession, d: str) -> DataFrame:
    """The credits of all captions through a table function of SQL."""
    Q.register(spark)
    captions(spark, d).createOrReplaceTempView("kith_captions")
    return spark.sql("SELECT p.post_id, c.role_raw, c.handle, c.role, count(*) AS n FROM kith_captions p, LATERAL kith_credits(p.caption) c GROUP BY ALL")


@query("sql_urls", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\.)?', ''), '#.*$', ''), '/+($|\?)', '\1', 'g') AS key FROM pages")
def sql_urls(spark: SparkSession, d: str) -> DataFrame:
    Q.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("kith_pages")
    return spark.sql("SELECT page_id, kith_host(url) AS host, kith_url_key(url) AS key FROM kith_pages")
