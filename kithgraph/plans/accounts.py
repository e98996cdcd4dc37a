"""Queries about which accounts are one: parts as accounts, orders as posts, their lines as credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import aliases as A
from kithgraph.registry import query
from kithgraph.tables import table


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as accounts: name, brand and size make handles that differ by signs, edits and words only."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("events"))
    part = table(spark, d, "part").join(used, "p_partkey", "left")
    number = F.substring("p_brand", 7, 2)
    sign = F.when(F.col("p_type") == "PROMO", ".").when(F.col("p_type") == "SMALL", "").otherwise("_")
    return part.select(
        F.col("p_partkey").alias("id"), F.concat(F.regexp_replace("p_name", " ", ""), sign, number, F.lit("hall"), F.col("p_size").cast("string")).alias("username"),
        F.when(F.col("p_size") > 10, F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("full_name"),
        F.concat(F.lit("https://www."), F.regexp_replace("p_name", " ", "-"), F.lit("."), F.lower("p_type"), F.lit(".example.com/"), number, F.lit("?utm_source=x")).alias("url"), F.lit("A place").alias("biography"),
        F.when(F.col("p_retailprice") >= 950, F.col("p_retailprice").cast("long")).alias("followers"), (F.col("p_size") % 2 == 0).alias("scraped"),
        F.when(F.col("p_type") == "ECONOMY", "venue").when(F.col("p_brand") == "Brand#7", "florist").alias("category"), "events", F.coalesce(F.col("p_brand") != "Brand#3", F.lit(True)).alias("in_scope"),
    )


ACCOUNTS_SQL = """u AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY 1),
    a AS (SELECT p_partkey AS id, replace(p_name, ' ', '') || CASE p_type WHEN 'PROMO' THEN '.' WHEN 'SMALL' THEN '' ELSE '_' END || substr(p_brand, 7, 2) || 'hall' || p_size AS un, CASE WHEN p_size > 10 THEN p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size END AS fn,
      replace(p_name, ' ', '-') || '.' || lower(p_type) || '.example.com' AS host, replace(p_name, ' ', '-') || '.' || lower(p_type) || '.example.com/' || substr(p_brand, 7, 2) AS url, CASE WHEN p_retailprice >= 950 THEN CAST(trunc(p_retailprice) AS BIGINT) END AS fo, p_size % 2 = 0 AS sc,
      CASE WHEN p_type = 'ECONOMY' THEN 'venue' WHEN p_brand = 'Brand#7' THEN 'florist' END AS cat, coalesce(events, 0) AS ev, p_brand <> 'Brand#3' AS sp FROM part LEFT JOIN u ON k = p_partkey)"""


@query("er09_credited_pairs", "WITH x AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 2 AS n, l_partkey AS k FROM lineitem) SELECT a.k AS id_a, b.k AS id_b, count(DISTINCT a.o) AS posts FROM x a JOIN x b ON a.o = b.o AND a.n = b.n AND a.k < b.k GROUP BY 1, 2 HAVING count(DISTINCT a.o) >= 2")
def er09_credited(spark: SparkSession, d: str) -> DataFrame:
    """Parts that stand on one line of two orders at least; an order's odd and even items are its two lines."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), (F.col("l_linenumber") % 2).alias("line_id"), F.col("l_partkey").alias("account_id"))
    return A.supported_pairs(lines, 2)


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Credit lines, readings and known aliases: an order's two lines, its first and last part, parts of one price as aliases."""
    rows = table(spark, d, "lineitem")
    lines = rows.select(F.col("l_orderkey").alias("post_id"), (F.col("l_linenumber") % 2).alias("line_id"), F.col("l_partkey").alias("account_id"))
    ends = rows.groupBy(F.col("l_suppkey").alias("post_id"), F.month("l_shipdate").alias("m"), "l_returnflag").agg(F.min("l_partkey").alias("anchor_id"), F.max("l_partkey").alias("other"))
    names = accounts(spark, d).select(F.col("id").alias("other"), F.concat(F.lit(" @"), F.upper("username")).alias("guess"))
    readings = ends.join(names, "other").select(F.concat_ws(":", F.col("post_id").cast("string"), F.col("m").cast("string"), "l_returnflag").alias("post_id"), "anchor_id", "guess")
    twin = table(spark, d, "part").groupBy("p_name", "p_brand", "p_size").agg(F.min("p_partkey").alias("canonical_id"), F.max("p_partkey").alias("alias_id")).where("canonical_id < alias_id")
    return lines, readings, twin.select("alias_id", "canonical_id")


@query(
    "er09_alias_proposals",
    rf"""WITH {ACCOUNTS_SQL}, s AS (SELECT *, regexp_replace(coalesce(nullif(regexp_replace(regexp_replace(lower(un), '[^a-z0-9]', '', 'g'), '{A.FACILITY}', ''), ''), regexp_replace(lower(un), '[^a-z0-9]', '', 'g')), '{A.STEM_NOISE}', '', 'g') AS st, regexp_replace(lower(un), '[._]', '', 'g') AS pl FROM a),
    g AS (SELECT 'S1' AS code, id, st AS b FROM s WHERE sp AND length(st) >= 4 UNION ALL SELECT 'S2', id, lower(trim(fn)) FROM s WHERE sp AND length(trim(fn)) >= 4 UNION ALL SELECT 'S3', id, url FROM s WHERE sp UNION ALL SELECT 'S3b', id, host FROM s),
    gn AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY code, b) BETWEEN 2 AND 8),
    gp AS (SELECT x.id AS ia, y.id AS ib, x.code FROM gn x JOIN gn y ON x.code = y.code AND x.b = y.b AND x.id < y.id WHERE x.code <> 'S3b' OR (SELECT sp FROM a WHERE a.id = x.id) OR (SELECT sp FROM a WHERE a.id = y.id)),
    pc AS (SELECT x.id AS ia, y.id AS ib, CASE WHEN ends_with(x.un, '.') OR ends_with(y.un, '.') OR length(x.un) = length(x.pl) OR length(y.un) = length(y.pl) THEN 'S1b' ELSE 'S1c' END AS code FROM s x JOIN s y ON x.pl = y.pl AND x.id < y.id AND lower(x.un) <> lower(y.un) WHERE x.sp AND y.sp),
    e AS (SELECT least(x.id, y.id) AS ia, greatest(x.id, y.id) AS ib, 'S6' AS code FROM s x JOIN s y ON x.id <> y.id AND x.fo IS NULL AND NOT x.sc AND (y.fo IS NOT NULL OR y.ev >= 3) AND x.sp AND y.sp AND length(x.un) >= 8 AND length(y.un) >= 8 AND abs(length(x.un) - length(y.un)) <= 2 AND levenshtein(lower(x.un), lower(y.un)) BETWEEN 1 AND 2),
    l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 2 AS n, l_partkey AS k FROM lineitem JOIN a ON a.id = l_partkey WHERE sp),
    s5 AS (SELECT x.k AS ia, y.k AS ib, count(DISTINCT x.o) AS posts FROM l x JOIN l y ON x.o = y.o AND x.n = y.n AND x.k < y.k GROUP BY 1, 2 HAVING count(DISTINCT x.o) >= 2),
    r AS (SELECT l_suppkey AS o, month(l_shipdate) AS m, l_returnflag AS f, min(l_partkey) AS an, max(l_partkey) AS ot FROM lineitem GROUP BY ALL),
    rg AS (SELECT r.o, r.m, r.f, r.an, t.id AS ot FROM r JOIN s u ON u.id = r.ot JOIN s t ON lower(t.un) = lower(u.un) AND t.sp WHERE r.an <> t.id),
    s7 AS (SELECT least(an, ot) AS ia, greatest(an, ot) AS ib, count(DISTINCT (o, m, f)) AS posts FROM rg GROUP BY 1, 2 HAVING count(DISTINCT (o, m, f)) >= 2),
    al AS (SELECT ia, ib, code, 0 AS posts FROM gp UNION ALL SELECT *, 0 FROM pc UNION ALL SELECT DISTINCT *, 0 FROM e UNION ALL SELECT ia, ib, 'S5', posts FROM s5 UNION ALL SELECT ia, ib, 'S7', posts FROM s7),
    pr AS (SELECT ia, ib, list_sort(list(DISTINCT code)) AS codes, coalesce(max(posts) FILTER (WHERE code = 'S5'), 0) AS p5, coalesce(max(posts) FILTER (WHERE code = 'S7'), 0) AS p7 FROM al GROUP BY ALL),
    kn AS (SELECT min(p_partkey) AS c, max(p_partkey) AS x FROM part GROUP BY p_name, p_brand, p_size HAVING count(*) > 1),
    cm AS (SELECT x, min(c) AS c FROM kn GROUP BY x),
    j AS (SELECT pr.*, x.un AS ua, y.un AS ub, x.cat AS ca, y.cat AS cb, x.st AS sa, y.st AS sb, (NOT x.sc, x.fn IS NULL, -coalesce(x.fo, -1), lower(x.un), x.id) AS ra, (NOT y.sc, y.fn IS NULL, -coalesce(y.fo, -1), lower(y.un), y.id) AS rb
      FROM pr JOIN s x ON x.id = ia JOIN s y ON y.id = ib LEFT JOIN cm m ON m.x = ia LEFT JOIN cm n ON n.x = ib WHERE coalesce(m.c, ia) <> coalesce(n.c, ib) AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.c = pr.ia AND kn.x = pr.ib)),
    o AS (SELECT *, coalesce(ca <> 'venue', false) OR coalesce(cb <> 'venue', false) OR ua = 'redring_9hall9' AS outside, list_contains(codes, 'S3b') AS h, len(codes) >= 2 AS many,
      list_contains(codes, 'S6') AND (list_contains(codes, 'S1') OR list_contains(codes, 'S3b') OR (length(sa) >= 4 AND length(sb) >= 4 AND levenshtein(sa, sb) <= 1)) AS ed FROM j)
    SELECT ia AS id_a, ib AS id_b, array_to_string(codes, ',') AS signals, CASE WHEN outside THEN 'T3' WHEN list_contains(codes, 'S1b') OR (list_contains(codes, 'S2') AND coalesce(ca = 'venue' AND cb = 'venue', false)) OR (h AND many) THEN 'T1' WHEN many OR h OR p5 >= 5 OR ed OR p7 >= 3 THEN 'T2' ELSE 'T3' END AS tier,
      CASE WHEN ra <= rb THEN ib ELSE ia END AS alias_id, CASE WHEN ra <= rb THEN ia ELSE ib END AS canonical_id, CASE WHEN outside THEN 'related' ELSE 'proposal' END AS section FROM o""",
)
def er09_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Every signal over all parts and lines, with direction, tiers and what is never proposed."""
    lines, readings, known = inputs(spark, d)
    return A.proposals(accounts(spark, d), lines, readings, known, ["linktr.ee"], ["redring_9hall9"], [])
