"""The structural evidence of orders as posts, whole and of one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import structure as S
from kithgraph.registry import query
from kithgraph.tables import table


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as posts by suppliers: totals give the author, priorities the location, customers the caption."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey", "left")
    segment = F.col("c_mktsegment")
    caption = F.when(segment == "BUILDING", "Anna & Ben at their wedding").when(segment == "MACHINERY", "Lido Banquets & Events gala").when(segment == "FURNITURE", "Mr. & Mrs. Smith").when(segment == "HOUSEHOLD", "A birthday of the bride")
    return rows.select(F.col("o_orderkey").alias("post_id"), caption.alias("caption"), F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("tag"), F.col("c_nationkey").cast("string"))).alias("location_tag"), F.concat(F.lit("SUPPLIER"), F.floor(F.col("o_totalprice") / 20000).cast("string")).alias("owner"))


def evidence(spark: SparkSession, d: str, of: DataFrame) -> DataFrame:
    """Line items as entries of suppliers: flags and statuses give roles, sources and labels."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    role = F.when(flag == "N", F.when(F.col("l_quantity") > 25, "dj").otherwise("other")).otherwise("venue")
    source = F.when((flag == "R") & (status == "F"), "credit_line").when(flag == "R", "inline_at").otherwise("venue_hashtag")
    label = F.when(F.col("l_discount") > 0.07, "Reception").when(F.col("l_discount") > 0.04, "Ceremony Venue").when(F.col("l_discount") > 0.02, "Venue").otherwise("Place")
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("handle"), role.alias("role"), label.alias("role_raw"), source.alias("source"), F.col("l_shipdate").alias("extracted_at"))
    supplier, nation = table(spark, d, "supplier"), F.col("s_nationkey")
    accounts = supplier.select(F.col("s_suppkey").alias("account_id"), F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")).alias("username"), F.when(nation < 5, "venue").when(nation < 8, "florist").alias("category"), (F.col("s_acctbal") > 5000).alias("is_venue"))
    twins = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("canonical_id"), F.max("s_suppkey").alias("alias_id")).where("canonical_id < alias_id")
    locations = supplier.groupBy(nation.alias("n")).agg(F.min("s_suppkey").alias("account_id")).select(F.concat(F.lit("tag"), F.col("n").cast("string")).alias("location_tag"), "account_id")
    extracted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("post_id"), F.lit(1).cast("long").alias("account_id"))
    return S.structural_evidence(of, entries, accounts, twins.select("alias_id", "canonical_id"), locations, extracted)


PAIR = r"(Mr\.? *& *Mrs\.?|Couple: *@|Bride: *@|[A-Z][a-z]+ *(&|\+|and) *[A-Z][a-z]+)"
EVIDENCE_SQL = rf"""WITH u AS (SELECT o_orderkey AS p, CASE c_mktsegment WHEN 'BUILDING' THEN 'Anna & Ben at their wedding' WHEN 'MACHINERY' THEN 'Lido Banquets & Events gala' WHEN 'FURNITURE' THEN 'Mr. & Mrs. Smith' WHEN 'HOUSEHOLD' THEN 'A birthday of the bride' END AS cap,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'tag' || c_nationkey END AS tag, 'supplier' || CAST(floor(o_totalprice / 20000) AS BIGINT) AS owner, o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey {{0}}),
    le AS (SELECT l_orderkey AS p, l_linenumber AS n, l_suppkey AS a, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity > 25 THEN 'dj' ELSE 'other' END ELSE 'venue' END AS role, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'credit_line' WHEN l_returnflag = 'R' THEN 'inline_at' ELSE 'venue_hashtag' END AS src,
      CASE WHEN l_discount > 0.07 THEN 'Reception' WHEN l_discount > 0.04 THEN 'Ceremony Venue' WHEN l_discount > 0.02 THEN 'Venue' ELSE 'Place' END AS raw, l_shipdate FROM lineitem JOIN u ON u.p = l_orderkey JOIN supplier ON s_suppkey = l_suppkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey ORDER BY l_shipdate DESC, role, raw, src) = 1),
    al AS (SELECT min(s_suppkey) AS c, max(s_suppkey) AS x FROM supplier GROUP BY s_nationkey HAVING count(*) > 1), lo AS (SELECT 'tag' || s_nationkey AS tag, min(s_suppkey) AS a FROM supplier GROUP BY s_nationkey),
    s AS (SELECT p, a, 0 AS k, CASE raw WHEN 'Reception' THEN 0 WHEN 'Venue' THEN 1 WHEN 'Ceremony Venue' THEN 2 ELSE 3 END AS t, n, raw, src FROM le WHERE role = 'venue' AND src = 'credit_line' UNION ALL SELECT p, a, 1, 0, NULL, NULL, 'location_tag' FROM u JOIN lo USING (tag)
      UNION ALL SELECT p, s_suppkey, 2, 0, NULL, NULL, 'author' FROM u JOIN supplier ON owner = 'supplier' || s_suppkey WHERE s_nationkey < 5 OR (s_nationkey >= 8 AND s_acctbal > 5000) UNION ALL SELECT p, a, 3, 0, n, raw, src FROM le WHERE role = 'venue' AND src = 'inline_at'
      UNION ALL SELECT p, a, 4, 0, n, raw, src FROM le WHERE role = 'venue' AND src = 'venue_hashtag' UNION ALL SELECT p, 1, 5, 0, NULL, NULL, 'extracted' FROM u WHERE o_orderstatus = 'P'),
    w AS (SELECT s.* REPLACE (coalesce(c, a) AS a) FROM s LEFT JOIN al ON x = a), f AS (SELECT p, count(DISTINCT a) > 1 AS torn FROM w WHERE k = 0 GROUP BY p),
    one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY p ORDER BY k, t, coalesce(n, 0), a, raw) = 1),
    e AS (SELECT p, a, 'venue' AS role, raw, n, src, src = 'credit_line' AND coalesce(torn, false) AS conflict FROM one LEFT JOIN f USING (p) UNION ALL SELECT p, a, role, raw, n, NULL, NULL FROM le WHERE role NOT IN ('other', 'venue')),
    c AS (SELECT p, cap, nullif(regexp_extract(coalesce(cap, ''), '{PAIR}', 1), '') AS m FROM u)
    SELECT p AS post_id, a AS account_id, role, raw AS role_raw, n AS line_no, src AS anchor_source, conflict AS anchor_conflict, m IS NOT NULL AND m NOT LIKE 'Lido%' AND m NOT LIKE 'Banquets%' AS has_couple_signal, coalesce(regexp_matches(cap, '(?i)\b(wedding|bride|mr\.? *& *mrs)\b'), false) AS has_wedding_keyword,
      CASE WHEN m IS NOT NULL AND m NOT LIKE 'Lido%' AND m NOT LIKE 'Banquets%' THEN lower(m) END AS couple_guess, coalesce(regexp_matches(cap, '(?i)\b(birthday|gala)\b'), false) AS has_other_event FROM e JOIN c USING (p)"""


@query("ev05_structural_evidence", EVIDENCE_SQL.format(""))
def ev05_whole(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of all posts, from six sources of venues and the other credits."""
    return evidence(spark, d, posts(spark, d))


@query("ev06_evidence_of_batch", EVIDENCE_SQL.format("WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 40000 AND o_orderstatus <> 'F'"))
def ev06_batch(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of the posts that one batch was the first to observe; orders' priorities, totals and statuses say which."""
    o = table(spark, d, "orders")
    batch = F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_totalprice") > 40_000), "batch-1").otherwise("batch-2")
    seen = o.select(F.col("o_orderkey").alias("post_id"), batch.alias("batch_id"), (F.col("o_orderstatus") != "F").alias("is_first"))
    return evidence(spark, d, S.first_of_batch(posts(spark, d), seen, "batch-1"))
