"""Queries of entity resolution: orders stand in as events and candidates, suppliers as their members, customers as venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import entities as E
from kithgraph.registry import query
from kithgraph.tables import table

SETS_SQL = "s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1)"


def members(spark: SparkSession, d: str) -> DataFrame:
    """Orders as (id, block, date, members)."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("members"))
    return table(spark, d, "orders").join(sets, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("block"), F.to_date("o_orderdate").alias("date"), "members")


@query("er01_greedy_events")
def er01(spark: SparkSession, d: str) -> DataFrame:
    """Orders as posts of their customer, with the operator's own days and similarity: members of one customer only can be shared."""
    posts = members(spark, d)
    named = F.transform("members", lambda m: F.concat_ws(":", F.col("block").cast("string"), m.cast("string")))
    return E.greedy_events(posts.select("id", "date", named.alias("members")))


MATCH_SQL = f"""{SETS_SQL}, o AS (SELECT o_orderkey AS k, o_custkey AS b, CAST(o_orderdate AS DATE) AS dt FROM orders JOIN n ON n.k = o_orderkey),
    c AS (SELECT * FROM o WHERE k % 2 = 1), e AS (SELECT * FROM o WHERE k % 2 = 0),
    i AS (SELECT c.k AS c, e.k AS e, count(*) AS i FROM c JOIN e ON c.b = e.b JOIN s x ON x.k = c.k JOIN s y ON y.k = e.k AND x.v = y.v GROUP BY 1, 2),
    j AS (SELECT c.k AS c, e.k AS e, abs(date_diff('day', c.dt, e.dt)) AS days, coalesce(i.i, 0) / (x.n + y.n - coalesce(i.i, 0)) AS jac FROM c JOIN e ON c.b = e.b JOIN n x ON x.k = c.k JOIN n y ON y.k = e.k LEFT JOIN i ON i.c = c.k AND i.e = e.k),
    best AS (SELECT c.k AS c, j.e, j.days, j.jac FROM c LEFT JOIN (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY c ORDER BY jac DESC, e) = 1) j ON j.c = c.k)"""


@query("join16_best_match", f"WITH {MATCH_SQL} SELECT c AS candidate_id, e AS event_id, round(jac, 6) AS jaccard FROM best")
def join16(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d)
    return E.best_match(rows.where("id % 2 = 1"), rows.where("id % 2 = 0")).select("candidate_id", "event_id", F.round("jaccard", 6).alias("jaccard"))


@query(
    "er04_reconcile",
    f"""WITH {MATCH_SQL}, l AS (SELECT *, CASE WHEN e IS NULL THEN 'insufficient' WHEN days <= 14 AND jac > 0.5 THEN 'high' WHEN days <= 30 OR jac > 0.3 THEN 'ambiguous' ELSE 'insufficient' END AS level FROM best)
    SELECT c AS candidate_id, CASE WHEN level <> 'insufficient' THEN e END AS matched_event_id, level, CAST(CASE level WHEN 'high' THEN 0.8 WHEN 'ambiguous' THEN 0.4 ELSE 0.1 END AS DOUBLE) AS confidence, round(jac, 6) AS jaccard, days, e IS NOT NULL AS venue_match FROM l""",
)
def er04(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d)
    return E.reconciled(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))


@query(
    "er06_merge_groups",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS venue, o_orderpriority AS couple, CAST(o_orderdate AS DATE) AS dt, o_orderstatus = 'P' AS created FROM orders)
    SELECT venue, couple, min(id) AS survivor, count(*) AS members, date_diff('day', min(dt), max(dt)) AS span FROM c GROUP BY 1, 2 HAVING count(*) > 1 AND date_diff('day', min(dt), max(dt)) <= 400 AND NOT bool_or(created)""",
)
def er06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue"), F.col("o_orderpriority").alias("couple"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderstatus") == "P").alias("created"))
    return E.merge_groups(rows)


@query(
    "er07_duplicate_pairs",
    """WITH k AS (SELECT DISTINCT 'supplier' AS r, l_orderkey AS id, l_suppkey AS key FROM lineitem UNION SELECT DISTINCT 'part', l_orderkey, l_partkey FROM lineitem),
    x AS (SELECT DISTINCT a.o_orderkey AS id_a, b.o_orderkey AS id_b, ka.r FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 400 JOIN k ka ON ka.id = a.o_orderkey JOIN k kb ON kb.id = b.o_orderkey AND kb.r = ka.r AND kb.key = ka.key)
    SELECT id_a, id_b, string_agg(r, ',' ORDER BY r) AS reasons FROM x GROUP BY 1, 2""",
)
def er07(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("venue"), F.to_date("o_orderdate").alias("date"))
    lines = table(spark, d, "lineitem")
    key = lambda c: lines.select(F.col("l_orderkey").alias("id"), F.col(c).alias("key")).distinct()
    return E.duplicate_pairs(events, {"supplier": key("l_suppkey"), "part": key("l_partkey")})


@query("er09_alias_signals")
def er09(spark: SparkSession, d: str) -> DataFrame:
    """Parts as accounts: every tenth has a twin whose name differs in punctuation."""
    k = F.col("p_partkey")
    base = F.concat_ws("", F.split("p_name", " "))
    accounts = table(spark, d, "part").select(k.alias("id"), F.when(k % 10 == 0, F.concat(base, F.lit("_"), (k - 1).cast("string"))).otherwise(F.concat(base, k.cast("string"))).alias("username"), F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("url"), F.lit("").alias("biography"))
    return E.alias_signals(accounts)


@query(
    "er10_location_map",
    """WITH t AS (SELECT upper(substr(c_name, 1, 12)) AS tag, c_nationkey AS venue FROM customer), v AS (SELECT tag, min(venue) AS venue, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT venue) = 1) SELECT lower(tag) AS tag, venue, n FROM v""",
)
def er10(spark: SparkSession, d: str) -> DataFrame:
    """Location tags that mean one venue; tags that mean several are dropped."""
    per = table(spark, d, "customer").groupBy(F.lower(F.substring("c_name", 1, 12)).alias("tag")).agg(F.min("c_nationkey").alias("venue"), F.max("c_nationkey").alias("other"), F.count("*").alias("n"))
    return per.where("venue = other").select("tag", "venue", "n")


@query("er14_role_split", "SELECT l_orderkey AS event_id, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AS split, min(l_suppkey) FILTER (WHERE l_returnflag = 'A') AS ceremony_venue FROM lineitem GROUP BY 1")
def er14(spark: SparkSession, d: str) -> DataFrame:
    """Events with separate ceremony and reception venues, and the ceremony's."""
    has = lambda flag: F.bool_or(F.col("l_returnflag") == flag)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg((has("R") & has("A")).alias("split"), F.min(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("ceremony_venue"))
