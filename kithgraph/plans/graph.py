"""Queries over the collaboration graph: edges, partners, role votes, profiles, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import edges
from kithgraph.operators import helpers as H
from kithgraph.registry import query
from kithgraph.tables import credits, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"))


def supplier_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits with suppliers as accounts, a dense graph: (event_id, account_id, role, n_confirmations)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("role")).agg(F.count("*").alias("n_confirmations"))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edges(supplier_credits(spark, sf_dir), events(spark, sf_dir))


CREDITS_SQL = "SELECT l_orderkey AS event_id, l_partkey AS account_id, count(*) AS n FROM lineitem GROUP BY 1, 2"
SUPPLIERS_SQL = "SELECT l_orderkey AS event_id, l_suppkey AS account_id, l_returnflag AS role, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"
EDGES_SQL = """SELECT a.account_id AS a, b.account_id AS b, count(DISTINCT a.event_id) AS n_events, CAST(sum(least(a.n, b.n)) AS BIGINT) AS n_confirmations, max(CAST(o_orderdate AS DATE)) AS last_date
    FROM c a JOIN c b ON a.event_id = b.event_id AND a.account_id < b.account_id JOIN orders ON o_orderkey = a.event_id GROUP BY 1, 2"""


@query(
    "agg10_edges",
    f"WITH c AS ({CREDITS_SQL}) SELECT a AS account_a, b AS account_b, n_events, n_confirmations, last_date AS last_worked_together FROM ({EDGES_SQL})",
)
def agg10_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edges(credits(spark, sf_dir), events(spark, sf_dir))


@query(
    "ev17_edges_with_roles",
    f"WITH c AS ({SUPPLIERS_SQL}) SELECT a AS account_a, b AS account_b, n_events, n_confirmations, last_date AS last_worked_together FROM ({EDGES_SQL})",
)
def ev17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with several roles on an event count it once but add up all confirmations."""
    return supplier_edges(spark, sf_dir)


@query("join13_pairs_raw", f"WITH c AS ({CREDITS_SQL}) SELECT a.event_id, a.account_id AS account_a, b.account_id AS account_b, least(a.n, b.n) AS n_confirmations FROM c a JOIN c b ON a.event_id = b.event_id AND a.account_id < b.account_id")
def join13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.pairs(credits(spark, sf_dir))


@query(
    "agg11_partners",
    f"""WITH c AS ({SUPPLIERS_SQL}), g AS ({EDGES_SQL}), s AS (SELECT CASE WHEN a IN (1, 2) THEN b ELSE a END AS partner_id, n_events, last_date FROM g WHERE (a IN (1, 2)) <> (b IN (1, 2)))
    SELECT partner_id, CAST(sum(n_events) AS BIGINT) AS n_events, max(last_date) AS last_date FROM s GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 24""",
)
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of an alias set, its own members left out. Events that credit two aliases count twice."""
    near = edges.symmetric(supplier_edges(spark, sf_dir)).where("account_id in (1, 2) and partner_id not in (1, 2)")
    total = near.groupBy("partner_id").agg(F.sum("n_events").alias("n_events"), F.max("last_worked_together").alias("last_date"))
    return total.orderBy(F.desc("n_events"), F.desc("last_date"), "partner_id").limit(24)


@query(
    "agg12_team_picks",
    f"""WITH c AS ({SUPPLIERS_SQL}), g AS ({EDGES_SQL}), s AS (SELECT a AS me, b AS other, n_events FROM g UNION ALL SELECT b, a, n_events FROM g),
    t AS (SELECT other, me, n_events FROM s WHERE me <= 5 AND other > 5)
    SELECT other AS account_id, CAST(sum(n_events) AS BIGINT) AS weight, string_agg(CAST(me AS VARCHAR) || ':' || CAST(n_events AS VARCHAR), ',' ORDER BY n_events DESC, me) AS receipts FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that worked most with a team, with the receipts."""
    near = edges.symmetric(supplier_edges(spark, sf_dir)).where("account_id <= 5 and partner_id > 5")
    receipts = F.array_sort(F.collect_list(F.struct((-F.col("n_events")).alias("k"), "account_id")))
    shown = F.array_join(F.transform(receipts, lambda x: F.concat_ws(":", x["account_id"].cast("string"), (-x["k"]).cast("string"))), ",")
    return near.groupBy(F.col("partner_id").alias("account_id")).agg(F.sum("n_events").alias("weight"), shown.alias("receipts")).orderBy(F.desc("weight"), "account_id").limit(12)


def role_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("account_id"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("source")).agg(F.count("*").alias("evidence"))
    return lines.withColumn("confidence", H.capped_confidence(F.col("evidence")))


VOTES_SQL = "SELECT l_partkey AS account_id, l_returnflag AS role, l_linestatus AS source, count(*) AS evidence, round(least(0.5 + 0.15 * count(*), 0.95), 6) AS confidence FROM lineitem GROUP BY 1, 2, 3"


@query("agg13_role_votes", VOTES_SQL.replace("round(least(0.5 + 0.15 * count(*), 0.95), 6)", "CAST(round(least(0.5 + 0.15 * count(*), 0.95), 6) AS DOUBLE)"))
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_votes(spark, sf_dir)


@query("win03_role_winner", f"SELECT DISTINCT ON (account_id) account_id, role, source, evidence FROM ({VOTES_SQL}) ORDER BY account_id, evidence DESC, confidence DESC, (role = 'R') DESC, role, source")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of most evidence per account; of ties the most confident, then a stated role, then by name."""
    order = [F.desc("evidence"), F.desc("confidence"), (F.col("role") == "R").desc(), F.col("role"), F.col("source")]
    return H.latest_by(role_votes(spark, sf_dir), ["account_id"], order).select("account_id", "role", "source", "evidence")


@query("agg14_confirmations", SUPPLIERS_SQL.replace("count(*) AS n ", "count(*) AS n_confirmations "))
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_credits(spark, sf_dir)


@query("agg15_mode_role", "SELECT DISTINCT ON (l_suppkey) l_suppkey AS account_id, l_returnflag AS role, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) ORDER BY l_suppkey, n DESC, l_returnflag")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent role, of ties the first by name."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("role")).agg(F.count("*").alias("n"))
    return n.groupBy("account_id").agg(F.min_by(F.struct("role", "n"), F.struct(-F.col("n"), "role")).alias("m")).select("account_id", "m.*")


@query("flt08_role_shape", "SELECT l_orderkey AS event_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag IN ('R', 'A'))")
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose roles, at least one, are all of a given set."""
    shape = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.bool_and(F.col("l_returnflag").isin("R", "A")).alias("inside"))
    return shape.where("inside").select("event_id")


@query(
    "srv01_feed_page",
    """WITH page AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 20)
    SELECT p.o_orderkey AS event_id, p.date, (SELECT count(*) FROM orders) AS total, (SELECT string_agg(l_returnflag || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_returnflag, l_partkey, l_linenumber) FROM lineitem WHERE l_orderkey = p.o_orderkey) AS vendors,
      (SELECT arg_min(l_partkey, (l_shipdate, l_linenumber)) FROM lineitem WHERE l_orderkey = p.o_orderkey) AS cover FROM page p""",
)
def srv01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of events with their vendors nested and a cover; only the page's lines are gathered."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    page = orders.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("date")).orderBy(F.desc("date"), F.desc("event_id")).limit(20)
    nested = lines.join(F.broadcast(page), F.col("l_orderkey") == F.col("event_id")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "l_partkey", "l_linenumber"))).alias("v"), F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber")).alias("cover"))
    shown = F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["l_returnflag"], x["l_partkey"].cast("string"))), ",")
    return page.join(nested, "event_id", "left").crossJoin(orders.agg(F.count("*").alias("total"))).select("event_id", "date", "total", shown.alias("vendors"), "cover")


@query(
    "srv03_profile_counts",
    "SELECT l_suppkey AS account_id, count(DISTINCT l_orderkey) AS n_events, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS n_hosted, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag <> 'R') AS n_credited FROM lineitem GROUP BY 1",
)
def srv03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct events per account, all and by part played: one pass over distinct (account, event) flags."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account_id"), "l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("h"), F.bool_or(F.col("l_returnflag") != "R").alias("c"))
    return per.groupBy("account_id").agg(F.count("*").alias("n_events"), F.count_if("h").alias("n_hosted"), F.count_if("c").alias("n_credited"))


@query(
    "srv04_partners_with_role",
    f"""WITH c AS ({SUPPLIERS_SQL}), p AS (SELECT b.account_id AS partner_id, b.role, count(*) AS n FROM c a JOIN c b ON a.event_id = b.event_id WHERE a.account_id = 3 AND b.account_id <> 3 GROUP BY 1, 2)
    SELECT DISTINCT ON (partner_id) partner_id, role, n FROM p ORDER BY partner_id, n DESC, role""",
)
def srv04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that each partner of an account has most often on shared events."""
    credit = supplier_credits(spark, sf_dir)
    mine = credit.where("account_id = 3").select("event_id", F.col("role").alias("own_role"))
    n = credit.where("account_id <> 3").join(mine, "event_id").groupBy(F.col("account_id").alias("partner_id"), "role").agg(F.count("*").alias("n"))
    return n.groupBy("partner_id").agg(F.min_by(F.struct("role", "n"), F.struct(-F.col("n"), "role")).alias("m")).select("partner_id", "m.*")


@query("srv05_credited_as", "SELECT l_suppkey AS account_id, l_returnflag AS role, count(DISTINCT l_orderkey) AS n_events FROM lineitem GROUP BY 1, 2")
def srv05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("role")).agg(F.countDistinct("l_orderkey").alias("n_events"))


@query(
    "srv06_vendor_browse",
    "WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n_events FROM lineitem GROUP BY 1) SELECT p_partkey AS account_id, p_name AS name, coalesce(n_events, 0) AS n_events FROM part LEFT JOIN n ON l_partkey = p_partkey WHERE p_brand = 'Brand#13' AND coalesce(n_events, 0) >= 2 ORDER BY 3 DESC, 1 LIMIT 50",
)
def srv06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.operators.serving import browse

    accounts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("account_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("role"))
    return browse(accounts, credits(spark, sf_dir), role="Brand#13", least=2, limit=50).select("account_id", "name", "n_events")


@query(
    "srv08_search",
    "WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n_events FROM lineitem GROUP BY 1) SELECT p_partkey AS account_id, p_name AS name, coalesce(n_events, 0) AS n_events FROM part LEFT JOIN n ON l_partkey = p_partkey WHERE contains(lower(p_name), '1') ORDER BY 3 DESC, 1 LIMIT 20 OFFSET 10",
)
def srv08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithgraph.operators.serving import browse

    accounts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("account_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("role"))
    return browse(accounts, credits(spark, sf_dir), text="1", limit=20, offset=10).select("account_id", "name", "n_events")


@query(
    "srv07_home_stats",
    "SELECT (SELECT count(*) FROM orders) AS events, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS vendors, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag FROM lineitem)) AS roles, (SELECT count(*) FROM lineitem) AS credits",
)
def srv07(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("vendors"), F.countDistinct("l_returnflag").alias("roles"), F.count("*").alias("credits"))
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("events")).crossJoin(per)


@query("srv13_busiest_venues", "SELECT o_custkey AS venue_id, count(*) AS n_events FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def srv13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("venue_id")).agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "venue_id").limit(15)


@query("srv13_strongest_pairs", f"WITH c AS ({CREDITS_SQL}) SELECT a AS account_a, b AS account_b, n_events FROM ({EDGES_SQL}) WHERE n_events > 1 ORDER BY 3 DESC, 1, 2 LIMIT 15")
def srv13_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg10_edges(spark, sf_dir).where("n_events > 1").orderBy(F.desc("n_events"), "account_a", "account_b").limit(15).select("account_a", "account_b", "n_events")


@query("srv07_category_counts", "SELECT p_brand AS category, count(DISTINCT p_partkey) AS accounts FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return used.groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("accounts"))


@query(
    "flt05_listing_rule",
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN n ON o_custkey = c_custkey
    WHERE NOT (c_custkey % 10 BETWEEN 1 AND 2) AND c_acctbal > 0 AND (coalesce(n, 0) >= 12 OR (coalesce(n, 0) >= 6 AND c_mktsegment <> 'MACHINERY'))""",
)
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues listed: enough events, or fewer with a known type; aliases hidden; in the metro only."""
    from kithgraph.operators.serving import listed

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.count("*").alias("n_events"))
    venues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 0).alias("in_metro"))
    aliases = venues.where((F.col("account_id") % 10).between(1, 2)).select("account_id")
    return listed(venues, n, aliases, enough=12, few=6, unknown="MACHINERY").select(F.col("account_id").alias("c_custkey"))
