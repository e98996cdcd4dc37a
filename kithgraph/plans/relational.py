"""Queries of the relational building blocks: latest rows, samples, joins, set operations, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.operators import helpers as H
from kithgraph.registry import query
from kithgraph.tables import table

def latest_events(events: DataFrame) -> DataFrame:
    return H.latest_by(events, ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()])


def short(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("win01_latest_event_per_user", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, round(value, 6) AS value FROM events ORDER BY user_id, ts DESC NULLS LAST, event_id DESC")
def win01(spark: SparkSession, d: str) -> DataFrame:
    return short(latest_events(table(spark, d, "events")))


@query("win02_latest_within_type", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, round(value, 6) AS value FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts DESC NULLS LAST, event_id DESC")
def win02(spark: SparkSession, d: str) -> DataFrame:
    return short(latest_events(table(spark, d, "events").where("event_type = 'purchase'")))


@query(
    "join10_latest_then_filter",
    "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1) WHERE event_type = 'purchase'",
)
def join10(spark: SparkSession, d: str) -> DataFrame:
    return short(latest_events(table(spark, d, "events")).where("event_type = 'purchase'"))


@query(
    "win05_page_with_total",
    "SELECT o_orderkey, round(o_totalprice, 2) AS price, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 24",
)
def win05(spark: SparkSession, d: str) -> DataFrame:
    """A page with the total beside each row: the total is a one-row aggregate, so no global window gathers all rows."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(24).limit(24)
    return page.crossJoin(rows.agg(F.count("*").alias("total"))).select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "total")


@query(
    "win06_group_index_and_size",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS group_index, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders",
)
def win06(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    number = F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", number.alias("group_index"), F.count("*").over(w).alias("group_size"))


@query(
    "win08_stratified_sample",
    "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 20",
)
def win08(spark: SparkSession, d: str) -> DataFrame:
    return H.stratified_sample(table(spark, d, "events"), "event_type", "event_id", 20).select("event_type", "event_id")


@query("win09_md5_sample", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders) WHERE rn <= CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 20 ELSE 10 END")
def win09(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic sample with a quota for each class."""
    quota = F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 20).otherwise(10)
    ranked = H.latest_rank(table(spark, d, "orders"), ["o_orderstatus"], [F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey")])
    return ranked.where(F.col("rn") <= quota).select("o_orderkey", "o_orderstatus")


@query(
    "win10_round_robin",
    "SELECT event_id, event_type, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 50",
)
def win10(spark: SparkSession, d: str) -> DataFrame:
    return H.round_robin(table(spark, d, "events"), "event_type", "event_id", 50).select("event_id", "event_type", F.col("rn").cast("long").alias("rn"))


@query(
    "win11_fair_slots",
    """WITH supply AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    slots AS (SELECT event_type, unnest(range(1, least(n, 37) + 1)) AS rn FROM supply),
    taken AS (SELECT * FROM slots ORDER BY rn, event_type LIMIT 37)
    SELECT event_type, count(*) AS slots FROM taken GROUP BY 1""",
)
def win11(spark: SparkSession, d: str) -> DataFrame:
    """37 slots dealt to the arms in turn, as far as each arm's supply lasts."""
    supply = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    slots = supply.select("event_type", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(37)).cast("int"))).alias("rn"))
    return slots.orderBy("rn", "event_type").limit(37).groupBy("event_type").agg(F.count("*").alias("slots"))


@query("join03_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join03(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join04_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join05_not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def join05(spark: SparkSession, d: str) -> DataFrame:
    """The subquery's column has no nulls, so NOT IN is an anti-join; with nulls it would give no rows."""
    named = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    return table(spark, d, "supplier").join(named, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query(
    "join06_exists_value",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 'bulk' ELSE 'plain' END AS kind FROM orders",
)
def join06(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS as values: flags are aggregated per key once, then joined."""
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_quantity") > 45).alias("q"))
    return table(spark, d, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.coalesce("r", F.lit(False)).alias("has_return"), F.when(F.coalesce("q", F.lit(False)), "bulk").otherwise("plain").alias("kind")
    )


@query(
    "join07_exists_or",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def join07(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    return table(spark, d, "customer").join(rich, "c_custkey", "left").where("c_acctbal > 9000 or big").select("c_custkey")


@query(
    "join08_correlated_scalar",
    "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM customer",
)
def join08(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return table(spark, d, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query(
    "join09_first_match",
    "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1) ON true",
)
def join09(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return H.first_match(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderkey"), ["o_orderkey", "o_orderstatus"])


@query(
    "join11_lateral_aggregates",
    """SELECT o_orderkey, x.any_return, x.all_open, coalesce(x.n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_return, bool_and(l_linestatus = 'O') AS all_open, count(*) AS n FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey""",
)
def join11(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_return"), F.bool_and(F.col("l_linestatus") == "O").alias("all_open"), F.count("*").alias("n"))
    return table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "any_return", "all_open", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(
    "join14_other_endpoint",
    """WITH c AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS a FROM lineitem), g AS (SELECT x.a AS a, y.a AS b, count(*) AS n FROM c x JOIN c y ON x.e = y.e AND x.a < y.a GROUP BY 1, 2)
    SELECT s_suppkey, CASE WHEN g.a = s_suppkey THEN g.b ELSE g.a END AS partner, n AS n_events FROM supplier JOIN g ON s_suppkey IN (g.a, g.b) WHERE s_suppkey <= 5""",
)
def join14(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by either endpoint: both directions of each edge make it one equi-join."""
    from kithgraph.operators.edges import pairs, symmetric

    credit = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("account_id"), F.lit(1).alias("n_confirmations")).distinct()
    edge = pairs(credit).groupBy("account_a", "account_b").agg(F.count("*").alias("n_events"))
    return symmetric(edge).where("account_id <= 5").select(F.col("account_id").alias("s_suppkey"), F.col("partner_id").alias("partner"), "n_events")


@query(
    "join15_interval_jaccard",
    """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 21),
    i AS (SELECT p.a, p.b, count(*) AS i FROM p JOIN s x ON x.k = p.a JOIN s y ON y.k = p.b AND x.v = y.v GROUP BY 1, 2)
    SELECT i.a AS order_a, i.b AS order_b, round(i.i / (x.n + y.n - i.i), 6) AS jaccard FROM i JOIN n x ON x.k = i.a JOIN n y ON y.k = i.b WHERE i.i / (x.n + y.n - i.i) > 0.1""",
)
def join15(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one customer's events within 21 days whose supplier sets are alike: a block on the customer, a residual on dates and sets."""
    from kithgraph.operators.entities import alike_within

    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("members"))
    rows = table(spark, d, "orders").join(sets, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("block"), F.to_date("o_orderdate").alias("date"), "members")
    return alike_within(rows, 21, 0.1).select(F.col("id_a").alias("order_a"), F.col("id_b").alias("order_b"), F.round("jaccard", 6).alias("jaccard"))


@query(
    "join17_canonical_ids",
    "SELECT CASE WHEN p_partkey % 10 BETWEEN 1 AND 3 THEN p_partkey - p_partkey % 10 ELSE p_partkey END AS account_id, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def join17(spark: SparkSession, d: str) -> DataFrame:
    """Credits of aliases count for their canonical account; keys ending in 1 to 3 stand in as aliases."""
    key = F.col("p_partkey")
    aliases = table(spark, d, "part").where((key % 10).between(1, 3)).select(key.alias("alias_id"), (key - key % 10).alias("canonical_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("account_id"))
    return H.canonical(lines, "account_id", aliases).groupBy("account_id").agg(F.count("*").alias("n_lines"))


@query("join18_case_insensitive", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON lower(substr(p_name, 1, 1)) = lower(substr(n_name, 1, 1))")
def join18(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.lower(F.substring(c, 1, 1))
    return table(spark, d, "part").join(table(spark, d, "nation"), first("p_name") == first("n_name")).select("p_partkey", "n_nationkey")


@query(
    "join20_edit_distance_block",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE abs(length(a.n_name) - length(b.n_name)) <= 3 AND levenshtein(a.n_name, b.n_name) <= 3",
)
def join20(spark: SparkSession, d: str) -> DataFrame:
    """Names within three edits: rows meet in buckets of lengths that differ by three at most."""
    from kithgraph.operators.entities import within_edits

    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return within_edits(names, 3).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("distance").cast("long").alias("distance"))


@query(
    "join21_pairs_in_small_groups",
    "WITH g AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM g a JOIN g b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.n <= 8",
)
def join21(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.operators.entities import pairs_in_groups

    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"))
    return pairs_in_groups(rows, 8).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query(
    "agg16_median",
    "SELECT o_orderpriority, round(median(o_totalprice), 6) AS median_price FROM orders GROUP BY 1",
)
def agg16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 6).alias("median_price"))


@query(
    "agg17_percentiles",
    "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY 1",
)
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])


@query(
    "agg18_bands",
    "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 15 THEN '6-15' WHEN n <= 49 THEN '16-49' ELSE '50+' END AS band, count(*) AS customers FROM n GROUP BY 1",
)
def agg18(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return table(spark, d, "customer").join(per, "c_custkey", "left").groupBy(H.bands(n, [0, 1, 5, 15, 49], ["0", "1", "2-5", "6-15", "16-49", "50+"]).alias("band")).agg(F.count("*").alias("customers"))


@query(
    "agg19_top_share",
    "WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn FROM n) SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(n) FILTER (WHERE rn <= 10) / sum(n), 6) AS top_share FROM r",
)
def agg19(spark: SparkSession, d: str) -> DataFrame:
    return H.top_share(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "n", 10)


@query(
    "agg21_zero_guard",
    "SELECT l_suppkey, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / nullif(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0), 6) AS ratio FROM lineitem GROUP BY 1",
)
def agg21(spark: SparkSession, d: str) -> DataFrame:
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.try_divide(of("R"), F.nullif(of("A"), F.lit(0.0))), 6).alias("ratio"))


@query(
    "agg22_dashboard",
    "SELECT (SELECT count(*) FROM orders) AS n_events, (SELECT count(*) FROM part) AS n_accounts, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS n_confirmed, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_credited",
)
def agg22(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    parts = [
        table(spark, d, "orders").agg(F.count("*").alias("n_events")), table(spark, d, "part").agg(F.count("*").alias("n_accounts")),
        lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_confirmed")), lines.agg(F.countDistinct("l_partkey").alias("n_credited")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one aggregate each
    return out


@query(
    "agg23_rollup_severity",
    "WITH r AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS k FROM events) SELECT user_id, CASE max(k) WHEN 3 THEN 'CONFIRMED' WHEN 2 THEN 'LIKELY' WHEN 1 THEN 'POSSIBLE' END AS severity, count(*) FILTER (WHERE k > 0) AS flagged FROM r GROUP BY 1 HAVING max(k) > 0",
)
def agg23(spark: SparkSession, d: str) -> DataFrame:
    """The worst of ordered severities per group, groups without any left out."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    per = table(spark, d, "events").select("user_id", rank.alias("k")).groupBy("user_id").agg(F.max("k").alias("k"), F.count_if(F.col("k") > 0).alias("flagged"))
    return per.where("k > 0").select("user_id", F.element_at(F.array(F.lit("POSSIBLE"), F.lit("LIKELY"), F.lit("CONFIRMED")), F.col("k")).alias("severity"), "flagged")


@query(
    "agg24_checksum",
    """WITH h AS (SELECT CAST(('0x' || substr(md5(CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR)), 1, 12)) AS BIGINT) AS h FROM nation)
    SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h % 1000003) AS BIGINT) AS sum_hash FROM h""",
)
def agg24(spark: SparkSession, d: str) -> DataFrame:
    return H.checksum(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("agg05_arrays", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, arg_max(l_partkey, (l_quantity, l_linenumber, l_partkey)) AS main_part, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY 1")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.max_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("main_part"),
        F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("line_numbers"),
    )


@query("agg08_object", "WITH l AS (SELECT l_orderkey, l_returnflag, arg_max(l_partkey, (l_linenumber, l_partkey)) AS p FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag || '=' || CAST(p AS VARCHAR), ',' ORDER BY l_returnflag) AS roles FROM l GROUP BY 1")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    """A map of keyed rows: of a key's rows the last line stays, stated instead of left to chance."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("p"))
    made = per.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "p")))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return made.select("l_orderkey", F.array_join(entries, ",").alias("roles"))


@query("set01_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'order' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'line', l_orderkey FROM lineitem) GROUP BY 1")
def set01(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"))
    b = table(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("k"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("set02_union_distinct", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def set02(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).union(lines.where("l_linestatus = 'O'").select("l_suppkey")).distinct()


@query(
    "set04_exceptall",
    "(SELECT 'missing' AS side, o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL) UNION ALL (SELECT 'extra', o_orderstatus, o_orderpriority, count(*) FROM (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL)",
)
def set04(spark: SparkSession, d: str) -> DataFrame:
    """Both differences of two multisets, from one signed count per row value."""
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    net = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum(sign).alias("n")).where("n <> 0")
    return net.select(F.when(F.col("n") > 0, "missing").otherwise("extra").alias("side"), "o_orderstatus", "o_orderpriority", F.abs("n").alias("n"))


@query(
    "set05_roleset_diff",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 48), b AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber > 2 AND l_quantity > 48)
    SELECT coalesce(a.l_suppkey, b.l_suppkey) AS account_id, coalesce(a.l_returnflag, b.l_returnflag) AS role, CASE WHEN a.l_suppkey IS NULL THEN 'added' WHEN b.l_suppkey IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag""",
)
def set05(spark: SparkSession, d: str) -> DataFrame:
    """Roles added, removed and kept between two sets: one grouping in place of a full join."""
    rows = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("role"), (F.col("l_linenumber") <= 2).alias("before"))
    both = rows.groupBy("account_id", "role").agg(F.bool_or("before").alias("b"), F.bool_or(~F.col("before")).alias("a"))
    return both.select("account_id", "role", F.when(~F.col("b"), "added").when(~F.col("a"), "removed").otherwise("kept").alias("change"))


@query("set07_overlap", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') SELECT count(*) AS returned, count(b.l_partkey) AS held, count(*) - count(b.l_partkey) AS fresh, round(100.0 * count(b.l_partkey) / count(*), 6) AS pct_held FROM a LEFT JOIN b USING (l_partkey)")
def set07(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a")).where("r")
    return per.agg(F.count("*").alias("returned"), F.count_if("a").alias("held"), F.count_if(~F.col("a")).alias("fresh"), F.round(F.count_if("a") * 100.0 / F.count("*"), 6).alias("pct_held"))


@query("flt02_escaped_search", r"SELECT p_partkey FROM part WHERE p_name ILIKE '%\_%' ESCAPE '\' OR p_type ILIKE '%brass%' OR p_brand ILIKE '%#1%'")
def flt02(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.functions.text import matches_any

    return table(spark, d, "part").where(matches_any("_", ["p_name"]) | matches_any("brass", ["p_type"]) | matches_any("#1", ["p_brand"])).select("p_partkey")


@query("flt04_bbox", "SELECT c_custkey FROM customer WHERE c_custkey = 7 OR (c_acctbal BETWEEN 1000 AND 2000 AND c_nationkey BETWEEN 3 AND 9)")
def flt04(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.functions.places import in_bounds

    return table(spark, d, "customer").where(in_bounds(F.col("c_acctbal"), F.col("c_nationkey"), (1000, 2000, 3, 9)) | (F.col("c_custkey") == 7)).select("c_custkey")


@query("flt06_null_safe", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE o_orderstatus IS DISTINCT FROM 'F'")
def flt06(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").where(~F.col("o_orderstatus").eqNullSafe("F")).agg(F.count("*").alias("n"))


@query("srt02_custom_order", "SELECT n_nationkey, array_position(['ASIA', 'EUROPE', 'AFRICA'], r_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def srt02(spark: SparkSession, d: str) -> DataFrame:
    """The place of a value in a stated order; values not in it have none and sort last."""
    place = F.nullif(F.array_position(F.array(F.lit("ASIA"), F.lit("EUROPE"), F.lit("AFRICA")), F.col("r_name")), F.lit(0).cast("long"))
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", place.cast("int").alias("place"))
