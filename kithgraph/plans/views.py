"""Queries of evidence, evaluation, acquisition and documents, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import acquire as A
from kithgraph.operators import documents as D
from kithgraph.operators import evaluate as V
from kithgraph.operators import evidence as E
from kithgraph.registry import query
from kithgraph.tables import table


@query("ev03_cluster_vendors", "WITH a AS (SELECT l_orderkey AS p, l_suppkey AS v, l_linestatus AS r FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey, l_suppkey, l_linestatus FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT p FROM a)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT o_custkey AS cluster_id, v AS account_id, r AS role, count(DISTINCT p) AS n_confirmations FROM u JOIN orders ON o_orderkey = p GROUP BY 1, 2, 3")
def ev03(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_url"), F.col("l_suppkey").alias("account_id"), F.col("l_linestatus").alias("role"), "l_returnflag")
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_url"), F.col("o_custkey").alias("cluster_id"))
    return E.cluster_vendors(posts, lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"))


@query(
    "ev05_anchor_priority",
    """WITH r AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS o, l_suppkey AS v FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linestatus, l_linenumber, l_suppkey),
    a AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS o, l_suppkey AS v FROM lineitem WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM r WHERE r.o = l_orderkey) ORDER BY l_orderkey, l_linestatus, l_linenumber, l_suppkey),
    n AS (SELECT o_orderkey AS o, o_custkey AS v FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o = o_orderkey) AND NOT EXISTS (SELECT 1 FROM a WHERE a.o = o_orderkey))
    SELECT o AS post_url, v AS account_id, 'credit_line' AS source FROM r UNION ALL SELECT o, v, 'location_tag' FROM a UNION ALL SELECT o, v, 'author' FROM n""",
)
def ev05(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda flag, name: lines.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("post_url"), F.col("l_linestatus").alias("label_rank"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("account_id"), F.lit(name).alias("source"))
    author = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_url"), F.lit("").alias("label_rank"), F.lit(0).alias("line_no"), F.col("o_custkey").alias("account_id"), F.lit("author").alias("source"))
    return E.anchors([of("R", "credit_line"), of("A", "location_tag"), author]).select("post_url", "account_id", "source")


@query("ev05_anchor_conflict", "SELECT l_orderkey AS post_url, count(DISTINCT l_suppkey) > 1 AS anchor_conflict FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def ev05_conflict(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_url"), F.col("l_suppkey").alias("account_id"), "l_returnflag")
    return E.conflicts([lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")])


@query(
    "ev08_geography",
    """WITH v AS (SELECT l_orderkey AS k, bool_or(CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END) AS y, bool_or(CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
    SELECT o_orderkey AS post_url, CASE WHEN y THEN 'CONFIRMED' WHEN o_orderpriority LIKE '1%' THEN 'CONFIRMED' WHEN n THEN 'NOT_CONFIRMED' WHEN o_orderpriority LIKE '2%' THEN 'NOT_CONFIRMED' WHEN k IS NOT NULL THEN 'AMBIGUOUS' ELSE 'NO_SIGNAL' END AS status FROM orders LEFT JOIN v ON k = o_orderkey""",
)
def ev08(spark: SparkSession, d: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_url"), F.when(p == "1", "in Chicago").otherwise("somewhere").alias("caption"), F.when(p == "2", "Miami Beach").alias("location_tag"))
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return E.geography(posts, table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("post_url"), flag.alias("in_metro")))


@query(
    "ev10_association",
    "WITH t AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS post_url, o_custkey % 3 = 0 AS author_is_vendor, coalesce(n, 0) AS tagged_vendor_count, CASE WHEN o_custkey % 3 = 0 AND n > 0 THEN 'BOTH' WHEN o_custkey % 3 = 0 THEN 'AUTHOR_ONLY' WHEN n > 0 THEN 'TAGGED_ONLY' ELSE 'NONE' END AS association FROM orders LEFT JOIN t ON k = o_orderkey",
)
def ev10(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_url"), F.col("o_custkey").alias("author_id"))
    vendors = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("account_id"))
    tagged = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("post_url"), F.col("l_suppkey").alias("account_id"))
    return E.association(posts, vendors, tagged)


@query(
    "ev14_verdict_rollup",
    """WITH v AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'THIS_VENUE' WHEN 'signup' THEN 'OTHER_VENUE' WHEN 'click' THEN 'NOT_WEDDING' ELSE 'SKIP' END AS v FROM events)
    SELECT user_id AS candidate_id, CASE WHEN count(*) FILTER (WHERE v = 'THIS_VENUE') > 0 THEN 'CONFIRM' WHEN count(*) FILTER (WHERE v = 'OTHER_VENUE') > 0 THEN 'WRONG_VENUE' WHEN count(*) FILTER (WHERE v <> 'NOT_WEDDING') = 0 THEN 'NOT_WEDDING' ELSE 'UNSURE' END AS decision, count(*) FILTER (WHERE v <> 'SKIP') AS decided FROM v GROUP BY 1""",
)
def ev14(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "purchase", "THIS_VENUE").when(F.col("event_type") == "signup", "OTHER_VENUE").when(F.col("event_type") == "click", "NOT_WEDDING").otherwise("SKIP")
    return E.verdict_rollup(table(spark, d, "events").select(F.col("user_id").alias("candidate_id"), verdict.alias("verdict")))


@query(
    "ev15_truth_tier",
    """WITH e AS (SELECT *, user_id AS p FROM events),
    hl AS (SELECT DISTINCT ON (p) p, CASE WHEN event_id % 2 = 0 THEN 'wedding' ELSE 'not_wedding' END AS x FROM e WHERE event_type = 'purchase' AND p % 3 = 0 ORDER BY p, ts DESC, event_id DESC),
    hv AS (SELECT DISTINCT ON (p) p, CASE event_id % 3 WHEN 0 THEN 'wedding' WHEN 1 THEN 'not_wedding' END AS x FROM e WHERE event_type = 'click' AND p % 4 = 0 ORDER BY p, ts DESC, event_id DESC),
    mv AS (SELECT DISTINCT ON (p) p, CASE event_id % 3 WHEN 0 THEN 'wedding' WHEN 1 THEN 'not_wedding' END AS x FROM e WHERE event_type = 'view' ORDER BY p, ts DESC, event_id DESC),
    m AS (SELECT c_custkey AS p, hl.x AS a, hv.x AS b, mv.x AS m, c_custkey % 5 = 0 AS att, c_custkey % 7 = 0 AS ret, c_custkey % 2 = 0 AS clu FROM customer LEFT JOIN hl ON hl.p = c_custkey LEFT JOIN hv ON hv.p = c_custkey LEFT JOIN mv ON mv.p = c_custkey)
    SELECT p AS post_id, CASE WHEN a <> b THEN 'conflicting' WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, b) WHEN m IS NOT NULL THEN m WHEN ret THEN 'not_wedding' WHEN att OR clu THEN 'wedding' ELSE 'unknown' END AS label,
      CASE WHEN coalesce(a, b) IS NOT NULL THEN 'gold' WHEN m IS NOT NULL OR ret OR att THEN 'silver' WHEN clu THEN 'bronze' END AS tier,
      CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'human_label+human_verdict' WHEN a IS NOT NULL THEN 'human_label' WHEN b IS NOT NULL THEN 'human_verdict' WHEN m IS NOT NULL THEN 'model_verdict' WHEN ret THEN 'retired' WHEN att THEN 'attachment' WHEN clu THEN 'cluster' END AS source,
      coalesce(coalesce(a, b) = 'not_wedding', false) AND att AND NOT coalesce(a <> b, false) AS retirement_candidate,
      coalesce(a, b) IS NULL AND (coalesce(m IS NOT NULL AND ((ret AND m <> 'not_wedding') OR (att AND m <> 'wedding')), false) OR (ret AND att)) AS silver_disagreement FROM m""",
)
def ev15(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("post_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "event_type")
    posts = table(spark, d, "customer").select(F.col("c_custkey").alias("post_id"))
    verdict = F.when(F.col("id") % 3 == 0, "THIS_VENUE").when(F.col("id") % 3 == 1, "NOT_WEDDING").otherwise("UNSURE")
    labels = log.where("event_type = 'purchase' and post_id % 3 = 0").withColumn("decision", F.when(F.col("id") % 2 == 0, "WEDDING").otherwise("NOT_WEDDING"))
    human = log.where("event_type = 'click' and post_id % 4 = 0").withColumn("verdict", verdict)
    model = log.where("event_type = 'view'").withColumn("verdict", verdict)
    return E.truth(posts, labels, human, model, posts.where("post_id % 5 = 0"), posts.where("post_id % 7 = 0"), posts.where("post_id % 2 = 0"))


GOLDEN_SQL = "g AS (SELECT doc_id, CASE quality WHEN 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS e, CASE WHEN n_chars >= 1500 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS a, CAST(least(n_chars / 5000.0, 1.0) AS DOUBLE) AS c FROM labels JOIN documents USING (doc_id))"


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a decision from their length, as an evaluation set."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "INCLUDE").otherwise("EXCLUDE").alias("expected"), F.when(F.col("n_chars") >= 1500, "INCLUDE").otherwise("EXCLUDE").alias("actual"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("confidence"))


@query("evl01_confusion", f"WITH {GOLDEN_SQL} SELECT e AS expected, a AS actual, count(*) AS n FROM g GROUP BY 1, 2")
def evl01(spark: SparkSession, d: str) -> DataFrame:
    return V.confusion(golden(spark, d))


@query(
    "evl01_quality",
    f"""WITH {GOLDEN_SQL}, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE e = 'INCLUDE' AND a = 'INCLUDE') AS tp, count(*) FILTER (WHERE e <> 'INCLUDE' AND a = 'INCLUDE') AS fp, count(*) FILTER (WHERE e = 'INCLUDE' AND a <> 'INCLUDE') AS fn FROM g)
    SELECT n, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM k""",
)
def evl01_quality(spark: SparkSession, d: str) -> DataFrame:
    return V.quality(golden(spark, d))


@query(
    "evl01_per_class",
    f"""WITH {GOLDEN_SQL}, c AS (SELECT e AS class FROM g UNION SELECT a FROM g) SELECT class, CAST((SELECT count(*) FROM g WHERE e = class) AS BIGINT) AS expected, CAST((SELECT count(*) FROM g WHERE a = class) AS BIGINT) AS predicted, CAST((SELECT count(*) FROM g WHERE a = class AND e = class) AS BIGINT) AS correct,
    round((SELECT count(*) FROM g WHERE a = class AND e = class) / nullif((SELECT count(*) FROM g WHERE a = class), 0), 6) AS precision, round((SELECT count(*) FROM g WHERE a = class AND e = class) / nullif((SELECT count(*) FROM g WHERE e = class), 0), 6) AS recall FROM c""",
)
def evl01_per_class(spark: SparkSession, d: str) -> DataFrame:
    return V.per_class(golden(spark, d))


@query(
    "evl01_calibration",
    f"WITH {GOLDEN_SQL} SELECT CASE WHEN c < 0.5 THEN '0.00-0.50' WHEN c < 0.7 THEN '0.50-0.70' WHEN c < 0.85 THEN '0.70-0.85' WHEN c < 0.95 THEN '0.85-0.95' ELSE '0.95-1.01' END AS bucket, count(*) AS n, count(*) FILTER (WHERE e = a) AS right, round(avg(CAST(e = a AS INTEGER)), 6) AS accuracy FROM g GROUP BY 1",
)
def evl01_calibration(spark: SparkSession, d: str) -> DataFrame:
    return V.calibration(golden(spark, d).withColumn("correct", F.col("expected") == F.col("actual")))


@query("evl03_account_errors", "WITH a AS (SELECT l_suppkey AS s, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS i FROM lineitem GROUP BY 1) SELECT s AS account_id, n AS posts, i AS included, round(i / n, 6) AS rate, i / n BETWEEN 0.2 AND 0.8 AS mixed FROM a WHERE n >= 5")
def evl03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("account_id"), F.when(F.col("l_returnflag") == "R", "INCLUDE").otherwise("EXCLUDE").alias("decision"))
    return V.account_errors(rows, 5)


@query("evl05_agreement", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = o_custkey % 3) AS same, round(count(*) FILTER (WHERE o_orderkey % 3 = o_custkey % 3) / count(*), 6) AS share FROM orders GROUP BY 1")
def evl05(spark: SparkSession, d: str) -> DataFrame:
    return V.agreement(table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("a"), (F.col("o_custkey") % 3).alias("b")), "o_orderpriority")


@query("cls01_cascade", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'EXCLUDE' WHEN o_orderpriority LIKE '1%' THEN 'EXCLUDE' ELSE 'INCLUDE' END AS decision, CASE WHEN o_orderstatus = 'P' THEN 'deterministic' WHEN o_orderpriority LIKE '1%' THEN 'cheap' ELSE 'strong' END AS tier FROM orders")
def cls01(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(F.col("o_orderstatus") == "P", "rule")
    cheap = F.when(F.col("o_orderpriority").startswith("1"), "EXCLUDE").otherwise("INCLUDE")
    decision, tier = V.cascade(rule, cheap, F.lit("INCLUDE"))
    return table(spark, d, "orders").select("o_orderkey", decision.alias("decision"), tier.alias("tier"))


@query("cls02_escalation", "SELECT o_orderkey, o_orderstatus = 'P' OR (o_orderkey % 11) / 10.0 BETWEEN 0.5 AND 0.8 AS escalates FROM orders")
def cls02(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "P", "UNSURE").otherwise("THIS_VENUE")
    return table(spark, d, "orders").select("o_orderkey", V.escalates(verdict, (F.col("o_orderkey") % 11) / 10.0, V.escalation_band("0.5-0.8")).alias("escalates"))


@query("cls05_skip_unchanged", "SELECT o_orderkey AS post_id FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderstatus = 'F'")
def cls05(spark: SparkSession, d: str) -> DataFrame:
    """Inputs not yet seen by a version: a fifth were, a part of them with other content since."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.md5(F.col("o_orderstatus")).alias("input_hash"))
    seen = rows.where("post_id % 5 = 0").select("post_id", F.when(F.col("input_hash") == F.md5(F.lit("F").cast("binary")), "old").otherwise(F.col("input_hash")).alias("input_hash"), F.lit("v3").alias("version"))
    return V.unchanged(rows, seen, "v3").select("post_id")


@query(
    "que01_labelling_queue",
    """WITH b AS (SELECT o_orderkey AS post_id, CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_orderstatus = 'F' THEN 'b' ELSE 'c' END AS bucket FROM orders)
    SELECT post_id, bucket, md5('queue:' || CAST(post_id AS VARCHAR)) AS rank_key FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(post_id AS VARCHAR)), post_id) <= CASE bucket WHEN 'a' THEN 10 WHEN 'b' THEN 20 ELSE 5 END""",
)
def que01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "post_id")
    return V.labelling_queue([("a", rows.where("o_totalprice > 300000")), ("b", rows.where("o_orderstatus = 'F'")), ("c", rows)], {"a": 10, "b": 20, "c": 5})


@query("que03_next_batch", "SELECT o_orderkey AS post_id FROM orders WHERE o_custkey % 4 <> 0 ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 25")
def que03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.md5(F.col("o_orderkey").cast("string")).alias("rank_key"), "o_custkey")
    done = rows.where("o_custkey % 4 = 0").select("post_id", F.lit("me").alias("labeled_by"))
    return V.next_to_label(rows, done, "me", 25).select("post_id")


@query(
    "acq01_venue_prior",
    """SELECT p_partkey, CAST(greatest(0.01, round(0.08 + CASE WHEN p_size % 4 = 0 THEN 0.04 WHEN p_size % 4 = 1 THEN -0.04 WHEN p_size % 4 = 2 THEN 0.03 ELSE 0 END
      + CASE WHEN p_size * 100 < 50 THEN -0.03 WHEN p_size * 100 < 150 THEN -0.01 WHEN p_size * 100 < 400 THEN 0.04 WHEN p_size * 100 < 5000 THEN 0.05 WHEN p_size * 100 < 20000 THEN -0.04 ELSE -0.07 END
      + CASE WHEN p_partkey % 1500 BETWEEN 50 AND 1000 THEN 0.02 WHEN p_partkey % 1500 > 1000 THEN -0.04 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN -0.06 ELSE 0 END, 3)) AS DOUBLE) AS prior FROM part""",
)
def acq01(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.when(s % 4 == 0, "museum").when(s % 4 == 1, "other").when(s % 4 == 3, "restaurant")
    prior = A.venue_prior(kind, s * 100, k % 1500, F.when(k % 5 == 0, "hotel"))
    return table(spark, d, "part").select("p_partkey", prior.alias("prior"))


@query("acq06_prior_update", "WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS w FROM lineitem GROUP BY 1) SELECT l_suppkey, round((25 * 0.2 + w) / (25 + n), 6) AS prior, CASE WHEN n >= 20 AND w = 0 THEN 'dead' WHEN n > 0 AND w / n >= 0.04 THEN 'promising' ELSE 'ambiguous' END AS status FROM s")
def acq06(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("w"))
    return per.select("l_suppkey", F.round(A.updated_prior(F.lit(0.2), F.col("w"), F.col("n")), 6).alias("prior"), A.status(F.col("n"), F.col("w"), F.lit(0)).alias("status"))


@query("acq07_funnel", "WITH n AS (SELECT o_custkey AS k, count(*) AS posts, count(*) FILTER (WHERE o_orderstatus = 'F') AS stacks, count(*) FILTER (WHERE o_orderstatus = 'P') AS ev FROM orders GROUP BY 1) SELECT c_mktsegment AS tier, count(*) AS targets, count(*) FILTER (WHERE c_acctbal > 0) AS crawled, count(*) FILTER (WHERE posts > 0) AS with_posts, count(*) FILTER (WHERE stacks > 0) AS with_stacks, count(*) FILTER (WHERE ev > 0) AS with_events FROM customer LEFT JOIN n ON k = c_custkey GROUP BY 1")
def acq07(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("posts"), F.count_if(F.col("o_orderstatus") == "F").alias("stacks"), F.count_if(F.col("o_orderstatus") == "P").alias("events"))
    return A.funnel(table(spark, d, "customer").join(per, "c_custkey", "left").select(F.col("c_mktsegment").alias("tier"), (F.col("c_acctbal") > 0).alias("crawled"), "posts", "stacks", "events"))


@query(
    "acq08_crossings",
    """WITH b AS (SELECT o_custkey AS v, count(*) AS n FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1), c AS (SELECT o_orderkey % 5 AS arm, o_custkey AS v, count(*) AS n FROM orders WHERE o_orderkey % 5 <= 1 GROUP BY 1, 2),
    x AS (SELECT arm, c.v, coalesce(b.n, 0) AS f, coalesce(b.n, 0) + c.n AS t FROM c LEFT JOIN b ON b.v = c.v) SELECT arm, v AS venue_id, CASE WHEN f = 0 THEN '0_to_1' ELSE '1_5_to_6' END AS crossing, f AS from_n, t AS to_n FROM x WHERE f = 0 OR (f BETWEEN 1 AND 5 AND t >= 6)""",
)
def acq08(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("arm"), F.col("o_custkey").alias("venue_id"))
    baseline = rows.where("arm > 1").groupBy("venue_id").agg(F.count("*").alias("n"))
    return A.crossings(baseline, rows.where("arm <= 1").groupBy("arm", "venue_id").agg(F.count("*").alias("n")))


@query("acq09_strategy_yield", "WITH t AS (SELECT o_orderkey % 7 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'O' THEN 'silver' ELSE 'bronze' END AS tier, CASE WHEN o_orderkey % 2 = 0 THEN 'wedding' ELSE 'not_wedding' END AS label FROM orders) SELECT batch_id, count(*) AS posts, count(*) FILTER (WHERE tier = 'gold' AND label = 'wedding') AS gold_w, count(*) FILTER (WHERE tier = 'gold' AND label <> 'wedding') AS gold_nw, count(*) FILTER (WHERE tier = 'silver' AND label = 'wedding') AS silver_w, count(*) FILTER (WHERE tier = 'bronze') AS bronze_w, CAST(0 AS BIGINT) AS unknown, round(count(*) FILTER (WHERE tier IN ('gold', 'silver') AND label = 'wedding') / count(*), 6) AS per_post, round(count(*) FILTER (WHERE tier IN ('gold', 'silver') AND label = 'wedding') / nullif(batch_id * 10.0, 0), 6) AS per_cost FROM t GROUP BY 1")
def acq09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 7).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "gold").when(F.col("o_orderstatus") == "O", "silver").otherwise("bronze").alias("tier"), F.when(F.col("o_orderkey") % 2 == 0, "wedding").otherwise("not_wedding").alias("label"))
    costs = rows.select("batch_id", (F.col("batch_id") * 10.0).alias("cost")).distinct()
    return A.strategy_yield(rows.select("batch_id", "post_id"), rows.select("post_id", "tier", "label"), costs)


@query("acq12_chunks", "SELECT c_custkey, CAST(ceil(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) / 50.0) AS BIGINT) AS chunk FROM customer")
def acq12(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.operators.helpers import latest_rank

    return latest_rank(table(spark, d, "customer"), ["c_mktsegment"], [F.col("c_custkey")]).select("c_custkey", F.ceil(F.col("rn") / 50.0).alias("chunk"))


@query("stm05_frontier", "SELECT c_custkey AS account_id, c_nationkey % 3 AS hops FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 <= 1 ORDER BY c_nationkey % 3, c_acctbal DESC, c_name LIMIT 40")
def stm05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("username"), (F.col("c_nationkey") % 3).alias("hops"), F.col("c_acctbal").alias("priority"), F.when(F.col("c_acctbal") > 0, "pending").otherwise("crawled").alias("status"))
    return A.next_batch(rows, 1, 40).select("account_id", "hops")


@query("stm06_expansion", "WITH p AS (SELECT l_suppkey, max(CASE l_returnflag WHEN 'A' THEN 0.8 WHEN 'R' THEN 0.35 ELSE 0.1 END) AS p FROM lineitem WHERE l_quantity > 49 GROUP BY 1) SELECT l_suppkey AS account_id, 2 AS hops, CAST(p AS DOUBLE) AS priority, CASE WHEN p > 0.1 THEN 'pending' ELSE 'skipped' END AS status FROM p")
def stm06(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "venue").when(F.col("l_returnflag") == "R", "photographer").otherwise("florist")
    return A.expanded(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("account_id"), role.alias("role")), 1)


@query("stm02_first_observed", "SELECT event_id, user_id, event_id = first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS is_first FROM events")
def stm02(spark: SparkSession, d: str) -> DataFrame:
    """The first observation of each key, from one aggregate instead of a sorted window."""
    events = table(spark, d, "events")
    first = events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))
    return events.join(first, "user_id").select("event_id", "user_id", (F.col("event_id") == F.col("first")).alias("is_first"))


@query("stm03_changes", "SELECT event_id, user_id, md5(event_type) IS DISTINCT FROM md5(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS changed FROM events")
def stm03(spark: SparkSession, d: str) -> DataFrame:
    """Whether content differs from the one observed before, by digest."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digest = F.md5("event_type")
    return table(spark, d, "events").select("event_id", "user_id", (~digest.eqNullSafe(F.lag(digest).over(w))).alias("changed"))


@query(
    "doc03_price_issues",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'nightly_rate' WHEN l_quantity < 20 THEN 'implausible' END AS issue, count(*) AS n FROM lineitem GROUP BY ALL",
)
def doc03(spark: SparkSession, d: str) -> DataFrame:
    quote = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "$200 per night").otherwise("$50 per guest")
    issue = D.price_issue(F.lit("per_guest"), F.col("l_quantity"), quote)
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", issue.alias("issue")).agg(F.count("*").alias("n"))


@query(
    "doc06_version_diff",
    """WITH o AS (SELECT c_custkey AS e, 'segment' AS p, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS e, 'segment' AS p, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(o.e, n.e) AS entity_id, 'segment' AS path, CASE WHEN o.e IS NULL THEN 'added' WHEN n.e IS NULL THEN 'removed' ELSE 'changed' END AS change, o.v AS old, n.v AS new FROM o FULL JOIN n ON o.e = n.e AND o.p = n.p WHERE o.e IS NULL OR n.e IS NULL OR o.v IS DISTINCT FROM n.v""",
)
def doc06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("segment").alias("path"), F.col("c_mktsegment").alias("value"))
    new = rows.where("entity_id % 5 <> 0").withColumn("value", F.when(F.col("entity_id") % 4 == 0, "NEW").otherwise(F.col("value")))
    return D.diff(rows.where("entity_id % 3 <> 0"), new)


@query(
    "doc07_corrections",
    """WITH v AS (SELECT c_custkey AS e, c_mktsegment AS x FROM customer), c AS (SELECT DISTINCT ON (user_id) user_id AS e, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'click' THEN 'unset' ELSE 'set' END AS a, event_type AS x FROM events ORDER BY user_id, ts DESC, event_id)
    SELECT v.e AS entity_id, 'segment' AS path, CASE WHEN c.a = 'set' THEN c.x ELSE v.x END AS value FROM v LEFT JOIN c ON c.e = v.e WHERE c.a IS NULL OR c.a = 'set' UNION ALL SELECT c.e, 'segment', c.x FROM c WHERE c.a = 'set' AND c.e NOT IN (SELECT e FROM v)""",
)
def doc07(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("segment").alias("path"), F.col("c_mktsegment").alias("value"))
    action = F.when(F.col("event_type") == "click", "unset").otherwise("set")
    return D.corrected(values, table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.lit("segment").alias("path"), action.alias("action"), F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query(
    "doc10_headline_capacity",
    """WITH r AS (SELECT l_orderkey AS v, l_suppkey AS s, l_partkey AS m, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 3 END AS k FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'N')
    SELECT DISTINCT ON (v) v AS venue_id, m AS headline, CASE k WHEN 0 THEN 'seated_dinner' WHEN 1 THEN 'seated_with_dance' ELSE 'standing' END AS layout, CAST(s AS VARCHAR) AS space_id, k = 3 AS cocktail_only FROM r ORDER BY v, k, m DESC, CAST(s AS VARCHAR)""",
)
def doc10(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    layout = F.when(flag == "R", "seated_dinner").when(flag == "A", "seated_with_dance").otherwise("standing")
    condition = F.when((flag == "N") & (F.col("l_linestatus") != "F"), "corporate gala")
    caps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("venue_id"), F.col("l_suppkey").cast("string").alias("space_id"), layout.alias("layout"), F.when(flag == "N", "cocktail").otherwise("seated").alias("tile"), F.col("l_partkey").alias("max"), condition.alias("condition"))
    spaces = caps.select("venue_id", "space_id").distinct().withColumn("bookable", F.lit(True))
    return D.headline_capacity(caps, spaces)


@query("doc01_grounding")
def doc01(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as quotes, documents as pages of one entity per language."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.lit("en").alias("entity_id"), F.col("text").alias("quote"), F.lit("https://example.org/0").alias("source_url"))
    pages = table(spark, d, "documents").select(F.col("lang").alias("entity_id"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), "text")
    return D.grounding(quotes, pages)


@query("src10_crawl_order")
def src10(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.functions.urls import crawl_order

    return crawl_order(table(spark, d, "pages"), 20)


@query("srv11_stack_by_category", "WITH x AS (SELECT DISTINCT l_orderkey AS e, CASE l_returnflag WHEN 'R' THEN 'media' WHEN 'A' THEN 'venue' ELSE 'other' END AS c, l_suppkey AS s FROM lineitem), y AS (SELECT e, c, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS names FROM x GROUP BY 1, 2) SELECT e AS event_id, string_agg(c || ': ' || names, '; ' ORDER BY CASE c WHEN 'venue' THEN 1 WHEN 'media' THEN 2 ELSE 3 END) AS stack FROM y GROUP BY 1")
def srv11(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.operators.serving import stack_by_category

    credit = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("role"))
    categories = spark.createDataFrame([("R", "media"), ("A", "venue")], "role string, category string")
    return stack_by_category(credit, categories, ["venue", "media"])


@query(
    "doc12_cost_estimate",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey % 3 AS path, 50 + o_orderkey % 100 AS g, CASE o_orderkey % 3 WHEN 0 THEN 'sat' WHEN 1 THEN 'fri' ELSE 'tue' END AS d FROM orders),
    x AS (SELECT *, CAST(CASE path WHEN 0 THEN 5000 ELSE 3000 + 1000 * path END AS DOUBLE) AS v, CAST(g * CASE WHEN d = 'sat' THEN 120 WHEN d = 'tue' THEN 80 ELSE 100 END AS DOUBLE) AS f FROM r),
    s AS (SELECT *, CAST(floor(f * 20 / 100 + 0.5) AS BIGINT) AS svc FROM x), t AS (SELECT *, CAST(floor((f + svc) * 10.25 / 100 + 0.5) AS BIGINT) AS tax FROM s)
    SELECT id AS request_id, round(v, 2) AS venue, round(f, 2) AS food, svc AS service, tax, round(v + f + svc + tax, 2) AS total, f < 8000 AS under_fb_minimum FROM t""",
)
def doc12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    requests = table(spark, d, "orders").select(k.alias("request_id"), (F.col("o_custkey") % 3).cast("int").alias("path_id"), (50 + k % 100).alias("guests"), F.when(k % 3 == 0, "sat").when(k % 3 == 1, "fri").otherwise("tue").alias("day"), F.lit("summer").alias("season"), F.lit("hall").alias("space_id"), F.lit(False).alias("card"))
    fees = spark.createDataFrame([(0, "Room", 5000.0, "hall", None, None, None), (0, "Whole house", 9000.0, None, None, None, None), (1, "Room", 4000.0, None, None, None, None), (2, "Room", 5000.0, None, "any", None, None), (2, "Brunch special", 700.0, None, None, None, None), (1, "Garden", 800.0, "garden", None, None, None)], "path_id int, label string, amount double, space_id string, day string, season string, hours int")
    tiers = spark.createDataFrame([(p, t, c, y, None) for p in range(3) for t, c, y in ((1, 100.0, None), (2, 120.0, "sat"), (3, 80.0, "weekday"))], "path_id int, tier_id int, per_guest double, day string, season string")
    minimums = spark.createDataFrame([(p, "fb_minimum", 8000.0, None, None) for p in range(3)], "path_id int, kind string, amount double, day string, season string")
    rates = spark.createDataFrame([(p, 20.0, False, 10.25, False, 3.0) for p in range(3)], "path_id int, service_pct double, service_on_all boolean, tax_pct double, tax_on_all boolean, card_pct double")
    return D.cost_estimate(requests, fees, tiers, minimums, rates).drop("card_fee", "under_minimum")
