"""Queries that align two descriptions: spaces of venues, capacities, clusterings of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.operators import clusterings as C
from kithgraph.operators import entities as E
from kithgraph.operators import matching as M
from kithgraph.plans.entities import members
from kithgraph.registry import query
from kithgraph.tables import table

# a customer is a venue; the parts that came back are its golden spaces, the accepted ones those of another document
SPACES_SQL = """x AS (SELECT DISTINCT o_custkey AS v, l_partkey AS k, l_returnflag AS f, p_name || ' ' || p_type || ' ' || p_brand AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    g AS (SELECT v, 'the-part ' || k AS id, name FROM x WHERE f = 'R'), c AS (SELECT v, 'Part_' || k AS id, name FROM x WHERE f = 'A'),
    ids AS (SELECT v, c.id AS l, g.id AS r FROM g JOIN c USING (v) WHERE substr(g.id, 10) = substr(c.id, 6)),
    w AS (SELECT v, c.id AS l, g.id AS r, list_distinct(string_split(trim(regexp_replace(lower(c.name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(g.name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b
      FROM g JOIN c USING (v) WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.v = g.v AND ids.l = c.id) AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.v = g.v AND ids.r = g.id)),
    j AS (SELECT v, l, r, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM w),
    o AS (SELECT v, l, r, row_number() OVER (PARTITION BY v ORDER BY i / (na + nb - i) DESC, l, r) AS n FROM j WHERE i / (na + nb - i) >= 0.5),
    f AS (SELECT DISTINCT v, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs, false AS hit FROM o
      UNION ALL SELECT o.v, o.n, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END,
        NOT (list_contains(ls, l) OR list_contains(rs, r)) FROM f JOIN o ON o.v = f.v AND o.n = f.n + 1),
    named AS (SELECT o.v, o.l, o.r FROM f JOIN o USING (v, n) WHERE hit),
    found AS (SELECT v, l, r, 'id' AS rule FROM ids UNION ALL SELECT v, l, r, 'name' FROM named),
    one_g AS (SELECT v, min(id) AS r FROM g GROUP BY v HAVING count(*) = 1), one_c AS (SELECT v, min(id) AS l FROM c GROUP BY v HAVING count(*) = 1),
    al AS (SELECT * FROM found UNION ALL SELECT v, l, r, 'single' FROM one_c JOIN one_g USING (v) WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.v = one_c.v AND found.l = one_c.l)
      UNION ALL SELECT v, 'whole_venue', r, 'whole_venue' FROM one_g)"""


def capacities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("max"), F.col("l_linestatus").alias("layout"))
    rows = line.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("venue_id")), "o_orderkey")
    side = lambda flag, name: rows.where(F.col("l_returnflag") == flag).select("venue_id", "l_partkey", F.concat(F.lit(name), F.col("l_partkey").cast("string")).alias("space_id"), "layout", "max")
    return side("R", "the-part "), side("A", "Part_")


def documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    golden, candidate = (df.join(part, "l_partkey").select("venue_id", F.col("space_id").alias("id"), "name") for df in capacities(spark, d))
    return golden, candidate


@query("doc17_space_alignment", f"WITH RECURSIVE {SPACES_SQL} SELECT v AS venue_id, l AS candidate_id, r AS golden_id, rule FROM al")
def doc17_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Customers' returned and accepted parts as the spaces of two documents: equal ids, alike names, single spaces."""
    golden, candidate = documents(spark, d)
    return M.aligned_spaces(golden, candidate)


@query(
    "doc17_capacity_score",
    f"""WITH RECURSIVE {SPACES_SQL}, e AS (SELECT DISTINCT o_custkey AS v, l_partkey AS k, l_returnflag AS f, l_linestatus AS y, CAST(trunc(l_quantity) AS INTEGER) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    gc AS (SELECT v, 'the-part ' || k AS s, y, m FROM e WHERE f = 'R'), cc AS (SELECT DISTINCT e.v, coalesce(al.r, 'Part_' || k) AS s, y, m FROM e LEFT JOIN al ON al.v = e.v AND al.l = 'Part_' || k WHERE f = 'A'),
    said AS (SELECT v, s, y, list(m) AS ms FROM cc GROUP BY ALL), t AS (SELECT v, count(*) AS golden, count(ms) AS found, count(*) FILTER (WHERE list_contains(ms, m)) AS "right" FROM gc LEFT JOIN said USING (v, s, y) GROUP BY v),
    x2 AS (SELECT v, count(*) AS extra FROM cc WHERE NOT EXISTS (SELECT 1 FROM gc WHERE gc.v = cc.v AND gc.s = cc.s AND gc.y = cc.y) GROUP BY v)
    SELECT v AS venue_id, golden, found, "right", coalesce(extra, 0) AS extra FROM t LEFT JOIN x2 USING (v)""",
)
def doc17_capacities(spark: SparkSession, d: str) -> DataFrame:
    """The quantities as capacities of those spaces, compared after the alignment."""
    return M.capacity_score(*capacities(spark, d), M.aligned_spaces(*documents(spark, d)))


CHAINS_SQL = """e AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY c ORDER BY d, k), d) AS gap FROM e),
    s AS (SELECT *, sum(CASE WHEN gap <= 90 THEN 0 ELSE 1 END) OVER w AS x, sum(CASE WHEN gap <= 270 THEN 0 ELSE 1 END) OVER w AS y FROM g WINDOW w AS (PARTITION BY c ORDER BY d, k)),
    q AS (SELECT c || ':' || x AS a, c || '/' || extract(year FROM d) AS b, c || '-' || y AS l FROM s)"""


def chains(spark: SparkSession, d: str, days: int) -> DataFrame:
    """Orders of a customer in chains with gaps of so many days at most, as a clustering."""
    w = Window.partitionBy("o_custkey").orderBy("date", "o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    rows = rows.withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    return rows.select(F.col("o_orderkey").alias("item"), F.concat_ws(":", F.col("o_custkey").cast("string"), F.sum(F.when(F.col("gap") <= days, 0).otherwise(1)).over(w).cast("string")).alias("cluster"))


def years(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer and year as a clustering."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("cluster"))


@query(
    "er03_clusterings_compared",
    f"""WITH {CHAINS_SQL}, n AS (SELECT a, b, count(*) AS n FROM q GROUP BY ALL), na AS (SELECT a, sum(n) AS n, count(*) AS p, max(n) AS m FROM n GROUP BY a), nb AS (SELECT b, sum(n) AS n, count(*) AS p FROM n GROUP BY b),
    t AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM na) AS ta, (SELECT sum(n * (n - 1) // 2) FROM nb) AS tb, (SELECT sum(n * (n - 1) // 2) FROM n) AS tt, (SELECT count(*) FROM q) AS items),
    u AS (SELECT *, items * (items - 1) / 2 AS every FROM t)
    SELECT items, (SELECT count(*) FROM na) AS clusters_a, (SELECT count(*) FROM nb) AS clusters_b, (SELECT count(*) FROM n JOIN na USING (a) JOIN nb USING (b) WHERE na.p = 1 AND nb.p = 1) AS same, (SELECT count(*) FROM nb WHERE p > 1) AS merges,
      (SELECT count(*) FROM na WHERE p > 1) AS splits, CAST((SELECT sum(n - m) FROM na) AS BIGINT) AS moved, CAST(ta AS BIGINT) AS together_a, CAST(tb AS BIGINT) AS together_b, CAST(tt AS BIGINT) AS together_both,
      round((every + 2 * tt - ta - tb) / every, 9) AS rand, round((tt - ta * (tb / every)) / ((ta + tb) / 2 - ta * (tb / every)), 9) AS adjusted_rand FROM u""",
)
def er03_compared(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a customer's orders within 90 days against the customer's calendar years."""
    return C.compared(chains(spark, d, 90), years(spark, d))


@query("er03_merged_clusters", f"WITH {CHAINS_SQL}, n AS (SELECT replace(l, '-', ':') AS b, a, count(*) AS n FROM q GROUP BY ALL) SELECT b AS cluster_b, a AS cluster_a, n, CAST(sum(n) OVER (PARTITION BY b) AS BIGINT) AS n_b, count(*) OVER (PARTITION BY b) AS parts FROM n QUALIFY parts > 1")
def er03_merged(spark: SparkSession, d: str) -> DataFrame:
    """What chains within 270 days merge of those within 90."""
    return C.merged_clusters(chains(spark, d, 90), chains(spark, d, 270))


@query("er03_sizes", f"WITH {CHAINS_SQL}, n AS (SELECT a, count(*) AS n FROM q GROUP BY a) SELECT count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singles, count(*) FILTER (WHERE n = 2) AS couples, count(*) FILTER (WHERE n > 2) AS larger, max(n) AS largest FROM n")
def er03_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.sizes(chains(spark, d, 90))


@query("er03_fold_variants")
def er03_variants(spark: SparkSession, d: str) -> DataFrame:
    """The strict fold of all orders against the inclusive one and the one that takes the best event, a row each."""
    posts = members(spark, d)
    named = posts.select("id", "date", F.transform("members", lambda m: F.concat_ws(":", F.col("block").cast("string"), m.cast("string"))).alias("members"))
    rows = E.fold_rows(named).checkpoint()
    fold = lambda **how: E.greedy_events(named, rows=rows, **how).select(F.col("post_id").alias("item"), F.col("event_id").alias("cluster"))
    strict, out = fold().checkpoint(), None
    for name, how in (("inclusive", {"inclusive": True}), ("best-match", {"best": True}), ("inclusive-best-match", {"inclusive": True, "best": True})):
        row = C.compared(strict, fold(**how)).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
