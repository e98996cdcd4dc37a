"""Queries about venues' documents: what they cost at least and at most, their leaves, and what they must not say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import pages as P
from kithgraph.operators import mustnot as N
from kithgraph.operators import ranges as R
from kithgraph.operators import trees as T
from kithgraph.registry import query
from kithgraph.tables import table

DAY_SQL = "CASE WHEN l_quantity < 8 THEN NULL ELSE ['sun', 'weekday', 'weekday', 'weekday', 'weekday', 'fri', 'sat'][1 + dayofweek(l_shipdate)] END"
SEASON_SQL = "CASE WHEN l_tax < 0.03 THEN NULL WHEN month(l_shipdate) BETWEEN 5 AND 10 THEN 'peak' ELSE 'off' END"
# an order is a venue, the flags of its lines are its paths; filled lines are fees, open ones tiers
PRICES_SQL = f"""x AS (SELECT l_orderkey AS v, l_returnflag AS p, l_linenumber AS n, l_linestatus AS s, l_extendedprice AS amount, CAST(l_suppkey % 3 AS VARCHAR) AS sp, l_quantity AS q, {DAY_SQL} AS d, {SEASON_SQL} AS y, CAST(l_partkey % 4 AS VARCHAR) AS nm, l_discount, l_tax FROM lineitem),
    paths AS (SELECT v, p, 20 + min(n) * 10 AS least, 20 + min(n) * 10 + count(*) * 25 AS most, min(sp) AS sp FROM x GROUP BY v, p),
    f AS (SELECT v, p, n, amount, CASE WHEN q < 30 THEN sp END AS fs, d, y FROM x WHERE s = 'F'), t AS (SELECT v, p, n, q AS per_guest, nm, d, y FROM x WHERE s = 'O'),
    rates AS (SELECT v, round(max(l_discount) * 100) AS sv, bool_or(l_discount > 0.08) AS sa, round(max(l_tax) * 100) AS tx, bool_or(l_tax > 0.07) AS ta FROM x GROUP BY v)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as venues with price lists; all that a venue has meets in one of four times the usual tasks, so a task holds little."""
    names = F.array(*map(F.lit, ["sun", "weekday", "weekday", "weekday", "weekday", "fri", "sat"]))
    day = F.when(F.col("l_quantity") >= 8, F.get(names, F.dayofweek("l_shipdate") - 1))
    season = F.when(F.col("l_tax") >= 0.03, F.when(F.month("l_shipdate").between(5, 10), "peak").otherwise("off"))
    space = (F.col("l_suppkey") % 3).cast("string")
    rows = table(spark, d, "lineitem").select("*", F.col("l_orderkey").alias("venue_id"), F.col("l_returnflag").alias("path_id"), day.alias("day"), season.alias("season"), space.alias("space"))
    rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "venue_id")
    first = F.min("l_linenumber") * 10 + 20
    paths = rows.groupBy("venue_id", "path_id").agg(first.alias("min_guests"), (first + F.count("*") * 25).alias("max_guests"), F.min("space").alias("space_id"))
    fees = rows.where("l_linestatus = 'F'").select("venue_id", "path_id", F.col("l_linenumber").alias("place"), F.lit("Rental").alias("label"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_quantity") < 30, F.col("space")).alias("space_id"), "day", "season")
    tiers = rows.where("l_linestatus = 'O'").select("venue_id", "path_id", F.col("l_linenumber").alias("place"), F.col("l_linenumber").cast("string").alias("tier_id"), (F.col("l_partkey") % 4).cast("string").alias("name"), F.col("l_quantity").alias("per_guest"), "day", "season")
    rates = rows.groupBy("venue_id").agg(F.round(F.max("l_discount") * 100).alias("service_pct"), F.bool_or(F.col("l_discount") > 0.08).alias("service_on_all"), F.round(F.max("l_tax") * 100).alias("tax_pct"), F.bool_or(F.col("l_tax") > 0.07).alias("tax_on_all"))
    return R.priced_paths(paths, fees, tiers, rates)


@query(
    "doc14_cost_extremes",
    f"""WITH {PRICES_SQL}, axes AS (SELECT d, y FROM (SELECT unnest(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun']) AS d), (SELECT unnest(['peak', 'off']) AS y)),
    c AS (SELECT v, p, sp, axes.d, axes.y FROM paths, axes), fits AS (SELECT c.v, c.p, c.sp, c.d, c.y, f.amount, f.fs FROM c JOIN f ON f.v = c.v AND f.p = c.p AND (f.d IS NULL OR f.d = c.d OR (f.d = 'weekday' AND c.d IN ('mon', 'tue', 'wed', 'thu'))) AND (f.y IS NULL OR f.y = c.y)),
    own AS (SELECT DISTINCT f.v, f.p FROM f JOIN paths ON paths.v = f.v AND paths.p = f.p AND f.fs = paths.sp),
    vf AS (SELECT v, p, d, y, sum(amount) FILTER (WHERE fs = sp OR (fs IS NULL AND (v, p) NOT IN (SELECT (v, p) FROM own))) AS venue FROM fits GROUP BY ALL),
    tf AS (SELECT c.v, c.p, c.d, c.y, t.per_guest FROM c JOIN t ON t.v = c.v AND t.p = c.p AND (t.d IS NULL OR t.d = c.d OR (t.d = 'weekday' AND c.d IN ('mon', 'tue', 'wed', 'thu'))) AND (t.y IS NULL OR t.y = c.y)
      QUALIFY row_number() OVER (PARTITION BY c.v, c.p, c.d, c.y, t.nm ORDER BY CASE WHEN t.d IS NULL THEN 0 WHEN t.d = 'weekday' THEN 1 ELSE 2 END + CASE WHEN t.y IS NULL THEN 0 ELSE 1 END DESC, t.n, t.per_guest) = 1),
    g AS (SELECT v, p, least AS guests FROM paths UNION ALL SELECT v, p, most FROM paths),
    w AS (SELECT c.v, c.p, coalesce(venue, 0) AS venue, coalesce(per_guest, 0) * guests AS food FROM c JOIN g ON g.v = c.v AND g.p = c.p LEFT JOIN vf ON vf.v = c.v AND vf.p = c.p AND vf.d = c.d AND vf.y = c.y LEFT JOIN tf ON tf.v = c.v AND tf.p = c.p AND tf.d = c.d AND tf.y = c.y),
    s AS (SELECT w.*, floor((food + CASE WHEN sa THEN venue ELSE 0 END) * sv / 100 + 0.5) AS service, tx, ta FROM w JOIN rates ON rates.v = w.v),
    z AS (SELECT v, p, round(venue + food + service + floor((food + service + CASE WHEN ta THEN venue ELSE 0 END) * tx / 100 + 0.5), 2) AS total FROM s)
    SELECT v AS venue_id, min(total) AS low, min_by(p, (total, p)) AS low_path, max(total) AS high, min_by(p, (-total, p)) AS high_path FROM z GROUP BY v""",
)
def doc14_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The least and greatest cost of every venue; the SQL prices every combination."""
    return R.extremes(prices(spark, d))


@query("doc14_shown_range")
def doc14_range(spark: SparkSession, d: str) -> DataFrame:
    """The example range of every path."""
    return R.shown_range(prices(spark, d))


# an order is a document, its lines are the members of an array in the order of their numbers
DOCS_SQL = """l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, l_returnflag AS flag, l_partkey AS max, l_suppkey AS min, p_name AS name,
      CASE WHEN l_linestatus = 'O' THEN 'https://' || p_type END AS url FROM lineitem JOIN part ON p_partkey = l_partkey), o AS (SELECT o_orderkey AS id, o_orderpriority AS kind, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders)"""


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc): every order with its lines as JSON."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    line = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("max"), F.col("l_suppkey").alias("min"), F.col("p_name").alias("name"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("https://"), "p_type")).alias("url"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", line.alias("line"))
    lines = table(spark, d, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("lines"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    empty = F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType))
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.col("o_orderpriority").alias("kind"), empty.alias("lines"), F.struct(F.col("o_totalprice").cast("long").alias("price"), F.lit(None).cast("string").alias("none")).alias("pricing"))).alias("doc"))


@query(
    "doc02_path_rows",
    f"""WITH {DOCS_SQL}, x AS (SELECT id, '/lines[' || i || ']' AS p, * EXCLUDE (id) FROM l)
    SELECT id AS doc_id, '/kind' AS path, 'string' AS kind, kind AS value FROM o UNION ALL SELECT id, '/pricing/price', 'number', CAST(price AS VARCHAR) FROM o
    UNION ALL SELECT id, p || '/flag', 'string', flag FROM x UNION ALL SELECT id, p || '/max', 'number', CAST(max AS VARCHAR) FROM x UNION ALL SELECT id, p || '/min', 'number', CAST(min AS VARCHAR) FROM x
    UNION ALL SELECT id, p || '/name', 'string', name FROM x UNION ALL SELECT id, p || '/url', 'string', url FROM x WHERE url IS NOT NULL UNION ALL SELECT id, '/lines', 'array', NULL FROM o WHERE id NOT IN (SELECT id FROM l)""",
)
def doc02_rows(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of all orders' documents."""
    return T.nodes(order_documents(spark, d), holding=False)


@query(
    "doc02_round_trip",
    f"""WITH {DOCS_SQL}, j AS (SELECT id, '[' || string_agg('{{"flag":"' || flag || '","max":' || max || ',"min":' || min || ',"name":"' || name || '"' || CASE WHEN url IS NULL THEN '' ELSE ',"url":"' || url || '"' END || '}}', ',' ORDER BY i) || ']' AS lines FROM l GROUP BY id)
    SELECT o.id AS doc_id, '{{"kind":"' || kind || '","lines":' || coalesce(lines, '[]') || ',"pricing":{{"price":' || price || '}}}}' AS doc FROM o LEFT JOIN j USING (id)""",
)
def doc02_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All orders' documents out of their rows again, members by name."""
    return T.documents(T.nodes(order_documents(spark, d)), in_runs=True)


@query("doc02_props_rows", "SELECT event_id AS doc_id, '/k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS value FROM events")
def doc02_props(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc")), holding=False)


def page_claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of what pages say of themselves and of the next page, and the pages' texts as what it is grounded in."""
    from pyspark.sql import Window

    rows = P.structures(table(spark, d, "pages")).select("page_id", "url", "title", "text", "links")
    rows = rows.withColumn("next", F.lead("title").over(Window.partitionBy(F.pmod(F.xxhash64("url"), F.lit(64))).orderBy("page_id")))
    claim = lambda text: F.struct(F.lit("stated").alias("status"), text.alias("value"), text.alias("quote"), F.col("url").alias("source_url"))
    items = F.transform("links", lambda x: F.struct(x["href"].alias("id"), x["text"].alias("quote"), F.col("url").alias("source_url")))
    doc = F.to_json(F.struct(F.struct(claim(F.col("title")).alias("title"), claim(F.coalesce("next", F.lit(""))).alias("motto")).alias("spine"), items.alias("links"), F.lit("none").alias("faqs")))
    return rows.select(F.col("page_id").alias("doc_id"), doc.alias("doc")), rows.select(F.col("page_id").alias("doc_id"), "url", "text")


@query("doc02_assembly")
def doc02_assembly(spark: SparkSession, d: str) -> DataFrame:
    """What pages claim, assembled: counts, and a digest of what is left of each document."""
    docs, pages = page_claims(spark, d)
    kept, _, counts = T.assembled(docs, pages, [T.Rule("/spine/*", "demote", "ungrounded_spine", "error", "critical", True), T.Rule("/links[*]")], ("/faqs", "/spaces"))
    return kept.join(counts, "doc_id", "left").select("doc_id", F.md5("doc").alias("doc_md5"), "checked", "passed", "failed", "critical", "needs_review")


MUST_NOT = [
    ("no_hot_parts", "match", "/lines[*]/name", "^hot (gear|bolt)$", None, "gear", None, None, None),
    ("no_wide_span", "span", "/lines[*]/max", "150", "min", None, None, None, None),
    ("no_twins", "twins", "/lines[*]/name", r"\bsmall\b", None, None, None, None, None),
    ("no_returns", "share", "/lines[*]/flag", "^R$", "0.5", None, "/kind", "1-URGENT", None),
    ("no_unlinked", "alone", "/lines[*]/name", "Red Ring|blue-bolt", "url", None, None, None, None),
    ("one_of", "one_of", "/lines[*]/name", "red ring|hot gear|small bolt|blue widget", None, None, None, None, None),
]


@query(
    "doc18_must_not",
    f"""WITH {DOCS_SQL}, x AS (SELECT l.*, '/lines[' || i || ']' AS p, o.kind FROM l JOIN o USING (id)), t AS (SELECT *, regexp_replace(regexp_replace(lower(name), '\\bsmall\\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS k FROM x)
    SELECT id AS doc_id, 'no_hot_parts' AS rule_id, p || '/name' AS path, name AS value FROM x WHERE name = 'hot bolt' UNION ALL SELECT id, 'no_wide_span', p || '/max', CAST(max AS VARCHAR) FROM x WHERE min > 0 AND max / min > 150
    UNION ALL SELECT id, 'no_twins', p || '/name', name FROM t WHERE k <> '' QUALIFY count(*) OVER (PARTITION BY id, k) > 1
    UNION ALL SELECT id, 'no_returns', '/lines[0]/flag', max(flag) FILTER (WHERE i = 0) FROM x WHERE kind = '1-URGENT' GROUP BY id HAVING count(*) FILTER (WHERE flag = 'R') / count(*) > 0.5
    UNION ALL SELECT id, 'no_unlinked', p || '/name', name FROM x WHERE name IN ('red ring', 'blue bolt') AND url IS NULL
    UNION ALL SELECT id, 'one_of', p || '/name', name FROM x WHERE name IN ('red ring', 'hot gear', 'small bolt', 'blue widget') QUALIFY count(*) OVER (PARTITION BY id) > 1""",
)
def doc18_must_not(spark: SparkSession, d: str) -> DataFrame:
    """What all orders' documents say against a table of rules."""
    return N.violations(T.nodes(order_documents(spark, d), holding=False), spark.createDataFrame(MUST_NOT, N.RULES))
