"""Queries of current rows, batches, checks, titles, readiness and lookups, on the test tables; captions are samples that every customer has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import checks as C
from kithgraph.operators import currency as U
from kithgraph.operators import helpers as H
from kithgraph.plans.vocabulary import spread
from kithgraph.registry import query
from kithgraph.tables import table

#: Captions that meet every rule of the title and mention queries at least once.
CAPTIONS = [
    (1, "Emily and JAMES's wedding was a dream\nPhoto: @lens.one"), (2, "Mr. & Mrs. o'brien forever"), (3, "Inside the Kowalski wedding at the barn"),
    (4, "anna x BEN, summer light"), (5, "Hair & Makeup by @glam"), (6, "Zoe + Max"), (7, "black and white portraits"), (8, None), (9, ""),
    (10, "Sara's Baby Shower\nVenue: @hall"), (11, "Corporate gala 2024\n@hall"), (12, "Birthday of the bride, just married\nfun"),
    (13, "a very long first line about a birthday party that goes on and on beyond sixty signs\nSweet 16 night"), (14, "@birthday.shop birthday\nno title here"),
    (15, "Their wedding at @hall with @lens.one"), (16, "wedding reception @barn @hall @nobody"), (17, "bride and groom"), (18, "tied the knot | quinceañera"),
]
ACCOUNTS = [(1, "Hall", "venue"), (2, "barn", "venue"), (3, "lens.one", "photographer"), (4, "glam", "makeup")]
BLOCKED = ["hair", "makeup", "black", "white", "venue", "catering", "bride", "groom", "photo", "the", "married"]


def values(rows: list[tuple], name: str, columns: str) -> str:
    """Rows as a SQL common table."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


CAP = values(CAPTIONS, "sample", "id, caption") + ", cap AS (SELECT c_custkey * 100 + id AS id, caption || chr(10) || 'for ' || c_mktsegment AS caption FROM sample, customer)"
ACC = values(ACCOUNTS, "acc", "account_id, username, role")


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's posts with the sample captions, which end with the customer's segment."""
    return spread(spark, d, CAPTIONS, "id long, caption string").select((F.col("c_custkey") * 100 + F.col("id")).alias("id"), F.concat("caption", F.lit("\nfor "), "c_mktsegment").alias("caption"))


@query("snk03_conditional_delete", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.09)")
def snk03(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 49 and l_returnflag = 'R' and l_discount > 0.09")
    return U.deleted_without(table(spark, d, "supplier"), lines.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey").select("s_suppkey", "s_name")


@query("src12_text_cache", "SELECT sha256(text) AS address, count(*) AS n_refs, min(doc_id) AS first_key, any_value(length(text)) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def src12(spark: SparkSession, d: str) -> DataFrame:
    return U.text_cache(table(spark, d, "documents"), "text", "doc_id").select("address", "n_refs", "first_key", F.char_length("text").cast("long").alias("n_chars"))


@query("prj02_prefer_address", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name) AS profile, coalesce(n_name, c_mktsegment) AS card FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def prj02(spark: SparkSession, d: str) -> DataFrame:
    """The profile prefers one source, the card the other."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("profile"), F.coalesce("n_name", "c_mktsegment").alias("card"))


@query("prj03_profile_url", "SELECT s_suppkey, 'https://example.org/' || lower(replace(s_name, '#', '')) || '/' AS url FROM supplier")
def prj03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://example.org/"), F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit("/")).alias("url"))


@query("win12_seeded_shuffle", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('seed-7|' || c_custkey), c_custkey) AS place FROM customer")
def win12(spark: SparkSession, d: str) -> DataFrame:
    """A shuffle per group that a seed fixes, by the order of hashes."""
    order = [F.md5(F.concat(F.lit("seed-7|"), F.col("c_custkey").cast("string"))), F.col("c_custkey")]
    return H.latest_rank(table(spark, d, "customer"), ["c_nationkey"], order).select("c_custkey", F.col("rn").cast("long").alias("place"))


@query("win13_sample_by_venue", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) <= 3")
def win13(spark: SparkSession, d: str) -> DataFrame:
    return H.stratified_sample(table(spark, d, "customer"), "c_nationkey", "c_custkey", 3).select("c_nationkey", "c_custkey", "c_name")


REVIEW_SQL = """o_orderstatus = 'P' DESC, CASE WHEN o_totalprice >= 300000 THEN 0 WHEN o_totalprice >= 150000 THEN 1 ELSE 2 END, o_orderpriority LIKE '1%' DESC,
    o_orderpriority LIKE '2%' DESC, o_orderkey % 2 = 0, o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderpriority, o_orderkey"""


@query("srt03_review_order", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {REVIEW_SQL}) AS place FROM orders")
def srt03(spark: SparkSession, d: str) -> DataFrame:
    """Nine keys: booleans, a bucket, dates and values; numbered per venue, so no task orders the whole queue."""
    price, rank = F.col("o_totalprice"), F.col("o_orderpriority")
    bucket = F.when(price >= 300_000, 0).when(price >= 150_000, 1).otherwise(2)
    keys = [(F.col("o_orderstatus") == "P").desc(), bucket, F.startswith(rank, F.lit("1")).desc(), F.startswith(rank, F.lit("2")).desc(), F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").desc_nulls_last(), price.desc(), rank, F.col("o_orderkey")]
    return H.latest_rank(table(spark, d, "orders"), ["o_custkey"], keys).select("o_orderkey", F.col("rn").cast("long").alias("place"))


@query("dat03_rounded_days", "SELECT l_orderkey, l_linenumber, CAST(abs(round(epoch(l_shipdate - o_orderdate) / 86400.0)) AS BIGINT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def dat03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return rows.select("l_orderkey", "l_linenumber", F.abs(F.round(seconds / 86_400)).cast("long").alias("days"))


OLD = [(i, r) for i, r in enumerate([*C.OLD_ROLES, "unheard_of", None])]


@query("txt07_old_roles", f"WITH {values(OLD, 'r', 'id, role')}, {values(list(C.OLD_ROLES.items()), 'm', 'role, slug')} SELECT c_custkey * 100 + id AS id, coalesce(slug, 'other') AS slug FROM customer, r LEFT JOIN m USING (role)")
def txt07(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, OLD, "id long, role string").select((F.col("c_custkey") * 100 + F.col("id")).alias("id"), C.mapped(F.col("role"), C.OLD_ROLES, F.lit("other")).alias("slug"))


@query(
    "txt09_event_title",
    f"""WITH {CAP}, l AS (SELECT id, caption, generate_subscripts(string_split(caption, chr(10)), 1) AS i, trim(unnest(string_split(caption, chr(10)))) AS line FROM cap),
    t AS (SELECT id, min_by(line, i) AS title FROM l WHERE line <> '' AND length(line) <= 60 AND NOT contains(line, '@') AND regexp_matches(line, '{C.OTHER_TITLE}') AND NOT regexp_matches(caption, '{C.RECAP}') GROUP BY 1)
    SELECT cap.id, title FROM cap LEFT JOIN t ON t.id = cap.id""",
)
def txt09(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("id", C.other_event_title(F.col("caption")).alias("title"))


NAMES_OUT = ", ".join(f"'{w}'" for w in BLOCKED)
CASED = lambda w: f"CASE WHEN {w} = upper({w}) OR {w} = lower({w}) THEN upper({w}[1]) || lower({w}[2:]) ELSE {w} END"
WORD = "([A-Za-z][A-Za-z''’-]*)"


def sql_pair(name: str, pattern: str, two: bool = True) -> str:
    a, b = f"regexp_extract(trim(caption), '{pattern}', 1)", f"regexp_extract(trim(caption), '{pattern}', 2)"
    good = lambda w: f"length({w}) >= 2 AND lower({w}) NOT IN ({NAMES_OUT})"
    shown = f"{CASED('(' + a + ')')} || ' & ' || {CASED('(' + b + ')')}" if two else f"'The ' || {CASED('(' + a + ')')}"
    return f"CASE WHEN {good(a)}{' AND ' + good(b) if two else ''} THEN {shown} END AS {name}"


TITLES = ", ".join([
    sql_pair("t1", rf"(?i)\b{WORD}\s*(?:and|&|\+)\s*{WORD}''s\s+wedding\b"), sql_pair("t2", rf"(?i)\bMrs?\.?\s*(?:&|and)\s*Mrs\.?\s+{WORD}\b", False),
    sql_pair("t3", r"\bthe\s+([A-Z][A-Za-z''’-]*)\s+wedding\b", False), sql_pair("t4", rf"(?i)\b{WORD}\s+x\s+{WORD}\b"), sql_pair("t5", rf"(?i)\b{WORD}\s*(?:\+|&|and)\s*{WORD}\b"),
])


@query("str13_couple_title", f"WITH {CAP} SELECT id, coalesce(t1, t2, t3, t4, t5) AS title FROM (SELECT id, {TITLES} FROM cap)")
def str13(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("id", C.couple_title(F.col("caption"), BLOCKED).alias("title"))


@query(
    "ev04_inline_venues",
    f"""WITH {CAP}, {ACC}, m AS (SELECT id, caption, lower(unnest(regexp_extract_all(caption, '@([a-zA-Z0-9_.]+)', 1))) AS handle FROM cap)
    SELECT DISTINCT id, account_id, 'venue' AS role FROM m JOIN acc ON lower(username) = handle AND role = 'venue' WHERE regexp_matches(caption, '(?i)(their wedding|wedding reception|wedding at )') AND id % 100 <> 15""",
)
def ev04(spark: SparkSession, d: str) -> DataFrame:
    """Venues that a recap mentions in passing, for posts that have no venue yet."""
    told = captions(spark, d).where(F.col("caption").rlike("(?i)(their wedding|wedding reception|wedding at )"))
    handle = told.select("id", F.explode(F.regexp_extract_all("caption", F.lit("@([a-zA-Z0-9_.]+)"), F.lit(1))).alias("h"))
    venue = spark.createDataFrame(ACCOUNTS, "account_id long, username string, role string").where("role = 'venue'")
    has_venue = captions(spark, d).where("id % 100 = 15").select("id")
    return handle.join(venue, F.lower("h") == F.lower("username")).select("id", "account_id", "role").distinct().join(has_venue, "id", "left_anti")


@query(
    "ev06_edges_of_batch",
    """WITH f AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3), c AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem JOIN f ON l_orderkey = o_orderkey)
    SELECT a.p AS a, b.p AS b, count(*) AS n_events FROM c a JOIN c b ON a.e = b.e AND a.p < b.p GROUP BY 1, 2""",
)
def ev06(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the events first seen in one batch: the batch cuts the line items before they are grouped."""
    sightings = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).alias("batch_id"), F.lit(True).alias("is_first"))
    lines = U.of_batch(table(spark, d, "lineitem"), sightings, F.col("batch_id") == 3, "l_orderkey")
    seen = lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("p")).distinct()
    met = seen.select("event_id", F.col("p").alias("a")).join(seen.select("event_id", F.col("p").alias("b")), "event_id").where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n_events"))


@query(
    "ev07_content_corpus",
    """WITH r AS (SELECT user_id AS post_id, event_id, event_type AS decision, ts FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT c_custkey AS post_id, round(c_acctbal, 2) AS score, decision, n_name AS vendor FROM customer JOIN r ON r.post_id = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""",
)
def ev07(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("post_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "view", "v3").otherwise("v2").alias("version"), F.col("event_type").alias("decision"), F.col("ts").alias("at"))
    c = table(spark, d, "customer")
    vendors = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("vendor_id"), F.col("n_name").alias("vendor"))
    scores = c.select(F.col("c_custkey").alias("post_id"), F.round("c_acctbal", 2).alias("score"))
    return U.content_corpus(scores, runs, c.select(F.col("c_custkey").alias("post_id"), F.col("c_nationkey").alias("vendor_id")), vendors, "v3").select("post_id", "score", "decision", "vendor")


@query("ev09_confirmed_content", "SELECT o_orderkey AS post_id FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND n_regionkey = 1)")
def ev09(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.when(F.col("o_orderstatus") == "F", "INCLUDE").otherwise("EXCLUDE").alias("decision"))
    homes = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    places = table(spark, d, "orders").join(homes, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("post_id"), F.when(F.col("n_regionkey") == 1, "CONFIRMED").otherwise("UNKNOWN").alias("status"))
    return U.confirmed_content(golden, places).select("post_id")


@query(
    "ev13_current_rows",
    """WITH l AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, max(event_id) FILTER (WHERE event_type = 'click') AS click, max(event_id) FILTER (WHERE event_type = 'view') AS view, max(event_id) FILTER (WHERE event_type = 'error') AS error FROM l GROUP BY 1""",
)
def ev13(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each log side by side: latest per key in one aggregate, without a join per log."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))["event_id"].alias(kind)
    return table(spark, d, "events").groupBy("user_id").agg(*[last(k) for k in ("click", "view", "error")])


@query(
    "stm09_stale",
    """WITH c AS (SELECT user_id, event_type AS version, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id FROM c WHERE version <> 'click' OR value < 5 OR ts < TIMESTAMP '2024-01-15 00:00:00'""",
)
def stm09(spark: SparkSession, d: str) -> DataFrame:
    now = U.current(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("version"), F.col("value").alias("confidence"), F.col("ts").alias("at"))
    return U.stale(now, behind="click", below=5, before=F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id")


@query(
    "er05_without_venue",
    """WITH v AS (SELECT o_custkey AS venue, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
    SELECT o_orderkey AS candidate_id, first AS matched_event_id, first IS NOT NULL AS venue_match FROM orders LEFT JOIN v ON v.venue = o_custkey WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""",
)
def er05(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without a venue are left out; those at a venue without events keep a row that says so."""
    o = table(spark, d, "orders")
    venue = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    candidates = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("candidate_id"), venue.alias("venue")).where("venue is not null")
    first = o.where("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("venue")).agg(F.min("o_orderkey").alias("matched_event_id"))
    return candidates.join(first, "venue", "left").select("candidate_id", "matched_event_id", F.col("matched_event_id").isNotNull().alias("venue_match"))


@query(
    "er15_payload_twins",
    "WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' !' ELSE '...' END), '[^a-z0-9]+', '', 'g') AS key FROM part) SELECT key, count(*) AS n, min(p_partkey) AS survivor FROM k GROUP BY 1 HAVING count(*) > 1",
)
def er15(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one owner that are the same text but for punctuation, case and blanks."""
    raw = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " !").otherwise("..."))
    return table(spark, d, "part").groupBy(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "").alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("survivor")).where("n > 1")


@query(
    "cls04_result_errors",
    """SELECT event_id, array_to_string([y FOR y IN [CASE WHEN value < 0 OR value > 60 THEN 'confidence' END, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'decision' END,
      CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'no_reason' END, CASE WHEN event_id % 6 = 5 THEN 'tier' END] IF y IS NOT NULL], ',') AS errors FROM events""",
)
def cls04(spark: SparkSession, d: str) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    decision = F.when(kind == "click", "INCLUDE").when(kind == "view", "EXCLUDE").when(kind == "error", "REVIEW").otherwise(kind)
    tier = F.when(i % 6 == 5, "unknown").when(i % 6 < 2, "prefilter").when(i % 6 < 4, "cheap").otherwise("strong")
    none = F.lit(None).cast("double")
    found = C.result_errors(decision, tier, F.col("value") / 60, F.when(i % 2 == 1, "promo"), F.lit(None).cast("date"), none)
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("errors"))


@query(
    "cls10_identity",
    """WITH w AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, c_nationkey AS nk, c_acctbal AS b FROM customer LEFT JOIN w ON o_custkey = c_custkey)
    SELECT k, CASE WHEN k % 17 = 0 THEN 'merged_away' WHEN k % 19 = 0 THEN 'not_a_venue' WHEN n = 0 AND k % 5 = 0 THEN 'chain_brand' WHEN n >= 1 AND nk >= 15 THEN 'geo_blocked' WHEN n >= 1 AND b < 0 THEN 'mis_anchored' WHEN n >= 1 THEN 'merged_away'
      WHEN k % 7 = 0 THEN 'dead_feed' WHEN b > 2000 AND k % 2 = 0 THEN 'never_crawled' ELSE 'no_identity' END AS bucket FROM c""",
)
def cls10(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left")
    k, true = F.col("c_custkey"), F.lit(True)
    bucket = C.identity_bucket(k % 17 == 0, k % 19 == 0, k % 5 == 0, F.coalesce("n", F.lit(0)), true, F.col("c_nationkey") < 15, F.col("c_acctbal") >= 0, F.when(k % 7 == 0, "dead"), F.col("c_acctbal") > 2_000, k % 2)
    return rows.select(k.alias("k"), bucket.alias("bucket"))


@query("cls11_label_decisions", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'REVIEW' END AS decision FROM events")
def cls11(spark: SparkSession, d: str) -> DataFrame:
    """Labels of people as decisions; labels that say nothing of the post give none."""
    names = F.array(*[F.lit(x) for x in ("WEDDING", "NOT_WEDDING", "UNSURE", "UNVIEWABLE", "SKIP")])
    label = F.get(names, (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select("event_id", C.mapped(label, C.HUMAN_LABELS).alias("decision"))


@query(
    "evl02_ship_report",
    """WITH a AS (SELECT user_id, event_type, value, sum(value) OVER (PARTITION BY user_id) AS spent, count(*) OVER (PARTITION BY user_id) AS tries, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    SELECT event_type AS tier, count(*) AS items, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS review_rate, round(sum(value), 2) AS latest_cost, round(sum(spent), 2) AS true_cost, CAST(sum(tries) AS BIGINT) AS attempts FROM a WHERE rn = 1 GROUP BY 1""",
)
def evl02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("tier"), F.when(F.col("value") > 20, "REVIEW").otherwise("INCLUDE").alias("decision"), F.col("value").alias("cost"))
    return C.ship_report(e)


@query("evl07_label_coverage", "SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'O') AS mapped, round(count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 6) AS share FROM orders GROUP BY 1 HAVING count(*) >= 5")
def evl07(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each frequent label a taxonomy maps."""
    per = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "O").alias("mapped")).where("n >= 5")
    return per.select("label", "n", "mapped", F.round(F.col("mapped") / F.col("n"), 6).alias("share"))


@query(
    "evl08_splits",
    """WITH s AS (SELECT CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'tune' ELSE 'heldout' END AS split, quality = 1 AS truth, n_chars > 300 AS hit FROM documents JOIN labels USING (doc_id))
    SELECT split, count(*) AS n, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn FROM s GROUP BY 1""",
)
def evl08(spark: SparkSession, d: str) -> DataFrame:
    """A screen scored apart on tuning and held-out rows, which the hash of the id tells apart."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    split = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", "tune").otherwise("heldout")
    hit, true = F.col("n_chars") > 300, F.col("quality") == 1
    return rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))


@query("que02_zero_credit_queue", "SELECT o_custkey AS venue, count(*) AS events FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1 HAVING count(*) >= 2")
def que02(spark: SparkSession, d: str) -> DataFrame:
    """Venues with several events of which none of the credits counts."""
    credited = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(credited, "o_orderkey", "left_anti").groupBy(F.col("o_custkey").alias("venue")).agg(F.count("*").alias("events")).where("events >= 2")


@query(
    "acq03_target_pools",
    """WITH w AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k, 0 AS pr, 'venue' AS pool FROM customer JOIN w ON w.k = c_custkey WHERE w.n < 3 UNION ALL
      SELECT c_custkey, 1, 'alias' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 2, 'discovered' FROM customer WHERE c_custkey NOT IN (SELECT k FROM w))
    SELECT k AS account_id, arg_min(pool, pr) AS pool FROM p GROUP BY 1""",
)
def acq03(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of the pools of targets, each in the first pool that has it."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.count("*").alias("n"))
    pools = [("venue", c.join(n.where("n < 3"), "account_id", "left_semi")), ("alias", c.where("account_id % 10 = 0")), ("discovered", c.join(n, "account_id", "left_anti"))]
    return H.priority_pick([p.select("account_id", F.lit(name).alias("pool")) for name, p in pools], ["account_id"], [F.col("account_id")])


@query(
    "acq05_realized_yield",
    """WITH f AS (SELECT o_orderkey AS post, o_custkey AS seed FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'), s AS (SELECT l_orderkey AS post, bool_or(l_returnflag = 'R') AS stack, count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS events FROM lineitem GROUP BY 1)
    SELECT seed, count(*) AS new_posts, count(*) FILTER (WHERE stack) AS stack_posts, CAST(coalesce(sum(events), 0) AS BIGINT) AS events FROM f LEFT JOIN s USING (post) GROUP BY 1""",
)
def acq05(spark: SparkSession, d: str) -> DataFrame:
    """Of the posts that each seed was first to show: those with a stack, and the events made of them. Both are counted per
    post before they meet the posts, so nothing multiplies."""
    first = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("post"), F.col("o_custkey").alias("seed"))
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("post")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("stack"), F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("events"))
    return first.join(made, "post", "left").groupBy("seed").agg(F.count("*").alias("new_posts"), F.count_if("stack").alias("stack_posts"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


@query(
    "acq10_yield_baselines",
    """WITH w AS (SELECT c_custkey AS k, c_mktsegment AS kind, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT kind, CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' ELSE '16+' END AS band, count(*) AS venues, CAST(sum(n) AS BIGINT) AS events FROM w GROUP BY ROLLUP (kind, band)""",
)
def acq10(spark: SparkSession, d: str) -> DataFrame:
    """Venues and events by kind and coverage band, with totals per kind and over all."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left").select(F.col("c_mktsegment").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("band", H.bands(F.col("n"), [0, 5, 15], ["0", "1-5", "6-15", "16+"])).rollup("kind", "band").agg(F.count("*").alias("venues"), F.sum("n").alias("events"))


@query(
    "acq13_fair_sample",
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= ceil(20.0 / (SELECT count(DISTINCT coalesce(source, '~')) FROM documents))",
)
def acq13(spark: SparkSession, d: str) -> DataFrame:
    """A sample of some twenty with equal slots per source."""
    docs = table(spark, d, "documents")
    sources = docs.select(F.coalesce("source", F.lit("~")).alias("s")).distinct().count()
    return H.stratified_sample(docs, "source", "doc_id", -(-20 // max(1, sources))).select("source", "doc_id")


@query("doc05_enum_errors", "SELECT o_orderkey AS doc_id, 'status' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def doc05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    every = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")).unionByName(o.select(F.col("o_orderkey").alias("doc_id"), F.lit("free").alias("field"), F.col("o_orderpriority").alias("value")))
    return C.enum_errors(every, spark.createDataFrame([("status", "F"), ("status", "O")], "field string, value string"))


VENUES = [(1, "stated", 20, 200), (2, "conflicting", 30, None), (3, "none", None, 1000), (4, "none", None, None), (5, "stated", 10, 90)]
CAPS = [(1, None, 50, 150), (2, None, 40, 120), (3, "Gala seated", 100, 1000), (3, None, 80, 300), (4, None, None, 75), (5, "Corporate meeting", 5, 80)]
HEADS = [(1, 150, 0), (2, 120, 0), (3, 300, 0), (4, 75, 1)]


@query(
    "doc11_guest_range",
    f"""WITH {values(VENUES, "v0", "venue_id, min_status, min_guests, max_guests")}, {values(CAPS, "c0", "venue_id, cond, lo, hi")}, {values(HEADS, "h0", "venue_id, headline, cocktail")},
    v AS (SELECT c_custkey * 10 + venue_id AS venue_id, min_status, min_guests, max_guests + c_nationkey AS max_guests FROM v0, customer), c AS (SELECT c_custkey * 10 + venue_id AS venue_id, cond, lo, hi + c_nationkey AS hi FROM c0, customer),
    h AS (SELECT c_custkey * 10 + venue_id AS venue_id, headline + c_nationkey AS headline, cocktail FROM h0, customer),
    x AS (SELECT v.*, h.headline, h.cocktail, (SELECT min(lo) FROM c WHERE c.venue_id = v.venue_id) AS least, coalesce(v.max_guests IS NOT NULL AND NOT (EXISTS (SELECT 1 FROM c WHERE c.venue_id = v.venue_id AND regexp_matches(cond, '(?i)gala|corporate') AND hi = v.max_guests) AND coalesce(h.headline < v.max_guests, false)), false) AS stated FROM v LEFT JOIN h USING (venue_id))
    SELECT venue_id, CASE min_status WHEN 'conflicting' THEN NULL WHEN 'stated' THEN min_guests ELSE least END AS min, CASE WHEN stated THEN max_guests ELSE headline END AS max, CASE WHEN stated OR coalesce(cocktail, 0) = 1 THEN 'guests' ELSE 'seated' END AS max_measures FROM x""",
)
def doc11(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's five sample venues, larger by the number of the customer's nation."""
    venue, more = (F.col("c_custkey") * 10 + F.col("venue_id")).alias("venue_id"), lambda c: (F.col(c) + F.col("c_nationkey")).alias(c)
    v = spread(spark, d, VENUES, "venue_id int, min_status string, min_guests int, max_guests int").select(venue, "min_status", "min_guests", more("max_guests"))
    c = spread(spark, d, CAPS, "venue_id int, condition string, min int, max int").select(venue, "condition", "min", more("max"))
    h = spread(spark, d, HEADS, "venue_id int, headline int, cocktail_only int").select(venue, more("headline"), (F.col("cocktail_only") == 1).alias("cocktail_only"))
    return C.guest_range(v, c, h)


@query(
    "doc16_readiness",
    """WITH r AS (SELECT *, o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_totalprice > 50000 AND o_orderstatus <> 'P' AS ready FROM orders)
    SELECT o_orderkey, CASE WHEN ready AND (o_orderkey % 13 = 0 OR o_orderkey % 4 = 1) THEN 'excellent' WHEN ready THEN 'compare_ready' END AS level FROM r""",
)
def doc16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    stated = F.when(F.col("o_orderstatus") != "P", "stated").otherwise("not_stated")
    level = C.readiness(k % 11 == 0, F.when(k % 3 == 0, 2).otherwise(0), F.when(F.col("o_totalprice") > 50_000, 100), stated, F.lit("stated"), stated, k % 13 == 0, F.lit(2), k % 4 == 1)
    return table(spark, d, "orders").select("o_orderkey", level.alias("level"))


ADD_ONS = [(1, 1, "12 uplights + monogram package"), (1, 2, "Package of 12 uplights + monogram"), (1, 3, "Chair covers (each)"), (1, 4, "chair covers"), (1, 5, "Dance floor"), (1, 6, "Dance lighting"), (2, 7, "Dance floor"), (2, 8, "Dance floor rental upgrade"), (2, 9, "a"), (2, 10, "A!"), (2, 11, "Up"), (2, 12, "Uplights"), (2, 13, "Dan")]
ADD_ON_SQL = f"""WITH {values(ADD_ONS, "n0", "venue_id, id, name")}, n AS (SELECT c_custkey * 10 + venue_id AS venue_id, id, name FROM n0, customer UNION ALL SELECT DISTINCT -1 - l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS flat FROM n),
    w AS (SELECT *, list_distinct([t FOR t IN string_split(flat, ' ') IF length(t) > 1 AND t NOT IN ({', '.join(f"'{x}'" for x in C.NAME_STOPS)})]) AS ws FROM f)
    SELECT a.venue_id, a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.venue_id = b.venue_id AND a.id < b.id
    WHERE starts_with(a.flat, b.flat) OR starts_with(b.flat, a.flat) OR (len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) >= 0.6)"""


@query("doc21_similar_add_ons", ADD_ON_SQL)
def doc21(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's sample add-ons, and the parts of every order as its own."""
    samples = spread(spark, d, ADD_ONS, "venue_id int, id long, name string").select((F.col("c_custkey") * 10 + F.col("venue_id")).alias("venue_id"), "id", "name")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    parts = table(spark, d, "lineitem").select((-F.col("l_orderkey") - 1).alias("venue_id"), F.col("l_partkey").alias("id")).join(names, "id")
    return C.similar_names(samples.unionByName(parts))


@query(
    "doc19_crawl_coverage",
    "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (WHERE length(html) >= 1000) AS with_text, count(*) FILTER (WHERE contains(lower(html), '<title')) AS with_title FROM pages GROUP BY 1",
)
def doc19(spark: SparkSession, d: str) -> DataFrame:
    """Per host what a crawl brought: pages, pages of some length, pages with a title."""
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "html")
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.char_length("html") >= 1_000).alias("with_text"), F.count_if(F.contains(F.lower("html"), F.lit("<title"))).alias("with_title"))


@query("doc09_flat_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS failed, round(value, 1) AS value FROM events")
def doc09(spark: SparkSession, d: str) -> DataFrame:
    """Columns that serving filters on, out of the document itself."""
    doc = F.from_json("props", "k bigint")
    return table(spark, d, "events").select("event_id", doc["k"].alias("k"), (F.col("event_type") == "error").alias("failed"), F.round("value", 1).alias("value"))


@query(
    "doc23_fill_order",
    "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(n, 0) = 0, coalesce(n, 0) DESC, c_acctbal DESC, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def doc23(spark: SparkSession, d: str) -> DataFrame:
    """Which venues' documents to fill first: those with events, most events first, then reach; numbered per metro."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return H.latest_rank(rows, ["c_nationkey"], [F.col("n") == 0, F.desc("n"), F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", F.col("rn").cast("long").alias("place"))


@query("srv12_current_document", "SELECT n_name, event_id, value FROM nation JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ON user_id = n_nationkey WHERE lower(n_name) = 'france' OR n_nationkey < 5")
def srv12(spark: SparkSession, d: str) -> DataFrame:
    """The current document of accounts named by username, whatever the case: the names cut the runs before the window."""
    wanted = table(spark, d, "nation").where("lower(n_name) = 'france' or n_nationkey < 5").select(F.col("n_nationkey").alias("user_id"), "n_name")
    runs = table(spark, d, "events").join(wanted, "user_id", "left_semi")
    return U.current(runs, "user_id", "ts", "event_id").join(wanted, "user_id").select("n_name", "event_id", "value")


ROLES = {"venue": "Venue", "photographer": "Photographer", "dj": "DJ"}
SLOTS = {"venue": "Venue", "hotel": "Venue", "photographer": "Photography", "drone": "Photography", "dj": "Music", "band": "Music"}
ASKED = [(i, r) for i, r in enumerate([*SLOTS, "unheard_of", None])]


@query(
    "srv14_role_labels",
    f"WITH {values(ASKED, 'r', 'id, role')}, {values(list(ROLES.items()), 'l', 'role, label')}, {values(list(SLOTS.items()), 's', 'role, slot')} SELECT c_custkey * 100 + id AS id, coalesce(label, 'Vendor') AS label, coalesce(slot, 'Other') AS slot FROM customer, r LEFT JOIN l USING (role) LEFT JOIN s USING (role)",
)
def srv14(spark: SparkSession, d: str) -> DataFrame:
    """Labels and team slots of roles, out of small tables of constants."""
    role = F.col("role")
    return spread(spark, d, ASKED, "id long, role string").select((F.col("c_custkey") * 100 + F.col("id")).alias("id"), C.mapped(role, ROLES, F.lit("Vendor")).alias("label"), C.mapped(role, SLOTS, F.lit("Other")).alias("slot"))
