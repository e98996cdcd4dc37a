"""Queries of text functions and parsers. Captions are made from columns, so the SQL computes answers from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import credits as C
from kithgraph.functions import text as T
from kithgraph.functions import urls as U
from kithgraph.operators import evaluate as V
from kithgraph.registry import query
from kithgraph.tables import table

#: Labels that stand for a line's return flag.
LABELS = {"R": "Photographer", "A": "Venue", "N": "Floral Design"}
ROLE_SQL = "CASE l_returnflag WHEN 'R' THEN 'photographer' WHEN 'A' THEN 'venue' ELSE 'florist' END"
LABEL_SQL = "CASE l_returnflag WHEN 'R' THEN 'Photographer' WHEN 'A' THEN 'Venue' ELSE 'Floral Design' END"


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Posts (post_id, caption): a line of prose and a credit line per item of an order."""
    label = F.when(F.col("l_returnflag") == "R", LABELS["R"]).when(F.col("l_returnflag") == "A", LABELS["A"]).otherwise(LABELS["N"])
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.concat(label, F.lit(": @Part"), F.col("l_partkey").cast("string")).alias("line")).alias("x"))
    per = lines.groupBy(F.col("l_orderkey").alias("post_id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return per.select("post_id", F.concat(F.lit("A lovely wedding day\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("caption"))


@query("txt01_credit_lines", f"SELECT l_orderkey AS post_id, {LABEL_SQL} AS role_raw, 'part' || CAST(l_partkey AS VARCHAR) AS handle, {ROLE_SQL} AS role, count(*) AS n FROM lineitem GROUP BY ALL")
def txt01(spark: SparkSession, d: str) -> DataFrame:
    return C.credit_lines(captions(spark, d)).groupBy("post_id", "role_raw", "handle", "role").agg(F.count("*").alias("n"))


@query("txt01_has_stack", "SELECT l_orderkey AS post_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 3")
def txt01_stack(spark: SparkSession, d: str) -> DataFrame:
    return C.has_stack_raw(C.credit_lines(captions(spark, d)))


@query("txt03_has_stack_roles", "SELECT l_orderkey AS post_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2")
def txt03_stack(spark: SparkSession, d: str) -> DataFrame:
    return C.has_stack_roles(C.credit_lines(captions(spark, d)), 2)


@query("txt02_role_norm", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'tin') OR contains(lower(p_type), 'steel') THEN 'metal' ELSE 'other' END AS role FROM part")
def txt02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.ordered_role(F.col("p_type"), [("brass", ["brass"]), ("metal", ["tin", "steel"])]).alias("role"))


@query(
    "txt10_candidate_score",
    """SELECT l_orderkey AS post_id, 2 * least(count(DISTINCT l_returnflag), 5) + CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 3 ELSE 0 END + 1 AS score FROM lineitem GROUP BY 1""",
)
def txt10(spark: SparkSession, d: str) -> DataFrame:
    """Roles are found within the row, so no post is moved once its caption is made."""
    posts = captions(spark, d).select("post_id", "caption", C.roles_of(F.col("caption")).alias("roles"))
    return posts.select("post_id", V.candidate_score(F.col("roles"), F.col("caption")).cast("long").alias("score"))


@query(
    "txt11_prefilter",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_wedding_related' WHEN o_orderpriority LIKE '1%' THEN 'destination_wedding' WHEN o_orderpriority LIKE '2%' THEN 'not_local' END AS reason FROM orders",
)
def txt11(spark: SparkSession, d: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    caption = F.when(F.col("o_orderstatus") == "P", "a concert").otherwise("our wedding")
    place = F.when(p.isin("1", "2"), "Tulum, Mexico").otherwise("Chicago")
    none = F.array().cast("array<string>")
    return table(spark, d, "orders").select("o_orderkey", V.prefilter(caption, place, none, none, p == "1").alias("reason"))


@query(
    "txt12_styled_signal",
    "SELECT o_orderkey AS post_url, CASE WHEN o_orderkey % 50 = 0 THEN 'CONFIRMED' WHEN o_orderpriority LIKE '1%' THEN 'LIKELY' WHEN o_orderpriority LIKE '2%' THEN 'POSSIBLE' WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1 HAVING count(*) >= 2) THEN 'POSSIBLE' ELSE 'NO_SIGNAL' END AS confidence FROM orders",
)
def txt12(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.operators.evidence import styled_signal

    p = F.substring("o_orderpriority", 1, 1)
    caption = F.when(p == "1", "From our Styled Shoot last week").when(p == "2", "so stylish").otherwise("a day out")
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_url"), caption.alias("caption"), F.col("o_custkey").cast("string").alias("author"))
    return styled_signal(posts, posts.where("post_url % 50 = 0"))


@query("txt13_couple_signal", "SELECT c_custkey, c_custkey % 3 <> 0 AS couple FROM customer")
def txt13(spark: SparkSession, d: str) -> DataFrame:
    from kithgraph.operators.evidence import COUPLE

    k = F.col("c_custkey") % 3
    caption = F.when(k == 0, "party of the year").when(k == 1, "Anna & Ben").otherwise("Mr. & Mrs. Smith")
    return table(spark, d, "customer").select("c_custkey", caption.rlike(COUPLE).alias("couple"))


@query("txt16_exact_handle", "SELECT p_partkey, p_partkey % 2 = 0 AS named FROM part")
def txt16(spark: SparkSession, d: str) -> DataFrame:
    """A handle is named only if nothing that could belong to it follows."""
    k = F.col("p_partkey")
    caption = F.concat(F.lit("at @the.part"), F.when(k % 2 == 0, ". Lovely").otherwise("_2 Lovely"))
    return table(spark, d, "part").select("p_partkey", T.names_handle(caption, F.lit("The.Part")).alias("named"))


@query("txt18_hashtags", "SELECT n_nationkey, lower(n_name) || ',wedding' AS tags FROM nation")
def txt18(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_replace("n_name", r"[^A-Za-z0-9_]", "_")
    caption = F.concat(F.lit("so #"), words, F.lit(" and #Wedding #WEDDING!"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(T.hashtags(caption), ",").alias("tags"))


def url_variants(spark: SparkSession, d: str) -> DataFrame:
    """The URLs of the pages with a path out of a list by their id, so that every rule of the score meets some."""
    tails = F.array(*[F.lit(x) for x in URL_TAILS])
    tail = F.get(tails, (F.col("page_id") % len(URL_TAILS)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat("url", tail).alias("url"), (F.col("page_id") % 2 == 0).alias("nav"), (F.col("page_id") % 9).alias("parent"))


URL_TAILS = [
    "", "/weddings", "/Bridal-Suite", "/private-events/rooftop", "/faq", "/floor-plans", "/event-spaces", "/rooms", "/rooms/wedding-block", "/preferred-vendors", "/about", "/dining", "/dining/private",
    "/blog/weddings", "/menu.pdf", "/annual.pdf", "/photo.JPG", "/wp-content/uploads/x", "/weddings?s=1", "/spaces/ballroom#top", "/the-loft", "/wedding-page", "/page/12", "/stay/offers",
]
TAILS_SQL = "[" + ", ".join(f"'{x}'" for x in URL_TAILS) + "]"
# RE2 has no look-ahead: the two rules with one are written out
ADD_SQL = " + ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN {n} ELSE 0 END" for p, n in U.SCORES if "(?!" not in p)
LODGING_SQL = r"regexp_matches(path, '/accommodations?\b|/stay\b|/suites?\b|/reservations?\b|/book(ing)?\b|/offers?\b|/spa\b') OR (regexp_matches(path, '/rooms?') AND NOT regexp_matches(path, '/rooms?.*(event|wedding)')) OR (regexp_matches(path, '/dining') AND NOT regexp_matches(path, '/dining.*private'))"


@query(
    "txt19_url_score",
    f"""WITH u AS (SELECT page_id, url || {TAILS_SQL}[1 + page_id % {len(URL_TAILS)}] AS url FROM pages),
    p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$', 1)) AS whole FROM u)
    SELECT page_id, CASE WHEN NOT regexp_matches(path, '\\.pdf$') AND regexp_matches(path, '{U.NO_PAGE}') THEN NULL ELSE {ADD_SQL} + CASE WHEN {LODGING_SQL} THEN -10 ELSE 0 END
      + CASE WHEN regexp_matches(path, '{U.SPACE}') AND regexp_matches(path, '{U.SPACE_CONTEXT}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(regexp_replace(path, '[-_/]+', ' ', 'g'), '{U.SPACE_NAME}') THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(whole, '{U.NOISE}') THEN -10 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 9 >= 5 THEN 3 ELSE 0 END
      + CASE WHEN regexp_matches(path, '\\.pdf$') THEN CASE WHEN regexp_matches(url, '{U.RELEVANT_PDF}') THEN 5 ELSE -5 END ELSE 0 END END AS score FROM p""",
)
def txt19(spark: SparkSession, d: str) -> DataFrame:
    score = U.url_score(F.col("url"), from_nav=F.col("nav"), parent_score=F.col("parent"))
    return url_variants(spark, d).select("page_id", score.alias("score"))


@query("txt21_html_text")
def txt21(spark: SparkSession, d: str) -> DataFrame:
    return U.page_texts(table(spark, d, "pages")).select("page_id", F.char_length("text").alias("n_chars"), F.size("links").alias("n_links"), "sha256")


@query("txt24_salvage", "SELECT l_orderkey, l_linenumber, 'part' || CAST(l_partkey AS VARCHAR) AS handle FROM lineitem WHERE l_returnflag = 'R'")
def txt24(spark: SparkSession, d: str) -> DataFrame:
    """Model output is searched for its array; entries count only if the handle and the role are allowed ones."""
    raw = F.concat(F.lit('Sure! [{"handle": "part'), F.col("l_partkey").cast("string"), F.lit('", "role": "'), F.col("l_returnflag"), F.lit('"}, {"handle": "ghost", "role": "R"}] ok'))
    found = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), "array<struct<handle:string,role:string>>")
    mine = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    kept = F.filter(found, lambda x: (x["handle"] == mine) & x["role"].isin("R"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(kept).alias("x")).select("l_orderkey", "l_linenumber", F.col("x.handle").alias("handle"))


@query("url01_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def url01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.host("url").alias("host"))


@query("url02_key", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\.)?', ''), '#.*$', ''), '/+($|\?)', '\1', 'g') AS key FROM pages")
def url02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_key("url").alias("key"))


@query("url04_shortcode", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'S' || CAST(o_orderkey AS VARCHAR) END AS shortcode FROM orders")
def url04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://example.org/"), F.when(k % 4 == 0, "reel/").otherwise("p/"), F.lit("S"), k.cast("string"), F.lit("/?x=1"))
    return table(spark, d, "orders").select("o_orderkey", T.shortcode(url).alias("shortcode"))


@query("dat04_event_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0")
def dat04(spark: SparkSession, d: str) -> DataFrame:
    """ISO dates, month/day/year, and text that is no date."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 1, F.date_format(date, "yyyy-MM-dd'T'HH:mm")).when(k % 3 == 2, F.date_format(date, "M/d/yyyy")).otherwise("2/31/2024")
    return table(spark, d, "orders").select("o_orderkey", T.event_date(raw).alias("event_date"))


@query("dat07_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS season FROM orders")
def dat07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.season(F.col("o_orderdate")).alias("season"))


@query("str08_slug", "SELECT n_nationkey, regexp_replace(regexp_replace(lower(n_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nation")
def str08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.slug(F.concat("n_name", F.lit(" & Co."))).alias("slug"))


@query("str14_couple_key", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'anna|ben' WHEN c_custkey % 3 = 1 THEN 'ann|zoe' END AS couple FROM customer")
def str14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, "Ben Smith & Anna Jones").when(k == 1, "Zoe and ANN").otherwise("Al + Bo")
    return table(spark, d, "customer").select("c_custkey", T.couple_key(raw).alias("couple"))


@query("prj01_display_name", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Studio ' || s_name WHEN 1 THEN 'Full ' || s_name ELSE s_name END AS name FROM supplier")
def prj01(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 3, F.col("s_name")
    business = F.when(k == 0, F.concat(F.lit("Studio "), name)).when(k == 1, F.concat(F.lit("@"), name))
    full = F.when(k == 1, F.concat(F.lit("Full "), name)).when(k == 2, "")
    return table(spark, d, "supplier").select("s_suppkey", T.display_name(business, full, name).alias("name"))


@query("hsh02_input_hash", "SELECT l_orderkey, sha256('v1' || chr(10) || string_agg(sha256(CAST(l_partkey AS VARCHAR)), chr(10) ORDER BY sha256(CAST(l_partkey AS VARCHAR)))) AS input_hash FROM lineitem GROUP BY 1")
def hsh02(spark: SparkSession, d: str) -> DataFrame:
    """A hash of a set of inputs that doesn't depend on their order."""
    digests = F.array_sort(F.collect_list(F.sha2(F.col("l_partkey").cast("string"), 256)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.concat(F.lit("v1\n"), F.array_join(digests, "\n")), 256).alias("input_hash"))


@query("jsn01_json_fields", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def jsn01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
