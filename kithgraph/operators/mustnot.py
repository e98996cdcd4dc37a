"""What documents must not say, as rules in a table: each rule names the leaves it is about, an operator and its operands.

Rules meet leaves by the shape of their path (places in arrays as *), so one equi-join serves all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.operators.trees import CONTAINERS, parent, shape

RULES = "rule_id string, op string, path string, operand string, other string, unless string, scope_path string, scope_value string, doc_id string"

# Headings that are no rooms, nightly rates, hotel guests' questions, boilerplate, other events' plans, headings of vendor lists.
GENERIC_SPACE = r"(?i)^\s*(wedding venues?|event space|meeting rooms?)\s*$"
NIGHTLY = r"(?i)\b(adr|average daily rate)\b|\$\s?[\d,]+(\.\d+)?\s*/?\s*(per\s+)?night\b"
HOTEL_QUESTION = r"(?i)\b(check-?in|check-?out|wi-?fi|loyalty|gift card|parking garage rate|pet policy|room service|housekeeping)\b"
EVENT_QUESTION = r"(?i)\b(wedding|ceremony|reception|bride|groom|bridal|catering|venue rental|event space)\b"
BOILERPLATE = r"(?i)\b(privacy (request|policy)|code of (business )?conduct|modern slavery|gift cards?|order online|follow us|terms (of|&) (service|conditions)|investor relations|accessibility statement|sitemap)\b"
SLUG = r"^\s*([a-z0-9]+([-_][a-z0-9]+)+|[a-z0-9]{9,})\s*$"
OTHER_PLAN, EVENT_PLAN = r"(?i)\b(gala|corporate|social event)\b", r"(?i)wedding"
HEADINGS = (
    "accommodations av bakeries bakery bands band beauty cake cakes caterer caterers catering ceremony coordinator coordinators decor dj djs entertainment florals florist florists flowers furniture "
    "hair hotel hotels invitations lighting limousines linens makeup music officiant officiants photobooth photobooths photographer photographers photography planner planners reception rental rentals "
    "stationery tents transportation vendors videographer videographers videography"
)
MOST_SPAN, MOST_HOTEL_SHARE = 10, 0.9

#: The rules that hold for every venue.
FLOOR = [
    ("no_generic_label_space", "match", "/spaces[*]/name", GENERIC_SPACE, None, None, None, None, None),
    ("no_duplicate_space", "twins", "/spaces[*]/name", r"\broom\b", None, None, None, None, None),
    ("no_adr_price", "match", "/pricing/paths[*]/fixed_fees[*]/quote", NIGHTLY, None, None, None, None, None),
    ("no_adr_price", "match", "/pricing/add_ons[*]/quote", NIGHTLY, None, None, None, None, None),
    ("no_hotel_faq_majority", "share", "/faqs[*]/question", HOTEL_QUESTION, str(MOST_HOTEL_SHARE), EVENT_QUESTION, "/spine/venue_kind/value", "hotel", None),
    ("no_junk_vendor_names", "match", "/vendor_lists[*]/entries[*]/name", BOILERPLATE, None, None, None, None, None),
    ("no_junk_vendor_names", "match", "/vendor_lists[*]/entries[*]/name", SLUG, None, None, None, None, None),
    ("no_junk_vendor_names", "alone", "/vendor_lists[*]/entries[*]/name", HEADINGS.replace(" ", "|"), "url", None, None, None, None),
    ("no_gala_floor_plan", "match", "/resources[*]/label", OTHER_PLAN, None, EVENT_PLAN, None, None, None),
    ("no_amalgam_capacity_range", "span", "/capacities[*]/max", str(MOST_SPAN), "min", None, None, None, None),
]


def floor_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLOOR, RULES)


def plain(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def violations(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, path, value): what in the documents breaks a rule. found: nodes (doc_id, path, kind, value); rules: RULES.

    match: the value fits the operand and not `unless`. span: the number is more than `operand` times its member `other`
    (which is over zero). twins: several leaves of the document are one name without what the operand names, other signs and case. one_of:
    several leaves have names that the operand lists (a|b|c). share: more than `other` of the leaves fit the operand and not
    `unless`; told once, at the first. alone: the value is a listed name and its member `other` is missing, null or empty. A scope
    keeps a rule to documents with that value at that path, a doc_id to one document. A document without such leaves breaks
    nothing; null values fit nothing; a rule may have several rows.
    """
    r = rules.select("rule_id", "op", F.col("path").alias("shape"), "operand", "other", "unless", "scope_path", "scope_value", F.col("doc_id").alias("only"), F.xxhash64(*rules.columns).alias("row"))
    r = r.withColumn("names", F.when(F.col("op").isin("one_of", "alone"), F.transform(F.split("operand", r"\|"), plain)))
    # what the rules ask of a leaf: those on its own shape, those that look at it beside another, those that it is the scope of
    own = r.select("shape", F.struct("row", "op", "operand", "names", "other", "unless", "scope_path", "scope_value", "only").alias("rule"))
    beside = r.where("other is not null and op in ('span', 'alone')").select(F.concat(parent(F.col("shape")), F.lit("/"), F.col("other")).alias("shape")).distinct().withColumn("is_beside", F.lit(True))
    by_shape = own.unionByName(beside, allowMissingColumns=True).groupBy("shape").agg(F.collect_list("rule").alias("asked"), F.bool_or("is_beside").alias("is_beside"))
    scopes = r.where("scope_path is not null").select(F.col("scope_path").alias("path"), F.lit(True).alias("is_scope")).distinct()
    leaf = found.where(~F.col("kind").isin(CONTAINERS)).select("doc_id", "path", F.col("value").alias("v"), shape(F.col("path")).alias("shape"))
    # the rules do not grow with the documents, so they go to every task and only leaves that they ask for are moved, once, by document
    met = leaf.join(F.broadcast(by_shape), "shape", "left").join(F.broadcast(scopes), "path", "left")
    met = met.where("asked is not null or is_beside or is_scope").withColumn("folded", F.when(F.exists("asked", lambda x: x["names"].isNotNull()), plain(F.col("v"))))
    v, fold = F.col("v"), lambda x: F.array_contains(x["names"], F.col("folded"))
    fit = lambda x: F.coalesce(F.rlike(v, x["operand"]), F.lit(False)) & ~F.coalesce(F.rlike(v, x["unless"]), F.lit(False))
    # a rule that is about single leaves is told of those that fit it
    told = lambda x: F.when(x["op"] == "match", fit(x)).when(x["op"].isin("one_of", "alone"), F.coalesce(fold(x), F.lit(False))).when(x["op"].isin("share", "span", "twins"), True).otherwise(False)
    mine = F.filter("asked", lambda x: (x["only"].isNull() | (x["only"] == F.col("doc_id").cast("string"))) & told(x))
    met = met.withColumn("asked", F.transform(mine, lambda x: x["row"])).where("size(asked) > 0 or is_beside or is_scope")
    met = met.select("doc_id", "path", "v", F.coalesce("asked", F.array().cast("array<bigint>")).alias("asked"), "is_beside", "is_scope").repartition(2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # twice as many: documents that come by document would stay in few tasks
    # in its document every leaf meets those beside it and the scopes
    scope = F.collect_set(F.when(F.col("is_scope"), F.struct("path", "v"))).over(Window.partitionBy("doc_id"))
    near = F.collect_list(F.when(F.col("is_beside"), F.struct(F.regexp_extract("path", r"/([^/\[]*)$", 1).alias("k"), F.col("v").alias("v")))).over(Window.partitionBy("doc_id", "holder"))
    # the finer window goes first, so that the coarser one finds its rows in order
    rows = met.withColumn("holder", parent(F.col("path"))).withColumn("near", near).withColumn("scopes", scope).where("size(asked) > 0")
    rows = rows.select("doc_id", "path", "v", "scopes", "near", F.explode("asked").alias("row")).join(F.broadcast(r.drop("shape", "names")), "row")
    rows = rows.where(F.col("scope_path").isNull() | F.exists("scopes", lambda x: (x["path"] == F.col("scope_path")) & (x["v"] == F.col("scope_value"))))
    rows = rows.withColumn("other_v", F.get(F.filter("near", lambda x: x["k"] == F.col("other")), F.lit(0))["v"]).drop("scopes", "near")
    fits = F.coalesce(F.rlike("v", "operand"), F.lit(False)) & ~F.coalesce(F.rlike("v", "unless"), F.lit(False))
    number, less = F.col("v").try_cast("double"), F.col("other_v").try_cast("double")
    cut = F.when(F.col("op") == "twins", F.regexp_replace(F.lower("v"), F.col("operand"), F.lit(""))).otherwise(F.col("v"))
    rows = rows.withColumn("fits", F.when(F.col("op") == "share", fits).otherwise(F.col("op").isin("match", "one_of", "alone"))).withColumn("key", F.when(F.col("op") == "twins", F.nullif(plain(cut), F.lit(""))))
    of_rule, of_key = Window.partitionBy("doc_id", "row"), Window.partitionBy("doc_id", "row", "key")
    rows = rows.withColumn("n_key", F.count("key").over(of_key))
    rows = rows.select("*", F.count("*").over(of_rule).alias("n"), F.count_if("fits").over(of_rule).alias("n_fits"), (F.min("path").over(of_rule) == F.col("path")).alias("first"))
    wrong = (
        F.when(F.col("op") == "match", F.col("fits")).when(F.col("op") == "alone", F.col("fits") & (F.coalesce("other_v", F.lit("")) == ""))
        .when(F.col("op") == "span", (less > 0) & (number / less > F.col("operand").try_cast("double"))).when(F.col("op") == "twins", F.col("n_key") > 1)
        .when(F.col("op") == "one_of", F.col("fits") & (F.col("n_fits") > 1)).when(F.col("op") == "share", F.col("first") & (F.col("n_fits") / F.col("n") > F.col("other").try_cast("double")))
    )
    return rows.where(F.coalesce(wrong, F.lit(False))).select("doc_id", "rule_id", "path", F.col("v").alias("value")).distinct()


def passed(docs: DataFrame, broken: DataFrame) -> DataFrame:
    """(doc_id, passed, n_broken, rules): each document with the rules it breaks, in order."""
    each = broken.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    rows = docs.select("doc_id").join(each, "doc_id", "left")
    return rows.select("doc_id", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n_broken"), F.coalesce("rules", F.lit("")).alias("rules"))
