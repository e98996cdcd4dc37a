"""Which accounts may be one venue: signals between pairs, what they add up to, which side to keep, and what is never proposed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import host, mention_kind, mention_snippet, mentions, url_key, without_tracking
from kithgraph.operators.entities import pairs_in_groups, within_edits
from kithgraph.session import ensure_checkpoints

# Words of a handle that say nothing about which place it is, kinds of room at its end, least lengths and counts.
STEM_NOISE = r"(chicago|chi|events?|weddings?|venue|banquets?|official|il|the|and|at)"
FACILITY = r"(conferencecenter|eventcenter|eventspace|banquetcenter|center|centre|pavilion|ballroom|rooftop|terrace)$"
LEAST_STEM, LEAST_TRUSTED_STEM, LEAST_HANDLE, MOST_EDITS, MOST_IN_GROUP = 4, 4, 8, 2, 8
CREDIT_POSTS, READER_POSTS, MANY_CREDIT_POSTS, MANY_READER_POSTS, REAL_EVENTS = 2, 2, 5, 3, 3
# Houses of worship, biographies and handles of other trades, umbrella brands, biographies of venues.
WORSHIP = r"(?i)church|parish|cathedral|chapel|temple|synagogue|mosque|basilica"
WORSHIP_WORD = r"(?i)\b(church|parish|cathedral|chapel|temple|synagogue|mosque|basilica)\b"
OTHER_TRADE = r"(?i)\b(cater|catering|management|hospitality|restaurant group|planner|planning|photograph|floral|florist)\b"
OWN_PLACE = r"(?i)\b(venue|event space|event centre|event center|banquet hall|ballroom|our space|host your|book your (?:wedding|event)|weddings? (?:and|&) events?)\b"
TRADE_HANDLE = r"(?i)photograph|photog|films?|cinema|videograph|floral|florist|planner|planning|makeup|beauty|hairby|djs?by|catering|caterer"
UMBRELLA = r"(?i)(hotels|resorts|clubs|venues|properties|collection|hospitality|\bgroup\b|conferences?|bonvoy|management|portfolio|destinations)"
LISTING_HOST = r"\.(bio|link)$"


def stem(handle: Column) -> Column:
    """What is left of a handle without signs, the kind of room at its end and words that many places share."""
    plain = F.regexp_replace(F.lower(handle), "[^a-z0-9]", "")
    short = F.regexp_replace(plain, FACILITY, "")
    return F.regexp_replace(F.when(short != "", short).otherwise(plain), STEM_NOISE, "")


def unpunctuated(handle: Column) -> Column:
    return F.regexp_replace(F.lower(handle), "[._]", "")


def signs(handle: Column) -> Column:
    return F.char_length(handle) - F.char_length(F.regexp_replace(handle, "[._]", ""))


def punctuation_signal(a: Column, b: Column) -> Column:
    """S1b if two handles differ by a dropped or trailing sign only, S1c if they use other signs in the same place; else null."""
    x, y = F.lower(a), F.lower(b)
    dropped = x.endswith(".") | y.endswith(".") | (signs(x) == 0) | (signs(y) == 0)
    return F.when((x != y) & (unpunctuated(a) != "") & (unpunctuated(a) == unpunctuated(b)), F.when(dropped, "S1b").otherwise("S1c"))


def supported_pairs(lines: DataFrame, least: int) -> DataFrame:
    """(id_a, id_b, posts): accounts that stand on one line in at least so many posts. lines: post_id, line_id, account_id.

    Accounts of fewer posts can't be in such a pair and go first. Lines with the same accounts are one set, whose pairs are
    made once; the posts of its lines bound the count of a pair, and only pairs that can reach it are counted exactly.
    """
    rows = lines.where("account_id is not null and post_id is not null").select("post_id", "line_id", "account_id").distinct()
    often = rows.groupBy("account_id").agg(F.count_distinct("post_id").alias("n")).where(F.col("n") >= least).select("account_id")
    sets = rows.join(often, "account_id").groupBy("post_id", "line_id").agg(F.array_sort(F.collect_set("account_id")).alias("members")).where(F.size("members") > 1)
    sets = sets.select("post_id", "members").distinct()
    each = sets.groupBy("members").agg(F.count("*").alias("n"))
    first = each.select("members", "n", F.posexplode("members").alias("at", "id_a"))
    pairs = first.select("members", "n", "id_a", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("id_b"))
    able = pairs.groupBy("id_a", "id_b").agg(F.sum("n").alias("bound")).where(F.col("bound") >= least).select("id_a", "id_b")
    exact = pairs.join(able, ["id_a", "id_b"]).join(sets, "members").groupBy("id_a", "id_b").agg(F.count_distinct("post_id").alias("posts"))
    return exact.where(F.col("posts") >= least)


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def signals(accounts: DataFrame, lines: DataFrame, readings: DataFrame, listing_hosts: list[str], most: int = MOST_IN_GROUP) -> DataFrame:
    """(id_a, id_b, code, posts, alike): the signals between accounts but for S6, a row for each; see `proposals`."""
    near = accounts.where("in_scope")
    group = lambda rows, code: pairs_in_groups(rows.where("block is not null"), most).select("id_a", "id_b", F.lit(code).alias("code"))
    kept = lambda c, n: F.when(F.char_length(c) >= n, c)
    found = [
        group(near.select("id", kept(stem(F.col("username")), LEAST_STEM).alias("block")), "S1"),
        group(near.select("id", kept(F.lower(F.trim("full_name")), 4).alias("block")), "S2"),
        group(near.select("id", F.nullif(url_key(without_tracking("url")), F.lit("")).alias("block")), "S3"),
    ]
    name = host("url")
    listed = reduce(lambda a, b: a | b, [name.endswith(h) for h in listing_hosts], name.rlike(LISTING_HOST))
    scope = accounts.select("id", "in_scope")
    shared = group(accounts.select("id", F.when(~listed, name).alias("block")), "S3b")
    shared = shared.join(scope.select(F.col("id").alias("id_a"), F.col("in_scope").alias("x")), "id_a").join(scope.select(F.col("id").alias("id_b"), F.col("in_scope").alias("y")), "id_b").where("x or y")
    found.append(shared.select("id_a", "id_b", "code"))
    named = near.select("id", "username", unpunctuated(F.col("username")).alias("plain")).where("plain <> ''")
    other = named.select(F.col("id").alias("id_b"), F.col("username").alias("username_b"), "plain")
    met = named.withColumnRenamed("id", "id_a").join(other, "plain").where("id_a < id_b").withColumn("code", punctuation_signal(F.col("username"), F.col("username_b")))
    found.append(met.where("code is not null").select("id_a", "id_b", "code"))
    every = reduce(DataFrame.unionByName, found).select("*", F.lit(None).cast("long").alias("posts"), F.lit(None).cast("string").alias("alike"))
    by_name = near.select(F.col("id").alias("other"), F.lower("username").alias("handle"))
    said = near.select("id", "biography", F.explode(mentions("biography")).alias("handle")).join(by_name, "handle").where("id <> other")
    told = said.select(*pair("id", "other"), F.lit("S4").alias("code"), F.lit(None).cast("long").alias("posts"), F.coalesce(mention_kind(mention_snippet(F.col("biography"), F.col("handle"))), F.lit("unclassified")).alias("alike"))
    credited = supported_pairs(lines.join(near.select(F.col("id").alias("account_id")), "account_id"), CREDIT_POSTS)
    guessed = readings.select("post_id", "anchor_id", F.regexp_replace(F.lower(F.trim("guess")), "^@", "").alias("handle")).join(by_name, "handle").where("anchor_id <> other")
    read = guessed.select("post_id", *pair("anchor_id", "other")).groupBy("id_a", "id_b").agg(F.count_distinct("post_id").alias("posts")).where(F.col("posts") >= READER_POSTS)
    count = lambda df, code: df.select("id_a", "id_b", F.lit(code).alias("code"), "posts", F.lit(None).cast("string").alias("alike"))
    return every.unionByName(told).unionByName(count(credited, "S5")).unionByName(count(read, "S7"))


def cards(accounts: DataFrame, known: DataFrame, denied: list[str]) -> DataFrame:
    """What pairs need to know of an account, worked out once for each; see `proposals`."""
    no, handle = F.lit(False), F.lower("username")
    worship = [F.col("username").rlike(WORSHIP), F.col("full_name").rlike(WORSHIP_WORD), F.col("biography").rlike(WORSHIP_WORD)]
    trade = [F.col("biography").rlike(OTHER_TRADE) & ~F.col("biography").rlike(OWN_PLACE), F.col("category") != "venue"]
    related = reduce(lambda x, y: x | y, [F.coalesce(t, no) for t in [*worship, *trade, *([handle.isin(denied)] if denied else [])]])
    other = F.coalesce(F.col("username").rlike(TRADE_HANDLE), no) | F.coalesce(F.col("username").rlike(UMBRELLA), no)
    can_be_edited = F.coalesce(F.col("in_scope") & (F.char_length("username") >= LEAST_HANDLE), no)
    real = F.col("followers").isNotNull() | (F.coalesce("events", F.lit(0)) >= REAL_EVENTS)
    whole = known.groupBy(F.col("alias_id").alias("id")).agg(F.min("canonical_id").alias("canonical"))
    each = accounts.select(
        "id", handle.alias("name"), stem(F.col("username")).alias("stem"), F.coalesce(unpunctuated(F.col("username")), F.lit("")).alias("plain"), related.alias("related"), F.coalesce(F.col("category") == "venue", no).alias("venue"), other.alias("other"),
        (can_be_edited & real).alias("real"), (can_be_edited & F.col("followers").isNull() & ~F.col("scraped")).alias("unseen"), F.struct((~F.col("scraped")).alias("s"), F.coalesce(F.col("full_name") == "", F.lit(True)).alias("n"), (-F.coalesce("followers", F.lit(-1))).alias("f"), F.coalesce(handle, F.lit("")).alias("u"), F.col("id").alias("i")).alias("rank"),
    )
    return each.join(whole, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))


def side(rows: DataFrame, end: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{end}") for c in rows.columns])


def one_is_edited() -> Column:
    """Whether one of two accounts was never seen and the other is real."""
    return (F.col("real_a") & F.col("unseen_b")) | (F.col("real_b") & F.col("unseen_a"))


def trusted() -> Column:
    """Whether two long stems are one edit apart at most."""
    return F.coalesce((F.char_length("stem_a") >= LEAST_TRUSTED_STEM) & (F.char_length("stem_b") >= LEAST_TRUSTED_STEM) & (F.levenshtein("stem_a", "stem_b", 1) >= 0), F.lit(False))


def edited(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """Pairs of cards whose only signal is S6, sides in any order, with `trusted`. paired: id_a, id_b of pairs that are told elsewhere.

    Handles are compared once however many accounts have them, and accounts meet on the handles: a pair is written where it
    is made and neither moved nor compared again. What is told elsewhere is kept with the account, if it is such a pair.
    """
    names = rows.where("real or unseen").groupBy("name").agg(F.first("stem").alias("stem"), F.first("plain").alias("plain"), F.bool_or("real").alias("real"), F.bool_or("unseen").alias("unseen"))
    near = within_edits(names.select(F.struct("name", "stem", "plain", "real", "unseen").alias("id"), "name"), MOST_EDITS).where("distance >= 1")
    near = near.select("id_a.name", "id_a.stem", "id_a.plain", "id_a.real", "id_a.unseen", "id_b").toDF("name_a", "stem_a", "plain_a", "real_a", "unseen_a", "b")
    near = near.select("*", *[F.col(f"b.{c}").alias(f"{c}_b") for c in ("name", "stem", "plain", "real", "unseen")]).where(one_is_edited())
    near = near.where((F.col("plain_a") != F.col("plain_b")) | (F.col("plain_a") == "")).select("name_a", "name_b", trusted().alias("trusted"))  # else S1b or S1c tells of it
    kinds = rows.select("id", "name", "real", "unseen")
    both = paired.join(side(kinds, "a"), "id_a").join(side(kinds, "b"), "id_b").where(one_is_edited()).where(F.levenshtein("name_a", "name_b", MOST_EDITS) >= 1)
    told = both.select(F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))).alias("x")).groupBy(F.col("x.id_a").alias("id")).agg(F.collect_set("x.id_b").alias("told"))
    able = rows.where("real or unseen").select("id", "name", "related", "real", "unseen", "rank", "canonical")
    met = near.join(side(able.join(told, "id", "left"), "a"), "name_a").join(side(able, "b"), "name_b").where(one_is_edited())
    return met.where(~F.coalesce(F.array_contains("told_a", F.col("id_b")), F.lit(False)))


def tier() -> Column:
    """T1, T2 or T3 by the codes of a pair (`codes`, `both_venues`, `alias_like`, `host_counts`, `edits_count`, `credit_posts`, `reader_posts`)."""
    has = lambda c: F.array_contains("codes", c)
    several = F.size("codes") >= 2
    sure = has("S1b") | (has("S2") & F.col("both_venues")) | (has("S4") & F.col("alias_like")) | (F.col("host_counts") & several)
    likely = several | F.col("host_counts") | (F.col("credit_posts") >= MANY_CREDIT_POSTS) | F.col("edits_count") | (F.col("reader_posts") >= MANY_READER_POSTS)
    return F.when(sure, "T1").when(likely, "T2").otherwise("T3")


def proposals(accounts: DataFrame, lines: DataFrame, readings: DataFrame, known: DataFrame, listing_hosts: list[str], denied: list[str], apart: list[tuple[str, str]], most: int = MOST_IN_GROUP) -> DataFrame:
    """(id_a, id_b, signals, tier, alias_id, canonical_id, section): pairs of accounts that may be one, a row for each.

    accounts: id, username, full_name, url, biography, followers, scraped, category, events, in_scope; lines: post_id, line_id,
    account_id (venues credited on one line); readings: post_id, anchor_id, guess (the handle that a reader named instead);
    known: alias_id, canonical_id. S1 equal stems, S1b and S1c punctuation, S2 equal names, S3 equal links, S3b equal hosts that
    list no others' pages (one side in scope is enough), S4 a biography that names the other, S5 one credit line in two
    posts, S6 two edits between a handle that was never seen and a real one, S7 two readings. Groups of more than `most` say nothing.
    The side with a profile, a name, more followers, the lesser handle is kept. Pairs that are one already are left out; houses
    of worship, other trades, denied handles and pairs, and accounts that only name a relation go to the section `related`.
    Null handles have no signal of a handle; repeated ids count once.
    """
    # of repeated ids one row, the same on every run
    rows = accounts.groupBy("id").agg(F.min(F.struct("username", "full_name", "url", "biography", "followers", "scraped", "category", "events", "in_scope")).alias("x")).select("id", "x.*")
    rows = rows.withColumn("scraped", F.coalesce("scraped", F.lit(False))).withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    ensure_checkpoints(accounts.sparkSession)
    card = cards(rows, known, denied).checkpoint()
    no = F.lit(False)
    each = signals(rows, lines, readings, listing_hosts, most)
    grouped = each.groupBy("id_a", "id_b").agg(
        F.collect_set("code").alias("codes"), F.coalesce(F.bool_or(F.col("alike") == "alias_like"), no).alias("alias_like"),
        F.coalesce(F.bool_and(F.col("alike") == "related_not_alias"), no).alias("only_related"),
        F.coalesce(F.max(F.when(F.col("code") == "S5", F.col("posts"))), F.lit(0)).alias("credit_posts"), F.coalesce(F.max(F.when(F.col("code") == "S7", F.col("posts"))), F.lit(0)).alias("reader_posts"),
    ).checkpoint()
    one = known.select(*pair("alias_id", "canonical_id")).distinct()
    columns = ["id_a", "id_b", "codes", "alias_like", "only_related", "credit_posts", "reader_posts", "trusted", "both_venues", "neither_other", *[f"{c}_{e}" for c in ("name", "related", "canonical", "rank") for e in "ab"]]
    p = grouped.join(one, ["id_a", "id_b"], "left_anti").join(side(card, "a"), "id_a").join(side(card, "b"), "id_b")
    edits = F.coalesce(one_is_edited() & (F.levenshtein("name_a", "name_b", MOST_EDITS) >= 1), no)
    p = p.withColumn("codes", F.array_sort(F.when(edits, F.array_append("codes", "S6")).otherwise(F.col("codes"))))
    p = p.withColumn("trusted", trusted()).withColumn("both_venues", F.col("venue_a") & F.col("venue_b")).withColumn("neither_other", ~F.col("other_a") & ~F.col("other_b")).select(columns)
    # pairs of S6 alone, of which there may be very many, have none of what other signals say
    alone = edited(card, grouped.select("id_a", "id_b").unionByName(one).distinct())
    alone = alone.select("*", F.array(F.lit("S6")).alias("codes"), no.alias("alias_like"), no.alias("only_related"), F.lit(0).cast("long").alias("credit_posts"), F.lit(0).cast("long").alias("reader_posts"), no.alias("both_venues"), no.alias("neither_other")).select(columns)
    return judged(p, apart).unionByName(judged(alone, apart))


def judged(p: DataFrame, apart: list[tuple[str, str]]) -> DataFrame:
    """Pairs with all that is known of both sides as proposals, but for those that are one already."""
    no = F.lit(False)
    p = p.where(F.col("canonical_a") != F.col("canonical_b"))
    a, b = F.col("name_a"), F.col("name_b")
    split = reduce(lambda x, y: x | y, [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in apart], no)
    has = lambda c: F.array_contains("codes", c)
    soft = (F.size("codes") == 1) & has("S4") & F.col("only_related")
    p = p.withColumn("host_counts", has("S3b") & F.col("neither_other"))
    p = p.withColumn("edits_count", has("S6") & (has("S1") | has("S3b") | F.col("trusted")))
    first = F.col("rank_a") <= F.col("rank_b")
    out = F.coalesce(F.col("related_a") | F.col("related_b") | split | soft, no)
    return p.select(
        *pair("id_a", "id_b"), F.array_join("codes", ",").alias("signals"), F.when(out, "T3").otherwise(tier()).alias("tier"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("alias_id"),
        F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("canonical_id"), F.when(out, "related").otherwise("proposal").alias("section"),
    )
