"""Evidence, truth and content views over posts, credits, labels and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.helpers import latest_by, priority_pick

#: The least score of posts worth a model's look.
LEAST_SCORE = 12
#: Signs of a couple in a caption.
COUPLE = r"(Mr\.? *& *Mrs\.?|Couple: *@|Bride: *@|[A-Z][a-z]+ *(&|\+|and) *[A-Z][a-z]+)"
#: What the rows of a post say of it, as bits that are joined by or.
IS_POST, HAS_COUPLE, IS_TAGGED, IS_DOCUMENTED = 1, 2, 4, 8
#: Words of a wedding post that names no couple.
OCCASION = r"(?i)(wedding day|.s wedding|their wedding|wedding at |wedding weekend|wedding celebration|wedding reception|wedding ceremony|congrat.*wedding|bride|groom|mr\.? *& *mrs\.?)"
#: Cities and regions elsewhere.
ELSEWHERE = r"(?i)(new york|los angeles|miami|dallas|houston|atlanta|denver|seattle|boston|nashville|austin|san francisco|milwaukee|indianapolis|detroit|florida|california|texas|tuscany|italy|mexico|paris|london)"
HERE = r"(?i)chicago"
#: Signs of a styled shoot.
STYLED = [
    r"(?i)(styled shoot|styled editorial|this styled|editorial shoot|stylized shoot|style.?d wedding)",
    r"(?i)#(styledshoot|stylizedshoot|editorialshoot|flatlaystyling)\b",
    r"(?i)\b(styled?|editorial|concept)\s+(shoot|session|editorial)\b",
    r"(?i)#(styledshoot|styledshoots|stylizedshoot|editorialshoot|inspirationshoot|styledweddingshoot)\b",
]
STYLED_PAIRS = [(r"(?i)\bmodels?\s*[:|]", r"(?i)\b(shoot|styled|editorial|session)\b"), (r"(?i)\bstyled by\b", r"(?i)\bshoot\b")]
STYLED_WORD = r"(?i)styl"


def latest_entries(entries: DataFrame) -> DataFrame:
    """The latest entry per (post, line, handle); of equal times the larger entry id. Roles `other` are left out after that."""
    return latest_by(entries, ["post_url", "line_no", "handle"], [F.desc("extracted_at"), F.desc("entry_id")]).where("role <> 'other'")


def model_evidence(entries: DataFrame, accounts: DataFrame, scores: DataFrame, runs: DataFrame, version: str = "v3") -> DataFrame:
    """Credits of posts that score high enough and whose latest run of a version says INCLUDE (latest first, then the test)."""
    current = latest_by(runs.where(F.col("version") == version), ["post_url"], [F.desc("classified_at"), F.desc("run_id")]).where("decision = 'INCLUDE'")
    good = scores.where(F.col("score") >= LEAST_SCORE).select("post_url", "score").join(current.select("post_url", "confidence"), "post_url")
    return with_accounts(latest_entries(entries), accounts).join(good, "post_url")


def with_accounts(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Entries with the id of the account of their handle, whatever its case."""
    return entries.join(accounts.select(F.lower("username").alias("handle"), "account_id"), "handle")


def human_evidence(entries: DataFrame, accounts: DataFrame, golden: DataFrame) -> DataFrame:
    """Credits of posts that people confirmed."""
    return with_accounts(latest_entries(entries), accounts).join(golden.where("expected_decision = 'INCLUDE'"), "post_url", "left_semi")


def cluster_vendors(cluster_posts: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Per cluster, account and role the posts that confirm it; the second source counts only for posts that the first lacks."""
    rest = second.join(first.select("post_url").distinct(), "post_url", "left_anti")
    both = first.select("post_url", "account_id", "role").unionByName(rest.select("post_url", "account_id", "role"))
    return cluster_posts.join(both, "post_url").groupBy("cluster_id", "account_id", "role").agg(F.countDistinct("post_url").alias("n_confirmations"))


def anchors(sources: Sequence[DataFrame]) -> DataFrame:
    """The venue of each post from sources in order of rank: credit line, location tag, author, inline mention, hashtag, extraction.

    Each source: post_url, label_rank, line_no, account_id. Within a source by label rank, line, then least account.
    """
    return priority_pick(sources, ["post_url"], [F.col("label_rank"), F.col("line_no"), F.col("account_id")])


def conflicts(sources: Sequence[DataFrame]) -> DataFrame:
    """Posts whose sources name more than one venue."""
    every = None
    for s in sources:
        part = s.select("post_url", "account_id")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("post_url").agg((F.countDistinct("account_id") > 1).alias("anchor_conflict"))


def geography(posts: DataFrame, venues: DataFrame) -> DataFrame:
    """Where a post is, by ordered rules: (post_url, status).

    posts: post_url, caption, location_tag. venues: post_url, in_metro (three-valued), one row per venue of the post.
    """
    signal = venues.groupBy("post_url").agg(F.bool_or(F.col("in_metro")).alias("yes"), F.bool_or(~F.col("in_metro")).alias("no"), F.lit(True).alias("any"))
    rows = posts.join(signal, "post_url", "left")
    says = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    status = (
        F.when(F.col("yes"), "CONFIRMED").when(says("location_tag", HERE) | says("caption", HERE), "CONFIRMED").when(F.col("no"), "NOT_CONFIRMED")
        .when(says("location_tag", ELSEWHERE) | says("caption", ELSEWHERE), "NOT_CONFIRMED").when(F.col("any"), "AMBIGUOUS").otherwise("NO_SIGNAL")
    )
    return rows.select("post_url", status.alias("status"))


def association(posts: DataFrame, vendors: DataFrame, evidence: DataFrame) -> DataFrame:
    """How a post is tied to vendors: BOTH, AUTHOR_ONLY, TAGGED_ONLY or NONE. posts: post_url, author_id."""
    tagged = evidence.groupBy("post_url").agg(F.countDistinct("account_id").alias("tagged"))
    known = vendors.select(F.col("account_id").alias("author_id"), F.lit(True).alias("is_vendor")).distinct()
    rows = posts.join(known, "author_id", "left").join(tagged, "post_url", "left")
    author, n = F.coalesce("is_vendor", F.lit(False)), F.coalesce("tagged", F.lit(0))
    kind = F.when(author & (n > 0), "BOTH").when(author, "AUTHOR_ONLY").when(n > 0, "TAGGED_ONLY").otherwise("NONE")
    return rows.select("post_url", author.alias("author_is_vendor"), n.alias("tagged_vendor_count"), kind.alias("association"))


def portfolio(posts: DataFrame, tagged: DataFrame, documented: DataFrame) -> DataFrame:
    """Posts of venues' portfolios, own before tagged, with captions of more than 15 characters; `is_tagged`: any account is tagged.

    posts: post_url, caption (one a post), account_id (of the venue whose profile it is on, or null); tagged: post_url, account_id;
    documented: post_url. All three meet in one aggregation of numbers per post, with no join and nothing sorted. Rows are dealt to its
    tasks before: the posts of a file's part have few rows in common, so combining them there would hold all of them.
    """
    no_one = F.lit(None).cast(tagged.schema["account_id"].dataType)
    couple = F.when(F.col("caption").rlike(COUPLE), F.lit(IS_POST | HAS_COUPLE)).otherwise(IS_POST)
    rows = posts.where(F.char_length(F.trim("caption")) > 15).select("post_url", F.col("account_id").alias("own"), no_one.alias("other"), couple.alias("marks"))
    rows = rows.unionByName(tagged.select("post_url", no_one.alias("own"), F.col("account_id").alias("other"), F.lit(IS_TAGGED).alias("marks")))
    rows = rows.unionByName(documented.select("post_url", no_one.alias("own"), no_one.alias("other"), F.lit(IS_DOCUMENTED).alias("marks")))
    tasks = 4 * int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.repartition(tasks, "post_url").groupBy("post_url").agg(F.min("own").alias("own"), F.min("other").alias("other"), F.bit_or("marks").alias("marks"))
    has = lambda mark: F.col("marks").bitwiseAND(F.lit(mark)) > 0
    is_own = F.col("own").isNotNull()
    one = one.where(has(IS_POST) & (is_own | has(IS_TAGGED)))
    return one.select("post_url", F.coalesce("own", "other").alias("account_id"), F.when(is_own, "own_profile").otherwise("tagged").alias("connection"), has(HAS_COUPLE).alias("has_couple_evidence"), has(IS_DOCUMENTED).alias("is_documented"), has(IS_TAGGED).alias("is_tagged"))


def has_styled_phrase(caption: Column) -> Column:
    """Whether a caption says that it shows a styled shoot."""
    any_of = [caption.rlike(p) for p in STYLED] + [caption.rlike(a) & caption.rlike(b) for a, b in STYLED_PAIRS]
    out = any_of[0]
    for x in any_of[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def styled_signal(posts: DataFrame, golden: DataFrame, networks: Sequence[str] = (), repeats: int = 2) -> DataFrame:
    """How sure it is that a post shows a styled shoot: CONFIRMED, LIKELY, POSSIBLE or NO_SIGNAL.

    posts: post_url, caption, author. golden: post_url of those that people called styled. Authors of `repeats` such posts,
    and known networks, make a post possible.
    """
    marked = golden.select("post_url").distinct().withColumn("_g", F.lit(True))
    rows = posts.join(marked, "post_url", "left")
    authors = rows.where("_g and author is not null").groupBy("author").agg(F.count("*").alias("_n")).where(F.col("_n") >= repeats).select("author", F.lit(True).alias("_r"))
    rows = rows.join(authors, "author", "left")
    known = F.coalesce(F.col("author").isin(*networks), F.lit(False)) if networks else F.lit(False)
    level = F.when(F.col("_g"), "CONFIRMED").when(has_styled_phrase(F.col("caption")), "LIKELY").when(F.coalesce("_r", F.lit(False)) | known | F.coalesce(F.col("caption").rlike(STYLED_WORD), F.lit(False)), "POSSIBLE").otherwise("NO_SIGNAL")
    return rows.select("post_url", level.alias("confidence"))


def rolled_up(signals: DataFrame) -> DataFrame:
    """Per event the surest styled signal of its posts and how many have any; events without are left out."""
    order = F.array(F.lit("POSSIBLE"), F.lit("LIKELY"), F.lit("CONFIRMED"))
    per = signals.groupBy("event_id").agg(F.max(F.array_position(order, F.col("confidence"))).alias("k"), F.count_if(F.col("confidence") != "NO_SIGNAL").alias("flagged"))
    return per.where("k > 0").select("event_id", F.element_at(order, F.col("k").cast("int")).alias("confidence"), "flagged")


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """A candidate's decision from its posts' verdicts: any THIS_VENUE confirms, then OTHER_VENUE, DUPLICATE, all NOT_WEDDING."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    decision = F.when(has("THIS_VENUE"), "CONFIRM").when(has("OTHER_VENUE"), "WRONG_VENUE").when(has("DUPLICATE"), "DUPLICATE").when(F.bool_and(F.col("verdict") == "NOT_WEDDING"), "NOT_WEDDING").otherwise("UNSURE")
    return verdicts.groupBy("candidate_id").agg(decision.alias("decision"), F.count_if(F.col("verdict") != "SKIP").alias("decided"))


def truth(posts: DataFrame, labels: DataFrame, human: DataFrame, model: DataFrame, attached: DataFrame, retired: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row per post with its label, tier and source, from sources that are never blended.

    People's labels and verdicts are gold and conflict if they differ; a model's verdict, retirement or attachment is
    silver; membership of a cluster is bronze. labels: post_id, decision, at. human, model: post_id, verdict, at. Ties in
    time go to the later id.
    """
    last = lambda df, value, name: latest_by(df, ["post_id"], [F.desc("at"), F.desc("id")]).select("post_id", F.col(value).alias(name))
    flag = lambda df, name: df.select("post_id").distinct().withColumn(name, F.lit(True))
    rows = posts.select("post_id").join(last(labels, "decision", "hl"), "post_id", "left").join(last(human, "verdict", "hv"), "post_id", "left").join(last(model, "verdict", "mv"), "post_id", "left")
    rows = rows.join(flag(attached, "att"), "post_id", "left").join(flag(retired, "ret"), "post_id", "left").join(flag(clustered, "clu"), "post_id", "left")
    venue = lambda c: F.when(F.col(c).isin("THIS_VENUE", "OTHER_VENUE"), "wedding").when(F.col(c) == "NOT_WEDDING", "not_wedding")
    a = F.when(F.col("hl") == "WEDDING", "wedding").when(F.col("hl") == "NOT_WEDDING", "not_wedding")
    b, m = venue("hv"), venue("mv")
    att, ret, clu = (F.coalesce(F.col(c), F.lit(False)) for c in ("att", "ret", "clu"))
    conflict = F.coalesce(a != b, F.lit(False))
    gold = F.coalesce(a, b)
    label = F.when(conflict, "conflicting").when(gold.isNotNull(), gold).when(m.isNotNull(), m).when(ret, "not_wedding").when(att | clu, "wedding").otherwise("unknown")
    tier = F.when(gold.isNotNull(), "gold").when(m.isNotNull() | ret | att, "silver").when(clu, "bronze")
    source = (
        F.when(a.isNotNull() & b.isNotNull(), "human_label+human_verdict").when(a.isNotNull(), "human_label").when(b.isNotNull(), "human_verdict")
        .when(m.isNotNull(), "model_verdict").when(ret, "retired").when(att, "attachment").when(clu, "cluster")
    )
    retire = F.coalesce(gold == "not_wedding", F.lit(False)) & att & ~conflict
    torn = gold.isNull() & (F.coalesce(m.isNotNull() & ((ret & (m != "not_wedding")) | (att & (m != "wedding"))), F.lit(False)) | (ret & att))
    return rows.select("post_id", label.alias("label"), tier.alias("tier"), source.alias("source"), retire.alias("retirement_candidate"), torn.alias("silver_disagreement"))
