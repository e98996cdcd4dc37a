"""A crawl as rounds over tables: open links by score, what was fetched, what stays out; and the page about events of a site.

Fetching is another system's: captures (one row per URL key) stand for what a fetch gives. Each round settles the best open
link of every site that has a capture, together with the links before it that have none, so a site sees its links in the
order of one queue while all sites go on at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.pages import NO_TARGET, PDF, SHELL_CHARS
from kithgraph.functions.text import host
from kithgraph.functions.urls import RELEVANT_PDF, allowed, url_score
from kithgraph.session import checkpoint_path

# Scores of a site's own event page and of a listed page, limits of a site, answers that end its crawl.
SEED_SCORE, EVENT_PAGE_SCORE, HOME_SCORE = 10.0, 18.0, float("inf")
MAX_PAGES, MAX_PDFS, MAX_DEPTH, HTML_BYTES, PDF_BYTES = 30, 8, 3, 2 * 1024 * 1024, 15 * 1024 * 1024
BLOCKED = [403, 429, 503]
# Pages about events, strictly and broadly, pages that only go with them, terms by rank, paths to try.
STRICT = r"(?i)wedding|bridal|nuptial"
BROAD = r"(?i)wedding|bridal|nuptial|celebrat|private[-_ ]?event|special[-_ ]?event|social[-_ ]?event|host[-_ ]?an[-_ ]?event|venue[-_ ]?rental"
SECONDARY = r"(?i)gallery|photos?|inquir|form|contact|blog|faq|rsvp|registry|guest"
TERMS = [STRICT, r"(?i)celebrat", r"(?i)private[-_ ]?event|special[-_ ]?event|social[-_ ]?event", r"(?i)host[-_ ]?an[-_ ]?event", r"(?i)venue[-_ ]?rental"]
COMMON_PATHS = ["/weddings", "/wedding", "/weddings-events", "/events/weddings", "/private-events/weddings", "/celebrations/weddings", "/weddings/"]

QUEUE = "site string, key string, url string, depth int, score double, is_pdf boolean, source string, seen_in int, place int"


def page_key(url: Column) -> Column:
    """What makes two URLs one page: host without www, path without a last slash, query; lower case, without scheme and fragment."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(www\.)?", ""), r"#.*$", "")
    return F.regexp_replace(out, r"/+(?=$|\?)", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def start_queue(sites: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The open links of a crawl's start (QUEUE). sites: homepage, event_url; seeds: homepage, url. A home page comes first, then the
    site's event page unless it is the same page, then its seeds, which may lie on any host."""
    home = sites.where("homepage is not null").select(host("homepage").alias("site"), "homepage", "event_url").where("site is not null")
    row = lambda url, score, source: ["site", page_key(url).alias("key"), url.alias("url"), F.lit(0).alias("depth"), F.lit(score).alias("score"), url.rlike(PDF).alias("is_pdf"), F.lit(source).alias("source"), F.lit(-1).alias("seen_in"), F.lit(0).alias("place")]
    out = home.select(*row(F.col("homepage"), HOME_SCORE, "home"))
    own = home.where("event_url is not null").where(page_key(F.col("event_url")) != page_key(F.col("homepage")))
    out = out.unionByName(own.select(*row(F.col("event_url"), EVENT_PAGE_SCORE, "event_page")))
    if seeds is not None:
        out = out.unionByName(seeds.where("url is not null").select(host("homepage").alias("site"), "url").where("site is not null").select(*row(F.col("url"), SEED_SCORE, "seed")))
    return once(out)


def order() -> Column:
    """How a site's queue is ordered: the best score, then the least depth, then what was seen first."""
    return F.struct((-F.col("score")).alias("a"), F.col("depth").alias("b"), F.col("seen_in").alias("c"), F.col("place").alias("d"), F.col("url").alias("e"))


def once(queue: DataFrame) -> DataFrame:
    """Each page of a site once, as the link that comes first in the order."""
    names = [c.split()[0] for c in QUEUE.split(", ")]
    return queue.groupBy("site", "key").agg(F.min_by(F.struct(*[c for c in names if c not in ("site", "key")]), order()).alias("x")).select("site", "key", "x.*").select(*names)


class CrawlState:
    """The tables of a crawl under one folder: log-n is what round n settled, queue-n what is open after it.

    A round counts once its queue is written, so a crawl that was stopped goes on after its last whole round.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, n: int) -> str:
        return f"{self.folder}/{name}-{n:05d}"

    def whole(self, n: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("queue", n) + "/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def rounds(self) -> int:
        n = 0
        while self.whole(n):
            n += 1
        return n

    def put(self, df: DataFrame, name: str, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, n))
        return self.spark.read.schema(df.schema).parquet(self.path(name, n))

    def queue(self, n: int) -> DataFrame:
        return self.spark.read.schema(QUEUE).parquet(self.path("queue", n))

    def log(self, n: int) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*[self.path("log", i) for i in range(1, n)])


LOG = "site string, key string, url string, depth int, score double, is_pdf boolean, source string, outcome string, round int"


def crawled(
    sites: DataFrame, captures: DataFrame, seeds: DataFrame | None = None, robots: DataFrame | None = None, folder: str | None = None,
    max_pages: int = MAX_PAGES, max_pdfs: int = MAX_PDFS, max_depth: int = MAX_DEPTH, max_rounds: int | None = None,
) -> DataFrame:
    """The log of a crawl (LOG): every page that was asked for, once, with its outcome and round.

    captures: url, status, bytes, n_chars, links (place, href, text, from_nav); of several of one page the one of the least
    URL counts; a page without one is an error of its own. robots: host, pattern, allow. A site's links are taken by score, depth and order of discovery; links
    beyond the depth, and those of a negative score that are deeper than one link, are never taken; a link to another host
    only if it is a PDF that reads like a relevant one, or a seed. Links of a page without text of its own are not followed. A
    status of 403, 429 or 503 ends the site's crawl; too many bytes are an error. `folder` keeps the state and lets a later
    call go on where this one ended; max_rounds ends a call early. Null links and targets are left out; repeated links of a
    page count once; sites without a home page have no crawl.
    """
    spark = sites.sparkSession
    state = CrawlState(spark, folder or f"{checkpoint_path(spark)}/crawl-{uuid.uuid4().hex}")
    n = state.rounds()
    if not n:
        state.put(start_queue(sites, seeds), "queue", 0)
        n = 1
    have = captures.select(page_key(F.col("url")).alias("key"), "status", "bytes", "n_chars", "links", F.struct("url", "n_chars", "bytes").alias("o"))
    have = have.groupBy("key").agg(F.min_by(F.struct("status", "bytes", "n_chars", "links"), "o").alias("x")).select("key", "x.*")
    done = 0
    while max_rounds is None or done < max_rounds:
        queue, settled = state.queue(n - 1), state.log(n) if n > 1 else spark.createDataFrame([], LOG)
        if queue.isEmpty():
            break
        fetched = F.col("outcome").isin("fetched", "js_shell")
        used = settled.groupBy("site").agg(F.count_if(fetched & ~F.col("is_pdf")).alias("pages"), F.count_if(F.col("outcome").isin("fetched", "error", "blocked") & F.col("is_pdf")).alias("pdfs"), F.bool_or(F.col("outcome") == "blocked").alias("ended"))
        live = queue.join(used, "site", "left").where("not coalesce(ended, false)").where(F.when(F.col("is_pdf"), F.coalesce("pdfs", F.lit(0)) < max_pdfs).otherwise(F.coalesce("pages", F.lit(0)) < max_pages)).select(*queue.columns)
        met = live.join(have, "key", "left")
        if robots is not None:
            paths = live.select(host("url").alias("host"), path_of(F.col("url")).alias("path")).distinct()
            met = met.withColumn("host", host("url")).withColumn("path", path_of(F.col("url"))).join(allowed(paths, robots), ["host", "path"], "left").drop("host", "path")
        else:
            met = met.withColumn("allowed", F.lit(True))
        big = F.col("bytes") > F.when(F.col("is_pdf"), PDF_BYTES).otherwise(HTML_BYTES)
        outcome = F.when(~F.coalesce("allowed", F.lit(True)), "robots").when(F.col("status").isin(BLOCKED), "blocked").when(F.col("status").isNull() | (F.col("status") != 200) | big, "error")
        outcome = outcome.when(~F.col("is_pdf") & (F.col("n_chars") < SHELL_CHARS), "js_shell").otherwise("fetched")
        ranked = met.withColumn("outcome", outcome).withColumn("o", order())
        stops = ~F.col("outcome").isin("robots", "error") | F.col("is_pdf")  # what counts against a limit changes what comes next
        first = ranked.where(stops).groupBy("site").agg(F.min("o").alias("first"))
        now = ranked.join(first, "site", "left").where(F.col("first").isNull() | (F.col("o") <= F.col("first")))
        log = state.put(now.select("site", "key", "url", "depth", "score", "is_pdf", "source", "outcome", F.lit(n).alias("round")), "log", n)
        links = log.where("outcome = 'fetched' and not is_pdf").join(have, "key").select("site", "depth", F.col("score").alias("parent"), F.explode("links").alias("x"))
        href, text = F.col("x.href"), F.coalesce(F.col("x.text"), F.lit(""))
        links = links.where(href.isNotNull() & ~href.rlike(NO_TARGET)).withColumn("new", url_score(href, from_nav=F.col("x.from_nav"), anchor=text, parent_score=F.col("parent")).cast("double"))
        relevant = (host(href) == F.col("site")) | (href.rlike(PDF) & F.concat_ws(" ", href, text).rlike(RELEVANT_PDF))
        deeper = F.col("depth") + 1
        links = links.where("new is not null").where(F.coalesce(relevant, F.lit(False)) & (deeper <= max_depth) & ((F.col("new") >= 0) | (deeper <= 1)))
        found = links.select("site", page_key(href).alias("key"), href.alias("url"), deeper.alias("depth"), F.col("new").alias("score"), href.rlike(PDF).alias("is_pdf"), F.lit("link").alias("source"), F.lit(n).alias("seen_in"), F.col("x.place").cast("int").alias("place"))
        rest = once(live.unionByName(found)).join(state.log(n + 1).select("site", "key"), ["site", "key"], "left_anti")
        state.put(rest.select(*queue.columns), "queue", n)
        n, done = n + 1, done + 1
    return state.log(n) if n > 1 else spark.createDataFrame([], LOG)


def event_pages(sites: DataFrame, links: DataFrame, captures: DataFrame, strict: str = STRICT, broad: str = BROAD, secondary: str = SECONDARY, terms: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """(site, url, source, is_secondary): the page about events of each site that has one.

    sites: homepage; links: homepage, place, href, text, from_nav (of the home page); captures: homepage, url, depth, text.
    First the captured pages whose path fits the strict pattern, of those that share the path of their host's shallowest
    page up to its last part, the shortest path; then links of the home page on its own host, strictly by target or text,
    else broadly by target: navigation first, the more special term, the shortest path; then the usual paths, in order, where a
    capture has enough text that fits. Pages that only go with the subject (galleries, forms) count only where a source has no
    other, and paths that the crawl's score rejects do not count. Ties go to the first place, then to the lesser URL. Nulls
    are left out; a site without a page gives no row.
    """
    terms, paths = TERMS if terms is None else terms, COMMON_PATHS if paths is None else paths
    fits = lambda url, p: path_of(url).rlike(p) & F.coalesce(url_score(url) >= 0, F.lit(False))
    second = lambda url: path_of(url).rlike(secondary)
    site = host("homepage").alias("site")
    pages = captures.where("url is not null").select(site, "url", host("url").alias("host"), F.coalesce("depth", F.lit(1 << 30)).alias("depth"), "text").where("site is not null and host is not null")
    parts = lambda url: F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    root = pages.groupBy("site", "host").agg(F.min_by("url", F.struct("depth", "url")).alias("root"))
    scope = F.slice(parts(F.col("root")), F.lit(1), F.greatest(F.size(parts(F.col("root"))) - 1, F.lit(0)))
    inside = F.slice(parts(F.col("url")), F.lit(1), F.size(scope)) == scope
    own = pages.join(root, ["site", "host"]).where(fits(F.col("url"), strict) & inside)
    rank = lambda *cs: F.struct(*[c.alias(f"r{i}") for i, c in enumerate(cs)])
    every = own.select("site", "url", F.lit("captured").alias("source"), second(F.col("url")).alias("is_secondary"), rank(F.lit(0), second(F.col("url")).cast("int"), F.lit(0), F.lit(0), F.char_length(path_of(F.col("url"))), F.lit(0)).alias("rank"))
    a = links.where("href is not null").select(site, "place", F.col("href").alias("url"), F.coalesce("text", F.lit("")).alias("text"), "from_nav").where(host("url") == F.col("site"))
    by_url, by_text = fits(F.col("url"), strict), F.col("text").rlike(strict)
    tier = F.when(by_url | by_text, 1).when(fits(F.col("url"), broad), 2)
    term = lambda c: F.coalesce(*[F.when(c.rlike(p), i) for i, p in enumerate(terms)], F.lit(len(terms)))
    linked = a.withColumn("tier", tier).where("tier is not null")
    linked_rank = rank(F.col("tier"), second(F.col("url")).cast("int"), F.when(F.col("from_nav"), 0).otherwise(1), F.least(term(F.col("url")), term(F.col("text"))), F.char_length(path_of(F.col("url"))), F.col("place").cast("int"))
    every = every.unionByName(linked.select("site", "url", F.lit("homepage_link").alias("source"), second(F.col("url")).alias("is_secondary"), linked_rank.alias("rank")))
    number = F.coalesce(*[F.when(F.lower(path_of(F.col("url"))) == p, i) for i, p in enumerate(paths)]) if paths else F.lit(None).cast("int")
    usual = pages.where(F.col("host") == F.col("site")).withColumn("number", number).where("number is not null").where((F.char_length("text") >= SHELL_CHARS) & F.col("text").rlike(strict))
    every = every.unionByName(usual.select("site", "url", F.lit("common_path").alias("source"), F.lit(False).alias("is_secondary"), rank(F.lit(3), F.lit(0), F.lit(0), F.lit(0), F.col("number"), F.lit(0)).alias("rank")))
    best = every.groupBy("site").agg(F.min(F.struct("rank", "url", "source", "is_secondary")).alias("x"))
    return sites.select(site).where("site is not null").distinct().join(best, "site").select("site", "x.url", "x.source", "x.is_secondary")
