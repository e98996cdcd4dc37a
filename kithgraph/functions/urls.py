"""Scores of URLs for a crawl, robots rules, and HTML as text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a URL's path adds to its crawl score.
SCORES = [
    (r"/wedding(s)?\b|/bridal\b", 6),
    (
        r"/private-events?\b|/special-events?\b|/events?\b|/venue-rental\b|/host-an-event\b|/facility-rental\b|/celebrate\b"
        r"|/rentals?\b|/packages?\b|/pricing\b|/rates?\b|/investment\b",
        5,
    ),
    (r"/faq\b|/policies\b|/questions\b|/terms\b|/legal\b|/contract\b|/agreement\b|/guidelines\b|/planning\b", 6),
    (r"floor-?plans?|/capacit|/ballroom\b|/venues?\b", 4),
    (r"/preferred\b|/vendors?\b|/partners?\b|/caterers?\b|/approved\b|/resources?\b", 3),
    (r"/about\b|/contact\b|/amenities\b|/features\b|/gallery\b|/tour\b|/virtual-tour\b|/sustainability\b", 2),
    (
        r"/rooms?(?!.*(event|wedding))|/accommodations?\b|/stay\b|/suites?\b|/reservations?\b|/book(ing)?\b|/offers?\b|/spa\b"
        r"|/dining(?!.*private)",
        -10,
    ),
]
SPACE, SPACE_CONTEXT = r"/spaces?\b|/rooms?\b", r"event|wedding|ballroom|venue"
SPACE_NAME = (
    r"\b(hall|ballroom|terrace|terraces|atrium|gallery|pavilion|garden|gardens|loft|rooftop|salon|lounge|courtyard|conservatory"
    r"|chapel|barn|greenhouse|patio|deck|theater|theatre|library|parlor|solarium|veranda|winery|mezzanine|penthouse)\b"
)
NOISE = (
    r"/blog\b|/news\b|/press\b|/careers?\b|/jobs?\b|/shop\b|/cart\b|/login\b|/account\b|/wp-json\b|/feed\b|/tag/|/category/|/author/"
    r"|/page/\d+|/calendar\b|/exhibit\b|/visit\b|/tickets?\b|/membership\b|/education\b|/donate\b|/mitzvah\b|/corporate\b|/meetings?\b"
    r"|\?replytocom|\?utm_|\?s=|#|/staff\b|/people\b|/team\b|/leadership\b|/profile/|/internships?\b|/volunteer|/member(ship)?\b"
    r"|/history\b|/licensing\b|/copyright|/privacy|/non-discrimination|/land-acknowledg|/statement\b|/website-terms|/traveling-"
    r"|/workplace\b|/business-services\b|/centers-and-offices\b|/research\b|/collections?\b|/science\b|/learn\b|/exhibitions?\b"
    r"|/annual-report"
)
NO_PAGE = (
    r"\.(jpg|jpeg|png|gif|webp|svg|ico|zip|rar|7z|doc|docx|xls|xlsx|ppt|pptx|mp4|mov|mp3|wav|avi|css|js|json|xml|woff2?|ttf|eot|dmg|exe)$"
    r"|/wp-content/uploads/"
)
RELEVANT_PDF = r"(?i)wedding|brochure|menu|bar|beverage|package|pricing|rate|capacity|floor|plan|vendor|contract|agreement|guideline|catering|faq"
FROM_NAV, FROM_GOOD_PARENT, GOOD_PARENT = 2, 3, 5


def url_score(url: Column, from_nav: Column | None = None, anchor: Column | None = None, parent_score: Column | None = None) -> Column:
    """The additive score of a URL by its path, for a crawl; null for what is not to be fetched.

    A link out of the navigation counts more, and so does one from a page of a good score; a PDF counts by its URL and the
    text of its link.
    """
    parts = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)(.*)$"
    path, rest = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_extract(url, parts, 2))
    adds = [(path.rlike(pattern), n) for pattern, n in SCORES]
    adds += [(path.rlike(SPACE) & path.rlike(SPACE_CONTEXT), 4), (F.regexp_replace(path, "[-_/]+", " ").rlike(SPACE_NAME), 4), (F.concat(path, rest).rlike(NOISE), -10)]
    if from_nav is not None:
        adds.append((from_nav, FROM_NAV))
    if parent_score is not None:
        adds.append((parent_score >= GOOD_PARENT, FROM_GOOD_PARENT))
    out = F.lit(0)
    for test, n in adds:
        out = out + F.when(test, n).otherwise(0)
    pdf = path.rlike(r"\.pdf$")
    told = url if anchor is None else F.concat_ws(" ", url, anchor)
    out = out + F.when(pdf & told.rlike(RELEVANT_PDF), 5).when(pdf, -5).otherwise(0)
    return F.when(~url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://") | (~pdf & path.rlike(NO_PAGE)), F.lit(None).cast("int")).otherwise(out)


def crawl_order(links: DataFrame, per_host: int) -> DataFrame:
    """The best links of each host: (url, host, score, place). A link to another host than its page's is left out unless it is a PDF."""
    from kithgraph.functions.text import host
    from kithgraph.operators.helpers import latest_rank

    rows = links.select("url", host("url").alias("host"), url_score(F.col("url")).alias("score")).where("score is not null and host is not null").distinct()
    return latest_rank(rows, ["host"], [F.desc("score"), F.length("url"), F.col("url")]).where(F.col("rn") <= per_host).withColumnRenamed("rn", "place")


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed) by the longest matching rule of the host, allow before disallow on ties; without rules allowed.

    rules: host, pattern (* matches anything, a final $ the end), allow.
    """
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?^(){}\[\]|\\])", r"\\$1"), r"\*", ".*"), r"\$$", r"\$"))
    met = paths.join(rules.select("host", "pattern", "allow", regex.alias("regex")), "host", "left")
    hit = met.groupBy("host", "path").agg(F.max(F.when(F.col("pattern").isNotNull() & F.expr("path rlike regex"), F.struct(F.length("pattern").alias("n"), "allow"))).alias("best"))
    return hit.select("host", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "table", "ul", "ol"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None) -> tuple[str, list[str]]:
    """The visible text of a page, blanks folded, a line per block, and its links."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x), parser.links


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, links, sha256) of pages (page_id, url, html): a worker holds some hundred pages at once, whatever an
    Arrow batch holds; hashed in the plan."""
    parsed = F.udf(html_text, "text string, links array<string>", useArrow=False)
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), parsed("html").alias("page"))
    return out.select("page_id", "url", "page.text", "page.links", F.sha2("page.text", 256).alias("sha256"))
