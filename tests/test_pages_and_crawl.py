"""Page structure, the crawl loop and the choice of event pages, with the hard cases and against a sequential crawl."""

import pytest
from kithgraph.functions import pages as P
from kithgraph.functions.urls import url_score
from kithgraph.operators import frontier as R
from kithgraph.plans.crawl import crawl_input
from pyspark.sql import functions as F

BASE = "https://venue.com/weddings"


def structure(spark, *html, url=BASE):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    return P.structures(df).orderBy("page_id")


def page(html, url=BASE):
    p = P.Page(url)
    p.feed(html)
    p.closed()
    return p


def links(html, url=BASE):
    return [(x["href"], x["text"], x["from_nav"]) for x in page(html, url).links]


def assets(spark, html):
    return [(r.kind, r.url, r.label) for r in P.page_assets(structure(spark, html)).orderBy("place").collect()]


def test_a_title_keeps_what_it_does_not_end(spark):
    cases = ["<p>x</p>\n<title>A &amp;&amp\n b &am</title>", '<title>t = &quot;1 &lt;b&gt; &amp;lt;</title><a href="x">y</a>', "<title></title>", "<title>open &amp"]
    got = [r.t for r in structure(spark, *cases).select(P.plain_title(F.col("raw_title")).alias("t"), "page_id").orderBy("page_id").collect()]
    assert got == ["A &&amp b &am", "t = &quot;1 <b> &lt;", "", "open &amp"]


def test_text_title_and_cells():
    p = page("<html><head><title>Hall\n One</title><style>.a{}</style></head><body><script>var x = '</p>';</script><p>Real content</p><table><tr><td>Seated</td><td>150</td></tr></table></body></html>")
    assert P.folded("".join(p.title)) == "Hall One"
    assert P.flowing(p.out).split("\n")[0] == "Real content" and "Seated | 150 |" in P.flowing(p.out)
    assert P.flowing(page("<p>One</p>\n\n\n\n\n\n<p>Two</p>").out) == "One\n\n\nTwo"
    assert P.flowing(page("<p>a<p>b<noscript>no<template>deep</template>er</noscript>c").out) == "a\nbc"


def test_links_base_and_navigation():
    assert links('<a href="/private-events">Private Events</a>') == [("https://venue.com/private-events", "Private Events", False)]
    assert links('<head><base href="https://hotel.com"></head><a href="amenities/">A</a>', "https://hotel.com/weddings/") == [("https://hotel.com/amenities/", "A", False)]
    assert links('<a href="amenities/">A</a>', "https://venue.com/weddings/") == [("https://venue.com/weddings/amenities/", "A", False)]
    assert links('<base href="https://one.example/"><base href="https://two.example/"><a href="x">X</a>') == [("https://one.example/x", "X", False)]
    found = dict((t, n) for _, t, n in links("<nav><div><a href=/w>W</a></div></nav><header><a href=/a>A</a></header><main><a href=/r>R</a></main><div role=navigation><a href=/d>D</a></div><footer><a href=/c>C</a></footer>"))
    assert found == {"W": True, "A": True, "R": False, "D": True, "C": True}
    assert links('<a href="mailto:a@v.com">E</a><a href="tel:+1">C</a><a href="#top">T</a><a href=" javascript:x()">J</a><a>none</a>') == []
    assert links("<nav><a href=/x>X <b>y</nav><a href=/z>Z") == [("https://venue.com/x", "X y", True), ("https://venue.com/z", "Z", False)]


def test_odd_pages(spark):
    rows = structure(spark, None, "", "<p", "plain", "<a href='http://[bad'>x</a>").collect()
    assert [r.text for r in rows] == ["", "", "", "plain", "x"] or [r.text for r in rows][3:] == ["plain", "x"]
    none = spark.createDataFrame([(None, None, "<a href='/x'>X</a>")], "page_id long, url string, html string")
    r = P.structures(none).first()
    assert r.page_id is None and r.links[0].href == "/x"
    assert P.structures(none.limit(0)).count() == 0


ASSETS = [
    ('<h2>Watch</h2><iframe src="https://www.youtube.com/embed/abc123" title="Venue Tour"></iframe>', [("video", "https://www.youtube.com/watch?v=abc123", "Venue Tour")]),
    ('<h2>360 Walkthrough</h2><iframe src="https://my.matterport.com/show/?m=xyz"></iframe>', [("virtual_tour", "https://my.matterport.com/show/?m=xyz", "360 Walkthrough")]),
    ('<iframe src="https://maps.google.com/embed?pb=abc"></iframe>', []),
    ('<video src="/media/r.mp4"></video>', [("video", "https://venue.com/media/r.mp4", "")]),
    ('<img src="/images/plan1.jpg" alt="Floor Plan">', [("floor_plan", "https://venue.com/images/plan1.jpg", "Floor Plan")]),
    ('<h3>Floor Plans</h3><img src="/i.jpg?width=792&amp;height=612">', [("floor_plan", "https://venue.com/i.jpg?width=792&height=612", "Floor Plans")]),
    ('<h2>Our Ballroom</h2><img src="/glam.jpg" alt="A set ballroom">', []),
    ('<h1>Floor Plans</h1><a href="/up/W-1.png">Ceremony (300)</a>', [("floor_plan", "https://venue.com/up/W-1.png", "Ceremony (300)")]),
    ('<a href="/360-tour-hall">360 Tour</a>', [("virtual_tour", "https://venue.com/360-tour-hall", "360 Tour")]),
    ('<img src="/p.jpg" alt="Floor Plan"><img src="/p.jpg" alt="Floor Plan again">', [("floor_plan", "https://venue.com/p.jpg", "Floor Plan")]),
    ('<a href="/f/menu.pdf">American &amp; Italian Menu</a>', [("pdf", "https://venue.com/f/menu.pdf", "American & Italian Menu")]),
    ('<h2>Bar Packages</h2><a href="/docs/bar.pdf"></a>', [("pdf", "https://venue.com/docs/bar.pdf", "Bar Packages")]),
    ('<a href="/f/4b_hash.pdf"></a>', [("pdf", "https://venue.com/f/4b_hash.pdf", "4b_hash.pdf")]),
    ('<img src="data:image/svg+xml;base64,PHN2Zy8+" alt="Floor Plan">', []),
    ('<h2>Floor Plans</h2><img src="/px/pixel.gif"><img src="/plan.jpg" width="1" height="1">', []),
    ('<a href="https://www.youtube.com/@SomeVenue">F</a><a href="https://www.youtube.com/channel/UC1">tour</a><a href="https://vimeo.com/someuser">V</a>', []),
    ('<a href="https://www.youtube.com/watch?v=abc123&list=xyz">Watch</a><iframe src="https://youtu.be/abc123"></iframe>', [("video", "https://www.youtube.com/watch?v=abc123", "Watch")]),
    ('<iframe src="https://player.vimeo.com/video/123?h=abc&amp;fl=pl" title="Tour"></iframe><a href="https://vimeo.com/123/abc?x=1">T</a>', [("video", "https://vimeo.com/123/abc", "Tour")]),
]


@pytest.mark.parametrize(("html", "want"), ASSETS)
def test_assets(spark, html, want):
    assert assets(spark, html) == want


def test_assets_block_round_trip(spark):
    found = P.with_assets_block(structure(spark, '<p>Copy.</p><img src="/p.jpg" alt="Floor Plan | two"><video src="/v.mp4"></video>', "<p>Just copy.</p>", f"<p>{'Real content. ' * 40}</p>"))
    rows = found.orderBy("page_id").select("text", "is_shell", P.assets_of(F.col("text")).alias("a")).collect()
    assert rows[0].text.endswith("--- ASSETS ---\nfloor_plan | https://venue.com/p.jpg | Floor Plan | two\nvideo | https://venue.com/v.mp4 | ")
    assert [tuple(x) for x in rows[0].a] == [("floor_plan", "https://venue.com/p.jpg", "Floor Plan | two"), ("video", "https://venue.com/v.mp4", "")]
    assert rows[1].a == [] and "ASSETS" not in rows[1].text and [r.is_shell for r in rows] == [True, True, False]
    odd = spark.createDataFrame([("x\n\n--- ASSETS ---\nbogus | https://v.com/x | S\nvideo | https://v.com/v.mp4 |\nvideo\n",)], "t string")
    assert [tuple(x) for x in odd.select(P.assets_of(F.col("t"))).first()[0]] == [("video", "https://v.com/v.mp4", "")]


def sequential(spark, sites, captures, max_pages, max_pdfs, max_depth):
    """One queue per site, one page after the other."""
    rows = sorted(captures.select("*", R.page_key(F.col("url")).alias("key")).collect(), key=lambda r: (r["url"], r["n_chars"]), reverse=True)
    have = {r["key"]: r for r in rows}
    every = captures.select(F.explode("links").alias("x")).select(F.col("x.href").alias("u"), F.col("x.from_nav").alias("n"), F.col("x.text").alias("t")).distinct()
    scores = {}
    for parent in (0.0, 9.0):
        rows = every.select("u", "n", "t", url_score(F.col("u"), from_nav=F.col("n"), anchor=F.col("t"), parent_score=F.lit(parent)).alias("s"), R.page_key(F.col("u")).alias("k"), R.host("u").alias("h"), F.col("u").rlike(P.PDF).alias("p")).collect()
        scores[parent] = {(r.u, r.n, r.t): r for r in rows}
    out = []
    for s in R.start_queue(sites).collect():
        queue, seen, pages, pdfs, at = [(-s.score, 0, 0, 0, s.url, s.key, s.is_pdf)], set(), 0, 0, 0
        while queue:
            queue.sort()
            score, depth, _, _, url, key, is_pdf = queue.pop(0)
            if key in seen or (pdfs >= max_pdfs if is_pdf else pages >= max_pages):
                continue
            seen.add(key)
            c = have.get(key)
            outcome = "error" if c is None or c["status"] != 200 else "js_shell" if not is_pdf and c["n_chars"] < 400 else "fetched"
            out.append((s.site, url, depth, outcome))
            if outcome == "error":
                pdfs += is_pdf
                continue
            pages, pdfs, at = pages + (not is_pdf), pdfs + is_pdf, at + 1
            for x in c["links"] if outcome == "fetched" else []:
                r = scores[9.0 if -score >= 5 else 0.0][(x.href, x.from_nav, x.text)]
                if r.s is None or r.h != s.site or depth + 1 > max_depth or (r.s < 0 and depth + 1 > 1):
                    continue
                queue.append((-float(r.s), depth + 1, at, x.place, x.href, r.k, r.p))
    return sorted(out)


@pytest.mark.parametrize(("folder", "max_pages"), [("sf0.001", 3)])
def test_crawl_is_one_queue_per_site(spark, folder, max_pages):
    sites, captures = crawl_input(spark, f"/root/testdata/{folder}")
    found = R.crawled(sites, captures, max_pages=max_pages, max_pdfs=2, max_depth=2)
    assert sorted((r.site, r.url, r.depth, r.outcome) for r in found.collect()) == sequential(spark, sites, captures, max_pages, 2, 2)


LINK = "array<struct<place:int,href:string,text:string,from_nav:boolean>>"
CAPTURE = f"url string, status int, bytes int, n_chars int, links {LINK}"


def web(spark):
    home, good = "https://www.v.com/", (200, 1000, 1000)
    rows = [
        (home, *good, [(0, "https://v.com/faq", "F", False), (1, "/bad", None, False), (2, None, "n", False), (3, "https://v.com/rooms/", "R", True), (4, "https://other.com/x", "O", False), (5, "https://cdn.com/menu.pdf", "Menu", False), (6, "https://cdn.com/annual.pdf", "A", False), (7, "http://v.com/faq/", "again", False)]),
        ("https://v.com/faq", *good, [(0, "https://v.com/weddings", "W", True), (1, "https://v.com/rooms/deep", "D", False), (2, home, "home", True)]),
        ("https://v.com/weddings", 200, 10, 10, [(0, "https://v.com/hidden", "H", False)]),
        ("https://cdn.com/menu.pdf", *good, []),
        ("https://v.com/rooms", 200, 3 * 1024 * 1024, 900, []),
        ("https://b.com/", *good, [(0, "https://b.com/a", "a", True), (1, "https://b.com/about", "b", False)]),
        ("https://b.com/a", 429, 0, 0, []),
    ]
    sites = spark.createDataFrame([(home, None), ("https://b.com", "http://b.com/"), (None, None)], "homepage string, event_url string")
    return sites, spark.createDataFrame(rows, CAPTURE)


def test_crawl_rules_robots_and_resume(spark, tmp_path):
    sites, captures = web(spark)
    told = lambda df: sorted((r.site, r.url, r.outcome) for r in df.collect())
    whole = told(R.crawled(sites, captures, folder=str(tmp_path / "one")))
    assert whole == sorted([
        ("v.com", "https://www.v.com/", "fetched"), ("v.com", "https://v.com/faq", "fetched"), ("v.com", "https://v.com/weddings", "js_shell"), ("v.com", "https://cdn.com/menu.pdf", "fetched"), ("v.com", "https://v.com/rooms/", "error"),
        ("b.com", "https://b.com", "fetched"), ("b.com", "https://b.com/a", "blocked"),
    ])
    R.crawled(sites, captures, folder=str(tmp_path / "two"), max_rounds=1)
    (tmp_path / "two" / "queue-00001" / "_SUCCESS").unlink()  # a round that was cut off is done again
    R.crawled(sites, captures, folder=str(tmp_path / "two"), max_rounds=2)
    assert told(R.crawled(sites, captures, folder=str(tmp_path / "two"))) == whole
    robots = spark.createDataFrame([("v.com", "/faq", False), ("www.v.com", "/faq", False)], "host string, pattern string, allow boolean")
    banned = {(u, o) for _, u, o in told(R.crawled(sites, captures, robots=robots))}
    assert ("https://v.com/faq", "robots") in banned and "https://v.com/weddings" not in {u for u, _ in banned}
    seeds = spark.createDataFrame([("https://b.com", "https://else.com/about")], "homepage string, url string")
    assert ("b.com", "https://else.com/about", "error") in told(R.crawled(sites, captures, seeds=seeds))
    assert R.crawled(sites.limit(0), captures).count() == 0


def chosen(spark, link_rows=(), pages=(), home="https://v.com/"):
    sites = spark.createDataFrame([(home,)], "homepage string")
    links_df = spark.createDataFrame([(home, i, *x) for i, x in enumerate(link_rows)], "homepage string, place int, href string, text string, from_nav boolean")
    captures = spark.createDataFrame([(home, *x) for x in pages], "homepage string, url string, depth int, text string")
    r = R.event_pages(sites, links_df, captures).first()
    return r and (r.url, r.source, r.is_secondary)


def test_event_pages(spark):
    v = "https://v.com"
    assert chosen(spark) is None
    assert chosen(spark, [(f"{v}/private-events", "Private", True), (f"{v}/weddings", "W", False)]) == (f"{v}/weddings", "homepage_link", False)
    assert chosen(spark, [(f"{v}/celebrate", "C", True), (f"{v}/private-events", "Private", True)]) == (f"{v}/celebrate", "homepage_link", False)
    assert chosen(spark, [(f"{v}/gallery/wedding", "G", True), (f"{v}/portfolio/wedding-venue", "P", False)]) == (f"{v}/portfolio/wedding-venue", "homepage_link", False)
    assert chosen(spark, [(f"{v}/venue-rentals/inquiry-form", "Form", True)]) == (f"{v}/venue-rentals/inquiry-form", "homepage_link", True)
    assert chosen(spark, [("https://other.com/weddings", "W", True), (f"{v}/x/host-an-event.jpg", "J", True), (f"{v}/blog/wedding-trends", "Trends", False)]) is None
    assert chosen(spark, [(f"{v}/celebrate-with-us", "Weddings", False), (f"{v}/a/weddings", "b", False)]) == (f"{v}/a/weddings", "homepage_link", False)
    long = "a wedding here " * 40
    assert chosen(spark, [(f"{v}/weddings", "W", True)], [(f"{v}/", 0, ""), (f"{v}/events/weddings", 1, ""), (f"{v}/our-weddings", 1, "")]) == (f"{v}/our-weddings", "captured", False)
    assert chosen(spark, [], [(f"{v}/hotels/here/", 0, ""), (f"{v}/hotels/a/weddings", 1, "")], f"{v}/hotels/here/") == (f"{v}/hotels/a/weddings", "captured", False)
    assert chosen(spark, [], [(f"{v}/hotels/here/home", 0, ""), (f"{v}/hotels/a/weddings", 1, ""), (f"{v}/hotels/here/the/weddings", 2, "")]) == (f"{v}/hotels/here/the/weddings", "captured", False)
    assert chosen(spark, [], [(f"{v}/x/y", 0, ""), (f"{v}/weddings/", 1, long), (f"{v}/wedding", 1, "short wedding")]) == (f"{v}/weddings/", "common_path", False)
