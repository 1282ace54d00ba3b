import html as entities
import re
from collections import defaultdict

import duckdb

from tallyloom.llm import templates


def text_of(page):
    return " ".join(t for t, _ in templates.read_page(page)[0])


def test_page_marks():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>";</script></head><body class="has-sidebar">'
            '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div><!-- x -->'
            '<article><header><h1>Ti&amp;tle</h1><p>By Joe</p></header><p>One <b>bold</b>er<br>line\n two<p>Next&nbsp;&copy; &am'
            '<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input value=1>Send</form><section id="comments"><article class="comment">'
            '<p>Nice</article></section><p hidden>secret</p><blockquote>quo<i>te</i></blockquote><pre>x\n  y</pre><table><tr><td>1<td>2</table>'
            '</article><aside>More</aside><footer>End</footer></body></html>')
    assert text_of(page) == "Ti&tle One bolder line two Next © &am a b quote x y 1 2"
    assert text_of("<div role=navigation>Menu</div><main><p>In main</p></main><p>Out") == "In main"
    assert text_of("<p>no article<p>here") == "no article here"
    assert text_of("plain") == "plain" and text_of("<p>cut off <a hre") == "cut off" and text_of("") == "" and text_of("1 < 2 <p>x") == "1 < 2 x"
    assert text_of("<article><p>a</article><article><p>b</article>") == "a b"
    assert text_of("<script>x" * 3) == "" and text_of("</p></div>x") == "x"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text_of(deep) == "deep"


def brute(pages, limits):
    """Counts in plain Python; equal pages of a host count once."""
    read = {p: templates.read_page(h) for p, _, h in pages}
    host = {p: (u or "").split("://")[-1].split("/")[0] if "://" in (u or "") else "" for p, u, _ in pages}
    seen, different = defaultdict(set), defaultdict(set)
    for p, _, h in pages:
        different[host[p]].add(h or "")
        for x in read[p][1]:
            seen[host[p], x].add(h or "")
    often = {k for k, v in seen.items() if len(v) >= limits.pages and len(v) >= limits.share * len(different[k[0]])}
    return {p: " ".join(t for t, w in read[p][0] if not any((host[p], x) in often for x in w)) for p, _, _ in pages}


def test_site_templates_go(spark):
    box = "<div><p>Follow our letters</p><p>every week</p></div>"
    rows = [(k, "http://a.org/%d" % k, f"<div>{box}<div><p>Story {k} is new</p><p>same line</p></div></div>") for k in range(12)]
    rows += [(20 + k, "http://b.org/x", f"{box}<p>other {k}") for k in range(3)]
    rows += [(30 + k, "http://c.org/x", "<p>copied page</p><div>all of it</div>") for k in range(9)]
    rows += [(40 + k, "http://d.org/x", f"<article><p>common paragraph</p><div>Sign up</div><p>text {k}</p></article>") for k in range(9)]
    rows += [(50, None, None), (51, None, ""), (52, "nohost", "<p>x"), (53, "http://a.org/long", "<p>" + "word " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS page", "'h' AS host", "2 AS template")
    limits = templates.SiteLimits()
    got = {r.page_id: r for r in templates.extract(pages, limits).collect()}
    assert {p: r.text for p, r in got.items()} == brute(rows, limits)
    assert got[3].text == "Story 3 is new" and got[21].text == "Follow our letters every week other 1"
    assert got[30].text == "copied page all of it" and got[44].text == "common paragraph text 4"
    assert got[50].text == "" and got[53].n_chars == 5 * 60_000 - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert templates.extract(pages.limit(0)).count() == 0


def test_given_pages(spark, data):
    """The given pages mark their article; its text comes out whole."""
    rows = duckdb.sql(f"SELECT page_id, html FROM '{data}/pages.parquet'").fetchall()
    want = {}
    for p, page in rows:
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [entities.unescape(re.sub("<[^>]+>", "", re.sub("<br>", " ", x))) for x in re.split("</?(?:p|h1)>", body)]
        want[p] = " ".join(" ".join(" ".join(parts).split()).split())
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert {r.page_id: r.text for r in templates.extract(pages).collect()} == want
