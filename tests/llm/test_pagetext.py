import random
from collections import defaultdict
from html import escape
from html.parser import HTMLParser

import pytest

from tests.llm.cases import sentence
from tidebar.llm import pagetext
from tidebar.llm.catalog import llm_queries

PAGES = "page_id long, url string, html string"


class Article(HTMLParser):
    """The plain reading of a well-formed page: what stands in <article>, a line for each block."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.held = 0, [], ""
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if self.held.split():
            self.lines.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "br", "span", "a"):
            self.flush()
        self.depth += tag == "article"
        if tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "span", "a"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held += data


def page(article, nav="Home,News,About", ad="Buy now", extra="", footer="All rights reserved"):
    items = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in nav.split(","))
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>t &amp; t</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        f'<body class="has-sidebar"><nav><ul>{items}</ul></nav><!-- ad <p>x</p> --><div class="ad">{ad}</div>{article}{extra}'
        f"<footer>&copy; {footer}</footer></body></html>"
    )


def texts(spark, rows, **kw):
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    return {r.page_id: r.text for r in pagetext.extract(df, **kw).collect()}


def one(html):
    p = pagetext.Page(html)
    out, scope, _ = p.article()
    return p.text(out, scope)


def test_query_on_given_pages(spark):
    out = llm_queries()["op12_page_text"](spark, "/root/testdata/sf0.01")
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    given = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = out.collect()
    assert len(found) == len(given)
    for r in found:
        assert r.url == given[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == "\n".join(Article(given[r.page_id].html).lines)


@pytest.mark.parametrize("html,want", [
    (page("<article><h1>T</h1><p>a  b\n c &lt;i&gt; &eacute;&nbsp;x<p><b>d</b>e<br>f</article>"), "T\na b c <i> é x\nde f"),
    (page("<article><p><b>open<br><p>next</article>"), "open\nnext"),
    (page("<article><header><h1>T</h1></header><p>x</p><aside>side</aside><form>mail <input></form><ul><li>1<li>2</ul></article>"), "T\nx\n1\n2"),
    (page("<article><p>x</p></article>", extra='<section id="comments"><article class="comment"><p>nice</p></article></section>'), "x"),
    (page('<div class="content-with-ads"><form><article><p>x</p></article></form></div>'), "x"),
    (page("<main><h1>T</h1><p>x</p><div class='cookie-notice'>We use</div></main>"), "T\nx"),
    (page("<div id=content><p>x y</p><div>z and a lot more than anything else here</div></div>"), "x y\nz and a lot more than anything else here"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>k<dd>v</dl></article>", "a\nb\nc\nk\nv"),
    ("<article>a <span class='ad'>no</span> b <span hidden>no</span> <i>c</div> d</article>", "a b c d"),
    ("<article><p>1 < 2 <3 & <a title='x>y' href=\"q>\">z</a></p><p>open", "1 < 2 <3 & z\nopen"),
    ("plain text only", "plain text only"), ("", ""), ("<p>a<script>x<p>b", "a"), ("<p>a<!-- b <p>c", "a"), ("<ARTICLE><P>A</ARTICLE>", "A"),
    ("<article><p>a</p><SCRIPT>if (a</b) {}</Script ><p>b</p><style></styl></style >c", "a\nb\nc"),
])
def test_pages_that_stand_alone(html, want):
    assert one(html) == want


def plain_templates(rows, least, share):
    """Subtrees by loops: host -> those on enough pages of different content."""
    content, on = defaultdict(set), defaultdict(set)
    for _, url, html in rows:
        host = url.split("/")[2] if url else ""
        if not host:
            continue
        p = pagetext.Page(html or "")
        out, scope, marked = p.article()
        text = p.text(out, scope)
        content[host].add(text)
        for h in set(p.candidates(scope, marked).values()):
            on[host, h].add(text)
    return {k: len(v) for k, v in on.items() if len(v) >= least and len(v) >= share * len(content[k[0]])}


def site_rows():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = sentence(rng, 60)
        body = f"<h1>Story {i}</h1><div class=lead>{words}</div><p>{sentence(rng, 30)}</p>"
        promo = "<div><b>Join</b> our club today</div>" if i % 2 else ""
        rows.append((i, f"https://a.example/{i}", f"<body><div><a>Start</a> <a>Contact</a></div>{body}{promo}<p>Printed by A Press</p></body>"))
        rows.append((100 + i, f"http://b.example:80/{i}?x#y", page(f"<article>{body}<p>same line in all</p><div>Read more of us</div></article>")))
    copy = page(f"<article><h1>Copy</h1><p>{sentence(rng, 80)}</p></article>")
    rows += [(200 + i, f"https://b.example/copy{i}", copy) for i in range(200)]
    rows += [(500 + i, "https://c.example/", f"<body><div>Rare menu</div><p>{sentence(rng, 9)}</p></body>") for i in range(3)]
    rows += [(600, None, "<p>no host</p>"), (601, "https://a.example/n", None), (602, "about:blank", ""), (603, "HTTPS://A.example/u", rows[0][2]), (0, *rows[0][1:])]
    return rows


def test_templates_against_loops(spark):
    rows = site_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    candidates = pagetext.subtree_rows(pagetext._with_host(df, "url", "html")).cache()
    found = pagetext.templates(candidates, 4, 0.3).collect()
    names = {r.h: r.host for r in df.selectExpr("url").select(pagetext.host_of(df.url).alias("host")).selectExpr("host", "xxhash64(host) h").distinct().collect()}
    lower = [(i, u.lower().replace(":80", "") if u else u, h) for i, u, h in rows]
    lower = [(i, u if u and u.startswith("http") else None, h) for i, u, h in lower]
    assert {(names[r.h], r.sub): r.n for r in found} == plain_templates(lower, 4, 0.3)
    found = spark.createDataFrame(found)
    lists = [{(r.d0, r.d1): set(r.subs) for r in pagetext.to_delete(candidates, found, salt).collect()} for salt in (200_000, 7)]
    assert lists[0] and lists[0] == lists[1]


def test_templates_go_and_articles_stay(spark):
    rows = site_rows()
    out = texts(spark, rows)
    assert len(out) == len({r[0] for r in rows})
    for i in range(60):
        assert out[i].startswith(f"Story {i}\n")
        for gone in ("Start", "Join", "Printed"):
            assert gone not in out[i]
        assert "same line in all" in out[100 + i] and "Read more" not in out[100 + i] and "Home" not in out[100 + i]
    assert len({out[200 + i] for i in range(200)}) == 1 and out[200].startswith("Copy\n") and len(out[200]) > 200
    assert all("Rare menu" in out[500 + i] for i in range(3))
    assert out[600] == "no host" and out[601] == "" and out[602] == "" and out[603] == out[0]


def test_defined_cases(spark):
    long = page("<article>" + "".join(f"<p>{escape('a<b & ' + str(i))}</p>" for i in range(20_000)) + "</article>")
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    names = ["text", "row", "h", "subs", "d0"]
    schema = PAGES + "".join(f", {c} string" for c in names)
    rows = [(1, "https://a.b/", long), (None, None, None), (2, "https://a.b/", deep), (2, "https://a.b/", deep)]
    df = spark.createDataFrame([(*r, *["old"] * len(names)) for r in rows], schema)
    out = pagetext.extract(df)
    assert out.columns == ["page_id", "url", "html", "row", "h", "subs", "d0", "text", "n_chars"]
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == 4 and found[None].text == "" and found[2].text == "x" and found[2].row == "old"
    assert found[1].text == "\n".join(f"a<b & {i}" for i in range(20_000)) and found[1].n_chars == len(found[1].text)
    assert pagetext.extract(spark.createDataFrame([], schema)).collect() == []
