"""Extraction of main text: whole tables against a plain reader of their articles, and hand-made pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from netloom.llm import html_text
from netloom.llm.html_text import Page, extract_text
from netloom.llm.queries import op12_consensus_extraction


class Article(HTMLParser):
    """Blocks of h1 and p inside article, as the tables' pages have them."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] if tag in ("p", "h1") else []

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] if tag in ("p", "h1") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    reader = Article()
    reader.feed(html)
    reader.close()
    return "\n\n".join(filter(None, (" ".join(b.split()) for b in reader.blocks)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    rows = op12_consensus_extraction(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


WORDS = "It was a long day, and the river ran as it always had, past the mill and the old stones. "

PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p > b {{}}</style><script>if (a < b) document.write("<article><p>no</article>")</script></head>
<body class="comments-open has-sidebar"><header id="top"><h2>Site</h2></header><nav><ul><li><a href="/a>b">A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="page with-sidebar"><div class="breadcrumbs"><a href=x>Home</a></div>
<article class="post post-123" data-x='a > b'><header><h1>Head &eacute;&#8217;s
 line</h1></header><p>One <b>bold</b> and <i>word<br>next&nbsp;line &lt;tag&gt; &amp;amp; A&B &copy 5 &#x41;<p>Two <!-- <p>hidden --> still<div class="ad">Buy!</div><ul><li>i<li>ii</ul>
<table><tr><td>c1<td>c2<tr><td>c3</table><blockquote><p>Said.</blockquote><form><p>Name <input></p><button>Go</button></form><pre>  a
   b</pre>tail {WORDS}<script>var s = "</p>";</script> end<aside>More</aside><footer>By me</footer></article>
<section id="comments"><h3>3 comments</h3><article class="comment"><p>{WORDS * 9}</p></article></section><div id="sidebar"><p>{WORDS}</div></div>
<footer>&copy; 2020</footer></body></html>"""
TEXT = ["Head é’s line", "One bold and word next line <tag> &amp; A&B © 5 A", "Two still", "i", "ii", "c1", "c2", "c3", "Said.", "a b", f"tail {WORDS}end"]


def test_a_page_with_everything(spark):
    rows = [(i, f"http://a.org/{i}", PAGE) for i in range(3)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars", "container"]
    for r in out.collect():
        assert r["text"].split("\n\n") == TEXT
        assert r["container"] == "body>div.page.with-sidebar>article.post.post-#"


def pages_of(host, bodies):
    return [(f"http://{host}/{i}", b) for i, b in enumerate(bodies)]


def test_a_host_outvotes_a_page(spark):
    page = lambda n, m: f"<body><div class=col><p>{WORDS * n}</p></div><div class=talk><p>{'Nice one, thanks. ' * m}</p></div>"
    rows = pages_of("x.org", [page(6, 1)] * 12 + [page(1, 40)])
    rows += pages_of("y.org", [page(1, 40)])
    out = {(r["url"]): r for r in extract_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert all(r["container"] == "body>div.col" for u, r in out.items() if "x.org" in u)
    assert out["http://x.org/12"]["text"] == WORDS.strip()
    assert out["http://y.org/0"]["container"] == "body>div.talk"


def test_pages_without_the_winning_path_take_their_own(spark):
    rows = pages_of("x.org", [f"<article><p>{WORDS}</article>"] * 20 + [f"<div class=other><p>{WORDS}</div>", "<article> </article><footer>f</footer>", "plain words only"])
    got = [r["text"] for r in extract_text(spark.createDataFrame(rows, "url string, html string").coalesce(1)).collect()]
    assert got == [WORDS.strip()] * 21 + ["", "plain words only"]


def test_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    rows = [(i, f"http://{'hot' if i % 3 else i}.org/", f"<div class=m>{i} {WORDS}</div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), carry=["page_id"]).collect()}
    assert got == {i: f"{i} {WORDS}".strip() for i in range(60)}


def test_nulls_repeats_and_names(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (None, "http://a.org", "", "b"), (2, "no host", "<p>x<p>y", None), (3, "http://a.org", "<p>z", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract_text(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "", 0), (2, "x\n\ny", 4), (3, "z", 1)], key=str)
    assert extract_text(df.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("html, text", [
    ("a < b and c > d", "a < b and c > d"), ("<p>x</p", "x"), ("<p>x<a href='", "x"), ("<p title=\"a>b\">x", "x"), ("<p don't>x", "x"), ("x<!-- y", "x"), ("x<!-->y", "xy"), ("x<!DOCTYPE y>z", "xz"),
    ("<script>x", ""), ("<SCRIPT>x</script >y", "y"), ("<scripts>y", "y"), ("&am x&amp y&amp;", "&am x& y&"), ("<b>x</b>y", "xy"), ("x<br/>y", "x y"), ("x<hr>y", "x\n\ny"), ("</div>x</p>y", "x\n\ny"), ("<li>a<ul><li>b</ul><li>c", "a\n\nb\n\nc"),
    ("<table><tr><td><p>a<td>b</table>c", "a\n\nb\n\nc"), ("<div hidden>x</div>", "x"), ("\U0001f600<p>&#128512;", "\U0001f600\n\n\U0001f600"), ("<p><a href=x>only links</a>", "only links"),
])
def test_fragments(html, text):
    page = Page(html)
    assert page.main_text([])[0] == text


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "x", "<p>x" * 50_000, "<" * 300_000, "<a b='" * 50_000, "<!--" * 50_000, "</div>" * 50_000 + "x", "<script>" * 50_000, "<div " * 50_000, "&" * 200_000, "<li>x" * 20_000])
def test_odd_pages_end_soon(html):
    Page(html).main_text([])


def test_a_long_text_is_kept_whole():
    text = "\n".join(f"<p>{i} {WORDS * 30}" for i in range(800))
    assert Page(f"<article>{text}</article>").main_text([])[0] == "\n\n".join(f"{i} {WORDS * 30}".strip() for i in range(800))
