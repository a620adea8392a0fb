import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from feedlake.llm import html_text as H
from feedlake.llm.registry import op10_html_text

ARTICLE = "<h1>Title &amp; more</h1><p>First  para\n with <b>bold <i>text</i><br>and a break<p>Second &lt;para&gt; &eacute;&nbsp;x</p><ul><li>one<li>two</ul>"
TEXT = "Title & more\nFirst para with bold text and a break\nSecond <para> é x\none\ntwo"
AROUND = (
    '<nav><a href="/">Home</a></nav><header>Site name</header><div id="cookie-notice">We use cookies</div><div class="ad-box">Buy</div>{}'
    '<form><input name="q">Search</form><div class="comments"><p>A reader says much, and more, and even more than that</p></div><aside>Side</aside><footer>&copy; us</footer>'
)


def page(body, head="<title>T</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="content c12">{}</div>', '<main><div id="x">{}</div></main>', '<body class="has-sidebar"><section>{}</section>', "<table><tr><td>{}</td></tr></table>"])
def test_the_article_and_nothing_around_it(wrap):
    assert H.main_text(page(AROUND.format(wrap.format(ARTICLE))), None) == TEXT


@pytest.mark.parametrize("source,text", [
    ("", ""), ("plain words", "plain words"), ("a < b & c", "a < b & c"), ("<p>x<!-- <p>no --> y</p>", "x y"), ("<p>open <b>tags", "open tags"), ("</div></p><p>x</p></b>", "x"),
    ("<script>no", ""), ("<p>a</p><!-- never closed <p>b", "a"), ("<div hidden>no</div><p>yes</p>", "yes"), ("<P CLASS=x>Up</P>", "Up"), ("<p title='a>b'>q</p>", "q"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<nav>only a menu</nav>", ""), ("<p>&#x41;&#66;&unknown;</p>", "AB&unknown;"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
])
def test_odd_sources(source, text):
    assert H.main_text(source, None) == text


def test_hosts_agree_on_a_path(spark):
    long, short = "word " * 60, "few words"
    tall = lambda a, b: page(f'<div class="story v1"><p>{a}</p></div><div class="extra"><p>{b}</p></div>')
    rows = [(i, f"http://h.example/{i}", tall(long, short), "x") for i in range(5)]
    rows += [(5, "http://h.example:80/5?q", tall(short, long), "x"), (6, "no host", tall(short, long), "x"), (7, None, None, "x"), (None, "http://u@H.Example/x", page("<p>other form</p>"), None), (8, "http://h.example/8", "", None), (8, "http://h.example/8", "", None)]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[5] == short and by[6] == long.strip() and by[7] == "" and by[None] == "other form" and by[8] == ""
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_query_against_the_form_of_the_pages(spark):
    """Every page of the table has one article; a plain reading of it must agree."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op10_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "word " * 200


@pytest.mark.parametrize("body,text", [
    (f'<article><h1>A title</h1><p>An intro.</p><div class="content"><p>{LONG}</p></div></article>', f"A title\nAn intro.\n{LONG.strip()}"),
    (f"<article><section><div><p>one {LONG}</p></div></section><section><div><p>two</p></div></section><section><div><p>three</p></div></section></article>", f"one {LONG.strip()}\ntwo\nthree"),
    (f'<div id="wrap"><div class="lead"><p>Lead</p></div><div class="body"><p>{LONG}</p></div></div><div class="extra"><p>other</p></div>', f"Lead\n{LONG.strip()}"),
    (f'<div><div class="links"><a href="/">many links here</a> x</div><div class="body"><p>{LONG}</p></div></div>', LONG.strip()),
    (f'<div class="part p1"><p>{LONG}</p></div><div class="extra">no</div><div class="part p2"><p>second</p></div><div class="part p3"><a href="/">all of it a link</a> x</div>', f"{LONG.strip()}\nsecond"),
])
def test_main_text_outside_the_largest_container(spark, body, text):
    assert H.main_text(page(AROUND.format(body)), None) == text
    rows = [(i, f"http://h.example/{i}", page(AROUND.format(body))) for i in range(2)]
    assert [r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()] == [text] * 2


@pytest.mark.parametrize("wrap", [
    '<div class="layout sidebar-right">{}</div>', '<div class="page-header-fixed">{}</div>', '<div class="post tags-page">{}</div>', '<div class="search-result-article">{}</div>',
    "<form>{}</form>", '<form action="/x"><div class="story">{}</div></form>', '<div class="comments-open"><article>{}</article></div>', '<div id="sidebar"><main>{}</main></div>',
    '<div class="layout sidebar-right"><form><div class="post tags">{}</div></form></div>',
])
def test_a_wrapper_with_a_suspect_name_stays(wrap):
    assert H.main_text(page(AROUND.format(wrap.format(f"<h1>A title</h1><p>{LONG}</p>"))), None) == f"A title\n{LONG.strip()}"
    assert H.main_text(page(wrap.format(AROUND.format(f"<h1>A title</h1><p>{LONG}</p>"))), None) == f"A title\n{LONG.strip()}"


@pytest.mark.parametrize("extra", [
    '<div class="comments">{}</div>', '<section id="comment-list">{}</section>', '<nav>{}</nav>', '<div class="sidebar"><article>teaser</article>{}</div>', "<aside>{}</aside>", '<div class="related-posts"><article>teaser</article></div>',
    '<form>{}</form>', '<footer>{}</footer>',
])
def test_long_parts_beside_a_short_article_go(extra):
    body = f"<article><p>{'short text ' * 12}</p></article>" + extra.format("<p>not the article at all, yet longer than it is</p>" * 9)
    if extra.startswith("<form"):
        body = body.replace("short text " * 12, "short text " * 20)
    assert H.main_text(page(body), None) == ("short text " * (20 if extra.startswith("<form") else 12)).strip()


def test_titles_links_and_formulas_stay():
    header = '<header class="entry-header"><h1>A title</h1><p>By the staff</p></header>'
    assert H.main_text(page(f"<article>{header}<p>{LONG}</p></article>"), None) == f"A title\n{LONG.strip()}"
    assert H.main_text(page(f'<div class="post"><div class="entry-header"><h2>A title</h2></div><p>{LONG}</p></div>'), None) == f"A title\n{LONG.strip()}"
    assert H.main_text(page(f"<header><h1>The site</h1></header><article><p>{LONG}</p></article>"), None) == LONG.strip()
    assert H.main_text(page("<nav><a>menu</a></nav><article><p><a href='/1'>one link</a></p><p><a>two</a></p></article>"), None) == "one link\ntwo"
    assert H.main_text(page("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>"), None) == "so x=2 holds"


@pytest.mark.parametrize("unit", [
    "<a ", '"<a "', "<a '", "<", "<!", "<!--", "<a b=\"'", "</a ", "<script", "<script>", "<b>", "</b>", "<p><b>", "<li>", "<div>", "<dd></dd><div>", "<td><b>", "<a><b>x", "<i>x</p>", '<a b=">', "&amp;&", "<p title='>'x\">",
    "<ul><li>a", "<dl><dt>a<dd>", "<form><nav>a",
])
def test_long_pages_take_time_by_their_length(unit):
    start = time.process_time()
    H.main_text(unit * (2_000_000 // len(unit)), None)
    assert time.process_time() - start < 40
    if unit in ("<a ", '"<a "'):
        assert time.process_time() - start < 5


class Reader(HTMLParser):
    """A second reader: text by the chain of open elements, for pages whose tags are balanced."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], {}
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag not in H.VOID:
            self.n += 1
            self.open.append((tag, dict(attrs).get("class", ""), self.n))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for at, (tag, _, n) in enumerate(self.open):
            if tag in ("p", "h1", "li"):
                self.blocks.setdefault((tuple(x[:2] for x in self.open[: at + 1]), n), []).append(data)


def test_pages_without_a_bare_article_against_a_second_reader():
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choice(("alpha", "beta &amp; b", "gamma", "<b>delta</b>", "eps&eacute;")) for _ in range(k))
    shells = ['<div class="layout sidebar-left"><div id="story-{}">{}</div></div>', '<div class="c{}"><div class="main-content">{}</div></div>', '<form><div class="x{}">{}</div></form>', '<main class="m{}"><section>{}</section></main>']
    around = ['<nav class="top"><ul><li>menu</li></ul></nav>', '<div class="ad-slot"><p>buy now</p></div>', '<div class="comments"><p>a reader wrote this</p></div>', '<aside><p>aside</p></aside>', '<footer><p>legal</p></footer>']
    for case in range(200):
        kept = [f"<p>{say(rng.randrange(20, 60))}</p>" if rng.random() < 0.8 else f"<ul><li>{say(9)}</li><li>{say(3)}</li></ul>" for _ in range(rng.randrange(2, 6))]
        body = rng.choice(shells).format(case, f"<h1>{say(4)}</h1>" + "".join(kept))
        source = page("".join(rng.sample(around, rng.randrange(4))) + body + "".join(rng.sample(around, rng.randrange(4))))
        reader = Reader()
        reader.feed(source)
        skip = ("top", "ad-slot", "comments")
        want = [" ".join("".join(parts).split()) for (chain, _), parts in reader.blocks.items() if not any(t in ("nav", "aside", "footer") or c in skip for t, c in chain)]
        assert H.main_text(source, None) == "\n".join(want), source
