import random
from html.parser import HTMLParser
from itertools import product

from lorebank.llm import html_text


def cost(labels, scores, edges):
    return sum(max(0, -s) if x else max(0, s) for x, s in zip(labels, scores, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_min_cut_equals_exhaustive_search():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -1, -0.4, 0, 0.3, 1, 2]) + rng.random() / 7 for _ in range(n)]
        edges = [(i - 1, i, rng.choice([0.02, 0.4, 1, 2])) for i in range(1, n)] + [(a, b, rng.random()) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(4)) if a < b]
        best = min(cost(x, scores, edges) for x in product([False, True], repeat=n))
        assert abs(cost(html_text.min_cut(scores, edges), scores, edges) - best) < 1e-6


class Article(HTMLParser):
    """The blocks inside the article element, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.now = [], False, ""

    def _end(self):
        text = " ".join(self.now.split())
        self.blocks += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "article"):
            self._end()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self._end()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_generated_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages).collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        assert r.text == "\n".join(parser.blocks)


PAGE = """<!doctype html><html><head><title>T &amp; U</title><script>var x = "<p>no</p>";</script><style>p{}</style></head>
<body class="article-page"><header class="site-header"><a href="/">Home</a><h2>Site name</h2></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site work. Please accept them all, they are very good for you.</div>
<main><div class=breadcrumbs><a>Home</a> &gt; <a>News</a></div>
<article><header><h1>The  big&nbsp;story</h1><p class="byline">By A. Writer</p></header>
<p>First paragraph with <b>bold</b>, <a href=x>a link</a> and a reference&mdash;done.
<p>Second&lt;tag&gt; paragraph<br>after a break.</p>
<ul><li>Point one<li>Point two</ul>
<div class="ad-slot"><p>Buy this wonderful thing now. It is the best thing that you can buy, and it is cheap.</p></div>
<p>Short.</p>
<form><label>Name</label><input name=n><button>Send</button></form>
<blockquote>Quoted words.</blockquote>
</article>
<section id="comments"><h3>2 comments</h3><p>I liked this long article a lot, and I want to tell everybody about it right here.</p></section></main>
<aside class="sidebar"><p>More stories that you may like to read when you have the time.</p></aside>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_a_page_with_every_kind_of_boilerplate():
    assert html_text.main_text(PAGE).split("\n") == ["The big story", "First paragraph with bold, a link and a reference—done.", "Second<tag> paragraph after a break.", "Point one", "Point two", "Short.", "Quoted words."]


def test_layout_names_do_not_hide_the_article():
    page = "<body class='home'><div class='page has-sidebar'><article class='post comments-open'><p>The text of the article.</p></article><div class='sidebar'><p>Other things to read.</p></div></div></body>"
    assert html_text.main_text(page) == "The text of the article."


def test_pages_without_an_article_and_broken_pages():
    plain = "<html><body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>Some real text of the page, with several words in it.</p><p>And more of it.</p></div></body></html>"
    assert html_text.main_text(plain) == "Some real text of the page, with several words in it.\nAnd more of it."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><p>Cut &am") == "Cut &am"
    assert html_text.main_text("<article><p>Cut off</p><p cla") == "Cut off"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep text") == "deep text"
    assert len(html_text.main_text("<article>" + "<p>word.</p>" * 20_000)) == 20_000 * 6 - 1
    assert html_text.main_text("<div>" * 30_000 + "</p></span>" * 30_000 + "<article>text</article>") == "text"


def test_rows_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "<article>a</article>", "y"), (None, "", "z")], "page_id long, html string, text2 string")
    assert sorted((r.text, r.text2) for r in html_text.extract(pages).collect()) == [("", "x"), ("", "z"), ("a", "y")]
    assert html_text.extract(pages.limit(0)).count() == 0
