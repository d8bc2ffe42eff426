from lexgrain.llm import html_extract as h

PAGE = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><p>A tagline that is long enough to count, really.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div id="cookie-notice">We use cookies, please accept them all.</div>%s
<div class="sidebar"><p>Sidebar text that goes on and on, with commas, for a while.</p></div><section id="comments"><article><p>Great post, I liked it a lot, thanks.</p></article></section>
<form><label>Name</label><input></form><footer>&copy; us</footer><!-- no --></body></html>"""
ARTICLE = "<h1>Title</h1><p>First   paragraph, with <b>bold</b> and &lt;tags&gt; &eacute;&#8364;.<p>Short<ul><li>item one<li>item two</ul><p>Another long paragraph follows here, with commas, and more.</p>"
TEXT = "Title\nFirst paragraph, with bold and <tags> é€.\nShort\nitem one\nitem two\nAnother long paragraph follows here, with commas, and more."


def test_article_and_plain_containers():
    for box in ("<article>%s</article>", "<main>%s</main>", '<div role="main">%s</div>', "<div id=content>%s</div>"):
        assert h.extract(PAGE % (box % ARTICLE)) == TEXT, box


def test_notices_within_the_article_go():
    inner = ARTICLE.replace("<p>Another", '<aside>Read also this, please.</aside><div class="ad">Buy now, cheap!</div><div class="newsletter-signup">Sign up.</div><p>Another')
    assert h.extract(PAGE % f"<article>{inner}</article>") == TEXT


def test_layout_classes_and_outer_headers():
    page = f'<body><div class="site-header"><p>The site, its name, and its motto.</p></div><div class="content with-sidebar comments-open">{ARTICLE}</div><div class="rightRail"><p>More, and more.</p></div><div id="respondForm">Reply, now.</div></body>'
    assert h.extract(page) == TEXT
    assert h.extract('<article><div class="article-header"><h1>T</h1></div><p>Some text, here.</p></article>') == "T\nSome text, here."


def test_unnamed_link_lists_go():
    page = f'<body><div><a href="#">Home page</a> <a href="#">All the news</a></div><div><div>{ARTICLE}</div></div><div><ul><li><a href="#">Other story, one</a></li><li><a href="#">Other story, two</a></li></ul></div></body>'
    assert h.extract(page) == TEXT


def test_plain_containers_with_one_dominant_part():
    long, short = "A long text, with words and commas. " * 22, "A short text, with a comma. " * 7
    two = ["Title", long.strip(), short.strip()]
    for page in ("<div id=content><h1>%s</h1><p>%s</p><p>%s</p></div>", "<div id=content><h1>%s</h1><p class=lead>%s</p><p>%s</p></div>", "<div><h1>%s</h1><div class=lead>%s</div><div>%s</div></div>"):
        assert h.extract(PAGE % (page % tuple(two))).split("\n") == two, page
    parts = f"<div class=a>{f'<p>{short}</p>' * 9}</div>", f"<div class=b>{f'<p>{short}</p>' * 3}</div>"
    for page in ("".join(parts), "".join(parts[::-1])):
        assert h.extract(PAGE % f"<div>{page}</div>").split("\n") == [short.strip()] * 12


def test_edges():
    assert h.extract(None) == h.extract("") == h.extract("<p>") == h.extract("<nav>x</nav>") == ""
    assert h.extract("plain text, only.") == "plain text, only."
    assert h.extract("<article><p>a < b & c <b") == "a < b & c"
    assert h.extract("<article>" + "<div>" * 5000 + "deep, text." + "</article>") == "deep, text."
    assert len(h.extract("<article>" + "<p>long text, here.</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE % f"<article>{ARTICLE}</article>", "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, h.main_text(pages).collect()), key=repr)
    assert rows == [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (2, None, "", 0)]
    assert h.main_text(pages.limit(0)).count() == 0


def pages_and_articles():
    """The test pages and what stands in their article element."""
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " * (m[0] == "<br>"), b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        yield page, "\n".join(p for p in parts if p)


def test_test_pages_give_their_articles():
    assert all(h.extract(page) == want for page, want in pages_and_articles())


def test_test_pages_without_an_article_element():
    import re

    assert sum(h.extract(re.sub(r"(</?)(article|main)\b", r"\1div", page)) == want for page, want in pages_and_articles()) >= 248


def test_ratios_decide_where_tags_and_names_say_nothing():
    """All parts of a page as nameless div elements: the tag paths' ratios find the article, constant ones do not."""
    import re

    plain = [(re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"(</?)(article|main|nav|header|footer|aside)\b", r"\1div", page)), want) for page, want in pages_and_articles()]
    constant = lambda found: {b.path: 1.0 for b in found}
    assert sum(h.extract(page) == want for page, want in plain) >= 240
    assert sum(h.extract(page, constant) == want for page, want in plain) <= 25


def test_names_of_parts_do_not_drop_sections_of_the_article():
    long = "This part of the article says something, at length, and with commas; it is no comment. " * 3
    inner = f'<h1>T</h1><p>{long}</p><section id="discussion"><h2>Discussion</h2><p>{long}</p></section><div class="rating-scale"><p>Short scale.</p></div><div class="social-history"><p>{long}</p></div><div class="related"><p>{long}</p><p>{long}</p></div><p>{long}</p>'
    want = ["T", long.strip(), "Discussion", long.strip(), "Short scale.", *[long.strip()] * 4]
    assert h.extract(PAGE % f"<article>{inner}</article>").split("\n") == want
    dropped = inner.replace("<h1>T</h1>", '<h1>T</h1><div class="share-buttons">Share this</div><div class="cookie-notice-box">Cookies, please.</div><div class="ad">Buy.</div>')
    assert h.extract(PAGE % f"<article>{dropped}</article>").split("\n") == want


def test_formulas_stay_in_their_sentence():
    assert h.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be given, here.</p></article>") == "Let x=2 be given, here."


def test_deep_and_long_pages_take_time_in_proportion():
    import time
    import tracemalloc

    for page in ("<div>x, " * 100_000, "<article>" * 100_000 + "x, y.", "<blockquote>x" * 50_000, "<p>x<table><tr><td>" * 20_000, "<ul><li>x, " * 50_000 + "</p>" * 50_000, '<div class="reply">x, ' * 50_000):
        start = time.process_time()
        h.extract(page)
        assert time.process_time() - start < 6, page[:30]
    tracemalloc.start()
    h.extract("<div>x, " * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_linked_headings_lists_and_quotations_of_the_article_stay():
    long = "This part of the article says something, at length, and with commas; it goes on. " * 2
    inner = f'<h1>T</h1><h2><a href="#x">Anchored heading</a></h2><p>{long}</p><ul><li><a href="#1">First reference</a></li><li><a href="#2">Second reference</a></li></ul><blockquote class="reply"><p>{long}</p></blockquote><div class="print"><p>{long}</p></div><div class="recommended">{long}</div>'
    want = ["T", "Anchored heading", long.strip(), "First reference", "Second reference", *[long.strip()] * 3]
    assert h.extract(PAGE % f"<article>{inner}</article>").split("\n") == want
    assert "Anchored heading" in h.extract(PAGE % f"<div id=content>{inner}</div>")


def test_shorter_articles_beside_one_stay():
    long = "A sentence of the long article, with commas. "
    page = PAGE % f"<article><h1>A</h1><p>{long * 20}</p></article><article><h2>B</h2><p>{long * 4}</p></article>"
    assert h.extract(page).split("\n") == ["A", (long * 20).strip(), "B", (long * 4).strip()]
