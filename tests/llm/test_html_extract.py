import re

from siltstone.llm import html_extract as H


def test_article_between_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now</div><!-- x --><article><h1>A &amp; B</h1>
    <p><b>First   para<br>goes on.<br><p>Second <i>pa</i>ra &lt;tag&gt;.</p><p> </p><p>End.</p><section class="comments"><p>Me too, a comment</p></section></article>
    <aside>Side</aside><form><input>Mail</form><footer>&copy; all</footer></body></html>"""
    assert H.main_text(page) == "A & B\nFirst para goes on.\nSecond para <tag>.\nEnd."


def test_page_without_an_article():
    body = "".join(f"<p>This is a long paragraph of the main text, number {k}, with a good many words in it.</p>" for k in range(5))
    page = f'<body><div id="top-menu"><a href="/">Home</a><a href="/x">News</a></div><div><h2>Heading</h2>{body}<p>Bye.</p></div><div class="footer-links">imprint</div></body>'
    lines = H.main_text(page).split("\n")
    assert lines[0] == "Heading" and lines[-1] == "Bye." and len(lines) == 7


def test_text_broken_by_an_advert_or_links():
    text = [f"This is a long paragraph of the main text, number {k}, with a good many words in it." for k in range(10)]
    for between, kept in (('<div class="ad"><p>Buy</p><p>this</p><p>now</p></div>', []), ('<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul>', ["One", "Two", "Three"])):
        page = "<body><div>" + "".join(f"<p>{x}</p>" for x in text[:5]) + between + "".join(f"<p>{x}</p>" for x in text[5:]) + "</div></body>"
        assert H.main_text(page).split("\n") == text[:5] + kept + text[5:]


def test_a_small_article_does_not_decide():
    text = [f"This is a long paragraph of the main text, number {k}, with a good many words in it." for k in range(6)]
    page = "<body><div>" + "".join(f"<p>{x}</p>" for x in text) + "</div><article><h3>Teaser</h3><p>Read on.</p></article></body>"
    assert H.main_text(page).split("\n")[:6] == text


def test_names_of_wrappers():
    text = [f"This is a long paragraph of the main text, number {k}, with a good many words in it." for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in text)
    side = '<div class="sidebar"><p>One of the other stories, with some words.</p></div>'
    for tag, name in (("div", "content has-sidebar"), ("div", "content-sidebar-wrap"), ("article", "post comments-open"), ("main", "no-sidebar"), ("div", "sidebar-layout")):
        for attribute in ("class", "id"):
            assert H.main_text(f"<body><{tag} {attribute}='{name}'>{body}{side}</{tag}></body>").split("\n") == text
    assert H.main_text(f"<div class='form-page'><article>{body}</article>{side}</div>").split("\n") == text


def test_odd_pages():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<p></p>") == ""
    assert H.main_text("just text & more &nbsp; text") == "just text & more text"
    assert H.main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    assert H.main_text("<article><p>open <b>never closed") == "open never closed"
    assert H.main_text("<nav><ul><li>menu<article><p>text</p></article>") == "text"
    assert H.main_text("<main><p>a</p><script>never closed <p>b</p>") == "a"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(H.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").split("\n")) == 20_000


def test_stretches():
    import numpy as np

    assert H._stretches(np.array([0, 50, 3, 0, 9, 0, 0, 0, 60, 0, 0, 0]), 3, 40) == ([1, 8], [5, 9])
    assert H._stretches(np.array([3, 0, 0, 0, 60]), 3, 40) == ([4], [5])
    assert H._stretches(np.array([5, 5]), 3, 40) == ([0], [2])  # the page's own highest sum
    assert H._stretches(np.array([0, 0]), 3, 40) == ([], [])


def test_the_windows_choose():
    text = [f"This is a long paragraph of the main text, number {k}, with a good many words in it." for k in range(6)]
    links = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(4))
    body = "".join(f"<p>{x}</p>" for x in text)
    for tag in ("article", "div"):
        page = f"<body><div>12 March</div><ul>{links}</ul><{tag}>{body}</{tag}><ul>{links}</ul><div>Page 1 of 2</div></body>"
        assert H.main_text(page).split("\n") == text
        # a window over the whole page sees no surge and no dive in it: the short lines around the text come in
        assert H.main_text(page, window=100) != H.main_text(page) or tag == "article"
    outside = "A passage outside the article that is as long as a paragraph. " * 6
    page = f"<body><article>{body}</article><div>Short line.</div><div>{outside}</div></body>"
    assert H.main_text(page).split("\n") == [*text, outside.strip()]


def test_linear_in_hostile_pages():
    import time

    for unit in ("<a ", '<a "', "<a b='", "<b>", "</i>", "<b></i>", "<p><b>", "<!", "<svg>", "<svg/>", "&", "<a b=\"", "<dd><b>", "x<"):
        page = "<div><p><div>" + unit * ((2_000_000 if unit == "<a " else 400_000) // len(unit)) + ">"
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 30, unit


def test_pages_against_the_article_element(spark, sf):
    """The test pages hold the text in one article: what is outside must be gone, what is inside must stay."""
    import html

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    divs = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div>'), '</article>', '</div>') html")
    assert {r.page_id: r.text for r in H.extract(divs).collect()} == got  # the tag doesn't decide
    for r in rows:
        inside = r.html.split("<article>")[1].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(x for x in want if x)


def test_rows(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "t"), (1, "u", "<article><p>x</p></article>", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in H.extract(df).collect()), key=str) == [(1, "u", "x"), (1, "u", "x"), (None, None, "")]
    assert H.extract(df.limit(0)).count() == 0


def test_the_query_against_the_extractor(spark, sf):
    from siltstone.llm import queries

    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op2_html_extraction(spark, sf).collect()
    assert sorted(r.page_id for r in out) == sorted(rows)
    for r in out:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, H.main_text(rows[r.page_id].html), len(r.text))
