import random
import time

from terralift.llm import op9_html
from tests.llm.data import documents

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p>a{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="page sidebar-left"><header class="site-header"><a href=/>Logo</a> Slogan of the site that is rather long to read</header><nav><ul><li><a href=/a>A</a></li><li>B</li></ul></nav>
<div id="cookie-notice"><p>We use cookies. Accept them all, please, or read on in the policy of this site.</p></div>
<div class="wrap"><aside><p>Side story that is long enough to be taken for text by a careless reader.</p></aside>
<article><header><h1>Caf&eacute; &amp; bar</h1></header><p><b>First  <i>bold</i>
line.<br>same block<p>Second &lt;tag&gt;.</p><div class="advert">Buy now, buy cheap, buy a lot of things that nobody needs.</div>
<ul><li>one</li><li>two <a href=x>link</a></li></ul><form><input value=x>Your mail</form><p>Yes.</p><!-- <p>gone</p> --></article>
<section id="comments"><article class="comment"><p>Reader says: this is a long comment about the article above and more.</p></article></section></div>
<footer>&copy; 2020 Somebody, all rights reserved, in every country of the world</footer></body></html>"""
TEXT = ["Café & bar", "First bold line. same block", "Second <tag>.", "one", "two link", "Yes."]


def test_article():
    assert op9_html.main_text(PAGE) == "\n\n".join(TEXT)


def test_without_article_element():
    page = PAGE.replace("<article>", '<div class="content">', 1).replace("</article>", "</div>", 1)
    page = page.replace("var t=\"</p></div>", "var t=\"</p>")
    got = op9_html.main_text(page)
    for part in (TEXT[1], TEXT[2], "Yes."):
        assert part in got
    for part in ("Slogan", "cookies", "Side story", "Buy now", "Reader says", "rights reserved", "Your mail"):
        assert part not in got


def test_broken_markup():
    assert op9_html.main_text("just words &amp; more") == "just words & more"
    assert op9_html.main_text("<nav>menu<p>x<article><p>body text<p>more") == "body text\n\nmore"
    assert op9_html.main_text("a < b and c > d") == "a < b and c > d"
    assert op9_html.main_text("<p title='it's'>hello there<p a=\"<\">you") .startswith("hello there")
    for bad in ("<", "<!--", "<script>", "</p></p>", "<p " * 50, "<div>" * 3000 + "deep", "&#0;&bogus;&", "\x00"):
        op9_html.main_text(bad)


def test_table(spark):
    docs = documents(spark, [PAGE, None, "", "plain", "<p>" + "long text " * 20000 + "</p>"])
    rows = op9_html.extract(docs.withColumnRenamed("text", "html"), keep=["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == docs.count()
    assert by_id[0]["text"] == "\n\n".join(TEXT) and by_id[1]["text"] == "" and by_id[3]["text"] == "plain"
    assert by_id[4]["n_chars"] == len(("long text " * 20000).strip())
    assert op9_html.extract(documents(spark, []).withColumnRenamed("text", "html"), keep=["doc_id"]).count() == 0


def plain_stretches(weights, level, window):
    """Line by line, without sums kept."""
    n, found, i = len(weights), [], 0
    seen = lambda k: sum(max(0, w) for w in weights[k : k + window])
    while i < n:
        j = i
        if weights[i] > 0:
            while j < n and weights[j] >= 0 and seen(j) > 0:
                j += 1
            if any(seen(k) > level for k in range(i, j)):
                found.append((i, j))
        i = max(j, i + 1)
    return found


def test_stretches():
    assert op9_html.stretches([0, 5, 0, 9, 0, 0, 0, 4]) == [(1, 4), (7, 8)]
    assert op9_html.stretches([5, op9_html.SINK, 4, 0, op9_html.SINK]) == [(0, 1), (2, 3)]
    assert op9_html.stretches([]) == []
    draw = random.Random(1)
    for _ in range(500):
        weights = [draw.choice([op9_html.SINK, 0, 0, 0, draw.randint(1, 9), draw.randint(1, 9)]) for _ in range(draw.randint(0, 30))]
        level = draw.choice([0, 3, 10])
        assert op9_html.stretches(weights, level) == plain_stretches(weights, level, op9_html.WINDOW)


def test_surge_and_dive_decide(monkeypatch):
    monkeypatch.setattr(op9_html, "stretches", lambda weights, *_: [(0, len(weights))])
    everything = op9_html.main_text(PAGE)
    assert "Slogan" in everything and "cookies" in everything and "Buy now" in everything


def test_text_after_an_advert_of_its_container_stays():
    long = "words of the body that go on and on. " * 20
    page = f"<body><div class=c><p>{long}</p><div class=ad>Buy.</div><p>Last.</p><p><a href=/x>All of it a link</a></p><p>End.</p></div><nav>menu</nav><div class=x><p>Stray</p></div></body>"
    assert op9_html.main_text(page) == f"{long.strip()}\n\nLast.\n\nAll of it a link\n\nEnd."


def test_slight_article_without_links_stays():
    long = "words of the body that go on and on. " * 20
    page = f"<article><p>{long}</p></article><article><h2>Short one</h2></article><article><a href=/t>Teaser</a> of more</article>"
    assert op9_html.main_text(page) == f"{long.strip()}\n\nShort one"


def test_quoted_angle_brackets():
    assert op9_html.main_text('<article><p title="a > b">one</p><p data-x=\'<b>\' class="t">two</p></article>') == "one\n\ntwo"


def test_broken_pages_take_one_pass():
    value = ' a="b"'
    began = time.perf_counter()
    for page in ("<p" + value * 10_000, "<p" + " a='b\"" * 10_000, '<a "' * 20_000, "<!-" * 50_000, "<nav>" * 3000 + "<section>" * 3000, "<div>" * 5000 + "</span>" * 20_000, "<script " * 20_000, "<aside>x" * 5000):
        op9_html.main_text(page)
        assert time.perf_counter() - began < 5
    began = time.perf_counter()
    op9_html.main_text("<p" + value * 10_000)
    assert time.perf_counter() - began < 1
