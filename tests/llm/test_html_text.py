import html
import re
import time

import pytest

from conftest import SF
from lexigrain.llm.html_text import Weights, best_run, extract, fit, main_text
from lexigrain.llm.queries import op2_html_text


def plain_article(page):
    """The article element's blocks, cut by regular expressions."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)\b[^>]*>", inside))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op2_html_text(spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {i: (p.url, t := plain_article(p.html), len(t)) for i, p in pages.items()}


WORDS = "Some words of the article that are long enough to count for much."
CHROME = [
    '<header class="site"><h1>The Daily</h1></header>',
    '<div class="cookie-notice"><p>We use cookies. Do you agree with that?</p><button>OK</button></div>',
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">More of it</a></li></ul></nav>',
    '<aside><p>Side words that nobody reads here.</p></aside>',
    '<form action="/s"><label>Your name</label><select><option>A</option></select></form>',
    '<section id="comments"><h2>Comments</h2><p>First! And a very long reader comment, longer than all others, that goes on and on.</p></section>',
    '<div class="ad banner">Buy this now.</div>',
    '<footer><p>&copy; The Daily</p></footer>',
    "<script>if (1 < 2) { x('</p>'); }</script><style>p { margin: 0 }</style><!-- <p>no</p> --><noscript>No script</noscript>",
]


@pytest.fixture(scope="module")
def weights(spark):
    return fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div id="content">%s</div>', "%s"])
@pytest.mark.parametrize("middle", ["", CHROME[3], CHROME[6], CHROME[8]])
def test_chrome_is_left_out(weights, wrap, middle):
    body = f"<h1>A title &amp; more</h1><p>{WORDS}<br>Next&nbsp;line</p>{middle}<p>{WORDS} <b>Bo</b>ld\n end.</p>"
    page = f"<html><head><title>T</title></head><body>{''.join(CHROME[:4])}{wrap % body}{''.join(CHROME[4:])}</body></html>"
    assert main_text(page, weights) == f"A title & more\n{WORDS} Next line\n{WORDS} Bold end."


WRAPPERS = [
    "<form id=aspnetForm>%s</form>",
    '<main class="content no-sidebar">%s</main>',
    '<article class="post comments-open">%s</article>',
    '<article class="post sponsored">%s</article>',
    '<form><div class="search-widget"><article class="recommended">%s</article></div></form>',
    '<div class="has-comments">%s</div>',
    '<fieldset><div class="search-result">%s</div></fieldset>',
    '<div class="related-topics">%s</div>',
    "<aside>%s</aside>",
    "<label>%s</label>",
    "<form>" * 2_000 + "%s" + "</form>" * 2_000,
]


@pytest.mark.parametrize("wrap", WRAPPERS)
@pytest.mark.parametrize("outside", [True, False])
def test_names_of_wrappers_hide_nothing(weights, wrap, outside):
    body = f"<h1>A title</h1><p>{WORDS}</p><p>{WORDS}</p>{CHROME[3]}<p>{WORDS}</p>"
    before, after = "".join(CHROME[:4]), "".join(CHROME[4:])
    page = before + wrap % body + after if outside else wrap % (before + body + after)
    assert main_text(f"<html><body>{page}</body></html>", weights) == "\n".join(["A title", WORDS, WORDS, WORDS])


@pytest.mark.parametrize("head", ['<header><h1>A title</h1></header>', '<h1 class="header">A title</h1>', '<div class="article-header"><h1>A title</h1></div>'])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_headlines_in_headers(weights, head, tag):
    page = f"<body>{''.join(CHROME[:4])}<{tag}>{head}<p>{WORDS}</p></{tag}>{''.join(CHROME[4:])}</body>"
    assert main_text(page, weights) == f"A title\n{WORDS}"


def test_named_parts_stay_out(weights):
    comments = '<section id="comments">' + f'<article class="comment"><p>{WORDS}</p></article>' * 2 + "</section>"
    cards = '<div class="related">' + "<article><p>Another page</p></article>" * 6 + "</div>"
    for wrap in ('<article class="post comments-open">%s</article>', '<div id="content">%s</div>', "<main>%s</main>"):
        assert main_text(f"<body>{wrap % f'<p>{WORDS}</p><p>{WORDS}</p>'}{comments}{cards}</body>", weights) == f"{WORDS}\n{WORDS}"
    results = "".join(f'<div class="search-result"><p>{WORDS}</p></div>' for _ in range(5))
    assert main_text(f"<body>{CHROME[2]}{results}</body>", weights) == "\n".join([WORDS] * 5)


def test_broken_and_bare_pages(weights):
    assert main_text("", weights) == ""
    assert main_text("just text &lt;b&gt; &#233;", weights) == "just text <b> é"
    assert main_text("<div><span></div>", weights) == ""
    assert main_text("<p>one<p>two<li>three<li>four", weights) == "one\ntwo\nthree\nfour"
    assert main_text("<p>a < b <c", weights).startswith("a <")
    assert main_text("<p>x<script>never closed", weights) == "x"
    assert main_text("<p " + "a='" * 5_000 + ">", weights) == ""
    assert len(main_text("<p>" + "word " * 200_000, weights)) == 999_999


def test_best_run():
    assert best_run([-1, 2, -1, 3, -9, 3]) == (1, 4) and best_run([-1.0, 0.0]) == (0, 0) and best_run([]) == (0, 0)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>word</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (1, "u", "", 0), (None, "u", "word", 4)], key=repr)
    assert extract(df.limit(0)).collect() == []
    assert extract(df, Weights({}, {})).count() == 3


def test_pages_without_the_label(spark, weights):
    """The weights find the same text where the article is a plain division."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert main_text(re.sub(r"(</?)article\b", r"\1div", r.html), weights) == plain_article(r.html), r.page_id


def test_letters_that_change_length_in_lower_case(weights):
    assert main_text("<p>İİİİ words here</p><script>var x = 1;</script><p>hello there</p>", weights) == "İİİİ words here\nhello there"
    assert main_text("<p>a</p><SCRIPT>x</ſcript>y</Script><p>b</p>", weights) == "a\nb"


def test_words_of_names_that_are_about_something_else(weights):
    page = "<body>" + CHROME[2] + "<article><p>%s</p><div class='share-price'><p>The share price rose</p></div><p>As a response</p>%s</article></body>"
    for chrome in ("", '<div class="share-buttons"><p>Tell your friends of it</p></div>', '<div class="site-footer widget-area">Footer</div>', '<ul class="nav-links list"><li>Next</li></ul>'):
        assert main_text(page % (WORDS, chrome), weights) == f"{WORDS}\nThe share price rose\nAs a response"


def test_formulas_are_text(weights):
    assert main_text(f"<article><p>{WORDS} <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math></p></article>", weights) == f"{WORDS} x = 1"


@pytest.mark.parametrize("part", ["<b>x ", "</i>y<b>", "<p>z", "<script></script>w ", "<li>q<b>", "<div>a "])
def test_a_megabyte_of_tags_takes_linear_time(weights, part):
    def seconds(n):
        began = time.process_time()
        main_text(part * (n // len(part)), weights)
        return time.process_time() - began

    assert seconds(1_000_000) < 8 * max(seconds(250_000), 0.1)


def test_quotes_and_comments(weights):
    assert main_text(f"<article><p title=it's>alpha beta gamma</p><p>don't stop {WORDS}</p></article>", weights) == f"alpha beta gamma\ndon't stop {WORDS}"
    assert main_text(f"<article><p><a href=/x title=John's>John</a> said it isn't so. {WORDS}</p></article>", weights) == f"John said it isn't so. {WORDS}"
    assert main_text(f'<article><p data-x="a>b" title = \'c>d\' e=">">{WORDS}</p></article>', weights) == WORDS
    for comment in ("<!-->", "<!--->", "<!-- x -->", "<!---->", "<!-- a --!>"):
        assert main_text(f"<article>{comment}<p>{WORDS}</p></article>", weights) == WORDS


def test_labels_and_quotations_in_articles(weights):
    assert main_text(f"<article><p>{WORDS} see <label>the label</label> <button>now</button></p></article>", weights) == f"{WORDS} see the label now"
    assert main_text(f"<article><p>{WORDS}</p><blockquote class='reply'><p>Quoted words</p></blockquote><fieldset><p>In a box</p></fieldset></article>", weights) == f"{WORDS}\nQuoted words\nIn a box"
    assert main_text(f"<article><p>{WORDS}</p><form><fieldset><legend>Sign up</legend><label>Mail</label></fieldset></form></article>", weights) == WORDS


@pytest.mark.parametrize("name", ["kommentare", "kommentar", "commentaires", "comentarios", "related-topics", "werbung"])
def test_names_in_other_languages(weights, name):
    assert main_text(f"<body><article><p>{WORDS}</p></article><div class='{name}'><p>{WORDS} I say</p></div></body>", weights) == WORDS
    assert main_text(f"<body><article><p>{WORDS}</p><p>{WORDS}</p><div class='{name}'><p>Not of it</p></div></article></body>", weights) == f"{WORDS}\n{WORDS}"
