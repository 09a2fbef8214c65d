import pytest
from pyspark.sql import functions as F

from shakeprint.llm import html_extract
from shakeprint.llm.html_blocks import leaf_blocks
from shakeprint.llm.html_pages import labelled_pages


def test_blocks():
    page = '<html><head><title>T</title><style>p{}</style></head><body><p>a &amp; b<br>c<p>d&nbsp;<b>e</b>\n f<script>x("</p>")</script><ul><li>g<li><a href=x>h</a></ul><!-- no --><div>i</div>j &copy'
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["a & b c", "d e f", "g", "h", "i", "j ©"]
    assert blocks[3].link_chars == 1 and [e.tag for e in blocks[3].path][-3:] == ["ul", "li"] or [e.tag for e in blocks[3].path][-1] in ("li", "a")
    assert leaf_blocks("") == [] and leaf_blocks("<p") == [] and [b.text for b in leaf_blocks("<div hidden>x</div>")] == ["x"]


def test_raw_names_end_and_empty_svg():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    for tag in ("<video-js id=1></video-js>", "<svg-icon>", "<audio-player src='a'/>", "<svg/>", '<svg class="a" viewBox="0 0 / >"/>', "<math />", "<title-bar></title-bar>"):
        assert texts(f"<p>a</p>{tag}<p>rest</p>") == ["a", "rest"], tag
    for tag in ("<svg><path/>yes</svg>", "<svg a=b/>yes</svg>", "<video src=x>yes</video>", "<noscript>yes</noscript>", "<svg\n>yes</svg >", "<textarea>yes</textarea>", "<template>yes</template>"):
        assert texts(f"<p>a</p><div>{tag}</div><p>rest</p>") == ["a", "yes", "rest"], tag
    for tag in ("<script>no</script>", "<style>no</style>", "<!-- no -->", "<script\n>if (a < b) no('</p>')</script >"):
        assert texts(f"<p>a</p>{tag}<p>rest</p>") == ["a", "rest"], tag
    assert texts("<head><title>no</title><meta x>no</head><p>a") == ["a"] == texts("<head><title>no</title><p>a")


def test_nothing_hides():
    """Hidden parts of an article are part of it; only where they stand tells."""
    for attrs in ('class="overflow-hidden"', 'class="hidden-print a"', 'class="hidden"', "hidden", 'style="color:red; display: none"'):
        assert [b.text for b in leaf_blocks(f"<div {attrs}><p>x</p></div>")] == ["x"], attrs
        page = PAGE.replace("<article>", f"<article {attrs}>")
        assert html_extract.main_text(page) == html_extract.main_text(PAGE) != "", attrs


LONG_PAGE = """<html><body{body}>{before}<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
{open}<h1>A walk in the marsh</h1>{inner}<p>{one}</p><p>{two}</p>{close}<footer>© 2020 Marsh Society. All rights reserved.</footer>{after}</body></html>"""
ONE = "Herons stood in the shallow water, and we counted nineteen of them before the rain began to fall on the reeds."
TWO = "It was late when we came back to the road; nobody had passed, and the lamps of the village were out already."


def marsh(body="", before="", after="", open="<article>", inner="", close="</article>"):
    page = LONG_PAGE.format(body=body, before=before, after=after, open=open, inner=inner, close=close, one=ONE, two=TWO)
    return html_extract.main_text(page)


WHOLE = f"A walk in the marsh\n{ONE}\n{TWO}"
STATES = ["cookie-consent-open", "comment-enabled", "has-sidebar", "with-sidebar", "no-sidebar", "page-header-fixed", "modal-open", "ads-enabled", "menu-open has-footer", "nav-fixed home blog", "popup-active"]


@pytest.mark.parametrize("name", STATES)
def test_names_of_states(name):
    """On body, on what is around an article, and on a layer inside it."""
    assert marsh(f' class="{name}"') == WHOLE
    assert marsh(before=f'<div class="{name}">', after="</div>") == WHOLE
    assert marsh(inner=f'<div class="{name}">', close="</div></article>") == WHOLE
    assert marsh(f' class="{name}"', open='<div class="content">', close="</div>") == WHOLE


@pytest.mark.parametrize("name", ["form-group", "text-widget", "top", "header", "has-sidebar", "banner", "widget", "bottom", "menu-page", "alert-box"])
def test_layers_inside_an_article(name):
    assert marsh(inner=f'<div class="{name}">', close="</div></article>") == WHOLE
    assert marsh(inner=f'<section><div id="{name}"><div>', close="</div></div></section></article>") == WHOLE


@pytest.mark.parametrize("holder", [("<article>", "</article>"), ('<div id="main">', "</div>"), ('<div class="content">', "</div>"), ("<main>", "</main>")])
def test_a_form_around_the_page(holder):
    for name in ("aspnetForm", "form1", "search"):
        assert marsh(before=f'<form id="{name}">', after="</form>", open=holder[0], close=holder[1]) == WHOLE


def test_what_is_not_main_stays_out():
    """Longer than the article, and still not of it."""
    said = "".join(f'<div class="comment"><p>I was there {k} years ago, and it rained then, too, all the day long.</p></div>' for k in range(12))
    assert marsh(after=f'<section class="comments">{said}</section>') == WHOLE
    assert marsh(close=f'</article><div id="comments">{said}</div>') == WHOLE
    assert marsh(before='<div class="cookie-notice"><p>We use cookies. By going on you agree to all of them, and to our terms.</p></div>') == WHOLE
    assert marsh(before="<noscript>Please turn on JavaScript to see this page.</noscript>") == WHOLE


def test_field_on_held_out_pages():
    model = html_extract.trained()
    wrong = total = 0
    for blocks, labels in labelled_pages(150, seed=77):
        found = model.chain.viterbi([model.odds(html_extract.features(b)) for b in blocks])
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


PAGE = '<html><body><nav><ul><li><a href="/">Home page</a></li></ul></nav><div class="ad">Buy it now. It is great.</div><article><h1>Title here</h1><p>First &lt;one&gt;,\n with  space.</p><p><b>Bold text<br><p>Last.</article><section class="comments"><p>I liked it a lot, really.</p></section><footer>&copy; us</footer>'


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<p>" + "long text. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = html_extract.extract(df).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id == 1] == ["Title here\nFirst <one>, with space.\nBold text\nLast."] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, None)} == {""}
    assert next(r for r in got if r.page_id == 3).n_chars == len("long text. " * 50_000) - 1
    assert html_extract.extract(df.limit(0)).count() == 0
