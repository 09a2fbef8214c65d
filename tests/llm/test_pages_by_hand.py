"""Pages written and labelled by hand, in layouts that the generator of training pages doesn't make. In each, the lines
of main text are those between ⟦ and ⟧."""

import itertools
import re

import pytest

from shakeprint.llm import html_extract, queries
from shakeprint.llm.html_blocks import leaf_blocks

PAGES = {
    "weblog": """<!doctype html><html><head><title>Slow mornings</title></head><body class="home blog logged-out"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><a href="/">A quiet blog</a><p class="site-description">Notes from the hills</p></header>
<nav class="main-navigation"><ul><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li></ul></nav><div id="content" class="site-content"><div id="primary"><main id="main"><article id="post-42" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">⟦Slow mornings⟧</h1></header>
<div class="entry-content"><p>⟦We got up late, and the fog had not lifted.⟧</p><p>⟦By noon the road was dry; nobody had passed since Friday.⟧</p><ul><li>⟦bread⟧</li><li>⟦two eggs⟧</li></ul></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely, thank you for this.</p></li><li class="comment"><p>I was there in May.</p></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Rain</a></li><li><a href="/2">Snow</a></li></ul></section></aside></div><footer id="colophon" class="site-footer">Proudly powered by nothing</footer></div></body></html>""",
    "news": """<html><body><div class="top-bar"><a href="/login">Log in</a> <a href="/subscribe">Subscribe</a></div><header role="banner"><a href="/">The Daily Sheet</a></header><nav role="navigation"><a href="/world">World</a><a href="/sport">Sport</a></nav>
<main role="main"><article itemprop="articleBody"><h1>⟦Bridge closes for repairs⟧</h1><p>⟦The old bridge over the river will close on Monday, the council said.⟧</p><div class="ad-slot"><p>Advertisement</p></div><p>⟦Repairs will take <b>six weeks</b> and cost about two million.⟧</p><h2>⟦Ferry service⟧</h2><p>⟦A ferry will run every half hour from 6 a.m.⟧</p><blockquote><p>⟦We know it is a long detour, and we are sorry.⟧</p></blockquote></article>
<aside class="related"><h3>Related</h3><ul><li><a href="/a">Road works elsewhere</a></li></ul></aside></main><div class="newsletter"><p>Get our morning letter.</p><form><label>Email</label><input><button>Sign up</button></form></div><footer><p>© 2021 The Daily Sheet. All rights reserved.</p></footer></body></html>""",
    "utility classes": """<html><body class="antialiased overflow-hidden"><div class="md:overflow-hidden flex flex-col"><nav class="flex px-4 py-2"><a href="/">Docs</a><a href="/api">API</a></nav><article class="prose lg:prose-xl mx-auto"><h1>⟦Install the package⟧</h1><p>⟦Download the archive and unpack it anywhere you like.⟧</p><pre>⟦tar xf tool.tar.gz && cd tool⟧</pre><p>⟦Then run the installer, which asks for a folder.⟧</p></article><footer class="mt-8 text-sm"><a href="/edit">Edit this page</a></footer></div></body></html>""",
    "plain old": """<html><head><title>Bees</title></head><body><h1>⟦Keeping bees⟧</h1><p>⟦Bees need water within a short flight of the hive.⟧<p>⟦In spring, look for brood on at least four frames.⟧<p>⟦Do not open the hive in rain.⟧</body></html>""",
    "math and objects": """<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">Notes</a></li></ul></nav><article><h1>⟦Mass and energy⟧</h1><p>⟦The relation <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds in suitable units.⟧</p><p>⟦See <object data="x.pdf">the printed paper</object> for a proof.⟧</p><p>⟦A drawing <svg width="9"><text>fig</text></svg> shows it.⟧</p></article><footer>Copyright 1999</footer></body></html>""",
    "medium style": """<html><body><div id="root"><div class="a b c"><div class="metabar"><a href="/">Home</a><a href="/signin">Sign in</a></div><article><div class="section"><div class="section-content"><h1>⟦What I learned from a broken clock⟧</h1><p>⟦For eleven years the clock in our hall was wrong.⟧</p><p>⟦It was <em>not</em> wrong by much; it lost four minutes a day.⟧</p><p>⟦That is how habits fail, too.⟧</p></div></div></article><div class="share-buttons"><a href="#">Tweet</a><a href="#">Share</a></div><div class="comments"><p>Great read!</p></div></div></div></body></html>""",
    "cookie bar": """<html><body><div id="cookie-banner" role="dialog"><p>We use cookies to improve your visit. By going on you agree.</p><button>Accept all</button></div><div id="header"><h2><a href="/">Garden Weekly</a></h2></div><div id="content"><h1>⟦Pruning apple trees⟧</h1><p>⟦Prune in late winter, before the buds swell.⟧</p><p>⟦Cut just above an outward-facing bud, at a slant.⟧</p><h2>⟦Tools⟧</h2><p>⟦A sharp saw and a clean pair of shears are enough.⟧</p></div><div id="sidebar"><h3>Popular</h3><ul><li><a href="/roses">Roses</a></li><li><a href="/soil">Soil</a></li></ul></div><div id="footer"><p>Imprint | Privacy</p></div></body></html>""",
    "wiki": """<html><body><div id="mw-navigation"><div class="menu"><ul><li><a href="/Main">Main page</a></li><li><a href="/Random">Random page</a></li></ul></div></div><main id="content" class="mw-body"><h1 id="firstHeading">⟦Lighthouse⟧</h1><div id="bodyContent"><p>⟦A <b>lighthouse</b> is a tower that gives light to help ships find their way.⟧</p><div class="toc" role="navigation"><h2>Contents</h2><ul><li><a href="#h">1 Origins</a></li><li><a href="#l">2 Lights</a></li></ul></div><h2>⟦History⟧</h2><p>⟦The first towers burned wood, and later coal or oil.⟧</p><h2>⟦Lamps⟧</h2><p>⟦A lens gathers the light into a beam.⟧</p></div></main><footer id="footer"><ul><li>This page was last edited on 3 May.</li></ul></footer></body></html>""",
    "recipe": """<html><body><header class="site-header"><nav><a href="/">Recipes</a></nav></header><div class="post-content"><h1>⟦Leek soup⟧</h1><p>⟦This soup takes half an hour and keeps for three days.⟧</p><h3>⟦You need⟧</h3><ul><li>⟦three leeks⟧</li><li>⟦one litre of stock⟧</li><li>⟦salt⟧</li></ul><h3>⟦How to⟧</h3><ol><li>⟦Wash and slice the leeks.⟧</li><li>⟦Simmer them in the stock until they are soft.⟧</li></ol></div><section class="comment-thread"><div class="comment"><p>Mine burned.</p></div></section><footer class="page-footer"><a href="/terms">Terms</a></footer></body></html>""",
    "hidden parts": """<html><body><div style="display: none"><p>Loading your page, please wait a moment.</p></div><main><article class="hidden-print story"><h1>⟦Night trains⟧</h1><p>⟦The last sleeper left in 1995; next week one returns.⟧</p><p hidden>⟦Draft note of the editors.⟧</p><p>⟦Tickets cost as much as a cheap hotel room.⟧</p></article></main><footer>© Rail Notes</footer></body></html>""",
    "table layout": """<html><body><table width="100%"><tr><td colspan="2" id="header"><a href="/">Home of chess</a></td></tr><tr><td class="menu"><a href="/rules">Rules</a><br><a href="/links">Links</a></td><td id="content"><h1>⟦The opening⟧</h1><p>⟦Move your pawns in the centre first.⟧</p><p>⟦Bring out knights before bishops, and castle early.⟧</p></td></tr><tr><td colspan="2" id="footer">Last update 2003</td></tr></table></body></html>""",
    "nested sections": """<html><body><div class="wrapper"><header><h1>City Library</h1><nav><ul><li><a href="/h">Hours</a></li></ul></nav></header><main><section class="story"><h2>⟦A new reading room⟧</h2><section><h3>⟦Light⟧</h3><p>⟦Tall windows face the garden.⟧</p></section><section><h3>⟦Quiet⟧</h3><p>⟦Felt on the walls takes the noise away.⟧</p></section></section></main><aside><p>Become a member today and borrow ten books.</p></aside><footer><p>12 Main Street</p></footer></div></body></html>""",
    "references": """<html><body><div class="masthead"><a href="/">Caf&eacute; Talk</a></div><div class="entry"><h1>⟦Caf&eacute; &amp; Tea⟧</h1><p>⟦Coffee&nbsp;is &lt;better&gt; when&#32;ground late &mdash; everyone says so.⟧</p><p>⟦Tea   needs
 water at 80&#176;.⟧</p></div><div class="widget"><p>Follow us</p></div></body></html>""",
    "custom elements": """<html><body><site-nav><ul><li><a href="/">Start</a></li><li><a href="/blog">Blog</a></li></ul></site-nav><article><h1>⟦A walk in the marsh⟧</h1><p>⟦Herons stood in the shallow water.⟧</p><video-player id="v"></video-player><p>⟦We counted nineteen of them.⟧</p><svg-icon name="x"></svg-icon><p>⟦Then it began to rain.⟧</p></article><footer>Marsh Society</footer></body></html>""",
    "notice in article": """<html><body><nav><a href="/">Top</a></nav><article class="post"><h1>⟦Changing a tyre⟧</h1><div class="notice"><p>This post has partner links.</p></div><p>⟦Loosen the nuts while the wheel is still on the ground.⟧</p><p>⟦Lift the car, and take the wheel off.⟧</p><div class="newsletter"><p>Join our list for more.</p></div><p>⟦Fit the spare wheel, and tighten the nuts crosswise.⟧</p><div class="author-bio"><p>Kim writes about cars.</p></div></article><div id="disqus"><p>First!</p></div></body></html>""",
    "question": """<html><body><div class="topbar"><form action="/s"><input name="q"><button>Search</button></form></div><div class="container"><main><article class="question"><h1>⟦Why does ice float?⟧</h1><p>⟦Most solids sink in their own liquid, so what is special about water?⟧</p></article></main><div class="sidebar"><h4>Hot questions</h4><ul><li><a href="/q1">Why is the sky blue?</a></li></ul></div></div><footer><a href="/help">Help</a></footer></body></html>""",
}


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """(text without marks, whether it is main) of the blocks."""
    return [(re.sub("[⟦⟧]", "", b.text), "⟦" in b.text) for b in leaf_blocks(page)]


@pytest.mark.parametrize("name", PAGES)
def test_labels_are_whole_blocks(name):
    for text, main in blocks_of(PAGES[name]):
        assert text.strip() and isinstance(main, bool)
    assert all(("⟦" in b.text) == ("⟧" in b.text) for b in leaf_blocks(PAGES[name]))


def test_extraction_of_pages_by_hand():
    right = total = missed = 0
    exact, wrong = 0, []
    for name, page in PAGES.items():
        marked = blocks_of(page)
        want = "\n".join(t for t, main in marked if main)
        got = html_extract.main_text(re.sub("[⟦⟧]", "", page))
        exact += got == want
        found = got.split("\n")
        for text, main in marked:
            total += 1
            right += (text in found) == main
            missed += main and text not in found
            if (text in found) != main:
                wrong.append((name, text, main))
    assert missed == 0, wrong
    assert right / total >= 0.97 and exact >= len(PAGES) - 3, wrong


WRAPS = {
    "state on body": lambda p: p.replace("<body", '<body data-x class="cookie-consent-open comment-enabled no-sidebar"', 1),
    "form around": lambda p: re.sub(r"(<body[^>]*>)(.*)(</body>)", r'\1<form id="aspnetForm" action="./">\2</form>\3', p, flags=re.DOTALL),
    "layers around": lambda p: re.sub(r"(<body[^>]*>)(.*)(</body>)", r'\1<div id="app" class="menu-open"><div class="layout with-sidebar has-ads">\2</div></div>\3', p, flags=re.DOTALL),
}


@pytest.mark.parametrize("wrap", WRAPS)
def test_pages_by_hand_in_other_layouts(wrap):
    """Each of the pages again, with names and elements around it that say nothing of its text."""
    right = total = missed = 0
    wrong = []
    for name, page in PAGES.items():
        page = WRAPS[wrap](page)
        found = html_extract.main_text(re.sub("[⟦⟧]", "", page)).split("\n")
        for text, main in blocks_of(page):
            total += 1
            right += (text in found) == main
            missed += main and text not in found
            if (text in found) != main:
                wrong.append((name, text, main))
    assert missed <= 1 and right / total >= 0.97, wrong


def test_query_against_brute_force(spark, sf_dir):
    """Every page of the table: of all labellings of its blocks the likeliest, by trying them all where they are few,
    and by plain dynamic programming over whole labellings else."""
    model = html_extract.trained()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}

    def weight(odds, labels):
        chain = model.chain
        return labels[0] * chain.start + sum(o for o, y in zip(odds, labels, strict=True) if y) + sum(chain.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

    def best(odds):
        if len(odds) <= 12:
            return max(itertools.product((0, 1), repeat=len(odds)), key=lambda y: weight(odds, y))
        ways = {0: ([0], weight(odds[:1], [0])), 1: ([1], weight(odds[:1], [1]))}
        for o in odds[1:]:
            ways = {y: max(((w + [y], s + model.chain.move[w[-1], y] + (o if y else 0.0)) for w, s in ways.values()), key=lambda x: x[1]) for y in (0, 1)}
        return max(ways.values(), key=lambda x: x[1])[0]

    rows = queries.op10_html_extract(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        blocks = [b for b in leaf_blocks(pages[r.page_id] or "")]
        labels = best([model.odds(html_extract.features(b)) for b in blocks]) if blocks else []
        assert r.text == "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y) and r.n_chars == len(r.text)
