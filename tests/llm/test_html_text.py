"""The main text of pages: layouts, edges, and brute force for the best run."""

import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomfold.llm import html_text
from loomfold.llm.html_text import PRIOR, best_region, main_text, weights_from

BARE = weights_from({})
STORY = ["The harbour was quiet when the first boats came back that morning.", "Nobody on the quay had expected them before noon, so nobody was there.", "By ten, though, the whole town knew."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)
WANT = "\n".join(STORY)
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News and more news</a></li><li><a href='/about'>About us</a></li></ul>"
LONG = " ".join(["this is something else that goes on for long"] * 30)


def layouts() -> dict[str, tuple[str, str]]:
    titled = "Boats\n" + WANT
    return {
        "article": (f"<nav>{MENU}</nav><article><h1>Boats</h1>{PARAGRAPHS}</article><footer>{LONG}</footer>", titled),
        "main": (f"<header><h1>Gazette</h1><p>{LONG}</p></header><main><h1>Boats</h1>{PARAGRAPHS}</main><aside>{LONG}</aside>", titled),
        "div by id": (f"<div id='menu'>{MENU}</div><div id='content'><h1>Boats</h1>{PARAGRAPHS}</div><div id='sidebar'><p>{LONG}</p></div><div class='site-footer'>{LONG}</div>", titled),
        "div without names": (f"<div>{MENU}</div><div><h1>Boats</h1>{PARAGRAPHS}</div><div>{MENU}</div>", titled),
        "table": (f"<table><tr><td>{MENU}<td><h1>Boats</h1>{PARAGRAPHS}<td>{MENU}</table>", titled),
        "advert between": (f"<article>{PARAGRAPHS[:-30]}<div class='ad-box'><p>{LONG}</p></div></article>", None),
        "advert and a short end": (f"<article><p>{STORY[0]}</p><div class='ad'>{LONG}</div><p>{STORY[1]}</p><aside>{LONG}</aside><p>{STORY[2]}</p></article>", WANT),
        "comments in the article": (f"<article>{PARAGRAPHS}<section id='comments'><article class='comment'><p>{LONG}</p></article></section></article>", WANT),
        "comments after": (f"<main><article>{PARAGRAPHS}</article><div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div></main>", WANT),
        "form and cookie notice": (f"<div id='cookie-notice'>{LONG}</div><article>{PARAGRAPHS}<form><p>{LONG}</p><input><button>Send it now</button></form></article>", WANT),
        "script and style": (f"<script>var a='<p>{LONG}</p>';</script><style>p{{}}</style><article>{PARAGRAPHS}<script>if (a<b) {{}}</script></article><!-- <p>{LONG}</p> -->", WANT),
        "hidden": (f"<article><p hidden>{LONG}</p><p style='display: none'>{LONG}</p>{PARAGRAPHS}</article>", WANT),
        "wrapper named after its sidebar": (f"<div class='with-sidebar'><article>{PARAGRAPHS}</article><div class='sidebar'>{LONG}</div></div>", WANT),
        "all in a wrapper named otherwise": (f"<div class='sidebar-layout'><nav>{MENU}</nav>{PARAGRAPHS}</div>", WANT),
        "article header": (f"<article><header><h1>Boats</h1><p>Share this page with friends</p></header>{PARAGRAPHS}</article>", titled),
        "item property": (f"<div><h2>Boats</h2><div itemprop='articleBody'>{PARAGRAPHS}</div></div><div>{LONG}</div>", titled),
        "cut off": (f"<nav>{MENU}</nav><article><h1>Boats</h1>{PARAGRAPHS[:-4]}", titled),
        "ends left out": (f"<nav><ul><li><a href=/>Home<li><a href=/x>More</ul></nav><article><h1>Boats</h1>{''.join('<p>' + x for x in STORY)}</article>", titled),
        "list in the article": ("<article><p>Three things:</p><ul><li>one<li>two<li>three</ul></article>", "Three things:\none\ntwo\nthree"),
        "short article": (f"<nav>{MENU}</nav><article><p>Yes.</p></article><div>{LONG}</div><footer>{LONG}</footer>", "Yes."),
        "no head end": (f"<html><head><title>{LONG}</title><body><article>{PARAGRAPHS}</article>", WANT),
    }


def test_layouts():
    for name, (page, want) in layouts().items():
        for weights in (BARE, learnt()):
            if want is not None:
                assert main_text(page, weights) == want, name
    page, _ = layouts()["advert between"]
    assert LONG not in main_text(page, BARE)


def learnt():
    total = html_text.Counter()
    for k in range(300):
        total += html_text.counts(f"<html><body><nav>{MENU}</nav><article><h1>Boats {k}</h1>{PARAGRAPHS}</article><div class='ad'>{STORY[0]}</div><footer>&copy; {k}</footer></body></html>")
    return weights_from(total)


def test_weights_have_signs_and_follow_labels():
    weights = learnt()
    assert all(v > 0 for v in weights.words.values()) and all(v < 0 for v in weights.tags.values())
    assert weights.tags["p"] > PRIOR["p"] and weights.tags["/body"] < -1
    assert BARE.words["text"] == 1.0 and not html_text.counts(f"<div>{PARAGRAPHS}</div>")


def test_text_rules():
    def inner(x):
        return main_text(f"<article>{x}</article>", BARE)

    assert inner("<p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &amp;lt; &copy 1 &bogus;") == "a & b <c> ééé &lt; © 1 &bogus;"
    assert inner("<p>  two \n\t words<br>here&nbsp;now <b>b</b><i>i</i></p>") == "two words here now bi"
    assert inner("<p>a</p>tail<div>b<p>c</div>d") == "a\ntail\nb\nc\nd"
    assert inner("<P CLASS=x>A</P><p title='a > b'>B</p><p title=a'b>C</p>x < y") == "A\nB\nC\nx < y"
    assert main_text(None, BARE) == main_text("", BARE) == main_text("<p></p>", BARE) == main_text("<nav>a b c</nav>", BARE) == ""
    assert main_text("plain words only", BARE) == "plain words only"
    assert main_text("<", BARE) == "<" and main_text("<article><p>x</p><a href='", BARE) == "x"


def test_long_and_deep_pages_take_linear_time():
    assert main_text("<article>" + "<b>" * 50_000 + "<p>x" * 20_000, BARE).count("x") == 20_000
    assert main_text("<div>" * 20_000 + "word", BARE) == "word"
    assert main_text('<article><p>x <a b="' * 5_000, BARE).startswith("x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_region_is_the_maximum(scores):
    start, end = best_region(scores)
    best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
    assert sum(scores[start:end]) == max(0, best) and (start < end) == (best > 0)
    if best > 0:
        assert not any(sum(scores[i:j]) == best for j in range(1, end) for i in range(j))


def test_query_equals_the_marked_articles(spark, sf_dir):
    from loomfold.llm.queries import op11_html_text

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op11_html_text(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    pages = [(r.page_id, r.html) for r in rows]
    for r in rows:
        body = re.search("<article>(.*)</article>", r.html, re.S).group(1).replace("<br>", " ")
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (r.url, want, len(want))
    # without the markup that names the article, learnt weights find it by its words
    bare = spark.createDataFrame([(i, re.sub("</?article>", "", h)) for i, h in pages], "page_id bigint, html string")
    weights = html_text.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = {r.page_id: r.text for r in html_text.extract(bare, weights).collect()}
    assert all(found[i] == got[i][1] for i in found)


def test_edges(spark):
    schema = "page_id bigint, url string, html string, TEXT string, _loom_html int"
    rows = [(1, "a", None, "x", 1), (1, "a", None, "x", 1), (None, None, "<p>one two", None, None), (3, "b", "", "y", 2)]
    pages = spark.createDataFrame(rows, schema)
    weights = html_text.learn(pages)
    assert weights == BARE
    got = sorted(html_text.extract(pages, weights).collect(), key=str)
    assert sorted(r.text for r in got) == ["", "", "", "one two"] and got[0].asDict().keys() == {"page_id", "url", "_loom_html", "text", "n_chars"}
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0))).collect() == []
