import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import with_clash
from weftline.llm.html_text import BLOCKS, Page, attributes_of, densities, extract_main_text, main_text, says_boilerplate

LONG = "A paragraph of the article with enough words in it to weigh more than what stands around it, as articles do. "
BODY = f"<h2>The title</h2><p>{LONG}One.</p><p>{LONG}<a href=x>Two</a>.</p><p>{LONG}Three.</p>"
WANT = f"The title\n{LONG}One.\n{LONG}Two.\n{LONG}Three."
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>{LONG}</footer></body></html>",
        f"<body><div class='top'>{MENU}</div><div id=content>{BODY}</div><div class=sidebar><p>{LONG}</p></div><div id='footer'>{LONG}</div></body>",
        f"<body><header><h1>Site</h1></header><main>{BODY}<form><p>{LONG}</p></form><section class='comments'><p>{LONG}{LONG}</p></section></main></body>",
        f"<div><div class='cookie-notice'>{LONG}</div><div><div class=x>{BODY}</div></div><aside>{LONG}</aside></div>",
        f"<article>{BODY}<div class='ad'>{LONG}</div><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style></article>",
        f"<article>{BODY.replace('</p>', '')}",
        f"<article>{BODY.replace('One.', '<b>One.').replace('<p>', '<P class=z>')}</article></div></b>",
        f"<article><!-- <p>{LONG}</p> -->{BODY}<noscript>{LONG}</noscript><div role=navigation>{MENU}</div></article>",
    ],
)
def test_layouts(page):
    assert main_text(page) == WANT


ONE = "A sentence of the only part that this page has, long enough to be one. " * 8


@pytest.mark.parametrize(
    "attributes",
    ["style='overflow:hidden'", 'title="the hidden truth"', "data-id=ad", 'data-role="menu"', 'data-href="?class=notice"', 'class="social-studies"', 'alt="> class=ad <p"', "class=notice", "id=comments role=form", "CLASS='ad-hoc sidebar'"],
)
def test_names_alone_remove_no_text(attributes):
    assert main_text(f"<body><div {attributes}><p>{ONE}</p><p>{ONE}</p></div></body>") == f"{ONE.strip()}\n{ONE.strip()}"
    assert main_text(f"<body><form id=all {attributes}><nav>{MENU}</nav><div>{BODY}</div></form></body>") == WANT


@pytest.mark.parametrize("attributes", ["hidden", "hidden=''", "style='color: red; display : none'"])
def test_parts_that_are_not_shown(attributes):
    assert main_text(f"<article>{BODY}<div {attributes}>{LONG}</div></article>") == WANT


def test_parts_of_a_text():
    inline = "<p>Energy is <math>E=mc2</math> in physics, <abbr title='hidden Markov model'>HMM</abbr> <span class='notice-board-x'>too</span>.</p>"
    assert main_text(f"<article>{BODY}{inline}</article>") == WANT + "\nEnergy is E=mc2 in physics, HMM too."
    table = "<table><tr><th>a<td>b<tr><td>1<td>2</table><pre>x\n  y</pre><xmp><b>&amp;</xmp>"
    assert main_text(f"<article>{BODY}{table}</article>") == WANT + "\na\nb\n1\n2\nx y<b>&amp;".replace("y<b>", "y\n<b>")


def test_an_article_in_two_parts():
    second = BODY.replace("One", "Four").replace("The title", "More")
    for tag in ("article", "section", "div"):
        page = f"<body><nav>{MENU}</nav><div><{tag}>{BODY}</{tag}><{tag}>{second}</{tag}></div><div class=footer>{LONG}</div></body>"
        assert main_text(page) == f"{WANT}\n{WANT.replace('One', 'Four').replace('The title', 'More')}"


def test_attributes():
    assert attributes_of(""" a b = 'x "y' C="z'" d=e/f a=2 data-class='class=ad' """) == {"a": "", "b": 'x "y', "c": "z'", "d": "e/f", "data-class": "class=ad"}
    assert all(map(says_boilerplate, ("ad", "cookie-notice", "siteFooter", "main_nav", "sidebar-left", "comments")))
    assert not any(map(says_boilerplate, ("social-studies", "ad-hoc", "shadow", "content", "navy", "notice-of-meeting", "header-1-a")))


def test_references_white_space_and_breaks():
    assert main_text("<article><p> a&amp;b &#8212;\n\t&eacute; &lt;i&gt; </p>tail<br>of <i>it</i><ul><li>x<li>y</ul></article>") == "a&b — é <i>\ntail of it\nx\ny"


def test_headings_above_a_bare_content_division():
    assert main_text(f"<body>{MENU}<h1>The title</h1><div>{BODY[18:]}</div></body>").startswith(f"The title\n{LONG}One.")


def test_densities_lower_links():
    page = Page(f"<body><div>{MENU}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>")
    density, sums = densities(page)
    divs = [i for i, t in enumerate(page.tag) if t == "div"]
    assert density[divs[0]] < density[divs[1]] and max(range(len(sums)), key=sums.__getitem__) == divs[1]


TREES = st.recursive(st.text("ab c", min_size=0, max_size=30), lambda kids: st.tuples(st.sampled_from(["p", "div", "b", "a", "section"]), st.lists(kids, max_size=4)), max_leaves=12)


def plain_densities(tree):
    """Densities and sums in page order by their definition, from the nested tree."""
    from math import e, log

    def chars(t, only_links=False, linked=False):
        if isinstance(t, str):
            return len(t.replace(" ", "")) if linked or not only_links else 0
        return sum(chars(k, only_links, linked or t[0] == "a") for k in t[1])

    def tags(t, name=None):
        return 0 if isinstance(t, str) else sum((not isinstance(k, str) and name in (None, k[0])) + tags(k, name) for k in t[1])

    share = chars(tree, True) / max(1, chars(tree))
    out = []

    def visit(t, linked):
        c, lc = chars(t), chars(t, True, linked)
        d = 0.0
        if c:
            base = log(log(c * max(1, lc) / max(1, c - lc) + share * c + e))
            d = c / max(1, tags(t)) * max(0.0, log(c * max(1, tags(t)) / (max(1, lc) * max(1, tags(t, "a"))))) / base
        at = len(out)
        out.append([d, 0.0])
        below = [(k[0], visit(k, linked or k[0] == "a"), chars(k)) for k in t[1] if not isinstance(k, str)]
        held = [x for name, x, n in below if name in BLOCKS and n]
        out[at][1] = sum(held) if held else d * (t[0] in BLOCKS or t[0] == "#root")
        return d

    visit(tree, False)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=4))
def test_densities_by_definition(kids):
    def markup(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(markup, t[1]))}</{t[0]}>"

    def nests(t, inside=()):  # what a parser does not take apart: no p around a block
        return isinstance(t, str) or (t[0] not in BLOCKS or "p" not in inside) and all(nests(k, (*inside, t[0])) for k in t[1])

    tree = ("#root", kids)
    if nests(tree):
        density, sums = densities(Page("".join(map(markup, kids))))
        want = plain_densities(tree)
        assert density == pytest.approx([d for d, _ in want]) and sums == pytest.approx([x for _, x in want])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", ">", "<a href='", "'", '"', "</div>", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "<", "<li>", "<b>", "</ul>", "<br/>", "<article>", "</", "<![x", "é"]), max_size=30).map("".join))
def test_any_markup_is_read(page):
    out = main_text(page)
    assert out == "\n".join(" ".join(x.split()) for x in out.split("\n"))


def test_deep_and_long_pages():
    assert main_text("<div>" * 50_000 + "deep words") == "deep words"
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert main_text("<a '" * 30_000 + "x") is not None and main_text("<p>a < b <c") == "a < b <c"


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>"), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p></p>"), (5, "u", "plain é text")]
    frame = with_clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "n_chars")
    out = sorted((tuple(r) for r in extract_main_text(frame).collect()), key=repr)
    want = [(1, "u", WANT, len(WANT)), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0), (None, "u", "", 0), (5, "u", "plain é text", 12)]
    assert out == sorted(want, key=repr)
    assert extract_main_text(frame.limit(0)).count() == 0


def test_whole_table_as_the_marked_articles(spark):
    blocks = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|div|table|tr|td|section)\b[^>]*>")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.sub(r"<br[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in blocks.split(article))
        assert got[r.page_id].text == "\n".join(x for x in lines if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert main_text(r.html.replace("article>", "div>")) == got[r.page_id].text  # density decides, not the tag
