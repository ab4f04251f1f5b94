import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import html_text

BODY = "<p>First paragraph of the article, long enough to be seen, with <b>bold</b> words.</p><p>Second &amp; last one, which has a <a href=x>link</a> inside it as well.</p>"
TEXT = "First paragraph of the article, long enough to be seen, with bold words.\nSecond & last one, which has a link inside it as well."
MENU = "<ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul>"

PAGES = {
    "article": (f"<body><nav>{MENU}</nav><!-- ad --><div class=ad>Buy</div><article>{BODY}</article><footer>&copy; us</footer>", TEXT),
    "plain containers": (f'<div id="header"><a href=/>Site</a></div><div class="wrap">{MENU}<div class="post">{BODY}</div></div><div class="footer">Rights</div>', TEXT),
    "sidebar and notice": (f'<div class="cookie-notice">We use cookies, many of them, on all of our pages, and more.</div><main>{BODY}</main><div id=sidebar><p>Other stories of today</p></div>', TEXT),
    "reader comments": (f'<article>{BODY}<section id="comments"><div class="comment"><p>{"A long comment by a reader. " * 20}</p></div></section></article>', TEXT),
    "comments beside": (f'<div class="story">{BODY}</div><div class="comments"><p>{"A long comment by a reader. " * 20}</p></div>', TEXT),
    "forms, scripts and styles": (f'<article><style>p{{}}</style><script>if (a<b) w("</p>")</script>{BODY}<form><input><button>Go</button>Name</form></article>', TEXT),
    "unclosed": (f"<article><h1>Head</h1>{BODY.replace('</p>', '')}", "Head\n" + TEXT),
    "headline in a header": (f"<header><h1>Site</h1></header><article><header><h1>Head</h1><span>by me</span></header>{BODY}</article>", "Head\n" + TEXT),
    "table": (f"<main>{BODY}<table><tr><td>1<td>2<tr><td>3</table></main>", TEXT + "\n1\n2\n3"),
    "hidden": (f'<article><p hidden>No</p><p style="display: none">No</p><div aria-hidden="true">No</div>{BODY}</article>', TEXT),
    "body with a telling class": (f'<body class="has-sidebar page-with-menu">{BODY}</body>', TEXT),
    "upper case and odd tags": (f"<ARTICLE><P>a<BR>b</P><x-y>c</x-y></ARTICLE><NAV>n</NAV>", "a b\nc"),
    "no tags": ("just text &lt;b&gt; 1 < 2 & 3", "just text <b> 1 < 2 & 3"),
    "references": ("<article><p>&eacute;&#233;&#xe9;&nbsp;x &amp &am</p></article>", "ééé x & &am"),
    "cut": ('<article><p>abc def</p><p>ghi <a href="x', "abc def\nghi"),
    "cut comment": ("<article><p>abc</p><!-- never ends", "abc"),
    "preformatted": ("<article><pre>a\n  b</pre>\n\n<blockquote>c</blockquote></article>", "a b\nc"),
    **{f"all in {c}": (f'<nav>{MENU}</nav><div class="{c}">{BODY}</div><p><a href=/>Home</a></p>', TEXT) for c in
       ("content no-sidebar", "has-sidebar", "entry with-comments", "layout-header-fixed", "related-work", "notices", "share-price")},
    "all in a section named notices": (f'<body><section id="notices">{BODY}</section></body>', TEXT),
    "telling first words": (f'<article>{BODY}<p class="share-price">Up two per cent.</p><div class="related-findings">Found before.</div></article>', TEXT + "\nUp two per cent.\nFound before."),
    "names with ways": (f'<div class="story">{BODY}</div><div class="reader-comments-list"><p>{"A comment. " * 9}</p></div><div class="sidebar-left">Left</div><ul id="related-posts"><li>One</ul>', TEXT),
    "paragraph in a header": (f"<article><header><h1>Head</h1><p>by me, today</p><p>What it is about, told in one sentence of more than ten words.</p></header>{BODY}</article>",
                              "Head\nWhat it is about, told in one sentence of more than ten words.\n" + TEXT),
    "formula": (f"<article>{BODY}<p>Area is <math><mi>a</mi><mo>=</mo><mn>2</mn></math> here.</p></article>", TEXT + "\nArea is a=2 here."),
    "nothing": ("<html><body><nav>menu</nav></body></html>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


def test_bare_text_beside_the_seed():
    first, second, last = ("word " * 60).strip(), ("more " * 50).strip(), ("closing " * 30).strip()
    quotes = [("quoted " * 28).strip(), ("cited " * 33).strip()]
    quote = f"<blockquote><p>{quotes[0]}</p><p>{quotes[1]}</p></blockquote>"
    html = f"<body><div class=post>{first}<br><br>{second} <b>bold</b> <span>and so on</span>{quote}{last}</div>"
    assert html_text.main_text(html) == "\n".join([f"{first} {second} bold and so on", *quotes, last])
    linked = f"<body><div class=post><a href=x>Here</a> | <a href=y>There</a>{quote}{last}</div>"
    assert html_text.main_text(linked) == "\n".join([*quotes, last])


def test_density_by_hand():
    assert html_text.composite_density(0, 3, 0, 0, 0.1) == 0.0
    assert html_text.composite_density(100, 4, 0, 0, 0.0) > html_text.composite_density(100, 4, 60, 3, 0.3) > 0
    assert html_text.composite_density(200, 4, 0, 0, 0.0) > html_text.composite_density(100, 4, 0, 0, 0.0)


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert html_text.main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert html_text.main_text("<" * 20_000) == "<" * 20_000
    assert len(html_text.main_text("<a b='" + "x" * 50_000)) >= 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap b\"'=!-&;div", max_size=120))
def test_any_markup_is_read(text):
    out = html_text.main_text(text)
    assert out == "\n".join(" ".join(line.split()) for line in out.split("\n"))


def test_table_of_pages(spark):
    rows = [(1, "u", PAGES["article"][0], "old", 3), (1, "u", PAGES["article"][0], "old", 3), (None, None, None, None, None), (2, "v", "", "", 0)]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted(found.columns) == ["n_chars", "page_id", "text", "url"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found.collect()) == sorted(
        [("1", TEXT, len(TEXT)), ("1", TEXT, len(TEXT)), ("None", "", 0), ("2", "", 0)]
    )
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
