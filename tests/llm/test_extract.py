import pytest

from sightline.llm import extract
from tests.conftest import rows

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    "<div class='cookie-notice'><p>We use cookies on this site, please accept them all.</p></div>"
    "<article><h1>The &amp; title</h1><p>First   paragraph\nwith <b>bold</b> text&nbsp;here.<br>More.</p>"
    "<div class='advert'>Buy this now</div><ul><li>item one</li><li>item two</li></ul>"
    "<script>var a = '<p>no</p>';</script><p>Last one.</p>"
    "<section id='comments'><p>I like this article very much, said a reader.</p></section></article>"
    "<aside><p>Other things to read in the sidebar</p></aside>"
    "<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020 example</footer></body></html>"
)
TEXT = "The & title\nFirst paragraph with bold text here. More.\nitem one\nitem two\nLast one."


def test_article_without_everything_else():
    assert extract.main_texts([PAGE]) == [TEXT]


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words only", "plain words only"),
        ("<article><p>open <b>never closed <i>tags", "open never closed tags"),
        ("<article><p>one<p>two</article>", "one\ntwo"),
        ("<article><p>cut off <!-- and a comment", "cut off"),
        ("<article><p>a &lt;b&gt; &#x41;&#66; &eacute; &unknown; &am</p></article>", "a <b> AB é &unknown; &am"),
        ("<article><p title='a > b'>x</p></article>", "x"),
        ("<article><p>kept</p><p hidden>not</p><div style='display: none'>not</div></article>", "kept"),
        ("</div></p><article><p>x</p></article></nav>", "x"),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_single_cases(html, text):
    assert extract.main_texts([html]) == [text]


def test_the_tree_fits_its_table_and_long_pages_are_whole():
    x, y = extract.labelled_rows()
    assert (extract.classified(extract.tree(), x) == y).mean() > 0.97
    page = "<article>" + "".join(f"<p>word{i} and more</p>" for i in range(20_000)) + "</article>"
    assert extract.main_texts([page])[0].count("\n") == 19_999


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    data = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, None)]
    found = extract.extracted(spark.createDataFrame(data, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert rows(found, "page_id", "text", "n_chars") == [(1, TEXT, len(TEXT))] * 2 + [(None, "", 0)]
    assert extract.extracted(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article aria-hidden="false"><p>kept</p><p aria-hidden="true">not</p></article>', "kept"),
        ('<article><div data-hidden="false">kept</div><p HIDDEN=hidden>not</p></article>', "kept"),
        ('<article><p title="a hidden valley">kept</p></article>', "kept"),
        ('<article><p title="class=comments id=ad">kept</p><p data-class="comments">too</p></article>', "kept\ntoo"),
        ('<article><p title="a>b" class = \'comments\'>not</p><p>kept</p></article>', "kept"),
        ('<article><p>one</p><svg width="1" /><p>two</p><svg><text>not</text></svg><p>three</p>', "one\ntwo\nthree"),
        ("<article><p>one</p><svg-icon></svg-icon><p>two</p></article>", "one\ntwo"),
        ('<main class="has-sidebar"><p>some words of the text</p></main>', "some words of the text"),
        ("<article class='post tag-search'><p>some words of the text</p></article>", "some words of the text"),
        ("<article><p>kept</p></article><article class=comment><p>I like this very much</p></article>", "kept"),
    ],
)
def test_attributes_are_read_by_name(html, text):
    assert extract.main_texts([html]) == [text]


@pytest.mark.parametrize(
    "shape",
    ["<b>{}</i>", "<div>{}<p>", "<b>{}<p>", "<b>{}</b>", "<p>{}</div>", "<ul><li>{}</b>", "<td><p>{}<tr>", "<a><b>{}x</a>", "<i>{}<div>x</div>"],
)
def test_parsing_is_linear(shape):
    """A megabyte of tags that never close, or close nothing, takes a second or two."""
    import time

    first, second = shape.split("{}")
    page = "<p>one two three</p>" + first * (500_000 // len(first)) + second * (500_000 // len(second))
    started = time.process_time()
    found = extract.blocks(page)
    assert time.process_time() - started < 12
    assert found[0].text == "one two three"
