"""Pages whose scripts and unclosed elements hide the text that follows."""

import time

import pytest

from lodestar.llm.html_extraction import extract, main_texts, parse, trained_model


def blocks(source):
    return [t for t in parse(source).text if t]


@pytest.mark.parametrize(
    "hidden",
    [
        "<script>for(var i=0;i<n;i++){f(i)}</script>",
        "<script>a = '<!--';</script><script>if (b<c) d()</script >",
        "<style>a<b{}</style><textarea>x<y</textarea><iframe src=a>p<q</iframe>",
        "<noscript><script>i<n</script><div>no</div></noscript>",
        "<div><object data=a><p>no</p></div><object>no</object>",
        "<div><select><option>no<option>no</div><select><option>no</option></select>",
        "<datalist><option value=a><option value=b></datalist>",
        "<object data=a><iframe src=b><option>",
    ],
)
def test_text_after_hidden_parts(hidden):
    assert blocks(f"<html><head><title>a<b</title><script>i<n</script></head><body>{hidden}<article><p>One.</p><p>Two.</p></article></body></html>") == ["One.", "Two."]


def test_unclosed_script_is_no_text():
    assert blocks("<body><p>One.</p><script>i<n; <p>no</p>") == ["One."]


def test_many_unclosed_objects_in_linear_time():
    start = time.time()
    assert blocks("<div><object></div>" * 20_000 + "<p>One.</p>" + "<object>no</object>") == ["One."]
    assert time.time() - start < 10


ARTICLE = "<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article><h1>A title of words</h1><p>The first paragraph says something, and it ends with a full stop.</p>%s<p>The last paragraph says something else, and it ends the same way.</p></article></body></html>"
WORDS = ["A title of words", "The first paragraph says something, and it ends with a full stop.", "The last paragraph says something else, and it ends the same way."]


@pytest.mark.parametrize(
    "put",
    [
        "<!-- a --!>",
        "<!-->",
        "<!--->",
        "<!-- a -- > b -->",
        "<!---->",
        "<script src=https://x.com/>track(a);</script>",
        '<script src="x"/>if (a<b) c();</script>',
        "<style media=print/>p{}</style>",
        "<form><option>one<option>two</form>",
        "<form><select><option>one<option>two</form>",
        "<form><textarea>unsent words here</form>",
        "<form><label>Name</label><select name=a><option selected>one</select><textarea rows=2/>typed</textarea></form>",
        '<div style="display:none">Nobody is to read this sentence of the page.</div>',
        "<p hidden>Nobody is to read this sentence of the page.</p>",
        '<span style="color:red; display : none">Nobody is to read this.</span>',
        "<i hidden>Nobody <i>is</i> to read this.</i>",
        "<img alt=it's src=x><br/><hr>",
    ],
)
def test_article_stays_as_it_is(put):
    assert main_texts([ARTICLE % put], trained_model()) == ["\n".join(WORDS)]


@pytest.mark.parametrize(
    ("put", "text"),
    [
        ("<p>x <y and it's a fine day</p>", "x"),
        ('<p>Lines are <a style="text-decoration:none" href=\'/q?a>b\'>drawn</a> under links, at least on some pages.</p>', "Lines are drawn under links, at least on some pages."),
        ("<p title=don't>One may say don't, can't and won't here, and nothing goes missing.</p>", "One may say don't, can't and won't here, and nothing goes missing."),
        ("<p>Less is 1 < 2 and more is 3 > 2, as everybody has known for a long time.</p>", "Less is 1 < 2 and more is 3 > 2, as everybody has known for a long time."),
        ("<p>Caf&eacute;s &amp; bars&nbsp;close&#33; They open &lt;again&gt; in the morning of the day.</p>", "Cafés & bars close! They open <again> in the morning of the day."),
    ],
)
def test_text_between_paragraphs(put, text):
    assert text in main_texts([ARTICLE % put], trained_model())[0].split("\n")
    assert [t for t in blocks(ARTICLE % put) if t in WORDS] == WORDS


def test_long_page_in_linear_time():
    start = time.time()
    assert len(main_texts([ARTICLE % ("<p>A paragraph of a very long page, with words enough to stay.</p>" * 60_000)], trained_model())[0].split("\n")) == 60_003
    assert len(blocks("<p>a" + "<b c='" * 3000 + "<p>z")) >= 1
    assert time.time() - start < 60


def test_clashing_columns(spark):
    rows = [(1, "u", ARTICLE % "", "t", 5, 1.5), (1, "u", ARTICLE % "", "t", 5, 1.5), (None, None, None, "t", 5, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, unary double")).collect()
    assert sorted(got, key=str) == sorted([(1, "u", "\n".join(WORDS), sum(map(len, WORDS)) + 2)] * 2 + [(None, None, "", 0)], key=str)
