"""Pages that are long, deep or broken, and text that belongs to the article."""

import time

import pytest

from prismspark.llm import html_text
from prismspark.llm.common import prepare

MEGABYTE = 1_000_000


def text(body):
    return html_text.Page(f"<html><body>{body}</body></html>").text(None)


@pytest.mark.parametrize("part", ["<a ", "<div>", "<p", "<p>", "<div>x", "</b>", "<b><i>", "<svg>", "<a \"'>", "<!--", "<! ", "<li>", "</div>", "<i>x<p>y", "&#", "< ", "<div class='sidebar'>x"])
def test_a_megabyte_of_one_tag(part):
    began = time.time()
    page = html_text.Page(f"<article>begin {part * (MEGABYTE // len(part))} end")
    page.text(None)
    page.scores()
    assert time.time() - began < 20
    assert sum(map(len, page.paths)) < 40 * MEGABYTE


def test_inline_tags_under_many_others():
    began = time.time()
    page = html_text.Page("<article><b><div>" + "<i>" * 100_000 + "</b>" * 100_000 + "<li>x</li>" * 50_000 + "</article>")
    assert page.text(None).count("x") == 50_000 and time.time() - began < 20


def test_linked_article():
    assert text("<nav><a href='/'>menu</a></nav><article><a href='/x'>linked headline only</a></article>") == "linked headline only"
    assert text("<div><a href='/'>menu</a> <a href='/2'>more</a></div>") == ""


@pytest.mark.parametrize("part", ["<section class='search'><p>on search engines</p></section>", "<ul class='tags'><li>on search engines</li></ul>", "<p>on <math><mi>search</mi></math> engines</p>", "<object data='x'><p>on search engines</p></object>", "<canvas>on search engines</canvas>", "<div class='form'>on search engines</div>"])
def test_text_of_an_article(part):
    assert " ".join(text(f"<article><p>first words of it</p>{part}<p>last words</p></article>").split("\n")) == "first words of it on search engines last words"


def test_boilerplate_outside_the_article():
    body = "<section class='search'>find</section><ul class='tags'><li>a</li></ul><article><p>the words of it</p><div class='sidebar'>side</div><div class='comments'>me too</div><form>send</form><script>if (a < b) x('</p>')</script><style>p {}</style></article><footer>end</footer>"
    assert text(body) == "the words of it"


def test_broken_tags():
    assert text("<article><p>a < b and c > d <p title=\"x>y\">e<p title='open>f</article>") == "a < b and c > d\ne\nf"
    assert text("<article>a &#" + "9" * 5000 + "; b &#0065; &#" + "0" * 5000 + "66; c</article>") == "a � b A B c"
    assert text("<article>a <!-- b > c") == "a" and text("<article>a <!-- > b --> c <") == "a c <"
    assert [html_text.Page(f"<article>{t}").text(None) for t in ("a <b", "a <!-- b", "a < <b <!-- c", "<", "a <? b")] == ["a <b", "a", "a < <b", "<", "a <? b"]
    assert text("<article>a <svg>b<p>c <svg><title>d</title></svg> e</article>") == "a e"


def test_paths_of_deep_pages_are_short_and_shared():
    deep = "<div class='a1'>" * 3000 + "words of it"
    one, two = html_text.Page(deep), html_text.Page(deep.replace("a1", "a2"))
    assert one.paths == two.paths and len(set(one.paths)) == 3001 and max(map(len, one.paths)) < 30
    assert list(one.scores()) == [one.paths[-1]]


def test_hosts_with_long_pages(spark):
    prepare(spark)
    rows = [(i, u, h, "x") for i, (u, h) in enumerate([("https://a.org/1", "<article>first</article>"), ("https://a.org/2", "<div>" * 50_000 + "second"), (None, None), ("https://b.org", ""), ("https://a.org/1", "<article>first</article>")])]
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert found == {0: ("first", 5), 1: ("second", 6), 2: ("", 0), 3: ("", 0), 4: ("first", 5)}
