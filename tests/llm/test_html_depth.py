"""Text of elements that merely look special, containers far above a block, and very large pages."""

import time

import pytest

from batchlens.llm import html_text

PROSE = [f"Paragraph {w} of the story tells in some detail how the work went on, and why it took so long to finish." for w in ("one", "two", "three", "four")]
TOP = "<html><head><title>Site</title></head><body><nav class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
STORY = "<article><h1>A long title of the story</h1>" + "".join(f"<p>{p}</p>" for p in PROSE[:2]) + "{}" + "".join(f"<p>{p}</p>" for p in PROSE[2:]) + "</article>"
WANT = "\n".join(["A long title of the story", *PROSE])


@pytest.fixture(scope="module")
def chain():
    return html_text.model()


@pytest.mark.parametrize("name", ["svg", "math", "object", "canvas", "audio", "video", "template"])
def test_unclosed_elements_swallow_nothing(chain, name):
    page = TOP + STORY.format(f"<{name} width=3>") + "</body></html>"
    assert html_text.extract_text(page, chain) == WANT


@pytest.mark.parametrize("name", ["svg", "math", "object", "canvas", "audio", "video"])
def test_text_of_closed_elements_stays(chain, name):
    inner = "Text within the element is read like any other text of the article, word for word."
    page = TOP + STORY.format(f"<{name}><p>{inner}</p></{name}>") + "</body></html>"
    assert html_text.extract_text(page, chain) == WANT.replace(PROSE[2], f"{inner}\n{PROSE[2]}")


@pytest.mark.parametrize("name", ["script", "style", "noscript", "textarea", "iframe", "template"])
def test_hidden_content_stays_out(chain, name):
    page = TOP + STORY.format(f"<{name}>Hidden words that nobody sees, <p>not even this long paragraph of them.</p></{name}>") + "</body></html>"
    assert html_text.extract_text(page, chain) == WANT


@pytest.mark.parametrize("depth", [1, 5, 12, 50])
@pytest.mark.parametrize("outer", ["<section class='comments'>", "<div id='comment-list'>", "<footer>", "<div class='site-footer'>", "<aside class='sidebar'>"])
def test_containers_count_at_any_depth(chain, outer, depth):
    tag = outer[1:].split(" ")[0].rstrip(">")
    below = outer + "<div>" * depth + "<p>Words of a reader or of the publisher, long enough to look like prose of the story itself.</p>" + "</div>" * depth + f"</{tag}>"
    assert html_text.extract_text(TOP + "<div>" * depth + STORY.format("") + "</div>" * depth + below + "</body></html>", chain) == WANT


def test_features_follow_the_stack():
    page = html_text.blocks("<div class='a b'><ul><li>x<li><b>y</b></ul>z</div>w<p>v")
    assert [(b.text, b.around, b.parent) for b in page] == [
        ("x", ("in:div", "in:li", "in:ul", "name:a", "name:b"), "li"), ("y", ("in:div", "in:li", "in:ul", "name:a", "name:b"), "li"),
        ("z", ("in:div", "name:a", "name:b"), "div"), ("w", (), ""), ("v", ("in:p",), "p"),
    ]
    assert html_text.blocks("<div " * 5_000) == []


@pytest.mark.parametrize("piece", ["<div>text ", "<b><p>x", "<ul><li>y", "<p class='c1'>z</i>", "<svg><g>q"])
def test_large_and_deep_pages_in_linear_time(spark, chain, piece):
    page = piece * (5_000_000 // len(piece))
    began = time.process_time()
    found = html_text.blocks(page, chain.known)
    assert len(found) >= 1 and time.process_time() - began < 60
    small = piece * 2000
    df = spark.createDataFrame([(1, "u", page), (2, "u", small)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df, chain).collect()}
    assert got[2].text == html_text.extract_text(small, chain) and got[1].n_chars == len(got[1].text)
