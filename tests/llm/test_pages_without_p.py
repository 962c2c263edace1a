"""Articles whose text is not in p elements, and the article of every page of a table."""

import html
import os
import re

import pytest

from behavex.llm import html_extract

DATA = "/root/testdata/sf0.1"
SENTENCES = ["The river rises in the northern hills and runs for ninety miles.", "It was first mapped by surveyors in the last century.", "Today most of its banks are farmland."]
CHINESE = ["这条河发源于北部的山区，全长九十英里，流经许多村庄和城市。", "上个世纪的测量员首次绘制了它的地图，并记录了沿岸的地貌。", "今天它的两岸大多是农田，也有一些工厂和学校。"]


def layouts(title, said):
    divs = "".join(f"<div>{x}</div>" for x in said)
    pairs = "".join(f"<div>{a} {b}</div>" for a, b in zip(said * 2, said[1:] + said + said[:1], strict=True))
    return {
        "breaks": f'<h1>{title}</h1><div class="post-body">{"<br><br>".join(said)}</div>',
        "divs": f'<h1>{title}</h1><div class="post-body">{divs}</div>',
        "divs in an article": f'<article><h1>{title}</h1><div class="post-body">{divs}</div></article>',
        "longer divs": f"<article><h1>{title}</h1>{pairs}</article>",
        "bare": f'<div class="content">{" ".join(said)}</div>',
        "span": f"<main><div><span>{' '.join(said)}</span></div></main>",
        "weblog": f'<div class="post"><h3 class="post-title">{title}</h3><div class="post-body">{"<br />".join(said)}</div></div>',
    }


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


@pytest.mark.parametrize("said", [SENTENCES, CHINESE])
@pytest.mark.parametrize("around", [False, True])
@pytest.mark.parametrize("layout", sorted(layouts("", SENTENCES)))
def test_no_sentence_is_lost(model, layout, around, said):
    body = layouts("River", said)[layout]
    if around:
        body = f'<div class="nav"><a href="/">Home</a> <a href="/a">About us</a></div>{body}<div id="footer">Copyright 2024 by us. All rights reserved.</div>'
    text = html_extract.main_text(f"<html><body>{body}</body></html>", model)
    assert all(x in text for x in said) and "Home" not in text and "Copyright" not in text
    assert "River" in text or "River" not in body


def brute_article(page):
    """The text of the article element, by its block elements."""
    found = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)
    return "".join(html.unescape(re.sub(r"<[^>]*>", " ", found.group(1))).split())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_page_of_the_table(spark, model):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: brute_article(r.html) for r in pages.collect()}
    got = {r.page_id: "".join(r.text.split()) for r in html_extract.extract(pages, model).collect()}
    assert got == want and len(got) == 2500
