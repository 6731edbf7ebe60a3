"""The labeller on pages whose wrappers and class names its training does not hold."""

import inspect
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from tessella.llm import html_extract

WRAPPERS = ("", "div.widecolumn>div.hentry>div.prose", "div.css-xkqz", "section.chapter", "div.leftcol>div.reading", "div.dispatch>div.longread", "div.kolumne")
DISCUSSION = ("div.discussion>p", "div.talkback>div.remark>p", "ul.reactions>li", "div.leserbriefe>div>p")
LINKS = ("nav>ul>li", "div.topbar>ul>li", "ul.jumplist>li")
END = ("footer>p", "div.colophon>p")
UNSEEN = {w for spec in (*WRAPPERS, *DISCUSSION, *LINKS, *END) for w in re.findall(r"\.([a-z]+)", spec)}


def tags(spec):
    parts = [p.split(".") for p in spec.split(">") if p]
    return "".join(f'<{t} class="{c[0]}">' if c else f"<{t}>" for t, *c in parts), "".join(f"</{t}>" for t, *_ in reversed(parts))


def made_page(rng, texts):
    """A page and the words of its article."""

    def sentence(low, high):
        words = texts[rng.integers(len(texts))].split()
        at = int(rng.integers(0, max(1, len(words) - high)))
        return " ".join(words[at : at + int(rng.integers(low, high))]) + "."

    def repeated(specs, n, low, high, link=False):
        before, after = tags(specs[rng.integers(len(specs))])
        outer, inner = before.rsplit("<", 1)
        close = after.split(">", 1)
        one = lambda s: f"<a href=/x>{s}</a>" if link else s
        return outer + "".join(f"<{inner}{one(sentence(low, high))}{close[0]}>" for _ in range(n)) + close[1]

    article = [sentence(3, 9), *(sentence(12, 90) for _ in range(int(rng.integers(3, 12))))]
    before, after = tags(WRAPPERS[rng.integers(len(WRAPPERS))])
    body = f"<h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" + ("<p hidden>Not to be seen here.</p><div style='display: none'><p>Nor this one, of course.</p></div>" if rng.random() < 0.1 else "") for p in article[1:])
    page = "<html><body>" + (repeated(LINKS, 5, 1, 3, link=True) if rng.random() < 0.7 else "") + before + body + after
    if before and rng.random() < 0.6:
        page += repeated(DISCUSSION, int(rng.integers(2, 5)), 5, 25)
    return page + (repeated(END, 1, 4, 12) if rng.random() < 0.6 else "") + "</body></html>", " ".join(article).split()


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train_labeller()


def test_wrappers_are_not_in_the_training():
    known = set(re.findall(r"[a-z]+", " ".join((*html_extract.MAIN_WRAPPERS, *(s for specs in html_extract.BOILERPLATE.values() for s in specs)))))
    assert not known & UNSEEN
    assert "reading" not in inspect.getsource(html_extract.training_page)


def test_unseen_wrappers(labeller):
    rng = np.random.default_rng(5)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t.split()) > 100]
    pages = [made_page(rng, texts) for _ in range(300)]
    scores = []
    for got, (_, gold) in zip(html_extract.main_texts(labeller, [p for p, _ in pages]), pages, strict=True):
        common = (Counter(got.split()) & Counter(gold)).total()
        scores.append(2 * common / (len(got.split()) + len(gold)))
    print(np.mean(scores), np.quantile(scores, [0.01, 0.05, 0.2]))
    assert np.mean(scores) >= 0.9


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><h1>A heading of a page</h1><p>The first paragraph says a few things, and goes on.</p><p>The second one ends the page, with more words.</p></body>", "A heading of a page The first paragraph says a few things, and goes on. The second one ends the page, with more words."),
        ("<div class=site-main><div class=hentry><div class=entry-content><p>The first paragraph of a blog, with a few words.</p><p>And a second paragraph to end it, with other words.</p></div></div></div>", "The first paragraph of a blog, with a few words. And a second paragraph to end it, with other words."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given in this sentence.</p><p hidden>Not shown to any reader.</p><p style='color:red; display : none'>Nor this.</p><p>The last paragraph.</p></article>", "Let x=1 be given in this sentence. The last paragraph."),
    ],
)
def test_plain_pages(labeller, html, text):
    assert html_extract.main_texts(labeller, [html]) == [text]
