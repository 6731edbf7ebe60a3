"""Main text of web pages: a recurrent labeller over the sequence of text blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each has
the hashed tags, classes, ids and roles on its path, all its words, hashed, and a
few numbers, among them how the page's text is spread over its containers; a page
of any length takes a few hundred bytes for a block. A numpy bidirectional LSTM
reads the vectors of the whole page in order and says of every block whether it
belongs to the main text. It is trained on generated pages whose blocks are
labelled; half of them have no wrapper or wrappers with names made up for the
page, so that the labeller does not depend on known names.

Edge cases: null and empty pages, and pages without main text, give an empty
text; blocks that the page hides are no main text; markup that is cut off or badly nested is read as far as it goes; long
pages are read whole; repeated rows are answered alike. Other columns pass
through; one with the name of an added column gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Adam, lstm, lstm_gradient, lstm_params, sigmoid, uniform
from .common import fresh

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z_:@][^\s=>/\"']*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset("class id role aria-label".split())
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Tags without an end, tags whose content is no text, tags that do not end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select object canvas".split())
INLINE = frozenset("a abbr annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q s samp semantics small span strike strong sub sup time tt u var wbr".split())
#: Tags that a new one of the same kind ends.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Tags that lay out the text of their container.
LAYOUT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary".split())

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 4096, 32, 12
INPUTS = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
PROJECTION, HIDDEN = 24, 16
TRAIN_PAGES, TRAIN_STEPS, TRAIN_BATCH = 2500, 900, 32

HIDDEN_TOKEN = "!hidden"
Block = tuple[tuple[str, ...], str, int]  # path tokens, text, characters inside links


def path_tokens(name: str, rest: str) -> tuple[str, ...]:
    """The tag and the words of its class, id, role and label."""
    out = [name]
    if "=" in rest or "hidden" in rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key in NAMING:
                out += [f".{w}" for w in re.split(r"[^a-z]+", value.lower()) if len(w) > 1]
            elif key == "hidden" or key == "style" and CONCEALED.search(value):
                out.append(HIDDEN_TOKEN)
    return tuple(out)


@lru_cache(maxsize=1 << 12)
def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without the tags at its end that only lay out text."""
    end = len(path)
    for i in range(len(path) - 1, -1, -1):
        if path[i][0] not in ".!":
            if path[i] not in LAYOUT:
                break
            end = i
    return path[:end]


def spread(blocks: list[Block]) -> np.ndarray:
    """How each block's container stands to the others of the page, a row of six numbers for each block.

    Its share of the page's text outside links, whether it is the container with
    the largest share or inside that one, whether it comes before or after that
    one, its rank among containers of some size, and its share of links.
    """
    order: dict[tuple[str, ...], int] = {}
    at = np.array([order.setdefault(container(path), len(order)) for path, _, _ in blocks])
    size = np.array([len(text) for _, text, _ in blocks], dtype=np.float64)
    links = np.array([link_chars for _, _, link_chars in blocks], dtype=np.float64)
    text, linked = np.bincount(at, np.maximum(size - links, 0)), np.bincount(at, links)
    share = text / max(text.sum(), 1)
    top = int(share.argmax())
    names = list(order)
    inside = np.array([c[: len(names[top])] == names[top] for c in names])
    places = np.flatnonzero(at == top)
    place = np.arange(len(at))
    rank = np.cumsum(share >= 0.1) - 1
    return np.stack((share[at], inside[at], place < places[0], place > places[-1], np.clip(rank[at], 0, 4) / 4, np.minimum(1, linked / np.bincount(at, size))[at]), axis=1)


def leaf_blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order, with references decoded and white space joined."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link_chars = 0
    links = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((tuple(t for _, tokens in stack for t in tokens), text, link_chars))
        link_chars = 0

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            piece = html[at:stop]
            parts.append(piece)
            if links:
                link_chars += len(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name in INLINE:
                links -= name == "a" and links > 0
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            flush()
            if not m["rest"].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else end
            continue
        if name in INLINE:
            links += name == "a"
            continue
        flush()
        if name in VOID or m["rest"].endswith("/"):
            continue
        closes = SELF_CLOSING.get(name, set())
        if stack and stack[-1][0] in closes:
            stack.pop()
        links = 0
        stack.append((name, path_tokens(name, m["rest"])))
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS


@lru_cache(maxsize=1 << 12)
def path_buckets(path: tuple[str, ...]) -> np.ndarray:
    """Two buckets for each token, so that a name that shares one with another is not taken for it."""
    hashes = [zlib.crc32(t.encode()) for t in path]
    return np.unique([b % PATH_BUCKETS for h in hashes for b in (h, h // PATH_BUCKETS)]).astype(np.int64)


def inputs(blocks: list[Block]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each block the path buckets, and a row of its word shares and numbers."""
    dense = np.zeros((len(blocks), WORD_BUCKETS + NUMBERS), dtype=np.float32)
    for i, (path, text, link_chars) in enumerate(blocks):
        words = text.split()
        dense[i, :WORD_BUCKETS] = np.bincount([word_bucket(w) for w in words], minlength=WORD_BUCKETS) * (0.5 / max(len(words), 1))
        n = len(text)
        dense[i, WORD_BUCKETS:-6] = (np.log1p(n) / 8, min(1.0, link_chars / n), text[-1] in ".!?", text.count(",") / (1 + n / 40), i / len(blocks), len(path) / 12)
    dense[:, -6:] = spread(blocks)
    return [path_buckets(path) for path, _, _ in blocks], dense


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row with all inputs for each block, as the training needs them."""
    return expanded(*inputs(blocks), np.arange(PATH_BUCKETS))


def expanded(paths: list[np.ndarray], dense: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The rows of inputs with a column for each path bucket in used."""
    x = np.zeros((len(paths), len(used) + dense.shape[1]), dtype=np.float32)
    x[:, len(used) :] = dense
    for i, path in enumerate(paths):
        x[i, np.searchsorted(used, path)] = 1
    return x


def projected(p: dict[str, np.ndarray], blocks: list[Block]) -> np.ndarray:
    """What the first layer makes of vectors(blocks)."""
    paths, dense = inputs(blocks)
    out = dense @ p["project"][PATH_BUCKETS:]
    at = np.concatenate(([0], np.cumsum([len(path) for path in paths])))
    sums = np.concatenate((np.zeros((1, out.shape[1]), np.float32), np.cumsum(p["project"][np.concatenate(paths)], axis=0, dtype=np.float64)))
    return np.tanh(out + sums[at[1:]] - sums[at[:-1]]).astype(np.float32)


# Generated training pages. Names under each role are those that pages commonly use.
#: Tags and class names by role.
MAIN_WRAPPERS = ("article", "main", "div.content", "div.post", "div.entry-content", "section.article-body", "div#main-content", "article.post", "main>article", "div.story", "div.article__text", "div.page-body>article")
BOILERPLATE = {
    "menu": ("nav>ul>li", "div.menu>ul>li", "ul.navbar>li", "nav.breadcrumb", "div.breadcrumbs", "nav#main-nav>a", "div.tabs>ul>li", "ul.pagination>li", "div.toc>ol>li"),
    "header": ("header", "div.site-header", "header>h1", "div#masthead", "header>div.logo", "header>p"),
    "footer": ("footer", "div.footer", "footer>p", "div#site-footer>ul>li", "footer>div.copyright", "div.legal"),
    "sidebar": ("aside", "div.sidebar", "aside>ul>li", "div#secondary>div.widget", "div.related>ul>li", "section.recommended>h3", "aside>p", "div.newsletter", "div.social-share", "div.tags", "aside.author-bio"),
    "notice": ("div.notice", "div.cookie-banner", "div.alert", "div#gdpr-consent>p", "p.disclaimer", "div.banner", "div.popup>p", "div.modal>p", "div.paywall", "div.warning>p"),
    "advert": ("div.ad", "div.advert", "div.sponsored>p", "div.promo", "aside.ads", "ins.adsbygoogle", "div#ad-slot", "div.advertisement>p"),
    "form": ("form>p", "form>label", "form>fieldset>div", "div.search-form", "form>button", "div.login>form>p", "form.subscribe>div"),
    "comment": ("div.comments>div.comment>p", "section#comments>article.comment>p", "ol.comment-list>li>p", "div.reader-comments>p", "div#disqus-thread>p", "section.comments>h2", "div.comment-body>p", "ul.replies>li>p", "article.comment>p"),
}


def _sentence(rng: np.random.Generator, words: np.ndarray, n: int) -> str:
    """n words with marks between and behind them, of which no role of block is typical."""
    few = rng.random() < 0.12  # the same few words again and again
    chosen = words[rng.integers(0, len(words), n) if not few else rng.choice(rng.integers(0, len(words), 3), n)].tolist()
    if few and rng.random() < 0.3:
        chosen *= int(rng.integers(2, 40))
        n = len(chosen)
    if rng.random() < 0.5:
        mark = (",", ".", "***", " |", "!!", "&&&")[rng.integers(6)]
        chosen = [w + mark if r < 0.2 else w for w, r in zip(chosen, rng.random(n), strict=True)]
    return " ".join(chosen).capitalize() + (".", ".", ".", "", "!", "?", "***", " |", ":")[rng.integers(9)]


def _steps(spec: str) -> tuple[str, ...]:
    out: list[str] = []
    for part in spec.split(">"):
        m = re.match(r"([a-z0-9]+)(?:[.#](.+))?", part)
        out += [m[1], *(f".{w}" for w in re.split(r"[^a-z]+", m[2] or "") if len(w) > 1)]
    return tuple(out)


def _name(rng: np.random.Generator) -> str:
    """A class name made up for one page."""
    return "." + "".join(("bcdfghklmnprstvwz"[rng.integers(17)] + "aeiouy"[rng.integers(6)]) for _ in range(int(rng.integers(1, 5))))


def _unnamed(rng: np.random.Generator, most: int = 3) -> tuple[str, ...]:
    """Nested wrappers with made-up names or none."""
    out: list[str] = []
    for _ in range(int(rng.integers(1, most + 1))):
        out.append("section" if rng.random() < 0.2 else "div")
        out += [_name(rng) for _ in range(int(rng.integers(0, 3)))]
    return tuple(out)


def training_page(rng: np.random.Generator, words: np.ndarray) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a page: boilerplate before, inside and after an article.

    The article is in a wrapper of a known name, in wrappers of made-up names, or
    in the body itself; boilerplate outside it can have made-up names, too.
    """
    blocks: list[Block] = []
    labels: list[int] = []
    outer = ("html", "body") + ((), ("div", ".wrapper"), ("div", ".container", "div", ".row"), ("div",))[rng.integers(4)]
    if rng.random() < 0.3:
        outer += _unnamed(rng, 2)

    def boilerplate(role: str, under: tuple[str, ...], unnamed: float = 0.0) -> None:
        specs = BOILERPLATE[role]
        path = under + _steps(specs[rng.integers(len(specs))])
        if rng.random() < unnamed:
            path = under + _unnamed(rng) + (("ul", "li"), ("p",), ("p",), ())[rng.integers(4)]
        link = role in ("menu", "sidebar") and rng.random() < 0.7
        for _ in range(int(rng.integers(1, 7))):
            long = role in ("comment", "notice", "advert", "footer", "sidebar") and rng.random() < 0.6
            text = _sentence(rng, words, int(rng.integers(6, 50))) if long else _sentence(rng, words, int(rng.integers(1, 5)))
            blocks.append((path, text, len(text) if link else 0))
            labels.append(0)

    kind = rng.random()
    inside = outer + _steps(MAIN_WRAPPERS[rng.integers(len(MAIN_WRAPPERS))])
    if kind < 0.2:
        inside = outer
    elif kind < 0.6:
        inside = outer + _unnamed(rng)
    for role in ("notice", "header", "menu", "advert", "form", "sidebar"):
        if rng.random() < 0.45:
            boilerplate(role, outer, 0.35 if role in ("menu", "sidebar") else 0.1)
    if rng.random() < 0.8:
        blocks.append(((*inside, "header", "h1") if rng.random() < 0.1 else (*inside, "h1"), _sentence(rng, words, int(rng.integers(2, 12))), 0))
        labels.append(1)
    for _ in range(int(rng.integers(1, 22))):
        tail = (("p",), ("p",), ("p",), ("p",), ("p", "p"), ("h2",), ("ul", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",), ())[rng.integers(13)]
        text = _sentence(rng, words, int(rng.integers(1, 9) if tail in (("h2",), ("table", "tr", "td"), ("ul", "li")) or rng.random() < 0.25 else rng.integers(8, 120) if rng.random() < 0.9 else rng.integers(120, 700)))
        blocks.append((inside + tail, text, int(len(text) * 0.2) if rng.random() < 0.15 else 0))
        labels.append(1)
        if rng.random() < 0.06:
            boilerplate(("advert", "sidebar", "notice", "form", "menu")[rng.integers(5)], inside)
        if rng.random() < 0.04:
            blocks.append(((*inside, ("p", "div", "section")[rng.integers(3)], HIDDEN_TOKEN, *(("p",), ())[rng.integers(2)]), _sentence(rng, words, int(rng.integers(2, 60))), 0))
            labels.append(0)
    if rng.random() < 0.15:
        boilerplate("comment", inside)
    for role in ("comment", "sidebar", "form", "advert", "menu", "notice", "footer"):
        if rng.random() < 0.45:
            boilerplate(role, outer, 0.5 if role == "comment" else 0.25)
    return blocks, np.array(labels)


def padded(pages: list[np.ndarray]) -> np.ndarray:
    """(time, batch, inputs); short pages end in zeros."""
    out = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), dtype=np.float32)
    for j, x in enumerate(pages):
        out[: len(x), j] = x
    return out


def block_scores(p: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of each block of each page to be main text; pages of like length together are fastest."""
    x = padded([projected(p, blocks) for blocks in pages])
    ahead, _ = lstm(p, "ahead", x, keep=False)
    # A page's own end comes first in its reversed order.
    sizes = np.array([len(v) for v in pages])
    steps = np.arange(len(x))[:, None]
    turn = np.where(steps < sizes, sizes - 1 - steps, steps)
    back, _ = lstm(p, "behind", np.take_along_axis(x, turn[:, :, None], axis=0), keep=False)
    behind = np.take_along_axis(back, turn[:, :, None], axis=0)
    prob = sigmoid(np.concatenate((ahead, behind, x), axis=2) @ p["out"] + p["out_b"])[:, :, 0]
    return [prob[: len(v), j] for j, v in enumerate(pages)]


@lru_cache(maxsize=1)
def train_labeller(seed: int = 11, pages: int = TRAIN_PAGES, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """Weights of the labeller; the same for the same seed."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("etaoinshrdlucmwfgypbvkéñüß"))
    words = np.array(["".join(letters[rng.integers(0, len(letters), rng.integers(1, 10))]) for _ in range(4000)])
    made = [training_page(rng, words) for _ in range(pages)]
    made.sort(key=lambda m: len(m[0]))
    data = [(inputs(b), y) for b, y in made]
    p = {"project": uniform(rng, INPUTS, PROJECTION) * 2, "out": uniform(rng, 2 * HIDDEN + PROJECTION, 1), "out_b": np.zeros(1)}
    p |= lstm_params(rng, PROJECTION, HIDDEN, "ahead") | lstm_params(rng, PROJECTION, HIDDEN, "behind")
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, 0.02)
    for step in range(steps):
        begin = int(rng.integers(0, len(data) - TRAIN_BATCH))
        part = data[begin : begin + TRAIN_BATCH]
        used = np.unique(np.concatenate([path for (paths, _), _ in part for path in paths]))
        rows = np.concatenate((used, np.arange(PATH_BUCKETS, INPUTS)))
        raw = padded([expanded(*x, used) for x, _ in part])
        sizes = np.array([len(y) for _, y in part])
        index = np.arange(len(raw))[:, None]
        turn = np.where(index < sizes, sizes - 1 - index, index)[:, :, None]
        x = np.tanh(raw @ p["project"][rows])
        ahead, a_saved = lstm(p, "ahead", x)
        flipped = np.take_along_axis(x, turn, axis=0)
        back, b_saved = lstm(p, "behind", flipped)
        both = np.concatenate((ahead, np.take_along_axis(back, turn, axis=0), x), axis=2)
        prob = sigmoid(both @ p["out"] + p["out_b"])[:, :, 0]
        gold = np.zeros_like(prob)
        for j, (_, y) in enumerate(part):
            gold[: len(y), j] = y
        d = np.where(index < sizes, prob - gold, np.float32(0))[:, :, None] / np.float32(sizes.sum())
        grads = {"out": np.tensordot(both, d, axes=((0, 1), (0, 1))), "out_b": d.sum(axis=(0, 1))}
        d_both = d @ p["out"].T
        d_x = lstm_gradient(p, "ahead", x, a_saved, d_both[:, :, :HIDDEN], grads) + d_both[:, :, 2 * HIDDEN :]
        d_flipped = lstm_gradient(p, "behind", flipped, b_saved, np.take_along_axis(d_both[:, :, HIDDEN : 2 * HIDDEN], turn, axis=0), grads)
        d_x += np.take_along_axis(d_flipped, turn, axis=0)
        grads["project"] = np.zeros_like(p["project"])
        grads["project"][rows] = np.tensordot(raw, d_x * (1 - x * x), axes=((0, 1), (0, 1)))
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        adam.step(grads)
    return p


def main_texts(p: dict[str, np.ndarray], htmls: list[str | None]) -> list[str]:
    """The main text of each page."""
    pages = [leaf_blocks(h) for h in htmls]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # Batches of bounded size: long pages go in small company.
        n = max(1, min(64, 8_000 // len(pages[order[min(at + 63, len(order) - 1)]])))
        part = order[at : at + n]
        at += n
        for i, prob in zip(part, block_scores(p, [pages[i] for i in part]), strict=True):
            out[i] = " ".join(text for (_, text, _), q in zip(pages[i], prob, strict=True) if q >= 0.5)
    return out


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each as a column of that name."""
    pages = pages.drop(*(c for c in pages.columns if c.lower() == text.lower() and c != html))
    shared = pages.sparkSession.sparkContext.broadcast(train_labeller())  # some ten thousand numbers
    (copy,) = fresh(pages, "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for at in range(0, batch.num_rows, 128):
                found += main_texts(shared.value, batch.column(batch.num_columns - 1).slice(at, 128).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], text])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"`{text}` string"])
    return pages.withColumn(copy, F.col(f"`{html}`").cast("string")).mapInArrow(run, schema)
