"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

The tagger is trained in numpy on generated text with labelled spans. A text is
read in overlapping windows. Windows that overlap are reconciled as one stretch:
a character's scores are the mean of those that its windows give, weighted by
how far it lies from a window's ends, and one Viterbi path runs over the whole
stretch. A span that the tagger
finds counts if it does not overlap another one and passes the checks of its
kind, all of which ask for a trigger: a digit, an at sign, or a spelt-out "at"
or "dot", in any case. So only windows are decoded that touch a trigger, the
word it stands in or the words beside that.

Edge cases: null and empty texts have no spans; long texts are read whole;
repeated rows are answered alike. Other columns pass through; one with the name
of an added column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Adam, crf_loss, lstm, lstm_gradient, lstm_params, uniform, viterbi
from .common import fresh

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE = 128, 64
#: One of these is in every string that the shapes below accept.
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]|\bdot\b", re.IGNORECASE)
WORD = re.compile(r"\S+")
#: Of a character in a window: most in the middle.
WEIGHTS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
DECODE_BATCH = 256

Span = tuple[int, int, int]  # kind, start, end


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])) % 10 == 0


def good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def good_card(s: str) -> bool:
    d = digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def good_phone(s: str) -> bool:
    return 9 <= len(digits(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, pattern, good in ((1, IP, good_ip), (2, CARD, good_card), (3, PHONE, good_phone)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m[0])]
    return out


DIGIT = re.compile("[0-9]")

# The tagger. Tags: 0 outside; 1 + 2 * kind begins a span, 2 + 2 * kind goes on.
TAGS = 1 + 2 * len(KINDS)
#: Characters: ASCII as they are, then other letters, other white space, the rest, and what lies beyond a text.
VOCABULARY = 132
EMBEDDING, HIDDEN = 12, 20
TRAIN_STEPS, TRAIN_BATCH, TRAIN_LENGTH = 260, 48, 96


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.minimum(points, 128).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        c = chr(points[i])
        codes[i] = 128 if c.isalpha() else 129 if c.isspace() else 130
    return codes


def _word(rng: np.random.Generator) -> str:
    letters = "etaoinshrdlucmwfgypbvkéèñüöß"
    return "".join(rng.choice(list(letters), rng.integers(1, 9)))


def _card_number(rng: np.random.Generator, valid: bool) -> str:
    d = "".join(map(str, rng.integers(0, 10, rng.choice([14, 15, 15, 15, 16, 18]))))
    last = next(x for x in "0123456789" if luhn(d + x))
    return d + (last if valid else str((int(last) + int(rng.integers(1, 10))) % 10))


def labelled_example(rng: np.random.Generator) -> tuple[str, int | None]:
    """A piece of text and its kind; None for what only looks like personal data."""
    n = lambda a, b: "".join(map(str, rng.integers(0, 10, rng.integers(a, b + 1))))
    word = lambda: _word(rng).encode("ascii", "ignore").decode() or "x"
    pick = lambda *x: x[rng.integers(len(x))]
    what = rng.integers(0, 12)
    if what <= 2:
        user = word() + pick("", ".", "_", "-", "+") + pick("", word(), n(1, 3))
        host, top = word() + pick("", n(1, 2)), pick("com", "org", "net", "de", "fr", "es", "co.uk", "example.com")
        at = pick("@", "@", "@", " @ ", " [at] ", " (at) ", "[at]", " {at} ")
        dot = pick(".", ".", ".", " [dot] ", " (dot) ", " dot ") if "at" in at or at == " @ " else "."
        address = user + at + host + dot + top
        return address.upper() if rng.random() < 0.12 else address, 0
    if what == 3:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4)), 1
    if what <= 5:
        d = _card_number(rng, True)
        sep = pick("", "", " ", "-", ".", "/")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), 2
    if what <= 7:
        a, b, c = n(3, 3), n(3, 3), n(4, 4)
        return pick(f"+{n(1, 2)} ({a}) {b}-{c}", f"+{n(1, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{n(2, 2)} {a} {b} {c}", f"+{n(1, 2)}-{a}-{b}-{c}"), 3
    if what == 8:
        return pick(n(1, 6), n(1, 2) + "." + n(1, 2), f"{n(4, 4)}-{n(2, 2)}-{n(2, 2)}", f"{n(1, 3)}%", f"v{n(1, 1)}.{n(1, 2)}.{n(1, 2)}", f"{n(2, 2)}:{n(2, 2)}", f"{n(1, 3)},{n(3, 3)}.{n(2, 2)}"), None
    if what == 9:
        return pick("AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)), 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 24)) + '"', n(20, 30), n(7, 12), f"{n(3, 3)}.{n(3, 3)}.{n(3, 3)}.{n(3, 3)}".replace("0", "9")), None
    if what == 10:
        return pick("@" + word(), word() + "@", f"{word()} at {word()}", f"{word()} dot {word()}", "(at)", f"{n(1, 3)}@{n(1, 2)}"), None
    return _card_number(rng, False), None


def training_batch(rng: np.random.Generator, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = np.full((length, size), 131), np.zeros((length, size), dtype=np.int64)
    for j in range(size):
        text, marks = "", []
        while len(text) < length + 40:
            if rng.random() < 0.25:
                piece, kind = labelled_example(rng)
                if kind is not None:
                    marks.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                w = _word(rng)
                text += w if rng.random() < 0.6 else w.capitalize() if rng.random() < 0.5 else w.upper()
            text += ("", ". ", ", ", "\n", "*** ", "!! ", " | ")[rng.integers(1, 7)] if rng.random() < 0.25 else " "
        begin = int(rng.integers(0, 40))
        seen = encode(text)[begin : begin + length]
        codes[: len(seen), j] = seen
        for kind, a, b in marks:
            a, b = max(a - begin, 0), min(b - begin, length)
            if a < b:
                tags[a:b, j] = 2 + 2 * kind
                tags[a, j] = 1 + 2 * kind
    return codes, tags


def tag_scores(p: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    x = p["embedding"][codes]
    ahead, _ = lstm(p, "ahead", x, keep=False)
    behind, _ = lstm(p, "behind", x, reverse=True, keep=False)
    return np.concatenate((ahead, behind), axis=2) @ p["out"] + p["out_b"]


@lru_cache(maxsize=1)
def train_tagger(seed: int = 7, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """Weights of the tagger; the same for the same seed."""
    rng = np.random.default_rng(seed)
    p = {"embedding": rng.normal(0, 0.3, (VOCABULARY, EMBEDDING)), "out": uniform(rng, 2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
    p |= lstm_params(rng, EMBEDDING, HIDDEN, "ahead") | lstm_params(rng, EMBEDDING, HIDDEN, "behind")
    adam = Adam(p, 0.02)
    for step in range(steps):
        codes, tags = training_batch(rng, TRAIN_BATCH, TRAIN_LENGTH)
        x = p["embedding"][codes]
        ahead, a_saved = lstm(p, "ahead", x)
        behind, b_saved = lstm(p, "behind", x, reverse=True)
        both = np.concatenate((ahead, behind), axis=2)
        _, d_scores, d_moves = crf_loss(both @ p["out"] + p["out_b"], p["moves"], tags)
        grads = {"moves": d_moves, "out": np.tensordot(both, d_scores, axes=((0, 1), (0, 1))), "out_b": d_scores.sum(axis=(0, 1))}
        d_both = d_scores @ p["out"].T
        d_x = lstm_gradient(p, "ahead", x, a_saved, d_both[:, :, :HIDDEN], grads) + lstm_gradient(p, "behind", x, b_saved, d_both[:, :, HIDDEN:], grads)
        grads["embedding"] = np.zeros_like(p["embedding"])
        np.add.at(grads["embedding"], codes, d_x)
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        adam.step(grads)
    return {k: v.astype(np.float32) for k, v in p.items()}


def window_starts(text: str) -> list[int]:
    """Of the windows to decode; windows lie on a grid from the text's start, and the last one begins inside the text."""
    triggers = [(m.start(), m.end()) for m in TRIGGER.finditer(text)]
    if not triggers:
        return []
    words = np.array([m.span() for m in WORD.finditer(text)])
    first, last = np.array(triggers).T
    lo = words[np.maximum(np.searchsorted(words[:, 0], first, side="right") - 2, 0), 0]
    hi = words[np.minimum(np.searchsorted(words[:, 1], last) + 1, len(words) - 1), 1]
    begin, end = np.maximum(-(-(lo - WINDOW + 1) // STRIDE), 0), (hi - 1) // STRIDE
    edges = np.zeros(len(text) // STRIDE + 2, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end + 1, -1)
    return (np.flatnonzero(np.cumsum(edges)) * STRIDE).tolist()


def decode(p: dict[str, np.ndarray], texts: list[str]) -> list[list[Span]]:
    """Raw spans of each text: scores of its windows, joined into stretches, and the best path of each stretch."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    stretches: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # text, start, weighted scores, weights
    for i, s in jobs:
        stop = min(s + WINDOW, len(texts[i]))
        if stretches and stretches[-1][0] == i and s < stretches[-1][1] + len(stretches[-1][3]):
            _, start, _, weights = stretches.pop()
            stretches.append((i, start, None, np.zeros(max(stop - start, len(weights)), np.float32)))
        else:
            stretches.append((i, s, None, np.zeros(stop - s, np.float32)))
    stretches = [(i, start, np.zeros((len(w), TAGS), np.float32), w) for i, start, _, w in stretches]
    of = iter(stretches)
    now = next(of, None)
    for at in range(0, len(jobs), DECODE_BATCH):
        part = jobs[at : at + DECODE_BATCH]
        codes = np.full((WINDOW, len(part)), 131)
        for j, (i, s) in enumerate(part):
            seen = encode(texts[i][s : s + WINDOW])
            codes[: len(seen), j] = seen
        scores = tag_scores(p, codes)
        for j, (i, s) in enumerate(part):
            while now[0] != i or s >= now[1] + len(now[3]):
                now = next(of)
            n = min(WINDOW, len(texts[i]) - s)
            now[2][s - now[1] : s - now[1] + n] += scores[:n, j] * WEIGHTS[:n, None]
            now[3][s - now[1] : s - now[1] + n] += WEIGHTS[:n]
    out: list[list[Span]] = [[] for _ in texts]
    # Stretches of like length together; what lies behind a shorter one's end is outside of every span.
    order = sorted(range(len(stretches)), key=lambda k: len(stretches[k][3]))
    while order:
        longest = len(stretches[order[min(DECODE_BATCH, len(order)) - 1]][3])
        n = max(1, min(DECODE_BATCH, DECODE_BATCH * 8 * WINDOW // longest))
        part, order = order[:n], order[n:]
        scores = np.full((len(stretches[part[-1]][3]), len(part), TAGS), -1e4, dtype=np.float32)
        scores[:, :, 0] = 0
        for j, k in enumerate(part):
            scores[: len(stretches[k][3]), j] = stretches[k][2] / stretches[k][3][:, None]
        found = viterbi(scores, p["moves"])
        for j, k in enumerate(part):
            i, start, _, weights = stretches[k]
            run: list[int] | None = None
            runs = []
            for t in np.flatnonzero(found[: len(weights), j]).tolist():
                kind, begins = divmod(int(found[t, j]) - 1, 2)
                if run and run[2] == start + t and run[0] == kind and begins:
                    run[2] += 1
                else:
                    run = [kind, start + t, start + t + 1]
                    runs.append(run)
            out[i] += [tuple(r) for r in runs]
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


#: What a span of the tagger must look like as a whole.
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+\s?(@|[\[({<]\s?at\s?[\])}>])\s?[A-Za-z0-9-]+(\s?(\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s)\s?[A-Za-z0-9-]+)+", re.IGNORECASE),
    re.compile(r"[0-9]{1,3}([.\s\[\](){}]{1,3}[0-9]{1,3}){3}"),
    re.compile(r"[0-9]([ ./-]?[0-9])+"),
    re.compile(r"(\+|00)?\(?[0-9]{1,4}\)?([ .-]\(?[0-9]{2,5}\)?){2,5}"),
)


def accepted(text: str, raw: list[Span], base: list[Span]) -> list[Span]:
    """Spans of the tagger that stand: trimmed, well formed, and clear of every other span."""
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, a, b in raw:
        while a < b and text[a] in " \t\n.,;:*!|'\"":
            a += 1
        while a < b and text[b - 1] in " \t\n.,;:*!|'\"":
            b -= 1
        piece = text[a:b]
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if not whole or not _SHAPES[kind].fullmatch(piece) or any(x < b and a < y for x, y in taken):
            continue
        if kind == 1 and not all(int(x) <= 255 for x in re.findall(r"[0-9]+", piece)) or kind == 2 and not good_card(piece) or kind == 3 and not good_phone(piece):
            continue
        taken.append((a, b))
        out.append((kind, a, b))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SPAN = "array<struct<kind:string,start:bigint,stop:bigint>>"


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans, and spans, which holds these and the tagger's; sorted by kind, then start."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("base_spans", "spans") and c != text))
    shared = docs.sparkSession.sparkContext.broadcast(train_tagger())  # a few thousand numbers
    (copy,) = fresh(docs, "__text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            bases: list[list[Span]] = []
            more: dict[int, list[Span]] = {}
            waiting: list[tuple[int, str]] = []

            def flush():
                for (i, value), raw in zip(waiting, decode(tagger, [v for _, v in waiting]), strict=True):  # noqa: B023
                    more[i] = accepted(value, raw, bases[i])  # noqa: B023
                waiting.clear()  # noqa: B023

            for i, scalar in enumerate(batch.column(batch.num_columns - 1)):
                value = scalar.as_py() or ""
                bases.append(base_spans(value))
                if TRIGGER.search(value):
                    waiting.append((i, value))
                    if len(waiting) >= 64:
                        flush()
            flush()
            rows = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in sorted(spans)]
            added = [pa.array([rows(s) for s in bases], kind), pa.array([rows([*s, *more.get(i, [])]) for i, s in enumerate(bases)], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "base_spans", "spans"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"base_spans {SPAN}, spans {SPAN}"])
    return docs.withColumn(copy, F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
