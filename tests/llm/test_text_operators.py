import hashlib
import html as H
import re

import numpy as np
import pytest
from conftest import SF

from tessella.llm import bilstm, chat, decontam, html_extract, pii, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def test_decontamination_like_brute_force(spark):
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(r.item_id)
    got = {r.doc_id: r for r in queries.op10_decontamination(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = WORD.findall(lower(r.text))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        g = got[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(items), digest, bool(hit))


def test_spans_and_blocks(spark):
    item = "One two, THREE four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"é start {item.lower()}! end"), (2, "one two three"), (3, "short item here"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "SHORT item"), (9, ""), (10, None), (None, "x")], "item_id long, text string")
    for limit in (1 << 20, 4):
        got = {r.doc_id: r for r in decontam.decontaminate(docs, bench, automaton_words=limit).collect()}
        assert got[1].spans[0].start == 8
        assert got[1].n_hit == 11
        assert got[1]["items"] == [7]
        assert (got[2].n_hit, got[3].n_hit, got[3]["items"], got[4].n_words) == (0, 2, [8], 0)


def test_tables_beyond_one_automaton(spark, awkward):
    """Several automata give what one gives, and columns of any name stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").selectExpr("*", "'x' as __all", "'y' as __copy", "'z' as __row")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = sum(len(decontam.normal_words(r.text)) for r in bench.collect())
    one, many = (decontam.decontaminate(docs, bench, automaton_words=n).collect() for n in (10 * words, words // 3))
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.stop) for s in r.spans), r["__all"], r["__copy"], r["__row"])
    assert sorted(map(key, one)) == sorted(map(key, many))
    assert any(r.n_hit for r in one)
    assert len(decontam.decontaminate(awkward, bench, automaton_words=words // 3).collect()) == 12


def test_awkward_decontamination(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "many other animals")], "item_id long, text string")
    got = decontam.decontaminate(awkward, bench).toPandas()
    assert got[got.n_hit > 0].doc_id.tolist() == [4, 4, 5]
    assert decontam.decontaminate(awkward, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a<|turn|>b\\"),
        (1, 0, "user", "a<|turn|>b\\"),
        (1, 1, "assistant", "<|end|>\n<|x <s>[INST]\\\\<|"),
        (1, 2, "assistant", "\\|<\\|next|> <</SYS>> <end_of_turn>"),
        (1, 3, None, None),
        (1, 4, "assistant", ""),
        (2, None, "a<|text|>\n", "x"),
        (None, 1, "user", "hé<|"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as formatted")
    out = {r.conv_id: r for r in chat.format_chats(df).selectExpr("*").withColumn("back", chat.read_back(__import__("pyspark.sql.functions", fromlist=["col"]).col("formatted"))).collect()}
    for key, r in out.items():
        assert [tuple(t) for t in r.back] == [(x[2] or "", x[3] or "") for x in rows if x[0] == key]
    assert out[1].formatted.count("<|turn|>") == 4
    assert "[INST]" not in out[1].formatted
    assert "</s>" not in out[1].formatted
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op4_chat_formatting(spark, SF).collect()}
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, turns in convs.items():
        said = "".join(t for role, t in turns if role == "assistant")
        g = got[key]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))


def test_gradients():
    rng = np.random.default_rng(0)
    p = bilstm.lstm_params(rng, 3, 4, "f") | {"out": bilstm.uniform(rng, 4, 3), "moves": rng.normal(0, 0.3, (3, 3))}
    x, tags = rng.normal(0, 1, (5, 2, 3)), rng.integers(0, 3, (5, 2))

    def loss():
        h, saved = bilstm.lstm(p, "f", x)
        value, d_scores, d_moves = bilstm.crf_loss(h @ p["out"], p["moves"], tags)
        return value, h, saved, d_scores, d_moves

    _, h, saved, d_scores, d_moves = loss()
    grads = {"moves": d_moves, "out": np.tensordot(h, d_scores, axes=((0, 1), (0, 1)))}
    bilstm.lstm_gradient(p, "f", x, saved, d_scores @ p["out"].T, grads)
    for name, value in p.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 7)]:
            value[at] += 1e-5
            up = loss()[0]
            value[at] -= 2e-5
            down = loss()[0]
            value[at] += 1e-5
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(2)
    scores, moves = rng.normal(0, 1, (5, 1, 3)), rng.normal(0, 1, (3, 3))
    total = lambda path: sum(scores[i, 0, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
    assert tuple(bilstm.viterbi(scores, moves)[:, 0]) == max(product(range(3), repeat=5), key=total)


def test_base_patterns():
    def found(text):
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]

    text = "a.b+c@mail1.example.com, 1.2.3.400 10.0.0.1, 4111 1111 1111 1111, 4111111111111112, +1 (523) 555-1055 +12"
    assert found(text) == [("email", "a.b+c@mail1.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (523) 555-1055")]
    # One match takes both numbers and the digit before them, fails, and is not tried again.
    assert found("1 4111 1111 1111 1111 4111111111111112") == []


def test_tagger_on_unseen_text():
    p = pii.train_tagger()
    codes, tags = pii.training_batch(np.random.default_rng(123), 200, 128)
    found = pii.viterbi(pii.tag_scores(p, codes), p["moves"])
    assert (found == tags).mean() > 0.94
    for text, kind, piece in (("call (523) 555-1055 now", 3, "(523) 555-1055"), ("mail john.doe [at] example [dot] com today", 0, "john.doe [at] example [dot] com")):
        (raw,) = pii.decode(p, [text])
        assert [(k, text[a:b]) for k, a, b in pii.accepted(text, raw, pii.base_spans(text))] == [(kind, piece)]
    clean = "on 2024-01-02 they paid 12,345.67 for version 1.2.3 of it"
    assert pii.accepted(clean, pii.decode(p, [clean])[0], []) == []


def test_spans_of_unseen_text():
    p = pii.train_tagger()
    rng = np.random.default_rng(31)
    right = wrong = missed = 0
    for _ in range(40):
        text, marks = "", set()
        while len(text) < 1500:
            if rng.random() < 0.15:
                piece, kind = pii.labelled_example(rng)
                if kind is not None:
                    marks.add((kind, len(text), len(text) + len(piece)))
                text += f"{piece} "
            else:
                text += pii._word(rng) + (" ", ". ", ", ", "\n")[rng.integers(4)]
        base = pii.base_spans(text)
        got = {*base, *pii.accepted(text, pii.decode(p, [text])[0], base)}
        right, wrong, missed = right + len(got & marks), wrong + len(got - marks), missed + len(marks - got)
    assert right / (right + wrong) > 0.95
    assert right / (right + missed) > 0.9


def test_case_and_words_beside_a_trigger():
    p = pii.train_tagger()
    text = "write to john [AT] example.com today"
    assert [(k, text[a:b]) for k, a, b in pii.accepted(text, pii.decode(p, [text])[0], [])] == [(0, "john [AT] example.com")]
    far = "y" * 300
    starts = pii.window_starts(f"{'x ' * 500}{far} (at) host.org {'x ' * 500}")
    assert starts[0] <= 1000 <= starts[0] + pii.WINDOW
    assert all(b - a == pii.STRIDE for a, b in zip(starts, starts[1:], strict=False))
    assert pii.window_starts("no such thing " * 50) == []


def test_personal_data_query_like_brute_force(spark):
    def kinds(text):
        found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
                found.append(("card", m.span()))
        found += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return [f"{k}:{a}:{b}" for k, (a, b) in found]

    got = {r.doc_id: r for r in queries.op8_personal_data(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base, g = kinds(r.text or ""), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
        spans = [x.split(":") for x in g.spans.split(",") if x]
        assert set(base) <= {":".join(x) for x in spans}
        order = sorted((int(a), int(b)) for _, a, b in spans)
        assert all(0 <= a < b <= len(r.text or "") for a, b in order)


def test_personal_data_of_whole_texts(spark, awkward, empty):
    text = "x " * 40_000 + "me@example.com"
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.stop) for s in got.spans] == [("email", 80_000, len(text))]
    assert pii.find_personal_data(awkward).where("size(base_spans) > 0").count() == 0
    assert pii.find_personal_data(awkward).count() == 12
    assert pii.find_personal_data(empty).count() == 0


def test_labeller_on_unseen_pages():
    p = html_extract.train_labeller()
    rng = np.random.default_rng(99)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(500)])
    pages = [html_extract.training_page(rng, words) for _ in range(100)]
    scores = html_extract.block_scores(p, [b for b, _ in pages])
    assert np.mean([((s >= 0.5) == y).mean() for s, (_, y) in zip(scores, pages, strict=True)]) > 0.98


def test_pages(spark):
    def article(html):
        m = re.search(r"<article>(.*?)</article>", html, re.DOTALL)
        parts = (" ".join(H.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|article)[^>]*>", m[1]))
        return " ".join(x for x in parts if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, SF).collect():
        assert r.text == article(pages[r.page_id])
        assert r.n_chars == len(r.text)


def test_first_layer_reads_all_words():
    p = {"project": np.random.default_rng(1).normal(0, 1, (html_extract.INPUTS, 5)).astype(np.float32)}
    blocks = [(("html", "div", ".post"), " ".join(f"word{i}" for i in range(300)) + ".", 0), ((), "x, y", 2), (("html", "html"), "z", 0)]
    assert np.allclose(html_extract.projected(p, blocks), np.tanh(html_extract.vectors(blocks) @ p["project"]), atol=1e-4)
    other = [(blocks[0][0], blocks[0][1].replace("word299", "else"), 0)]
    assert not np.array_equal(html_extract.vectors(blocks[:1])[:, :-1], html_extract.vectors(other)[:, :-1])


def test_a_very_long_page(spark):
    n = 120_000
    page = "<nav><ul><li><a href=x>menu</a></li></ul></nav><article>" + "".join(f"<p>Sentence number {i}, with some more words.</p>" for i in range(n)) + "</article><footer>end</footer>"
    got = html_extract.extract_main_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text
    assert got.count("Sentence number") == n


def test_other_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>cut off <b"), (4, "<nav>menu</nav><main><h1>Title</h1><p>A &amp; B<br>more&nbsp;text here, and so on.</p><form><label>Mail</label></form></main><section id=comments><div class=comment><p>Nice one, thank you very much.</p></div></section><aside>Related</aside><footer>end</footer>"), (4, "<script>x('</p>')</script><style>p{}</style>")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' as text", "'y' as __html")
    got = [r.text for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == ""
    assert "Title A & B more text here, and so on." in got
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
