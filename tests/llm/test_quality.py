import numpy as np
import pyarrow as pa
from conftest import SF

from tessella.llm import quality_classifier, quality_rules, queries, wordhash


def test_rules_reject_bad_labels_and_keep_good_ones(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    ok = got[~got.base_failed]
    assert ok[ok.quality == 1].kept.mean() > 0.99
    assert ok[ok.quality == 0].kept.mean() < 0.15
    assert not got[got.base_failed].kept.any()


def test_good_texts_score_alike_whether_trusted_or_not(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = quality_rules.trusted_labels(labels)
    half = good.where("crc32(string(doc_id)) % 2 = 0")
    got = quality_rules.quality_rules(docs.select("doc_id", "text"), half).where("not base_failed").drop("text")
    marked = got.join(labels, "doc_id").join(half.selectExpr("doc_id", "true as seen"), "doc_id", "left").toPandas()
    seen, unseen = (marked[(marked.quality == 1) & (marked.toxic.fillna(0) == 0) & (marked.seen.eq(True) == x)] for x in (True, False))
    assert abs(seen.llr.mean() - unseen.llr.mean()) < 0.02
    assert unseen.kept.mean() > 0.99
    assert marked[marked.quality == 0].kept.mean() < 0.1


def test_rules_query_like_brute_force(spark):
    """The statistics in plain Python, and the verdict from plain counts over hashed n-grams."""
    import re

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    grams, raw, trusted = {}, {}, {}
    for b in wordhash.blocks(pa.array(list(docs.values()))):
        buckets, owners = quality_rules.features(b)
        ids = list(docs)[b.rows]
        for k, o in zip(buckets.tolist(), owners.tolist(), strict=True):
            own = grams.setdefault(ids[o], {})
            own[k] = own.get(k, 0) + 1
    for d, own in grams.items():
        for k, n in own.items():
            raw[k] = raw.get(k, 0) + n
            if d in good:
                trusted[k] = trusted.get(k, 0) + n
    share = sum(trusted.values()) / sum(raw.values())
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, SF).collect()}
    for d, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, hit = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit.update(j for i in at for j in range(i, i + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = grams.get(d, {})
        mine = own if d in good else {}
        total = sum(n * (np.log(trusted.get(k, 0) - mine.get(k, 0) + 10 * share) - np.log(share * (raw[k] - n + 10))) for k, n in own.items())
        llr = total / max(sum(own.values()), 1)
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        g = got[d]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(lines) - len(set(lines)), len(hit), failed)
        assert np.isclose(g.llr, llr)
        assert g.kept == (not failed and llr >= quality_rules.THRESHOLD)


def test_scores_are_plain_dot_products(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    weights = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.score for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        (b,) = wordhash.blocks(pa.array([text]))
        words = b.words().tolist()
        pairs, _ = wordhash.windows(b.words(), b.word_offsets, 2)
        grams = words + pairs.tolist()
        for back in range(1, quality_classifier.BACK + 1):
            grams += [int(wordhash.mix(np.array([back], dtype=np.uint64))[0])] * sum(words[i] == words[i - back] for i in range(back, len(words)))
        dot = sum(float(np.float32(weights[g >> 20 & quality_classifier.BUCKETS - 1])) for g in grams) / max(len(grams), 1) ** 0.5 + weights[quality_classifier.BIAS]
        assert np.isclose(got[d], 1 / (1 + np.exp(-dot)), atol=1e-4)


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    marked, mark = quality_rules.mark_trusted(docs, docs.where("doc_id = 1").select("doc_id"))
    counts = quality_rules.count_ngrams(marked, "text", mark).toPandas()
    assert sorted(counts.raw.tolist()) == [1, 1, 1, 1, 2]
    assert counts.trusted.sum() == 5
    t = quality_rules.totals(quality_rules.count_ngrams(marked, "text", mark))
    (own, seen), (own_trusted, _) = quality_rules.mean_ratios(np.array([5, 5, 6]), np.array([0, 0, 1]), 2, np.array([[0, 3], [4, 6]]).repeat([5, quality_rules.BUCKETS - 5], axis=1))
    assert t.sum(axis=1).tolist() == [5, 6]
    share = 3 * (quality_rules.BUCKETS - 5) / (4 * 5 + 6 * (quality_rules.BUCKETS - 5))
    assert np.isclose(own, np.log((3 + 10 * share) / (share * (6 - 2 + 10))))
    assert np.isclose(seen, np.log((3 + 10 * share) / (share * (6 - 1 + 10))))
    assert np.isclose(own_trusted, np.log((3 - 2 + 10 * share) / (share * (6 - 2 + 10))))


def test_awkward_rules(spark, awkward, empty):
    ids = spark.createDataFrame([(4,), (None,), (8,)], "doc_id long")
    got = quality_rules.quality_rules(awkward, ids).toPandas()
    assert len(got) == 12
    assert got[got.doc_id == 1].n_words.tolist() == [0]
    assert not got[got.doc_id.isin([1, 2, 3, 6])].kept.any()
    assert quality_rules.quality_rules(awkward, ids.limit(0)).where("not base_failed and not kept").count() == 0
    assert quality_rules.quality_rules(empty, ids).count() == 0


def test_leader_learns_a_rule():
    rng = np.random.default_rng(0)
    rows = [(float(y), np.array([10 + y, 20 + int(rng.integers(5)), quality_classifier.BIAS]), np.ones(3)) for y in rng.integers(0, 2, 400)]
    w = quality_classifier.follow_the_regularised_leader(rows)
    assert w[11] > 0.5
    assert w[10] < -0.5
    assert np.abs(w[20:25]).max() < 0.5


def test_held_out_ranking(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((got.score >= 0.7) == got.predicted).all()


def test_awkward_classifier(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = quality_classifier.classify(awkward, labels).toPandas()
    assert len(got) == 12
    assert got.score.between(0, 1).all()
    assert (quality_classifier.classify(awkward, labels.limit(0)).toPandas().score == 0.5).all()
    assert quality_classifier.classify(empty, labels).count() == 0
