"""Language identification and toxicity: gradients, held-out accuracy, edge cases."""

import numpy as np
from conftest import DATA

from deskbook.llm import common, langid, toxicity


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b"], rng)
    for f in ("table_zr", "table_n", "u_zr", "u_n", "out", "bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    ids, y = rng.integers(97, 105, (3, 6)), np.array([0, 1, 1])
    ids[0, 4:] = langid.PAD
    _, grads = net.gradients(ids, y)
    for w, g in zip(net.weights(), grads):
        flat = np.argsort(-np.abs(g).ravel())[:4]
        for at in flat:
            spot, eps = np.unravel_index(at, w.shape), 1e-3
            old = w[spot]
            w[spot] = old + eps
            up, _ = net.gradients(ids, y)
            w[spot] = old - eps
            down, _ = net.gradients(ids, y)
            w[spot] = old
            assert abs((up - down) / (2 * eps) - g[spot]) < 2e-3 * max(1, abs(g[spot]))


def test_languages_held_out(spark):
    docs = common.table(spark, DATA, "documents")
    net = langid.train(*langid.labelled_windows(docs))
    truth = {r.doc_id: r for r in docs.withColumn("out", common.crc_held_out()).collect()}
    rows = {r.doc_id: r for r in langid.op3_language_id(spark, DATA).collect()}
    assert len(rows) == len(truth)
    for i, r in rows.items():  # against the mean over each text's own positions
        text = truth[i].text or ""
        assert r.held_out == truth[i].out and (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        if r.lang_pred != "und":
            raw, total = np.frombuffer(text.encode(), np.uint8), np.zeros(len(net.languages))
            for at in range(0, len(raw), langid.WINDOW):
                total += net.probabilities(raw[None, at : at + langid.WINDOW].astype(np.int64)).sum(axis=(0, 1))
            assert net.languages[int(total.argmax())] == r.lang_pred and abs(total.max() / len(raw) - r.score) < 1e-4
    judged = [r for i, r in rows.items() if r.held_out and r.lang_pred != "und" and truth[i].lang]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in judged) >= 0.95 * len(judged) > 0
    big = (1 << 53) + 1
    cases = [(1, None, 0.0), (2, "", 0.0), (3, "12 !? ½ ² ① Ⅷ", 0.0), (big, "the and " * 30000, 0.0), (big, "the and " * 30000, 0.0), (None, "the and", 0.0)]
    odd = spark.createDataFrame(cases, "doc_id long, text string, score double")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(odd, net).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (big, "en"), (big, "en"), (None, "en")], key=str)
    assert langid.identify(odd.limit(0), net).count() == 0
    assert langid.train([], []) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_sample_takes_rows_by_hash(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'a', if(id < 50, 'c', 'b')) as k", "xxhash64(id) as h")
    got, all_rows = langid.about(df, "k", "h", 500).collect(), df.collect()
    for k, least, most in (("a", 500, 700), ("b", 500, 700), ("c", 33, 33)):
        own = sorted(r.h % (1 << 64) for r in got if r.k == k)
        assert least <= len(own) <= most and own == sorted(r.h % (1 << 64) for r in all_rows if r.k == k)[: len(own)]


def test_toxicity_finds_sentences(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeilmnorstu"), 7)) for _ in range(300)]
    say = lambda: " ".join(rng.choice(words, 8)) + "."
    texts, labels = [], []
    for i in range(300):
        sentences = [say() for _ in range(6)]
        if i % 3 == 0:
            sentences[int(rng.integers(6))] = f"you {rng.choice(['grumblo', 'grumbling', 'nastyword'])} thing."
        texts.append(" ".join(sentences))
        labels.append(int(i % 3 == 0))
    sample = lambda texts, labels: spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, toxic int, text string")
    model = toxicity.fit(sample(texts[:200], labels[:200]))
    score = model.scorer()
    assert all((score(t)[0] >= toxicity.THRESHOLD) == bool(y) for t, y in zip(texts[200:], labels[200:]))
    hit = texts[201]
    (span,) = score(hit)[1]
    assert any(w in hit[span[0] : span[1]] for w in ("grumbl", "nastyword"))
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (big, hit, 5), (big, hit, 5), (4, say() * 100_000, 5), (None, "x", 5)], "doc_id long, text string, offending int")
    got = [(r.doc_id, r.toxic_score >= toxicity.THRESHOLD) for r in toxicity.score_documents(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (big, True), (big, True), (4, False), (None, False)], key=str)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.fit(sample([], [])).weights == {} and toxicity.fit(sample(["a"], [1])).scorer()("a")[0] < toxicity.THRESHOLD


def test_toxicity_is_learnt_and_held_out(spark):
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    sample = {r.doc_id: r.toxic for r in toxicity.labelled_sample(docs, labels).collect()}
    own = {r.doc_id: r.toxic for r in labels.where(~common.crc_held_out()).where("toxic is not null").collect()}
    assert sample == own and len({r.toxic for r in labels.collect()}) == 2
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, DATA).collect()}
    texts = {r.doc_id: r for r in docs.withColumn("out", common.crc_held_out()).collect()}
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    score = model.scorer()
    for i, r in rows.items():  # against a plain noisy-or over the document's distinct sets of weighted words
        sets = {frozenset(toxicity.document_features(t) & model.weights.keys()) for t in toxicity.SENTENCE.findall(texts[i].text or "")} - {frozenset()}
        want = 1 - (1 - model.leak) * np.prod([1 - 1 / (1 + np.exp(-toxicity.BIAS - sum(model.weights[f] for f in s))) for s in sets])
        assert abs(r.score - want) < 1e-9 and abs(score(texts[i].text or "")[0] - want) < 1e-9
        assert r.held_out == texts[i].out and r.predicted == int(r.score >= 0.7)
    assert len(rows) == len(texts)


def test_texts_that_share_common_words_all_stay(spark):
    words = sorted((a + b + c for a in "abcdefgh" for b in "aeiou" for c in "klmnrst"), key=lambda w: toxicity.zlib.crc32(f"={w}".encode()))
    texts = [" ".join(words[:3] + words[at : at + 40]) for at in (3, 43, 83, 123)]
    texts += [texts[0] + " " + words[43], texts[1], "", ""]  # near copy, copy, and two without features
    kept = lambda rows: sorted(r.doc_id for r in toxicity.distinct_bags(toxicity.bags_of(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))).collect())
    assert kept([(i, 0, t) for i, t in enumerate(texts)]) == [0, 1, 2, 3, 6]
    assert kept([(0, 0, texts[0]), (1, 1, texts[0])]) == [0, 1]
