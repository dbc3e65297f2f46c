"""Trained operators: held-out accuracy on planted rules, and defined results in special cases."""

from collections import Counter

import numpy as np
from conftest_llm import WORDS, prose

from catalogmatch.llm import lm, quality, toxicity
from catalogmatch.llm.common import clean_labels, is_held_out, labelled_sample, word_hashes, written
from pyspark.sql import functions as F


def planted(spark, spoil):
    rows = [(k, spoil(prose(k, 30 + k % 50)) if k % 3 == 0 else prose(k, 30 + k % 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0)) for k in range(400)], "doc_id long, toxic int, quality int")
    return docs, labels


def accuracy(scores, labels, label, threshold):
    rows = scores.join(labels, "doc_id").where(is_held_out(F.col("doc_id"))).select("score", label).collect()
    assert len(rows) > 40
    return np.mean([(r.score >= threshold) == bool(r[label]) for r in rows])


def special_cases(model, odd, none):
    rows = model.score(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (101, 102)}
    twins = [r.score for r in rows if r.doc_id == 107]
    assert len(empty) == 1 and len(twins) == 2 and twins[0] == twins[1]
    assert model.score(none).count() == 0


def test_toxicity(spark, odd, none):
    docs, labels = planted(spark, lambda t: t.replace(" ", " vile brute ", 1))
    model = toxicity.fit_toxicity(docs, labels)
    assert accuracy(model.score(docs), labels, "toxic", 0.5) > 0.97
    special_cases(model, odd, none)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.fit_toxicity(docs, few).score(docs.limit(3)).collect()} == {0.0}


def test_toxicity_equals_a_plain_fit(spark):
    docs, labels = planted(spark, lambda t: t.replace(" ", " vile brute ", 1))
    model = toxicity.fit_toxicity(docs, labels, ridge=1e-3)
    known = {r.doc_id: r.toxic for r in labels.where(~is_held_out(F.col("doc_id"))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = np.array([known[k] for k in sorted(known)])
    grams = [set(toxicity.gram_buckets(texts[k]).tolist()) for k in sorted(known)]
    every = sorted(set().union(*grams))
    held = np.array([[g in x for g in every] for x in grams], float)
    pos, neg = held[y == 1].sum(axis=0), held[y == 0].sum(axis=0)
    ratio = np.log((pos + 1) / ((y == 1).sum() + 2)) - np.log((neg + 1) / ((y == 0).sum() + 2))
    told = np.abs(ratio) / np.sqrt(1 / (pos + 1) + 1 / (neg + 1)) >= 2.5
    assert model.buckets.tolist() == np.array(every)[told].tolist()
    x = held[:, told] * ratio[told]
    weights = model.weights / ratio[told]
    wrong = 1 / (1 + np.exp(-(x @ weights + model.bias))) - y
    assert np.abs(x.T @ wrong / len(y) + 1e-3 * weights).max() < 1e-3 and abs(wrong.mean()) < 1e-3  # no slope is left
    plain = 1 / (1 + np.exp(-(x @ weights + model.bias)))
    assert np.allclose(model.score_texts([texts[k] for k in sorted(known)]), plain)


def test_an_id_with_many_texts_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.text) for r in labelled_sample(docs, labels, "toxic", 9).collect()) == [(1, "text 0"), (2, "a")]


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = prose(4, 3_000)
    whole = toxicity.gram_buckets(text)
    monkeypatch.setattr(toxicity, "BLOCK", 1_000)
    assert (toxicity.gram_buckets(text) == whole).all()
    assert len(toxicity.gram_buckets("")) <= 1


def test_quality(spark, odd, none):
    docs, labels = planted(spark, lambda t: t.upper().replace(" ", "!! ### "))
    model = quality.fit_quality(docs, labels)
    assert accuracy(model.score(docs), labels, "quality", 0.3) > 0.97
    special_cases(model, odd, none)
    kept = model.keep(odd, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.fit_quality(docs, labels.limit(0)).keep(docs, 0.3).count() == docs.count()


def test_statistics_have_their_number():
    for text in ("", " \n ", "Abc def.\n12 |!!", prose(1, 50)):
        values = quality.text_statistics(text)
        assert len(values) == quality.N_STATS and np.isfinite(values).all()


def test_isotonic_is_monotone_and_exact_on_separated_data():
    made = np.random.default_rng(2)
    raw = made.normal(size=300)
    labels = (raw + made.normal(size=300) > 0).astype(float)
    x, y = quality.isotonic(raw, labels)
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and abs(np.interp(raw, x, y).mean() - labels.mean()) < 0.02
    x, y = quality.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert np.interp([1.5, 3.5], x, y).tolist() == [0.0, 1.0]


def test_partition_sums_equal_one_sum(spark):
    made = np.random.default_rng(0)
    stats = made.normal(size=(200, quality.N_STATS))
    rows = spark.createDataFrame([(x.tolist(), int(k % 2)) for k, x in enumerate(stats)], "stats array<double>, label int").repartition(5)
    model = quality.QualityModel(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), made.normal(size=(quality.N_STATS, 16)), made.uniform(size=16), np.zeros(0))
    gram, right = quality._normal_equations(rows, model)
    z, y = model.features(stats), np.arange(200) % 2
    assert np.allclose(gram, z.T @ z) and np.allclose(right, z.T @ y)


def test_quality_equals_a_plain_fit(spark):
    docs, labels = planted(spark, lambda t: t.upper().replace(" ", "!! ### "))
    model = quality.fit_quality(docs, labels, n_features=24)
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).alias("part")
    rows = docs.join(labels, "doc_id").where(~is_held_out(F.col("doc_id"))).select("text", "quality", part).collect()
    stats, y, of = np.array([quality.text_statistics(r.text) for r in rows]), np.array([r.quality for r in rows], float), np.array([r.part for r in rows])
    made = np.random.default_rng(7)
    waves, phases = made.normal(0, 1 / 4.0, (quality.N_STATS, 24)), made.uniform(0, 2 * np.pi, 24)
    spread = stats.std(axis=0)
    scaled = np.clip((stats - stats.mean(axis=0)) / np.where(spread > 1e-9, spread, 1), -8, 8)
    z = np.hstack([np.sqrt(2 / 24) * np.cos(scaled @ waves + phases), np.ones((len(y), 1))])
    fit = of > 0
    weights = np.linalg.solve(z[fit].T @ z[fit] + 1e-3 * fit.sum() * np.eye(25), z[fit].T @ y[fit])
    assert np.allclose(model.weights, weights, atol=1e-6)
    steps = quality.isotonic(z[~fit] @ weights, y[~fit])
    plain = np.clip(np.interp(z @ weights, *steps), 0, 1)
    assert np.allclose(model.score_texts([r.text for r in rows]), plain, atol=1e-4)


def test_labels_that_contradict_or_are_held_out_are_left_out(spark):
    rows = [(k, 1) for k in range(40)] + [(1, 0), (2, 1), (None, 1), (3, None), (4, 7)]
    kept = {r.doc_id for r in clean_labels(spark.createDataFrame(rows, "doc_id long, toxic int"), "toxic").collect()}
    import zlib

    assert kept == {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 and k not in (1,)}


def test_lm_prefers_what_it_has_seen(spark, odd, none):
    rows = [(k, "the cat sat on the mat and the dog ran to the door " * 5) for k in range(60)] + [(99, prose(8, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(docs, n_words=lm.WIDTH).collect()}
    assert got[0].n_words == 65 and abs(got[0].log_likelihood - got[1].log_likelihood) < 1e-3 and got[0].mean_log_likelihood > got[99].mean_log_likelihood
    rest = lm.score_documents(odd).collect()
    assert len(rest) == odd.count() and all((r.n_words == 0) == (r.mean_log_likelihood is None) for r in rest)
    assert lm.score_documents(none).count() == 0


def plain_units(texts, n_words):
    words = [[w.encode() for w in (t or "").lower().split()] for t in texts]
    hashes = {w: int(word_hashes(w)[0]) for t in words for w in t}
    n = Counter(w for t in words for w in t)
    top = sorted(n, key=lambda w: (-n[w], np.uint64(hashes[w]).view(np.int64)))[:n_words]
    unit = {w: top.index(w) if w in top else n_words + int(lm.endings([w])[0]) for w in n}
    return words, n, set(top), unit


def test_lm_equals_a_plain_version(spark):
    texts = [prose(k % 17, 20 + k) for k in range(40)] + [prose(3, 30)] * 2 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words, n, top, unit = plain_units(texts, lm.WIDTH)
    counts = np.zeros(lm.WIDTH + lm.TAILS)
    for w, k in n.items():
        counts[unit[w]] += k
    model = lm.WindowModel.begin(counts, 32, 5)
    flat = np.array([unit[w] for t in words for w in t])
    bounds = np.cumsum([0, *map(len, words)])
    for turn in range(4):  # as one partition sees it
        model.train(flat, bounds, turn, 4, 0.3)
    tails = [w for w in n if w not in top]
    mass = {u: sum(n[w] + lm.PRIOR for w in tails if unit[w] == u) for u in {unit[w] for w in tails}}
    got = {r.doc_id: r for r in lm.score_documents(docs, n_words=lm.WIDTH).collect()}
    for k, text in enumerate(words):
        padded = [len(counts)] * 2 + [unit[w] for w in text] + [len(counts)] * 2
        total = 0.0
        for i, w in enumerate(text):
            hidden = model.hidden([np.array([padded[i + 2 + d]]) for d in lm.SIDES])[0].astype(float)
            *_, classes, class_bias, units, unit_bias = (x.astype(float) for x in model.layers)
            c, j = divmod(unit[w], lm.WIDTH)
            for logits, which in ((classes @ hidden + class_bias, c), (units[c] @ hidden + unit_bias[c], j)):
                total += logits[which] - np.log(np.exp(logits).sum())
            if w not in top:
                total += np.log(n[w] - text.count(w) + lm.PRIOR) - np.log(mass[unit[w]])
        assert got[k].n_words == len(text) and abs(got[k].log_likelihood - total) < 1e-2 * max(1, len(text) / 20)


def test_lm_steps_follow_the_slope():
    made = np.random.default_rng(0)
    model = lm.WindowModel.begin(made.integers(0, 50, 3 * lm.WIDTH).astype(float), 8, 1)
    model.layers = [(x + made.normal(0, 0.3, x.shape)).astype(np.float32) for x in model.layers]
    sides, own = [made.integers(0, 3 * lm.WIDTH + 1, 200) for _ in lm.SIDES], made.integers(0, 3 * lm.WIDTH, 200)
    before = [x.astype(float) for x in model.layers]
    #: Paces of one make a step plain gradient descent.
    model.seen = [np.full(x.shape[:-1], 1.0, np.float32) for x in model.layers]
    model.step(sides, own, 1e-2)
    for k, layer in enumerate(before):
        at = np.unravel_index(np.argmax(np.abs(model.layers[k] - layer)), layer.shape)
        loss = []
        for nudge in (-1e-2, 1e-2):
            layers = [x.astype(np.float32) for x in before]
            layers[k][at] += nudge
            loss.append(-lm.WindowModel(layers).position_sums(sides, own).astype(float).mean())
        slope = (loss[1] - loss[0]) / 2e-2
        assert abs((layer[at] - model.layers[k][at]) / 1e-2 - slope) < 0.05 * abs(slope) + 2e-4


def test_lm_averages_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    rows = [(k, prose(k, 30)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    counts = lm.word_counts(docs)
    known = lm.vocabulary(counts, lm.WIDTH)
    words = lm.written(lm.encoded(docs, known), "test-words")
    many = lm.fit_window_model(words, known.counts)
    monkeypatch.setattr(lm, "FAN", 64)
    assert np.allclose(many.flat(), lm.fit_window_model(words, known.counts).flat(), atol=1e-5)


def test_context_gains_alike_on_any_number_of_partitions(spark):
    """What the words around add, against the same texts with their words shuffled, for 4, 32 and 128 partitions."""
    import random

    made = random.Random(11)
    follows = {w: made.sample(WORDS, 3) for w in WORDS}
    texts = []
    for _ in range(240):
        word, out = made.choice(WORDS), []
        for _ in range(250):
            word = made.choice(follows[word])
            out.append(word)
        texts.append(" ".join(out))
    mixed = [" ".join(made.sample(t.split(), 250)) for t in texts]
    gains = []
    for parts in (4, 32, 128):
        docs, other = (spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").repartition(parts) for x in (texts, mixed))
        counts = written(lm.word_counts(docs), "counts")
        known = lm.vocabulary(counts, lm.WIDTH)
        words = written(lm.encoded(docs, known), "words")
        model = lm.fit_window_model(words, known.counts)
        mean = lambda w: lm.score_words(w, model, known, counts).selectExpr("sum(log_likelihood) / sum(n_words)").first()[0]  # noqa: B023, E731
        gains.append(mean(words) - mean(lm.encoded(other, known)))
    assert min(gains) > 0.3 and max(gains) - min(gains) <= 0.1 * min(gains)
