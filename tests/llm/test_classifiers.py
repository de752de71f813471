import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import documents, with_clashes
from tessera.llm.language_id import fit_languages, keep_identified, predict_languages, spherical_kmeans
from tessera.llm.quality import HIDDEN, best_bin_prior, descent, estimate_prior, fit_nnpu, fit_quality, risk_parts, score_quality, shape_features
from tessera.llm.quality import FEATURES as SHAPE_FEATURES

SYLLABLES = {"en": "the ing and er tion th ou wh st", "de": "sch ung ei ver au ü ö heit lich", "es": "ción os la que ez ñ ado mente í"}


def make(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    langs = list(SYLLABLES)
    rows = [(i, make(rng, langs[i % 3], rng.choice([5, 40, 200])), langs[i % 3] if i % 11 else None, "s", 1) for i in range(240)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "12 34 ... !", "en", "s", 9), (1003, "Ж щ", "en", "s", 3), (1004, make(rng, "de", 30_000), None, "s", 1), (None, "the and", "en", "s", 1)]
    return spark.createDataFrame(rows, documents(spark, []).schema)


def test_held_out_accuracy_and_unknown(spark, corpus):
    docs = with_clashes(corpus, "lang_pred", "score", "id", "rank")
    model = fit_languages(docs)
    got = {r.doc_id: r for r in predict_languages(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in corpus.collect() if r.doc_id is not None and r.doc_id < 1000}
    held = [i for i, lang in truth.items() if lang and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred in SYLLABLES  # a letter, if of no learned script
    assert got[1004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_stage_drops_only_what_is_rejected(spark, corpus):
    model = fit_languages(corpus)
    kept = keep_identified(corpus, model)
    assert kept.schema == corpus.schema
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {1000, 1001, 1002} and len(ids & set(range(240))) == 240


def test_learning_ignores_held_out_languages(spark, corpus):
    from pyspark.sql import functions as F

    flipped = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = fit_languages(corpus), fit_languages(flipped)
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids)


def test_rejects_unlearned_languages_and_gibberish(spark, corpus):
    rng = random.Random(9)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (50, 200) for _ in range(20)]
    for unlearned in SYLLABLES:
        learned = [lang for lang in SYLLABLES if lang != unlearned]
        model = fit_languages(corpus.where(f"lang <> '{unlearned}'"))
        foreign = [make(rng, unlearned, n) for n in (40, 200) for _ in range(20)]
        short = [make(rng, lang, n) for lang in learned for n in (3, 5, 40) for _ in range(20)]
        texts = foreign + noise + short
        docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], documents(spark, []).schema)
        rejected = {r.doc_id for r in predict_languages(docs, model).where("rejected").collect()}
        alien = set(range(len(foreign + noise)))
        assert len(rejected & alien) > 0.9 * len(alien), unlearned
        assert len(rejected - alien) <= 0.02 * len(short), unlearned
        assert {r.doc_id for r in keep_identified(docs, model).collect()} == set(range(len(texts))) - rejected


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than texts that the sample may hold in all."""
    from tessera.llm import language_id

    monkeypatch.setattr(language_id, "FIT_TEXTS", 10)
    monkeypatch.setattr(language_id, "LEAST_TEXTS", 1)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(40):
        parts = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(8)]
        rows += [(100 * k + i, " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(40)), f"l{k:02}", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    model = fit_languages(docs)
    assert model.languages == [f"l{k:02}" for k in range(40)]
    got = {r.doc_id: r.lang_pred for r in predict_languages(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.95


def plain_trigrams(text):
    """Counts of hashed byte trigrams of lower-cased words with a blank at both ends."""
    from collections import Counter

    words = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()).split()
    out = Counter()
    line = b" " + b" ".join(words) + b" " if words else b""
    for i in range(len(line) - 2):
        a, b, c = line[i : i + 3]
        if b != 32:
            out[(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
    return out


def test_scores_equal_plain_recomputation(spark, corpus):
    """TF-IDF vectors, the nearest centroid and its cosine, recomputed without numpy for every text."""
    import math

    model = fit_languages(corpus)
    rows = corpus.where("doc_id is not null").collect()
    train = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    frequency = [0] * 4096
    for r in train:
        for f in plain_trigrams(r.text or ""):
            frequency[f] += 1
    idf = [math.log((1 + len(train)) / (1 + n)) for n in frequency]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r.doc_id: r for r in predict_languages(corpus, model).collect()}
    centroids = model.centroids.tolist()
    for r in rows[:60] + rows[-6:]:
        v = {f: math.log1p(n) * idf[f] for f, n in plain_trigrams(r.text or "").items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if not norm or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == ("und" if not any(c.isalpha() for c in r.text or "") else got[r.doc_id].lang_pred)
            continue
        cos = [sum(x * c[f] for f, x in v.items()) / norm for c in centroids]
        best = max(cos)
        assert abs(got[r.doc_id].score - min(max(best, 0), 1)) < 1e-4
        near = {model.languages[model.owner[k]] for k, x in enumerate(cos) if x > best - 1e-5}
        assert got[r.doc_id].lang_pred in near


def test_no_training_data(spark, corpus):
    model = fit_languages(corpus.limit(0))
    assert {r.lang_pred for r in predict_languages(corpus, model).collect()} == {"und"}
    assert predict_languages(corpus.limit(0), model).count() == 0


def test_kmeans_finds_directions():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(4)[k] + rng.normal(0, 0.05, (30, 4)) for k in (0, 1, 2)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = spherical_kmeans(x, 3)
    assert sorted(c.argmax(axis=1).tolist()) == [0, 1, 2]


def test_nnpu_separates():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (7000, SHAPE_FEATURES)), rng.normal(0, 1, (2000, SHAPE_FEATURES))
    bad[:, :3] += 4
    # as many texts as the production bounds draw
    model = fit_nnpu(good[:3000].astype(np.float32), np.concatenate([good[3000:], bad]).astype(np.float32), 2 / 3)
    assert (model.score(good[3000:]) >= 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.85


def test_risk_and_descent_equal_plain_sums_and_small_steps():
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (12, SHAPE_FEATURES)), rng.normal(0, 1, (17, SHAPE_FEATURES))
    w = [rng.normal(0, 0.2, (SHAPE_FEATURES, HIDDEN)), rng.normal(0, 0.2, HIDDEN), rng.normal(0, 0.4, HIDDEN), np.array([0.1])]

    def plain(w, prior):
        def loss(x, sign):
            out = 0.0
            for row in x:
                h = [max(sum(a * b for a, b in zip(row, w[0][:, k], strict=True)) + w[1][k], 0) for k in range(HIDDEN)]
                g = sum(a * b for a, b in zip(h, w[2], strict=True)) + w[3][0]
                out += 1 / (1 + np.exp(sign * g))
            return out / len(x)

        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    for prior in (0.3, 0.9):
        parts = risk_parts(w, p, u, prior)
        assert np.allclose(parts, plain(w, prior))
        # below 0, the step undoes the negative part
        risk = (lambda v: sum(risk_parts(v, p, u, prior))) if parts[1] >= 0 else (lambda v: -risk_parts(v, p, u, prior)[1])
        for i, g in enumerate(descent(w, p, u, prior)):
            for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
                moved = []
                for e in (1e-5, -1e-5):
                    v = [x.copy() for x in w]
                    v[i][at] += e
                    moved.append(risk(v))
                assert abs(g[at] - (moved[0] - moved[1]) / 2e-5) < 1e-6, (prior, i)
    assert {risk_parts(w, p, u, q)[1] >= 0 for q in (0.3, 0.9, 5.0)} == {True, False}


def test_prior_from_scores_and_from_unlabelled_texts():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(3, 1, 6000), rng.normal(-3, 1, 2000)
    assert abs(best_bin_prior(good[:2000], np.concatenate([good[2000:], bad])) - 2 / 3) < 0.03
    good, bad = rng.normal(0, 1, (6000, SHAPE_FEATURES)), rng.normal(0, 1, (1000, SHAPE_FEATURES))
    bad[:, :8] += 3
    assert abs(estimate_prior(good[:2000], np.concatenate([good[2000:], bad])) - 0.8) < 0.06
    assert estimate_prior(good[:1], bad) == 0.5


def test_shape_features_equal_plain_counts():
    import pyarrow as pa

    from tessera.llm.quality import BIGRAMS, CATEGORIES, CATEGORY
    from tessera.llm.textbytes import text_buffers

    texts = ["One two two.\nOne two two.\n\nx!", "a\tb  B b b (q) 12", "", "é é\né é", "ha ha HA ha!"]
    found = shape_features(*text_buffers(pa.array(texts, pa.string())))
    for t, x in zip(texts, found, strict=True):
        raw = t.encode()
        want = np.zeros(SHAPE_FEATURES)
        n = max(len(raw), 1)
        for b in raw:
            want[CATEGORY[b]] += 1 / n
        units = [[w.lower() for w in re.split(rb"[\t-\r ]+", raw) if w], [w.lower() for w in raw.split(b"\n") if w]]
        for k, u in enumerate(units):
            if u:
                want[CATEGORIES + 2 * k], want[CATEGORIES + 2 * k + 1] = len(set(u)) / len(u), max(u.count(w) for w in u) / len(u)
        words = [w for w in re.split(rb"[\t-\r ]+", raw) if w]
        many = max(len(words), 1)
        want[CATEGORIES + 4], want[CATEGORIES + 5] = np.log1p(len(words)) / 10, np.log1p(len(units[1])) / 10
        want[CATEGORIES + 6] = sum(map(len, words)) / many / 10
        want[CATEGORIES + 7] = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)) / many
        want[CATEGORIES + 8] = sum(CATEGORY[w[-1]] >= 8 for w in words) / many
        pairs = np.zeros(BIGRAMS)
        low = raw.lower()
        for a, b in zip(low, low[1:], strict=False):
            pairs[(((a << 8 | b) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BIGRAMS.bit_length() + 1)] += 1
        want[-BIGRAMS:] = np.sqrt(pairs / n)
        assert np.allclose(x, want, atol=1e-6), t


def test_null_and_repeated_ids_of_documents(spark):
    rng = random.Random(7)
    rows = [(i // 2 if i % 5 else None, make(rng, "en", 40).capitalize() + ".", "en", "s", 1) for i in range(200)] + [(None, None, None, None, None), (3, None, "de", "s", 0)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    lab = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    scores = score_quality(docs, fit_quality(docs, lab)).collect()
    assert len(scores) == 202 and sum(r.doc_id is None for r in scores) == 41 and all(0 <= r.score <= 1 for r in scores)
    assert score_quality(docs.limit(0), fit_quality(docs, lab)).collect() == []
    found = predict_languages(docs, fit_languages(docs)).collect()
    assert len(found) == 202 and sum(r.lang_pred == "und" for r in found) == 2


def test_quality_scores(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = make(rng, "en", 60)
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t.capitalize() + ".", "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "THE!! " * 30_000, "en", "s", 0)]
    labels += [(5, 1, 0), (None, 1, 0), (7, None, 0)]
    docs = with_clashes(spark.createDataFrame(rows, documents(spark, []).schema), "score", "positive", "label", "features")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, lab)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.9
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert fit_quality(docs, lab.limit(0)) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    from tessera.llm.textbytes import text_buffers

    texts = ["One two two.\nOne two two.\n", "", None, "é é", "x"]
    whole = shape_features(*text_buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], shape_features(*text_buffers(pa.array([t], pa.string())))[0])
