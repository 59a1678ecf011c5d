import random

import numpy as np
import pytest
from factweir.llm import entries, langid, mixing, quality_model

from tests.llm.brute import HOSTILE, docs

ALPHABETS = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "äöüßklmn"}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(0)
    rows = [(i, _text(rng, lang, 60), lang) for i, lang in enumerate(list(ALPHABETS) * 20)] + [(900, None, "aa"), (901, "zzz", None)]
    return langid.learn(docs(spark, rows))


def test_languages_and_mixtures(languages):
    rng = random.Random(1)
    langs, logp = languages
    assert langs == sorted(ALPHABETS)
    for lang in langs:
        pred, score, shares = langid.infer(_text(rng, lang, 50), langs, logp)
        assert (pred, set(shares)) == (lang, {lang})
        assert score == pytest.approx(1)
    mixed = " ".join([_text(rng, "aa", 300), _text(rng, "bb", 100)])
    pred, score, shares = langid.infer(mixed, langs, logp)
    assert pred == "aa" and set(shares) == {"aa", "bb"}
    assert score == pytest.approx(0.75, abs=0.06)


def test_awkward_texts(spark, languages):
    langs, logp = languages
    rows = [*enumerate(HOSTILE), (None, None), (3, "word"), (50, "12 !"), (51, "é"), (52, "a")]
    got = langid.identify(docs(spark, rows), langs, logp).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(HOSTILE):
        letters = any(c.isalpha() for c in t or "")
        assert (by[i].lang_pred == "und") == (not letters), t
        assert 0 <= by[i].score <= 1
    assert by[50].lang_pred == "und" and by[51].lang_pred != "und" and by[52].lang_pred != "und"
    assert langid.identify(docs(spark, []), langs, logp).count() == 0
    none = langid.learn(docs(spark, []))
    assert langid.identify(docs(spark, [(1, "words here")]), *none).first().lang_pred == "und"


def test_language_query_on_held_out_rows(spark, data):
    got = entries.op4_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 10
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_non_negative_risk_separates(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (600, 4)), rng.normal(-1, 1, (600, 4))
    mixed = np.vstack([good[:300], bad[:200]])
    w = quality_model.fit_pu(good[300:].astype(np.float32), mixed.astype(np.float32), prior=0.6)
    says = lambda x: x @ w[:-1] + w[-1] > 0
    assert says(good[:300]).mean() > 0.9 and says(bad[200:]).mean() < 0.15
    assert not quality_model.fit_pu(good[:0], mixed, 0.5).any()


def test_quality_query_on_held_out_rows(spark, data):
    got = entries.op3_quality_classifier(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert (got.predicted == got.quality).mean() > 0.9
    assert got[got.quality == 1].predicted.mean() > 0.97


def test_quality_query_with_more_labels(spark):
    data = "/root/testdata/sf0.01"
    got = entries.op3_quality_classifier(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got[got.quality == 1].predicted.mean() > 0.98
    assert got[got.quality == 0].predicted.mean() < 0.1


def test_quality_on_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [*enumerate(HOSTILE), (None, None), (3, "word")]
    w = quality_model.learn(docs(spark, rows), labels)
    got = quality_model.score(docs(spark, rows), w).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (0, 1, 2)} == {0.0}
    none = quality_model.learn(docs(spark, []), labels.limit(0))
    assert quality_model.score(docs(spark, []), none).count() == 0
    assert quality_model.score(docs(spark, [(1, "some words")]), none).first().score == 0.5


MODEL = mixing.Model(("nasty",), tuple(np.log([0.8, 0.1, 0.1])), {f: [list(np.log([0.5, 0.3, 0.2]))] + [list(np.log([0.1, 0.3, 0.6]))] * len(c) for f, c in mixing.BINS.items()})


def _brute_loss(tokens, p, targets, w, ridge=1e-4):
    have = tokens @ p
    anchor = int(np.argmax(targets))
    budget = have[anchor] / targets[anchor]
    gap = (tokens * w) @ p - np.array(targets) * budget
    return (gap**2 / have).sum() + ridge * (tokens * (w - 1) ** 2).sum()


def _brute_rates(tokens, p, targets, ridge, top, rounds=20_000):
    """Plain projected gradient to the end, with the rates held document by document."""
    w = np.ones(len(tokens))
    have = tokens @ p
    anchor = int(np.argmax(targets))
    budget = have[anchor] / targets[anchor]
    for _ in range(rounds):
        r = ((tokens * w) @ p - np.array(targets) * budget) / have
        w = np.clip(w - (p @ r + ridge * (w - 1)) / (1 + ridge), 0, top)
    return w


def test_rates_match_brute_force_and_targets(spark):
    rng = random.Random(0)
    words = ["plain", "prose", "words", "nasty", "SHOUT!!", "|", "here"]
    rows = [(i, " ".join(rng.choices(words, [9, 9, 9, i % 3, i % 5, i % 2, 9], k=rng.randint(1, 60)))) for i in range(300)] + list(enumerate(HOSTILE, 400)) + [(None, "x"), (5, "again")]
    targets = (0.7, 0.2, 0.1)
    got = mixing.mix(docs(spark, rows), MODEL, targets).toPandas()
    assert len(got) == len(rows)
    p, tokens = got[["p_clean", "p_low", "p_toxic"]].to_numpy(), got.n_words.to_numpy(dtype=float)
    assert np.allclose(p.sum(axis=1), 1)
    want = _brute_rates(tokens, p, targets, 1e-4, 4.0)
    assert got.rate.between(0, 4).all()
    best, start = _brute_loss(tokens, p, targets, want), _brute_loss(tokens, p, targets, np.ones(len(p)))
    assert _brute_loss(tokens, p, targets, got.rate.to_numpy()) <= best + 0.002 * (start - best)
    sums, ideal = (tokens * got.rate.to_numpy()) @ p, (tokens * want) @ p
    assert np.allclose(sums / sums.sum(), ideal / ideal.sum(), atol=0.01)
    assert ((got.copies - got.rate).abs() < 1).all()
    many = mixing.mix(docs(spark, [(i, t) for i, (_, t) in enumerate(rows * 20)]), MODEL, targets).toPandas()
    q, size = many[["p_clean", "p_low", "p_toxic"]].to_numpy(), many.n_words.to_numpy(dtype=float)
    usual = np.abs(size) < 100  # a text of thousands of words alone moves a total
    drawn, meant = ((size * many[c].to_numpy())[usual] @ q[usual] for c in ("copies", "rate"))
    assert np.allclose(drawn, meant, rtol=0.03)
    snapped = mixing.mix(docs(spark, rows), MODEL, targets, snap=0.1).toPandas()
    near = snapped.rate.round()
    assert (snapped.copies == near)[(snapped.rate - near).abs() <= 0.1].all()
    assert mixing.mix(docs(spark, []), MODEL, targets).count() == 0


def test_lexicon_and_domains_are_learned(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choices(["river", "stone", "cloud", "forest", "window", "letter"], k=40))
    rows = [(i, clean() + (" You nasty, vile thing" if i % 4 == 0 else "") + (" BUY!! NOW!!" * 20 if i % 4 == 1 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 1 else 1, int(i % 4 == 0)) for i in range(0, 240)] + [(None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = mixing.learn(docs(spark, rows), labels)
    assert {"nasty", "vile"} <= set(model.lexicon)
    got = mixing.mix(docs(spark, rows), model, (0.9, 0.05, 0.05), max_rate=1.0, snap=0.1).toPandas()
    truth = np.select([got.doc_id % 4 == 0, got.doc_id % 4 == 1], [2, 1], 0)
    assert (got[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(axis=1) == truth).mean() > 0.97
    assert (got[truth == 0].copies == 1).all()
    assert got[truth == 2].rate.mean() < 0.6
    empty = mixing.learn(docs(spark, []), labels.limit(0))
    assert (mixing.mix(docs(spark, rows), empty, (0.9, 0.05, 0.05)).toPandas().rate > 0).all()


def _plain_scores(rows, labels, threshold=0.3):
    """The classifier of a small table, document by document, without Spark."""
    vectors = {i: quality_model.features(t) for i, t in rows}
    stack = lambda ids: np.stack(sorted((vectors[i] for i in ids if vectors[i] is not None), key=lambda v: v.tobytes()))
    marked = [q for i, q in labels.items() if i in vectors]
    w = quality_model.fit_pu(stack([i for i, q in labels.items() if q and i in vectors]), stack(vectors), sum(marked) / len(marked))
    score = {i: 0.0 if v is None else 1 / (1 + np.exp(-(v @ w[:-1] + w[-1]))) for i, v in vectors.items()}
    return {i: (s, int(s >= threshold)) for i, s in score.items()}


def test_quality_query_matches_brute_force(spark, data):
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if not held(r.doc_id)}
    train = [(i, t) for i, t in texts.items() if not held(i)]
    vectors = _plain_scores(train, labels)
    got = {r.doc_id: r for r in entries.op3_quality_classifier(spark, data).collect()}
    assert len(got) == len(texts)
    for i, t in train:
        assert got[i].score == pytest.approx(vectors[i][0], abs=1e-6), t
        assert got[i].predicted == vectors[i][1]
    assert all(r.held_out == held(i) for i, r in got.items())


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        found = quality_model.estimate_prior(good[2000:].astype(np.float32), np.vstack([good[:n], bad[: 2000 - n]]).astype(np.float32))
        assert found == pytest.approx(share, abs=0.08)


def _mixture_by_grid(units, langs):
    """Best pair of languages and proportion, over a grid."""
    like = np.exp((units - units.max(axis=1, keepdims=True)).astype(np.float64))
    best = (-np.inf, None)
    for i in range(len(langs)):
        for j in range(len(langs)):
            for share in np.linspace(0, 1, 101):
                value = np.log(share * like[:, i] + (1 - share) * like[:, j] + 1e-300).sum()
                best = max(best, (value, (langs[i], share) if share >= 0.5 else (langs[j], 1 - share)), key=lambda x: x[0])
    return best[1]


def test_language_mixtures_match_a_grid_search(spark, data, languages):
    rng = random.Random(5)
    langs, logp = languages
    for a, b in ((30, 0), (200, 90), (60, 240), (150, 140)):
        text = " ".join([_text(rng, "aa", a), _text(rng, "bb", b) if b else ""])
        pred, score, _ = langid.infer(text, langs, logp)
        want = _mixture_by_grid(langid._units(text, logp), langs)
        assert pred == want[0] and score == pytest.approx(want[1], abs=0.02)
