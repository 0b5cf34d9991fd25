import random

import numpy as np
import pytest

from rallylens.llm import langid, quality, toxicity, trees
from rallylens.llm.tables import held_out

SYLLABLES = {"xx": "ka lo mi ter un sa".split(), "yy": "ßen üch der lich ung pf".split(), "zz": "ción que ñas mente los rra".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(documents):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(360):
        lang = rng.choice(list(SYLLABLES))
        text, toxic, good = prose(rng, lang, rng.randint(20, 60)), i % 5 == 0, i % 4 != 0
        if toxic:
            text += " you " + rng.choice(["stupid", "zorgling", "zorgel"]) + " " + rng.choice(["idiot", "zorgon"])
        if not good:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, "s"))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "123 !!", "yy", None), (None, "ka lo", "xx", "s"), (0, rows[0][1], "xx", "s"), (1003, prose(rng, "zz", 30000), None, None)]
    return documents(rows), labels


def test_languages(corpus):
    docs, _ = corpus
    model = langid.fit(docs, docs.where(~held_out(3, 1)).select("doc_id", "lang"), 60, 12)
    rows = docs.select("doc_id", "lang", langid.language("text", model).alias("p")).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.p for r in rows}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == "xx" and by[1003].lang_pred == "zz"
    right = [r.p.lang_pred == r.lang for r in rows if r.doc_id is not None and 0 < r.doc_id < 360 and r.doc_id]
    assert np.mean(right) > 0.97 and all(0 <= r.p.score <= 1 for r in rows)


def test_kernel_is_shared_ngrams_over_norms():
    a, b = "abc", "abd"
    sets = [{*t, *(t[i : i + 2] for i in range(2)), t} for t in (a, b)]
    slots = np.arange(langid.SLOTS)
    rows, sizes = langid.presence([a, b], slots)
    assert sizes.tolist() == [len(s) for s in sets] and rows[0] @ rows[1] == len(sets[0] & sets[1])


def test_quality_and_toxicity(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    good = quality.fit(docs, table.select("doc_id", "quality"))
    bad = toxicity.fit(docs, table.where(~held_out(3, 1)).select("doc_id", "toxic"))
    rows = docs.select("doc_id", quality.quality("text", good).alias("q"), toxicity.toxicity("text", bad).alias("t")).collect()
    assert len(rows) == docs.count() and all(0 <= r.q <= 1 and 0 <= r.t <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert np.mean([(by[i].q >= 0.7) == bool(q) for i, q, _ in labels]) > 0.97
    assert np.mean([(by[i].t >= 0.7) == bool(t) for i, _, t in labels]) > 0.95
    assert by[1000].t == by[1001].t < 0.7


def test_disguised_insults():
    words = toxicity.Lexicon(frozenset([b"idiot", b"stupid"]), frozenset([b"zorg"]))
    squeezed = frozenset(map(toxicity.collapsed, words.words))
    found = {t: toxicity.text_features(t, words, squeezed) for t in ("you id1ot", "st.upid", "i d i o t", "stuuupid", "Zorgel here", "fine words")}
    names = toxicity.FEATURES
    assert all(found[t][names.index("disguised")] > 0 for t in ("you id1ot", "st.upid", "i d i o t", "stuuupid"))
    assert found["Zorgel here"][names.index("lexicon")] == 0.5 and found["fine words"][1:4] == [0.0, 0.0, 0.0]


def test_nothing_to_learn(spark, empty, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "abc", "en", "s"), (2, None, None, None)])
    q, t = quality.fit(empty, labels.select("doc_id", "quality")), toxicity.fit(empty, labels.select("doc_id", "toxic"))
    model = langid.fit(empty, empty.select("doc_id", "lang"))
    rows = docs.select(quality.quality("text", q).alias("q"), toxicity.toxicity("text", t).alias("t"), langid.language("text", model).alias("l")).collect()
    assert {(r.q, r.t, r.l.lang_pred) for r in rows} == {(0.5, 0.5, "und")}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, size=(3000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=3000) < 0.05)).astype(float)
    model = quality.fit_additive(x, y, np.ones(3000))
    assert (1, 0) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.88


def test_isotonic_is_monotone_and_keeps_the_mean():
    s = np.array([0.1, 0.2, 0.2, 0.3, 0.9])
    y = np.array([0.0, 1.0, 0.0, 0.0, 1.0])
    at, value = trees.isotonic(s, y, np.ones(5))
    assert (np.diff(value) >= 0).all() and abs(np.interp(s, at, value).mean() - y.mean()) < 1e-9
