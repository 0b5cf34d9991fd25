import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallylens.learn import bayes, metrics, response, scorer, topics, variational
from rallylens.operators import tokens as tok
from rallylens.plans import queries
from rallylens.storage import FREE_SHUFFLES, passing_tables, settle, shared_root

TRAIN = [
    (1, "tension with the police", 1),
    (2, "police arrested protesters", 1),
    (3, "demonstrators were shot", 1),
    (4, "marched through the town", 0),
    (5, "gathered outside the hall", 0),
]
TEST = [(6, "police arrested demonstrators"), (7, "marched outside"), (8, "zzz"), (9, "police police hall")]


def brute_force(train, test):
    counts = {c: Counter(w for _, t, y in train if y == c for w in t.split()) for c in (0, 1)}
    vocabulary = set(counts[0]) | set(counts[1])
    out = {}
    for doc, text in test:
        scores = []
        for c in (0, 1):
            total = sum(counts[c].values()) + len(vocabulary)
            scores.append(sum(math.log((counts[c][w] + 1) / total) for w in text.split() if w in vocabulary))
        out[doc] = scores
    return out


def test_naive_bayes(spark):
    train = spark.createDataFrame(TRAIN, "doc int, t string, y int")
    test = spark.createDataFrame(TEST, "doc int, t string")
    words = tok.tokens(train, "t", ["doc", "y"], stop_words=())
    model = bayes.train(words, "word", "y")
    got = bayes.predict(tok.tokens(test, "t", ["doc"], stop_words=()), model, test.select("doc"), "doc")
    want = brute_force(TRAIN, TEST)
    rows = got.collect()
    assert len(rows) == len(TEST)
    for r in rows:
        assert [r.score0, r.score1] == pytest.approx(want[r.doc], abs=1e-5)
        assert r.predicted == int(want[r.doc][1] > want[r.doc][0])


def test_tokens_and_stop_table(spark):
    df = spark.createDataFrame([(1, "The 12 police, arrested a man2 the day")], "doc int, t string")
    words = [r.word for r in tok.tokens(df, "t", ["doc"]).collect()]
    assert words == ["police", "arrested", "man2", "day"]
    stops = spark.createDataFrame([("police",), ("the",)], "word string")
    assert [r.word for r in tok.tokens(df, "t", ["doc"], stops).collect()] == ["arrested", "a", "man2", "day"]
    counted = tok.term_counts(tok.tokens(df, "t", ["doc"], ()), "doc")
    assert {r.word: r.n for r in counted.collect()}["the"] == 2


def test_stems_of_counted_words(spark):
    df = spark.createDataFrame([(1, "arrested"), (1, "arrests"), (2, "police")], "doc int, word string")
    df = df.union(spark.createDataFrame([(3, "police")] * 4, "doc int, word string"))
    got = sorted(map(tuple, tok.stemmed_counts(df, ["doc"]).collect()))
    assert got == [(1, "arrest", 2), (2, "polic", 1), (3, "polic", 4)]
    assert {r.word: r.stem for r in tok.stem_vocabulary(df).collect()} == {"arrested": "arrest", "arrests": "arrest", "police": "polic"}


def test_stop_tables(spark):
    df = spark.createDataFrame([(1, "don le police"), (2, "le nicht march"), (3, "le")], "doc int, t string")
    stops = tok.stop_table(spark, ["english", "french", "german"])
    for limit in (1 << 26, 0):
        assert sorted(r.word for r in tok.tokens(df, "t", ["doc"], stops, limit=limit).collect()) == ["march", "police"]
    words = tok.tokens(df, "t", ["doc"], ())
    assert [r.word for r in tok.common_words(words, "doc", 0.5).collect()] == ["le"]


def test_confusion(spark):
    pairs = [(1, 1)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(0, 0)] * 4
    row = metrics.confusion_stats(spark.createDataFrame(pairs, "a int, p int"), "a", "p").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (5, 2, 1, 4)
    assert row.accuracy == pytest.approx(9 / 12) and row.precision == pytest.approx(5 / 7)
    assert row.specificity == pytest.approx(4 / 6) and row.prevalence == pytest.approx(0.5)
    assert row.balanced_accuracy == pytest.approx((5 / 6 + 4 / 6) / 2)
    expected = (7 * 6 + 5 * 6) / 144
    assert row.kappa == pytest.approx((0.75 - expected) / (1 - expected))


def test_multilabel(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.5), (1, 1, 0.4, 0.6), (0, 0, 0.1, 0.7)], "a int, b int, s double, t double")
    row = metrics.multilabel_metrics(df, ["a", "b"], ["s", "t"]).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 1)
    assert row.accuracy == pytest.approx(1 / 3)


def test_label_preparation(spark):
    df = spark.createDataFrame([(None, "", "1"), ("x", None, "0")], "t string, a string, b string")
    rows = scorer.prepare_labels(df, "t", ["a", "b"]).collect()
    assert [(r.t, r.a, r.b, r.labels) for r in rows] == [("", 0, 1, [0.0, 1.0]), ("x", 0, 0, [0.0, 0.0])]


def test_batch_hook_survives_failures(spark):
    def fails_on_bad(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("bad").any():
            raise RuntimeError("no")
        return pd.DataFrame({"arrest": texts.str.len().astype(float)})

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "  "), (4, None)], "id int, t string").coalesce(1)
    got = {r.id: r.arrest for r in scorer.score_batches(df, "t", fails_on_bad, ["arrest"]).collect()}
    assert got == {1: 4.0, 2: 0.0, 3: 0.0, 4: 0.0}
    cut = scorer.score_batches(df.where("id = 1"), "t", fails_on_bad, ["arrest"], max_chars=2)
    assert cut.first().arrest == 2.0


def test_severity_learns_and_reloads(spark, tmp_path):
    rows = [(i, "police arrested people" if i % 2 else "quiet march in town", i % 2, 0 if i % 3 else 1) for i in range(60)]
    coded = spark.createDataFrame([*rows, (99, None, 0, 0)], "id int, t string, arrest int, other int")
    model = scorer.fit_severity(coded, "t", ["arrest", "other"], features=1 << 10)
    path = str(tmp_path / "model")
    scorer.save_model(model, path)
    out = scorer.score_severity(coded, scorer.load_model(path), "t", ["arrest", "other"])
    got = {r.id: r.arrest_score for r in out.collect()}
    assert len(got) == 61 and got[99] == 0.0
    assert got[1] > 0.5 > got[2]
    assert out.where("id = 99").first().t is None


def test_topics(spark):
    pieces = ["police arrest riot gas", "march town hall square", "farm price milk crop"]
    words = spark.createDataFrame(
        [(d, w) for d in range(30) for w in pieces[d % 3].split()], "doc int, word string"
    )
    counts = tok.term_counts(words, "doc")
    model = topics.fit_topics(counts, "doc", "word")
    dominant = model.dominant()
    assert dominant.select("doc").distinct().count() == 30
    sums = model.topic_shares().groupBy("doc").agg(F.sum("gamma").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    terms = model.top_terms(2)
    assert terms.groupBy("topic").count().where("count < 2").count() == 0
    few = topics.fit_topics(counts.where("doc < 5"), "doc", "word")
    assert few.dominant().collect() == few.top_terms().collect() == []
    assert few.dominant().dtypes == model.dominant().dtypes and few.top_terms().dtypes == model.top_terms().dtypes


def test_every_document_counts_in_the_fit(spark):
    # Each document alone holds a term; all of them must have weight in the topics.
    rows = [(d, w, 1) for d in range(60) for w in ("common", f"only{d}")]
    model = topics.fit_topics(spark.createDataFrame(rows, "doc int, stem string, n long"), "doc", passes=3)
    weights = model.top_terms(61).groupBy("term").agg(F.max("beta").alias("b")).where("b > 1e-4")
    assert weights.count() == 61


def test_grouped_fit_equals_row_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    g = rng.integers(0, 12, 400)
    df = spark.createDataFrame(
        pd.DataFrame({"a": x[:, 0].astype(float), "b": x[:, 1].astype(float), "y": y, "g": g})
    )
    by_row, _ = response.fit_binary(df, ["a", "b"], "y")
    grouped = response.grouped_counts(df, ["a", "b", "g"], "y")
    by_group, _ = response.fit_binary(grouped, ["a", "b"], "y", weight="w")
    assert list(by_group.coefficients) == pytest.approx(list(by_row.coefficients), abs=1e-6)
    one = response.clustered_errors(df, ["a", "b"], "y", "g", by_row)
    two = response.clustered_errors(grouped, ["a", "b"], "y", "g", by_group, weight="w")
    assert [e for *_, e in one] == pytest.approx([e for *_, e in two], rel=1e-6)
    design = np.column_stack([np.ones(400), x])
    beta = np.array([by_row.intercept, *by_row.coefficients])
    p = 1 / (1 + np.exp(-design @ beta))
    bread = np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design)
    scores = np.array([((y - p)[g == c][:, None] * design[g == c]).sum(axis=0) for c in np.unique(g)])
    k = len(scores)
    want = np.sqrt(np.diag(k / (k - 1) * bread @ scores.T @ scores @ bread))
    assert [e for *_, e in one] == pytest.approx(list(want), rel=1e-6)


def test_selection_adds_the_ratio(spark):
    rng = np.random.default_rng(2)
    n = 500
    x, z = rng.normal(size=n), rng.normal(size=n)
    chosen = (0.5 * x + z + rng.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "s": chosen, "y": 1 + 2 * x + rng.normal(size=n)}))
    probit, outcome, names = response.two_step_selection(df, ["x", "z"], "s", ["x"], "y")
    assert names == ["x", "mills_ratio"]
    assert outcome.coefficients[0] == pytest.approx(2.0, abs=0.3)
    assert probit.coefficients[1] > 0.5


def test_two_step_errors_against_numerical_derivatives(spark):
    """The stacked moments written out densely, their slope by differences; grouped rows give the same."""
    rng = np.random.default_rng(5)
    n = 600
    x, z = rng.integers(0, 3, n).astype(float), rng.integers(0, 4, n) / 2.0
    d = (0.4 * x - 0.5 + z + rng.normal(size=n) > 0.6).astype(float)
    y = np.where(d == 1, np.round(1 + 2 * x + rng.normal(size=n)), 0.0)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "s": d, "y": y}))
    got = response.two_step_errors(df, ["x", "z"], "s", ["x"], "y")
    probit, outcome, _ = response.two_step_selection(df, ["x", "z"], "s", ["x"], "y")
    gamma = np.array([probit.intercept, *probit.coefficients])
    theta = np.concatenate([gamma, [outcome.intercept, *outcome.coefficients]])
    design = np.column_stack([np.ones(n), x, z])
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))

    def moments(t):
        lin = design @ t[:3]
        phi, p = np.exp(-lin * lin / 2) / math.sqrt(2 * math.pi), cdf(lin)
        v = np.column_stack([np.ones(n), x, phi / p])
        first = (phi * (d - p) / (p * (1 - p)))[:, None] * design
        return np.column_stack([first, (d * (y - v @ t[3:]))[:, None] * v])

    slope = np.column_stack([(moments(theta + h).sum(0) - moments(theta - h).sum(0)) / 2e-5 for h in 1e-5 * np.eye(6)])
    lin = design @ gamma
    phi, p = np.exp(-lin * lin / 2) / math.sqrt(2 * math.pi), cdf(lin)
    slope[:3, :3] = -(design * (phi * phi / (p * (1 - p)))[:, None]).T @ design  # expected, not observed
    g = moments(theta)
    back = np.linalg.inv(slope)
    want = np.sqrt(np.diag(back @ g.T @ g @ back.T))[3:]
    assert [e for *_, e in got] == pytest.approx(list(want), rel=1e-4)
    grouped = df.groupBy("x", "z", "s", "y").agg(F.count("*").cast("double").alias("w"))
    again = response.two_step_errors(grouped, ["x", "z"], "s", ["x"], "y", weight="w")
    assert [e for *_, e in again] == pytest.approx([e for *_, e in got], rel=1e-4)


def test_equivalence(spark):
    df = spark.createDataFrame([("p", 1), ("p", 0), ("p", 1), ("q", 1), ("q", 0)], "g string, v int")
    row = response.mean_equivalence(df, F.col("v"), "g", "p", "q").first()
    error = math.sqrt(1 / 3 / 3 + 0.5 / 2)
    assert row.difference == pytest.approx(2 / 3 - 0.5)
    assert row.t_lower == pytest.approx((row.difference + 0.184) / error)


def test_equal_texts_are_fitted_once_and_weigh_as_often_as_they_occur(spark):
    """Against every document on its own; ids of several rows and rows without id are one document each."""
    pieces = ["police arrest riot gas police", "march town hall square", "farm price milk crop", "march price"]
    rows = [(f"d{i}", pieces[i % 7 % 4]) for i in range(40)] + [("d3", pieces[0]), ("d4", pieces[0]), ("d5", pieces[1]), ("d5", pieces[1])]
    rows += [(None, pieces[2]), (None, pieces[2]), ("", pieces[1]), ("none", None), ("short", "")]
    df = spark.createDataFrame(rows, "id string, notes string")
    plain = topics.fit_topics(tok.stemmed_counts(tok.tokens(df, "notes", ["id"]), ["id"]), "id")
    members, texts = topics.by_text(df, "id", "notes")
    model = topics.fit_topics(tok.stemmed_counts(tok.tokens(texts, "notes", [topics.STANDS]), [topics.STANDS]), "id", members=members)
    assert model.documents.count() < 12 < plain.documents.count() == 42 and model.documents.agg(F.sum("copies")).first()[0] == 42
    assert model.fitted.bounds == pytest.approx(plain.fitted.bounds, rel=1e-4)
    best = [{(r.id, r.topic): r.gamma for r in m.topic_shares().collect()} for m in (plain, model)]
    assert len(best[0]) == 42 * 3 and best[0] == pytest.approx(best[1], abs=2e-2)


def test_words_of_a_text_are_never_dealt_out(spark):
    """Texts are dealt out once; counts and lists per text come from where they lie, also of words without broadcast stems."""
    rows = [(f"d{i}", f"police march{i % 7}ing arrests arrested farms {'crop ' * (i % 3)}") for i in range(30)] + [("d3", "police crops")]
    df = spark.createDataFrame(rows, "id string, notes string").repartition(3)
    with passing_tables(spark):
        _, texts = topics.by_text(df, "id", "notes")
        by = [topics.STANDS, topics.PIECE]
        words = tok.tokens(texts, "notes", by)
        counts = tok.stemmed_counts(words, by, together=True)
        lists = counts.groupBy(*by).agg(F.collect_list("stem"))
        plan = lists._jdf.queryExecution().executedPlan().toString()
        dealt = plan[: plan.index("Union")]
        assert dealt.count("Exchange hashpartitioning") == 1 == dealt.count("REPARTITION_BY_NUM") and "SortMergeJoin" not in dealt
        plain = tok.stemmed_counts(words, by)
        assert sorted(map(str, counts.collect())) == sorted(map(str, plain.collect()))


def test_rare_words_get_their_stems_where_they_are(spark, monkeypatch):
    words = spark.createDataFrame([(k % 3, w) for k in range(30) for w in ("running", "runs", f"marching{'s' * (k % 9)}")], "doc int, word string")
    want = sorted(map(tuple, tok.stemmed_counts(words, ["doc"]).collect()))
    frequent = tok._frequent_stems
    monkeypatch.setattr(tok, "_frequent_stems", lambda *a: frequent(*a, limit=200))
    assert [r.word for r in tok._frequent_stems(words, "word", "stem").collect()] in (["running", "runs"], ["runs", "running"])
    assert sorted(map(tuple, tok.stemmed_counts(words, ["doc"], together=True).collect())) == want


def vectors(model):
    """The documents with the terms' names."""
    names = {r.term_id: r.term for r in model.vocabulary.collect()}
    return sorted((r[0], sorted((names[t], n) for t, n in zip(r.terms, r.counts, strict=True)), r.copies) for r in model.documents.collect())


def test_documents_of_many_rows_are_counted_in_pieces(spark, monkeypatch):
    pieces = ["police arrest riot gas police", "march town hall square", "farm price milk crop", "march price"]
    rows = [(f"d{i}", pieces[i % 7 % 4]) for i in range(40)] + [("d3", p) for p in pieces] + [(None, p) for p in pieces[1:]] * 2
    df = spark.createDataFrame(rows, "id string, notes string")
    by = [topics.STANDS, topics.PIECE]
    found = []
    for many in (1000, 2):
        monkeypatch.setattr(topics, "MANY_ROWS", many)
        members, texts = topics.by_text(df, "id", "notes")
        counts = tok.stemmed_counts(tok.tokens(texts, "notes", by), by, together=True)
        assert counts.select(*by).distinct().count() == 4 + (4 if many > 2 else 7)
        for least in (1, 2):
            found.append(vectors(topics.fit_topics(counts, "id", members=members, passes=1, min_documents=least)))
    members, texts = topics.by_text(df, "id", "notes")
    plain = tok.stemmed_counts(tok.tokens(texts, "notes", by[:1]), by[:1])
    want = [vectors(topics.fit_topics(plain, "id", members=members, passes=1, min_documents=least)) for least in (1, 2)]
    assert found == want * 2 and len(want[0]) == 6 and sum(v[2] for v in want[0]) == 41


def test_terms_are_numbered_right_when_hashes_meet(spark, monkeypatch):
    rows = [(d, w, d + 1) for d in range(12) for w in (None, *"abcdefg"[: 3 + d % 5])] + [(99, None, 1)]
    counts = spark.createDataFrame(rows, "doc int, stem string, n long")
    want = [vectors(topics.fit_topics(counts, "doc", passes=1, min_documents=m)) for m in (1, 5)]
    assert len(want[0]) == 12 and want[0][3][1] == [(w, 4.0) for w in "abcdef"]
    hashed = topics._hash
    monkeypatch.setattr(topics, "_hash", lambda term, seed: hashed(term, seed) % 3 if seed < 2 else hashed(term, seed))
    assert [vectors(topics.fit_topics(counts, "doc", passes=1, min_documents=m)) for m in (1, 5)] == want


def test_shares_do_not_need_one_large_batch(monkeypatch):
    rng = np.random.default_rng(1)
    weights = rng.dirichlet([0.2] * 50, 3).T
    batch = variational.Batch(rng.integers(0, 50, 700), rng.integers(1, 5, 700).astype(float), np.arange(0, 701, 10))
    whole = variational.shares_of(batch, weights, 0.5)
    monkeypatch.setattr(variational, "PART", 9)
    for a, b in zip(whole, variational.shares_of(batch, weights, 0.5), strict=True):
        assert a.shape == b.shape and np.allclose(a, b, atol=2e-2)


def test_passes_leave_nothing_on_disk_and_take_a_task_per_core(spark, monkeypatch):
    rows = [([d % 40, 40 + d % 9], [1.0, 2.0], 1) for d in range(400)]
    documents = spark.createDataFrame(rows, "terms array<int>, counts array<double>, copies long").repartition(40)
    context = spark.sparkContext
    weights = variational.starting_weights(49, 3, 1)
    files, tasks = set(os.listdir(context._temp_dir)), []
    totals = variational.one_pass(documents, weights, 1.0)
    assert set(os.listdir(context._temp_dir)) == files
    assert totals.documents == 400 and totals.taken.sum() == pytest.approx(1200)
    asked = type(documents).mapInArrow
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, *a: tasks.append(self.rdd.getNumPartitions()) or asked(self, *a))
    variational.fit(documents, 49, 3, 1, passes=2)
    assert max(tasks) <= context.defaultParallelism


def folders(spark):
    return {f.path for f in os.scandir(shared_root(spark).removeprefix("file:"))}


@pytest.mark.parametrize("name", ["topic_dominant", "topic_terms", "topic_invariants"])
def test_topic_queries_let_go_of_texts_and_words(spark, sf, name):
    """Once the documents are numbers, no landed table holds a text or a list of words."""
    settle(spark.range(1))  # the folder is there
    before = folders(spark)
    found = queries.QUERIES[name](spark, sf)
    left = [spark.read.parquet(f"file:{path}").columns for path in folders(spark) - before]
    assert left and not any({"notes", "word", "stem", "e"} & set(columns) for columns in left)
    assert found.collect() and spark.conf.get(FREE_SHUFFLES, None) in (None, "false")


def test_tables_in_passing_are_removed_unless_kept(spark):
    settle(spark.range(1))
    before = folders(spark)
    with passing_tables(spark) as passing:
        kept, gone = settle(spark.range(5)), settle(spark.range(7), "zstd")
        assert gone.count() == 7 and len(folders(spark) - before) == 2
        passing.keep_only(kept)
        assert kept.count() == 5 and len(folders(spark) - before) == 1
        settle(spark.range(9))
    assert len(folders(spark) - before) == 2 and settle(spark.range(3)).count() == 3


def test_vectors_hold_the_counts(spark):
    words = spark.createDataFrame(
        [(d, w) for d in range(12) for w in ["a"] * (d + 1) + ["b", "c", "d", "e", "f"]], "doc int, word string"
    )
    counts = tok.term_counts(words, "doc")
    model = topics.fit_topics(counts, "doc", "word", passes=1)
    ids = {r.term: r.term_id for r in model.vocabulary.collect()}
    assert sorted(ids.values()) == list(range(6))
    for r in model.documents.collect():
        held = dict(zip(r.terms, r.counts, strict=True))
        assert held[ids["a"]] == r.doc + 1 and held[ids["b"]] == 1 and len(held) == 6
    assert topics.fit_topics(counts, "doc", "word", min_documents=13).top_terms().collect() == []


def test_planted_topics_come_back_and_the_bound_rises(spark):
    """Documents drawn from three topics with own terms: weights and shares are recovered."""
    rng = np.random.default_rng(3)
    beta = np.full((30, 3), 1.0)
    for j in range(3):
        beta[10 * j : 10 * j + 10, j] = 30.0
    beta /= beta.sum(axis=0)
    theta = rng.dirichlet([0.3] * 3, 200)
    rows = []
    for d in range(200):
        drawn = rng.multinomial(80, beta @ theta[d])
        rows += [(d, f"t{w:02}", int(n)) for w, n in enumerate(drawn) if n]
    model = topics.fit_topics(spark.createDataFrame(rows, "doc int, stem string, n long"), "doc")
    bounds = model.fitted.bounds
    assert len(bounds) > 3 and all(b >= a - 1e-5 * abs(a) for a, b in zip(bounds, bounds[1:]))
    order = [None] * 3
    for r in model.top_terms(10).collect():
        true = int(r.term[1:]) // 10
        assert order[r.topic - 1] in (None, true)
        order[r.topic - 1] = true
    assert sorted(order) == [0, 1, 2]
    error = [abs(r.gamma - theta[r.doc][order[r.topic - 1]]) for r in model.topic_shares().collect()]
    assert np.mean(error) < 0.05 and 0.1 < model.fitted.alpha < 1


def test_shares_and_bound_of_plain_loops():
    """One document entry by entry, with the library's gamma functions checked against known values."""
    assert variational.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235], abs=1e-9)
    assert variational.digamma(np.array([31.5])) == pytest.approx(variational.digamma(np.array([30.5])) + 1 / 30.5, abs=1e-12)
    x = np.array([0.1, 1.7, 8.0, 400.25])
    assert variational.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    weights = np.array([[0.7, 0.1], [0.2, 0.1], [0.1, 0.8]])
    batch = variational.Batch(np.array([0, 2, 1]), np.array([3.0, 1.0, 2.0]), np.array([0, 2, 2, 3]))
    gamma, entry, bound = variational.shares_of(batch, weights, 0.5)
    psi = lambda v: float(variational.digamma(np.array(v)))
    for d, words in enumerate([[(0, 3.0), (2, 1.0)], [], [(1, 2.0)]]):
        g = [0.5 + sum(n for _, n in words) / 2] * 2
        for _ in range(500):
            e = [math.exp(psi(v) - psi(sum(g))) for v in g]
            g = [0.5 + sum(n * e[j] * weights[w][j] / sum(e[i] * weights[w][i] for i in range(2)) for w, n in words) for j in range(2)]
        assert gamma[d] == pytest.approx(g, abs=5e-3)
        e = [psi(v) - psi(sum(g)) for v in g]
        told = sum(n * math.log(sum(math.exp(e[j]) * weights[w][j] for j in range(2))) for w, n in words)
        told += math.lgamma(1.0) - 2 * math.lgamma(0.5) - math.lgamma(sum(g)) + sum(map(math.lgamma, g)) + sum((0.5 - v) * x for v, x in zip(g, e))
        assert bound[d] == pytest.approx(told, abs=1e-4)
    assert entry.sum() == pytest.approx(6.0)
