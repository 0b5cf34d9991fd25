import random
import re

import pytest

from rallylens.llm import decontaminate as dec

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def expected(text, items, size=10):
    said, hit, named = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            window = w[i : i + size]
            for at in range(len(said) - len(window) + 1):
                if said[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    named.add(item)
    return len(said), len(hit), len(named), sorted(map(str, named))


@pytest.fixture(scope="module")
def case(spark, documents):
    rng = random.Random(3)
    pool = ["the", "of", "a", "École", "x1", "Élan", "rare", "Word", "K", "K"] + [f"w{i}" for i in range(30)]
    passage = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(1, passage(14)), (2, passage(11)), (2, passage(11)), (3, "the"), (4, None), (5, "..."), (10, passage(10)), (None, passage(12)), (6, "Élan vital of The End")]
    texts = [None, "", "... !", passage(400), passage(20000)]
    texts += [f"{passage(20)}, {t.upper() if t.isascii() else t}\n{passage(5)}" for _, t in items if t]
    texts += [t.replace("É", "é") for t in texts if t][:3] + ["the"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return documents([*rows, rows[6], (None, texts[6], None, None)]), spark.createDataFrame(items, "item_id long, text string"), items, texts


def test_report_is_that_of_brute_force(case):
    docs, bench, items, texts = case
    rows = dec.report(docs, bench).collect()
    assert len(rows) == len(texts) + 2
    named = [(i, t) for i, t in items if i is not None]
    for r in rows:
        text = texts[6 if r.doc_id is None else r.doc_id]
        n_words, n_hit, n_items, ids = expected(text, named)
        n_hit = expected(text, items)[1]  # an item without an id hits but has no name
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids) == (n_words, n_hit, n_items, ids)


def test_clean_documents_stay(case):
    docs, bench, items, texts = case
    left = sorted(r.doc_id for r in dec.drop_contaminated(docs, bench).collect())
    assert left == [i for i, t in enumerate(texts) if not expected(t, items)[1]]
    assert dec.drop_contaminated(docs, bench).columns == docs.columns


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = documents([(1, "one two three four six five seven eight nine ten", "en", "s"), (2, "one two only", "en", "s")])
    assert dec.matches(docs, bench).collect() == []
    assert [(r.doc_id, r.same) for r in dec.matches(docs, bench, proximity=9).collect()] == [(1, 10)]


def test_empty_tables(spark, case, empty):
    docs, bench, _, texts = case
    assert dec.report(empty, bench).collect() == []
    nothing = bench.limit(0)
    assert {r.n_hit for r in dec.report(docs, nothing).collect()} == {0}
    assert dec.drop_contaminated(docs, nothing).count() == len(texts) + 2
