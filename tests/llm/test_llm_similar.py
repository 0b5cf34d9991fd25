import random

import corpus_pipeline
from rallylens.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    """Smallest linked index of every text, all pairs compared."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted(rng):
    """Edited copies with one word in fifty replaced, chains, and texts just below 0.8."""
    texts = []
    for n in (50, 60, 100, 200, 400):
        for _ in range(5):
            base = [f"w{rng.randrange(9000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (n // 50, n // 50, n // 25, n // 12):
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = f"new{rng.randrange(9000)}"
                texts.append(" ".join(copy))
                base = copy if edits == n // 50 else base
    return texts


def test_groups_are_those_of_all_pairs(spark, documents):
    texts = [*planted(random.Random(7)), None, "", " \n", "one two", "One  TWO", "one two three"]
    rows = similar.grouped(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.label, r.doc_id)
    assert [first[r.label] for r in sorted(rows)] == groups(texts)


def test_fingerprint_chains_link_the_sets(spark, documents, monkeypatch):
    """Without any band key the chains still group what is a few bits apart, and the exact check holds them to 0.8."""
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    rows = [(i, similar.shingle_set(t)) for i, t in enumerate(texts)]
    prints = {i: similar.set_fingerprint(s) for i, s in rows}
    df = spark.createDataFrame(list(prints.items()), "v long, fp long")
    got = {frozenset((r.a, r.b)) for r in similar.ring_pairs(df).collect()}
    near = {frozenset((i, j)) for i in prints for j in range(i) if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= similar.RADIUS}
    assert got == near and len(near) >= 30
    monkeypatch.setattr(similar, "stars", lambda posts: posts.select(posts.v.alias("a"), posts.v.alias("b")).limit(0))
    monkeypatch.setattr(similar, "prefix_pairs", lambda sets: sets.select(sets.v.alias("a"), sets.v.alias("b")).limit(0))
    found = {r.doc_id: r.label for r in similar.grouped(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert all(found[min(p)] == found[max(p)] for p in near) and len(set(found.values())) == 80 - len(near)


def test_one_large_group_of_edited_copies(spark, documents):
    """Copies with one to sixty words changed: most link with the origin only, the rest with nobody or each other."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for n in range(700):
        copy = list(base if n % 9 else base[: 120 + n % 30])
        for at in rng.sample(range(len(copy)), 1 + n % 60 % rng.choice([8, 20, 60])):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    rows = similar.grouped(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.label, r.doc_id)
    expected = groups(texts)
    assert [first[r.label] for r in sorted(rows)] == expected and len(set(expected)) > 50


def test_prefix_join_finds_every_similar_pair(spark):
    """Sets with shared parts of many sizes, each its own component, against all pairs."""
    rng = random.Random(5)
    sets = []
    for _ in range(40):
        base = [rng.randrange(3000) for _ in range(rng.choice([1, 4, 9, 45, 90]))]
        for _ in range(6):
            kept = [x for x in base if rng.random() < rng.choice([1, 0.95, 0.8])]
            sets.append(sorted({*kept, *[rng.randrange(10**9) for _ in range(len(base) // rng.choice([4, 10, 30]))]}) or [1])
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "v long, l long, shingles array<long>")
    got = {frozenset(map(int, r)) for r in similar.prefix_pairs(df).collect()}
    pairs = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if alike(set(sets[i]), set(sets[j]))}
    assert pairs and pairs <= got


def test_stage_drops_planted_edited_copies(spark, sf, documents):
    rng = random.Random(3)
    rows = []
    for i in range(100):
        words = [f"w{rng.randrange(9000)}" for _ in range(50 + i)]
        copy = list(words)
        copy[20] = "edited"
        rows += [(i, " ".join(words), "en", "s"), (1000 + i, " ".join(copy), "en", "s")]
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))


def test_ids_do_not_decide_groups(documents):
    """One id on two different texts keeps both; rows without ids keep one of each group."""
    rows = [(5, "first text of five words", "en", "a"), (5, "second text with other words", "en", "b"), (None, "no id but text here", "en", "c"), (None, "No id but  text here", "en", "c")]
    assert similar.drop_near_duplicates(documents(rows)).count() == 3


def test_recall_of_all_pairs_of_the_tables(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    sets = [similar.shingle_set(t) for t in texts]
    keys = [set(similar.band_keys(s)) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar.jaccard(sets[i], sets[j]) >= similar.SIMILARITY]
    assert pairs and all(keys[i] & keys[j] for i, j in pairs)


def test_empty_table(empty):
    assert similar.grouped(empty).collect() == [] and similar.drop_near_duplicates(empty).collect() == []


def test_least_language_score_does_not_depend_on_how_many():
    """One best language of weight w against others of 1 each is kept or not for every count alike."""
    for w, kept in ((1.2, False), (1.4, True)):
        for n in (2, 3, 4, 10, 300):
            assert (w / (w + n - 1) >= corpus_pipeline.least_score(n)) is kept
    assert abs(corpus_pipeline.least_score(4) - corpus_pipeline.LEAST_SCORE) < 1e-12 and corpus_pipeline.least_score(1) <= 1
