import random

import xxhash

from rallylens.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints():
    texts = [None, "", " \t\n", "One", "one  TWO", "a b c d", "é É\x0bß x y z", "r s t " * 9000]
    assert [simhash.text_fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert simhash.text_fingerprint("A  b\nC") == simhash.text_fingerprint("a b c")


def near(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) - (1 << 62) for _ in range(60)]
    fps = set(base) | {0, -1}
    for b in base:
        for flips in (1, 2, 2, 3):
            v = (b & ((1 << 64) - 1)) ^ sum(1 << i for i in rng.sample(range(64), flips))
            fps.add(v - (1 << 64) if v >> 63 else v)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (0, 1, 2, 3):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if near(a, b) <= radius}
        assert {(r.a, r.b) for r in simhash.links(df, radius).collect()} == want


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.l for r in simhash.components(pairs).collect()}
    assert set(got) == set(range(41)) | {100, 101}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_groups_and_survivors(documents):
    same = "the same words again and again in one text"
    rows = [(5, same, "en", "a"), (3, same.upper(), "de", "b"), (None, same, "en", "c"), (7, None, "en", "d"), (6, "", None, "e"), (9, "other words stand here alone", "en", "f"), (9, "other words stand here alone", "en", "f"), (None, "without any id this one", "en", None)]
    docs = documents(rows)
    got = simhash.grouped(docs)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == sorted(
        [("5", "3"), ("3", "3"), ("None", "3"), ("7", "6"), ("6", "6"), ("9", "9"), ("9", "9"), ("None", "None")]
    )
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "9", "None"]


def test_empty_table(empty):
    assert simhash.grouped(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []
