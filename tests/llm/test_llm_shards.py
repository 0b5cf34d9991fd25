import zlib
from collections import Counter

from rallylens.llm import shards


def test_counts_mixture_slots_and_sums(documents):
    rows = [(i, f"text {i} é" if i % 9 else None, "en", "big" if i % 3 else (None if i % 2 else f"s{i % 4}")) for i in range(503)]
    rows += [(7, "again", "en", "big")] * 40
    got = shards.shard(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for source, n in Counter(r[3] for r in rows).items():
        of = Counter(r.shard for r in got if r.source == source)
        assert max(of.values()) - min(of.get(k, 0) for k in range(8)) <= 2 and sum(of.values()) == n
    texts = {r[0]: r[1] for r in rows[:503]}
    for r in got:
        if r.text_crc32 != zlib.crc32(b"again"):
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_same_shards_for_any_layout(documents):
    docs = documents([(i, str(i), "en", f"s{i % 3}") for i in range(100)])
    a, b = (sorted(map(str, shards.shard(docs.repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_few_rows_and_none(documents, empty):
    assert [(r.shard, r.slot) for r in shards.shard(documents([(None, None, None, None)])).collect()] == [(0, 0)]
    assert shards.shard(empty).collect() == []
