import zlib

import numpy as np
import pytest

from rallylens.llm import packing
from rallylens.llm.registry import vocabulary

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return vocabulary("word_bpe_49k.json")


TEXTS = [
    None, "", " \n", "Hello, world.", "It's the end. Don't!", "ÉCOLE İstanbul ΣΑΣ é ﬁ  x\x1cy", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "1990 0 10. 0.5, x0.", "word " * 5000, "a.. b,. 日本語 😀.", "naïve…, w..", "##Größe$$$ (it's) -'s' ***a'S! x.'ll \"1990\" <b>. é\u0301, _a_ ²,",
]


def test_pieces_have_the_ids_of_the_tokenizer(documents, vocab):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s"), (None, "x", None, None)])
    encoder = tokenizers.Tokenizer.from_str(vocab)
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "x")]:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    rows = packing.pack(docs, vocab, 512).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    placed = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    room = {}
    for s, offset, length in placed:
        assert offset == room.get(s, 0)
        room[s] = offset + length
    assert max(room.values()) <= 512
    assert len(room) == -(-sum(r.length for r in rows) // 512)


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(1)
    for low, high in ((1, 257), (100, 257), (1, 30), (256, 257), (50, 86), (3, 4)):
        counts = np.bincount(rng.integers(low, high, 4000), minlength=257)
        chosen = packing.plan(counts, 256)
        used = np.zeros(257, dtype=np.int64)
        for parts, n in chosen:
            assert sum(parts) <= 256 and n > 0
            for p in parts:
                used[p] += n
        assert (used == counts).all()
        alone = sum(n for _, n in packing.best_fit(counts, 256))
        assert sum(n for _, n in chosen) <= 1.005 * alone + 1


def test_fitted_patterns_beat_best_fit_where_it_wastes():
    counts = np.bincount(np.random.default_rng(2).integers(400, 681, 4000), minlength=2049)
    fitted, alone = (sum(n for _, n in made) for made in (packing.plan(counts, 2048), packing.best_fit(counts, 2048)))
    assert fitted < 0.96 * alone


def test_patterns_fit_and_their_repeat_counts_meet_the_histogram():
    ways = packing.patterns(np.array([0, 4, 9, 3, 0, 5, 6, 0, 0]), 8)
    assert ((5, 1), (3, 1)) in ways and ((6, 1), (2, 1)) in ways and ((2, 4),) in ways
    assert all(sum(p * k for p, k in w) <= 8 for w in ways)
    x = packing.non_negative_fit([((5, 1), (3, 1)), ((2, 4),)], np.array([0, 0, 8, 6, 0, 6, 0, 0, 0.0]), 8)
    assert np.allclose(x, [6, 2], atol=0.01)


def test_empty_table(empty, vocab):
    assert packing.pack(empty, vocab).collect() == []
