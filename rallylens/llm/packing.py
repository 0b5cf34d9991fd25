"""Packing of token sequences by patterns fitted with non-negative least squares.

Texts are tokenised whole, cut into pieces of at most ``size`` ids, and only
the lengths go on.  On the histogram of lengths (at most ``size`` counts, all
that reaches the driver) patterns of few different lengths that nearly fill a
sequence are fitted: non-negative repeat counts whose pieces come closest to
the histogram in the least-squares sense.  Counts are rounded down and the rest
is fitted again; what is left at last is packed best fit, longest first.  A plan says, for each
length, which ranks go to which sequences; pieces are ranked within their
length in cells, so no length is gathered, and look their place up.

Defined results: a null text is empty; an empty text is its end id alone; equal
rows are separate pieces; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import sys
import types
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.ranks import cells, ranked, unit
from rallylens.llm.tables import text_key
from rallylens.storage import landed

END = 0
EDGE = r"""!"#$%&()*+,-./:;=?@[\]^_`{}~"""  # cut off a word's ends: never one token with letters, part of a contraction or a special token
MARK = "0"  # a digit is always a token of its own
CACHED_WORDS = 700_000


def plain(c: str) -> bool:
    """Whether a character is a letter or digit that no normal form joins with what follows."""
    return c < "\u0250" and c.isalnum()


class WordIds:
    """Ids of space-separated words; each distinct word is encoded once per worker.

    The vocabulary's tokenizer lower-cases and never joins across white space,
    so a text's ids are those of its words.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(vocabulary)
        self.mark = self.encoder.encode(MARK, add_special_tokens=False).ids[0]
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before, many in one call with marks between."""
        unmarked = [w for w in words if MARK not in w]
        for at in range(0, len(unmarked), 2000):
            part = unmarked[at : at + 2000]
            ids = self.encode(f" {MARK} ".join(part))
            stops = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, stops, strict=True):
                self.known[word] = raw[4 * start : 4 * stop]
                start = stop + 1
        for word in words:
            if MARK in word:
                self.known[word] = self.encode(word).tobytes()

    def lookup(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
            known[""] = b""
        cut: dict[str, tuple[str, str, str]] = {}
        parts: set[str] = set()
        for word in words:
            if word in known:
                continue
            right = word.rstrip(EDGE)
            base = right.lstrip(EDGE)
            if base and base != word and plain(base[0]) and plain(base[-1]):
                cut[word] = made = (right[: len(right) - len(base)], base, word[len(right) :])
                parts.update(made)
            else:
                parts.add(word)
        self.learn([w for w in parts if w not in known])
        for word, (head, base, tail) in cut.items():
            known[word] = known[head] + known[base] + known[tail]
        return [known[w] for w in words]


def worker_encoder(vocabulary: str) -> WordIds:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    held = sys.modules.setdefault("_rallylens_encoders", types.ModuleType("_rallylens_encoders")).__dict__
    name = f"v{zlib.crc32(vocabulary.encode())}"
    if name not in held:
        held[name] = WordIds(vocabulary)
    return held[name]


def batch_ids(texts: pa.Array, encoder: WordIds) -> list[bytes]:
    """The ids of each text, little-endian, four bytes an id."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    # ASCII capitals change nothing but special-token strings, which stay as written.
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(texts)
    bounds = words.offsets.to_numpy()
    codes = words.flatten().dictionary_encode()
    found = encoder.lookup(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
    of = codes.indices.to_numpy()
    told = []
    for start, stop in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), strict=True):
        told.append(b"".join(map(found.__getitem__, of[start:stop].tolist())))
    return told


def text_pieces(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of one text's ids and its end id."""
    view = memoryview(ids + END.to_bytes(4, "little"))
    length = len(view) // 4
    return [(piece, at, min(size, length - at), zlib.crc32(view[4 * at : 4 * (at + size)])) for piece, at in enumerate(range(0, length, size))]


PIECES = "doc_id long, h long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """doc_id, h (a hash of id and text), piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            per_text = [text_pieces(ids, size) for ids in batch_ids(batch.column("text"), encoder)]
            rows = np.repeat(np.arange(len(per_text)), [len(p) for p in per_text])
            columns = list(zip(*[p for made in per_text for p in made])) or [[], [], [], []]
            taken = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:])]], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("doc_id", F.lit(0)), text_key()).alias("h"), "text")
    return source.mapInArrow(cut, PIECES)


Way = tuple[tuple[int, int], ...]  # (length, how often) of a pattern's pieces, longest first


def patterns(counts: np.ndarray, size: int, most: int = 20_000) -> list[Way]:
    """Ways to fill ``size`` with m pieces of one length, n of another and one more, with little waste.

    The last piece is the longest that still fits.  Of the ways led by a length
    those with the least waste stay; about ``most`` are looked at, spread over
    all lengths.
    """
    present = np.flatnonzero(counts)
    fits = np.zeros(size + 1, dtype=np.int64)  # the longest present length up to each
    fits[present] = present
    fits = np.maximum.accumulate(fits)
    rows = []
    for at, a in enumerate(present[::-1].tolist()):
        times = [m for m in (1, 2, 4, 8, 16, 32) if m * a <= size and m <= counts[a]]
        below = present[present <= min(a, size - a)]
        step = max(1, len(below) * len(times) * 4 * len(present) // most)
        for m in times:
            left = size - m * a
            rows.append(np.array([[a, m, 0, 0, fits[min(left, a)]]]))
            b = below[(at + m) % step :: step]
            b = b[b <= left]
            for n in (np.ones_like(b), left // b, np.maximum(left // b - 1, 1), (left // b + 1) // 2):
                n = np.minimum(n, counts[b])
                rows.append(np.column_stack([np.full(len(b), a), np.full(len(b), m), b, n, fits[np.minimum(left - n * b, b)]]))
    ways = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 5), dtype=np.int64)
    waste = size - ways[:, 0] * ways[:, 1] - ways[:, 2] * ways[:, 3] - ways[:, 4]
    least = np.full(size + 1, size)
    np.minimum.at(least, ways[:, 0], waste)
    return [named([a] * m + [b] * n + [c]) for a, m, b, n, c in ways[waste <= least[ways[:, 0]]].tolist()]


def named(pieces: Iterable[int]) -> Way:
    return tuple(sorted(Counter(p for p in pieces if p).items(), reverse=True))


def non_negative_fit(ways: list[Way], counts: np.ndarray, sequences: int, weight: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' pieces closest to ``counts``.

    One more row, weighed by ``weight``, draws their sum to ``sequences``, so
    that patterns with little waste are preferred.  Accelerated projected
    gradient; a round is linear in the number of patterns.
    """
    of = np.array([i for i, w in enumerate(ways) for _ in w])
    length = np.array([p for w in ways for p, _ in w])
    times = np.array([float(k) for w in ways for _, k in w])

    def back(made: np.ndarray, total: float) -> np.ndarray:
        return np.bincount(of, times * made[length], len(ways)) + weight * total

    def made(x: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(length, times * x[of], len(counts)), weight * x.sum()

    v = np.ones(len(ways))
    for _ in range(20):
        v = back(*made(v))
        largest = np.linalg.norm(v)
        v /= largest
    x = np.zeros(len(ways))
    y, t = x, 1.0
    for _ in range(rounds):
        pieces, total = made(y)
        new = np.maximum(0.0, y + back(counts - pieces, weight * sequences - total) / (1.02 * largest))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts that pack the counts ``left``, longest first, best fit."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((pattern, n))

    for length in range(size, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = size // length
                put(size - each * length, (length,) * each, todo // each)
                rest = todo % each
                put(size - rest * length, (length,) * rest, 1 if rest else 0)
                break
            space = spaces[at]
            pattern, n = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(at)
            each = space // length
            full = min(n, todo // each)
            put(space - each * length, pattern + (length,) * each, full)
            todo -= full * each
            if full < n:
                rest = min(todo, each)
                put(space - rest * length, pattern + (length,) * rest, 1)
                put(space, pattern, n - full - 1)
                todo -= rest
    return [p for space in spaces for p in room[space]]


REFITS, PRUNES = 4, 3


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece is in exactly one.

    What the rounded counts leave is fitted again; the patterns best fit would
    use on it are candidates too.  A fit is repeated on its strongest patterns,
    as many as there are lengths, so that counts are large enough to round.
    """
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    for refit in range(REFITS):
        if not left.any():
            break
        ways = list(dict.fromkeys([*patterns(left, size), *(named(p) for p, _ in best_fit(left, size))]))
        sequences = -(-int(left @ np.arange(size + 1)) // size)
        for _ in range(PRUNES):
            x = non_negative_fit(ways, left.astype(float), sequences)
            top = np.argsort(-x, kind="stable")[: max(8, np.count_nonzero(left))]
            top = top[x[top] > 1e-6]
            ways, x = [ways[i] for i in top], x[top]
        used = 0
        for way, want in zip(ways, x.tolist(), strict=True):
            n = min(int(want + (0.5 if refit > 1 else 0.0)), *(int(left[p]) // k for p, k in way))
            if n > 0:
                chosen.append((tuple(p for p, k in way for _ in range(k)), n))
                used += n
                for p, k in way:
                    left[p] -= k * n
        if not used and refit > 1:
            break
    return chosen + best_fit(left, size)


class Places:
    """For a length and a rank within it: the sequence and the offset there."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], size: int):
        used = np.zeros(size + 1, dtype=np.int64)
        rows, sequence = [], 0
        for parts, n in chosen:
            offset = 0
            for p in parts:
                rows.append((p, used[p], sequence, offset))
                used[p] += n
                offset += p
            sequence += n
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.keys = (table[:, 0] << 48) + table[:, 1]
        self.ranks, self.sequences, self.offsets = table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length.astype(np.int64) << 48) + rank, side="right") - 1
        return self.sequences[at] + rank - self.ranks[at], self.offsets[at]


def pack(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, vocabulary, size)
    rows = landed(cut.groupBy(*cut.columns).agg(F.count("*").alias("copies")), "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in rows.groupBy("length").agg(F.sum("copies")).collect():
        counts[length] = n
    places = Places(plan(counts, size), size)
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.arrow_udf(place)
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = places.find(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    told = ranked(rows.withColumn("u", unit(F.col("h"))), ["length"], F.col("u"), ["u", "h", "doc_id", "piece", "ids_crc32"], cells(int(counts.sum())))
    told = told.withColumn("p", placed.asNondeterministic()("length", "rank"))
    return told.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "p.sequence_id", "p.offset")
