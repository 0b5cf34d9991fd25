import hashlib
import zlib
from collections import defaultdict

from rallylens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in made.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    nodes = set(members)
    out = []
    for node in nodes:
        below = [v for v in nodes if v[: len(node)] == node]
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        leaves = [v for v in below if not any(w[:-1] == v for w in nodes if w)]
        ends = sorted(c for c, said in made.items() if tuple(said) == node)
        children = sum(1 for w in nodes if w and w[:-1] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), children, len(leaves), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def nodes_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(*trie.rebuilt(trie.turns(df))).collect()), key=repr)


def test_all_nodes_with_shared_turns_copies_and_odd_rows(spark):
    rows = []
    for c in [*range(0, 130), 205, 300, 301, -7, -100, 10**17]:
        for t in range(c % 7 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", ["hi", "é" * 3, "", "long " * 20][(c // 3 + t) % 4]))
    rows += [(c, t, "user", f"same {t}") for c in range(400, 500, 2) for t in range(7)]  # many copies
    rows += [(500, None, None, None), (500, None, "user", "b"), (500, 0, "user", "a"), (500, 0, "user", "a"), (None, 0, "user", "no id"), (501, 3, "us", "erab"), (502, 3, "user", "ab")]
    assert nodes_of(spark, rows) == brute(rows)


def test_a_conversation_of_thousands_of_turns_and_equal_rows(spark):
    rows = [(100, t // 2, "user", f"{t % 5}") for t in range(2500)] + [(103, 0, "user", "again")] * 900 + [(101, 1, "user", "")]
    got = nodes_of(spark, rows)
    depths = [r[1] for r in got if r[0] == 100]
    assert max(depths) == 2500 and len(got) > 2500
    small = [(100, t // 2, "user", f"{t % 5}") for t in range(25)] + [(103, 0, "user", "again")] * 9 + [(101, 1, "user", "")]
    assert nodes_of(spark, small) == brute(small)
    saved = {r[1]: r[6] for r in got if r[0] == 100}
    turns = sorted((t // 2, f"{t % 5}") for t in range(2500))
    h = zlib.crc32(b"103") % 6
    assert saved[0] == sum(len(x) for _, x in turns[:h]) + sum(len(x) for _, x in turns[: zlib.crc32(b"101") % 6])


def test_ends_are_hashed_over_many_pieces(spark):
    ids = [*range(-3000, 9000, 3), 5 * 10**12]
    df = spark.createDataFrame([(b"n", i) for i in ids] + [(b"m", 4)], "node binary, conv_id long")
    got = {bytes(r.node): r.ends_sha256 for r in trie.ends_hashed(df).collect()}
    assert got == {b"n": sha(",".join(map(str, ids))), b"m": sha("4")}


def test_empty_table(spark):
    assert nodes_of(spark, []) == []
