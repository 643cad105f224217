import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from geoview.llm import trie
from geoview.llm.queries import op11_prefix_trie

TURNS = "conv_id long, turn long, role string, text string, words int, depth int, turns string"


def brute(rows):
    """Nodes by their whole sequence of turns, straight from the definition."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c > 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    below = {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves, saved = int(not kids[n]), (len(members[n]) - 1) * words
        for k in kids[n]:
            leaves, saved = leaves + below[k][0], saved + below[k][1]
        below[n] = leaves, saved
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], TURNS)
    got = trie.prefix_trie(trie.branched(table))
    return sorted(tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, convs=120):
    """Conversations with few kinds of turns, so that many prefixes and whole
    conversations are equal, and long ones among them."""
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        n = 300 if c == 40 else r.choice([0, 1, 1, 2, 3, 4, 7])
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d  e\tf"]) if t > 1 else "hello you") for t in range(n)]
    return rows


def test_trie_equals_brute_force(spark, many_parts):
    rows = made(1)
    assert found(spark, rows) == brute(rows)


def test_odd_turns(spark):
    rows = [
        (None, 1, "user", "lost"), (1, None, None, None), (1, 2, "user", "x y"), (1, 2, "user", "x y"), (1, 2, None, "x y"), (5, 0, "", ""), (5, None, "user", ""),
        (-3, 1, "user", "q"), (0, 1, "user", "q"), (20, 0, "a", "ünï   cöde"), (21, 0, "a", "z" * 100_000), (23, None, None, None), (60, 0, "user", "only"), (66, 0, "user", "one"), (41, 0, "u", "w"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []


def test_chunks_add_up():
    """However sorted strings are cut, chunks' rows add up to those of one tree."""
    r = random.Random(5)
    ids = [bytes([b]) * 15 + bytes([c]) for b in (0, 7, 255) for c in (0, 1, 200)]
    keys = sorted({b"".join(r.choice(ids) for _ in range(r.choice([0, 1, 2, 3, 5, 40]))) for _ in range(300)})
    words = [b"".join((k[i] + k[i + 15]).to_bytes(4, "big") for i in range(0, len(k), 16)) for k in keys]
    counts, convs = [r.randint(1, 3) for _ in keys], r.sample(range(10_000), len(keys))

    def nodes(size):
        met, rows = {}, []
        for a in range(0, len(keys), size):
            e = min(a + size, len(keys))
            before = trie.shared(keys[a - 1], keys[a]) // 16 if a else -1
            behind = trie.shared(keys[e - 1], keys[e]) // 16 if e < len(keys) else -1
            rows += trie.chunk_nodes(keys[a:e], words[a:e], counts[a:e], convs[a:e], before, behind, e < len(keys) and keys[e].startswith(keys[e - 1]))
        for row in rows:
            if row[9]:
                old = met.get(row[10], (None, 0, 0, 0, 0, 0))
                met[row[10]] = (row[0] if old[0] is None else min(old[0], row[0]), *[x + y for x, y in zip(old[1:], row[3:8])])
        out = [(*met[row[10]][:1], row[1], *met[row[10]][1:]) if row[9] else (row[0], row[1], *row[3:8]) for row in rows]
        return sorted(set(out)), all(not row[9] or row[11] in met or row[1] == 0 for row in rows)

    whole = nodes(len(keys))
    assert whole[1] and len(whole[0]) > len(keys)
    for size in (1, 2, 7, 50):
        assert nodes(size) == whole


def test_layouts_grow_and_find():
    tree = trie.RadixTree()
    keys = [bytes([b, c]) * 8 for b in range(256) for c in (1, 2)] + [b"", bytes(16), bytes(32), bytes(31) + b"\1"]
    for i, k in enumerate(keys):
        tree.insert(k, i)
    assert tree.root.size == 256
    seen, todo = {}, [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        at = above + node.path
        if node.end >= 0:
            seen[at] = node.end
        assert node.size in (4, 16, 48, 256) and len(node.children()) <= node.size
        todo += [(c, at) for c in node.children()]
    assert seen == {k: i for i, k in enumerate(keys)}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_prefix_trie(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == brute(rows)
