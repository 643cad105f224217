import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from geoview.llm import near_dup
from geoview.llm.shingles import shingle_hashes, word_hashes


def brute_force(rows, threshold=0.8):
    """(class, links, copies) for every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, copies = [0] * len(rows), [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if not a or not b:
            continue
        if a == b:
            copies[i] += 1
            copies[j] += 1
        elif len(a & b) < threshold * len(a | b):
            continue
        else:
            links[i] += 1
            links[j] += 1
        root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, min(ids) if ids else None, links[i], copies[i] + 1 if sets[i] else 0))
    return sorted(out, key=repr)


def copies_of(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(text(rng.randint(1, 120))) for _ in range(60)]
    for n, changes in ((12, 2), (30, 3), (5, 0), (8, 8)):
        texts += copies_of(rng, text(150), n, changes)
    shared = " ".join(text(60))
    texts += [" ".join(text(40)) + " " + shared for _ in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in near_dup.near_duplicates(df).collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_force(rows)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(near_dup, "HOT_ROWS", 3)
    assert result(df) == want


def test_edge_cases(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(odd_docs) == brute_force(rows)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_one_of_each_class_stays(spark, odd_docs):
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.select("doc_id", "text").collect())
    ids = [i for none, i, _ in got if not none]
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] and sum(none for none, _, _ in got) == 1
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, c, _, _ in brute_force(rows)}
    assert {r["doc_id"] for r in near_dup.keep_one(df).collect()} == want


def test_prefixes_are_shortened_until_recall_is_reached():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 16, (500, near_dup.TREES * near_dup.DEPTH), dtype=np.uint16)
    sample[:, : 5 * near_dup.DEPTH] %= 2  # the first five trees are crowded
    depths = near_dup.tree_depths(sample, 0.8)
    assert near_dup.chance(depths, 0.8) >= near_dup.RECALL
    assert near_dup.chance([d + 1 for d in depths], 0.8) < near_dup.RECALL
    assert min(depths[:5]) > max(depths[5:])
    assert near_dup.chance(near_dup.tree_depths(sample[:0], 0.8), 0.8) >= near_dup.RECALL


def test_linked_sets_by_both_ways_of_counting(monkeypatch):
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    make = lambda n: [np.unique(np.concatenate([core[: rng.integers(85, 101)], rng.integers(0, 1 << 60, rng.integers(0, 15), dtype=np.uint64)])) for _ in range(n)]
    left, right = make(30), make(20)
    for few in (0, 8, 1000):
        monkeypatch.setattr(near_dup, "FEW", few)
        for a, b, alone in ((left, right, False), (left, left, True)):
            got = near_dup._linked(a, b, 0.8, alone)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if not (alone and i == j):
                        assert got[i, j] == (len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)))


def test_recall_on_thousands_of_documents(spark):
    """Chains and clusters of changed copies, some near the threshold: links are
    those of comparing all pairs of a family, classes follow from them."""
    rng = random.Random(12)
    families, rows = [], []
    for f in range(150):
        w = [f"f{f}w{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        texts = copies_of(rng, w, rng.randint(1, 30), max(1, len(w) // 45))
        families.append(list(range(len(rows), len(rows) + len(texts))))
        rows += list(enumerate(texts, len(rows)))
    rng.shuffle(order := list(rows))
    got = result(spark.createDataFrame(order, "doc_id long, text string").repartition(6))
    want = sorted((r for ids in families for r in brute_force([rows[i] for i in ids])), key=repr)
    assert len(rows) > 2000
    assert got == want


def test_many_repeats_of_a_row(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(200_000).select(F.lit(7).alias("doc_id"), F.lit(long).alias("text")).unionByName(spark.createDataFrame([(8, long + " more"), (9, "other")], "doc_id long, text string"))
    got = {tuple(r): r["count"] for r in near_dup.near_duplicates(docs).groupBy("doc_id", "class_id", "n_links", "n_copies").count().collect()}
    assert {k[:4]: n for k, n in got.items()} == {(7, 7, 1, 200_000): 200_000, (8, 7, 200_000, 1): 1, (9, 9, 0, 1): 1}
    assert near_dup.keep_one(docs).count() == 2


def test_leaders_of_hot_prefixes_meet_in_blocks(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name, value in (("HOT_SAMPLE", 1.0), ("HOT_ROWS", 3), ("SALT_ROWS", 2), ("LEADERS", 2), ("HUB_ROWS", 3), ("REPEATS", 0), ("BLOCK_SHINGLES", 500)):
        monkeypatch.setattr(near_dup, name, value)
    assert result(df) == brute_force(rows)


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for shared in (100, 600, 800):
        a, b = np.unique(base), np.unique(np.concatenate([base[:shared], rng.integers(0, 1 << 63, 900 - shared, dtype=np.uint64)]))
        bits = near_dup._nibbles(near_dup.signature([a, b]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dup.estimates(bits[0], bits[1:])[0] - true) < 0.17


def test_components_on_a_path(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(100, 103).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r["node"]: r["comp"] for r in near_dup.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 104)} == {100}
    assert near_dup.components(edges.limit(0)).count() == 0


def test_shingles():
    words = word_hashes(["One two, THREE four five six", "one two", "", None])
    assert [len(shingle_hashes(w)) for w in words] == [2, 1, 0, 0]
    assert word_hashes(["ONE two three four five"])[0].tolist() == words[0][:5].tolist()
