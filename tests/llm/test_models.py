import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from geoview.llm import ann, langid, quality
from geoview.llm.common import held_out
from geoview.llm.queries import QUERIES


def brute_force_bits(texts, text):
    """Prediction by partial matching, straight from its definition."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        x = b"\0\0\0" + t
        for i in range(3, len(x)):
            for k in range(4):
                counts[k][x[i - k : i]][x[i]] += 1
    x, bits = b"\0\0\0" + text, 0.0
    for i in range(3, len(x)):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(x[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if x[i] in seen:
                bits -= math.log2(seen[x[i]] / (total + kinds))
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    langs = {"a": [b"the cat sat on the mat", b"the dog"], "b": ["où est le café".encode(), b"le chat"]}
    lang, gram = [], []
    for i, texts in enumerate(langs.values()):
        for t in texts:
            g = langid._grams(t)
            gram.append(g)
            lang.append(np.full(len(g), i))
    keys, n = np.unique((np.concatenate(lang).astype(np.int64) << 32) | np.concatenate(gram).astype(np.int64), return_counts=True)
    model = langid.Model.fit(list(langs), keys >> 32, keys & 0xFFFFFFFF, n)
    probes = [b"", b"the cat", "été ZZ".encode(), bytes(range(256)), b"le chat sat on the caf" * 9]
    got = model.lengths(probes)
    for p, row in zip(probes, got):
        want = [brute_force_bits(t, p) for t in langs.values()]
        assert np.allclose(row, want, rtol=1e-5), p


def test_long_texts_in_blocks(monkeypatch):
    g = langid._grams(b"abcabcabd")
    model = langid.Model.fit(["x"], np.zeros(len(g), int), g.astype(np.int64), np.ones(len(g), int))
    text = b"abcabd" * 50
    whole = model.lengths([text, b"abc", text])
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(model.lengths([text, b"abc", text]), whole, rtol=1e-5)


def test_language_is_predicted(spark, sf_dir, docs):
    got = QUERIES["op6_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95


def test_language_edge_cases(odd_docs, no_docs):
    model = langid.fit(odd_docs, F.lit(True))
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, model).collect()}
    assert got[(4, None)] == got[(5, "")] == got[(6, "   ")] == got[(9, "12 34 !!")] == ("und", 0.0)
    assert got[(7, "a")][0] == "en"
    assert langid.fit(no_docs, F.lit(True)) == [] and langid.predict(no_docs, []).count() == langid.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, []).collect()} == {"und"}


def test_groups_of_languages_change_nothing(spark, docs, monkeypatch):
    some = docs.select("doc_id", "text", "lang")
    ask = lambda: {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(some, langid.fit(docs, F.lit(True))).collect()}
    want = ask()
    monkeypatch.setattr(langid, "GROUP", 1)
    assert ask() == want and len({lang for lang, _ in want.values()}) > 3


def test_scores_tell_how_far_languages_are_apart(spark, docs):
    models = langid.fit(docs, F.lit(True))
    texts = {r["lang"]: r["text"] for r in docs.filter("lang is not null and n_chars between 300 and 3000").orderBy("doc_id").collect()}
    (a, one), (b, two), *_ = sorted(texts.items())
    rows = [(0, one), (1, two), (2, one[:150] + " " + two[:150]), (3, "1x 7z 9q 4w 0v " * 20)]
    got = {r["doc_id"]: r["score"] for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert min(got[0], got[1]) > max(got[2], got[3]) and all(0 < x < 1 for x in got.values())


def test_language_sample_takes_its_share_of_copies(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    seen = {}
    monkeypatch.setattr(langid.Model, "fit", lambda languages, lang, gram, count: seen.update(zip(gram.tolist(), count.tolist())))
    for text in ("qqqq", "zzzz", "jjjj"):
        langid.fit(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit("xxxx "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang")), F.lit(True))
        copies, others = (seen.get(int.from_bytes(c * 4, "big"), 0) for c in (text[:1].encode(), b"x"))
        assert 60 <= copies <= 145 and 140 <= others <= 265, text
        seen.clear()


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_quality_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op9_quality"](spark, at).join(labels, "doc_id").filter("held_out").collect()
    assert {r["predicted"] for r in got} <= {0, 1} and all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.93


def test_quality_edge_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    out = quality.score(odd_docs, model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows) and "quality_score" in out.columns
    assert quality.score(no_docs, model).count() == 0
    only = quality.fit(odd_docs, labels.filter("quality = 1"), F.lit(True))
    assert {r["score"] for r in quality.score(odd_docs, only).collect()} == {1.0}
    assert {r["score"] for r in quality.score(odd_docs, quality.fit(odd_docs, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (400, 4), dtype=np.uint16)
    queries = codes[:30].copy()
    queries[:, 0] ^= rng.integers(0, 1 << 16, 30, dtype=np.uint16)
    d = ann.hamming(queries, codes)
    assert all(d[i, j] == sum(int(a ^ b).bit_count() for a, b in zip(queries[i], codes[j])) for i, j in ((0, 0), (3, 9), (29, 399)))
    for radius in (0, 3, 8, 17, 30, 64):
        q, r = ann.MultiIndex(codes).within(queries, radius)
        assert set(zip(q.tolist(), r.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(d <= radius)]))


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], dtype=float)
    got = defaultdict(list)
    for r in QUERIES["op7_nearest"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        want = sorted((-s, i) for s, i in zip(score, ids.tolist()) if i != q)[:20]
        assert [k for k, _, _ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0), (20, 4, 0)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_nearest_recall_on_a_table_sorted_by_clusters(spark):
    rng = np.random.default_rng(1)
    clusters = []
    for n, spread in ((300, 0.05), (1500, 0.3), (1500, 1.0)):
        at = rng.normal(size=16)
        clusters.append(3 * at / np.linalg.norm(at) + spread * rng.normal(size=(n, 16)))
    x = np.concatenate(clusters)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / len(range(0, len(x), 20)) / 20 >= 0.95


def test_probes_by_flips_and_by_values_agree():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 1 << 16, (3000, 4), dtype=np.uint16)
    table = ann.HashTable(codes, 1)
    for flips in (0, 1, 2, 4, 9):
        q, r = table.probe(codes[:20], flips)
        want = np.nonzero(np.bitwise_count(codes[:20, 1, None] ^ codes[None, :, 1]) <= flips)
        assert set(zip(q.tolist(), r.tolist())) == set(zip(*[x.tolist() for x in want])) and len(q) == len(want[0])
    assert ann.flip_count(2) < len(table.values) < ann.flip_count(9)


def clusters(rows, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(rows // 40, 32))
    x = np.concatenate([at + 0.15 * rng.normal(size=at.shape) for _ in range(40)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_probing_spares_most_pairs_of_tables_with_structure():
    shares = []
    for rows in (800, 4000):
        x = clusters(rows)
        x = x[np.random.default_rng(1).permutation(len(x))]
        coder = ann.fit(x, len(x), float(np.linalg.norm(x, axis=1).max()), float(np.abs(x).max()), 20)
        shares.append((coder.touched, coder.kept))
    assert all(touched < 0.5 for touched, _ in shares) and shares[1][1] < 0.03 and shares[1][1] < shares[0][1]


def test_cells_and_parts_change_nothing(spark, monkeypatch):
    x = clusters(2000)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5000 + i, x[0].tolist()) for i in range(700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()}
    want = ask()
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    assert ask() == want
    # Copies of one vector: ties go to the smaller ids, all of which are there.
    assert [want[(5000, k)][0] for k in range(1, 21)] == [0, *range(5001, 5020)]


def test_nearest_of_very_large_and_mixed_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [-1e200, -1e200]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 0.0, 0.0]), (40, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    inf = float("inf")
    assert got == [(0, 1, 1, inf), (0, 2, 2, -inf), (20, 1, 21, 1.0)]


def test_quality_learns_from_long_texts_and_bounds_its_sample(spark, monkeypatch):
    long = " ".join(["Fine words stand here in good order."] * 3000)
    bad = " ".join(["BUY!! NOW!! $$$ 999%%"] * 5000)
    rows = [(i, long if i % 2 else bad) for i in range(40)] + [(1000, long[:60_000]), (1001, bad[:60_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got[1001] < 0.5 < got[1000] and got[0] < 0.1 and got[1] > 0.9
    # A hot id doesn't fill the sample, and equal labels count once.
    seen = []
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(quality, "train", lambda context, x, y, share: seen.append((len(y), share)))
    hot = docs.unionByName(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("more "), F.col("id").cast("string")).alias("text")))
    quality.fit(hot, labels.unionByName(labels), F.lit(True))
    assert seen[0][0] <= 80 and seen[0][1] == 0.5


def test_pooled_features_against_their_definition(spark):
    texts = ["aa bb aa aa", "", None, "Zq9% bb", "x" * 100 + " yy"]
    context = quality.context_vectors(spark.createDataFrame([("aa bb cc aa bb",)] * 6, "text string"))
    assert set(context) == {"aa", "bb", "cc"}
    pairs = Counter()
    w = "aa bb cc aa bb".split()
    for i in range(5):
        for j in range(max(0, i - 2), min(5, i + 3)):
            if i != j:
                pairs[(w[i], w[j])] += 6
    for word in context:
        v = sum(np.log1p(n) * quality.index_vector("word " + b) for (a, b), n in pairs.items() if a == word)
        assert np.allclose(context[word], v / np.linalg.norm(v), atol=1e-5)
    got = quality.WordTable(context).pooled(texts)
    for text, row in zip(texts, got):
        words = (text or "").split()
        vectors = [context.get(x, 0) + quality.index_vector("shape " + quality.shape_of(x)) + 0.5 * quality.index_vector("end " + x[-2:].lower()) for x in words]
        mean = np.mean(vectors, axis=0) if words else np.zeros(quality.DIM)
        assert np.allclose(row[: quality.DIM], mean, atol=1e-5)
        again = np.mean([np.allclose(a, b) for a, b in zip(vectors, vectors[1:])]) if len(words) > 1 else 0
        assert np.allclose(row[quality.DIM :], [np.log1p(len(words)), len(words) == 0, again])
