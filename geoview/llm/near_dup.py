"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of five-word shingles; two are linked if the Jaccard
similarity of their sets is ``threshold`` (0.8) or more, and classes are the
connected components of links.

1. Sketch.  Each document gets a digest of its set and a signature of
   ``TREES * DEPTH`` MinHash values.  Documents of equal digest are one node from
   here on, so a group of copies of any size is one row.
2. Forest.  Each tree has its own ``DEPTH`` values of a node as its label; labels
   in sorted order are a prefix trie.  All trees start at full depth, and the
   matched prefix of one tree after the other is shortened by one value, until
   the chance that some tree matches a pair at the threshold reaches ``RECALL``:
   next is always the tree where a step adds most to that chance for the pairs
   that it adds in a sample of nodes, so trees with crowded prefixes keep longer
   ones.  Nodes under one prefix meet in a stream sorted by label: each is
   compared with the leaders before it by the estimate from 4-bit values of the
   whole signature, is joined to one leader of every group that it may resemble,
   which makes these one group, and becomes a leader itself unless one is close.
   So memory holds leaders, not groups.  A prefix that a sample shows to be hot
   is dealt into salts of bounded size; the leaders of its salts meet again in
   pairs of blocks of ``LEADERS``.
3. Candidates.  Their components (alternating large-star and small-star rounds
   on tables, nothing on the driver) hold all pairs that may be linked.
4. Verification.  The texts of candidate nodes are read again, and within each
   component all pairs of sets are compared exactly, in blocks: components over
   ``BLOCK`` nodes or ``BLOCK_SHINGLES`` shingles are dealt as pairs of blocks to
   tasks of bounded size.  A task returns a count of links for each node and a spanning forest of the links,
   not the links, so nothing grows with the square of a group.  Components of
   the forest's links are the classes.

Result: one row per document with class_id (the least doc_id of its class),
n_links (linked documents whose set differs from its own) and n_copies
(documents with its own set).

Edge cases: null and empty texts, and texts without words, are in no class with
others: class_id is their own id, n_links and n_copies are 0; a null doc_id is
allowed and never names a class unless all ids of the class are null; rows that
repeat count each; texts of under five words are one shingle; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free_name, new_path, small_batches, tidied, written
from .shingles import mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
#: Estimates from this on make candidates.  They have a standard deviation of
#: about 0.04, so that a pair at 0.8 falls below with a chance under 1e-6; a
#: node stands for others if they are so close that their links show in its own
#: candidates: what is linked to a node within 0.06 is within 0.26 of it.
CANDIDATE = 0.6
CLOSE = 0.94
#: Nodes, and shingles, of a component that one task compares with as many others.
BLOCK = 2_048
BLOCK_SHINGLES = 2_000_000
BATCH_ROWS = 256
#: Nodes from which depths of trees are planned; it steers work, not results.
PLAN_NODES = 4_096
#: Similarity that two unrelated nodes are taken to have beyond what it shows.
UNRELATED = 0.05
#: A prefix is salted if it has this many nodes in the sample.
HOT_SAMPLE = 1 / 64
HOT_ROWS = 256
SALT_ROWS = 4_096
#: Leaders of one block of a hot prefix.
LEADERS = 4_096
#: Keys with this many rows, and a thousandth of all, are joined by a broadcast,
#: which so has a thousand rows at most.
HUB_ROWS = 1_000
#: Equal rows beyond which a text is reduced to one row before it is dealt.
REPEATS = 64
_SEEDS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 62, (2, TREES * DEPTH), dtype=np.uint64)


def chance(depths: list[int], threshold: float) -> float:
    """That a pair at ``threshold`` shares a prefix of some tree."""
    return 1 - float(np.prod([1 - threshold**d for d in depths]))


def tree_depths(sample: np.ndarray, threshold: float, recall: float = RECALL) -> list[int]:
    """How long a prefix each tree matches, from signatures of some nodes."""

    all_pairs = max(1, len(sample) * (len(sample) - 1) // 2)

    @cache
    def crowd(tree: int, depth: int) -> float:
        """Share of pairs of nodes under one prefix."""
        label = np.ascontiguousarray(sample[:, tree * DEPTH : tree * DEPTH + depth])
        n = np.unique(label, axis=0, return_counts=True)[1] if len(label) else np.zeros(1, int)
        return int((n * (n - 1) // 2).sum()) / all_pairs + UNRELATED**depth

    depths = [DEPTH] * TREES
    while chance(depths, threshold) < recall and max(depths) > 1:

        def worth(t: int) -> float:
            gain = np.log1p(-(threshold ** depths[t])) - np.log1p(-(threshold ** (depths[t] - 1)))
            return gain / (crowd(t, depths[t] - 1) - crowd(t, depths[t]))

        best = max((t for t in range(TREES) if depths[t] > 1), key=lambda t: (worth(t), -t))
        depths[best] -= 1
    return depths


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 16 bits each, of sets that are not empty."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = np.concatenate(sets)
    out = np.empty((len(sets), TREES * DEPTH), dtype=np.uint16)
    for k in range(TREES * DEPTH):
        h = (x ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1))
        least = np.minimum.reduceat(h, first)
        out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _nibbles(sig: np.ndarray) -> np.ndarray:
    low = (sig & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of one packed signature to each of many."""
    x = many ^ one
    equal = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
    return (equal / (TREES * DEPTH) - 1 / 16) / (1 - 1 / 16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, BATCH_ROWS):
            b = whole.slice(lo, BATCH_ROWS)
            sets = [np.unique(shingle_hashes(w)) for w in word_hashes(t.as_py() for t in b.column(2))]
            full = [i for i, s in enumerate(sets) if len(s)]
            node: list[int | None] = [None] * len(sets)
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                values = signature([sets[i] for i in full])
                for i, row in zip(full, values):
                    node[i] = xxhash.xxh3_64_intdigest(sets[i].tobytes()) - (1 << 63)
                    sig[i] = row.tobytes()
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), size], names=["doc_id", "rid", "node", "sig", "size"])


def _plant(depths: list[int]):
    """Rows of the forest: prefix (with its tree), whole label, node, bits."""
    weights = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 62, DEPTH, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, TREES * DEPTH)
                bits = pa.array([r.tobytes() for r in _nibbles(sig)], pa.binary())
                for t, depth in enumerate(depths):
                    label = sig[:, t * DEPTH : (t + 1) * DEPTH]
                    prefix = np.full(len(label), t + 1, dtype=np.uint64)
                    for j in range(depth):
                        prefix = mix(prefix * weights[j] + label[:, j])
                    # Big-endian, so that bytes sort as the trie does.
                    path = pa.array([r.tobytes() for r in label.astype(">u2")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), path, b.column(0), bits], names=["prefix", "label", "node", "bits"])

    return run


PLANTED = "prefix long, label binary, node long, bits binary"
MET = "a long, b long, prefix long, label binary, node long, bits binary"


def _meet(hand_on: bool):
    """Edges (a, b) from rows (prefix, i, j, side, label, node, bits) in that
    order.  Under i = j every row meets those before it; under i < j rows of side
    1 meet those of side 0.  With ``hand_on``, leaders of rows with i >= 0 are
    handed on, as rows with a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        lead_ids: list[int] = []
        # Leaders that are joined already have one group number, so that a group
        # of g nodes gives 2g edges at most, however many pairs resemble.
        group = np.zeros(64, np.int64)
        lead = np.zeros((64, TREES * DEPTH // 2), np.uint8)
        used = 0
        for whole in batches:
            prefix, left, right, sides = (whole.column(i).to_numpy() for i in range(4))
            new = np.ones(len(prefix), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(prefix))
            a: list[int] = []
            b: list[int] = []
            led: list[tuple] = []
            nodes, raw = whole.column(5).to_numpy(), whole.column(6)
            for lo, hi in zip(first.tolist(), ends.tolist()):
                here = (prefix[lo], left[lo], right[lo])
                apart, handed = left[lo] != right[lo], hand_on and left[lo] >= 0
                if here != key:
                    key, used, lead_ids = here, 0, []
                # A group of one that ends within the batch has no edges.
                if hi - lo == 1 and hi < len(prefix) and not used and not handed:
                    continue
                bits = np.frombuffer(b"".join(raw.slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)
                for i in range(hi - lo):
                    node, closest, mine = int(nodes[lo + i]), 0.0, used
                    if used and not (apart and sides[lo + i] == 0):
                        like = estimates(bits[i], lead[:used])
                        near = np.flatnonzero(like >= CANDIDATE)
                        groups, one_each = np.unique(group[near], return_index=True)
                        for j in near[one_each].tolist():
                            if lead_ids[j] != node:
                                a.append(node)
                                b.append(lead_ids[j])
                        if len(groups) > 1:
                            group[:used][np.isin(group[:used], groups)] = groups[0]
                        closest, mine = like.max(), groups[0] if len(groups) else used
                    if (sides[lo + i] == 0) if apart else closest < CLOSE:
                        if used == len(lead):
                            lead, group = np.concatenate([lead, np.zeros_like(lead)]), np.concatenate([group, np.zeros_like(group)])
                        lead[used] = bits[i]
                        group[used] = mine
                        lead_ids.append(node)
                        used += 1
                        if handed:
                            led.append((int(prefix[lo]), whole.column(4)[lo + i].as_py(), node, bits[i].tobytes()))
            none = [None] * len(a)
            p, r, n, x = zip(*led) if led else ((), (), (), ())
            pad = [None] * len(led)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + pad, pa.int64()), pa.array(b + pad, pa.int64()), pa.array(none + list(p), pa.int64()), pa.array(none + list(r), pa.binary()), pa.array(none + list(n), pa.int64()), pa.array(none + list(x), pa.binary())],
                names=["a", "b", "prefix", "label", "node", "bits"],
            )

    return run


def in_block_pairs(rows: DataFrame, of: str, blocks: Column) -> DataFrame:
    """``rows`` with i, j and side: those with one ``of`` are dealt into ``blocks``
    blocks by node, and block pairs (i <= j) hold both blocks; a row is on side
    0 of pairs (own, j) and on side 1 of pairs (i, own) with i < own."""
    mine = F.pmod(F.xxhash64("node", of), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks__") - 1),
        lambda x: F.struct(F.least(x, F.col("mine__")).alias("i"), F.greatest(x, F.col("mine__")).alias("j"), (x < F.col("mine__")).cast("int").alias("side")),
    )
    dealt = rows.withColumns({"blocks__": blocks.cast("int"), "mine__": mine}).withColumn("pair__", F.explode(pairs))
    return dealt.select(*rows.columns, "pair__.*")


def candidate_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between nodes that the forest finds alike."""
    order = ("prefix", "i", "j", "side", "label", "node", "bits")
    some = nodes.select("sig").orderBy(F.xxhash64("node"), "node").limit(PLAN_NODES).toArrow()["sig"].to_pylist()
    depths = tree_depths(np.frombuffer(b"".join(some), dtype=np.uint16).reshape(-1, TREES * DEPTH), threshold)
    planted = nodes.select("node", "sig").mapInArrow(_plant(depths), PLANTED)
    taste = nodes.select("node", "sig").filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(HOT_SAMPLE * (1 << 20)))
    hot = (
        taste.mapInArrow(_plant(depths), PLANTED).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS)
        .select("prefix", F.ceil(F.col("n") / (HOT_SAMPLE * SALT_ROWS)).cast("int").alias("salts"))
    )
    hot = written(hot, "hot-prefixes")
    any_hot = not hot.isEmpty()
    if any_hot:
        salted = planted.join(hot, "prefix", "left").withColumn("i", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).otherwise(-1))
    else:
        salted = planted.withColumn("i", F.lit(-1))
    rows = salted.withColumns({"j": F.col("i"), "side": F.lit(0)}).select(*order).repartition("prefix", "i").sortWithinPartitions("prefix", "i", "label", "node")
    met = rows.mapInArrow(_meet(True), MET)
    if not any_hot:
        return met.select("a", "b").filter(F.col("a").isNotNull())
    met = written(met, "forest-meetings")
    leaders = met.filter(F.col("node").isNotNull()).select("prefix", "label", "node", "bits")
    many = leaders.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / LEADERS).alias("blocks"))
    again = in_block_pairs(leaders.join(many, "prefix"), "prefix", F.col("blocks")).select(*order)
    second = again.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j", "side", "label", "node").mapInArrow(_meet(False), MET)
    return met.select("a", "b").unionByName(second.select("a", "b")).filter(F.col("a").isNotNull())


def hub_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with ``table``, which has one row for each key and, as ``size``, how
    many of ``rows`` have it.  Keys with many rows join by a broadcast, so that
    their rows stay where they are; there are ``total / limit`` of those at most."""
    limit = max(HUB_ROWS, -(-total // 1000))
    if total < 2 * limit:
        return rows.join(table.drop(size), key, how)
    hubs = table.filter(F.col(size) >= limit)
    near = rows.join(F.broadcast(hubs.drop(size)), key)
    far = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.filter(F.col(size) < limit).drop(size), key, how)
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge; comp is the component's least
    node.  Large-star and small-star rounds, each written as a table."""
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct().write.parquet(path)
    before = None
    while True:
        edges = spark.read.parquet(path)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        # At the end all edges form stars; then another round changes nothing.
        if now == before:
            break
        before = now
        # Large star: every node points its larger neighbours at its least one.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("size"))
        large = hub_join(both, least, "a", "size", 2 * now["n"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node points its smaller neighbours, and itself, at
        # the least of them; edges stand as (larger, smaller) already.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a != b").distinct()
        after = new_path(spark, "edges")
        small.write.parquet(after)
        drop(spark, path)
        path = after
    stars = spark.read.parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


#: Values in so few sets of either side are counted pair by pair, others by a
#: product of matrices.
FEW = 8


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float, alone: bool = False) -> np.ndarray:
    """Boolean matrix: which sets of ``left`` are linked to which of ``right``."""
    sizes = [np.array([len(s) for s in x], dtype=np.int64) for x in (left, right)]
    both = np.zeros(len(left) * len(right), dtype=np.float32)
    sides = []
    for x, n in zip((left, right), sizes):
        values, rows = np.concatenate(x), np.repeat(np.arange(len(x)), n)
        order = np.argsort(values, kind="stable")
        sides.append((values[order], rows[order], *np.unique(values[order], return_index=True, return_counts=True)))
    shared = np.intersect1d(sides[0][2], sides[1][2], assume_unique=True)
    runs = []  # for each side: first position and length of each shared value
    for _, _, values, first, n in sides:
        at = np.searchsorted(values, shared)
        runs.append((first[at], n[at]))
    (fl, nl), (fr, nr) = runs
    if alone:  # a value of one set only links nothing
        some = nl > 1
        fl, nl, fr, nr = fl[some], nl[some], fr[some], nr[some]
    few = np.flatnonzero((nl <= FEW) & (nr <= FEW))
    for lo in range(0, len(few), 1 << 14):
        i = few[lo : lo + (1 << 14)]
        n = nl[i] * nr[i]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nr[i], n)
        a, b = sides[0][1][np.repeat(fl[i], n) + k // width], sides[1][1][np.repeat(fr[i], n) + k % width]
        both += np.bincount(a * len(right) + b, minlength=len(both)).astype(np.float32)
    both = both.reshape(len(left), len(right))
    many = np.flatnonzero((nl > FEW) | (nr > FEW))
    for lo in range(0, len(many), 1024):
        i = many[lo : lo + 1024]
        mats = []
        for (_, rows, *_), first, n, size in ((sides[0], fl, nl, len(left)), (sides[1], fr, nr, len(right))):
            mat = np.zeros((size, len(i)), dtype=np.float32)
            at = np.arange(n[i].sum()) - np.repeat(np.cumsum(n[i]) - n[i], n[i]) + np.repeat(first[i], n[i])
            mat[rows[at], np.repeat(np.arange(len(i)), n[i])] = 1
            mats.append(mat)
        both += mats[0] @ mats[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return both + 1e-4 >= threshold * union


def _verify(threshold: float):
    """Per block pair: links of each node (weighted by documents) and a forest.
    Rows come sorted by (comp, i, j, side, node)."""

    def done(rows: list[tuple], alone: bool) -> tuple[list, list, list]:
        """``alone``: a block with itself, so that side 1 has no rows."""
        sides: dict[int, dict[int, tuple]] = {0: {}, 1: {}}
        for side, node, n, words in rows:
            sides[side].setdefault(node, (n, words))
        left = list(sides[0])
        right = left if alone else list(sides[1])
        if not left or not right:
            return [], [], []
        sets = {node: x for s in sides.values() for node, (_, x) in s.items()}
        link = _linked([sets[n] for n in left], [sets[n] for n in right], threshold, alone)
        if alone:
            np.fill_diagonal(link, False)
        count = {k: v[0] for s in sides.values() for k, v in s.items()}
        weight_r = np.array([count[n] for n in right], dtype=np.int64)
        weight_l = np.array([count[n] for n in left], dtype=np.int64)
        total: dict[int, int] = dict(zip(left, (link @ weight_r).tolist()))
        if not alone:
            for n, x in zip(right, (link.T @ weight_l).tolist()):
                total[n] = total.get(n, 0) + x
        # A spanning forest of the links, by union-find over rows.
        root = {n: n for n in (*left, *right)}

        def find(n):
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        edges = []
        for i, n in enumerate(left):
            for j in np.flatnonzero(link[i]).tolist():
                x, y = find(n), find(right[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((n, right[j]))
        nodes = [n for n, x in total.items() if x]
        return nodes, [total[n] for n in nodes], edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            for have, new in zip(out, done(rows, key is not None and key[1] == key[2])):
                have.extend(new)
            rows.clear()

        def table():
            nodes, links, edges = out
            pad_n, pad_e = [None] * len(edges), [None] * len(nodes)
            b = pa.RecordBatch.from_arrays(
                [pa.array(nodes + pad_n, pa.int64()), pa.array(links + pad_n, pa.int64()), pa.array(pad_e + [e[0] for e in edges], pa.int64()), pa.array(pad_e + [e[1] for e in edges], pa.int64())],
                names=["node", "links", "a", "b"],
            )
            for x in out:
                x.clear()
            return b

        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                texts = (t.as_py() for t in b.column(6))
                for comp, i, j, side, node, n, words in zip(*(c.to_pylist() for c in b.columns[:6]), word_hashes(texts)):
                    if (comp, i, j) != key:
                        flush()
                        key = (comp, i, j)
                        if len(out[0]) + len(out[2]) > 20_000:
                            yield table()
                    rows.append((side, node, n, np.unique(shingle_hashes(words))))
        flush()
        yield table()

    return run


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the least id."""
    found, rid = _classes(docs, threshold, id_col, text_col), free_name(docs, "row_id")
    last = F.lit((1 << 63) - 1)
    kept = found.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("doc_id"), "rid")).alias("row")).select(F.col("row.rid").alias(rid))
    # Rows that only share 64 bits stay: repeats are rows of equal 128 bits.
    more = free_name(docs, "row_hash")
    other = F.xxhash64(F.lit("row"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return docs.withColumns({rid: _rid(id_col, text_col), more: other}).join(kept, rid, "left_semi").dropDuplicates([rid, more]).drop(rid, more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of ``docs``."""
    return _classes(docs, threshold, id_col, text_col).select("doc_id", "class_id", "n_links", "n_copies")


def _rid(id_col: str, text_col: str) -> Column:
    """Equal for rows of equal ids and texts, which are one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _rid(id_col, text_col).alias("rid"))
    sketch = written(small_batches(base.select("doc_id", "rid", "text")).mapInArrow(tidied(_sketch), "doc_id long, rid long, node long, sig binary, size long"), "sketches")
    rows = sketch.filter(F.col("node").isNotNull()).groupBy("node", "rid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = rows.groupBy("node").agg(F.min("least").alias("least"), F.min("rid").alias("rid"), F.sum("n").alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.max("n").alias("repeats"))
    nodes = written(nodes, "nodes")
    comps = components(candidate_edges(nodes, threshold))
    members = comps.join(nodes.select("node", "rid", "n", "size"), "node")
    wide = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    sizes = members.groupBy("comp").agg(wide.alias("blocks"))
    dealt = in_block_pairs(members.join(sizes, "comp").drop("size"), "comp", F.col("blocks"))
    dealt = written(dealt.select("rid", "node", "n", "comp", "i", "j", "side"), "dealt")
    texts = base.select("rid", "text")
    if (nodes.agg(F.max("repeats")).first()[0] or 0) > REPEATS:
        texts = texts.groupBy("rid").agg(F.first("text").alias("text"))
    # A merge join at every size: what is dealt grows with the input.
    texts = texts.join(dealt.hint("merge"), "rid").select("comp", "i", "j", "side", "node", "n", "text")
    grouped = texts.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side", "node")
    verified = written(small_batches(grouped).mapInArrow(tidied(_verify(threshold)), "node long, links long, a long, b long"), "verified")
    links = verified.filter(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.filter(F.col("a").isNotNull()).select("a", "b"))
    named = classes.join(nodes.select("node", "least"), "node")
    name = named.groupBy("comp").agg(F.min("least").alias("class_id"))
    linked = classes.join(name, "comp").join(links, "node").select("node", "comp", "class_id", "links")
    known = nodes.select("node", "least", "n").join(linked, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), "n", F.col("n").alias("rows")
    )
    out = hub_join(sketch.select("doc_id", "rid", "node"), known, "node", "rows", sketch.count(), "left")
    # A document without words is a class of its own.
    key = F.when(F.col("node").isNull(), F.struct(F.lit(0).alias("kind"), F.col("rid").alias("of"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("comp").alias("of")))
    return out.select(
        "doc_id", "rid", key.alias("key"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n", F.lit(0)).cast("long").alias("n_copies"),
    )
