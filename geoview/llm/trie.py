"""Prefix trie of conversations, by adaptive radix trees.

A turn is its role and text; its id is the first ``WIDTH`` bytes of a digest of
both, so ids have one width and a conversation is the string of its turns' ids.
Equal strings become one row with a count before anything else, so a group of
copies of any size is one row.  The distinct strings are dealt out by range and
written with their part; a task takes a part in order and puts it, ``CHUNK_BYTES``
at a time, into an adaptive radix tree: nodes of 4, 16, 48 or 256 branches that grow
as needed, with compressed paths.  Only byte depths that are multiples of ``WIDTH``
are nodes of the result.  A chunk knows how many turns it shares with the string
before it and behind it, from the neighbours in its part or, at the ends of a part,
from a summary of two numbers a part, which is all that the driver sees.  What a
chunk finds are sums over strings, over nodes that begin in it and over leaves, so
nodes that lie in several chunks (those on a chunk's first and last path) add up in
one aggregate; all others are complete and cross no further shuffle.

Subtree values follow from such sums: saved words are those of all members' turns
less those of distinct nodes, each node being counted by the chunk in which it
begins.  The ids of conversations that end in a node are hashed in order: runs of
them, joined to texts of bounded length by range of ids, go to the node's task,
which feeds them to the hash one after the other.

A conversation, at 20 bytes a turn, is what a task holds at least.

Edge cases: rows without a conversation id are in no conversation; a null role or
text is empty; turns stand in the order of (turn, id), null turns first, so
repeated rows are turns of their own and ties have one order, by digest; a table
without conversations has no nodes, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied, written

WIDTH = 16
#: Bytes of turn ids in one tree.
CHUNK_BYTES = 4 << 20
#: Ids of one run that is hashed for a node.
RUN_IDS = 4096
#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the length keeps role and text apart."""
    head = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(head.cast("binary"), 256), 1, 2 * WIDTH)


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row for each id, its turns (turn, id, words) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").alias("turn"), turn_id(role, text).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    """Null turns first, then by turn, then by id."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    null = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(null, less(a["turn"], b["turn"]), less(a["id"], b["id"]), F.lit(0))


def branched(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations of which each begins as the one that leads its group does.

    Conversation c takes the first h turns of c - c % group, as many as there are,
    and goes on with its own behind its first h; h is crc32(c) % most.  Rows meet by
    group in the one shuffle that makes conversations.
    """
    conv = F.col("conv_id")
    base = conv - conv % group
    rows = conversations_of(turns.withColumn("conv_id", conv.cast("long"))).withColumn("base", base)
    head = F.first(F.when(conv == F.col("base"), F.slice("turns", 1, most - 1)), ignorenulls=True)
    rows = rows.withColumn("head", head.over(Window.partitionBy("base")))
    h = (F.crc32(conv.cast("string")) % most).cast("int")
    empty = F.slice("turns", 1, 0)
    taken = F.coalesce(F.slice("head", F.lit(1), h), empty)
    rest = F.slice("turns", h + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(taken, rest).alias("turns"))


class _Node:
    """A node of 4, 16, 48 or 256 branches below a compressed path.

    Up to 16 branches stand as sorted bytes with their nodes beside them; up to 48
    have an index of 256 entries; 256 branches are the index themselves.
    """

    __slots__ = ("path", "end", "size", "keys", "index", "below")

    def __init__(self, path: bytes, end: int = -1) -> None:
        self.path, self.end, self.size = path, end, 4
        self.keys, self.index, self.below = bytearray(), None, []

    def child(self, byte: int) -> "_Node | None":
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.below[at] if at >= 0 else None
        if self.size == 48:
            at = self.index[byte]
            return self.below[at - 1] if at else None
        return self.below[byte]

    def add(self, byte: int, node: "_Node") -> None:
        if self.size <= 16:
            if len(self.keys) == self.size:
                self._grow()
                return self.add(byte, node)
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.below.insert(at, node)
        elif self.size == 48:
            if len(self.below) == 48:
                self._grow()
                return self.add(byte, node)
            self.below.append(node)
            self.index[byte] = len(self.below)
        else:
            self.below[byte] = node

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            self.size, self.index = 48, bytearray(256)
            for at, byte in enumerate(self.keys):
                self.index[byte] = at + 1
            self.keys = bytearray()
        else:
            self.size, self.below = 256, [self.below[at - 1] if at else None for at in self.index]
            self.index = None

    def replace(self, byte: int, node: "_Node") -> None:
        if self.size <= 16:
            self.below[self.keys.find(byte)] = node
        elif self.size == 48:
            self.below[self.index[byte] - 1] = node
        else:
            self.below[byte] = node

    def children(self) -> list["_Node"]:
        if self.size <= 16:
            return self.below
        if self.size == 48:
            return [self.below[at - 1] for at in self.index if at]
        return [n for n in self.below if n is not None]


class RadixTree:
    """Adaptive radix tree of distinct byte strings, of which one may begin
    another; each has a number."""

    def __init__(self) -> None:
        self.root = _Node(b"")

    def insert(self, key: bytes, number: int) -> None:
        above, node, at = None, self.root, 0
        while True:
            path = node.path
            if key.startswith(path, at):
                at += len(path)
                if at == len(key):
                    node.end = number
                    return
                below = node.child(key[at])
                if below is None:
                    node.add(key[at], _Node(key[at:], number))
                    return
                above, node = node, below
                continue
            same = shared(path, key[at : at + len(path)])
            split = _Node(path[:same])
            above.replace(path[0], split)  # the root's path is empty: it never splits
            node.path = path[same:]
            split.add(path[same], node)
            at += same
            if at == len(key):
                split.end = number
            else:
                split.add(key[at], _Node(key[at:], number))
            return


def shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


#: What a chunk says of a node: partial values, whether it lies in more chunks, and
#: the digests by which its parts meet, its children find it and its ends are hashed.
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, end_conv long, split boolean, digest binary, parent binary"
_TYPES = [pa.int64()] * 9 + [pa.bool_()] + [pa.binary()] * 2
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")


def prefix_digests(key: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns of a string."""
    h = hashlib.sha256()
    out = [h.digest()]
    for d in range(depth):
        h.update(key[d * WIDTH : (d + 1) * WIDTH])
        out.append(h.digest())
    return out


class _Sums:
    """What the members below a place in the tree add up to; ``open`` has the rows
    of nodes whose parent is still above."""

    __slots__ = ("n", "least", "leaves", "saved", "low", "high", "open")

    def __init__(self) -> None:
        self.n, self.least, self.leaves, self.saved, self.low, self.high, self.open = 0, None, 0, 0, None, -1, []

    def take(self, n: int, least: int, leaves: int, saved: int, low: int, high: int, rows: list) -> None:
        self.n, self.leaves, self.saved, self.high = self.n + n, self.leaves + leaves, self.saved + saved, max(self.high, high)
        self.least = least if self.least is None else min(self.least, least)
        self.low = low if self.low is None else min(self.low, low)
        self.open = rows if not self.open else self.open + rows if len(rows) > len(self.open) else self._extended(rows)

    def _extended(self, rows: list) -> list:
        self.open.extend(rows)
        return self.open


def chunk_nodes(keys: list[bytes], words: list[bytes], counts: list[int], convs: list[int], before: int, behind: int, extended: bool) -> Iterator[tuple]:
    """Rows of NODE for sorted, distinct strings.

    The first string shares ``before`` turns with the one before it (-1: there is
    none) and the last ``behind`` with the next, which ``extended`` says to begin with it.
    """
    tree = RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    end = len(keys) - 1
    heads, tails = prefix_digests(keys[0], max(before, 0)), prefix_digests(keys[end], max(behind, 0))
    places = [(tree.root, -1, -1)]  # node, place of its parent, bytes above its path
    for at, (node, _, above) in enumerate(places):  # grows as it goes
        deep = max(above, 0) + len(node.path)
        places.extend((c, at, deep) for c in node.children())
    sums = [_Sums() for _ in places]
    for at in range(len(places) - 1, -1, -1):  # children stand behind their parents
        node, up, above = places[at]
        own, deep = sums[at], max(above, 0) + len(node.path)
        if node.end >= 0:
            leaf = not node.children() and not (node.end == end and extended)
            own.take(counts[node.end], convs[node.end], int(leaf), 0, node.end, node.end, [])
        if own.n == 0:
            continue
        size = np.frombuffer(words[own.low], ">u4")
        for d in range(deep // WIDTH, above // WIDTH, -1):
            begun = own.low == 0 and d <= before
            split = begun or d == 0 or own.high == end and d <= behind
            own.saved += (int(size[d - 1]) if d else 0) * (own.n - (not begun))
            ends_here = node.end >= 0 and d * WIDTH == deep
            ends = counts[node.end] if ends_here else 0
            digest = (heads[d] if begun or d == 0 else tails[d]) if split else hashlib.sha256(keys[node.end]).digest() if ends > 1 else None
            for row, _ in own.open:
                row[2], row[11] = own.least, digest if split else None
                yield tuple(row)
            kids = sum(new for _, new in own.open)
            own.open = [([own.least, d, None, own.n, kids, own.leaves, own.saved, ends, convs[node.end] if ends_here else None, split, digest, None], not begun)]
        if up >= 0:
            sums[up].take(own.n, own.least, own.leaves, own.saved, own.low, own.high, own.open)
        else:
            yield tuple(own.open[0][0])
        sums[at] = None


def _in_chunks(edges: dict[int, tuple[int, int, bool]]):
    """Rows (part, key, words, n, conv_id), sorted within parts, as rows of NODE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, before = None, 0, -1
        held: tuple[list, ...] = ([], [], [], [])

        def flush(behind: int, extended: bool) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in chunk_nodes(*held, before, behind, extended):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            for h in held:
                h.clear()

        for batch in batches:
            for p, *row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[0]
                if p != part:
                    if part is not None:
                        yield from flush(*edges[part][1:])
                    part, size, before = p, 0, edges[p][0]
                elif size >= CHUNK_BYTES:
                    last = held[0][-1]
                    behind, extended = shared(last, key) // WIDTH, key.startswith(last)
                    yield from flush(behind, extended)
                    size, before = 0, behind
                size += len(key)
                for h, v in zip(held, row):
                    h.append(v)
        if part is not None:
            yield from flush(*edges[part][1:])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def _edges_of(parts: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """part -> turns shared with the string before it (-1: none) and behind it, and
    whether that one extends it: two numbers and a flag for each part."""
    in_order = Window.orderBy("part")  # a row for each part
    ends = parts.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    met = ends.select("part", "low", "high", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("behind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, low, high, before, behind = (c.to_pylist() for c in b.columns)
            a = [-1 if x is None else shared(x, k) // WIDTH for x, k in zip(before, low)]
            z = [-1 if x is None else shared(k, x) // WIDTH for x, k in zip(behind, high)]
            more = [x is not None and x.startswith(k) for x, k in zip(behind, high)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(more, pa.bool_())], names=["part", "before", "behind", "more"])

    return {r[0]: (r[1], r[2], r[3]) for r in met.mapInArrow(run, "part int, before long, behind long, more boolean").collect()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digest) in order of ids as (digest, first, ids), comma-joined."""
    open_: dict[bytes, list[int]] = {}
    held = 0

    def batch(runs: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in runs], pa.binary()), pa.array([r[0] for _, r in runs], pa.int64()), pa.array([",".join(map(str, r)) for _, r in runs], pa.string())], names=["digest", "first", "ids"])

    for b in batches:
        full = []
        for conv, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            run = open_.setdefault(digest, [])
            run.append(conv)
            held += 1
            if len(run) == RUN_IDS:
                full.append((digest, open_.pop(digest)))
                held -= RUN_IDS
        if held > 64 * RUN_IDS:
            full += open_.items()
            open_, held = {}, 0
        if full:
            yield batch(full)
    if open_:
        yield batch(list(open_.items()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order as (digest, sha256 of all ids, comma-joined)."""
    now, h = None, None
    for b in batches:
        out = []
        for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if digest != now:
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h = digest, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["digest", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["digest", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``conversations`` (conv_id, turns with id
    and words): conv_id, the least member, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    joined = lambda e: F.unhex(F.array_join(e, ""))
    key = joined(F.transform("turns", lambda t: t["id"]))
    words = joined(F.transform("turns", lambda t: F.lpad(F.hex(t["words"]), 8, "0")))
    strings = written(conversations.select("conv_id", key.alias("key"), words.alias("words")), "trie-strings")
    same = strings.groupBy("key", "words").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    parts = written(same.repartitionByRange("key").select(F.spark_partition_id().alias("part"), "key", "words", "n", "conv_id"), "trie-parts")
    edges = _edges_of(parts)
    in_order = parts.repartition("part").sortWithinPartitions("part", "key")
    nodes = written(in_order.mapInArrow(tidied(_in_chunks(edges)), NODE), "trie-nodes")
    # Nodes in several chunks: as many as chunks have turns on their first and last path.
    met = nodes.filter("split").groupBy("digest", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS], F.min("end_conv").alias("end_conv"), F.max("parent").alias("parent"),
    )
    met = met.withColumn("parent_conv_id", F.lit(None).cast("long"))
    cols = ["conv_id", "depth", "parent_conv_id", *_SUMS, "end_conv", "digest", "parent"]
    every = nodes.filter("NOT split").select(cols).unionByName(met.select(cols))
    tops = met.select(F.col("digest").alias("parent"), F.col("conv_id").alias("top"))
    below = every.filter(F.col("parent").isNotNull()).join(tops, "parent").withColumn("parent_conv_id", F.col("top"))
    every = below.select(cols).unionByName(every.filter(F.col("parent").isNull()).select(cols))
    return _with_ends(every, strings, parts)


def _with_ends(nodes: DataFrame, strings: DataFrame, parts: DataFrame) -> DataFrame:
    """``nodes`` with the hash of the ids that end in them."""
    digest = F.unhex(F.sha2("key", 256)).alias("digest")
    several = parts.filter("n > 1").select(digest)
    ids = strings.select("conv_id", digest).join(several, "digest", "left_semi").select("conv_id", "digest")
    runs = ids.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_runs, "digest binary, first long, ids string")
    hashes = runs.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_hashed, "digest binary, sha string")
    one = F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")).cast("binary"), 256)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    few = nodes.filter("n_ends < 2").select(*out, one.alias("ends_sha256"))
    many = nodes.filter("n_ends > 1").join(hashes, "digest").select(*out, F.col("sha").alias("ends_sha256"))
    return few.unionByName(many)
