"""Benchmark decontamination by SimHash of item-sized windows.

For an item of m words, every window of m words of a document (the whole
document where it is shorter) has a SimHash of ``BITS`` bits over its word
shingles, weighted by how often each occurs.  Items of one size stand in a
multi-index of 16-bit blocks, hash tables that by the pigeonhole principle find
every item within ``RADIUS`` bits of a window.  Candidates are verified by exact
weighted Jaccard similarity, sum(min) / sum(max) of the shingles' counts, for a
block of windows and items at a time, and those of ``threshold`` or more are leaks; a
document reports its best window for an item.

Windows that hold fewer shingles of items of their size than the threshold needs are
near none of these and get no fingerprint; this loses nothing and leaves few windows.

The benchmark is broadcast in parts: equal rows are counted, and distinct ones
are dealt by hash into as many parts as keep each near ``PART_CHARS`` characters;
a worker makes a part's tables once.  One part is one pass over the documents,
which are not shuffled.  Of several parts each is a pass of its own that writes
what it finds by a 128-bit hash of the text, and documents meet that in one join.

A task holds one document at a time: its text is taken apart in slices, as one
64-bit number for each word and shingle; ``WINDOWS`` windows are fingerprinted at
once, from sums over ``SPAN`` shingles at a time.

Edge cases: null or empty texts and items have no leaks; items and documents of
fewer than five words are one shingle; repeated items and documents report each;
ties go to the first window; a null item_id is reported as null; an empty table
on either side gives no leaks; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import MultiIndex
from .common import free_name, small_batches, tidied, with_text, written
from .shingles import SIZE, shingle_hashes, word_hashes

BITS = 64
#: A window of similarity 0.8 differs in about 9.6 of 64 bits, with a standard
#: deviation of 2.9; more than 19 is over three deviations away.
RADIUS = 19
THRESHOLD = 0.8
PART_CHARS = 16_000_000
#: Rows of an output batch.
BATCH_ROWS = 256
#: Windows fingerprinted together, and shingles that are summed at a time.
WINDOWS = 1 << 10
#: Windows times items of one size that a block has at most.
PAIRS = 1 << 22
SPAN = 1 << 15
#: Counts of candidates' shingles that are compared at once.
ENTRIES = 1 << 20


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 16-bit blocks, from sums of signs."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(np.uint16)


def sums_before(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of signs of all shingles from the first of ``at`` (which rises) to
    each of the others."""
    out = np.zeros((len(at), BITS), np.int64)
    total = np.zeros(BITS, np.int64)
    for lo in range(int(at[0]), int(at[-1]), SPAN):
        hi = min(lo + SPAN, int(at[-1]))
        run = np.cumsum(signs(shingles[lo:hi]), axis=0)
        mine = slice(np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "right"))
        out[mine] = total + run[at[mine] - lo - 1]
        total += run[-1]
    return out


def fingerprints(shingles: np.ndarray, starts: np.ndarray, inside: int) -> np.ndarray:
    """SimHashes of the windows of ``inside`` shingles at rising ``starts``."""
    at = np.unique(np.concatenate([starts, starts + inside]))
    sums = sums_before(shingles, at)
    return packed(sums[np.searchsorted(at, starts + inside)] - sums[np.searchsorted(at, starts)])


class Shingled:
    """The shingles of items of one size, as counts in rows: entry e of item i has
    the number of a kind of shingle and how often the item has it."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.kinds = np.unique(np.concatenate(items))
        pairs = [np.unique(np.searchsorted(self.kinds, s), return_counts=True) for s in items]
        self.kind = np.concatenate([k for k, _ in pairs])
        self.often = np.concatenate([n for _, n in pairs])
        self.ends = np.cumsum([len(k) for k, _ in pairs])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.size = len(items[0])

    def has(self, shingles: np.ndarray) -> np.ndarray:
        """Which of some shingles are of these kinds."""
        return self.kinds[np.minimum(np.searchsorted(self.kinds, shingles), len(self.kinds) - 1)] == shingles

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Where a text has kinds of these shingles: kind * (length + 1) + place, sorted."""
        at = np.minimum(np.searchsorted(self.kinds, shingles), len(self.kinds) - 1)
        hit = np.flatnonzero(self.kinds[at] == shingles)
        return np.sort(at[hit] * (len(shingles) + 1) + hit)

    def shared(self, places: np.ndarray, length: int, starts: np.ndarray, inside: int, items: np.ndarray) -> np.ndarray:
        """sum(min) of the counts of windows and items, pair by pair."""
        n = self.ends[items] - self.starts[items]
        out = np.zeros(len(items), np.int64)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(items):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ENTRIES, "right")))
            own = n[lo:hi]
            pair = np.repeat(np.arange(lo, hi), own)
            entry = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + self.starts[items[pair]]
            first = self.kind[entry] * (length + 1) + starts[pair]
            there = np.searchsorted(places, first + inside) - np.searchsorted(places, first)
            out[lo:hi] = np.bincount(pair - lo, np.minimum(there, self.often[entry]), hi - lo).astype(np.int64)
            lo = hi
        return out


class Benchmark:
    """Items (item_id, text, how often) by size in words, each size with its
    multi-index."""

    def __init__(self, items: list[tuple]) -> None:
        self.sizes: dict[int, tuple] = {}
        by: dict[int, list] = {}
        for (item_id, _, times), words in zip(items, word_hashes(t for _, t, _ in items)):
            if len(words):
                by.setdefault(len(words), []).append((item_id, times, shingle_hashes(words)))
        known: dict[int, list] = {}
        for m, group in sorted(by.items()):
            prints = np.concatenate([fingerprints(s, np.zeros(1, np.int64), len(s)) for *_, s in group])
            self.sizes[m] = (group, MultiIndex(prints), Shingled([s for *_, s in group]))
            known.setdefault(min(m, SIZE), []).extend(s for *_, s in group)
        #: All shingles of items, by the number of words that they have.
        self.known = {k: np.unique(np.concatenate(s)) for k, s in known.items()}
        self.maps = {k: self._bitmap(s) for k, s in self.known.items()}

    @staticmethod
    def _bitmap(known: np.ndarray) -> np.ndarray:
        size = 1 << max(16, int(len(known) * 16).bit_length())
        bits = np.zeros(size, dtype=bool)
        bits[(known & np.uint64(size - 1)).astype(np.int64)] = True
        return bits

    def hits(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """Positions of the benchmark's shingles."""
        bits = self.maps[k]
        maybe = np.flatnonzero(bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        return maybe[known[at] == shingles[maybe]]

    def leaks(self, words: np.ndarray, threshold: float) -> list[tuple]:
        """(item_id, first word, words, similarity) for every leaked item."""
        found: list[tuple] = []
        if not len(words):
            return found
        shingled: dict[int, tuple] = {}
        for k in self.known:
            if k <= len(words) or k == min(self.known):
                s = shingle_hashes(words, k)
                shingled[min(k, len(words))] = (s, self.hits(s, k) if k <= len(words) else np.zeros(0, np.int64))
        for m, (group, index, shingled_items) in self.sizes.items():
            width = min(m, len(words))
            k = min(SIZE, width)
            s, hit = shingled.get(k, (None, ()))
            if not len(hit):
                continue
            inside = width - k + 1  # shingles of a window
            # A window shares at most as many shingles with an item as it holds of those
            # of this size: with fewer than the threshold needs, it is none of theirs.
            sizes = inside + shingled_items.size
            need = threshold * sizes / (1 + threshold) - 1e-6
            hit = hit[shingled_items.has(s[hit])]
            if len(hit) < need:
                continue
            # Starts of windows that hold a hit: ranges before each, which may overlap.
            low, high = np.maximum(hit - inside + 1, 0), np.minimum(hit, len(s) - inside)
            low[1:] = np.maximum(low[1:], high[:-1] + 1)
            n = np.maximum(high - low + 1, 0)
            starts = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = starts[np.searchsorted(hit, starts + inside) - np.searchsorted(hit, starts) >= need]
            places = shingled_items.places(s) if len(starts) else None
            best: dict[int, tuple] = {}
            lo = 0
            while lo < len(starts):
                # Windows that lie far apart are not summed across.
                hi = min(lo + max(1, min(WINDOWS, PAIRS // len(group))), int(np.searchsorted(starts, starts[lo] + max(SPAN, inside))))
                some = starts[lo:hi]
                w, i = index.within(fingerprints(s, some, inside), RADIUS)
                both = shingled_items.shared(places, len(s), some[w], inside, i)
                score = both / np.maximum(1, sizes - both)
                good = np.flatnonzero(score >= threshold)
                for at, j, x in zip((-some[w[good]]).tolist(), i[good].tolist(), score[good].tolist()):
                    if (x, at) > best.get(j, (0, 0)):
                        best[j] = (x, at)
                lo = hi
            found += [(group[i][0], -at, width, score) for i, (score, at) in sorted(best.items()) for _ in range(group[i][1])]
        return found


class Part:
    """Items as they are broadcast; a worker makes tables of them once."""

    def __init__(self, items: list[tuple]) -> None:
        self.items, self.made = items, None

    def __getstate__(self) -> list[tuple]:
        return self.items

    def __setstate__(self, items: list[tuple]) -> None:
        self.items, self.made = items, None

    def tables(self) -> Benchmark:
        self.made = self.made or Benchmark(self.items)
        return self.made


LEAK = "array<struct<item_id:long,start:long,words:long,similarity:double>>"
LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())]))


def _find(shared, threshold: float, text_at: int, keep: list[str], result: str, all_rows: bool):
    """Batches with columns ``keep`` (the first ones) and the leaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value.tables()
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                found = [bench.leaks(words, threshold) for words in word_hashes(t.as_py() for t in b.column(text_at))]
                found = [sorted(one, key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) for one in found]
                rows = [[dict(zip(("item_id", "start", "words", "similarity"), x)) for x in one] for one in found]
                out = pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, LEAK_ARROW)], names=[*keep, result])
                yield out if all_rows else out.filter(pa.array([bool(x) for x in rows]))

    return tidied(run)


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", result: str = "leaks") -> DataFrame:
    """``docs`` with the leaked items of each, an empty list where none is."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    items = written(items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")), "benchmark")
    parts = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))

    def part(i: int):
        own = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == i).orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(Part([(r["item_id"], r["text"], r["times"]) for r in own]))

    keep = [c for c in docs.columns if c != result]
    if parts == 1:
        rows, text_at = with_text(docs, keep, text_col)
        schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{result}` {LEAK}"])
        return small_batches(rows).mapInArrow(_find(part(0), threshold, text_at, keep, result, True), schema)
    text = F.col(text_col).cast("string")
    keys = [F.xxhash64(text), F.xxhash64(F.lit("leaks"), text)]
    texts = docs.select(keys[0].alias("k0"), keys[1].alias("k1"), text.alias("text"))
    found = []
    for i in range(parts):
        some = small_batches(texts).mapInArrow(_find(part(i), threshold, 2, ["k0", "k1"], "leaks", False), f"k0 long, k1 long, leaks {LEAK}")
        found.append(written(some.groupBy("k0", "k1").agg(F.first("leaks").alias("leaks")), "leaks"))
    every = reduce(DataFrame.unionByName, found).groupBy("k0", "k1").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    k0, k1, got = (free_name(docs, n) for n in ("leak_key0", "leak_key1", "leaks_found"))
    met = docs.withColumns({k0: keys[0], k1: keys[1]}).join(every.toDF(k0, k1, got), [k0, k1], "left")
    return met.select(*keep, F.coalesce(got, F.array().cast(LEAK)).alias(result))
