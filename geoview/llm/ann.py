"""Nearest neighbours by inner product: multi-index hashing of learned codes.

Fitting takes ``SAMPLE_ROWS`` vectors, the first in the order of a hash of id
and vector.  Vectors get one more component that makes all norms equal (so that
the nearest direction is the largest inner product).  Code bits are the signs
after learned rotations: principal axes, then iterative quantisation, from
several starting rotations where one has fewer axes than bits.  For each of
``SETTINGS`` the Hamming radius is the ``QUANTILE`` of distances between codes of
``FIT_QUERIES`` sampled queries and their true neighbours, at the rank in the
sample that matches ``k`` in the whole table; the setting of the least expected
work, as the sample shows it, is used.  ``Coder.touched`` and ``Coder.kept`` are
the shares of pairs that its tables and then its radius let through.

A code is cut into 16-bit substrings, each with a hash table from value to rows.
By the generalised pigeonhole principle a code within the radius R has a
substring within t_j of the query's, where the t_j + 1 sum to R + 1; so probing
the values within t_j in every table retrieves every code within R.  Values are
enumerated by flipping bits, or, where a table holds fewer values than flips
make, by going through its values.  What a probe finds is tested against the
whole radius, and what is left is reranked by exact inner products in double
precision.  A pair that several tables find is reported by the first of them.
A query that found fewer than k is searched again with the radius of all bits.

On Spark, a table's values are cut by their leading bits into cells of about
``CELL_ROWS`` rows, a fuller cell (as of a vector that many rows share) into
parts; a row goes to one part of its cell in every table, a query to the cells
that hold values within t_j of its own, and they meet by cell in one shuffle.  A
task holds the rows of one part at a time and streams queries past them.
Neither vectors nor queries pass through the driver, but for the sample; the
driver sees one count for each cell.  Each part returns k rows for a query at
most.

How much probing saves depends on the vectors: it follows from t_j, so from how
much nearer neighbours are than other rows.

Edge cases: vectors that are null, zero or hold null or non-finite components,
and rows without id, take no part; vectors are searched among those of their own
length; rows with the query's own id are no candidates; equal scores go to the
smaller id; repeated rows are candidates each, and a repeated query id is
searched once, with the first of its vectors in order of their values; products
beyond the range of doubles score infinite, and what is then no number ranks
last; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE_ROWS = 8_192
#: Sampled vectors that the radius is fitted on; each meets the whole sample.
FIT_QUERIES = 256
#: Bits of a code, which are cut into substrings of 16.
SETTINGS = (64, 128)
PART = 16
QUANTILE = 0.94
#: Rows of a cell, as aimed at; parts of fuller cells hold twice as many at most.
CELL_ROWS = 16_384
#: Queries probed together; it bounds the size of the intermediate arrays.
PROBE = 32
#: Work of reranking one pair, as a multiple of that of finding it in a table.
RERANK = 4.0
BATCH_ROWS = 2_048


def thresholds(radius: int, parts: int) -> list[int]:
    """Flips allowed in each substring; -1 leaves a table out."""
    base, more = divmod(radius + 1, parts)
    return [base - 1 + (j < more) for j in range(parts)]


@dataclass
class Coder:
    norm: float
    scale: float
    rotation: np.ndarray
    radius: int
    flips: list[int]
    touched: float = 1.0
    kept: float = 1.0

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of unsigned 16-bit substrings."""
        bits = (np.concatenate([x, _rest(x, self.norm, self.scale, query)[:, None]], axis=1) / self.scale @ self.rotation) > 0
        return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint16)

    def everywhere(self) -> "Coder":
        """The same codes with the radius of all bits, which one table serves."""
        return replace(self, radius=self.rotation.shape[1], flips=[PART] + [-1] * (len(self.flips) - 1))


def _rest(x: np.ndarray, norm: float, scale: float, query: bool) -> np.ndarray:
    """The component that makes all norms equal; 0 for queries."""
    if query:
        return np.zeros(len(x))
    return np.sqrt(np.maximum((norm / scale) ** 2 - ((x / scale) ** 2).sum(axis=1), 0)) * scale


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all codes of ``a`` and all of ``b``."""
    return np.bitwise_count(_words(a)[:, None, :] ^ _words(b)[None, :, :]).sum(axis=2, dtype=np.uint16)


def learn_rotation(x: np.ndarray, bits: int, seed: int = 5, rounds: int = 20) -> np.ndarray:
    """Principal axes, then iterative quantisation; columns give code bits."""
    rng = np.random.default_rng(seed)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)][:, :bits]
    y = x @ axes
    columns: list[np.ndarray] = []
    while sum(c.shape[1] for c in columns) < bits:
        r = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        columns.append(axes @ r)
    return np.concatenate(columns, axis=1)[:, :bits]


def fit(sample: np.ndarray, rows: int, norm: float, scale: float, k: int) -> Coder:
    """A coder from sampled vectors, in random order, of a table with ``rows`` rows."""
    whole = np.concatenate([sample, _rest(sample, norm, scale, False)[:, None]], axis=1) / scale
    queries = sample[:FIT_QUERIES]
    near = min(len(sample) - 1, max(1, round(k * len(sample) / max(rows, 1))))
    score = queries / scale @ (sample / scale).T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    found = []
    for bits in SETTINGS:
        coder = Coder(norm, scale, learn_rotation(whole, bits), bits, thresholds(bits, bits // PART))
        if near >= 1:
            top = np.argpartition(-score, near - 1, axis=1)[:, :near]
            q, c = coder.codes(queries, True), coder.codes(sample)
            d = hamming(q, c)
            coder.radius = int(np.quantile(np.take_along_axis(d, top, axis=1), QUANTILE)) + 1
            coder.flips = thresholds(coder.radius, bits // PART)
            coder.kept = float((d <= coder.radius).mean())
            coder.touched = float(sum((np.bitwise_count(q[:, j, None] ^ c[None, :, j]) <= t).mean() for j, t in enumerate(coder.flips)))
        found.append(coder)
    return min(found, key=lambda c: c.touched + RERANK * c.kept)


def masks(flips: int) -> np.ndarray:
    """All 16-bit values with at most ``flips`` bits set."""
    return np.array([sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(PART), n)], dtype=np.uint16)


def flip_count(flips: int) -> int:
    return sum(math.comb(PART, n) for n in range(flips + 1))


class HashTable:
    """From the values of one substring to the rows that have them."""

    def __init__(self, codes: np.ndarray, part: int) -> None:
        self.codes, self.part = codes, part
        self.order = np.argsort(codes[:, part], kind="stable")
        self.values, self.first = np.unique(codes[self.order, part], return_index=True)
        self.last = np.append(self.first[1:], len(codes))

    def probe(self, queries: np.ndarray, flips: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose substrings are within ``flips``."""
        mine = queries[:, self.part]
        if flip_count(flips) < len(self.values):
            wanted = mine[:, None] ^ masks(flips)[None, :]
            at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            q, m = np.nonzero(self.values[at] == wanted)
            v = at[q, m]
        else:
            q, v = np.nonzero(np.bitwise_count(mine[:, None] ^ self.values[None, :]) <= flips)
        n = self.last[v] - self.first[v]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.order[np.repeat(self.first[v], n) + within]

    def within(self, queries: np.ndarray, radius: int, flips: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs within ``radius`` that no earlier table finds."""
        q, r = self.probe(queries, flips[self.part])
        d = np.bitwise_count(_words(queries)[q] ^ _words(self.codes)[r]).sum(axis=1)
        near = d <= radius
        q, r = q[near], r[near]
        new = np.ones(len(q), bool)
        for j in range(self.part):
            new &= np.bitwise_count(queries[q, j] ^ self.codes[r, j]).astype(int) > flips[j]
        return q[new], r[new]


class MultiIndex:
    """One hash table for each substring, in one process."""

    def __init__(self, codes: np.ndarray) -> None:
        self.tables = [HashTable(codes, j) for j in range(codes.shape[1])]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of all codes within ``radius``, each once."""
        flips = thresholds(radius, len(self.tables))
        pairs = [t.within(queries, radius, flips) for t in self.tables if flips[t.part] >= 0]
        return np.concatenate([q for q, _ in pairs]), np.concatenate([r for _, r in pairs])


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cells(codes: np.ndarray, part: int, lead: int) -> np.ndarray:
    return codes[:, part].astype(np.int64) >> (PART - lead)


def _count_cells(shared, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for whole in batches:
            codes = coder.codes(_vectors(whole.column(0)))
            for j in range(codes.shape[1]):
                cell, n = np.unique(_cells(codes, j, lead), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell + (j << PART)), pa.array(n)], names=["cell", "n"])

    return run


def _place(shared, lead: int):
    """Rows of the tables: key (cell and part), side 0, id, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, parts = shared.value
        seen = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                codes = coder.codes(_vectors(b.column(1)))
                # Rows are dealt to a cell's parts in turn, so that equal rows part too.
                turn = np.arange(seen, seen + b.num_rows)
                seen += b.num_rows
                for j in [j for j, t in enumerate(coder.flips) if t >= 0]:
                    cell = _cells(codes, j, lead)
                    key = ((cell + (j << PART)) << 24) + turn % parts[j, cell]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int32)), b.column(0), b.column(1)], names=["key", "side", "id", "x"])

    return run


def _ask(shared, lead: int):
    """Queries for every part of each cell that may hold what they look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, parts = shared.value
        every = np.arange(1 << lead)
        for whole in batches:
            for lo in range(0, whole.num_rows, PROBE):
                b = whole.slice(lo, PROBE)
                codes = coder.codes(_vectors(b.column(1)), True)
                for j in [j for j, t in enumerate(coder.flips) if t >= 0]:
                    q, cell = np.nonzero((np.bitwise_count(_cells(codes, j, lead)[:, None] ^ every[None, :]) <= coder.flips[j]) & (parts[j] > 0)[None, :])
                    n = parts[j, cell]
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    key = (np.repeat(cell + (j << PART), n) << 24) + within
                    for at in range(0, len(key), BATCH_ROWS):
                        who = pa.array(np.repeat(q, n)[at : at + BATCH_ROWS])
                        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + BATCH_ROWS]), pa.array(np.ones(len(who), np.int32)), b.column(0).take(who), b.column(1).take(who)], names=["key", "side", "id", "x"])

    return run


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def _search(shared, k: int):
    """The k best rows of a part for each query, from rows in order of (key,
    side): first a part's rows, of which the table is made, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = shared.value
        key, held, table, x, ids = None, [], None, None, None
        for whole in batches:
            keys, sides = (whole.column(i).to_numpy() for i in (0, 1))
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, held, table = keys[lo], [], None
                some = whole.slice(lo, hi - lo)
                if sides[lo] == 0:
                    held.append((some.column(2).to_numpy(), _vectors(some.column(3))))
                    continue
                if not held and table is None:
                    continue
                if table is None:
                    ids, x = (np.concatenate(c) for c in zip(*held))
                    table, held = HashTable(coder.codes(x), int(key) >> (24 + PART)), []
                qid, qx = some.column(2).to_numpy(), _vectors(some.column(3))
                qcode = coder.codes(qx, True)
                for at in range(0, len(qid), PROBE):
                    q, r = table.within(qcode[at : at + PROBE], coder.radius, coder.flips)
                    q = q + at
                    other = qid[q] != ids[r]
                    q, r = q[other], r[other]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = np.concatenate([np.einsum("ij,ij->i", qx[q[i : i + 65536]], x[r[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
                    q, found, score = _best(q, ids[r], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Finite throughout and not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def nearest(table: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row that is a query."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count_if("q").alias("q"), F.max(F.array_max(F.transform("x", F.abs))).cast("double").alias("scale")).filter("q > 0")
    found = [_nearest(rows.filter(F.size("x") == r["d"]), r["scale"], k) for r in lengths.orderBy("d").collect()]
    if not found:
        return table.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, found)


def fitted(rows: DataFrame, scale: float, k: int) -> tuple[Coder, int]:
    """A coder for ``rows`` (id, x, q) of one length, and their number."""
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") / scale, F.lit(2.0)))) * scale
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("norm")).first()
    span = 1 << 32
    place = F.pmod(F.xxhash64(F.lit("ann"), "id", "x"), F.lit(span))
    # The filter leaves twice as many as are taken, so that a sort over all is spared.
    some = rows.select("id", "x", place.alias("p")).filter(F.col("p") < max(1, min(span, 2 * SAMPLE_ROWS * span // stats["n"])))
    got = some.orderBy("p", "id", "x").limit(SAMPLE_ROWS).select("x").toArrow()["x"]
    if not len(got):  # a few rows whose hashes all lie beyond
        got = rows.select("id", "x", place.alias("p")).orderBy("p", "id", "x").limit(SAMPLE_ROWS).select("x").toArrow()["x"]
    return fit(_vectors(got.combine_chunks()), stats["n"], stats["norm"], scale, k), stats["n"]


def _nearest(rows: DataFrame, scale: float, k: int) -> DataFrame:
    coder, n = fitted(rows, scale, k)
    context = rows.sparkSession.sparkContext
    lead = min(PART, max(0, math.ceil(math.log2(max(1.0, n / CELL_ROWS)))))
    # One count for each cell of each table: 2 ** lead, as many as N / CELL_ROWS.
    counts = np.zeros((len(coder.flips), 1 << lead), np.int64)
    only = context.broadcast(coder)
    for r in rows.select("x").mapInArrow(_count_cells(only, lead), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"] >> PART, r["cell"] & 0xFFFF] = r["n"]
    parts = -(-counts // (2 * CELL_ROWS))
    kind = rows.schema["x"].dataType.simpleString()
    schema = f"key long, side int, id long, x {kind}"

    def search(queries: DataFrame, coder: Coder) -> DataFrame:
        shared = context.broadcast((coder, parts))
        both = rows.select("id", "x").mapInArrow(_place(shared, lead), schema).unionByName(queries.mapInArrow(_ask(shared, lead), schema))
        met = both.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_search(shared, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = rows.filter("q").groupBy("id").agg(F.min("x").alias("x"))
    found = written(search(queries, coder), "nearest")
    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, n - 1)).select("id")
    short = queries.join(enough, "id", "left_anti")
    if not short.isEmpty():
        wide = search(short, coder.everywhere())
        found = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(wide)
    return found.select("query_id", "rank", "vec_id", "score")
