"""Ranked lexical search: the best documents of every item, by groups of equal
presence masks.

Terms are maximal runs of ASCII letters, digits and any characters beyond ASCII,
with A-Z in small letters.  Two passes read the texts.  The first counts documents,
terms and, for terms of items alone, documents that hold them.  The second scores:
a task takes blocks of documents and holds, for every term of an item, the list of
the block's documents that hold it and their term scores.  For one item these lists
set bits in a mask for each document, one bit a term; documents with equal masks
are a group, whose greatest possible score is the sum of the block's greatest term
scores over the mask's bits.  Groups are scored exactly in descending order of that
bound, until no bound reaches the score of the item's last hit so far; a bound that
only equals it is still scored, as ties go to smaller ids.  A task gives up to ``k``
hits for each item, so what is shuffled depends on tasks and items alone.

The items' terms go to tasks in parts of about ``PART_BYTES`` of text, each part a
scoring pass of its own.

Edge cases: a null text has no terms, and a document without terms is not counted;
rows of equal doc_id are documents of their own, null ids first among ties; rows of
equal item_id are one item with the terms of all of them, a null id included; an
item or a table without terms has no hits; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidied

#: Bytes of items' texts whose terms are in memory at once.
PART_BYTES = 16 << 20
#: Documents and term lists' entries of a block.
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 2_000_000
#: Bytes of a text that are taken apart at once.
SLICE_BYTES = 1 << 20
#: Groups that are scored between two looks at the bound.
GROUPS = 256
#: Tasks whose hits for an item meet in one first merge.
MERGES = 64

_kept = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
#: Every other byte becomes a space, and A-Z small letters.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _kept else 32 for c in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded length."""
    at = 0
    while at < len(raw):
        end = min(at + SLICE_BYTES, len(raw))
        while end < len(raw) and _TABLE[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_TABLE).split()
        at = end


def counted(raw: bytes, ids: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often those with an id occur."""
    n, found = 0, Counter()
    for some in terms(raw):
        n += len(some)
        found.update(map(ids.get, some))
    found.pop(None, None)
    return n, found


def held(raw: bytes, ids: dict[bytes, int]) -> tuple[int, set[bytes]]:
    """How many terms a text has, and which of those with an id."""
    n, found = 0, set()
    for some in terms(raw):
        n += len(some)
        found |= ids.keys() & set(some)
    return n, found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw")).filter("raw IS NOT NULL"))


def _count_part(ids: dict[bytes, int]):
    """Rows (term, n) of a task: documents that hold a term, and under -1 and -2 all
    documents and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds, docs, length = np.zeros(len(ids), np.int64), 0, 0
        for b in batches:
            for raw in b.column(0):
                n, found = held(raw.as_py(), ids)
                docs, length = docs + (n > 0), length + n
                if found:
                    holds[np.fromiter(map(ids.get, found), np.int64, len(found))] += 1
        some = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([holds[some], [docs, length]]))], names=["term", "n"])

    return run


class Best:
    """The ``k`` best (score, id) of an item so far; equal scores by least id, with
    null ids first."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that another document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        score, ids, null = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, ~null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


class Block:
    """Documents with the scores of their terms, ordered by term."""

    def __init__(self, ids: list, lengths: list[int], found: list[Counter], docs: int, length: int) -> None:
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        sizes = np.array([len(f) for f in found])
        doc = np.repeat(np.arange(len(ids)), sizes)
        term = np.fromiter((t for f in found for t in f), np.int64, len(doc))
        often = np.fromiter((v for f in found for v in f.values()), np.int64, len(doc))
        m = np.array([50 + 50 * n * docs // length for n in lengths], np.int64)
        order = np.lexsort((doc, term))
        self.doc = doc[order]
        often = often[order]
        self.value = 1_000_000_000 * often // (1000 * often + 20 * m[self.doc])
        term = term[order]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """``best`` after this block's documents, of an item with these terms."""
        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (weights > 0)
        there[there] = self.terms[at[there]] == terms[there]
        lists = [(self.starts[a], self.ends[a], w) for a, w in zip(at[there].tolist(), weights[there].tolist())]
        if not lists:
            return
        mask = np.zeros((len(self.ids), -(-len(lists) // 64)), np.uint64)
        bound = np.zeros(len(lists), np.int64)
        for j, (a, e, w) in enumerate(lists):
            mask[self.doc[a:e], j >> 6] |= np.uint64(1 << (j & 63))
            bound[j] = w * int(self.value[a:e].max())
        some = np.flatnonzero(mask.any(axis=1))
        if mask.shape[1] == 1:
            kinds, kind = np.unique(mask[some, 0], return_inverse=True)
            kinds = kinds[:, None]
        else:
            kinds, kind = np.unique(mask[some], axis=0, return_inverse=True)
        bits = np.unpackbits(kinds.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(lists))
        most = bits.astype(np.int64) @ bound
        descending = np.argsort(-most, kind="stable")
        place = np.empty(len(kinds), np.int64)
        place[descending] = np.arange(len(kinds))
        members = np.argsort(place[kind.ravel()], kind="stable")  # documents by group
        sizes = np.bincount(place[kind.ravel()], minlength=len(kinds))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for g in range(0, len(kinds), GROUPS):
            if most[descending[g]] < best.least:
                return
            good = int(np.searchsorted(-most[descending[g : g + GROUPS]], -best.least, side="right"))
            chosen = some[members[upto[g] : upto[g + good]]]
            chosen.sort()
            score = np.zeros(len(chosen), np.int64)
            for a, e, w in lists:
                own = self.doc[a:e]
                i = np.minimum(np.searchsorted(own, chosen), len(own) - 1)
                score += np.where(own[i] == chosen, w * self.value[a:e][i], 0)
            best.add(score, self.ids[chosen], self.null[chosen])


def _search_part(ids: dict[bytes, int], items: list[np.ndarray], weights: list[np.ndarray], docs: int, length: int, k: int):
    """Rows (item, id, score) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        own: tuple[list, list, list] = ([], [], [])  # ids, lengths and terms of a block
        entries = 0

        def flush() -> None:
            block = Block(*own, docs, length)
            for t, w, b in zip(items, weights, best):
                block.search(t, w, b)
            for h in own:
                h.clear()

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = counted(raw.as_py(), ids)
                if not found:
                    continue
                for h, v in zip(own, (i, n, found)):
                    h.append(v)
                entries += len(found)
                if len(own[0]) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    flush()
                    entries = 0
        if own[0]:
            flush()
        for at, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), at, np.int32)), pa.array(b.id, mask=b.null), pa.array(b.score)], names=["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for each
    item; docs' ids are integers."""
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").cast("binary").alias("raw")).filter("raw IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    out = None
    for p in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == p) if parts > 1 else asked
        found = _search(docs, own, k, id_col, text_col, item_col, item_type, id_type)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, item_col: str, item_type, id_type) -> DataFrame:
    spark = docs.sparkSession
    ids: dict[bytes, int] = {}
    by_item: dict[object, set[int]] = {}
    for r in items.toLocalIterator():  # a part of bounded size
        own = by_item.setdefault(r["item"], set())
        for some in terms(bytes(r["raw"])):
            own.update(ids.setdefault(t, len(ids)) for t in some)
    kinds = f"`{item_col}` {item_type.simpleString()}, rank int, `{id_col}` {id_type.simpleString()}, score long"
    if not ids:
        return spark.createDataFrame([], kinds)
    texts = _texts(docs, id_col, text_col)
    sums = texts.select("raw").mapInArrow(tidied(_count_part(ids)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holds = dict(sums.toLocalIterator())  # two rows and one for each term of the part
    n, length = holds.pop(-1, 0), holds.pop(-2, 0)
    if not n:
        return spark.createDataFrame([], kinds)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holds.get(t, 0) + 1))) for t in range(len(ids))], np.int64)
    keys = list(by_item)
    lists = [np.array(sorted(by_item[i]), np.int64) for i in keys]
    run = _search_part(ids, lists, [weight[t] for t in lists], n, length, k)
    hits = texts.mapInArrow(tidied(run), "item int, id long, score long").withColumn("merge", F.spark_partition_id() % MERGES)
    for by in (["item", "merge"], ["item"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("id"))
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, key) for i, key in enumerate(keys)], f"item int, name {item_type.simpleString()}")
    named = hits.join(names, "item")
    return named.select(F.col("name").alias(item_col), "rank", F.col("id").cast(id_type).alias(id_col), "score")
