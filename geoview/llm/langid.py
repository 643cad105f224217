"""Language identification by prediction by partial matching.

For every language there is a tree of byte contexts of up to three bytes, with
the counts of the bytes that followed them in training.  A byte costs -log2 of
its frequency in the longest known context in which it was seen; on the way
down, each known context in which it was not seen adds the cost of an escape
(method C: distinct / (total + distinct)), and a byte never seen costs 8 bits
after all escapes.  Statistics are frozen, so every cost is a fixed number for
four bytes; the tables below hold it for each known context and byte of any
language, exactly, with one array of columns per language.  A text's code
length in a language is the sum over all its bytes; the shortest wins.

The score is the posterior of the best language, all alike before, on the evidence
of ``EVIDENCE`` average bytes of the text (or of all, if it has fewer): with all
bytes it would be 1 for any text of some words.  So it says how far the text
as a whole is from the next languages, and one that fits several alike, as
lists of codes or mixtures do, has a low score.

Training counts bytes on executors over a bounded sample of labelled texts:
about ``SAMPLE_ROWS`` of each language, chosen by a hash of text and id, so that it
is the same whatever the partitions and copies of a text under different ids are
chosen apart; rows that agree in both, or a table without ids, count once.
Only counts reach the driver; they grow with the sample, not with the corpus.
Languages are taken in groups of ``GROUP``, each with tables of its own; code
lengths of one language do not depend on others, so several groups are as many
passes, each of which hands on the best language so far.

Edge cases: a null text or one without letters gets ``und`` and score 0; texts
of any length are scored whole, in blocks; if nothing can be learned, every
prediction is ``und``; a null or empty language teaches nothing; ties go to the
language that sorts first; other columns pass through unless they have the
names of results, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, free_name, small_batches, tidied, with_text, written

#: Rows to learn from, of each language, as expected under the row hash.
SAMPLE_ROWS = 1_500
#: Places of a row's hash, so many that rows of any table hardly share one.
PLACES = 1 << 62
#: Languages of one set of tables, which a worker holds.
GROUP = 16
#: Bytes on whose evidence the score is given.
EVIDENCE = 4.0
#: Bytes scored at a time.
BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number; zeros go first."""
    b = np.frombuffer(b"\0\0\0" + text, dtype=np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


class _Index:
    """Row numbers of 32-bit keys by open hashing; unknown keys get -1."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = np.zeros(1 << bits, dtype=np.uint32)
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        self.depth = 0
        while len(left):
            free = self.rows[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.rows[slots], self.keys[slots] = left[won], keys[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.rows) - 1)
            self.depth += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        for _ in range(self.depth):
            if not len(open_):
                break
            at_open = (at[open_] + 1) & (len(self.rows) - 1)
            at[open_] = at_open
            rows = self.rows[at_open]
            hit = (rows >= 0) & (self.keys[at_open] == keys[open_])
            out[open_[hit]] = rows[hit]
            open_ = open_[(rows >= 0) & ~hit]
        return out


@dataclass
class Model:
    """Frozen costs in bits; the last axis of each table is the language."""

    languages: list[str]
    index4: _Index
    cost4: np.ndarray
    index3: _Index
    cost3: np.ndarray
    escape3: np.ndarray
    cost2: np.ndarray
    escape2: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> "Model":
        """From counts of four-byte entries, given by language number."""
        n, width = len(languages), 1 << 32
        count = count.astype(np.float64)

        def level(shift: int, parent_cost, parent_escape):
            """Costs of the known (context, byte) pairs of one order."""
            mask = np.int64(shift - 1) if shift < width else np.int64(width - 1)
            key = gram.astype(np.int64) & mask
            keys, row = np.unique(key, return_inverse=True)
            freq = np.zeros((len(keys), n))
            np.add.at(freq, (row, lang), count)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, freq)
            np.add.at(kinds, of, (freq > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                seen = -np.log2(freq / (total + kinds)[of])
            below = parent_cost(keys) + escape[of]
            return keys, np.where(freq > 0, seen, below), contexts, escape

        flat = lambda keys: np.full((len(keys), n), 8.0)
        k1, c1, _, e1 = level(1 << 8, flat, None)
        cost1 = np.full((256, n), 8.0) + (e1[0] if len(e1) else 0.0)
        cost1[k1] = c1
        k2, c2, x2, e2 = level(1 << 16, lambda keys: cost1[keys & 255], None)
        escape1 = np.zeros((256, n))
        escape1[x2] = e2
        every = np.arange(1 << 16)
        cost2 = cost1[every & 255] + escape1[every >> 8]
        cost2[k2] = c2
        k3, c3, x3, e3 = level(1 << 24, lambda keys: cost2[keys & 0xFFFF], None)
        escape2 = np.zeros((1 << 16, n))
        escape2[x3] = e3
        row3 = lambda keys: np.searchsorted(k3, keys & 0xFFFFFF)  # noqa: E731  training keys are all known
        k4, c4, x4, e4 = level(width, lambda keys: c3[row3(keys)], None)
        # escape3 belongs to a context of three bytes, in a table of its own rows.
        order = np.unique(np.concatenate([k3, x4]))
        at3 = np.searchsorted(order, k3)
        full3 = cost2[order & 0xFFFF] + escape2[order >> 8]
        full3[at3] = c3
        full_e3 = np.zeros((len(order), n))
        full_e3[np.searchsorted(order, x4)] = e4
        f = np.float32
        return cls(languages, _Index(k4.astype(np.uint32)), c4.astype(f), _Index(order.astype(np.uint32)), full3.astype(f), full_e3.astype(f), cost2.astype(f), escape2.astype(f))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        row = self.index4.find(grams)
        out = self.cost4[np.maximum(row, 0)]
        odd = np.flatnonzero(row < 0)
        if len(odd):
            g = grams[odd]
            low = g & np.uint32(0xFFFFFF)
            r3 = self.index3.find(low)
            c3 = np.where(r3[:, None] >= 0, self.cost3[np.maximum(r3, 0)], self.cost2[low & np.uint32(0xFFFF)] + self.escape2[low >> np.uint32(8)])
            rx = self.index3.find(g >> np.uint32(8))
            out[odd] = c3 + np.where(rx[:, None] >= 0, self.escape3[np.maximum(rx, 0)], np.float32(0))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + sizes[hi] <= BLOCK):
                held += sizes[hi]
                hi += 1
            if held <= BLOCK:
                grams = [_grams(t) for t in texts[lo:hi]]
                costs = self.costs(np.concatenate(grams)) if held else np.zeros((0, len(self.languages)), np.float32)
                run = np.concatenate([np.zeros((1, costs.shape[1])), np.cumsum(costs, axis=0, dtype=np.float64)])
                ends = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                total[lo:hi] = run[ends[1:]] - run[ends[:-1]]
            else:  # one text longer than a block
                t = texts[lo]
                for at in range(0, len(t), BLOCK):
                    grams = _grams(t[max(0, at - 3) : at + BLOCK])
                    total[lo] += self.costs(grams[min(at, 3) :]).sum(axis=0, dtype=np.float64)
            lo = hi
        return total


def _count_part(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                by: dict[int, list[np.ndarray]] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(number[lang], []).append(_grams(text.lower().encode("utf-8", "surrogatepass")))
                for i, grams in by.items():
                    keys, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def chosen_below(rows: int) -> int:
    """Of ``PLACES`` that hashes fall on, those that choose ``SAMPLE_ROWS`` of so many
    rows on average."""
    return min(PLACES, SAMPLE_ROWS * PLACES // max(rows, 1))


def fit(docs: DataFrame, teach: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[Model]:
    """Models of groups of languages, from the rows for which ``teach`` holds; none
    if there is nothing to learn."""
    rows = docs.filter(teach & F.col(lang_col).isNotNull() & (F.col(lang_col) != ""))
    # The languages that labels name, one small row each.
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).agg(F.count(F.lit(1))).collect()}
    languages = sorted(sizes)
    span = PLACES
    models = []
    # The hash is of text and id alone, so a row is chosen wherever it lies.
    own = [c for c in (text_col, id_col) if c in docs.columns]
    place, other = F.pmod(F.xxhash64(F.lit("sample"), *own), F.lit(span)), F.xxhash64(F.lit("other"), *own)
    for lo in range(0, len(languages), GROUP):
        some = languages[lo : lo + GROUP]
        below = F.create_map(*[F.lit(x) for lang in some for x in (lang, chosen_below(sizes[lang]))])
        lang = F.col(lang_col).cast("string")
        sample = rows.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), place.alias("p"), other.alias("q")).filter(F.col("text").isNotNull() & (F.col("p") < F.try_element_at(below, "lang")))
        sample = sample.dropDuplicates(["p", "q", "lang"])
        counts = small_batches(sample.select("text", "lang")).mapInArrow(tidied(_count_part(some)), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        got = counts.toArrow()
        if got.num_rows:
            models.append(Model.fit(some, got["lang"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy()))
    return models


def score_of(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over languages of their odds against the best one, from bits more than
    its code length, on the evidence of a few average bytes."""
    part = np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))
    return np.exp2(-np.minimum(gaps * part[:, None], 1000.0)).sum(axis=1)


def _predict_part(shared, text_at: int, ok_at: int, before: int | None, keep: int, names: list[str]):
    """Columns ``keep`` (the first ones) and the best language, its bits and the
    sum of odds; ``before`` is where these stand for languages that came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language", lambda: None)
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                ok = b.column(ok_at).to_numpy(zero_copy_only=False).astype(bool)
                lang, bits, odds = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows), np.zeros(b.num_rows)
                if ok.any():
                    texts = [t.as_py().lower().encode("utf-8", "surrogatepass") for t, k in zip(b.column(text_at), ok) if k]
                    size = np.array([len(t) for t in texts])
                    length = model.lengths(texts)
                    least = length.min(axis=1)
                    mine, total = np.array(model.languages, dtype=object)[length.argmin(axis=1)], score_of(length - least[:, None], size)
                    if before is not None:
                        old_lang, old_least, old_total = (b.column(before + i).to_numpy(zero_copy_only=False)[ok] for i in range(3))
                        best = np.minimum(least, old_least)
                        total = total * score_of((least - best)[:, None], size) + old_total * score_of((old_least - best)[:, None], size)
                        mine, least = np.where(old_least <= least, old_lang, mine), best
                    lang[ok], bits[ok], odds[ok] = mine, least, total
                yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(lang, pa.string()), pa.array(bits), pa.array(odds)], names=names)

    return tidied(run)


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score."""
    keep = [c for c in docs.columns if c not in results]
    if not models:
        return docs.select(*keep, F.lit("und").alias(results[0]), F.lit(0.0).alias(results[1]))
    given, text_at = with_text(docs, keep, text_col)
    given = given.withColumn(free_name(given, "lettered"), F.coalesce(F.col(given.columns[text_at]).rlike(r"\p{L}"), F.lit(False)))
    ok_at = len(given.columns) - 1
    state = [free_name(given, n) for n in ("best_lang", "best_bits", "best_odds")]
    rows = given
    for i, model in enumerate(models):
        last = i == len(models) - 1
        names = [*(keep if last else given.columns), *state]
        kinds = [*(given.schema[c].dataType.simpleString() for c in names[:-3]), "string", "double", "double"]
        shared = docs.sparkSession.sparkContext.broadcast(model)
        run = _predict_part(shared, text_at, ok_at, ok_at + 1 if i else None, len(names) - 3, names)
        rows = small_batches(rows).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))
        if not last:
            # One group's tables at a time: the next pass has tasks of its own.
            rows = written(rows, "languages")
    return rows.select(*keep, F.col(state[0]).alias(results[0]), F.when(F.col(state[2]) > 0, 1.0 / F.col(state[2])).otherwise(0.0).alias(results[1]))
