"""Quality scores: random-indexing word vectors, pooled, and a small network.

Every word, word shape and word ending has a random index vector: a few +1 and
-1 at places given by its hash.  Training adds up, for each frequent word, the
index vectors of its neighbours (random indexing).  A word's vector is its
context vector plus the index vectors of its shape and ending, so unseen words
have one too.  A document is the mean of its words' vectors, with the logarithm
of its number of words, whether it has any, and the share of words whose vector
is that of the word before; a network of two layers, trained with numpy, gives a
logit, and a temperature fitted on a part of the sample that training did not see
makes its probabilities calibrated.  Classes are sampled evenly; the logit is
moved by their true odds.

Training takes about ``SAMPLE_ROWS`` labelled rows of each class, the first ones in
the order of a hash of their id and text; equal labelled rows count once.  Their
texts are read whole, on executors: the driver gets the ``VOCABULARY`` most
frequent words of the sample with their context vectors, and one row of features
for each sampled document.  Scoring reads whole texts, holds one batch at a time
and shuffles nothing.

Edge cases: null and empty texts score as a document without words; with no
labels, or labels of one class alone, the score is that class's share (0.5
without any); rows repeat as they are; other columns pass through unless they
have the names of results, which replace them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, small_batches, tidied, with_text, written
from .shingles import slices

DIM = 64
NONZERO = 6
WINDOW = 2
VOCABULARY = 8_000
HIDDEN = 32
SAMPLE_ROWS = 3_000
FAR = 6.0
#: Words that are longer are looked at anew each time and not kept.
KEPT_CHARS = 64
#: Characters of a text that are split at once.
SLICE_CHARS = 1 << 20
#: Rows of word vectors that a worker keeps before it starts anew.
TABLE_ROWS = 1 << 17
BATCH_ROWS = 512
_CLASSES = {ord(c): "x" for c in "abcdefghijklmnopqrstuvwxyz"} | {ord(c): "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord(c): "9" for c in "0123456789"}
_RUN = re.compile(r"(.)\1+")


def index_vector(name: str) -> np.ndarray:
    """Sparse, ternary, the same everywhere."""
    rng = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode("utf-8", "surrogatepass"))))
    v = np.zeros(DIM, dtype=np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), NONZERO)
    return v / np.sqrt(np.float32(NONZERO))


def shape_of(word: str) -> str:
    """Letters, digits and marks by class, runs shortened: 'Ab99%%' is 'Xx9%'."""
    shape = word.translate(_CLASSES)
    if not shape.isascii():
        shape = "".join(c if c.isascii() else "x" if c.islower() else "X" if c.isupper() else "o" for c in shape)
    return _RUN.sub(r"\1", shape)


def words_in(text: str | None) -> Iterator[list[str]]:
    """The words of a text, slice by slice."""
    for part in slices(text or "", SLICE_CHARS):
        yield part.split()


class WordTable:
    """Word vectors as rows of one array, filled as words are met."""

    def __init__(self, context: dict[str, np.ndarray]) -> None:
        self.context = context
        self.parts: dict[str, np.ndarray] = {}
        self.start()

    def start(self) -> None:
        self.rows: dict[str, int] = {}
        self.kinds: dict[tuple[str, str], int] = {}
        self.vectors = np.zeros((1024, DIM), dtype=np.float32)
        self.used = 0

    def _part(self, name: str) -> np.ndarray:
        if (v := self.parts.get(name)) is None:
            if len(self.parts) > TABLE_ROWS:
                self.parts.clear()
            v = self.parts[name] = index_vector(name)
        return v

    def _add(self, v: np.ndarray) -> int:
        if self.used == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.used] = v
        self.used += 1
        return self.used - 1

    def row(self, word: str) -> int:
        shape, end = shape_of(word), word[-2:].lower()
        # A shape may be as long as its word; its hash is not.
        kind = (xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")), end)
        known = self.context.get(word)
        r = self.kinds.get(kind) if known is None else None
        if r is None:
            of_shape = self._part("shape " + shape) if len(shape) <= KEPT_CHARS else index_vector("shape " + shape)
            v = of_shape + np.float32(0.5) * self._part("end " + end)
            r = self._add(v if known is None else v + known)
            if known is None:
                self.kinds[kind] = r
        if len(word) <= KEPT_CHARS:
            self.rows[word] = r
        return r

    def numbers(self, text: str | None) -> np.ndarray:
        """The row of each word of a text."""
        get, out = self.rows.get, [np.zeros(0, np.int32)]
        for words in words_in(text):
            got = [get(w) for w in words]
            if None in got:
                got = [self.row(w) if (r := get(w)) is None else r for w in words]
            out.append(np.array(got, dtype=np.int32))
        return out[1] if len(out) == 2 else np.concatenate(out)

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """One row of features for each text."""
        if len(self.rows) > 2 * TABLE_ROWS or self.used > TABLE_ROWS:
            self.start()
        ids = [self.numbers(t) for t in texts]
        sizes = [len(x) for x in ids]
        out = np.zeros((len(texts), DIM), dtype=np.float64)
        for i, rows in enumerate(ids):
            for at in range(0, len(rows), 1 << 16):
                out[i] += self.vectors[rows[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        # Repetition: the share of words whose vector is that of the one before.
        again = np.array([np.mean(r[1:] == r[:-1]) if len(r) > 1 else 0.0 for r in ids])
        n = np.array(sizes, dtype=np.float64)
        out /= np.maximum(n, 1)[:, None]
        return np.concatenate([out, np.log1p(n)[:, None], (n == 0)[:, None].astype(float), again[:, None]], axis=1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column(0):
            for words in words_in(text.as_py()):
                names, n = np.unique(np.array(words, dtype=object), return_counts=True) if words else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def _count_pairs(shared):
    """How often kept words stand within ``WINDOW`` words of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        for b in batches:
            keys = [np.zeros(0, np.int64)]
            for text in b.column(0):
                last = np.zeros(0, np.int64)  # a slice meets the end of the one before
                for words in words_in(text.as_py()):
                    new = len(last)
                    ids = np.concatenate([last, np.array([number.get(w, -1) for w in words], dtype=np.int64)])
                    for off in range(1, WINDOW + 1):
                        x, y = ids[:-off], ids[off:]
                        ok = (x >= 0) & (y >= 0) & (np.arange(off, len(ids)) >= new)
                        keys += [(x[ok] << 32) + y[ok], (y[ok] << 32) + x[ok]]
                    last = ids[-WINDOW:]
            pairs, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return run


def _add_up(shared):
    """Sums of neighbours' index vectors, for rows (a, b, n) in the order of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.stack([index_vector("word " + w) for w in shared.value])
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 14):
                a, b, n = (c.to_numpy() for c in whole.slice(lo, 1 << 14).columns)
                left, first = np.unique(a, return_index=True)
                some = np.add.reduceat(index[b] * np.log1p(n).astype(np.float32)[:, None], first, axis=0)
                for i, v in zip(left.tolist(), some):
                    sums[i] = sums[i] + v if i in sums else v
        vectors = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), vectors], names=["a", "v"])

    return run


def context_vectors(texts: DataFrame) -> dict[str, np.ndarray]:
    """Random indexing over the texts: neighbours' index vectors, summed."""
    context = texts.sparkSession.sparkContext
    words = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 5")
    kept = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    if not kept:
        return {}
    shared = context.broadcast(kept)
    pairs = texts.mapInArrow(_count_pairs(shared), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sums = pairs.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_add_up(shared), "a long, v array<double>").collect()
    out = np.zeros((len(kept), DIM), dtype=np.float32)
    for r in sums:
        out[r["a"]] = r["v"]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return dict(zip(kept, out))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in deviations from their mean, ``FAR`` of them at most, so that one
    feature unlike any of the sample doesn't decide alone."""
    return np.clip((x - mean) / scale, -FAR, FAR)


@dataclass
class Model:
    """What scoring needs; a few megabytes."""

    context: dict[str, np.ndarray] = field(default_factory=dict)
    share: float = 0.5
    layers: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.maximum(standard(x, mean, scale) @ w1 + b1, 0) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        odds = np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + odds, -500, 500)))


def train(context: dict[str, np.ndarray], x: np.ndarray, labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """A model from a sample's features; ``share`` is that of label 1 among all
    labels."""
    model, y = Model(context, share=float(share)), labels.astype(float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, use = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    x0 = standard(x, mean, scale)
    width = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    # Each class has the same weight, so that logits are free of the sample's odds.
    weight = np.where(y == 1, 0.5 / max(y[use].mean(), 1e-9), 0.5 / max(1 - y[use].mean(), 1e-9))
    for _ in range(60):
        rng.shuffle(use)
        for at in range(0, len(use), 128):
            i = use[at : at + 128]
            h = np.maximum(x0[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            dz = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i]) * weight[i] / len(i)
            dh = np.outer(dz, p[2]) * (h > 0)
            grads = [x0[i].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ dz + 1e-4 * p[2], dz.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = (mean, scale, *p)
    odds = np.log(share / (1 - share))
    ph = max(y[held].mean(), 1e-9) if len(held) else 0.5
    wh = np.where(y[held] == 1, share / ph, (1 - share) / max(1 - ph, 1e-9))
    z = model.logits(x[held])

    def loss(t: float) -> float:
        s = np.clip(z / t + odds, -500, 500)
        return float((wh * (np.logaddexp(0, s) - y[held] * s)).sum())

    if len(held):
        model.temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, teach: Column, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model from the labels of rows for which ``teach`` holds.

    The ids of sampled labels, about ``SAMPLE_ROWS`` of each class, are broadcast
    to the documents, whose texts are not shuffled; of documents that share an id
    no more are taken.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & teach).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Model(share=share if sizes else 0.5)
    span = 1 << 32
    part = {y: min(span, SAMPLE_ROWS * span // n) for y, n in sizes.items()}
    below = F.when(F.col("y") == 1, F.lit(part[1])).otherwise(F.lit(part[0]))
    sample = known.filter(F.pmod(F.xxhash64(F.lit("label"), id_col), F.lit(span)) < below)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col)
    rows = written(rows.select("text", "y", F.xxhash64(id_col, "text").alias("h")).dropDuplicates(["h", "y"]), "quality-sample")
    # Rows are as many as labels unless ids repeat; then the first by hash stay.
    ranked = rows.select("h", "y", F.row_number().over(Window.partitionBy("y").orderBy("h")).alias("r"))
    rows = rows.join(F.broadcast(ranked.filter(F.col("r") <= 2 * SAMPLE_ROWS).select("h", "y")), ["h", "y"], "left_semi")
    context = context_vectors(rows.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Model(context))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.context)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                x = table.pooled([t.as_py() for t in b.column(2)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["h", "y", "x"])

    got = small_batches(rows.select("h", "y", "text")).mapInArrow(tidied(features), "h long, y int, x array<double>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(share=share)
    return train(context, np.array(got["x"].to_pylist()), y, share)


def score(docs: DataFrame, model: Model, text_col: str = "text", result: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    keep = [c for c in docs.columns if c != result]
    given, text_at = with_text(docs, keep, text_col)
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        model = shared.value
        table = WordTable(model.context)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                p = model.probability(table.pooled(b.column(text_at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(p)], names=[*keep, result])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return small_batches(given).mapInArrow(tidied(run), f"{schema}, `{result}` double")
