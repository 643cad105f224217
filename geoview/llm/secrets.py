"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Patterns of three kinds give the base spans.  A conditional random field adds
others: it tags tokens as beginning a secret, inside one, or outside, from features of
their shape, of neighbouring words and marks, and of the file that they stand in.  It
is trained, by the gradient of the exact log-likelihood, to tag as secret what the
patterns find in a bounded sample of documents; what it has learned of shapes and
contexts then finds values that no pattern names.  A span of its own that meets a
base span is dropped, as the base span stays.

Every character but white space stands in one token, a run of letters, digits and
``_+/=-`` or one of other marks, and a text is one chain of all of its tokens: none is
outside by rule, in training or in decoding.  What a token adds to the scores of itself
and of its neighbours is summed once for each distinct piece of text, so that scoring is
a few lookups a token.  Where ``outside`` leads by more than steps and the next token
could ever make up for, every best path is outside; the Viterbi recursion then runs
between such tokens only, and its path is that of the whole chain.

Edge cases: a null text is empty and has no spans; whole texts are read, of any
length; equal rows have equal results; a sample without secrets trains a model that
finds none; an empty table has an empty result; columns of other names stay out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

#: Bounds of the sample that the model learns from: documents on average, and
#: segments (pieces of chains) with a secret and without one.
SAMPLE_DOCS, SECRET_SEGMENTS, OTHER_SEGMENTS = 8_000, 3_000, 6_000
FEATURES = 1 << 17
#: Groups of tokens, and the characters that make a word without digits a long one.
GROUPS, LONG_CHARS = 3, 20
#: Steps of training, their rate and the weight of the squared weights.
STEPS, RATE, DECAY = 120, 0.1, 1e-4
KINDS = ("assign", "access", "hex", "crf")
#: Tags: outside, begin, inside; inside follows begin or inside.
O, B, I = 0, 1, 2
NEVER = -1e9

#: The patterns of base spans; a span is a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[\w+/=-]+|[^\w\s+/=-]+")
#: All of a text in pieces: tokens, with the single space before them, and white space.
_PIECE = re.compile(r" ?[\w+/=-]+| ?[^\w\s+/=-]+|\s+")
_DIGITS = re.compile(r"[0-9]")
_KINDS = {ord(c): k for k, some in (("0", "0123456789"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in some}
#: Pieces that are scored at once, and distinct pieces that are remembered.
BLOCK, REMEMBERED = 1 << 16, 100_000
#: Tokens before and behind a token that its features name.
BEHIND, AHEAD = 5, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order.

    A run of hexadecimal or capital characters that is long enough is one match from
    its start, so the least length is part of these two patterns; an assignment that
    is too short still takes up its characters.
    """
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    small = text.lower()
    if any(n in small for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


def secret_parts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the secrets themselves stand in base spans: an assignment's is its value."""
    parts = []
    for start, kind, end in spans:
        if kind == 0:
            start = ASSIGN.match(text, start).start(2)
        parts.append((start, end))
    return parts


def open_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a text, in order: all are open to every tag."""
    return [m.span() for m in _TOKEN.finditer(text)]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[int]:
    """Where, among ``tokens``, chains begin: a text is one chain."""
    return [0] if tokens else []


def _step(n: float, *edges: float) -> int:
    return bisect_right(edges, n)


def file_features(text: str) -> list[str]:
    """What the whole text says of each of its tokens."""
    n = max(len(text), 1)
    return [
        f"size{_step(n, 50, 300, 2000, 20000)}",
        f"lines{_step(text.count(chr(10)) / n * 1000, 1, 5, 20, 50)}",
        f"equals{_step(text.count('=') / n * 1000, 0.01, 1, 5, 20)}",
        f"braces{_step((text.count('{') + text.count(';')) / n * 1000, 0.01, 2, 10)}",
    ]


def shape_of(token: str) -> tuple[str, int, bool, int, str]:
    """What the shape features of a token are made from: characters by kind, length,
    whether all are hexadecimal, how many differ, and a head of capitals."""
    size, token = len(token), token[:256]
    return token.translate(_KINDS), size, not token.strip("0123456789abcdef"), _step(len({*token}), 3, 6, 9, 12, 16, 24), token[:4] if token[:4].isupper() else ""


def group_of(kinds: str, size: int) -> int:
    """Words, long ones, and tokens with a digit have weights of their own."""
    return 2 if "0" in kinds else int(size >= LONG_CHARS)


@lru_cache(1 << 14)
def shape_features(kinds: str, size: int, hexa: bool, several: int, head: str) -> list[int]:
    """Feature ids of a shape, always of the same number."""
    group = group_of(kinds, size)
    long = _step(size, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 32, 40, 41, 64)
    n = max(len(kinds), 1)
    digit = kinds.count("0")
    turns = sum(x != y for x, y in zip(kinds, kinds[1:])) / n
    cast = f"{'a' in kinds:d}{'A' in kinds:d}{digit > 0:d}{hexa:d}"
    features = [
        "any", f"cast{cast}", f"long{long}", f"both{cast}.{long}", f"turns{_step(turns, 0.1, 0.25, 0.4, 0.55)}", f"digits{_step(digit / n, 0.01, 0.2, 0.4, 0.7, 1)}.{cast}",
        f"start{kinds[:4]}", f"head{head}", f"odd{_step(len({*kinds} - {*'aA0'}), 1, 2)}", f"kinds{several}",
        *[f"least{k}.{size >= k:d}" for k in (6, 8, 10, 16)],
    ]
    return _ids([f"{group}{f}" for f in features])


def name_of(token: str) -> str:
    """What a token is called by its neighbours: numbers and codes by their size."""
    token = token[-12:].lower()
    return token if token.isalpha() or not _DIGITS.search(token) else f"0{len(token)}"


def _ids(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in features]


def _white(gap: str) -> int:
    """Kind of the white space between tokens: none, one space, other, line ends."""
    return 0 if not gap else 1 if gap == " " else 3 if "\n" in gap or "\r" in gap else 2


#: Feature ids of white space before and behind a token, by its kind and the group.
GAPS = np.array([[_ids([f"{i}{side}{g}" for i in range(GROUPS)]) for g in range(4)] for side in ("before", "behind")], np.int32)
SHAPES = len(shape_features(*shape_of("a")))
#: A piece's columns beside its shape: at distances 1 to 3 before a token, anywhere
#: before it, at distances 1 and 2 behind it.
NEIGHBOURS = ("p1", "p2", "p3", "near", "n1", "n2")
_SALTS = np.array([int.from_bytes(hashlib.blake2b(f"{i}{n}".encode(), digest_size=8).digest()) for n in NEIGHBOURS for i in range(GROUPS)], np.uint64)


def neighbour_ids(names: np.ndarray) -> np.ndarray:
    """Feature ids that hashed names give to neighbours, by distance and their group."""
    return ((names.astype(np.uint64)[:, None] ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def piece_key(piece: str) -> tuple[tuple, int]:
    """What all features of a piece come from: its token's shape, and its name, hashed."""
    token = piece[1:] if piece[:1] == " " else piece
    return shape_of(token), zlib.crc32((name_of(token) if token else "edge").encode("utf-8", "surrogatepass"))


def piece_features(piece: str) -> list[int]:
    """Of a piece's token: its group, feature ids of its shape, and its hashed name."""
    shape, name = piece_key(piece)
    return [group_of(*shape[:2]), *shape_features(*shape), name]


def file_ids(text: str) -> np.ndarray:
    """Feature ids of the whole text, for each group."""
    return np.array([_ids([f"{i}{f}" for f in file_features(text)]) for i in range(GROUPS)])


def feature_ids(text: str, tokens: list[tuple[int, int]], known: dict[str, list[int]] | None = None) -> np.ndarray:
    """A row of hashed features for each token; ``known`` remembers those of words."""
    n = len(tokens)
    words = [text[a:e] for a, e in tokens]
    at = {w: i for i, w in enumerate(dict.fromkeys(["", *words]))}
    known = {} if known is None else known
    if len(known) > REMEMBERED // 4:
        known.clear()
    for w in at:
        if len(w) <= 64 and w not in known:
            known[w] = piece_features(w)
    table = np.array([known[w] if len(w) <= 64 else piece_features(w) for w in at], np.int64)
    table = np.concatenate([table[:, :-1], neighbour_ids(table[:, -1])], axis=1)
    rows = np.zeros(BEHIND + n + AHEAD, np.int64)
    rows[BEHIND : BEHIND + n] = [at[w] for w in words]
    own = table[rows[BEHIND : BEHIND + n], : 1 + SHAPES]
    group = own[:, 0]
    gaps = np.array([3, *[_white(text[e:a]) for (_, e), (a, _) in zip(tokens, tokens[1:])], 3])
    near = lambda d, name: table[rows[BEHIND + d : BEHIND + d + n], 1 + SHAPES + GROUPS * NEIGHBOURS.index(name) + group]
    out = [*own[:, 1:].T]
    out += [near(-1, "p1"), near(-2, "p2"), near(-3, "p3"), near(1, "n1"), near(2, "n2"), *[near(-d, "near") for d in range(1, BEHIND + 1)]]
    out += [GAPS[0][gaps[:n], group], GAPS[1][gaps[1 : n + 1], group], *file_ids(text)[group].T]
    return np.stack(out, axis=1).astype(np.int32)


class Pieces(dict):
    """Rows of distinct pieces in tables that grow with them: length, kind, group, the
    score of their shape, and what they add to scores of tokens of each group behind
    them at distances 1 to 5 and before them at 1 and 2.  Row 0 is outside the text."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.gaps = weights, weights[GAPS]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.size, self.kind = np.zeros(1024, np.int64), np.zeros(1024, np.int8)
        self.shapes: dict[tuple, tuple] = {}
        self.group, self.shape = np.zeros(1024, np.int8), np.zeros((1024, 3))
        self.sums = np.zeros((BEHIND + AHEAD, 1024, GROUPS, 3))
        self.fresh: list[str] = []
        self.characters = 0
        self.rows([""])

    def full(self) -> bool:
        return len(self) > REMEMBERED or self.characters > 64 * REMEMBERED

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = row = len(self)
        return row

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The rows of pieces; those of earlier calls hold until ``forget``."""
        out = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.fresh:
            first, n = len(self) - len(self.fresh), len(self)
            if n > len(self.size):
                more = max(n, 2 * len(self.size)) - len(self.size)
                self.size, self.kind = np.pad(self.size, (0, more)), np.pad(self.kind, (0, more))
                self.group, self.shape = np.pad(self.group, (0, more)), np.pad(self.shape, ((0, more), (0, 0)))
                self.sums = np.pad(self.sums, ((0, 0), (0, more), (0, 0), (0, 0)))
            self.size[first:n] = [len(p) for p in self.fresh]
            self.characters += int(self.size[first:n].sum())
            self.kind[first:n] = [2 + (_white(p) == 3) if p.isspace() else p[:1] == " " for p in self.fresh]
            for at in range(0, n - first, 4096):  # weights of a bounded number of pieces
                keys = [piece_key(p) for p in self.fresh[at : at + 4096]]
                some = slice(first + at, first + at + len(keys))
                for k in {k for k, _ in keys if k not in self.shapes}:
                    self.shapes[k] = (group_of(*k[:2]), *self.weights[shape_features(*k)].sum(axis=0).tolist())
                own = np.array([self.shapes[k] for k, _ in keys])
                self.group[some], self.shape[some] = own[:, 0], own[:, 1:]
                ids = neighbour_ids(np.array([n for _, n in keys]))
                p1, p2, p3, near, n1, n2 = self.weights.take(ids, axis=0).reshape(len(ids), len(NEIGHBOURS), GROUPS, 3).transpose(1, 0, 2, 3)
                for role, x in enumerate((p1 + near, p2 + near, p3 + near, near, near, n1, n2)):
                    self.sums[role, some] = x
            self.fresh = []
        return out

    def scores(self, tokens: np.ndarray, gaps: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Scores of tags by rows of tokens, kinds of the white space around them, and
        scores of the whole text for each group."""
        n = len(tokens)
        rows = np.zeros(BEHIND + n + AHEAD, np.int64)
        rows[BEHIND : BEHIND + n] = tokens
        rows *= GROUPS
        group = self.group[tokens]
        out = self.shape.take(tokens, axis=0)
        for role, d in enumerate((*range(-1, -BEHIND - 1, -1), *range(1, AHEAD + 1))):
            out += self.sums[role].reshape(-1, 3).take(rows[BEHIND + d : BEHIND + d + n] + group, axis=0)
        around = (self.gaps[0][:, None] + self.gaps[1] + whole).reshape(-1, 3)  # by both kinds and the group
        out += around.take((gaps[:n] * 4 + gaps[1:]) * GROUPS + group, axis=0)
        return out


def tags_of(tokens: list[tuple[int, int]], starts: list[int], parts: list[tuple[int, int]]) -> np.ndarray:
    """Tags of tokens by the secrets that they overlap."""
    tags, first = np.zeros(len(tokens), np.int8), set(starts)
    at, last = 0, -1
    for i, (a, e) in enumerate(tokens):
        while at < len(parts) and parts[at][1] <= a:
            at += 1
        if at < len(parts) and parts[at][0] < e:
            tags[i] = I if last == at and i not in first else B
            last = at
        else:
            last = -1
    return tags


class Crf:
    """Weights of features by tag and of steps from tag to tag."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps
        self.pieces: Pieces | None = None

    @staticmethod
    def allowed(steps: np.ndarray) -> np.ndarray:
        """``steps`` without those that no path takes; row 3 is the start."""
        out = steps.copy()
        out[O, I] = out[3, I] = NEVER
        return out

    def viterbi(self, emitted: np.ndarray, first: int = 3, last: int | None = None) -> list[int]:
        """The best path of one chain; ties go to the lower tag.  ``first`` is the tag
        before it (3: none), ``last`` the one behind it."""
        steps = self.allowed(self.steps).tolist()
        best = [e + s for e, s in zip(emitted[0].tolist(), steps[first])]
        back = bytearray()
        for row in emitted[1:]:
            new = []
            for tag, e in enumerate(row.tolist()):
                s = [best[p] + steps[p][tag] for p in (O, B, I)]
                p = s.index(max(s))
                back.append(p)
                new.append(s[p] + e)
            best = new
        if last is not None:
            best = [b + s[last] for b, s in zip(best, steps)]
        path = bytearray([best.index(max(best))])
        for at in range(len(back) - 3, -1, -3):
            path.append(back[at + path[-1]])
        return list(path[::-1])

    def surely_outside(self, emitted: np.ndarray) -> np.ndarray:
        """Where no best path has another tag than outside.

        A path with tag x there can take outside instead, and begin where it went on
        inside.  It wins the lead in scores, and loses at most what the worst steps
        before and behind and the next token's scores make of it.
        """
        s = self.allowed(self.steps)
        never = s <= NEVER / 2
        if never[O, B] and never[3, B]:
            return np.ones(len(emitted), bool)
        onward = np.full(len(emitted), np.inf)  # of the next token, to begin and not to be inside
        onward[:-1] = emitted[1:, B] - emitted[1:, I]
        onward += s[O, B] + min(0.0, (s[B] - s[I]).min())
        least = np.full(len(emitted), np.inf)
        for x in (B, I):
            before = (s[:, O] - s[:, x])[~never[:, x]].min()
            behind = min(0.0, (s[O, :I] - s[x, :I]).min())
            np.minimum(least, emitted[:, O] - emitted[:, x] + before + np.minimum(behind, onward - s[x, I]), out=least)
        return least > 1e-6

    def path(self, emitted: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """The best path of a chain, run between tokens that are surely outside, as
        ``emitted`` has the rows of the others alone."""
        out = np.zeros(len(sure), np.int8)
        where = np.flatnonzero(~sure)
        cuts = np.flatnonzero(np.diff(where) > 1) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]) if len(where) else ():
            first, last = int(where[a]), int(where[e - 1])
            out[first : last + 1] = self.viterbi(emitted[a:e], O if first else 3, O if last + 1 < len(sure) else None)
        return out

    def tags(self, ids: np.ndarray, starts: list[int]) -> list[int]:
        """Tags of tokens by their feature rows, chain by chain."""
        out: list[int] = []
        for s, e in zip(starts, [*starts[1:], len(ids)]):
            for at in range(s, e, BLOCK):  # emissions of a bounded number of tokens
                some = self.weights[ids[at : min(e, at + BLOCK)]].sum(axis=1)
                emitted = some if at == s else np.concatenate([emitted, some])
            sure = self.surely_outside(emitted)
            out += self.path(emitted[~sure], sure).tolist()
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of what the best path of a whole text tags as secret."""
        if self.pieces is None:
            self.pieces = Pieces(self.weights)
        whole = self.weights[file_ids(text)].sum(axis=1)
        done, start, parts = 0, 0, []
        for head, block, tail in _blocks(text):
            if self.pieces.full():
                self.pieces.forget()
            rows = self.pieces.rows([*head, *block, *tail] if head or tail else block)
            kind = self.pieces.kind[rows]
            token = kind < 2
            gaps = np.empty(int(token.sum()) + 1, np.int8)
            gaps[:-1] = np.maximum(kind, np.concatenate([[0], np.where(token, 0, kind)[:-1]]))[token]
            gaps[0] = gaps[-1] = 3
            rows_ = rows[token]
            emitted = self.pieces.scores(rows_, gaps, whole)
            sure = self.surely_outside(emitted)
            a, e = int(token[: len(head)].sum()), int(token[: len(head) + len(block)].sum())
            mine, emitted = sure[a:e], emitted[a:e]
            inner = slice(len(head), len(head) + len(block))
            size = self.pieces.size[rows[inner]]
            ends = start + np.cumsum(size)
            start = int(ends[-1])
            open_ = np.flatnonzero(~mine)
            ends, size = ends[token[inner]][open_], size[token[inner]][open_] - kind[inner][token[inner]][open_]
            parts.append((mine, emitted[open_], ends - size, ends))
        if not parts:
            return []
        sure, emitted, begin, end = (np.concatenate(p) for p in zip(*parts))
        out: list[list[int]] = []
        tags = self.path(emitted, sure)[~sure]
        for at in np.flatnonzero(tags).tolist():
            if tags[at] == B:
                out.append([int(begin[at]), int(end[at])])
            else:
                out[-1][1] = int(end[at])
        return [(a, e) for a, e in out]


def _blocks(text: str) -> Iterator[tuple[list[str], list[str], list[str]]]:
    """Pieces of a text in blocks, with those before and behind that features name.

    White space never follows white space, so a number of pieces holds half as many
    tokens; one more behind is what ``surely_outside`` asks for.
    """
    if len(text) <= BLOCK:
        pieces = _PIECE.findall(text)
        if pieces:
            yield [], pieces, []
        return
    found = (m[0] for m in _PIECE.finditer(text))
    head: list[str] = []
    block = list(islice(found, BLOCK))
    while block:
        after = list(islice(found, BLOCK))
        yield head, block, after[: 2 * AHEAD + 4]
        head, block = block[-2 * BEHIND - 2 :], after


def log_likelihood(weights: np.ndarray, steps: np.ndarray, ids: np.ndarray, tags: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of segments (n, longest, features), and its gradients, by forward and backward
    sums, scaled at each token; ``there`` marks the tokens that exist, each segment
    having a first."""
    n, longest = tags.shape
    allowed = Crf.allowed(steps)
    e = np.zeros((n, longest, 3))
    for j in range(ids.shape[2]):
        e += weights.take(ids[:, :, j], axis=0)
    top = e.max(axis=2)
    p, step = np.exp(e - top[:, :, None]), np.exp(allowed)
    ahead, scale = np.empty((longest, n, 3)), np.ones((longest, n))
    for t in range(longest):
        new = (ahead[t - 1] @ step[:3] if t else step[3]) * p[:, t]
        scale[t] = np.where(there[:, t], new.sum(axis=1), 1.0)
        ahead[t] = np.where(there[:, t, None], new / scale[t][:, None], ahead[t - 1])
    back = np.ones((longest, n, 3))
    pairs = np.zeros((4, 3))
    for t in range(longest - 2, -1, -1):
        onward = p[:, t + 1] * back[t + 1] / scale[t + 1][:, None]
        pairs[:3] += step[:3] * ((ahead[t] * there[:, t + 1, None]).T @ onward)
        back[t] = np.where(there[:, t + 1, None], onward @ step[:3].T, 1.0)
    marginal = (ahead * back).transpose(1, 0, 2) * there[:, :, None]
    pairs[3] = marginal[:, 0].sum(axis=0)
    gold = np.eye(3)[tags] * there[:, :, None]
    seen = np.zeros((4, 3))
    np.add.at(seen, (tags[:, :-1][there[:, 1:]], tags[:, 1:][there[:, 1:]]), 1)
    seen[3] = gold[:, 0].sum(axis=0)
    value = float((gold * e).sum() + (seen * allowed).sum() - np.log(scale).sum() - top[there].sum())
    rest = np.ascontiguousarray(((gold - marginal) * there[:, :, None]).reshape(-1, 3).T)
    grad = np.zeros_like(weights)
    for j in range(ids.shape[2]):
        at = ids[:, :, j].ravel()
        for tag in (O, B, I):
            grad[:, tag] += np.bincount(at, rest[tag], len(weights))
    return value, grad, seen - pairs


def train(segments_: list[tuple[np.ndarray, np.ndarray]]) -> Crf:
    """A model of segments (feature rows, tags), by Adam on the mean log-likelihood."""
    weights, steps = np.zeros((FEATURES, 3)), np.zeros((4, 3))
    if not any(tags.any() for _, tags in segments_):
        steps[3, B] = steps[O, B] = NEVER
        return Crf(weights, steps)
    longest = max(len(t) for _, t in segments_)
    n, k = len(segments_), segments_[0][0].shape[1]
    ids, tags, there = np.zeros((n, longest, k), np.int32), np.zeros((n, longest), np.int8), np.zeros((n, longest), bool)
    for i, (f, t) in enumerate(segments_):
        ids[i, : len(t)], tags[i, : len(t)], there[i, : len(t)] = f, t, True
    used, flat = np.unique(ids, return_inverse=True)
    ids = np.ascontiguousarray(flat.reshape(ids.shape).transpose(2, 0, 1)).transpose(1, 2, 0)  # each column by itself
    some = np.zeros((len(used), 3))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (some, steps)]
    for step in range(1, STEPS + 1):
        _, *grads = log_likelihood(some, steps, ids, tags, there)
        for x, g, (m, v) in zip((some, steps), grads, moments):
            g = g / n - DECAY * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = some
    return Crf(weights, steps)


#: Tokens of a training segment; a chain is learned in pieces.
PIECE = 32


def _pieces(most: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as rows (secret, key, ids, tags) of their segments whose key, a hash of
    their words, is at most ``most`` of other or of secret ones; if that is empty, all
    without their features."""
    known: dict[str, list[int]] = {}
    for b in batches:
        for text in b.column(0).to_pylist():
            text = text or ""
            tokens = open_tokens(text)
            if not tokens:
                continue
            tags = tags_of(tokens, segments(text, tokens), secret_parts(text, base_spans(text)))
            ids, rows = None, []
            for at in range(0, len(tokens), PIECE):
                t = tags[at : at + PIECE].copy()
                t[0] = B if t[0] == I else t[0]
                words = text[tokens[at][0] : tokens[at + len(t) - 1][1]]
                key = int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=6).digest()) / 2.0**48
                secret = bool(t.any())
                if not most:
                    rows.append((secret, None, None, None))
                elif key <= most[secret]:
                    ids = feature_ids(text, tokens, known) if ids is None else ids
                    rows.append((secret, key, ids[at : at + len(t)].tobytes(), t.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.bool_(), pa.float64(), pa.binary(), pa.binary()))], names=["secret", "key", "ids", "tags"])


def fit(docs: DataFrame, text_col: str = "text") -> Crf:
    """A model of what base spans mark in a sample of ``docs``.

    A document is drawn by a hash of its row, with a chance that makes
    ``SAMPLE_DOCS`` of them on average; segments are drawn by a hash of their words, with
    chances that make the two bounds on average, and at most these are learned.
    """
    n = docs.count()
    text = F.col(text_col).cast("string")
    place = F.pmod(F.xxhash64(text, *[F.col(f"`{c}`") for c, t in docs.dtypes if c != text_col and t in ("bigint", "int", "string")]), F.lit(1 << 48)) / float(1 << 48)
    drawn = small_batches(docs.filter(place < SAMPLE_DOCS / max(n, 1)).select(text.alias("text")))
    found = lambda most: drawn.mapInArrow(tidied(partial(_pieces, most)), "secret boolean, key double, ids binary, tags binary")
    counts = dict(found([]).groupBy("secret").count().collect())
    bounds = (OTHER_SEGMENTS, SECRET_SEGMENTS)
    chosen = found([most / max(counts.get(bool(i), 0), 1) for i, most in enumerate(bounds)]).collect()
    chosen.sort(key=lambda r: (r["key"], r["ids"], r["tags"]))
    rows = [r for i, most in enumerate(bounds) for r in [r for r in chosen if r["secret"] == bool(i)][:most]]
    return train([(np.frombuffer(r["ids"], np.int32).reshape(len(r["tags"]), -1), np.frombuffer(r["tags"], np.int8)) for r in rows])


def scan(text: str, model: Crf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and those that the model adds, as (start, kind, end)."""
    base = base_spans(text)
    own = model.spans(text)
    taken = _disjoint(base)
    ends = [e for _, e in taken]
    added = []
    for a, e in own:
        at = bisect_right(ends, a)  # the first that ends behind a
        if at == len(taken) or taken[at][0] >= e:
            added.append((a, 3, e))
    return base, added


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans, which are in order, cover together."""
    out: list[tuple[int, int]] = []
    for a, _, e in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_crf, base, spans): all spans of each document as
    lists of kind:start:end, in code points, and the base spans alone."""
    used = np.flatnonzero(model.weights.any(axis=1))  # what the sample has no feature of is 0
    rows, steps = model.weights[used], model.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((FEATURES, 3))
        weights[used] = rows
        own = Crf(weights, steps)
        for b in batches:
            if not b.num_rows:
                continue
            counts, texts = [], []
            for text in b.column(1).to_pylist():
                base, added = scan(text or "", own)
                n = [0] * len(KINDS)
                for _, k, _ in base + added:
                    n[k] += 1
                counts.append(n)
                texts.append((_shown(base), _shown(sorted(base + added))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*counts)], *[pa.array(c, pa.string()) for c in zip(*texts)]], names=[id_col, *[f"n_{k}" for k in KINDS], "base", "spans"])

    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    rows_ = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text__"))
    return small_batches(rows_).mapInArrow(tidied(run), kinds)
