"""Scoring with a gated recurrent language model over words.

The vocabulary follows the corpus: it has every word that all documents
together hold often enough. Each other word is one of 16 tokens, by its
length, and then its spelling, byte by byte, so that no part of a text goes
unscored. The softmax is factored: first the class of the next word, then the
word in its class, with classes of like frequency; spellings have a trigram
model of bytes, counted over all documents.

Training is truncated backpropagation in numpy: texts follow one another in
many lanes, a window of `WINDOW` words is unrolled, and the state goes on from
window to window. A first model is fitted on a bounded sample; from it every
partition trains a copy of the model on all its documents, and the copies are
averaged, weighted by their words, up a tree of 64 branches.

Scoring carries a document's state over all its windows, so that its
likelihood is that of the complete text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import _LOWER, _WORD, U64, Words, chunks, lean, ranges
from quillon.llm.bpe import Table
from quillon.session import Scratch, ship

SHAPES = 16
BEGIN, END = 0, 1
FIXED = 2 + SHAPES
HIDDEN, WINDOW, LANES, SLICES, BRANCHES = 24, 16, 512, 8, 64
NAMES = ("x", "u", "wc", "bc", "ww", "bw")
#: The bytes of folded words, and the mark of a word's bounds.
LETTERS = np.unique(_LOWER[np.flatnonzero(_WORD)])
SIGNS, BOUND = len(LETTERS) + 1, len(LETTERS)
_SIGN = np.searchsorted(LETTERS, _LOWER).astype(np.int64)
BACKOFF = 4.0
#: Exponentials of numbers below this are summed as they are.
LARGE = 40.0


@dataclass
class Spelling:
    """Counts of trigrams of bytes, which give each next byte of a word after the two before it; none: all bytes are alike.

    A word's length is known before it is spelled, up to SHAPES bytes; from there on a mark of its end may follow.
    """

    keys: np.ndarray
    counts: np.ndarray

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "counts": self.counts}

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each trigram's last sign, of no end after each two signs)."""
        if "_logs" not in self.__dict__:
            three = np.zeros(SIGNS**3, dtype=np.float32)
            three[self.keys] = self.counts
            three = three.reshape(SIGNS, SIGNS, SIGNS)
            two = three.sum(axis=0, dtype=np.float64)
            one = two.sum(axis=0)
            one = (one + BACKOFF / SIGNS) / (one.sum() + BACKOFF)
            two = ((two + BACKOFF * one) / (two.sum(axis=1, keepdims=True) + BACKOFF)).astype(np.float32)
            total = three.sum(axis=2, dtype=np.float64)[:, :, None] + BACKOFF
            three += np.float32(BACKOFF) * two
            three /= total.astype(np.float32)
            free = np.log1p(-three[:, :, BOUND].astype(np.float64)).ravel()
            self._logs = np.log(three, out=three).ravel(), free
        return self._logs

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of the spelling of each word, given its length's token."""
        if not len(starts):
            return np.zeros(0)
        logs, free = self.logs()
        keys, place, word = trigrams(raw, starts, ends)
        out = logs[keys].astype(np.float64)
        fixed = place < SHAPES
        out[fixed] -= free[keys[fixed] // SIGNS]
        return np.bincount(word, out, minlength=len(starts))


def trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, place in its word, word) of each byte of some words, and of the ends of words of SHAPES bytes or more."""
    size = ends - starts
    long = size >= SHAPES
    each = size + long
    word = np.repeat(np.arange(len(size)), each)
    place = ranges(np.zeros(len(size), dtype=np.int64), each)
    sign = _SIGN[raw[np.minimum(starts[word] + place, len(raw) - 1)]]
    sign[np.cumsum(each)[long] - 1] = BOUND
    before = np.full((2, len(sign)), BOUND)
    before[0, 1:], before[1, 2:] = sign[:-1], sign[:-2]
    before[0, place < 1] = before[1, place < 2] = BOUND
    return (before[1] * SIGNS + before[0]) * SIGNS + sign, place, word


@dataclass
class Vocabulary:
    """Token 0 begins a text, 1 ends it, 2 to 17 are other words by length, then come the words by falling frequency."""

    hashes: np.ndarray
    counts: np.ndarray
    spelling: Spelling = field(default_factory=lambda: Spelling(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    table: Table = field(init=False)
    class_of: np.ndarray = field(init=False)
    class_at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = Table((self.hashes >> U64(1)).astype(np.int64), np.arange(len(self.hashes)) + FIXED)
        mass = np.cumsum(np.sqrt(self.counts.astype(np.float64)))
        many = max(1, int(np.sqrt(len(self.counts))))
        band = np.minimum((mass / mass[-1] * many - 1e-9).astype(np.int64), many - 1) if len(mass) else mass.astype(np.int64)
        _, band = np.unique(band, return_inverse=True) if len(band) else (None, band)
        # tokens are numbered by class, so a class is a range of tokens; fixed tokens are classes of their own
        self.class_of = np.concatenate((np.arange(FIXED), FIXED + band)).astype(np.int64)
        self.class_at = np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 2))

    def __len__(self) -> int:
        return len(self.class_of)

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets): each text's words after BEGIN."""
        return self.read(column, False)[:2]

    def spelled(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood of how each text's words outside the vocabulary are spelled."""
        return self.read(column)[2]

    def read(self, column: pa.Array, spell: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, offsets, log-likelihood of the spelling of words outside the vocabulary, if asked for) of each text."""
        tokens, sizes, spelled = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], np.zeros(len(column))
        for i, k in chunks(column):
            w = Words(column.slice(i, k))
            got = self._known(w)
            if spell:
                other = np.flatnonzero(got < 0)
                spelled[i : i + k] = np.bincount(np.searchsorted(w.bounds, other, side="right") - 1, self.spelling.words(w.raw, w.starts[other], w.ends[other]), minlength=k)
            got = np.where(got >= 0, got, 2 + np.minimum(w.ends - w.starts, SHAPES) - 1)
            offsets = w.bounds + np.arange(k + 1)
            out = np.full(len(got) + k, BEGIN, dtype=np.int32)
            place = np.ones(len(out), dtype=bool)
            place[offsets[:-1]] = False
            out[place] = got
            tokens.append(out)
            sizes.append(np.diff(offsets))
        return np.concatenate(tokens), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64), spelled

    def others(self, w: Words) -> np.ndarray:
        """Which words are outside the vocabulary."""
        return np.flatnonzero(self._known(w) < 0)

    def _known(self, w: Words) -> np.ndarray:
        """The words' tokens, less than 0 outside the vocabulary."""
        return self.table.get((w.hash >> U64(1)).astype(np.int64))


def fresh(vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    v, c = len(vocabulary), len(vocabulary.class_at) - 1
    make = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    zero = lambda n: np.zeros(n, dtype=np.float32)
    return {"x": make(v, 3 * hidden), "u": make(hidden, 3 * hidden), "wc": make(hidden, c), "bc": zero(c), "ww": make(v, hidden), "bw": zero(v)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = x * x.dtype.type(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= x.dtype.type(0.5)
    return x


def step(p: dict, h: np.ndarray, tokens: np.ndarray, g: np.ndarray | None = None) -> tuple:
    """The next state, and what the way back needs; g: the tokens' rows of x, if they are there."""
    k = h.shape[1]
    g, hu = p["x"].take(tokens, axis=0) if g is None else g, h @ p["u"]
    zr = _sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
    z, r, hun = zr[:, :k], zr[:, k:], hu[:, 2 * k :]
    n = r * hun
    n += g[:, 2 * k :]
    np.tanh(n, out=n)
    after = h - n
    after *= z
    after += n
    return after, z, r, n, hun


def _exps(logits: np.ndarray, at: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the exponentials, log-likelihood of column `at` of each row); logits become their exponentials, less each row's maximum where one is large."""
    if not (logits.max() < LARGE and logits.min() > -LARGE):
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ ones[: logits.shape[1]]
    return total, own - np.log(total)


def likelihood(p: dict, vocabulary: Vocabulary, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log-likelihood of each target after its state, gradient of the states); adds to grads."""
    c = vocabulary.class_of[target]
    ones = np.ones(max(len(h), len(vocabulary)), dtype=h.dtype)
    e = h @ p["wc"]
    e += p["bc"]
    total, out = _exps(e, c, ones)
    dh = None
    if grads is not None:
        e *= (-1 / total)[:, None]
        e[np.arange(len(h)), c] += 1
        grads["wc"] += h.T @ e
        grads["bc"] += ones[: len(h)] @ e
        dh = e @ p["wc"].T
    order = np.argsort(c.astype(np.int16), kind="stable")
    cut = np.searchsorted(c[order], np.arange(len(vocabulary.class_at))).tolist()
    by, to = h.take(order, axis=0), target[order]
    part, back = np.zeros(len(h), dtype=out.dtype), np.zeros_like(h)
    for k, (lo, hi) in enumerate(zip(vocabulary.class_at[:-1].tolist(), vocabulary.class_at[1:].tolist())):
        x, y = cut[k], cut[k + 1]
        if k < FIXED or x == y or hi - lo == 1:
            continue
        own, at = by[x:y], to[x:y] - lo
        e = own @ p["ww"][lo:hi].T
        e += p["bw"][lo:hi]
        total, part[x:y] = _exps(e, at, ones)
        if grads is not None:
            e *= (-1 / total)[:, None]
            e[np.arange(y - x), at] += 1
            grads["ww"][lo:hi] += e.T @ own
            grads["bw"][lo:hi] += ones[: y - x] @ e
            np.matmul(e, p["ww"][lo:hi], out=back[x:y])
    out[order] += part
    if grads is not None:
        dh[order] += back
    return out, dh


def window_gradient(p: dict, vocabulary: Vocabulary, h: np.ndarray, tokens: np.ndarray, target: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """(log-likelihood, its gradient, last state) of a window: tokens and targets are [step, lane]."""
    total, grads, rows, h = _window_gradient(p, vocabulary, h, tokens, target)
    part, grads["x"] = grads["x"], np.zeros_like(p["x"])
    grads["x"][rows] = part
    return total, grads, h


def _window_gradient(p: dict, vocabulary: Vocabulary, h: np.ndarray, tokens: np.ndarray, target: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """The same with the gradient of x for the window's own tokens alone, the rows that come behind it: all others are 0."""
    grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
    k, steps, lanes = h.shape[1], len(tokens), len(h)
    goes_on = (tokens != BEGIN)[:, :, None].astype(h.dtype)
    g = p["x"].take(tokens, axis=0)
    before, z, r, n, hun, states = (np.empty((steps, lanes, k), dtype=h.dtype) for _ in range(6))
    for t in range(steps):
        np.multiply(h, goes_on[t], out=before[t])
        h, z[t], r[t], n[t], hun[t] = step(p, before[t], tokens[t], g[t])
        states[t] = h
    out, dout = likelihood(p, vocabulary, states.reshape(-1, k), target.ravel(), grads)
    dout = dout.reshape(steps, lanes, k)
    # the factors of all steps at once; what is left to the loop is the way of dh
    to_n = (1 - z) * (1 - n * n)
    before_n = before - n
    before_n *= z * (1 - z)
    hun *= r * (1 - r)
    du, dn = np.empty((steps, lanes, 3 * k), dtype=h.dtype), np.empty((steps, lanes, k), dtype=h.dtype)
    dh = np.zeros_like(h)
    back = np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        dh += dout[t]
        np.multiply(dh, to_n[t], out=dn[t])
        np.multiply(dh, before_n[t], out=du[t, :, :k])
        np.multiply(dn[t], hun[t], out=du[t, :, k : 2 * k])
        np.multiply(dn[t], r[t], out=du[t, :, 2 * k :])
        dh *= z[t]
        dh += du[t] @ back
        dh *= goes_on[t]
    grads["u"] += before.reshape(-1, k).T @ du.reshape(-1, 3 * k)
    du[:, :, 2 * k :] = dn  # from here on the gradient of x
    flat = tokens.ravel()
    order = np.argsort(flat.astype(np.int16) if len(vocabulary) < 1 << 15 else flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    grads["x"] = np.add.reduceat(du.reshape(-1, 3 * k).take(order, axis=0), first, axis=0)
    return float(out.sum()), grads, flat[first], h


class Trainer:
    """Gradient steps scaled by the history of each parameter."""

    def __init__(self, vocabulary: Vocabulary, p: dict, rate: float = 0.1) -> None:
        self.vocabulary, self.rate, self.words = vocabulary, rate, 0
        self.p = {k: v.copy() for k, v in p.items()}
        self.past = {k: np.full_like(v, 1e-3) for k, v in p.items()}

    def fit(self, tokens: np.ndarray) -> None:
        """One pass over texts that follow one another, each led by BEGIN."""
        if not len(tokens):
            return
        lanes = int(np.clip(len(tokens) // (4 * WINDOW), 1, LANES))
        length = -(-len(tokens) // lanes)
        grid = np.full(lanes * length + 1, BEGIN, dtype=np.int32)
        grid[: len(tokens)] = tokens
        now, nxt = grid[:-1].reshape(lanes, length).T, grid[1:].reshape(lanes, length).T
        nxt = np.where(nxt == BEGIN, END, nxt)  # what follows a text's last word is its end
        h = np.zeros((lanes, self.p["u"].shape[0]), dtype=np.float32)
        for t in range(0, length, WINDOW):
            _, grads, rows, h = _window_gradient(self.p, self.vocabulary, h, now[t : t + WINDOW], nxt[t : t + WINDOW])
            size = min(WINDOW, length - t) * lanes
            for k, g in grads.items():
                at = rows if k == "x" else ...
                g *= np.float32(1 / np.sqrt(size))
                self.past[k][at] += g * g
                self.p[k][at] += np.float32(self.rate) * g / np.sqrt(self.past[k][at])
        self.words += len(tokens)


def score_tokens(p: dict, vocabulary: Vocabulary, tokens: np.ndarray, offsets: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Log-likelihood of each complete text, its end included; texts run in step, longest first, `most` words to a window."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    size, at = size[order], offsets[:-1][order]
    out, less = np.zeros(len(size)), -size
    h = np.zeros((len(size), p["u"].shape[0]), dtype=np.float32)
    t, now = 0, tokens[at] if len(tokens) else tokens
    while len(size) and t < size[0]:
        states, target, who = [], [], []
        window = max(1, most // int(np.searchsorted(less, -t, side="left")))
        for s in range(t, min(t + window, int(size[0]))):
            live = int(np.searchsorted(less, -s, side="left"))
            h = step(p, h[:live], now[:live])[0]
            states.append(h)
            on = int(np.searchsorted(less, -s - 1, side="left"))
            now = np.full(live, END, dtype=tokens.dtype)
            now[:on] = tokens[at[:on] + s + 1]
            target.append(now)
            who.append(np.arange(live))
        ll, _ = likelihood(p, vocabulary, np.concatenate(states), np.concatenate(target))
        out += np.bincount(np.concatenate(who), ll, minlength=len(out))
        t += window
    back = np.empty(len(out))
    back[order] = out
    return back


def _count(batches):
    """(hash, count) of a partition's words."""
    held, n = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    parts, waiting = [], 0

    def merged():
        h, c = (np.concatenate(x) for x in zip((held, n), *parts))
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
        return h[first], np.add.reduceat(c, first) if len(first) else c

    def out():
        for i in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["h", "n"])

    for b in batches:
        for i, k in chunks(b.column(0)):
            h, c = np.unique(Words(b.column(0).slice(i, k)).hash | U64(1), return_counts=True)
            parts.append((h, c))
            waiting += len(h)
            if waiting > max(1 << 18, len(held)):
                held, n = merged()
                parts, waiting = [], 0
                if len(held) > 1 << 21:
                    yield from out()
                    held, n = held[:0], n[:0]
    held, n = merged()
    yield from out()


def vocabulary_of(docs: DataFrame, words: int, often: int | None = None) -> Vocabulary:
    """Every word that all documents together have `often` times, and the `words` most frequent ones if those are more; ties by hash."""
    counts = docs.select("text").mapInArrow(lean(_count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    if often is not None:
        counts = Scratch(docs.sparkSession).save(counts)
        words = max(words, counts.where(F.col("n") >= often).count())
    rows = counts.orderBy(F.desc("n"), "h").limit(words).collect()
    return Vocabulary(np.array([r["h"] for r in rows], dtype=np.int64).view(U64), np.array([r["n"] for r in rows], dtype=np.int64))


def _spell(shared):
    """(trigram, count) of a partition's words outside the vocabulary."""

    def run(batches):
        vocabulary = shared.value
        total = np.zeros(SIGNS**3, dtype=np.int64)
        for b in batches:
            for i, k in chunks(b.column(0)):
                w = Words(b.column(0).slice(i, k))
                other = vocabulary.others(w)
                if len(other):
                    np.add.at(total, trigrams(w.raw, w.starts[other], w.ends[other])[0], 1)
        key = np.flatnonzero(total)
        for i in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)]), pa.array(total[key[i : i + (1 << 16)]])], names=["h", "n"])

    return run


def spelling_of(docs: DataFrame, vocabulary: Vocabulary) -> Spelling:
    """Counted over the words outside the vocabulary of all documents; SIGNS ** 3 trigrams at most."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("text").mapInArrow(lean(_spell(shared)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()
    return Spelling(np.array([r["h"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64))


def _dump(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in NAMES]).astype("<f4").tobytes()


def _load(raw: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(raw, dtype="<f4"), {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _train(shared):
    """A partition's copy of the model in slices, and how many words it saw."""

    def run(batches):
        vocabulary, p = shared.value
        trainer = Trainer(vocabulary, p)
        for b in batches:
            for i, k in chunks(b.column(0), 1 << 22):
                trainer.fit(vocabulary.tokens(b.column(0).slice(i, k))[0])
        if not trainer.words:
            return
        flat = np.concatenate([trainer.p[k].ravel() for k in NAMES]).astype("<f4")
        cut = np.linspace(0, len(flat), SLICES + 1).astype(int)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pid] * SLICES, pa.int64()), pa.array([trainer.words] * SLICES, pa.int64()), pa.array([flat[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["slice", "pid", "words", "p"])

    return run


_COPY = "slice int, pid long, words long, p binary"


def _mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("pid")
    words = table.column("words").to_numpy()
    total = sum(float(w) * np.frombuffer(x.as_buffer(), dtype="<f4").astype(np.float64) for w, x in zip(words, table.column("p")))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "pid": pa.array([key[1].as_py()], pa.int64()), "words": pa.array([int(words.sum())], pa.int64()), "p": pa.array([(total / words.sum()).astype("<f4").tobytes()], pa.binary())})


def train(docs: DataFrame, words: int = 2000, warm_rows: int = 1000, often: int = 4000, hidden: int = HIDDEN) -> tuple[Vocabulary, dict]:
    """The vocabulary and the parameters fitted on all of docs (doc_id, text).

    `warm_rows` bounds the sample, of least hashed ids, on which the first
    model is fitted; from there every document is used once. The vocabulary
    has `words` words and all others that occur `often` times, of equally
    frequent ones those with the least hash; `hidden` is the size of the state.

    Null texts are not used, empty ones teach an immediate end. Rows that
    repeat, or whose id is null or repeated, are each trained on; rows without
    an id are not in the first sample. Texts of any length are read whole.
    Other columns may have any name. Of an empty table come an empty vocabulary
    and the parameters that training starts from.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null")
    vocabulary = vocabulary_of(docs, words, often)
    vocabulary.spelling = spelling_of(docs, vocabulary)
    trainer = Trainer(vocabulary, fresh(vocabulary, hidden))
    sample = docs.join(F.broadcast(docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(warm_rows)), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    first = spark.sparkContext.broadcast((vocabulary, trainer.p))
    warm = sample.select("text").coalesce(1).mapInArrow(lean(_train(first)), _COPY).orderBy("slice").collect()
    if not warm:
        return vocabulary, trainer.p
    p = _load(b"".join(r["p"] for r in warm), trainer.p)
    start = spark.sparkContext.broadcast((vocabulary, p))
    copies = scratch.save(docs.select("text").mapInArrow(lean(_train(start)), _COPY))
    most = copies.agg(F.max("pid")).first()[0] or 0
    while True:
        copies = scratch.save(copies.withColumn("pid", F.expr(f"pid div {BRANCHES}")).groupBy("slice", "pid").applyInArrow(_mean, _COPY))
        most //= BRANCHES
        if not most:
            break
    got = copies.orderBy("slice").collect()
    return vocabulary, _load(b"".join(r["p"] for r in got), p) if got else p


def _scorer(shared):
    def run(batches):
        vocabulary, p = shared.value
        for b in batches:
            for i, k in chunks(b.column(1), 1 << 24):
                rows = b.slice(i, k)
                tokens, offsets, spelled = vocabulary.read(rows.column(1))
                ll = score_tokens(p, vocabulary, tokens, offsets) + spelled
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((n - 1).astype(np.int64)), pa.array(np.round(ll, 4)), pa.array(np.round(np.exp(-ll / n), 4))], names=["doc_id", "n_words", "log_likelihood", "perplexity"])

    return run


def lm_score(docs: DataFrame, vocabulary: Vocabulary, p: dict) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) for every row.

    log_likelihood is the natural logarithm for all words of the text and its
    end; perplexity is per word, the end counted. A word outside the
    vocabulary counts as its length token and its spelling. Null, empty and wordless texts have
    the likelihood of an immediate end. Rows with null or repeated ids are
    scored each for itself; other columns may have any name. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((vocabulary, p))
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(_scorer(shared)), "doc_id long, n_words long, log_likelihood double, perplexity double")
