"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state with an arc to itself for every byte; each
merge x y -> z then adds a gadget, in the order of the merges:

* the state behind x loses its arc y, since x y is no longer written so;
* a new arc z leads from wherever x did to a state that is a copy of the one
  behind y, as it is at this moment; what y's state loses later doesn't touch
  the copy.

All arcs with one label lead to one state, so a state is named by the token
before it, and a copy shares the list of losses of its original up to the
moment it was made. The finished automaton accepts exactly one token sequence
for every string: the one that applying the merges in order gives.

A word is encoded by tables alone: a trie gives the arcs whose labels match
at each byte, and a walk through the automaton in the order of bytes keeps,
for each place, the one arc by which it is reached. Both run for all the
distinct words of a batch in step. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import _BYTE, U64, buffers, chunks, lean, mix, ranges, span_hash
from quillon.session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FOREVER = np.int32(2**31 - 1)
LETTER, DIGIT, SPACE, REST = range(4)


class Table:
    """A hash table from keys >= 0 to values, looked up for many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = (1 << max(4, int(len(keys) * 3).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, dtype=np.int64), np.zeros(self.mask + 1, dtype=np.int32)
        keys, values = np.asarray(keys, dtype=np.int64), np.asarray(values, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            one, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[one], self.values[one] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(U64)) & U64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


@dataclass
class Automaton:
    """What encoding needs, as arrays; its size depends on the vocabulary alone."""

    labels: np.ndarray  # the bytes of all tokens
    label_at: np.ndarray  # where each token's begin
    trie: Table  # node * 256 + byte -> node
    token_of: np.ndarray  # node -> token or -1
    lost: Table  # x * tokens + y -> when the state behind x lost its arc y
    before: np.ndarray  # token -> the token that its state is a copy of, and its last row
    copied: np.ndarray  # token -> when that copy was made, FOREVER for itself
    starts: np.ndarray  # token -> the tokens that its label starts with, from which its arc was made
    started: np.ndarray  # token -> when that was
    classes: np.ndarray  # code point -> LETTER, DIGIT, SPACE, REST
    memo_bits: int = 18

    def __post_init__(self) -> None:
        self.memo_key, self.memo = np.full(1 << self.memo_bits, -1, dtype=np.int64), np.zeros(1 << self.memo_bits, dtype=bool)

    def arc(self, behind: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state behind one token has an arc for another."""
        key = behind.astype(np.int64) * len(self.token_count) + token
        at = (mix(key.view(U64)) >> U64(64 - self.memo_bits)).astype(np.int64)
        out = self.memo[at]
        new = np.flatnonzero(self.memo_key[at] != key)
        if len(new):
            one, of = np.unique(key[new], return_inverse=True)
            fresh = self._arc((one // len(self.token_count)), (one % len(self.token_count)))
            out[new] = fresh[of]
            self.memo_key[at[new]], self.memo[at[new]] = key[new], fresh[of]
        return out

    @property
    def token_count(self) -> range:
        return range(len(self.label_at) - 1)

    def _arc(self, behind: np.ndarray, token: np.ndarray) -> np.ndarray:
        n, ok = len(self.token_count), np.ones(len(behind), dtype=bool)
        x, until = behind.astype(np.int64), np.full(len(behind), FOREVER)
        rows = np.arange(len(behind))
        while len(rows):
            y, end = token[rows].astype(np.int64), np.full(len(rows), FOREVER)
            sub = np.arange(len(rows))
            while len(sub):
                r = self.lost.get(x[sub] * n + y[sub])
                ok[rows[sub[(r >= 0) & (r < until[sub]) & (r <= end[sub])]]] = False
                up = self.starts[y[sub]]
                end[sub] = self.started[y[sub]]
                y[sub] = up
                sub = sub[up >= 0]
            up = self.before[x]
            until = self.copied[x]
            keep = (up >= 0) & ok[rows]
            rows, x, until = rows[keep], up[keep].astype(np.int64), until[keep]
        return ok


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            out[chr(256 + n)] = b
            n += 1
    return out


def _classes() -> np.ndarray:
    """By the Unicode version of this Python; a sign that Unicode added later counts as no letter."""
    every = [chr(i) for i in range(0x110000)]
    out = np.array([{"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], REST) for c in every], dtype=np.uint8)
    out[[i for i, c in enumerate(every) if c.isspace() and not 0x1C <= i <= 0x1F]] = SPACE
    return out


def compile_merges(path: str = TOKENIZER) -> Automaton:
    """Builds the automaton, one gadget per merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    to_byte = _unicode_bytes()
    names = {k: i for k, i in model["vocab"].items() if all(c in to_byte for c in k)}
    size = max(names.values()) + 1
    label = [b""] * size
    for k, i in names.items():
        label[i] = bytes(to_byte[c] for c in k)
    before, copied = np.full(size, -1, dtype=np.int32), np.full(size, FOREVER)
    starts, started = np.full(size, -1, dtype=np.int32), np.full(size, FOREVER)
    lost_key, lost_when = [], []
    reached = {i for i, b in enumerate(label) if len(b) == 1}
    for when, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        x, y, z = names[a], names[b], names[a + b]
        lost_key.append(x * size + y)
        lost_when.append(when)
        before[z], copied[z] = y, when
        starts[z], started[z] = x, when
        reached.add(z)
    children: dict[int, int] = {}
    token_of = [-1]
    for i in sorted(reached):
        node = 0
        for c in label[i]:
            nxt = children.get(node * 256 + c)
            if nxt is None:
                nxt = children[node * 256 + c] = len(token_of)
                token_of.append(-1)
            node = nxt
        token_of[node] = i
    flat = np.frombuffer(b"".join(label), dtype=np.uint8)
    at = np.concatenate(([0], np.cumsum([len(b) for b in label])))
    trie = Table(np.fromiter(children, dtype=np.int64), np.fromiter(children.values(), dtype=np.int32))
    return Automaton(flat, at, trie, np.array(token_of, dtype=np.int32), Table(np.array(lost_key), np.array(lost_when)), before, copied, starts, started, _classes())


def split(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where the words of some texts start, by the splitting pattern of the vocabulary.

    Letters, digits and other signs form runs that take one blank before them;
    white space is a word but for that blank; 's 't 're 've 'm 'll 'd are words.
    """
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    place = np.arange(n) if n == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)
    head = np.zeros(n + 1, dtype=bool)
    cuts = offsets[:-1]
    head[np.searchsorted(place, cuts)] = True
    head[n] = True
    kind = classes[points]
    change = head[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 32
    start = change.copy()
    # the last sign of white space before a run starts a word
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
    start |= last
    taken = np.zeros(n, dtype=bool)
    taken[1:] = (last & blank)[:-1]
    start &= ~taken
    mark = np.flatnonzero((points == 39) & start)
    if len(mark):
        nxt = lambda k: np.where(mark + k < n, points[np.minimum(mark + k, n - 1)], 0) * ~np.maximum.reduce([head[np.minimum(mark + j, n)] for j in range(1, k + 1)])
        one, two = nxt(1), nxt(2)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for m, k in ((mark[short], 1), (mark[long], 2)):
            start[m + 1] = False
            after = m + 1 + k
            after = after[after < n]
            start[after[(kind[after] == LETTER) & ~head[after]]] = True
    return place[start]


def encode_words(auto: Automaton, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of words raw[at[i]:at[i + 1]]."""
    total, words = len(raw), len(at) - 1
    owner = np.repeat(np.arange(words), np.diff(at))
    end = np.repeat(at[1:], np.diff(at))
    pos, node, depth = np.arange(total), np.zeros(total, dtype=np.int64), 0
    arcs = []
    while len(pos):
        node = auto.trie.get(node * 256 + raw[pos + depth]).astype(np.int64)
        alive = node >= 0
        pos, node = pos[alive], node[alive]
        depth += 1
        tok = auto.token_of[node]
        hit = np.flatnonzero(tok >= 0)
        arcs.append((pos[hit], np.full(len(hit), depth, dtype=np.int32), tok[hit]))
        inside = pos + depth < end[pos]
        pos, node = pos[inside], node[inside]
    start, length, token = (np.concatenate([a[i] for a in arcs]) for i in range(3)) if arcs else (np.zeros(0, dtype=np.int64),) * 3
    stop = start + length
    order = np.lexsort((-length, stop - at[owner[start]])) if len(start) else np.zeros(0, dtype=np.int64)
    start, stop, token = start[order], stop[order], token[order]
    step = stop - at[owner[start]] if len(start) else stop
    reach = np.full(total + 1, -1, dtype=np.int32)  # the arc that ends at each byte
    bounds = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True]))) if len(step) else [0]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        s, e, t = start[lo:hi], stop[lo:hi], token[lo:hi]
        first = s == at[owner[s]]
        ok = first.copy()
        rest = np.flatnonzero(~first)
        if len(rest):
            ok[rest] = auto.arc(reach[s[rest] - 1], t[rest])
        reach[e[ok] - 1] = t[ok]
    lengths = np.diff(auto.label_at)
    here, live, back, who = at[1:].copy(), np.flatnonzero(np.diff(at) > 0), [], []
    while len(live):
        t = reach[here[live] - 1]
        back.append(t)
        who.append(live)
        here[live] -= lengths[t]
        live = live[here[live] > at[:-1][live]]
    if not back:
        return np.zeros(0, dtype=np.int32), np.zeros(words, dtype=np.int64)
    rank = np.concatenate([np.full(len(b), -i) for i, b in enumerate(back)])
    back, who = np.concatenate(back), np.concatenate(who)
    order = np.lexsort((rank, who))
    return back[order], np.bincount(who, minlength=words)


class Encoder:
    """Encodes batches of texts; words met before are remembered, `MOST` of them at most."""

    MOST = 1 << 19

    def __init__(self, auto: Automaton) -> None:
        self.auto = auto
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.count, self.tokens = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of the texts; a null has no tokens."""
        raw, offsets = buffers(column)
        try:
            starts = split(raw, offsets, self.auto.classes)
        except UnicodeDecodeError:
            return self.encode(pa.array([x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else None for x in column.cast(pa.binary())]))
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        h = span_hash(_BYTE[raw], starts, ends)
        one, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > self.MOST:
            self._forget()
        k = np.minimum(np.searchsorted(self.hash, one), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[k] != one) if len(self.hash) else np.arange(len(one))
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            tokens, count = encode_words(self.auto, raw[ranges(s, e - s)], np.concatenate(([0], np.cumsum(e - s))))
            at = len(self.tokens) + np.concatenate(([0], np.cumsum(count)))[:-1]
            self.hash, self.at, self.count = np.concatenate((self.hash, one[new])), np.concatenate((self.at, at)), np.concatenate((self.count, count))
            order = np.argsort(self.hash, kind="stable")
            self.hash, self.at, self.count, self.tokens = self.hash[order], self.at[order], self.count[order], np.concatenate((self.tokens, tokens))
            k = np.searchsorted(self.hash, one)
        k = k[of]
        count = self.count[k]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.tokens[ranges(self.at[k], count)], total[np.searchsorted(starts, offsets)]


def decode_tokens(auto: Automaton, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the labels of the arcs."""
    size = np.diff(auto.label_at)[tokens]
    total = np.concatenate(([0], np.cumsum(size)))
    return auto.labels[ranges(auto.label_at[:-1][tokens], size)], total[offsets]


def _encoder(shared):
    def run(batches):
        auto = shared.value
        encoder = Encoder(auto)
        for b in batches:
            for i, k in chunks(b.column(1)):
                rows = b.slice(i, k)
                column = rows.column(1)
                tokens, offsets = encoder.encode(column)
                raw, back = decode_tokens(auto, tokens, offsets)
                old, old_at = buffers(column)
                same = np.diff(back) == np.diff(old_at)
                if same.all():
                    wrong = np.flatnonzero(raw != old)
                    same[np.searchsorted(old_at, wrong, side="right") - 1] = False
                else:
                    same &= [raw[back[j] : back[j + 1]].tobytes() == old[old_at[j] : old_at[j + 1]].tobytes() for j in range(k)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(offsets).astype(np.int32)), pa.array(same)], names=["doc_id", "tokens", "n_tokens", "exact"])

    return run


def bpe_encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for every row; exact: decoding gives the text's bytes again.

    The vocabulary is read on the driver and its automaton sent out, of a size
    that doesn't depend on the data. Null and empty texts have no tokens and
    are exact. Texts are encoded whole, however long. Bytes that are no UTF-8
    become U+FFFD before they are encoded, and the row isn't exact. Rows with
    null or repeated ids are encoded each for itself; other columns may have
    any name. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(compile_merges(tokenizer))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(lean(_encoder(shared)), "doc_id long, tokens array<int>, n_tokens int, exact boolean")


def _decoder(shared):
    def run(batches):
        auto = shared.value
        for b in batches:
            column = b.column(1)
            for i in range(0, b.num_rows, 256):
                part = column.slice(i, 256)
                lists = part.fill_null([]) if part.null_count else part
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                raw, at = decode_tokens(auto, flat, offsets)
                texts = [raw[at[j] : at[j + 1]].tobytes().decode("utf-8", "replace") for j in range(len(part))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(texts, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "text"])

    return run


def bpe_decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens); null tokens give a null text, an unknown token is an error."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(compile_merges(tokenizer))
    return encoded.select(F.col("doc_id").cast("long"), F.col("tokens").cast("array<int>")).mapInArrow(_decoder(shared), "doc_id long, text string")
