"""Passages of many words that documents share, by a logarithmic family of suffix arrays.

A suffix here starts a window of `min_words` words. A suffix array holds the
suffixes in the order of their words, compared word by word; neighbours with a
common prefix of `min_words` words are one passage, and longer matches are runs
of neighbouring windows.

Shards. A window belongs to the shard of its minimizer, the least hash of the
runs of `anchor` words in it; equal windows have equal minimizers, so all that
can match meet in one shard, and whether they do is decided there by their
words. Only windows whose minimizer occurs in several documents are sent at all.

In a shard, documents come in order of their ids, in batches. Each batch gets
its suffix array, which is merge-scanned against the levels that exist; what
is new becomes a level, and levels of like size merge, so that there are
log2(batches) of them and each window is merged as often.

`PassageFamily` keeps such levels on the shared folder: a new batch of
documents is scanned against the levels that earlier ones left, of which it
reads only the texts that share an anchor with it, and levels of like size are
merged there.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._text import U64, Words, chunks, lean, mix, ngrams, ranges, span_hash
from quillon.session import Scratch, delete, exists, partitions, ship

NONE = U64(2**64 - 1)
BATCH = 1 << 15
#: A task works on its shard in so many parts, by minimizers, to hold less at once.
SUBSHARDS = 8


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[i : i + width], by doubling; shorter at the end."""
    out, span = a.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = op(out[:-step], out[step:]) if step < len(out) else out[:-step]
        span += step
    return out


class Windows:
    """Minimizers of the windows of some texts. Hashes of different scopes never agree."""

    def __init__(self, column: pa.Array, min_words: int, anchor: int, scope: np.ndarray | None = None) -> None:
        self.words = w = Words(column)
        self.width = min_words - anchor + 1
        n = len(w.hash)
        end = np.repeat(w.bounds[1:], w.counts)
        at = np.arange(n)
        gram = ngrams(w.hash, anchor)
        if scope is not None:
            gram = mix(gram ^ np.repeat(scope, w.counts))
        self.gram = np.where(at + anchor <= end, gram | U64(1), NONE)
        self.valid = at + min_words <= end
        self.least = sliding(self.gram, self.width, np.minimum) if n else self.gram

    def anchors(self) -> np.ndarray:
        """Positions that are the minimizer of a window; if several tie, each is."""
        if not len(self.gram):
            return np.zeros(0, dtype=np.int64)
        most = sliding(np.where(self.valid, self.least, U64(0))[::-1], self.width, np.maximum)[::-1]
        return np.flatnonzero((most == self.gram) & (most > 0))


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _scopes(b: pa.RecordBatch) -> np.ndarray:
    return mix(b.column("scope").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))


def _anchor_emitter(min_words: int, anchor: int, parts: int):
    def run(batches):
        for b in batches:
            b = b.filter(b.column("doc").is_valid())
            for i, k in chunks(b.column("text")):
                rows = b.slice(i, k)
                w = Windows(rows.column("text"), min_words, anchor, _scopes(rows))
                at = w.anchors()
                ids = rows.column("doc").to_numpy(zero_copy_only=False)[np.searchsorted(w.words.bounds, at, side="right") - 1]
                h = mix(w.gram[at])
                part = ((h >> U64(32)) % U64(parts)).astype(np.int64)
                order, cut = _by_part(part, parts)
                low, ids = (h & U64(0xFFFFFFFF)).astype(np.uint32)[order], ids[order]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[cut[j] : cut[j + 1]].tobytes() + _planes(ids[cut[j] : cut[j + 1]]) for j in some], pa.binary())], names=["part", "blob"])

    return run


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _shared_anchors(batches):
    """(doc, anchor) of the anchors that several documents have."""
    low, ids = [], []
    for b in batches:
        for blob in b.column(1):
            raw = np.frombuffer(blob.as_buffer(), dtype=np.uint8)
            k = len(raw) // 12
            low.append(raw[: 4 * k].view(np.uint32))
            ids.append(np.ascontiguousarray(raw[4 * k :].reshape(8, k).T).reshape(-1).view(np.int64))
    if not low:
        return
    low, ids = np.concatenate(low), np.concatenate(ids)
    order = np.lexsort((ids, low))
    low, ids = low[order], ids[order]
    keep = np.concatenate(([True], (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])))
    low, ids = low[keep], ids[keep]
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(np.append(first, len(low)))
    many = np.repeat(count > 1, count)
    low, ids = low[many].astype(np.int64), ids[many]
    order = np.argsort(ids, kind="stable")
    low, ids = low[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)
    cut = np.append(first, len(ids)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array([low[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in range(len(first))], pa.binary())], names=["doc", "anchors"])


def _segment_emitter(min_words: int, anchor: int, parts: int):
    def run(batches):
        for b in batches:
            for i, k in chunks(b.column("text")):
                rows = b.slice(i, k)
                yield from _segments(rows, min_words, anchor, parts)

    return run


def _segments(rows: pa.RecordBatch, min_words: int, anchor: int, parts: int):
    scope = _scopes(rows)
    w = Windows(rows.column("text"), min_words, anchor, scope)
    if not len(w.gram):
        return
    # per text, the anchors that live: compare (row, 32 bits of the anchor)
    lists = [np.frombuffer(b"".join(x.as_py()), dtype=np.uint32) for x in rows.column("anchors")]
    alive = np.sort(np.concatenate([x.astype(U64) | (U64(r) << U64(32)) for r, x in enumerate(lists)]))
    row = w.words.owner()
    at = w.anchors()
    mine = (mix(w.gram[at]) & U64(0xFFFFFFFF)) | (row[at].astype(U64) << U64(32))
    found = np.searchsorted(alive, mine)
    at = at[(found < len(alive)) & (alive[np.minimum(found, len(alive) - 1)] == mine)]
    doc, sig = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sig"))
    yield from pack_segments(w, scope, doc, sig, at, min_words, parts)


def pack_segments(w: Windows, scope: np.ndarray, doc: np.ndarray, sig: np.ndarray, at: np.ndarray, min_words: int, parts: int):
    """The runs of windows whose minimizers are the anchors `at`, packed by shard."""
    if not len(at):
        return
    n, row = len(w.gram), w.words.owner()
    lives = np.full(n, NONE, dtype=U64)
    lives[at] = w.gram[at]
    hit = w.valid & (sliding(lives, w.width, np.minimum) == w.least)
    run = hit & np.concatenate(([True], ~hit[:-1] | (w.least[1:] != w.least[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(run)
    last = np.flatnonzero(hit & np.concatenate((run[1:] | ~hit[1:], [True])))
    long = last - first + 1
    tokens = (w.words.hash & U64(0xFFFFFFFF)).astype(np.uint32)
    name = span_hash(w.words.hash, first, first + long + min_words - 1) ^ scope[row[first]]
    shard = (mix(mix(w.least[first])) % U64(parts)).astype(np.int64)
    order, cut = _by_part(shard, parts)
    start = first - w.words.bounds[:-1][row[first]]
    doc, sig = doc[row[first]], sig[row[first]]
    some = np.flatnonzero(np.diff(cut))
    blobs = []
    for j in some:
        x = order[cut[j] : cut[j + 1]]
        _, one, of = np.unique(name[x], return_index=True, return_inverse=True)  # the same text is sent once
        one = x[one]
        size = long[one] + min_words - 1
        blobs.append(b"".join(a.tobytes() for a in (np.array([len(one), len(x)], dtype=np.int64), scope[row[first[one]]], long[one].astype(np.int64), doc[x].astype(np.int64), sig[x].astype(np.int64), of.astype(np.int32), start[x].astype(np.int32), tokens[ranges(first[one], size)], (mix(w.least[first[one]]) >> U64(56)).astype(np.uint8))))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


class Level:
    """A suffix array: the words of suffixes (`suffix_words`), ascending, and the window each stands for."""

    def __init__(self, keys: np.ndarray, windows: np.ndarray) -> None:
        self.keys, self.windows = keys, windows

    @classmethod
    def build(cls, keys: np.ndarray, windows: np.ndarray) -> Level:
        order = np.argsort(keys, kind="stable")  # equal suffixes stay in order of documents
        return cls(keys[order], windows[order])

    def lcp(self) -> np.ndarray:
        """How many words each suffix has in common with the one before it, the scope's two counted; 0 for the first."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        words = self.keys.view(">u4").reshape(len(self.keys), -1)
        differ = words[1:] != words[:-1]
        return np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])))

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """For ascending keys, the window here that matches, or -1: one merge of two sorted arrays."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.windows[at], -1) if len(self.keys) else np.full(len(keys), -1)

    def merge(self, other: Level) -> Level:
        return Level.build(np.concatenate((self.keys, other.keys)), np.concatenate((self.windows, other.windows)))


class Family:
    """Levels of suffix arrays of distinct windows; each is at least twice as large as the next."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        for level in self.levels:
            out = np.where(out < 0, level.scan(keys), out)
        return out

    def add(self, level: Level) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].keys) < 2 * len(self.levels[-1].keys):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merge(b))


def suffix_words(tokens: np.ndarray, starts: np.ndarray, min_words: int, scope: np.ndarray) -> np.ndarray:
    """Of each suffix its scope and first `min_words` words, as bytes that sort word by word."""
    out = np.empty((len(starts), 2 + min_words), dtype=">u4")
    out[:, 0], out[:, 1] = scope >> U64(32), scope & U64(0xFFFFFFFF)
    out[:, 2:] = np.lib.stride_tricks.sliding_window_view(tokens, min_words)[starts]
    return out.view(f"S{out.shape[1] * 4}").ravel()


def find_repeats(occurrences: dict[str, np.ndarray], tokens: np.ndarray, seg_start: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that repeat across documents, in order of documents: (partner window or -1, window of which it is the partner or -1).

    occurrences: doc, seg, long (windows), scope, each in order of doc.
    """
    doc, seg, long = occurrences["doc"], occurrences["seg"], occurrences["long"]
    owner = np.repeat(np.arange(len(doc)), long)
    base = np.concatenate(([0], np.cumsum(long)))
    total = base[-1]
    partner, echo, leads = np.full(total, -1, dtype=np.int64), np.full(total, -1, dtype=np.int64), np.arange(total)
    family = Family()
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(base, base[i] + BATCH, side="right")) - 1)
        x, y = base[i], base[j]
        of = owner[x:y]
        starts = seg_start[seg[of]] + (np.arange(x, y) - base[of])
        level = Level.build(suffix_words(tokens, starts, min_words, occurrences["scope"][of]), np.arange(x, y))
        win, head = level.windows, level.lcp() < min_words + 2
        head[:1] = True
        leader = np.flatnonzero(head)
        known = family.scan(level.keys[leader])
        lead = np.where(known >= 0, known, win[leader])[np.cumsum(head) - 1]
        other = doc[owner[lead]] != doc[owner[win]]
        partner[win[other]] = lead[other]
        echo[lead[other]] = win[other]
        leads[win] = lead
        new = known < 0
        family.add(Level(level.keys[leader[new]], win[leader[new]]))
        i = j
    return partner, echo[leads]  # a window that its own document has twice is shared in both places


SPANS = "doc long, sig long, first_doc long, start int, stop int"


def shard_runs(min_words: int, everywhere: bool):
    """Runs of repeated windows; windows start to stop - 1 of document doc are in first_doc too."""

    def run(batches):
        parts = []
        for b in batches:
            for blob in b.column("blob"):
                raw, at = memoryview(blob.as_buffer()), 16
                segs, occs = np.frombuffer(raw[:16], dtype=np.int64)
                got = []
                for kind, count in ((U64, segs), (np.int64, segs), (np.int64, occs), (np.int64, occs), (np.int32, occs), (np.int32, occs)):
                    size = int(count) * np.dtype(kind).itemsize
                    got.append(np.frombuffer(raw[at : at + size], dtype=kind))
                    at += size
                got.append(np.frombuffer(raw[at : len(raw) - int(segs)], dtype=np.uint32))
                parts.append([*got, np.frombuffer(raw[len(raw) - int(segs) :], dtype=np.uint8)])
        if not parts:
            return
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        scope, seg_long = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        every = [np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), np.concatenate([p[4].astype(np.int64) + s for p, s in zip(parts, shift)]), np.concatenate([p[5] for p in parts])]
        tokens, sub = np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts]) % SUBSHARDS
        del parts
        seg_start = np.concatenate(([0], np.cumsum(seg_long + min_words - 1)))[:-1]
        for k in range(SUBSHARDS):
            mine = np.flatnonzero(sub[every[2]] == k)
            if len(mine):
                yield from _sub_runs(*(x[mine] for x in every), scope, seg_long, seg_start, tokens, min_words, everywhere)

    return run


def _sub_runs(doc, sig, seg, start, scope, seg_long, seg_start, tokens, min_words: int, everywhere: bool):
    order = np.lexsort((start, sig, doc))
    doc, sig, seg, start = doc[order], sig[order], seg[order], start[order]
    long = seg_long[seg]
    partner, echo = find_repeats({"doc": doc, "seg": seg, "long": long, "scope": scope[seg]}, tokens, seg_start, min_words)
    owner = np.repeat(np.arange(len(doc)), long)
    base = np.concatenate(([0], np.cumsum(long)))
    if everywhere:
        partner = np.where(partner < 0, echo, partner)
    at = np.flatnonzero(partner >= 0)
    if not len(at):
        return
    of, whose = owner[at], doc[owner[partner[at]]]
    run = np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (whose[1:] != whose[:-1]) & (not everywhere)))
    first = np.flatnonzero(run)
    last = np.append(first[1:], len(at)) - 1
    o = of[first]
    cols = [doc[o], sig[o], whose[first], (start[o] + at[first] - base[o]).astype(np.int32), (start[o] + at[last] - base[o] + 1).astype(np.int32)]
    for i in range(0, len(o), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["doc", "sig", "first_doc", "start", "stop"])


def repeated_windows(rows: DataFrame, min_words: int, anchor: int, everywhere: bool = False) -> DataFrame:
    """Runs of repeated windows of rows (doc, scope, text): doc, sig, first_doc, start, stop.

    sig is xxhash64(text), since an id may come with several texts. With
    `everywhere` the earliest document that has a passage is reported as well.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    parts = partitions(spark)
    rows = rows.select("doc", "scope", "text", F.xxhash64("text").alias("sig"))
    anchors = rows.mapInArrow(lean(_anchor_emitter(min_words, anchor, parts)), "part int, blob binary").repartitionById(parts, "part").mapInArrow(lean(_shared_anchors), "doc long, anchors binary")
    alive = anchors.groupBy("doc").agg(F.collect_list("anchors").alias("anchors"))
    segments = rows.join(alive, "doc").mapInArrow(lean(_segment_emitter(min_words, anchor, parts)), "part int, blob binary")
    return segments.repartitionById(parts, "part").mapInArrow(lean(shard_runs(min_words, everywhere)), SPANS)


def _joined(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that touch become one."""
    order = f"(partition by {', '.join(keys)} order by start, stop"
    fresh = runs.withColumn("fresh", F.expr(f"coalesce(start > max(stop) over {order} rows between unbounded preceding and 1 preceding), true)"))
    numbered = fresh.withColumn("run", F.expr(f"sum(cast(fresh as int)) over {order} rows unbounded preceding)"))
    return numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("scope"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeated_passages(docs: DataFrame, min_words: int = 50, anchor: int = 10) -> DataFrame:
    """(doc_id, first_doc, start_word, n_words): passages of min_words words or more that an earlier document has too.

    first_doc has the least id of all documents with the passage; the passage
    is reported for every other document that has it. Words are runs of
    letters and digits, ASCII case aside, counted from 0; neighbouring matches
    with one first_doc are one passage. Reads doc_id and text alone.

    Rows without an id take part in nothing; null, empty and short texts hold
    no passage; what repeats only inside a document isn't reported. Rows that
    repeat an id are one document: passages of each of its texts are reported,
    those that only its own texts share are not. An empty table gives an empty
    result.
    """
    return _passages(repeated_windows(_rows(docs), min_words, anchor), min_words)


def _passages(runs: DataFrame, min_words: int) -> DataFrame:
    return _joined(runs, ["doc", "sig", "first_doc"]).select(F.col("doc").alias("doc_id"), "first_doc", F.col("start").alias("start_word"), (F.col("stop") - F.col("start") + (min_words - 1)).cast("int").alias("n_words")).distinct()


def _every_anchor(min_words: int, anchor: int):
    """(h, doc) of all anchors of each text."""

    def run(batches):
        for b in batches:
            for i, k in chunks(b.column("text")):
                rows = b.slice(i, k)
                w = Windows(rows.column("text"), min_words, anchor, _scopes(rows))
                at = w.anchors()
                ids = rows.column("doc").to_numpy(zero_copy_only=False)[np.searchsorted(w.words.bounds, at, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(mix(w.gram[at]).view(np.int64)), pa.array(ids)], names=["h", "doc"])

    return run


def _pack_anchors(batches):
    """(doc, anchors): the 32 bits of each that `_segments` compares, in one value."""
    for b in batches:
        lists = b.column(1)
        low = (lists.flatten().to_numpy(zero_copy_only=False).view(U64) & U64(0xFFFFFFFF)).astype(np.uint32)
        cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[low[x:y].tobytes()] for x, y in zip(cut, cut[1:])], pa.list_(pa.binary()))], names=["doc", "anchors"])


class PassageFamily:
    """Levels of texts and their anchors under `path`, to which batches of documents are added; each level is at least twice as large as the next.

    A manifest names the levels that count; it is written last, so a batch that
    was broken off leaves nothing behind that is read, and may be added again.
    """

    def __init__(self, spark: SparkSession, path: str, min_words: int = 50, anchor: int = 10) -> None:
        self.spark, self.path, self.min_words, self.anchor = spark, path, min_words, anchor

    def levels(self) -> list[tuple[str, int]]:
        """(name, documents) of each level, the largest first."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        rows = self.spark.read.schema("version long, levels string").parquet(f"{self.path}/manifest")
        return [tuple(x) for x in json.loads(rows.orderBy(F.desc("version")).first()["levels"])]

    def _read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.schema({"texts": "doc long, scope long, text string, sig long", "anchors": "h long, doc long"}[table]).parquet(f"{self.path}/{name}/{table}")

    def _write(self, texts: DataFrame, anchors: DataFrame) -> str:
        name = uuid.uuid4().hex
        texts.write.parquet(f"{self.path}/{name}/texts")
        anchors.write.parquet(f"{self.path}/{name}/anchors")
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """The passages of these documents that they or documents added before have too, as `repeated_passages` gives them.

        Ids must rise from batch to batch; then all batches together give what
        one run over all documents gives. Rows without an id take part in
        nothing. An empty batch gives an empty result.
        """
        ship(self.spark)
        levels, parts = self.levels(), partitions(self.spark)
        rows = _rows(docs).where("doc is not null").select("doc", "scope", "text", F.xxhash64("text").alias("sig")).distinct()
        found = rows.mapInArrow(lean(_every_anchor(self.min_words, self.anchor)), "h long, doc long").distinct()
        new = self._write(rows, found)
        mine, own = self._read(new, "anchors"), self._read(new, "texts")
        every = mine
        for name, _ in levels:  # the new anchors against each level
            every = every.union(self._read(name, "anchors").join(mine.select("h").distinct(), "h", "left_semi"))
        alive = every.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h")
        per = every.join(alive, "h", "left_semi").groupBy("doc").agg(F.collect_set("h").alias("h")).mapInArrow(_pack_anchors, "doc long, anchors array<binary>")
        texts = own
        for name, _ in levels:
            texts = texts.union(self._read(name, "texts"))
        segments = texts.join(per, "doc").mapInArrow(lean(_segment_emitter(self.min_words, self.anchor, parts)), "part int, blob binary")
        runs = segments.repartitionById(parts, "part").mapInArrow(lean(shard_runs(self.min_words, False)), SPANS).join(own.select("doc", "sig").distinct(), ["doc", "sig"], "left_semi")
        _passages(runs, self.min_words).write.parquet(f"{self.path}/{new}/passages")
        self._settle([*levels, (new, own.count())])
        return self.spark.read.schema("doc_id long, first_doc long, start_word int, n_words int").parquet(f"{self.path}/{new}/passages")

    def _settle(self, levels: list[tuple[str, int]]) -> None:
        """Merges levels of like size and makes what is left count."""
        gone = []
        while len(levels) > 1 and levels[-2][1] < 2 * levels[-1][1]:
            (b, m), (a, n) = levels.pop(), levels.pop()
            levels.append((self._write(*(self._read(a, t).union(self._read(b, t)) for t in ("texts", "anchors"))), n + m))
            gone += [a, b]
        version = self.spark.read.schema("version long, levels string").parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] + 1 if exists(self.spark, f"{self.path}/manifest") else 0
        self.spark.createDataFrame([(version, json.dumps(levels))], "version long, levels string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for name in gone:
            for table in ("texts", "anchors"):
                delete(self.spark, f"{self.path}/{name}/{table}")


def cut_words(column: pa.Array, spans: list) -> list[str]:
    """The texts without the given spans of words; a span ends where the next word starts."""
    w = Words(column)
    out = []
    raw = w.raw.tobytes()
    for r, cuts in enumerate(spans):
        lo, hi = int(w.offsets[r]), int(w.offsets[r + 1])
        starts = w.starts[w.bounds[r] : w.bounds[r + 1]]
        kept, at = [], lo
        for s in sorted(cuts or [], key=lambda s: (s["start"], s["stop"])):
            if s["start"] >= len(starts):
                continue
            x = int(starts[s["start"]])
            y = int(starts[s["stop"]]) if s["stop"] < len(starts) else hi
            if x > at:
                kept.append(raw[at:x])
            at = max(at, y)
        kept.append(raw[at:hi])
        out.append(b"".join(kept).decode("utf-8", "ignore"))
    return out


def _cutter(batches):
    for b in batches:
        names = b.schema.names
        for i, k in chunks(b.column("text")):
            rows = b.slice(i, k)
            spans = rows.column(len(names) - 1)
            if spans.null_count == k:
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=names[:-1])
                continue
            text = rows.column("text")
            some = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            new = dict(zip(some.tolist(), cut_words(text.take(pa.array(some)), spans.take(pa.array(some)).to_pylist())))
            texts = pa.array([new.get(r, x) for r, x in enumerate(text.to_pylist())], pa.string())
            keep = pa.array([r not in new or any(c.isalnum() for c in new[r]) for r in range(k)], pa.bool_())
            cols = []
            for v, c in zip(rows.columns, names[:-1]):
                if c == "text":
                    v = texts
                elif c == "n_chars":
                    v = pa.array([len(new[r]) if r in new else x for r, x in enumerate(v.to_pylist())], v.type)
                cols.append(v)
            yield pa.RecordBatch.from_arrays(cols, names=names[:-1]).filter(keep)


def cut_repeated_passages(docs: DataFrame, min_words: int = 50, anchor: int = 10) -> DataFrame:
    """Cuts each repeated passage from all documents but the first that has it; all columns stay.

    text and n_chars follow the cut, other columns are as they were. A document
    of which no letter or digit is left goes; one of which nothing is cut stays
    as it is, whatever its text. Rows without an id, and null, empty and short
    texts, stay as they are. Rows that repeat an id and a text are cut alike;
    of the same passage in several texts of one id nothing is cut. Texts of any
    length are read whole. Columns may have any name. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    runs = _joined(repeated_windows(_rows(docs), min_words, anchor), ["doc", "sig"])
    name = "__cuts"
    while name in docs.columns:
        name += "_"
    cuts = scratch.save(runs.groupBy("doc", "sig").agg(F.collect_list(F.struct("start", (F.col("stop") + (min_words - 1)).alias("stop"))).alias(name)))
    joined = docs.join(cuts, (docs["doc_id"].cast("long") == cuts["doc"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == cuts["sig"]), "left").select(*[docs[c] for c in docs.columns], cuts[name])
    return joined.mapInArrow(_cutter, docs.schema)
