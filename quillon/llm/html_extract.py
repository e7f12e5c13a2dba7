"""Main text of web pages: what a page doesn't share with others of its host.

The words of all pages of a host are one stream, cut at page ends, over which
a suffix array finds the runs of `min_words` words or more that occur on
several distinct pages: menus, banners, footers. Words so covered are removed
and the runs between them kept. Hosts are only a scope in the suffix arrays'
keys, so that a host with many pages is spread like all others.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._bitmap import has, sized
from quillon.llm._text import _BYTE, U64, buffers, chunks, mix, ranges, span_hash
from quillon.llm.suffix_dedup import Windows, cut_words, pack_segments, shard_runs
from quillon.session import Scratch, partitions, ship

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|section|article|header|footer|nav|main|aside|blockquote|pre|form|figure|title|body|head|html|dl|dt|dd)\b[^>]*|(?:br|hr)\b[^>]*)>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^>]*(?:>|\Z)")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def html_text(page: str | None) -> str:
    """The visible text, one block to a line; markup that never ends reaches to the end."""
    if not page:
        return ""
    text = _TAG.sub(" ", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANK.sub(" ", entities.unescape(text))).strip()


class Pages:
    """The visible texts of some rows (page_id, scope, html) and the number of each distinct page."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.ids = rows.column(0)
        self.scope = mix(rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
        self.text = pa.array([html_text(x).encode("utf-8", "replace").decode() for x in rows.column(2).to_pylist()], pa.string())
        raw, at = buffers(self.text)
        self.number = mix(span_hash(_BYTE[raw], at[:-1], at[1:]) ^ self.scope).view(np.int64)


def _pages(batches, most: int = 1 << 21):
    for b in batches:
        for i, k in chunks(b.column(2), most):
            yield Pages(b.slice(i, k))


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(raw: memoryview, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw[: n * size], dtype=np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _split(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(j, order[cut[j] : cut[j + 1]]) for j in np.flatnonzero(np.diff(cut)).tolist()]


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([j for j, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "blob"])


def _keys(w: Windows, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, part of each, 32 more bits of each)."""
    at = w.anchors()
    h = mix(w.gram[at])
    return at, ((h >> U64(32)) % U64(parts)).astype(np.int64), (h & U64(0xFFFFFFFF)).astype(np.uint32)


def _anchors(min_words: int, anchor: int, parts: int):
    """Each page's distinct anchors, packed by part: the sorted bits, places in a list of pages, and that list."""

    def run(batches):
        for p in _pages(batches):
            w = Windows(p.text, min_words, anchor, p.scope)
            at, part, low = _keys(w, parts)
            row = np.searchsorted(w.words.bounds, at, side="right") - 1
            order = np.lexsort((row, low, part))
            part, low, row = part[order], low[order], row[order]
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (row[1:] != row[:-1]))) if len(part) else part.astype(bool)
            part, low, row = part[new], low[new], row[new]
            out = []
            for j, x in _split(part, parts):
                there, of = np.unique(row[x], return_inverse=True)
                out.append((j, np.array([len(x), len(there)], dtype=np.int32).tobytes() + _planes(low[x]) + _planes(of.astype(np.uint32)) + p.number[there].tobytes()))
            yield _packed(out)

    return run


def _shared(batches):
    """The anchors, as part and 32 bits, that several pages have."""
    low, page, part = [], [], 0
    for b in batches:
        for j, blob in zip(b.column(0).to_pylist(), b.column(1)):
            part, raw = j, memoryview(blob.as_buffer())
            n, m = np.frombuffer(raw[:8], dtype=np.int32).tolist()
            low.append(_unplanes(raw[8:], np.uint32, n))
            page.append(np.frombuffer(raw[8 + 8 * n :], dtype=np.int64)[_unplanes(raw[8 + 4 * n :], np.uint32, n)])
    if not low:
        return
    low, page = np.concatenate(low), np.concatenate(page)
    order = np.lexsort((page, low))
    low, page = low[order], page[order]
    twice = (low[1:] == low[:-1]) & (page[1:] != page[:-1])
    yield pa.RecordBatch.from_arrays([pa.array((np.int64(part) << 32) | np.unique(low[1:][twice]).astype(np.int64))], names=["h"])


def _segments(min_words: int, anchor: int, parts: int, shared):
    def run(batches):
        for p in _pages(batches):
            w = Windows(p.text, min_words, anchor, p.scope)
            at, part, low = _keys(w, parts)
            at = at[has(shared.value, (part << 32) | low.astype(np.int64))]
            yield from pack_segments(w, p.scope, p.number, np.zeros_like(p.number), at, min_words, parts)

    return run


def _spans(min_words: int, parts: int):
    """Runs of repeated windows as (page number, first word, end), packed by the page's part; kind 0."""
    shard = shard_runs(min_words, True)

    def run(batches):
        for b in shard(batches):
            page, start, stop = (b.column(c).to_numpy() for c in ("doc", "start", "stop"))
            part = (page.view(U64) % U64(parts)).astype(np.int64)
            rows = [(j, np.array([len(x)], dtype=np.int64).tobytes() + _planes(page[x]) + _planes(start[x]) + _planes((stop[x] + (min_words - 1)).astype(np.int32))) for j, x in _split(part, parts)]
            out = _packed(rows)
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array([0] * len(rows), pa.int32()), out.column(1)], names=["part", "kind", "blob"])

    return run


def _texts(parts: int):
    """The pages, compressed together and packed by part; kind 1."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=6)
        for p in _pages(batches, 1 << 22):  # more pages to a blob are smaller together
            raw, at = buffers(p.text)
            known = p.ids.is_valid().to_numpy(zero_copy_only=False)
            ids = p.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part, rows = (p.number.view(U64) % U64(parts)).astype(np.int64), []
            for j, x in _split(part, parts):
                size = at[1:][x] - at[:-1][x]
                body = np.array([len(x)], dtype=np.int64).tobytes() + ids[x].tobytes() + known[x].astype(np.int64).tobytes() + p.number[x].tobytes() + size.tobytes() + raw[ranges(at[:-1][x], size)].tobytes()
                rows.append((j, squeeze.compress(body)))
            out = _packed(rows)
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array([1] * len(rows), pa.int32()), out.column(1)], names=["part", "kind", "blob"])

    return run


def _joined_spans(pages: list[np.ndarray], starts: list[np.ndarray], stops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in order of pages, those that overlap or touch made one."""
    page, start, stop = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (pages, starts, stops))
    order = np.lexsort((start, page))
    page, start, stop = page[order], start[order], stop[order]
    if not len(page):
        return page, start, stop
    fresh = np.concatenate(([True], page[1:] != page[:-1]))
    group = np.cumsum(fresh) - 1
    wide = np.int64(1) << 32
    far = np.maximum.accumulate(stop + group * wide) - group * wide  # the furthest end so far, page by page
    fresh[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(fresh)
    return page[first], start[first], np.maximum.reduceat(stop, first)


def _cut(batches):
    """The pages of a part without their spans."""
    pages, starts, stops, texts = [], [], [], []
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2)):
            if kind:
                texts.append(blob.as_py())
                continue
            raw = memoryview(blob.as_buffer())
            n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
            pages.append(_unplanes(raw[8:], np.int64, n))
            starts.append(_unplanes(raw[8 + 8 * n :], np.int32, n))
            stops.append(_unplanes(raw[8 + 12 * n :], np.int32, n))
    page, start, stop = _joined_spans(pages, starts, stops)
    expand = zstandard.ZstdDecompressor()
    for blob in texts:
        raw = memoryview(expand.decompress(blob))
        n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
        ids, known, number, size = (np.frombuffer(raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)], dtype=np.int64) for i in range(4))
        at = 8 + 32 * n + np.concatenate(([0], np.cumsum(size)))
        column = pa.array([bytes(raw[at[i] : at[i + 1]]).decode() for i in range(n)], pa.string())
        lo, hi = np.searchsorted(page, number), np.searchsorted(page, number, side="right")
        cuts = [[{"start": int(start[k]), "stop": int(stop[k])} for k in range(x, y)] for x, y in zip(lo, hi)]
        kept = ["\n".join(x for x in (line.strip() for line in t.split("\n")) if any(c.isalnum() for c in x)) for t in cut_words(column, cuts)]
        removed = [sum(s["stop"] - s["start"] for s in c) for c in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(kept, pa.string()), pa.array(removed, pa.int32())], names=["page_id", "text", "n_removed"])


def extract_html(pages: DataFrame, min_words: int = 8, anchor: int = 4) -> DataFrame:
    """(page_id, text, n_removed) for every row of pages (page_id, url, html).

    text: the page's visible text without the runs of min_words words or more
    that another page of the host has too; n_removed: how many words went.
    Lines without a letter or digit are left out. Pages of one host with the
    same visible text are one page, so copies don't empty each other. Host
    names compare without case; pages whose URL is null or names no host
    share the host "".

    Null and empty pages give an empty text. Rows with null or repeated ids
    are treated each for itself. Other columns may have any name. An empty
    table gives an empty result.

    Texts are made from the source in each of three passes, and move once, compressed.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch, parts = Scratch(spark), partitions(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(host).alias("scope"), F.col("html").cast("string").alias("html"))
    shared = scratch.save(rows.mapInArrow(_anchors(min_words, anchor, parts), "part int, blob binary").repartitionById(parts, "part").mapInArrow(_shared, "h long"))
    bits = spark.sparkContext.broadcast(sized(shared, "h", shared.count()))
    segments = rows.mapInArrow(_segments(min_words, anchor, parts, bits), "part int, blob binary").repartitionById(parts, "part")
    spans = segments.mapInArrow(_spans(min_words, parts), "part int, kind int, blob binary")
    texts = rows.mapInArrow(_texts(parts), "part int, kind int, blob binary")
    return spans.union(texts).repartitionById(parts, "part").mapInArrow(_cut, "page_id long, text string, n_removed int")
