"""Language identification with bit-sliced Bloom filters of byte n-grams.

One array of slots serves all languages: bit l of a slot belongs to the filter
of language l, so that the filters of all languages are asked with one lookup.
An n-gram of four bytes is looked up in two slots; the bits that both have are
the languages that contain it. A text's hits are counted per language, cleared
of the false positives that the filter's fill makes one expect, and the
language with the most wins.

A filter holds the n-grams that are frequent in its language and not much
rarer there than in any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._text import _LOWER, _WORD, buffers, chunks, lean
from quillon.session import ship

SLOTS = 1 << 20
GRAM = 4
UNKNOWN = "und"
_FOLD = np.where(_WORD, _LOWER, 32).astype(np.uint8)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, text of each): four bytes in lower case; what is no letter or digit is a blank, and a text has one before and after it."""
    raw, offsets = buffers(column)
    n, k = len(raw), len(offsets) - 1
    sizes = np.diff(offsets)
    some = np.full(n + 2 * k, 32, dtype=np.uint8)
    owner = np.repeat(np.arange(k, dtype=np.int32), sizes + 2)
    at = np.arange(n) + np.repeat(2 * np.arange(k) + 1, sizes)
    some[at] = _FOLD[raw]
    if len(some) < GRAM:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)
    # a run of blanks counts once
    keep = np.concatenate(([True], (some[1:] != 32) | (some[:-1] != 32) | (owner[1:] != owner[:-1])))
    some, owner = some[keep], owner[keep]
    if len(some) < GRAM:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)
    x = some[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        x |= some[i : len(some) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    inside = owner[3:] == owner[:-3]
    return x[inside], owner[:-3][inside]


def _slots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = x * np.uint32(0x9E3779B1)
    a ^= a >> np.uint32(15)
    b = (x ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA77)
    b ^= b >> np.uint32(13)
    return (a * np.uint32(0x2C1B3C6D)) >> np.uint32(12), (b * np.uint32(0x297A2D39)) >> np.uint32(12)


@dataclass
class Filters:
    """languages[l] owns bit l of each slot; fill[l]: the share of slots that have it."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> Filters:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= len(languages))
        slots = np.zeros(SLOTS, dtype=kind)
        for bit, x in enumerate(members):
            for at in _slots(x.astype(np.uint32)):
                slots[at] |= kind(1 << bit)
        fill = np.array([np.count_nonzero(slots & kind(1 << bit)) / SLOTS for bit in range(len(languages))])
        return cls(languages, slots, fill)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, [text, language] expected true hits)."""
        x, owner = grams(column)
        k = len(column)
        a, b = _slots(x)
        mask = self.slots[a] & self.slots[b]
        n = np.bincount(owner, minlength=k)
        width = 1 << min(len(self.languages), 8)
        hits = np.zeros((k, len(self.languages)))
        for lo in range(0, len(self.languages), 8):  # popcounts of eight languages at a time, from a histogram of masks
            part = ((mask >> mask.dtype.type(lo)) & mask.dtype.type(width - 1)).astype(np.int64)
            histogram = np.bincount(owner.astype(np.int64) * width + part, minlength=k * width).reshape(k, width) if k * width <= max(4 * len(x), 1 << 20) else None
            for bit in range(min(8, len(self.languages) - lo)):
                has = (np.arange(width) >> bit) & 1
                hits[:, lo + bit] = histogram @ has if histogram is not None else np.bincount(owner, (part >> bit) & 1, minlength=k)
        chance = self.fill**2
        return n, np.maximum((hits - n[:, None] * chance) / (1 - chance), 0)


def _counter(languages: list[str]):
    def run(batches):
        for b in batches:
            for i, k in chunks(b.column(0)):
                text, lang = b.column(0).slice(i, k), b.column(1).slice(i, k).to_pylist()
                x, owner = grams(text)
                code = np.array([languages.index(v) for v in lang])[owner] if k else owner
                keys, n = np.unique((code.astype(np.int64) << 32) | x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["l", "gram", "n"])

    return run


def train(docs: DataFrame, rows_per_language: int = 1000, most: int = 30_000, ratio: float = 0.3) -> Filters:
    """Filters of the languages that docs (doc_id, lang, text) name; at most 64.

    Fitted on at most `rows_per_language` labelled rows of each language,
    those with the least hash of their ids; of rows that repeat an id the least
    text counts. A filter takes the `most` most
    frequent n-grams that reach `ratio` of the frequency they have in any
    language; ties go by the n-gram's value. Rows without id, lang or text
    are not used; without any row there is no language.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(text as string) text").where("doc_id is not null and lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_language).select("doc_id", "lang")
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if len(languages) > 64:
        raise ValueError(f"{len(languages)} languages; a slot has 64 bits")
    if not languages:
        return Filters.build([], [])
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")  # chosen: rows_per_language * 64 rows at most
    counts = sample.mapInArrow(lean(_counter(languages)), "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    share = counts.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("l")))
    own = share.withColumn("top", F.max("f").over(Window.partitionBy("gram"))).where(F.col("f") >= F.col("top") * ratio)
    kept = own.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    got = kept.groupBy("l").agg(F.collect_list("gram").alias("grams")).collect()
    members = {r["l"]: np.array(r["grams"], dtype=np.int64) for r in got}
    return Filters.build(languages, [members.get(i, np.zeros(0, dtype=np.int64)) for i in range(len(languages))])


def _decider(shared, least: float):
    def run(batches):
        filters = shared.value
        names = np.array([*filters.languages, UNKNOWN])
        for b in batches:
            for i, k in chunks(b.column(1)):
                rows = b.slice(i, k)
                n, hits = filters.count(rows.column(1))
                if len(filters.languages):
                    best = hits.argmax(axis=1)
                    share = hits[np.arange(k), best] / np.maximum(n, 1)
                else:
                    best, share = np.zeros(k, dtype=np.int64), np.zeros(k)
                best = np.where((share >= least) & (n > 0), best, len(filters.languages))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(np.round(share, 6)), pa.array(n.astype(np.int64))], names=["doc_id", "language", "share", "n_grams"])

    return run


def identify(docs: DataFrame, filters: Filters, least: float = 0.1) -> DataFrame:
    """(doc_id, language, share, n_grams) for every row; share: the part of its n-grams that the language contains.

    Ties go to the language that is first by name. The language is "und" where
    the share is below `least`, for null and empty texts and for texts without
    letters or digits. Whole texts count. Rows with null or repeated ids are
    judged each for itself; other columns may have any name. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(filters)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(_decider(shared, least)), "doc_id long, language string, share double, n_grams long")
