"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed slots, so a question asked again with
other figures or people keeps its template. Two streams of words are matched:
the *template* stream, in which every number is a NUMBER slot, every
capitalised word a NAME slot and every unit behind a number a UNIT slot, and
the *literal* stream, in which only numbers are slots and case is folded, so
that a passage whose case was changed is found as well. A number with its
separators and decimals is one slot, as is a run of capitalised words that no
punctuation parts, and a unit glued to its number is a slot of its own, so that
the number of slots doesn't depend on what fills them.

Windows of `width` words are hashed. A bitmap tells which
windows of the documents may be in the benchmark; those few are hash-joined
with the benchmark's windows. Windows of one document and one item that lie at
the same distance are one line, and lines at nearby distances one chain, as
words put in or left out move what follows. The slots of a line or chain must
be filled consistently (one value in the document for each value in the item,
and back), and it must cover enough of the item, or a long enough passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._bitmap import has, sized
from quillon.llm._text import _BYTE_LOWER, U64, Words, chunks, lean, ranges, span_hash
from quillon.session import Scratch, ship

NUMBER, NAME, UNIT = (U64(0x51A7000000000001 + i) for i in range(3))
UNITS = "km m cm mm mi mile miles meter meters metre metres kilometers kilometres foot feet ft inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz gram grams kilogram kilograms ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit watt watts volt volts"

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in ".,"]] = True
_PARTS = np.zeros(256, dtype=bool)
_PARTS[[ord(c) for c in '.,;:!?()[]{}"\n']] = True


def _unit_hashes() -> np.ndarray:
    return np.sort(Words(pa.array(UNITS.split())).hash)


_UNIT_HASHES = _unit_hashes()


class _Stream:
    """A stream's words: what stands for each, the kind of slot it is (0 is none, 1 to 3 number, name, unit), what fills it, and each text's range of words."""

    def __init__(self, values: np.ndarray, kind: np.ndarray, fill: np.ndarray, bounds: np.ndarray) -> None:
        self.values, self.kind, self.fill, self.bounds, self.counts = values, kind, fill, bounds, np.diff(bounds)


class Canonical:
    """The two streams of some texts, literal and template."""

    def __init__(self, column: pa.Array) -> None:
        w = Words(column)
        raw = w.raw
        starts, ends, owner = _numbers(raw, w.starts, w.ends, w.owner())
        hashes = span_hash(_BYTE_LOWER[raw], starts, ends)
        bounds = np.searchsorted(owner, np.arange(len(w.counts) + 1))
        first = raw[starts] if len(starts) else np.zeros(0, dtype=np.uint8)
        number = _DIGIT[first]
        nonascii = (first == 0xC3) & (raw[np.minimum(starts + 1, max(len(raw) - 1, 0))] < 0x9F) if len(first) else number
        name = _UPPER[first] | nonascii
        unit = np.zeros(len(first), dtype=bool)
        behind = np.flatnonzero(number) + 1
        behind = behind[behind < len(first)]
        behind = behind[owner[behind] == owner[behind - 1]]
        unit[behind] = np.isin(hashes[behind], _UNIT_HASHES) & ~number[behind]
        literal = np.where(unit, 3, np.where(number, 1, 0)).astype(np.uint8)
        template = np.where(literal > 0, literal, np.where(name, 2, 0)).astype(np.uint8)
        parted = np.concatenate(([0], np.cumsum(_PARTS[raw])))
        # a run of names is one slot, filled by its last word
        inner = np.zeros(len(first), dtype=bool)
        inner[:-1] = (template[:-1] == 2) & (template[1:] == 2) & (owner[:-1] == owner[1:]) & (parted[starts[1:]] == parted[ends[:-1]])
        keep = np.flatnonzero(~inner)
        slots = np.array([0, NUMBER, NAME, UNIT], dtype=U64)
        self.literal = _Stream(np.where(literal > 0, slots[literal], hashes), literal, hashes, bounds)
        self.template = _Stream(np.where(template > 0, slots[template], hashes)[keep], template[keep], hashes[keep], np.searchsorted(owner[keep], np.arange(len(w.counts) + 1)))
        self.literal_kind, self.template_kind = self.literal.kind, self.template.kind

    def stream(self, stream: int) -> _Stream:
        return self.template if stream else self.literal

    def windows(self, width: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of `width` words that have three words or more that are no slots."""
        x = self.stream(stream)
        starts = ranges(x.bounds[:-1], np.maximum(x.counts - width + 1, 0))
        plain = np.concatenate(([0], np.cumsum(x.kind == 0)))
        starts = starts[plain[starts + width] - plain[starts] >= min(3, width)]
        return starts, span_hash(x.values, starts, starts + width) ^ U64(width * 2 + stream)


def _numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, owner) of the words with whole numbers as one word each, and units glued to one as the next."""
    other = np.append(np.flatnonzero(~_DIGIT[raw]), len(raw))
    digits = np.flatnonzero(_DIGIT[raw[starts]]) if len(starts) else np.zeros(0, dtype=np.int64)
    stop = np.minimum(other[np.searchsorted(other, starts[digits])], ends[digits])
    mixed = stop < ends[digits]
    glued = np.flatnonzero(mixed)
    glued = glued[np.isin(span_hash(_BYTE_LOWER[raw], stop[glued], ends[digits[glued]]), _UNIT_HASHES)]
    at, cut = digits[glued], stop[glued]
    whole = np.zeros(len(starts), dtype=bool)
    whole[digits[~mixed]] = True
    starts, ends, owner, whole = np.insert(starts, at + 1, cut), np.insert(ends, at, cut), np.insert(owner, at, owner[at]), np.insert(whole, at, False)
    if len(starts) < 2:
        return starts, ends, owner
    joined = whole[:-1] & _DIGIT[raw[starts[1:]]] & (starts[1:] - ends[:-1] == 1) & _POINT[raw[ends[:-1].clip(max=len(raw) - 1)]] & (owner[1:] == owner[:-1])
    return starts[np.concatenate(([True], ~joined))], ends[np.concatenate((~joined, [True]))], owner[np.concatenate(([True], ~joined))]


def _rows_of(c: Canonical, ids, starts, hashes, width: int, stream: int) -> pa.RecordBatch:
    """One row for each window: its place, its hash and what fills its slots."""
    w = c.stream(stream)
    kind = w.kind
    owner = np.searchsorted(w.bounds, starts, side="right") - 1
    filled = [w.fill[s : s + width][kind[s : s + width] > 0].view(np.int64) for s in starts]
    cut = np.concatenate(([0], np.cumsum([len(x) for x in filled]))).astype(np.int32)
    slots = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*filled, np.zeros(0, dtype=np.int64)])))
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.view(np.int64)), ids.take(pa.array(owner)), pa.array((starts - w.bounds[owner]).astype(np.int32)), pa.array(w.counts[owner].astype(np.int32)), pa.array(np.full(len(starts), stream, dtype=np.int32)), pa.array(np.full(len(starts), width, dtype=np.int32)), slots],
        names=["h", "id", "at", "words", "stream", "width", "slots"],
    )


_WINDOWS = "h long, id long, at int, words int, stream int, width int, slots array<long>"


def _widths(counts: np.ndarray, width: int) -> np.ndarray:
    """Words in the windows of each item: of one too short to keep a whole window beside any changed word, less than half of its own."""
    short = np.minimum(np.maximum((counts - 1) // 2, min(width, 4)), width)
    return np.where(counts <= width, counts, short)


def _item_windows(width: int):
    def run(batches):
        for b in batches:
            for i, k in chunks(b.column(1)):
                rows = b.slice(i, k)
                c = Canonical(rows.column(1))
                ids = rows.column(0)
                for stream in (0, 1):
                    x = c.stream(stream)
                    sizes = _widths(x.counts, width)
                    for size in np.unique(sizes).tolist():
                        if size < 3:
                            continue
                        s, h = c.windows(size, stream)
                        fit = sizes[np.searchsorted(x.bounds, s, side="right") - 1] == size
                        for j in range(0, int(fit.sum()), 1 << 15):
                            yield _rows_of(c, ids, s[fit][j : j + (1 << 15)], h[fit][j : j + (1 << 15)], size, stream)

    return run


def _doc_windows(widths: list[int], shared):
    def run(batches):
        bits = shared.value
        for b in batches:
            for i, k in chunks(b.column(1)):
                rows = b.slice(i, k)
                c = Canonical(rows.column(1))
                for width in widths:
                    for stream in (0, 1):
                        s, h = c.windows(width, stream)
                        hit = has(bits, h.view(np.int64))
                        s, h = s[hit], h[hit]
                        for j in range(0, len(s), 1 << 15):
                            yield _rows_of(c, rows.column(0), s[j : j + (1 << 15)], h[j : j + (1 << 15)], width, stream)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, consistency: float = 0.75, passage: int = 20) -> DataFrame:
    """(doc_id, item_id, coverage, consistency): documents that ask a benchmark item, perhaps with other numbers, names or units.

    coverage is the share of the item's windows of `width` words found in the
    document by one line or chain, or, if that is more, the share of its words
    that are in these windows, both less the width - 1 that the first window
    has; a chain's neighbouring lines are `width` words or half of the item
    apart at most. consistency is the number of distinct values in
    the item's slots, or in the document's if that is less, over the number
    of distinct pairs of both, 1 where there is no slot. A pair is in the
    result if a line or chain in either stream reaches both thresholds, or a
    line the second one with `passage` words that follow one another, whatever
    share of the item they are; with the best coverage, then consistency.

    An item of `width` words or fewer is one window of all its words, and one of
    up to twice as many has windows of less than half of its words; items
    of fewer than three words, null and empty ones match nothing, as do null
    and empty documents. Windows with fewer than three words that are no slots
    count in neither table. Rows that repeat an item_id, or a doc_id, each
    match for themselves and count as one in the result; rows without an id
    take part in nothing. Other columns may have any name. Empty tables give
    an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    items = benchmark.selectExpr("cast(item_id as long) id", "cast(text as string) text").where("id is not null and text is not null").distinct()
    windows = scratch.save(items.mapInArrow(_item_windows(width), _WINDOWS))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    shared = spark.sparkContext.broadcast(sized(windows, "h", windows.count()))
    rows = docs.selectExpr("cast(doc_id as long) id", "cast(text as string) text").where("id is not null and text is not null")
    found = rows.mapInArrow(lean(_doc_windows(widths, shared)), _WINDOWS)
    of_item = windows.groupBy("id", "stream", "words").agg(F.count_distinct("at").alias("n"))
    d = found.select("h", "stream", "width", F.col("id").alias("doc_id"), F.col("words").alias("d_words"), F.col("at").alias("d_at"), F.col("slots").alias("d_slots"))
    i = windows.select("h", "stream", "width", F.col("id").alias("item_id"), "words", F.col("at").alias("i_at"), F.col("slots").alias("i_slots"))
    hits = d.join(i, ["h", "stream", "width"]).where("size(d_slots) = size(i_slots)")
    pair = ["doc_id", "d_words", "item_id", "words", "stream", "width"]
    lines = scratch.save(hits.groupBy(*pair, (F.col("d_at") - F.col("i_at")).alias("off")).agg(
        F.array_sort(F.collect_set("i_at")).alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("i_slots", "d_slots")))).alias("fills")
    ))
    order = f"over (partition by {', '.join(pair)} order by off)"
    steps = lines.withColumn("step", F.expr(f"if(off - lag(off) {order} > greatest({width}, words div 2), 1, 0)")).withColumn("chain", F.expr(f"sum(step) {order}"))
    chains = steps.groupBy(*pair, "chain").agg(F.count("*").alias("lines"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("fills"))).alias("fills")).where("lines > 1")
    run = F.expr("aggregate(at, named_struct('a', -1, 'e', -1, 'b', 0), (s, x) -> named_struct('a', if(x <= s.e, s.a, x), 'e', x + width, 'b', greatest(s.b, x + width - if(x <= s.e, s.a, x))), s -> s.b)")
    found_in = lines.select(*pair, "at", "fills", run.alias("run")).union(chains.select(*pair, "at", "fills", F.lit(0)))
    ratio = F.expr("if(size(fills) = 0, 1.0D, least(size(array_distinct(transform(fills, x -> x.i_slots))), size(array_distinct(transform(fills, x -> x.d_slots)))) / cast(size(fills) as double))")
    covered = F.expr("(size(array_distinct(flatten(transform(at, x -> sequence(x, x + width - 1))))) - width + 1) / cast(words - width + 1 as double)")
    share = F.greatest(F.size("at") / F.col("n"), covered)
    scored = found_in.join(of_item.withColumnRenamed("id", "item_id"), ["item_id", "stream", "words"]).select("doc_id", "item_id", F.round(share, 6).alias("coverage"), F.round(ratio, 6).alias("consistency"), "run")
    best = F.max(F.struct("coverage", "consistency")).alias("best")
    return scored.where(((F.col("coverage") >= coverage) | (F.col("run") >= passage)) & (F.col("consistency") >= consistency)).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5) -> DataFrame:
    """The rows of documents that hold no benchmark item, with all columns as they were.

    Rows without an id or text stay, as do empty texts. Rows that repeat an id
    go together if one of their texts holds an item. Texts of any length are
    read whole. Columns may have any name. Empty documents give an empty
    result, an empty benchmark leaves all rows.
    """
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(contamination(docs, benchmark, width, coverage).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
