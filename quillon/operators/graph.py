"""Links between nodes.

Edges are (seq, src, dst), one row for each edge that was added; `adjacency`
has (id, nb, ord) with a row at either end, ord giving the order in which a
node's list grew. Parallel edges and loops are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine_to
from quillon.session import Scratch, ship

#: Rows of a block at least, blocks of a table while none takes more than WIDEST bytes, and rows and columns compared at once.
BLOCK, SIDE, WIDEST = 2048, 16, 32 << 20
STRIP = 512, 4096
RANKS = 8
PACKED = "block int, size int, ids binary, vectors binary"


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows padded with 0, which gives the product over the shorter and the norms of the full vectors; NaN is an error."""
    sizes = pc.list_value_length(column).to_numpy()
    width = int(max(sizes.max(), 1)) if len(sizes) else 1
    if len(sizes) and (sizes == width).all():
        out = pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        for i, r in enumerate(column.to_pylist()):
            out[i, : len(r)] = r
    if np.isnan(out).any():
        raise ValueError("NaN in an embedding")
    return out


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The rows of a block as two byte strings, in the precision of the table."""
    table = table.sort_by("id")
    ids, size = table.column("id").to_numpy(), 4 if table.schema.field("embedding").type.value_type == pa.float32() else 8
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([size], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([_vectors(table.column("embedding")).astype(f"<f{size}").tobytes()], pa.binary())})


def _unpack(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(table.column("ids")[i].as_buffer(), dtype="<i8")
    return ids, np.frombuffer(table.column("vectors")[i].as_buffer(), dtype=f"<f{table.column('size')[i].as_py()}").reshape(len(ids), -1)


def _blocks(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(blocks of nodes, packed in a row each; how many), numbered by a hash, so that any ids will do.

    There are SIDE blocks, fewer of a small table, and more only where blocks
    would be too wide: what a pass over all pairs moves is SIDE times the table.
    """
    facts = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("d")).first()
    many = max(1, min(SIDE, -(-facts["n"] // BLOCK)), -(-facts["n"] * facts["d"] * 8 // WIDEST))
    numbered = nodes.select("id", "embedding").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
    return numbered.groupBy("block").applyInArrow(_pack, PACKED), many


def _block_pairs(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(i, j, side, size, ids, vectors): two packed blocks for each pair, one where they are the same; with `of` its blocks with all of nodes."""
    every, many = _blocks(nodes)
    spread = lambda df, n: df.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if of is None:
        out, pairs = spread(every, many).select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.col("block").alias("side"), "size", "ids", "vectors"), many * (many + 1) // 2
    else:
        own, few = _blocks(of)
        left = spread(own, many).select(F.col("block").alias("i"), F.col("o").alias("j"), F.lit(-1).alias("side"), "size", "ids", "vectors")
        out, pairs = left.union(spread(every, few).select(F.col("o").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "size", "ids", "vectors")), few * many
    return out.repartition(pairs if pairs < 2 else max(pairs, min(2 * pairs, 200)), "i", "j")


class _Side:
    """A block's ids, ascending, its columns and squared norms in double precision, and its unit vectors in single."""

    def __init__(self, table: pa.Table, i: int, width: int = 0) -> None:
        self.ids, raw = _unpack(table, i)
        self.columns = np.zeros((max(width, raw.shape[1]), len(raw)))
        self.columns[: raw.shape[1]] = raw.T
        self.square = np.zeros(len(raw))
        for c in self.columns:  # one after the other, as the SQL adds them
            self.square += c * c
        size = np.sqrt(self.square)
        self.unit = np.ascontiguousarray((self.columns / np.where(size == 0, 1, size)).T.astype(np.float32))

    def __len__(self) -> int:
        return len(self.ids)

    def cosines(self, r: np.ndarray, other: _Side, c: np.ndarray) -> np.ndarray:
        """Of pairs of rows; each is summed in the order of the elements, so that equal vectors have equal cosines and ties are those of the SQL."""
        out = np.zeros(len(r))
        for x, y in zip(self.columns, other.columns):
            out += x[r] * y[c]
        n = np.sqrt(self.square[r] * other.square[c])
        return np.where(n == 0, 0.0, np.clip(out / np.where(n == 0, 1, n), -1.0, 1.0))


def _sides(table: pa.Table) -> tuple[_Side, _Side, bool]:
    """Both blocks of a pair, and whether they are the same."""
    table = table.sort_by("side")
    width = max(_unpack(table, i)[1].shape[1] for i in range(table.num_rows))
    x = _Side(table, 0, width)
    return (x, x, True) if table.num_rows == 1 else (x, _Side(table, 1, width), False)


def _margin(width: int) -> float:
    """More than a cosine in single precision can be off."""
    return (width + 8) * 2.0**-23


def _best_before(x: _Side, y: _Side, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(a, b, sim)]: for each of x the k most similar of y that aren't behind it and reach `least`; ties go to lower ids.

    Products in single precision leave out what can't be among the k; the
    cosines of the others are computed in double precision, row by row.
    """
    margin, out = _margin(len(x.columns)), []
    for r0 in range(0, len(x), STRIP[0]):
        mine = x.ids[r0 : r0 + STRIP[0]]
        bound = np.full(len(mine), float(least))
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for c0 in range(0, len(y), STRIP[1]):
            theirs = y.ids[c0 : c0 + STRIP[1]]
            if theirs[0] > mine[-1]:
                break
            near = x.unit[r0 : r0 + len(mine)] @ y.unit[c0 : c0 + len(theirs)].T
            hit = near >= (bound - margin).astype(np.float32)[:, None]
            if theirs[-1] > mine[0]:
                hit &= theirs[None, :] <= mine[:, None]
            if len(theirs) > k and np.count_nonzero(hit) > 64 * len(mine):
                near = np.where(hit, near, -np.inf)
                hit &= near >= np.partition(near, -k, axis=1)[:, -k, None] - 2 * margin
            parts = [held]
            for r, c, sim in _exact(hit, x, r0, y, c0):
                good = sim >= bound[r - r0]
                parts.append((r[good], c[good], sim[good]))
            if not any(len(p[0]) for p in parts[1:]):
                continue
            r, c, sim = (np.concatenate(z) for z in zip(*parts))
            order = np.lexsort((c, -sim, r))
            r, c, sim = r[order], c[order], sim[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            full = place == k - 1
            bound[r[full] - r0] = sim[full]
            held = r[place < k], c[place < k], sim[place < k]
        out.append((x.ids[held[0]], y.ids[held[1]], held[2]))
    return out


def _exact(hit: np.ndarray, x: _Side, r0: int, y: _Side, c0: int, most: int = 1 << 18):
    """(rows, columns, cosines) of the pairs that are marked, some at a time."""
    flat = np.flatnonzero(hit)
    for i in range(0, len(flat), most):
        p, q = np.divmod(flat[i : i + most], hit.shape[1])
        p, q = p + r0, q + c0
        yield p, q, x.cosines(p, y, q)


def _rows(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])


def _block_top(k: int, least: float, both: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = []
        if both or table.num_rows == 2:
            x, y, same = _sides(table)
            out = _best_before(x, y, k, least) + ([] if same or not both else _best_before(y, x, k, least))
        return pa.Table.from_batches([_rows(*o) for o in out], _rows(*[np.zeros(0)] * 3).schema)

    return run


def auto_link(nodes: DataFrame, threshold: float = 0.6, k: int = 5, since: int | None = None) -> DataFrame:
    """(src, dst, sim, rank): for each node the nearest of those before it, itself counted among the first k + 1 and then left out.

    Exact: nodes are compared in blocks, and each block pair sends on k + 1
    rows a node at most. With `since`, only nodes with that id or a later one
    get links, and only their blocks are compared with all. Ids may be any
    longs. NaN in an embedding is an error.
    """
    ship(nodes.sparkSession)
    nodes = nodes.select("id", "embedding")
    pairs = _block_pairs(nodes, None if since is None else nodes.where(F.col("id") >= since))
    found = pairs.groupBy("i", "j").applyInArrow(_block_top(k + 1, threshold, since is None), "a long, b long, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("rank", rank).where((F.col("rank") <= k + 1) & (F.col("a") != F.col("b")) & (F.col("sim") >= threshold)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim", "rank")


def lsh_tables(threshold: float, bits: int, recall: float) -> int:
    """How many tables of `bits` hyperplanes find two vectors with a cosine of `threshold` in one bucket with probability `recall`."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if together >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-together))


def _buckets(planes: np.ndarray, tables: int, bits: int):
    def run(batches):
        for b in batches:
            v = _vectors(pa.chunked_array([b.column("embedding")]))
            width = min(v.shape[1], len(planes))
            up = ((v[:, :width] @ planes[:width]) > 0).reshape(len(v), tables, bits)
            code = (up * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            row = np.repeat(np.arange(len(v)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), pa.array(code.ravel()), b.column("id").take(pa.array(row)), b.column("embedding").take(pa.array(row))], names=["t", "c", "id", "embedding"])

    return run


def _pack_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = _pack(key[2:], table)
    for i, (name, kind) in enumerate((("t", pa.int32()), ("c", pa.int64()))):
        out = out.append_column(name, pa.array([key[i].as_py()], kind))
    return out.append_column("blocks", table.column("blocks").slice(0, 1)).select(["t", "c", "blocks", "block", "size", "ids", "vectors"])


def near_links(nodes: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.95, most_tables: int = 128) -> DataFrame:
    """auto_link for tables too large for it: (src, dst, sim, rank) of the pairs that share a bucket.

    Buckets are those of random hyperplanes, as many that a bucket has a few
    hundred nodes, in as many tables that a pair at the threshold is found with
    probability `recall`; similarities are exact. Cost grows as n * log(n), if
    vectors spread. A low threshold needs more than `most_tables` tables and is
    an error; auto_link finds such links exactly. NaN in an embedding is an error.
    """
    ship(nodes.sparkSession)
    scratch = Scratch(nodes.sparkSession)
    nodes = nodes.select("id", "embedding")
    facts = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    bits = max(1, min(40, math.ceil(math.log2(max(facts["n"], 1) / 256 + 1))))
    tables = lsh_tables(threshold, bits, recall)
    if tables > most_tables:
        raise ValueError(f"{tables} tables for a threshold of {threshold}; the limit is {most_tables}")
    planes = np.random.default_rng(7).standard_normal((facts["d"], tables * bits))
    placed = scratch.save(nodes.mapInArrow(_buckets(planes, tables, bits), f"t int, c long, id long, embedding {nodes.schema['embedding'].dataType.simpleString()}"))
    sizes = placed.groupBy("t", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("many")).where("many > 1").drop("many")
    numbered = placed.join(sizes, ["t", "c"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    packed = scratch.save(numbered.groupBy("t", "c", "block").applyInArrow(_pack_bucket, f"t int, c long, blocks int, {PACKED}"))
    pairs = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "c", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.col("block").alias("side"), "size", "ids", "vectors")
    found = pairs.groupBy("t", "c", "i", "j").applyInArrow(_block_top(k + 1, threshold, True), "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("rank", rank).where((F.col("rank") <= k + 1) & (F.col("a") != F.col("b")) & (F.col("sim") >= threshold)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim", "rank")


def as_edges(links: DataFrame) -> DataFrame:
    """Edges in the order in which inserting the nodes one by one would have added them; seq has gaps."""
    return links.select((F.col("src") * RANKS + F.col("rank")).alias("seq"), "src", "dst")


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """The valid rows of new (n, src, dst), numbered behind edges; an unknown end drops the row."""
    ids = nodes.select("id")
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = edges.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return known.crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("n")).alias("seq"), "src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("src").alias("id"), F.col("dst").alias("nb"), (F.col("seq") * 2).alias("ord"))
    return one.union(edges.select(F.col("dst").alias("id"), F.col("src").alias("nb"), (F.col("seq") * 2 + 1).alias("ord")))


def neighbours(adj: DataFrame) -> DataFrame:
    """(id, neighbours): lists in the order in which they grew."""
    return adj.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "nb"))), lambda x: x["nb"]).alias("neighbours"))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("id").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).distinct()


def expand(seeds: DataFrame, adj: DataFrame, hops: int = 2) -> DataFrame:
    """(id): the seeds and all nodes at most `hops` links away."""
    step, front = adj.select("id", "nb"), seeds.select("id")
    reached = [front]
    for i in range(hops):
        front = front.join(step, "id").select(F.col("nb").alias("id"))
        if i + 1 < hops:
            front = front.distinct()
        reached.append(front)
    return reduce(DataFrame.union, reached).distinct()


def knn(nodes: DataFrame, query: list[float], k: int) -> DataFrame:
    """(rank, id, score): the k nearest to a query; equal scores by id."""
    top = nodes.select("id", cosine_to(query, F.col("embedding")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")  # k rows


def similar_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b that reach the threshold. Ids may be any longs; NaN in an embedding is an error."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, same = _sides(pa.Table.from_batches(batches))
        least = np.float32(threshold - _margin(len(x.columns)))
        for r0 in range(0, len(x), STRIP[0]):
            for c0 in range(0, min(len(y), r0 + STRIP[0]) if same else len(y), STRIP[1]):
                hit = x.unit[r0 : r0 + STRIP[0]] @ y.unit[c0 : c0 + STRIP[1]].T >= least
                for r, c, sim in _exact(hit, x, r0, y, c0):
                    a, b = x.ids[r], y.ids[c]
                    good = (sim >= threshold) & ((b < a) if same else (b != a))
                    yield _rows(np.minimum(a, b)[good], np.maximum(a, b)[good], sim[good])

    return _block_pairs(nodes).groupBy("i", "j").applyInArrow(run, "a long, b long, sim double")


def heap_layout(nodes: DataFrame) -> DataFrame:
    """(id, data_len, data_offset): where each content would lie if all were laid end to end, by ranges of ids so that no task sees all."""
    rows = nodes.select("id", F.octet_length("content").cast("long").alias("data_len"))
    placed = Scratch(nodes.sparkSession).save(rows.repartitionByRange("id").withColumn("run", F.spark_partition_id()))
    totals = placed.groupBy("run").agg(F.sum("data_len").alias("all"))
    before = totals.select("run", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range
    inside = F.coalesce(F.sum("data_len").over(Window.partitionBy("run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(before), "run").select("id", "data_len", (F.col("base") + inside).alias("data_offset"))
