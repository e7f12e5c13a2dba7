"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import lean
from quillon.session import Scratch, ship

EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node that it is connected to) with the components of edges (u, v): one fewer than nodes in each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    """A forest in place of each EDGES edges of a partition, and of those of the forests before while they are few."""
    held_u, held_v, n = [], [], 0
    for b in batches:
        for i in range(0, b.num_rows, EDGES):
            part = b.slice(i, EDGES)
            held_u.append(part.column(0).to_numpy())
            held_v.append(part.column(1).to_numpy())
            n += part.num_rows
            if n >= EDGES:
                u, v = forest(np.concatenate(held_u), np.concatenate(held_v))
                held_u, held_v, n = [u], [v], len(u)
                if n >= EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    held_u, held_v, n = [], [], 0
    if n:
        u, v = forest(np.concatenate(held_u), np.concatenate(held_v))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the component's least node.

    Partitions first replace their edges by forests, before and after the first
    shuffle, so that the rounds carry nodes and not links. Each round is a few
    equi-joins on node ids and is written to the shared folder, so lineage stays
    one round long. Edges with a null end and loops count for nothing.
    """
    ship(scratch.spark)
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = e.mapInArrow(lean(_contract), "u long, v long").distinct().mapInArrow(lean(_contract), "u long, v long").distinct()
    e = scratch.save(e)
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = scratch.save(small)
        scratch.drop(e)
        e = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
