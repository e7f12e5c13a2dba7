"""The stateful store: a graph of immutable tables with the methods of a database."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scores import life_score
from quillon.operators import clustering, export, graph, ranking
from quillon.session import Scratch, delete, exists

NODES = "id long, content string, embedding array<float>, significance short, access_count long, last_access_ts long"
EDGES = "seq long, src long, dst long"
CLUSTERS = "cluster_id long, parent_id long, root_id long, depth int, anchor_id long, centroid array<double>, significance double, size long"
MEMBERS = "cluster_id long, root_id long, pos int, node_id long"
ACCESSES = "node_id long, ts long"
TABLES = {"nodes": NODES, "edges": EDGES, "clusters": CLUSTERS, "members": MEMBERS}


def now() -> int:
    """Seconds since 1970, what `as_of` is if it isn't given."""
    return int(time.time())


def _positions(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(rows with an id from 0 on, in the order of pos; how many): places within ranges of pos, and how many rows the ranges before hold."""
    placed = scratch.save(rows.repartitionByRange("pos").withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row per partition
    return placed.join(F.broadcast(before), "part").withColumn("id", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1).drop("part", "base"), placed.count()


def save_snapshot(spark: SparkSession, path: str, tables: dict[str, DataFrame], config: dict) -> None:
    """Writes a new version beside the others, then points to it; readers see the old one or the new one."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, int(time.time() * 1000), json.dumps(config))], "version string, saved long, config string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    at = spark.read.schema("version string, saved long, config string").parquet(f"{path}/versions").orderBy(F.desc("saved"), "version").first()
    config = json.loads(at["config"])
    return {n: spark.read.schema(s).parquet(f"{path}/{at['version']}/{n}") for n, s in TABLES.items() if n in config["tables"]}, config


class Parts:
    """A table of appended parts in the shared folder; they are written together when there are too many."""

    MOST = 32

    def __init__(self, spark: SparkSession, scratch: Scratch, schema: str, start: DataFrame | None = None) -> None:
        self.spark, self.scratch, self.schema = spark, scratch, schema
        self.parts: list[DataFrame] = [] if start is None else [start]

    @property
    def table(self) -> DataFrame:
        paths = [p for x in self.parts if (p := getattr(x, "_quillon_path", None))]
        out = [x for x in self.parts if not hasattr(x, "_quillon_path")]
        if paths:
            out.append(self.spark.read.schema(self.schema).parquet(*paths))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        self.parts.append(self.scratch.save(rows))
        if len(self.parts) > self.MOST:
            self.replace(self.table)

    def replace(self, rows: DataFrame) -> None:
        old, self.parts = self.parts, [self.scratch.save(rows)]
        self.scratch.drop(*(x for x in old if hasattr(x, "_quillon_path")))


class GraphStore:
    """Nodes with text, vector, significance and access metrics, their links and clusters.

    Writes append to tables that are folded when they are read; tables handed
    out are good until the next write. Reads that
    count as accesses go to a log of LOG entries at most in memory, then to a
    table. Vectors with null or NaN are refused when they are added.
    """

    LOG = 10_000

    def __init__(self, spark: SparkSession, db_path: str = "./graph.db", max_capacity: int | None = None, m: int | None = None, ef_construction: int | None = None) -> None:
        self.spark, self.path = spark, db_path
        self._scratch = Scratch(spark)
        self._url: str | None = None
        self._notify_on_save = True
        self._clusters: DataFrame | None = None
        self._members: DataFrame | None = None
        tables = load_snapshot(spark, db_path)[0] if exists(spark, f"{db_path}/versions") else {}
        self._node_parts, self._edge_parts = (Parts(spark, self._scratch, s, tables.get(n)) for n, s in (("nodes", NODES), ("edges", EDGES)))
        self._clusters, self._members = tables.get("clusters"), tables.get("members")
        self._log: list[tuple[int, int]] = []
        self._old_log = Parts(spark, self._scratch, ACCESSES)
        top = lambda df, c: -1 if (x := df.agg(F.max(c)).first()[0]) is None else x
        self._next, self._seq = top(self._nodes, "id") + 1, top(self._edges, "seq") + 1

    # state

    @property
    def _nodes(self) -> DataFrame:
        return self._node_parts.table

    @property
    def _edges(self) -> DataFrame:
        return self._edge_parts.table

    @property
    def nodes(self) -> DataFrame:
        log = self._old_log.table if self._old_log.parts else None
        if self._log:
            recent = self.spark.createDataFrame(self._log, ACCESSES)
            log = recent if log is None else log.union(recent)
        return self._nodes if log is None else ranking.fold_access(self._nodes, log)

    @property
    def edges(self) -> DataFrame:
        return self._edges

    @property
    def adjacency(self) -> DataFrame:
        return graph.adjacency(self._edges)

    def _known(self, node: int) -> bool:
        return 0 <= node < self._next

    def _touch(self, ids: Iterable[int], as_of: int | None) -> None:
        at = now() if as_of is None else as_of
        self._log += [(int(i), at) for i in ids]
        if len(self._log) > self.LOG:
            self._old_log.append(self.spark.createDataFrame(self._log, ACCESSES).coalesce(1))
            self._log = []

    # writing

    def add_nodes(self, rows: DataFrame | list[tuple[str, list[float], int]], auto_link_threshold: float | None = None, as_of: int | None = None) -> range:
        """Adds nodes (content, embedding, significance) in this order, each linked to those before it; returns their ids.

        Rows of a DataFrame are added in the order of its column `pos`, whole
        numbers without repetition, and stay on the executors.
        """
        at = now() if as_of is None else as_of
        if not isinstance(rows, DataFrame):
            if not rows:
                return range(self._next, self._next)
            rows = self.spark.createDataFrame([(i, c, [None if x is None else float(x) for x in v], s) for i, (c, v, s) in enumerate(rows)], "pos long, content string, embedding array<float>, significance short")
        number, many = _positions(rows, self._scratch)
        first = self._next
        if not many:
            return range(first, first)
        number = number.withColumn("id", F.col("id") + first)
        fine = F.when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.raise_error(F.lit("an embedding holds a null or NaN")).cast("array<float>")).otherwise(F.col("embedding").cast("array<float>"))
        new = number.select("id", F.col("content").cast("string").alias("content"), fine.alias("embedding"), F.col("significance").cast("short").alias("significance"), F.lit(0).cast("long").alias("access_count"), F.lit(at).cast("long").alias("last_access_ts"))
        try:
            self._node_parts.append(new)
        except PySparkException as e:
            if "null or NaN" in str(e):
                raise ValueError("an embedding holds a null or NaN") from e
            raise
        links = graph.auto_link(self._nodes, 0.6 if auto_link_threshold is None else auto_link_threshold, since=first)
        self._edge_parts.append(graph.as_edges(links).select((F.col("seq") - first * graph.RANKS + self._seq).alias("seq"), "src", "dst"))
        self._next += many
        self._seq += many * graph.RANKS
        return range(first, first + many)

    def add_node(self, content: str, embedding: list[float], significance: int, auto_link_threshold: float | None = None) -> int:
        return self.add_nodes([(content, embedding, significance)], auto_link_threshold)[0]

    def add_edge(self, source_id: int, target_id: int) -> None:
        """Unknown ends are ignored; parallel edges and loops are kept."""
        if self._known(source_id) and self._known(target_id):
            self._edge_parts.append(self.spark.createDataFrame([(self._seq, source_id, target_id)], EDGES).coalesce(1))
            self._seq += 1

    # reading

    def get_node(self, node_id: int, as_of: int | None = None) -> str | None:
        """The content; counts as an access."""
        if not self._known(node_id):
            return None
        self._touch([node_id], as_of)
        row = self._nodes.where(F.col("id") == node_id).select("content").first()
        return row["content"] if row else None

    def get_neighbors(self, node_id: int) -> list[int]:
        return [r["nb"] for r in self.adjacency.where(F.col("id") == node_id).orderBy("ord").collect()]

    def hybrid_search(self, query_embedding: list[float], k: int, ef_search: int | None = None, as_of: int | None = None) -> list[tuple[int, float]]:
        """The best k; they count as accesses, after they were scored."""
        at = now() if as_of is None else as_of
        rows = ranking.hybrid_search(self.nodes, self.adjacency, query_embedding, k, at, self._clusters, self._members).orderBy("rank").collect()
        self._touch([r["id"] for r in rows], at)
        return [(r["id"], r["score"]) for r in rows]

    def vacuum(self, threshold: float, as_of: int | None = None) -> list[int]:
        at = now() if as_of is None else as_of
        return [r["id"] for r in ranking.vacuum(self.nodes, threshold, at).orderBy("id").collect()]

    def calculate_life_score(self, node_id: int, as_of: int | None = None) -> float:
        at = now() if as_of is None else as_of
        row = self.nodes.where(F.col("id") == node_id).select(life_score(F.col("significance"), F.col("access_count"), F.col("last_access_ts"), at).alias("life")).first()
        return row["life"] if row else 0.0

    # clusters

    def build_clusters(self, k_clusters: int | None = None) -> None:
        clusters, members = clustering.build(self._nodes, 10 if k_clusters is None else k_clusters)
        self._clusters, self._members = self._scratch.save(clusters), self._scratch.save(members)

    def get_clusters(self) -> list[tuple[int, int, list[int], float]]:
        if self._clusters is None:
            return []
        lists = self._members.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("ids"))
        rows = self._clusters.where("parent_id is null").join(lists, "cluster_id").orderBy("cluster_id").collect()
        return [(r["cluster_id"], r["anchor_id"], list(r["ids"]), r["significance"]) for r in rows]

    def get_node_clusters(self, node_id: int) -> list[int]:
        if self._members is None:
            return []
        return [r["cluster_id"] for r in self._members.where(F.col("node_id") == node_id).select("cluster_id").orderBy("cluster_id").collect()]

    def search_in_cluster(self, cluster_id: int, query_embedding: list[float], k: int) -> list[tuple[int, float]]:
        if self._clusters is None:
            return []
        rows = clustering.search_in_cluster(self._clusters, self._members, self._nodes, cluster_id, query_embedding, k).orderBy("rank").collect()
        return [(r["id"], r["score"]) for r in rows]

    def get_cluster_stats(self) -> tuple[int, float, float] | None:
        if self._clusters is None:
            return None
        r = clustering.statistics(self._clusters).first()
        nan = float("nan")
        return r["n_clusters"], nan if r["avg_size"] is None else r["avg_size"], nan if r["avg_significance"] is None else r["avg_significance"]

    def export_cluster_tree(self) -> str:
        if self._clusters is None:
            return "No clusters built yet"
        rows = clustering.tree_lines(self._clusters).join(self._clusters.select("cluster_id", "root_id"), "cluster_id").orderBy("cluster_id").collect()
        trees: dict[int, str] = {}
        for r in rows:
            trees[r["root_id"]] = trees.get(r["root_id"], "") + r["line"] + "\n"
        return "\n".join(trees.values())

    def get_all_graph_data(self) -> tuple[list[tuple], list[tuple[int, int]]]:
        clusters, members = (self._clusters, self._members) if self._clusters is not None else (self.spark.createDataFrame([], CLUSTERS), self.spark.createDataFrame([], MEMBERS))
        nodes = export.library_nodes(self._nodes, clusters, members).orderBy("id").collect()
        pairs = self.adjacency.orderBy("id", "ord").collect()
        return [tuple(r) for r in nodes], [(r["id"], r["nb"]) for r in pairs]

    # publishing

    def set_server_url(self, url: str | None) -> None:
        self._url = url

    def set_auto_notify(self, enabled: bool) -> None:
        self._notify_on_save = enabled

    def get_server_url(self) -> str | None:
        return self._url

    def notify(self) -> bool:
        """POSTs to the server that a new snapshot is there; False without a server, an error if it fails."""
        if not self._url:
            return False
        request = urllib.request.Request(f"{self._url.rstrip('/')}/api/notify", data=b"", method="POST")
        with urllib.request.urlopen(request, timeout=5) as answer:
            if not 200 <= answer.status < 300:
                raise RuntimeError(f"the server answered {answer.status}")
        return True

    def save(self, path: str | None = None) -> None:
        """Writes everything but the server's address; a failed notice doesn't fail the save."""
        folded = self._scratch.save(self.nodes)
        tables = {"nodes": folded, "edges": self._edges}
        if self._clusters is not None:
            tables |= {"clusters": self._clusters, "members": self._members}
        save_snapshot(self.spark, path or self.path, tables, {"tables": list(tables), "min_cluster_size": clustering.SMALLEST, "max_cluster_size": clustering.LARGEST, "max_depth": clustering.DEEPEST})
        self._scratch.drop(*(x for x in (*self._node_parts.parts, *self._old_log.parts) if hasattr(x, "_quillon_path")))
        self._node_parts.parts, self._old_log.parts, self._log = [folded], [], []
        if self._notify_on_save and self._url:
            try:
                self.notify()
            except (urllib.error.URLError, OSError, RuntimeError):
                pass

    def drop_snapshot(self) -> None:
        delete(self.spark, self.path)
