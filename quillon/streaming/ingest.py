"""Nodes that arrive as a stream, linked batch by batch, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import auto_link

NODES = "id long, content string, embedding array<float>, significance short"
LINKS = "src long, dst long, sim double, rank int"


def stream_nodes(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(NODES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, threshold: float = 0.6, available_now: bool = True):
    """Starts a query that appends to target/nodes and target/links.

    A batch links its nodes to all that came before and to each other. Each
    batch has a folder of its own that is overwritten if it is run again, so
    a restart neither loses nor repeats rows. Ids must rise from batch to batch;
    NaN in an embedding ends the query with an error.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        first = rows.agg(F.min("id")).first()[0]
        if first is None:
            return
        rows.write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        every = spark.read.schema(NODES).parquet(f"{target}/nodes").select("id", "embedding")
        auto_link(every, threshold, since=first).write.mode("overwrite").parquet(f"{target}/links/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes(before: DataFrame, after: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """(type, data): an event for each row of after that before lacks, as JSON."""
    fresh = after.join(before.select(*keys), keys, "left_anti")
    return fresh.select(F.lit(kind).alias("type"), F.to_json(F.struct(*after.columns)).alias("data"))


def events(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(type, data): what changed between two states of {nodes, edges, clusters}, as JSON.

    node_added for each new id; edge_added for each new link, whichever way it
    points; cluster_updated for each root cluster that is new or has another
    colour, size or significance; and one refresh without data if any cluster
    is gone.
    """
    old, new = before, after
    link = lambda e: e.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    out = changes(old["nodes"], new["nodes"], "node_added", ["id"])
    out = out.union(changes(link(old["edges"]), link(new["edges"]), "edge_added", ["source", "target"]))
    out = out.union(changes(old["clusters"], new["clusters"], "cluster_updated", new["clusters"].columns))
    gone = old["clusters"].select("id").join(new["clusters"].select("id"), "id", "left_anti").limit(1)
    return out.union(gone.select(F.lit("refresh").alias("type"), F.lit(None).cast("string").alias("data")))


def publish(stream: DataFrame, state, sink, checkpoint: str, available_now: bool = True):
    """Calls sink(events of the batch) after each batch; state() gives {nodes, edges, clusters} as they are then.

    The state before the first batch is empty, so its events are the snapshot.
    sink gets a DataFrame (type, data) and may write it or send it on.
    """
    held: dict[str, DataFrame] = {}

    def batch(rows: DataFrame, number: int) -> None:
        now = state(rows, number)
        sink(events(held or {n: df.limit(0) for n, df in now.items()}, now), number)
        held.update(now)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


NODE = "id long, label string, content string, significance int, cluster_id long, color string"
CLUSTER = "id long, color string, node_count long, significance double"
DATA = f"struct<nodes:array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>,edges:array<struct<source:long,target:long>>,clusters:map<string,struct<{CLUSTER.replace(' ', ':').replace(',:', ',')}>>>"


def fold_events(events: DataFrame) -> dict[str, DataFrame]:
    """{nodes, edges, clusters} as a viewer has them after events (seq, type, data), in the order of seq.

    A graph_snapshot replaces all that was before; those of one seq are parts
    of one snapshot. node_added and edge_added add what isn't there yet (of a
    node that is, the first stays; a link counts whichever way it points);
    cluster_updated changes a cluster and the colour of its nodes. Other types
    change nothing.
    """
    last = events.where("type = 'graph_snapshot'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("since"))  # one row
    rows = events.crossJoin(F.broadcast(last)).where("seq >= since").select("seq", "type", "data")
    of = lambda kind, schema: rows.where(F.col("type") == kind).select("seq", F.from_json("data", schema).alias("x"))
    snapshot = of("graph_snapshot", DATA)
    nodes = snapshot.select("seq", F.explode("x.nodes").alias("x")).union(of("node_added", NODE)).select("seq", "x.*").groupBy("id").agg(F.min_by(F.struct("label", "content", "significance", "cluster_id", "color"), "seq").alias("x"), F.min("seq").alias("since")).select("id", "x.*", "since")
    edges = snapshot.select(F.explode("x.edges").alias("x")).union(of("edge_added", "source long, target long").select("x"))
    edges = edges.select(F.least("x.source", "x.target").alias("source"), F.greatest("x.source", "x.target").alias("target")).distinct()
    updates = of("cluster_updated", CLUSTER).select("seq", "x.*")
    clusters = snapshot.select("seq", F.explode(F.map_values("x.clusters")).alias("x")).select("seq", "x.*").union(updates)
    clusters = clusters.groupBy("id").agg(F.max_by(F.struct("color", "node_count", "significance"), "seq").alias("x")).select("id", "x.*")
    recolour = updates.groupBy(F.col("id").alias("cluster_id")).agg(F.max_by("color", "seq").alias("new"), F.max("seq").alias("at"))  # a row per cluster
    nodes = nodes.join(F.broadcast(recolour), "cluster_id", "left").select("id", "label", "content", "significance", "cluster_id", F.when(F.col("at") > F.col("since"), F.col("new")).otherwise(F.col("color")).alias("color"))
    return {"nodes": nodes, "edges": edges, "clusters": clusters}
