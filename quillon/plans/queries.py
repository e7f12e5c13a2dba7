"""A query for each operator over the canonical graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scores import cluster_colour
from quillon.functions.vectors import cosine_to
from quillon.operators import clustering, export, graph, ranking
from quillon.plans.oracle import ORACLE_SQL  # noqa: F401
from quillon.session import Scratch
from quillon.sources import tables as T
from quillon.sources.store import load_snapshot, save_snapshot
from quillon.streaming import ingest

K = 10


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, adjacency), the links computed once."""
    edges = T.edges(spark, d)
    return T.scored_nodes(spark, d), edges, graph.adjacency(edges)


def _seeds(spark: SparkSession, d: str) -> tuple[list[float], DataFrame]:
    q = T.query_vector(spark, d, 0)
    return q, graph.knn(T.vectors(spark, d), q, 3 * K).select("id")


def node_scan(spark, d):
    return T.nodes(spark, d).select("id", F.substring("content", 1, 30).alias("label"), F.col("significance").cast("int").alias("significance"), "access_count", "last_access_ts")


def point_lookup(spark, d):
    return T.nodes(spark, d).where("id = 7").select("id", "content")


def heap_layout(spark, d):
    return graph.heap_layout(T.nodes(spark, d))


def knn_search(spark, d):
    return _r(graph.knn(T.vectors(spark, d), T.query_vector(spark, d, 0), K), "score")


def pairwise_cosine(spark, d):
    return _r(graph.similar_pairs(T.vectors(spark, d), 0.35), "sim")


def auto_link(spark, d):
    return _r(T.links(spark, d), "sim")


def adjacency(spark, d):
    return graph.neighbours(graph.adjacency(T.edges(spark, d))).select("id", F.array_join("neighbours", ",").alias("neighbours"))


def neighbor_lookup(spark, d):
    return graph.adjacency(T.edges(spark, d)).where("id = 3").select("nb", F.row_number().over(Window.partitionBy("id").orderBy("ord")).alias("place"))


def degree(spark, d):
    return graph.degree(graph.adjacency(T.edges(spark, d)))


def undirected_edges(spark, d):
    return graph.undirected(T.edges(spark, d))


def directed_edges(spark, d):
    return graph.adjacency(T.edges(spark, d)).select(F.col("id").alias("source"), F.col("nb").alias("target"))


def expand_2hop(spark, d):
    _, _, adj = _linked(spark, d)
    return graph.expand(spark.createDataFrame([(0,), (1,), (2,)], "id long"), adj, 2)


def add_edge_validation(spark, d):
    new = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 2, 2), (3, 0, 999_999_999), (4, 5, 7)], "n long, src long, dst long")
    none = spark.createDataFrame([], "seq long, src long, dst long")
    return graph.add_edges(none, new, T.vectors(spark, d))


def life_score(spark, d):
    return _r(ranking.with_life(T.scored_nodes(spark, d), T.AS_OF).select("id", "life"), "life")


def vacuum_candidates(spark, d):
    return ranking.vacuum(T.scored_nodes(spark, d), 0.5, T.AS_OF).select("id")


def bio_score(spark, d):
    return _r(ranking.with_bio(T.scored_nodes(spark, d), T.AS_OF).select("id", "bio"), "bio")


def graph_score(spark, d):
    nodes, _, adj = _linked(spark, d)
    q, seeds = _seeds(spark, d)
    scored = ranking.graph_scores(nodes, seeds, adj, nodes, q)
    return _r(nodes.select("id").join(scored, "id", "left").select("id", F.coalesce("graph", F.lit(0.0)).alias("graph")), "graph")


def coherence(spark, d):
    nodes, _, adj = _linked(spark, d)
    return _r(ranking.coherence(nodes, adj, nodes, T.query_vector(spark, d, 0)), "coherence")


def access_update(spark, d):
    """Every event counts once more, at its time and an hour."""
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node_id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) + 3600").alias("ts"))
    return ranking.fold_access(T.scored_nodes(spark, d), log).select("id", "access_count", "last_access_ts")


def hybrid_search_index(spark, d):
    nodes, _, adj = _linked(spark, d)
    return _r(ranking.hybrid_search(nodes, adj, T.query_vector(spark, d, 0), K, T.AS_OF), "score")


def _clustered(spark, d, query):
    nodes, _, adj = _linked(spark, d)
    clusters, members = T.clusters(spark, d)
    return _r(ranking.hybrid_search(nodes, adj, query, K, T.AS_OF, clusters, members), "score")


def hybrid_search_clustered(spark, d):
    return _clustered(spark, d, T.mean_vector(spark, d, 3))


def hybrid_search_no_match(spark, d):
    return _clustered(spark, d, T.query_vector(spark, d, 0))


def cluster_candidates(spark, d):
    clusters, members = T.clusters(spark, d)
    return ranking.cluster_candidates(clusters, members, T.mean_vector(spark, d, 3), 3 * K)


def cluster_score(spark, d):
    clusters, members = T.clusters(spark, d)
    return _r(ranking.cluster_scores(clusters, members, T.mean_vector(spark, d, 3)), "cluster_score")


def cluster_list(spark, d):
    clusters, members = T.clusters(spark, d)
    lists = members.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), ",").alias("members"))
    return _r(clusters.where("parent_id is null").join(lists, "cluster_id").select("cluster_id", "anchor_id", "members", "significance"), "significance")


def cluster_centroids(spark, d):
    clusters, _ = T.clusters(spark, d)
    return _r(clusters.select("cluster_id", F.posexplode("centroid").alias("i", "x")), "x")


def cluster_anchors(spark, d):
    return T.clusters(spark, d)[0].select("cluster_id", "anchor_id")


def cluster_significance(spark, d):
    return _r(T.clusters(spark, d)[0].select("cluster_id", "size", "significance"), "significance")


def cluster_stats(spark, d):
    return _r(clustering.statistics(T.clusters(spark, d)[0]), "avg_size", "avg_significance")


def cluster_cohesion(spark, d):
    return _r(clustering.cohesion(T.clusters(spark, d)[1], T.vectors(spark, d)), "cohesion")


def cluster_search(spark, d):
    clusters, members = T.clusters(spark, d)
    return _r(clustering.search_in_cluster(clusters, members, T.vectors(spark, d), 3, T.query_vector(spark, d, 0), K), "score")


def node_clusters(spark, d):
    clusters, members = T.clusters(spark, d)
    return clustering.clusters_of(members, clusters)


def deepest_cluster(spark, d):
    clusters, members = T.clusters(spark, d)
    return clustering.deepest(members, clusters)


def cluster_tree_text(spark, d):
    return clustering.tree_lines(T.clusters(spark, d)[0])


def cluster_legend(spark, d):
    return _r(export.legend(T.clusters(spark, d)[0]), "significance")


def cluster_colors(spark, d):
    return spark.range(24).select(F.col("id").alias("cluster_id"), cluster_colour(F.col("id"), F.lit(10)).alias("colour"))


def graph_nodes_library(spark, d):
    clusters, members = T.clusters(spark, d)
    return export.library_nodes(T.nodes(spark, d), clusters, members).withColumn("significance", F.col("significance").cast("int"))


def graph_nodes_export(spark, d):
    clusters, members = T.clusters(spark, d)
    return export.server_nodes(T.nodes(spark, d), clusters, members).select("id", "label", "content", F.col("significance").cast("int").alias("significance"), "cluster_id", "colour")


def graph_stats(spark, d):
    return export.statistics(T.vectors(spark, d), T.edges(spark, d), T.clusters(spark, d)[0])


def circular_layout(spark, d):
    _, members = T.clusters(spark, d)
    return _r(export.circular_layout(T.vectors(spark, d), members.where("cluster_id = root_id")), "x", "y")


def node_style(spark, d):
    _, members = T.clusters(spark, d)
    hits = graph.knn(T.vectors(spark, d), T.query_vector(spark, d, 0), K).select("id")
    return _r(export.node_style(T.vectors(spark, d), hits, [0, 3], members.where("cluster_id = root_id"), 2), "size", "ui_size")


def edge_style(spark, d):
    hits = graph.knn(T.vectors(spark, d), T.query_vector(spark, d, 0), K).select("id")
    return export.edge_style(T.edges(spark, d), T.vectors(spark, d), hits, 2)


def rag_context(spark, d):
    hits = hybrid_search_index(spark, d).where("rank <= 5").select("rank", "id")
    return export.context(hits, T.nodes(spark, d))


def snapshot_event(spark, d):
    parts = export.snapshot_parts(T.nodes(spark, d), T.edges(spark, d), *T.clusters(spark, d))
    j = lambda p: F.get_json_object("event", p)
    each = parts.select(j("$.type").alias("type"), j("$.data.nodes[0].id").cast("long").alias("node"), j("$.data.nodes[0].color").alias("colour"), j("$.data.clusters.3.node_count").cast("long").alias("three"), F.size(F.from_json(j("$.data.edges"), "array<struct<source:long,target:long>>")).cast("long").alias("edges"))
    return each.agg(F.min("type").alias("type"), F.min("node").alias("first_node"), F.min_by("colour", "node").alias("first_colour"), F.max("three").alias("size_of_3"), F.sum("edges").alias("n_edges"))


def agglomerative_flat(spark, d):
    clusters, members = clustering.build(T.vectors(spark, d), K)
    return members.join(clusters.where("parent_id is null").select("cluster_id"), "cluster_id", "left_semi")


def cluster_hierarchy(spark, d):
    clusters, _ = clustering.build(T.vectors(spark, d), K)
    return _r(clusters.drop("centroid"), "significance")


def snapshot_roundtrip(spark, d):
    """Nodes and, as rows of their own, edges, read back."""
    root = Scratch(spark).root
    save_snapshot(spark, root, {"nodes": T.nodes(spark, d), "edges": T.edges(spark, d)}, {"tables": ["nodes", "edges"]})
    tables, _ = load_snapshot(spark, root)
    nodes = tables["nodes"].select("id", "content", F.col("significance").cast("int").alias("significance"), "access_count", "last_access_ts", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("content", "string"), ("significance", "int"), ("access_count", "long"), ("last_access_ts", "long"))]
    return nodes.union(tables["edges"].select(F.col("seq").alias("id"), *none, "src", "dst"))


def stream_ingest(spark, d):
    """Four batches; each links to those before. A batch is as many files as tasks wrote, and is taken in before the next is written."""
    scratch = Scratch(spark)
    root = scratch.root
    rows = T.nodes(spark, d).select("id", "content", "embedding", "significance")
    size = -(-(T.vectors(spark, d).agg(F.max("id")).first()[0] + 1) // 4)
    placed = scratch.save(rows.withColumn("batch", F.floor(F.col("id") / size).cast("int")), by="batch")
    for i in range(4):
        placed.where(F.col("batch") == i).select(*rows.columns).write.mode("append").parquet(f"{root}/in")
        files = ingest.stream_nodes(spark, f"{root}/in", files_per_trigger=1_000_000)
        ingest.ingest(files, f"{root}/out", f"{root}/state", T.LINK_AT).awaitTermination()
    return _r(spark.read.schema(ingest.LINKS).parquet(f"{root}/out/links").select("src", "dst", "sim", "rank"), "sim")


def _states(spark, d):
    """(first of the last tenth of the ids, {nodes, edges, clusters} of the nodes below it, and of all).

    A node's links go to those before it, so the links of the nodes below an id are those that start below it.
    """
    every, edges = T.vectors(spark, d), T.edges(spark, d)
    many = every.agg(F.max("id") + 1).first()[0]
    upto = many - many // 10

    def state(nodes, edges):
        sizes = nodes.groupBy(F.col("significance").cast("long").alias("id")).agg(F.count("*").alias("node_count"))
        return {"nodes": nodes.select("id", F.col("significance").cast("int").alias("significance")), "edges": graph.undirected(edges), "clusters": sizes}

    return upto, state(every.where(F.col("id") < upto), edges.where(F.col("src") < upto)), state(every, edges)


def delta_events(spark, d):
    """From the graph of all nodes but the last tenth to that of all."""
    return ingest.events(*_states(spark, d)[1:])


def event_fold(spark, d):
    """What a viewer has after the snapshot of all nodes but the last tenth and the events that follow."""
    upto, old, new = _states(spark, d)
    edges = old["edges"].select(F.lit(0).alias("seq"), F.col("source").alias("src"), F.col("target").alias("dst"))
    first = export.snapshot_parts(T.nodes(spark, d).where(F.col("id") < upto), edges, *T.clusters(spark, d))
    head = first.select(F.lit(0).cast("long").alias("seq"), F.lit("graph_snapshot").alias("type"), F.get_json_object("event", "$.data").alias("data"))
    after = ingest.events({**old, "clusters": new["clusters"]}, new).select(F.lit(1).cast("long").alias("seq"), "type", "data")
    folded = ingest.fold_events(Scratch(spark).save(head.union(after)))
    nodes = folded["nodes"].select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("target"), "color")
    return nodes.union(folded["edges"].select(F.lit("edge"), "source", "target", F.lit(None).cast("string"))).union(folded["clusters"].select(F.lit("cluster"), "id", F.lit(None).cast("long"), "color"))


def cluster_palette(spark, d):
    _, members = T.clusters(spark, d)
    return export.palette(members)


def hit_colours(spark, d):
    return export.hit_colours(graph.knn(T.vectors(spark, d), T.query_vector(spark, d, 0), K).select("rank", "id"))


def node_tooltips(spark, d):
    _, members = T.clusters(spark, d)
    hits = graph.knn(T.vectors(spark, d), T.query_vector(spark, d, 0), K).select("id", "score")
    return export.tooltips(ranking.with_life(T.nodes(spark, d), T.AS_OF), members.where("cluster_id = root_id"), hits)


def similarity_to_all(spark, d):
    return _r(T.vectors(spark, d).select("id", cosine_to(T.mean_vector(spark, d, 3), F.col("embedding")).alias("sim")), "sim")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        node_scan, point_lookup, heap_layout, knn_search, pairwise_cosine, auto_link, adjacency, neighbor_lookup, degree, undirected_edges, directed_edges, expand_2hop, add_edge_validation,
        life_score, vacuum_candidates, bio_score, graph_score, coherence, access_update, hybrid_search_index, hybrid_search_clustered, hybrid_search_no_match, cluster_candidates, cluster_score,
        cluster_list, cluster_centroids, cluster_anchors, cluster_significance, cluster_stats, cluster_cohesion, cluster_search, node_clusters, deepest_cluster, cluster_tree_text, cluster_legend,
        cluster_colors, graph_nodes_library, graph_nodes_export, graph_stats, circular_layout, node_style, edge_style, rag_context, snapshot_event, agglomerative_flat, cluster_hierarchy,
        snapshot_roundtrip, stream_ingest, delta_events, similarity_to_all, event_fold, cluster_palette, hit_colours, node_tooltips,
    )
}
