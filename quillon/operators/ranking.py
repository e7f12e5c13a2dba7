"""Hybrid ranking: meaning, links, recency and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scores import bio_score, life_score
from quillon.functions.vectors import cosine, cosine_to
from quillon.operators.graph import expand, knn
from quillon.session import Scratch


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.50
    graph: float = 0.30
    bio: float = 0.15
    cluster: float = 0.05


LEAST = 0.25


def with_life(nodes: DataFrame, as_of: int) -> DataFrame:
    return nodes.withColumn("life", life_score(F.col("significance"), F.col("access_count"), F.col("last_access_ts"), as_of))


def with_bio(nodes: DataFrame, as_of: int) -> DataFrame:
    return with_life(nodes, as_of).withColumn("bio", bio_score(F.col("significance"), F.col("access_count"), F.col("life")))


def coherence(of: DataFrame, adj: DataFrame, nodes: DataFrame, query: list[float]) -> DataFrame:
    """(id, coherence) of the ids in `of` that have a link: over the first five of the list, how near they are to query and node."""
    first = Window.partitionBy("id").orderBy("ord")
    mine = adj.join(of.select("id"), "id", "left_semi").withColumn("deg", F.count("*").over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(first)).where("rank <= 5")
    own = nodes.select("id", F.col("embedding").alias("e"))
    other = nodes.select(F.col("id").alias("nb"), F.col("embedding").alias("f"))
    near = mine.join(own, "id").join(other, "nb").withColumn("x", (cosine_to(query, F.col("f")) + cosine(F.col("e"), F.col("f"))) / 2.0)
    return near.groupBy("id").agg((F.sum("x") / F.least(F.max("deg"), F.lit(5))).alias("coherence"))


def graph_scores(of: DataFrame, seeds: DataFrame, adj: DataFrame, nodes: DataFrame, query: list[float]) -> DataFrame:
    """(id, graph) of the ids in `of` that have a link."""
    marks = seeds.select(F.col("id").alias("nb"), F.lit(1).alias("hit"))
    many = seeds.agg(F.greatest(F.count("*"), F.lit(1)).alias("many"))  # one row
    counted = adj.join(of.select("id"), "id", "left_semi").join(marks, "nb", "left").groupBy("id").agg(F.count("*").alias("deg"), F.count("hit").alias("hits"))
    both = counted.join(coherence(of, adj, nodes, query), "id").crossJoin(F.broadcast(many))
    return both.select("id", F.least(F.least(F.col("deg") / 10.0, F.lit(1.0)) * 0.3 + F.col("hits") / F.col("many") * 0.4 + F.col("coherence") * 0.3, F.lit(1.0)).alias("graph"))


def root_similarity(clusters: DataFrame, query: list[float]) -> DataFrame:
    return clusters.where("parent_id is null").select("cluster_id", "significance", cosine_to(query, F.col("centroid")).alias("sim"))


def cluster_candidates(clusters: DataFrame, members: DataFrame, query: list[float], most: int) -> DataFrame:
    """(id): members of the three nearest roots that are nearer than 0.4, in the order of the lists, `most` of them."""
    roots = root_similarity(clusters, query).orderBy(F.desc("sim"), "cluster_id").limit(3)
    near = roots.where("sim > 0.4").join(members, "cluster_id")
    return near.orderBy(F.desc("sim"), "cluster_id", "pos").limit(most).select(F.col("node_id").alias("id"))


def cluster_scores(clusters: DataFrame, members: DataFrame, query: list[float]) -> DataFrame:
    """(id, cluster_score) of the nodes in a root cluster."""
    score = F.greatest(F.col("sim") * 0.7 + F.col("significance") / 255.0 * 0.3, F.lit(0.0))
    return root_similarity(clusters, query).join(members, "cluster_id").groupBy(F.col("node_id").alias("id")).agg(F.max(score).alias("cluster_score"))


SMALL_POOL = 1_000_000


def hybrid_scores(nodes: DataFrame, adj: DataFrame, query: list[float], k: int, as_of: int, clusters: DataFrame | None = None, members: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """(id, score) of the pool: candidates and what two links reach from them.

    Candidates come from the clusters if there are any, and never from the
    nearest neighbours then, even if no cluster is near enough. They are 3 * k
    at most and go through the driver; the pool is written once, and broadcast
    if it has SMALL_POOL ids at most.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark)
    chosen = knn(nodes, query, 3 * k).select("id") if clusters is None else cluster_candidates(clusters, members, query, 3 * k)
    candidates = spark.createDataFrame([(r["id"],) for r in chosen.collect()], "id long")
    pool = scratch.save(expand(F.broadcast(candidates), adj, 2).coalesce(8))
    some = F.broadcast(pool) if pool.count() <= SMALL_POOL else pool
    rows = scratch.save(nodes.select("id", "embedding", "significance", "access_count", "last_access_ts").join(some, "id", "left_semi"))
    near = scratch.save(adj.join(some, "id", "left_semi"))
    vectors = nodes.select("id", "embedding").join(near.select(F.col("nb").alias("id")).union(pool).distinct(), "id", "left_semi")
    graph = graph_scores(pool, candidates, near, vectors, query)
    scored = with_bio(rows, as_of).withColumn("semantic", cosine_to(query, F.col("embedding"))).select("id", "semantic", "bio").join(graph, "id", "left")
    scored = scored.join(cluster_scores(clusters, members.join(some.withColumnRenamed("id", "node_id"), "node_id", "left_semi"), query), "id", "left") if clusters is not None else scored.withColumn("cluster_score", F.lit(0.0))
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scored.select("id", (F.col("semantic") * weights.semantic + part("graph") * weights.graph + F.col("bio") * weights.bio + part("cluster_score") * weights.cluster).alias("score"))


def hybrid_search(nodes: DataFrame, adj: DataFrame, query: list[float], k: int, as_of: int, clusters: DataFrame | None = None, members: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """(rank, id, score): the best k of the pool that reach 0.25; equal scores by id."""
    top = hybrid_scores(nodes, adj, query, k, as_of, clusters, members, weights).where(F.col("score") >= LEAST).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")  # k rows


def vacuum(nodes: DataFrame, threshold: float, as_of: int) -> DataFrame:
    """(id, life) of the nodes that are below the threshold; nothing is deleted."""
    return with_life(nodes, as_of).where(F.col("life") < threshold).select("id", "life")


def fold_access(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """nodes with the accesses of log (node_id, ts) applied."""
    folded = log.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("__more"), F.max("ts").alias("__ts"))
    rows = nodes.join(folded, "id", "left")
    return rows.withColumn("access_count", F.col("access_count") + F.coalesce("__more", F.lit(0))).withColumn("last_access_ts", F.coalesce("__ts", "last_access_ts")).drop("__more", "__ts")
