"""Nodes, links and clusters as a viewer wants them."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scores import GREY, cluster_colour, hex_colour, label, palette_colour
from quillon.operators.clustering import deepest


def library_nodes(nodes: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label, significance, cluster_id): with the innermost cluster."""
    inner = deepest(members, clusters).withColumnRenamed("node_id", "id")
    return nodes.join(inner, "id", "left").select("id", label(F.col("content"), F.col("id")).alias("label"), "significance", "cluster_id")


def legend(clusters: DataFrame) -> DataFrame:
    """(cluster_id, colour, node_count, significance) of the root clusters."""
    roots = clusters.where("parent_id is null")
    many = roots.agg(F.count("*").alias("many"))
    return roots.crossJoin(F.broadcast(many)).select("cluster_id", cluster_colour(F.col("cluster_id"), F.col("many")).alias("colour"), F.col("size").alias("node_count"), "significance")


def server_nodes(nodes: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label, content, significance, cluster_id, colour): with the root cluster, grey without one."""
    roots = members.join(clusters.where("parent_id is null").select("cluster_id"), "cluster_id", "left_semi").select(F.col("node_id").alias("id"), "cluster_id")
    rows = nodes.join(roots, "id", "left").join(F.broadcast(legend(clusters).select("cluster_id", "colour")), "cluster_id", "left")  # a row per root
    return rows.select("id", label(F.col("content"), F.col("id")).alias("label"), "content", "significance", "cluster_id", F.coalesce("colour", F.lit(GREY)).alias("colour"))


def statistics(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    links = edges.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().agg(F.count("*").alias("edge_count"))
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(links).crossJoin(clusters.where("parent_id is null").agg(F.count("*").alias("cluster_count")))


def circular_layout(nodes: DataFrame, members: DataFrame, radius: float = 300.0) -> DataFrame:
    """(id, x, y): clusters on a circle in the order of their least node, their nodes on small circles around them; nodes without a cluster near the middle."""
    rows = nodes.select("id").join(members.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left")
    sizes = rows.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = sizes.withColumn("i", F.row_number().over(Window.orderBy("first")) - 1).withColumn("many", F.count("*").over(Window.partitionBy()))  # a row per cluster
    placed = rows.join(order, "cluster_id", "left").withColumn("j", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")) - 1).withColumn("own", F.count("*").over(Window.partitionBy("cluster_id")))
    angle, middle = 2 * F.pi() * F.col("j") / F.col("own"), 2 * F.pi() * F.col("i") / F.col("many")
    r = F.when(F.col("cluster_id").isNull(), 50.0).otherwise(F.least(F.lit(100.0), F.col("own") * 8.0))
    at = lambda f: F.coalesce(f(middle) * radius, F.lit(0.0)) + f(angle) * r
    return placed.select("id", at(F.cos).alias("x"), at(F.sin).alias("y"))


def node_style(nodes: DataFrame, hits: DataFrame, highlighted: list[int], members: DataFrame, least: int = 0) -> DataFrame:
    """(id, kind, size, ui_size): hits (id) before nodes of highlighted clusters before all others; cluster 0 is never highlighted."""
    marks = hits.select("id", F.lit(True).alias("hit"))
    rows = nodes.where(F.col("significance") >= least).join(marks, "id", "left").join(members.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left")
    wanted = F.col("cluster_id").isin([c for c in highlighted if c]) if any(highlighted) else F.lit(False)
    kind = F.when(F.col("hit"), "search_hit").when(wanted, "highlighted").otherwise("normal")
    size = (F.col("significance") * 3 + 15) * F.when(F.col("hit"), 1.5).otherwise(1.0)
    return rows.select("id", kind.alias("kind"), size.alias("size"), (F.col("significance") / 9.0 * 6.0 + 2.0).alias("ui_size"))


def palette(members: DataFrame) -> DataFrame:
    """(cluster_id, colour): hues spread evenly over the clusters in the order of their ids."""
    ids = members.where("cluster_id is not null").select("cluster_id").distinct()
    order = ids.withColumn("i", F.row_number().over(Window.orderBy("cluster_id")) - 1).withColumn("many", F.count("*").over(Window.partitionBy()))  # a row per cluster
    return order.select("cluster_id", palette_colour(F.col("i") / F.col("many")).alias("colour"))


def hit_colours(hits: DataFrame) -> DataFrame:
    """(id, colour) of hits (rank, id): from orange for the first to dark red; by rank, from 1 on."""
    many = hits.agg(F.count("*").alias("many"))  # one row
    rows = hits.crossJoin(F.broadcast(many)).withColumn("intensity", 1.0 - (F.col("rank") - 1) / F.col("many") * 0.5)
    return rows.select("id", hex_colour(F.lit(1.0), F.col("intensity") * 0.8, F.lit(0.0)).alias("colour"))


def tooltips(nodes: DataFrame, members: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, title, display_label) of nodes with a life score; hits: (id, score). A cluster 0 reads None, as no cluster does."""
    rows = nodes.join(members.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left").join(hits.select("id", F.col("score").alias("hit_score")), "id", "left")
    preview = F.substring(F.coalesce("content", label(F.col("content"), F.col("id"))), 1, 100)
    cluster = F.when(F.coalesce("cluster_id", F.lit(0)) == 0, F.lit("None")).otherwise(F.col("cluster_id").cast("string"))
    found = F.when(F.col("hit_score").isNotNull(), F.format_string("\U0001f3af Search Score: %.3f\n", "hit_score")).otherwise("")
    title = F.concat(F.format_string("Node %d\n", "id"), found, F.lit("Cluster: "), cluster, F.format_string("\nSignificance: %d/9\nLife Score: %.2f\n---\n", "significance", "life"), preview, F.lit("..."))
    shown = F.concat(F.when(F.col("hit_score").isNotNull(), F.lit("\u2b50 ")).otherwise(""), F.col("id").cast("string"), F.lit(": "), F.substring(preview, 1, 30), F.lit("..."))
    return rows.select("id", title.alias("title"), shown.alias("display_label"))


def html_report(nodes: DataFrame, edges: DataFrame, members: DataFrame, hits: DataFrame, highlighted: list[int] = (), least: int = 0) -> str:
    """A page that draws a graph which a viewer can show: nodes in circles by cluster, coloured, sized and explained as the other functions say.

    nodes has a life score; hits: (rank, id, score); members: of root clusters.
    """
    kept = nodes.where(F.col("significance") >= least)
    rows = circular_layout(kept, members).join(node_style(kept, hits, list(highlighted), members, least), "id").join(tooltips(kept, members, hits), "id")
    rows = rows.join(members.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left").join(palette(members).withColumnRenamed("colour", "own"), "cluster_id", "left").join(hit_colours(hits), "id", "left")
    fill = F.when(F.col("kind") == "search_hit", F.col("colour")).when(F.col("kind") == "highlighted", "#00FFFF").otherwise(F.coalesce("own", F.lit(GREY)))
    drawn = rows.select("id", "x", "y", "ui_size", "title", "display_label", fill.alias("fill")).orderBy("id").collect()
    at = {r["id"]: (r["x"], r["y"]) for r in drawn}
    lines = edge_style(edges, kept, hits, least).orderBy("source", "target").collect()
    legend_rows = palette(members).orderBy("cluster_id").collect()
    safe = html.escape
    svg = [f'<line x1="{at[r["source"]][0]:.1f}" y1="{at[r["source"]][1]:.1f}" x2="{at[r["target"]][0]:.1f}" y2="{at[r["target"]][1]:.1f}" stroke="{r["colour"]}"/>' for r in lines]
    svg += [f'<circle cx="{r["x"]:.1f}" cy="{r["y"]:.1f}" r="{r["ui_size"]:.1f}" fill="{r["fill"]}"><title>{safe(r["display_label"])}\n{safe(r["title"])}</title></circle>' for r in drawn]
    keys = [("#FFD700", "Search results"), ("#00FFFF", "Highlighted clusters"), (GREY, "Unclustered nodes"), *((r["colour"], f"Cluster {r['cluster_id']}") for r in legend_rows)]
    legend_html = "".join(f'<li><span style="background:{c}"></span>{safe(t)}</li>' for c, t in keys)
    style = "body{margin:0;background:#111;color:#eee;font:12px monospace}ul{position:fixed;left:1em;bottom:1em;list-style:none}li span{display:inline-block;width:1em;height:1em;margin-right:.6em}"
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><style>{style}</style><p>{len(drawn)} nodes, {len(lines)} links</p><svg viewBox="-450 -450 900 900">{"".join(svg)}</svg><ul>{legend_html}</ul>'


def edge_style(edges: DataFrame, nodes: DataFrame, hits: DataFrame, least: int = 0) -> DataFrame:
    """(source, target, colour): both ends are kept nodes; gold where one is a hit."""
    kept = nodes.where(F.col("significance") >= least).select("id")
    pairs = edges.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).distinct()
    pairs = pairs.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi")
    mark = lambda c: hits.select(F.col("id").alias(c), F.lit(True).alias(f"hit_{c}"))
    rows = pairs.join(mark("source"), "source", "left").join(mark("target"), "target", "left")
    return rows.select("source", "target", F.when(F.col("hit_source") | F.col("hit_target"), "gold").otherwise("grey").alias("colour"))


def context(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(context): the contents of hits (rank, id) in one text, a line each."""
    rows = hits.join(nodes.select("id", "content"), "id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("all"))
    return rows.select(F.array_join(F.transform("all", lambda x: x["content"]), "\n").alias("context"))


def _shown_nodes(nodes: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    return server_nodes(nodes, clusters, members).select(F.struct("id", "label", "content", "significance", "cluster_id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("colour").alias("color")).alias("node"))


def _shown_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).distinct().select(F.struct("source", "target").alias("edge"))


def _shown_clusters(clusters: DataFrame) -> DataFrame:
    """One row."""
    return legend(clusters).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("string"), F.struct(F.col("cluster_id").alias("id"), F.col("colour").alias("color"), "node_count", "significance"))))).alias("clusters"))


def _snapshot(nodes, edges, clusters):
    return F.to_json(F.struct(F.lit("graph_snapshot").alias("type"), F.struct(nodes.alias("nodes"), edges.alias("edges"), clusters.alias("clusters")).alias("data")), {"ignoreNullFields": "false"}).alias("event")


def snapshot_event(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(event): JSON {"type": "graph_snapshot", "data": {nodes, edges, clusters}}; for graphs that a viewer can show, since it is one text."""
    n = _shown_nodes(nodes, clusters, members).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    e = _shown_edges(edges).agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    return n.crossJoin(e).crossJoin(_shown_clusters(clusters)).select(_snapshot(F.col("nodes"), F.col("edges"), F.col("clusters")))


def snapshot_parts(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(event): the snapshot of a graph of any size in parts, an event for each node, one for each link and one for all root clusters.

    Each is JSON as that of snapshot_event; together their nodes, edges and
    clusters are the snapshot's, and fold_events takes those of one seq as one.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    no_cluster = F.create_map().cast("map<string,string>")
    out = _shown_nodes(nodes, clusters, members).select(_snapshot(F.array("node"), none("string"), no_cluster))
    out = out.union(_shown_edges(edges).select(_snapshot(none("string"), F.array("edge"), no_cluster)))
    return out.union(_shown_clusters(clusters).select(_snapshot(none("string"), none("string"), F.col("clusters"))))
