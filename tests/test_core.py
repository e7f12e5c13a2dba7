"""The core against its SQL, and the edge cases of the store."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quillon.operators import clustering, graph, ranking
from quillon.operators.clustering import agglomerate
from quillon.plans.queries import ORACLE_SQL, QUERIES
from quillon.sources.store import GraphStore


def _cell(v):
    if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(f"{data}/sf0.001"):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/sf0.001/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, data, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    cols = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(_cell(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)


def test_every_query_but_two_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"agglomerative_flat", "cluster_hierarchy"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "id", "score"]


def _slow(vectors, k):
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.where(n == 0, 0, vectors / np.where(n == 0, 1, n))
    s = u @ u.T
    lists = [[i] for i in range(len(vectors))]
    while len(lists) > k:
        best, at = -np.inf, None
        for i in range(len(lists)):
            for j in range(i + 1, len(lists)):
                m = s[np.ix_(lists[i], lists[j])].mean()
                if m > best:
                    best, at = m, (i, j)
        i, j = at
        lists[i] += lists.pop(j)
    return lists


@pytest.mark.parametrize("seed", range(15))
def test_clusters_are_those_of_the_slow_way(seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((int(rng.integers(3, 40)), 6))
    if seed % 3 == 0:
        v[1] = 0
    assert agglomerate(v, 4) == _slow(v, 4) if len(v) > 4 else [[i] for i in range(len(v))]


def test_few_rows_are_singletons_and_no_cluster_is_an_error(spark):
    assert agglomerate(np.eye(3), 5) == [[0], [1], [2]]
    with pytest.raises(ValueError):
        agglomerate(np.eye(3), 0)


def test_big_clusters_are_split_in_preorder(spark):
    rng = np.random.default_rng(3)
    near = [[float(x) for x in np.array([1.0, 0, 0]) + rng.normal(0, 0.05, 3)] for _ in range(51)]
    far = [[0.0, 1.0, float(x)] for x in rng.normal(0, 0.05, 50)]
    rows = [(i, v, 5) for i, v in enumerate(near + far)]
    clusters, members = clustering.build(spark.createDataFrame(rows, "id long, embedding array<float>, significance short"), 2)
    c = {r["cluster_id"]: r for r in clusters.collect()}
    assert [c[i]["depth"] for i in sorted(c)] == [0, 1, 1, 1, 1, 1, 0]  # 51 members are split in five, 50 are not
    assert all(c[i]["parent_id"] == 0 for i in range(1, 6)) and c[6]["size"] == 50
    inside = {r["node_id"] for r in members.where("cluster_id between 1 and 5").collect()}
    assert inside == set(range(51))


@pytest.fixture()
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/db")


def test_store_links_and_edges(store):
    ids = store.add_nodes([("a", [1, 0], 9), ("b", [1, 0.1], 9), ("c", [0, 1], 1)], as_of=0)
    assert list(ids) == [0, 1, 2] and store.get_neighbors(1) == [0] and store.get_neighbors(2) == []
    store.add_edge(0, 1)
    store.add_edge(2, 2)
    store.add_edge(0, 99)
    assert store.get_neighbors(0) == [1, 1] and store.get_neighbors(2) == [2, 2] and store.get_neighbors(99) == []
    assert store.add_node("d", [0, 1], 2) == 3 and store.get_neighbors(3) == [2]
    with pytest.raises(ValueError):
        store.add_node("e", [math.nan], 1)


def test_store_appends_and_folds(store, spark, monkeypatch):
    from quillon.sources import store as module

    monkeypatch.setattr(module.Parts, "MOST", 3)
    monkeypatch.setattr(GraphStore, "LOG", 2)
    rows = [(10 * i, f"t{i}", [float(x) for x in v], 5) for i, v in enumerate(np.random.default_rng(0).standard_normal((12, 3)))]
    df = spark.createDataFrame(rows[:8][::-1], "pos long, content string, embedding array<float>, significance short")
    assert list(store.add_nodes(df, 0.5, as_of=0)) == list(range(8)) and list(store.add_nodes(df.limit(0))) == []
    for _, c, v, s in rows[8:]:
        store.add_node(c, v, s, 0.5)
    store.add_edge(1, 2)
    one = GraphStore(spark, store.path + "-one")
    one.add_nodes([r[1:] for r in rows], 0.5, as_of=0)
    one.add_edge(1, 2)
    assert store.get_all_graph_data() == one.get_all_graph_data() and len(store._node_parts.parts) <= 3
    for i in (1, 1, 1, 2, 1):
        store.get_node(i, as_of=7)
    assert {r["id"]: r["access_count"] for r in store.nodes.where("access_count > 0").collect()} == {1: 4, 2: 1} and len(store._log) <= 2
    store.save()
    assert {r["id"]: r["access_count"] for r in GraphStore(spark, store.path).nodes.where("access_count > 0").collect()} == {1: 4, 2: 1}
    with pytest.raises(ValueError):
        store.add_nodes(spark.createDataFrame([(0, "x", [1.0, math.nan], 1)], "pos long, content string, embedding array<float>, significance short"))
    assert store.add_node("y", [1, 0, 0], 1) == 12


def test_links_of_any_ids_and_no_nan(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 4))
    ids = sorted(int(i) for i in rng.integers(-(2**62), 2**62, 60))
    schema = "id long, embedding array<double>"
    plain, wild = (spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(name, x)], schema) for name in (range(60), ids))
    graph_block, graph.BLOCK = graph.BLOCK, 7
    try:
        want = sorted(tuple(r) for r in graph.auto_link(plain, 0.2).collect())
        assert sorted((ids.index(r[0]), ids.index(r[1]), r[2], r[3]) for r in graph.auto_link(wild, 0.2).collect()) == want
        assert sorted((ids.index(r[0]), ids.index(r[1]), r[2], r[3]) for r in graph.auto_link(wild, 0.2, since=ids[40]).collect()) == [w for w in want if w[0] >= 40]
        assert len(graph.similar_pairs(wild, 0.2).collect()) == len(graph.similar_pairs(plain, 0.2).collect()) > 0
        bad = wild.union(spark.createDataFrame([(1, [math.nan, 1.0, 1.0, 1.0])], schema))
        for run in (lambda: graph.auto_link(bad).collect(), lambda: graph.knn(bad, [1.0, 0, 0, 0], 3).collect(), lambda: graph.similar_pairs(bad, 0.5).collect()):
            with pytest.raises(Exception, match="NaN in an embedding"):
                run()
    finally:
        graph.BLOCK = graph_block


def test_near_links_find_what_auto_link_finds(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 12))
    x[1::3] = x[::3] + rng.normal(0, 0.2, (1000, 12))
    df = spark.createDataFrame([(7 * i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, embedding array<float>")
    want = {(r["src"], r["dst"]): r["sim"] for r in graph.auto_link(df, 0.85).collect()}
    graph_block, graph.BLOCK = graph.BLOCK, 100
    try:
        got = {(r["src"], r["dst"]): r["sim"] for r in graph.near_links(df, 0.85).collect()}
    finally:
        graph.BLOCK = graph_block
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 900 and all(abs(want[p] - s) < 1e-9 for p, s in got.items())
    assert graph.near_links(df.where("false"), 0.9).count() == 0
    with pytest.raises(ValueError):
        graph.near_links(df, 0.1, most_tables=10)


def _slow_matrix(v, k):
    """The slow way on sums of cosines between lists, fast enough for a table."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / n
    total, lists = u @ u.T, [[i] for i in range(len(v))]
    while len(lists) > k:
        size = np.array([len(x) for x in lists])
        mean = np.where(np.triu(np.ones_like(total, dtype=bool), 1), total / size[:, None] / size[None, :], -np.inf)
        i, j = np.unravel_index(np.argmax(mean), mean.shape)
        lists[i] += lists.pop(j)
        total[i] += total[j]
        total[:, i] += total[:, j]
        total = np.delete(np.delete(total, j, 0), j, 1)
    return lists


def test_clusters_of_the_whole_table_are_those_of_the_slow_way(spark, data):
    rows = spark.read.parquet(f"{data}/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, v, s = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["label"] for r in rows])
    tree, flat = [], set()

    def grow(members, depth, parent, root):
        number = len(tree)
        root = number if root is None else root
        tree.append((number, parent, root, depth, len(members), round(float(s[members].mean()), 6)))
        if depth == 0:
            flat.update((number, pos, ids[m]) for pos, m in enumerate(members))
        if len(members) > 50 and depth < 3:
            for part in sorted(_slow_matrix(v[members], max(2, min(5, len(members) // 3))), key=lambda p: p[0]):
                grow([members[i] for i in part], depth + 1, number, root)

    for part in sorted(_slow_matrix(v, 10), key=lambda p: p[0]):
        grow(part, 0, None, None)
    got = QUERIES["agglomerative_flat"](spark, f"{data}/sf0.01").collect()
    assert {(r["cluster_id"], r["pos"], r["node_id"]) for r in got} == flat
    got = QUERIES["cluster_hierarchy"](spark, f"{data}/sf0.01").orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["parent_id"], r["root_id"], r["depth"], r["size"], r["significance"]) for r in got] == tree


def test_events_and_their_sink(spark, tmp_path):
    from quillon.streaming import ingest

    state = lambda n, e, c: {"nodes": spark.createDataFrame(n, "id long, label string"), "edges": spark.createDataFrame(e, "source long, target long"), "clusters": spark.createDataFrame(c, "id long, size long")}
    old, new = state([(0, "a"), (1, "b")], [(0, 1)], [(0, 2), (7, 1)]), state([(0, "a"), (1, "b"), (2, "c")], [(1, 0), (2, 1), (1, 2)], [(0, 3)])
    got = sorted(((r["type"], r["data"]) for r in ingest.events(old, new).collect()), key=str)
    assert got == [("cluster_updated", '{"id":0,"size":3}'), ("edge_added", '{"source":1,"target":2}'), ("node_added", '{"id":2,"label":"c"}'), ("refresh", None)]
    spark.range(2).selectExpr("id", "cast(null as string) content", "array(1f, 0f) embedding", "cast(1 as short) significance").repartitionByRange(2, "id").write.parquet(f"{tmp_path}/in")
    seen = []
    ingest.publish(ingest.stream_nodes(spark, f"{tmp_path}/in"), lambda rows, n: (old, new)[n], lambda df, n: seen.append(sorted(r["type"] for r in df.collect())), f"{tmp_path}/state").awaitTermination()
    assert seen == [["cluster_updated", "cluster_updated", "edge_added", "node_added", "node_added"], ["cluster_updated", "edge_added", "node_added", "refresh"]]


def test_the_fold_is_that_of_single_events(spark):
    import json
    import random

    from quillon.streaming import ingest

    rng = random.Random(4)
    node = lambda i: {"id": i, "label": f"l{i}", "content": f"c{rng.random()}", "significance": 3, "cluster_id": rng.choice([1, 2, None]), "color": f"#{rng.randint(0, 9)}"}
    cluster = lambda c: {"id": c, "color": f"#{rng.randint(0, 99)}", "node_count": rng.randint(1, 9), "significance": 0.5}
    events = []
    for seq in range(60):
        kind = "graph_snapshot" if seq in (0, 20) else rng.choice(["node_added", "edge_added", "cluster_updated", "refresh", "other"])
        data = {"graph_snapshot": lambda: {"nodes": [node(i) for i in range(5)], "edges": [{"source": 0, "target": 1}], "clusters": {str(c): cluster(c) for c in (1, 2)}}, "node_added": lambda: node(rng.randint(0, 12)), "edge_added": lambda: dict(zip(("source", "target"), rng.sample(range(6), 2))), "cluster_updated": lambda: cluster(rng.choice([1, 2, 3]))}.get(kind, lambda: None)()
        events.append((seq, kind, None if data is None else json.dumps(data)))
    nodes, edges, clusters = {}, set(), {}
    for _, kind, data in events:
        x = data and json.loads(data)
        if kind == "graph_snapshot":
            nodes, edges, clusters = {n["id"]: n for n in x["nodes"]}, {(0, 1)}, {int(c): v for c, v in x["clusters"].items()}
        elif kind == "node_added":
            nodes.setdefault(x["id"], x)
        elif kind == "edge_added":
            edges.add((min(x.values()), max(x.values())))
        elif kind == "cluster_updated":
            clusters[x["id"]] = x
            for n in nodes.values():
                if n["cluster_id"] == x["id"]:
                    n["color"] = x["color"]
    got = ingest.fold_events(spark.createDataFrame(events, "seq long, type string, data string"))
    assert sorted((r.asDict() for r in got["nodes"].collect()), key=lambda n: n["id"]) == [nodes[i] for i in sorted(nodes)]
    assert {tuple(r) for r in got["edges"].collect()} == edges
    assert sorted((r.asDict() for r in got["clusters"].collect()), key=lambda c: c["id"]) == [clusters[c] for c in sorted(clusters)]


def test_server_and_report(store, spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from quillon.operators import export
    from quillon.sinks import serve

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "index.html").write_text("hello")
    state = serve.State(spark, store.path)
    s = serve.server(state, 0, "127.0.0.1", str(tmp_path / "files"))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    get = lambda p: urllib.request.urlopen(at + p, timeout=60)
    try:
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/api/stats")  # nothing is saved yet
        assert e.value.code == 500
        store.add_nodes([(t, v, 5) for t, v in (("a <b>", [1, 0]), ("b", [1, 0.1]), ("c", [0, 1]))], as_of=0)
        store.build_clusters(2)
        store.save()
        assert json.load(get("/api/stats")) == {"node_count": 3, "edge_count": 1, "cluster_count": 2}
        graph_now = json.load(get("/api/graph"))
        assert [n["id"] for n in graph_now["nodes"]] == [0, 1, 2] and graph_now["edges"] == [{"source": 0, "target": 1}] and graph_now["nodes"][0]["x"] is None
        assert set(json.load(get("/api/clusters"))) == {"0", "1"} and get("/").read() == b"hello" and get("/api/graph").headers["Access-Control-Allow-Origin"] == "*"
        events = get("/events")
        first = json.loads(events.readline()[6:])
        assert first["type"] == "graph_snapshot" and len(first["data"]["nodes"]) == 3 and events.readline() == b"\n"
        store.set_server_url(at)
        store.add_node("d", [0, 1], 2)
        store.save()  # tells the server, and that its listeners
        assert len(json.loads(events.readline()[6:])["data"]["nodes"]) == 4
        hub = serve.Hub()
        mine = hub.join()
        for i in range(serve.BEHIND + 5):
            hub.send(str(i))
        assert mine.get() == "5"
    finally:
        s.shutdown()
    members = store._members.where("cluster_id = root_id")
    hits = spark.createDataFrame([(1, 0, 0.9)], "rank long, id long, score double")
    page = export.html_report(ranking.with_life(store.nodes, 3600), store.edges, members, hits, [1])
    assert page.count("<circle") == 4 and page.count("<line") == 2 and "a &lt;b&gt;" in page and "Cluster 1" in page


def test_notices(store):
    """A server of our own is told of each save, unless that is switched off."""
    import http.server
    import threading

    told = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            told.append(self.path)
            self.send_response(200 if len(told) < 3 else 500)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        store.set_server_url(f"http://127.0.0.1:{server.server_port}/")
        assert store.notify() and told == ["/api/notify"]
        store.save()
        assert len(told) == 2
        store.set_auto_notify(False)
        store.save()
        assert len(told) == 2
        with pytest.raises(Exception):
            store.notify()
        store.set_auto_notify(True)
        store.save()  # a failed notice doesn't fail it
        assert len(told) == 4
    finally:
        server.shutdown()


def test_the_clock_is_that_of_the_system(store):
    import time

    from quillon.sources.store import now

    assert abs(now() - time.time()) < 5
    store.add_nodes([("a", [1, 0], 9)])
    assert abs(store.nodes.first()["last_access_ts"] - time.time()) < 60


def test_store_reads_count_as_accesses(store):
    store.add_nodes([("a", [1, 0], 9), ("b", [0, 1], 0)], as_of=0)
    before = store.calculate_life_score(0, as_of=3600)
    assert store.get_node(0, as_of=3600) == "a" and store.get_node(5) is None
    assert store.calculate_life_score(0, as_of=3600) > before and store.calculate_life_score(7) == 0.0
    assert store.vacuum(1.0, as_of=3600) == [1]
    hits = store.hybrid_search([1, 0], 1, as_of=3600)
    assert [h[0] for h in hits] == [0]


def test_store_clusters_and_snapshot(store, spark):
    store.add_nodes([(t, v, 5) for t, v in (("a", [1, 0]), ("b", [1, 0.1]), ("c", [0, 1]), ("d", [0.1, 1]))], as_of=0)
    assert store.get_clusters() == [] and store.get_cluster_stats() is None and store.export_cluster_tree() == "No clusters built yet"
    store.build_clusters(2)
    assert [c[2] for c in store.get_clusters()] == [[0, 1], [2, 3]] and store.get_cluster_stats()[:2] == (2, 2.0)
    assert store.get_node_clusters(3) == [1] and [i for i, _ in store.search_in_cluster(1, [0, 1], 5)] == [2, 3] and store.search_in_cluster(9, [0, 1], 5) == []
    assert store.export_cluster_tree().splitlines()[0].startswith("Cluster 0 (anchor: ")
    assert store.hybrid_search([-1, -1], 3) == []  # no cluster is near: nothing, although there are nodes
    assert not store.notify() and store.get_server_url() is None
    store.save()
    again = GraphStore(spark, store.path)
    assert again.get_all_graph_data() == store.get_all_graph_data() and again.get_clusters() == store.get_clusters()
    assert again.add_node("e", [1, 0], 1) == 4


def test_empty_store(store):
    store.build_clusters(3)
    assert store.get_clusters() == [] and store.get_cluster_stats()[0] == 0
    assert store.hybrid_search([1, 0], 3) == [] and store.get_all_graph_data() == ([], [])


def test_vectors_of_uneven_length(spark):
    from pyspark.sql import functions as F

    from quillon.functions.vectors import cosine, cosine_to

    rows = spark.createDataFrame([([1.0, 2.0], [1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [tuple(round(x, 6) for x in r) for r in rows.select(cosine(F.col("a"), F.col("b")), cosine_to([1.0], F.col("a"))).collect()]
    assert got == [(round(1 / 5**0.5, 6), round(1 / 5**0.5, 6)), (0.0, 0.0)]


def test_future_access_counts_as_now(spark):
    df = spark.createDataFrame([(0, 1, 0, 500)], "id long, significance short, access_count long, last_access_ts long")
    assert round(ranking.with_life(df, 100).first()["life"], 6) == round(10 / 2**1.8, 6)


def test_coherence_takes_the_first_five(spark):
    nodes = spark.createDataFrame([(i, [1.0, 0.0] if i <= 5 else [0.0, 1.0]) for i in range(8)], "id long, embedding array<float>")
    edges = spark.createDataFrame([(i, 0, i) for i in range(1, 8)], "seq long, src long, dst long")
    got = ranking.coherence(nodes.where("id = 0"), graph.adjacency(edges), nodes, [1.0, 0.0]).first()
    assert got["coherence"] == 1.0


@pytest.mark.parametrize("threshold", [-1.0, 0.2])
def test_strips_keep_the_nearest_and_ties_go_to_lower_ids(monkeypatch, threshold):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = rng.standard_normal((90, 5)).astype(np.float32)
    v[30:40], v[41], v[50:54] = v[3], 0, v[50]
    ids = np.sort(rng.choice(1000, 90, replace=False)) - 500
    monkeypatch.setattr(graph, "STRIP", (16, 11))
    side = lambda m: graph._Side(pa.Table.from_pylist([{"ids": ids[m].astype("<i8").tobytes(), "vectors": v[m].tobytes(), "size": 4}]), 0)
    few = np.arange(90) % 3 == 0
    x, y = side(few), side(~few)
    got = sorted((int(a), int(b), s) for part in graph._best_before(x, y, 4, threshold) for a, b, s in zip(*part))
    sim, want = x.cosines(np.repeat(np.arange(len(x)), len(y)), y, np.tile(np.arange(len(y)), len(x))).reshape(len(x), len(y)), []
    for i, a in enumerate(x.ids):
        order = [j for j in np.lexsort((y.ids, -sim[i])) if y.ids[j] <= a and sim[i, j] >= threshold]
        want += [(int(a), int(y.ids[j]), sim[i, j]) for j in order[:4]]
    assert got == sorted(want)


def test_a_pass_over_all_pairs_moves_each_node_a_fixed_number_of_times(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = lambda n: spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"))
    monkeypatch.setattr(graph, "BLOCK", 10)
    moved = {n: graph._block_pairs(rows(n)).agg(F.sum(F.length("vectors"))).first()[0] for n in (1000, 4000)}
    assert moved[4000] == 4 * moved[1000] == 4 * 1000 * 8 * graph.SIDE
    monkeypatch.setattr(graph, "WIDEST", 100 * 16)
    assert graph._blocks(rows(4000))[1] == 40  # no block is wider than that


def test_links_of_copies_are_those_of_the_sql(spark, tmp_path):
    from quillon.plans.oracle import _CTES

    rng = np.random.default_rng(6)
    v = rng.standard_normal((400, 64)).astype(np.float32)
    v[100:200] = v[:100]
    v[300:350] = v[150:200]
    df = spark.createDataFrame([(3 * i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/n")
    found = duckdb.sql(f"with nodes as (select id, embedding::double[] as v from '{tmp_path}/n/*.parquet'),\n{_CTES['links']}\nselect src, dst, sim, rank from links").fetchall()
    assert sorted(map(tuple, graph.auto_link(df, 0.3).collect())) == sorted(found)


def test_parts_of_a_snapshot_are_the_snapshot(spark, data):
    import json

    from quillon.operators import export
    from quillon.sources import tables as T
    from quillon.streaming import ingest

    d = f"{data}/sf0.001"
    args = T.nodes(spark, d), T.edges(spark, d), *T.clusters(spark, d)
    whole = json.loads(export.snapshot_event(*args).first()["event"])
    parts = [json.loads(r["event"]) for r in export.snapshot_parts(*args).collect()]
    assert all(p["type"] == whole["type"] and len(p["data"]["nodes"]) + len(p["data"]["edges"]) <= 1 for p in parts)
    assert sorted((n for p in parts for n in p["data"]["nodes"]), key=lambda n: n["id"]) == whole["data"]["nodes"]
    assert sorted((e for p in parts for e in p["data"]["edges"]), key=lambda e: (e["source"], e["target"])) == whole["data"]["edges"]
    assert [p["data"]["clusters"] for p in parts if p["data"]["clusters"]] == [whole["data"]["clusters"]]
    texts = lambda of: spark.createDataFrame([(4, "graph_snapshot", json.dumps(p["data"])) for p in of], "seq long, type string, data string")
    one, many = ingest.fold_events(texts([whole])), ingest.fold_events(texts(parts))
    for kind in one:
        assert sorted(map(str, one[kind].collect())) == sorted(map(str, many[kind].collect()))
    empty = [df.limit(0) for df in args]
    assert [json.loads(r["event"])["data"] for r in export.snapshot_parts(*empty).collect()] == [{"nodes": [], "edges": [], "clusters": {}}]


@pytest.mark.parametrize("k", [1, 4])
def test_clusters_of_rounds_on_the_cluster_are_those_of_one_task(spark, monkeypatch, k):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((400, 6)) + rng.standard_normal((8, 6))[np.arange(400) % 8]
    ids = np.sort(rng.choice(10**6, 400, replace=False)) - 500_000
    df = spark.createDataFrame([(int(i), [float(y) for y in x], 5) for i, x in zip(ids, v)][::-1], "id long, embedding array<double>, significance short")
    monkeypatch.setattr(clustering, "BLOCK", 30)
    want = []

    def grow(rows, parts, depth):
        for part in sorted(_slow_matrix(v[rows], parts), key=lambda p: p[0]):
            inside = [rows[i] for i in part]
            want.append((depth, [int(ids[i]) for i in inside]))
            if len(inside) > 50 and depth < 3:
                grow(inside, max(2, min(5, len(inside) // 3)), depth + 1)

    grow(list(range(400)), k, 0)
    for alone in (0, 10**9) if k == 1 else (20_000,):
        monkeypatch.setattr(clustering, "ALONE", alone)
        clusters, members = clustering.build(df, k)
        lists = {}
        for r in members.orderBy("cluster_id", "pos").collect():
            lists.setdefault(r["cluster_id"], []).append(r["node_id"])
        assert [(r["depth"], lists[r["cluster_id"]]) for r in clusters.orderBy("cluster_id").collect()] == want
    assert clustering.build(df.limit(0), k)[0].count() == 0 and clustering.build(df.limit(1), k)[1].count() == 1


def test_a_clustering_holds_no_pairs_in_memory():
    import tracemalloc

    v = np.random.default_rng(1).standard_normal((20_001, 3))  # one more than there could be once
    tracemalloc.start()
    parts = agglomerate(v, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) == 10 and sorted(i for p in parts for i in p) == list(range(len(v))) and most < 200e6


def test_a_batch_of_the_stream_is_written_by_all_tasks(spark, data, monkeypatch):
    from quillon.streaming import ingest

    seen, real = [], ingest.stream_nodes
    monkeypatch.setattr(ingest, "stream_nodes", lambda s, path, **more: seen.append(len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")])) or real(s, path, **more))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, QUERIES["stream_ingest"](spark, f"{data}/sf0.001").collect()))
        assert seen == [4, 8, 12, 16]
        assert got == sorted(map(tuple, QUERIES["auto_link"](spark, f"{data}/sf0.001").collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
