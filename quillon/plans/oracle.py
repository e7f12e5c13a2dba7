"""The same queries in SQL, for DuckDB over the given tables."""

from __future__ import annotations

AS_OF, NEVER, LINK_AT = 1706659200, 1704067200, 0.3


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


_CTES = {
    "nodes": f"""nodes as (
  select e.vec_id as id, coalesce(d.text, 'Node ' || e.vec_id) as content, e.embedding::double[] as v, e.label as significance, coalesce(a.n, 0) as access_count, coalesce(a.t, {NEVER}) as last_access_ts
  from embeddings e left join documents d on d.doc_id = e.vec_id
  left join (select user_id, count(*) as n, cast(floor(epoch(max(ts))) as bigint) as t from events group by user_id) a on a.user_id = e.vec_id)""",
    "links": f"""ranked as (
  select a.id as src, b.id as dst, {_cos("a.v", "b.v")} as sim, row_number() over (partition by a.id order by {_cos("a.v", "b.v")} desc, b.id) as rank from nodes a join nodes b on b.id <= a.id),
links as (select src, dst, sim, rank from ranked where rank <= 6 and src <> dst and sim >= {LINK_AT})""",
    "adj": """edges as (select src * 8 + rank as seq, src, dst from links),
adj as (select src as id, dst as nb, 2 * seq as ord from edges union all select dst, src, 2 * seq + 1 from edges)""",
    "q0": "q as (select v as q from nodes where id = 0)",
    "q3": """q as (select list(x order by i) as q from (select i, avg(x) as x from (select unnest(v) as x, generate_subscripts(v, 1) as i from nodes where significance = 3) group by i))""",
    "life": f"life as (select *, (2.0 * access_count + 10.0 * significance) / power(greatest({AS_OF} - last_access_ts, 0) / 3600.0 + 2, 1.8) as life from nodes)",
    "bio": "bio as (select *, significance / 255.0 * 0.4 + least(life / 10.0, 1.0) * 0.3 + least(access_count / 100.0, 1.0) * 0.3 as bio from life)",
    "members": """members as (
  select significance::bigint as cluster_id, significance::bigint as root_id, id as node_id, row_number() over (partition by significance order by id) - 1 as pos from nodes
  union all select 10 + significance * 5 + id % 5, significance, id, row_number() over (partition by 10 + significance * 5 + id % 5 order by id) - 1 from nodes)""",
    "centroids": """parts as (select m.cluster_id, unnest(n.v) as x, generate_subscripts(n.v, 1) as i from members m join nodes n on n.id = m.node_id),
means as (select cluster_id, i, avg(x) as x from parts group by all),
centroids as (select cluster_id, list(x order by i) as c from means group by cluster_id)""",
    "clusters": f"""anchored as (
  select m.cluster_id, m.root_id, m.node_id, n.significance, row_number() over (partition by m.cluster_id order by {_cos("n.v", "c.c")} * 0.7 + n.significance / 9.0 * 0.3 desc, m.pos) as best from members m join nodes n on n.id = m.node_id join centroids c using (cluster_id)),
clusters as (
  select cluster_id, case when cluster_id = root_id then null else root_id end as parent_id, root_id, case when cluster_id = root_id then 0 else 1 end as depth, max(case when best = 1 then node_id end) as anchor_id, avg(significance) as significance, count(*) as size
  from anchored group by cluster_id, root_id)""",
    "rootsim": f"rootsim as (select k.cluster_id, k.significance, {_cos('q.q', 'c.c')} as sim from clusters k join centroids c using (cluster_id), q where k.parent_id is null)",
    "top30": f"cand as (select id from nodes, q order by {_cos('q.q', 'v')} desc, id limit 30)",
    "ccand": "near as (select * from (select * from rootsim order by sim desc, cluster_id limit 3) where sim > 0.4), cand as (select m.node_id as id from near n join members m using (cluster_id) order by n.sim desc, n.cluster_id, m.pos limit 30)",
    "coherence": f"""firsts as (select id, nb, count(*) over (partition by id) as deg, row_number() over (partition by id order by ord) as r from adj),
coherence as (
  select f.id, sum(({_cos("q.q", "b.v")} + {_cos("a.v", "b.v")}) / 2) / least(max(f.deg), 5) as coherence from firsts f join nodes a on a.id = f.id join nodes b on b.id = f.nb, q where f.r <= 5 group by f.id)""",
    "graph": """counted as (select a.id, count(*) as deg, count(c.id) as hits from adj a left join cand c on c.id = a.nb group by a.id),
graph as (select id, least(1.0, least(deg / 10.0, 1.0) * 0.3 + hits / greatest((select count(*) from cand), 1)::double * 0.4 + coherence * 0.3) as graph from counted join coherence using (id))""",
    "pool": "hop1 as (select id from cand union select a.nb from adj a join cand c on c.id = a.id), pool as (select id from hop1 union select a.nb from adj a join hop1 h on h.id = a.id)",
    "cscore": "cscore as (select m.node_id as id, max(greatest(r.sim * 0.7 + r.significance / 255.0 * 0.3, 0)) as cluster_score from rootsim r join members m using (cluster_id) group by m.node_id)",
    "legend": """legend as (select cluster_id, size as node_count, significance, cluster_id / greatest(10, 1)::double * 360 as hue from clusters where parent_id is null)""",
}
_COLOUR = """(select '#' || printf('%02X', cast(floor((r + m) * 255) as int)) || printf('%02X', cast(floor((g + m) * 255) as int)) || printf('%02X', cast(floor((b + m) * 255) as int)) from (
  select m, case k when 0 then c when 1 then x when 2 then 0 when 3 then 0 when 4 then x else c end as r, case k when 0 then x when 1 then c when 2 then c when 3 then x else 0 end as g, case k when 0 then 0 when 1 then 0 when 2 then x when 3 then c when 4 then c else x end as b from (
    select (1 - abs(2 * 0.55::double - 1)) * 0.75::double as c, 0.55::double - (1 - abs(2 * 0.55::double - 1)) * 0.75::double / 2 as m, cast(floor(hue) as int) // 60 as k, (1 - abs(2::double - 1.1)) * 0.0 as unused, (1 - abs(2 * 0.55::double - 1)) * 0.75::double * (1 - abs(hue / 60.0::double - 2 * floor(hue / 120.0::double) - 1)) as x)))"""


def _channel(shift: str) -> str:
    h = f"(hue + {shift} - floor(hue + {shift}))"
    high, low = "(0.55::double + 0.75::double - 0.55::double * 0.75::double)", "(2 * 0.55::double - (0.55::double + 0.75::double - 0.55::double * 0.75::double))"
    x = f"case when {h} < 1 / 6.0::double then {low} + ({high} - {low}) * {h} * 6 when {h} < 0.5 then {high} when {h} < 2 / 3.0::double then {low} + ({high} - {low}) * (2 / 3.0::double - {h}) * 6 else {low} end"
    return f"cast(round_even(({x}) * 255, 0) as int)"


_PALETTE = f"printf('#%02x%02x%02x', {_channel('1 / 3.0::double')}, {_channel('0')}, {_channel('-1 / 3.0::double')})"


def _sql(ctes: str, select: str) -> str:
    return "with " + ",\n".join(_CTES[c] for c in ctes.split()) + "\n" + select


_CLUSTERS = "nodes members centroids clusters"
_HYBRID = f"""
select row_number() over (order by score desc, id) as rank, id, round(score, 6) as score from (
  select n.id, 0.5 * {_cos("q.q", "n.v")} + 0.3 * coalesce(g.graph, 0) + 0.15 * n.bio + %s as score from bio n join pool p on p.id = n.id left join graph g on g.id = n.id %s, q) where score >= 0.25 order by score desc, id limit 10"""
_HYBRID_INDEX = _sql("nodes links adj q0 life bio top30 coherence graph pool", _HYBRID % ("0.0", ""))
_HYBRID_PARTS = ("0.05 * coalesce(c.cluster_score, 0)", "left join cscore c on c.id = n.id")


ORACLE_SQL: dict[str, str] = {
    "node_scan": _sql("nodes", "select id, left(content, 30) as label, significance, access_count, last_access_ts from nodes"),
    "point_lookup": _sql("nodes", "select id, content from nodes where id = 7"),
    "heap_layout": _sql("nodes", "select id, octet_length(encode(content)) as data_len, coalesce(sum(octet_length(encode(content))) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as data_offset from nodes"),
    "knn_search": _sql("nodes q0", f"select row_number() over (order by s desc, id) as rank, id, round(s, 6) as score from (select id, {_cos('q.q', 'v')} as s from nodes, q) order by s desc, id limit 10"),
    "pairwise_cosine": _sql("nodes", f"select a.id as a, b.id as b, round({_cos('a.v', 'b.v')}, 6) as sim from nodes a join nodes b on a.id < b.id where {_cos('a.v', 'b.v')} >= 0.35"),
    "auto_link": _sql("nodes links", "select src, dst, round(sim, 6) as sim, rank from links"),
    "adjacency": _sql("nodes links adj", "select id, string_agg(nb, ',' order by ord) as neighbours from adj group by id"),
    "neighbor_lookup": _sql("nodes links adj", "select nb, row_number() over (order by ord) as place from adj where id = 3"),
    "degree": _sql("nodes links adj", "select id, count(*) as degree from adj group by id"),
    "undirected_edges": _sql("nodes links", "select distinct least(src, dst) as source, greatest(src, dst) as target from links"),
    "directed_edges": _sql("nodes links adj", "select id as source, nb as target from adj"),
    "expand_2hop": _sql("nodes links adj", "select id from (values (0::bigint), (1), (2)) s(id) union select nb from adj where id in (0, 1, 2) union select nb from adj where id in (select nb from adj where id in (0, 1, 2))"),
    "add_edge_validation": "select n as seq, src, dst from (values (0::bigint, 0::bigint, 1::bigint), (1, 0, 1), (2, 2, 2), (3, 0, 999999999), (4, 5, 7)) e(n, src, dst) where src in (select vec_id from embeddings) and dst in (select vec_id from embeddings)",
    "life_score": _sql("nodes life", "select id, round(life, 6) as life from life"),
    "vacuum_candidates": _sql("nodes life", "select id from life where life < 0.5"),
    "bio_score": _sql("nodes life bio", "select id, round(bio, 6) as bio from bio"),
    "graph_score": _sql("nodes links adj q0 top30 coherence graph", "select n.id, round(coalesce(g.graph, 0), 6) as graph from nodes n left join graph g on g.id = n.id"),
    "coherence": _sql("nodes links adj q0 coherence", "select id, round(coherence, 6) as coherence from coherence"),
    "access_update": _sql("nodes", "select n.id, n.access_count + coalesce(e.n, 0) as access_count, coalesce(e.t, n.last_access_ts) as last_access_ts from nodes n left join (select user_id as id, count(*) as n, cast(floor(epoch(max(ts))) as bigint) + 3600 as t from events group by user_id) e using (id)"),
    "hybrid_search_index": _HYBRID_INDEX,
    "hybrid_search_clustered": _sql(f"{_CLUSTERS} links adj q3 rootsim life bio ccand coherence graph pool cscore", _HYBRID % _HYBRID_PARTS),
    "hybrid_search_no_match": _sql(f"{_CLUSTERS} links adj q0 rootsim life bio ccand coherence graph pool cscore", _HYBRID % _HYBRID_PARTS),
    "cluster_candidates": _sql(f"{_CLUSTERS} q3 rootsim ccand", "select id from cand"),
    "cluster_score": _sql(f"{_CLUSTERS} q3 rootsim cscore", "select id, round(cluster_score, 6) as cluster_score from cscore"),
    "cluster_list": _sql(_CLUSTERS, "select k.cluster_id, any_value(k.anchor_id) as anchor_id, string_agg(m.node_id, ',' order by m.pos) as members, round(any_value(k.significance), 6) as significance from clusters k join members m using (cluster_id) where k.parent_id is null group by k.cluster_id"),
    "cluster_centroids": _sql("nodes members centroids", "select cluster_id, i - 1 as i, round(x, 6) as x from means"),
    "cluster_anchors": _sql(_CLUSTERS, "select cluster_id, anchor_id from clusters"),
    "cluster_significance": _sql(_CLUSTERS, "select cluster_id, size, round(significance, 6) as significance from clusters"),
    "cluster_stats": _sql(_CLUSTERS, "select count(*) as n_clusters, round(avg(size), 6) as avg_size, round(avg(significance), 6) as avg_significance from clusters where parent_id is null"),
    "cluster_cohesion": _sql("nodes members", f"select a.cluster_id, round(avg({_cos('x.v', 'y.v')}), 6) as cohesion from members a join members b on a.cluster_id = b.cluster_id and a.pos < b.pos join nodes x on x.id = a.node_id join nodes y on y.id = b.node_id group by a.cluster_id"),
    "cluster_search": _sql("nodes members q0", f"select row_number() over (order by s desc, pos) as rank, id, round(s, 6) as score from (select m.node_id as id, m.pos, {_cos('q.q', 'n.v')} as s from members m join nodes n on n.id = m.node_id, q where m.cluster_id = 3) order by s desc, pos limit 10"),
    "node_clusters": _sql("nodes members", "select node_id, cluster_id, case when cluster_id = root_id then 0 else 1 end as depth from members"),
    "deepest_cluster": _sql("nodes members", "select node_id, cluster_id from members where cluster_id <> root_id"),
    "cluster_tree_text": _sql(_CLUSTERS, "select cluster_id, repeat('  ', depth) || printf('Cluster %d (anchor: %d, %d nodes, sig: %.2f)', cluster_id, anchor_id, size, significance) as line from clusters"),
    "cluster_legend": _sql(f"{_CLUSTERS} legend", f"select cluster_id, {_COLOUR} as colour, node_count, round(significance, 6) as significance from legend"),
    "cluster_colors": f"select cluster_id, {_COLOUR} as colour from (select range as cluster_id, range / 10::double * 360 as hue from range(24))",
    "graph_nodes_library": _sql("nodes members", "select n.id, left(n.content, 30) as label, n.significance, m.cluster_id from nodes n left join members m on m.node_id = n.id and m.cluster_id <> m.root_id"),
    "graph_nodes_export": _sql(f"{_CLUSTERS} legend", f"select n.id, left(n.content, 30) as label, n.content, n.significance, l.cluster_id, {_COLOUR} as colour from nodes n join legend l on l.cluster_id = n.significance"),
    "graph_stats": _sql("nodes links", "select (select count(*) from nodes) as node_count, (select count(*) from (select distinct least(src, dst), greatest(src, dst) from links)) as edge_count, (select count(distinct significance) from nodes) as cluster_count"),
    "circular_layout": _sql("nodes", """, placed as (
  select id, significance, row_number() over (partition by significance order by id) - 1 as j, count(*) over (partition by significance) as n from nodes),
groups as (select significance, row_number() over (order by min(id)) - 1 as i, count(*) over () as many from nodes group by significance)
select id, round(cos(2 * pi() * i / many) * 300 + cos(2 * pi() * j / n) * least(100, 8 * n), 6) as x, round(sin(2 * pi() * i / many) * 300 + sin(2 * pi() * j / n) * least(100, 8 * n), 6) as y from placed join groups using (significance)""".lstrip()),
    "node_style": _sql("nodes q0", f"""select id, case when hit then 'search_hit' when significance = 3 then 'highlighted' else 'normal' end as kind, round((significance * 3 + 15) * case when hit then 1.5 else 1.0 end, 6)::double as size, round(significance / 9.0 * 6 + 2, 6)::double as ui_size
from (select *, id in (select id from nodes, q order by {_cos("q.q", "v")} desc, id limit 10) as hit from nodes) where significance >= 2"""),
    "edge_style": _sql("nodes links q0", f""", hits as (select id from nodes, q order by {_cos("q.q", "v")} desc, id limit 10), kept as (select id from nodes where significance >= 2)
select distinct least(src, dst) as source, greatest(src, dst) as target, case when src in (from hits) or dst in (from hits) then 'gold' else 'grey' end as colour from links where src in (from kept) and dst in (from kept)""".lstrip()),
    "rag_context": f"select string_agg(content, chr(10) order by rank) as context from ({_HYBRID_INDEX}) h join (select e.vec_id as id, coalesce(d.text, 'Node ' || e.vec_id) as content from embeddings e left join documents d on d.doc_id = e.vec_id) n using (id) where rank <= 5",
    "snapshot_event": _sql(f"{_CLUSTERS} links legend", f"""select 'graph_snapshot' as type, 0::bigint as first_node, (select {_COLOUR} from legend where cluster_id = (select significance from nodes where id = 0)) as first_colour, (select count(*) from nodes where significance = 3) as size_of_3, (select count(*) from (select distinct least(src, dst), greatest(src, dst) from links)) as n_edges"""),
    "snapshot_roundtrip": _sql("nodes links adj", "select id, content, significance, access_count, last_access_ts, null::bigint as src, null::bigint as dst from nodes union all select seq, null, null, null, null, src, dst from edges"),
    "stream_ingest": _sql("nodes links", "select src, dst, round(sim, 6) as sim, rank from links"),
    "delta_events": _sql("nodes links", """, many as (select max(id) + 1 as n, max(id) + 1 - (max(id) + 1) // 10 as old from nodes)
select 'node_added' as type, '{"id":' || id || ',"significance":' || significance || '}' as data from nodes, many where id >= old
union all select distinct 'edge_added', '{"source":' || least(src, dst) || ',"target":' || greatest(src, dst) || '}' from links, many where greatest(src, dst) >= old
union all select 'cluster_updated', '{"id":' || significance || ',"node_count":' || count(*) || '}' from nodes, many group by significance, old having count(*) <> count(*) filter (id < old)""".lstrip()),
    "event_fold": _sql(f"{_CLUSTERS} links legend", f""", painted as (select cluster_id, {_COLOUR} as colour from legend), many as (select max(id) + 1 - (max(id) + 1) // 10 as old from nodes)
select 'node' as kind, id, null::bigint as target, case when id < old then colour end as color from nodes join painted on cluster_id = significance, many
union all select distinct 'edge', least(src, dst), greatest(src, dst), null from links
union all select 'cluster', cluster_id, null, colour from painted""".lstrip()),
    "cluster_palette": _sql("nodes members", f"select cluster_id, {_PALETTE} as colour from (select cluster_id, (row_number() over (order by cluster_id) - 1) / count(*) over ()::double as hue from (select distinct cluster_id from members))"),
    "hit_colours": _sql("nodes q0", f"select id, printf('#%02x%02x%02x', 255, cast(round_even((1.0::double - (r - 1) / 10.0::double * 0.5::double) * 0.8::double * 255, 0) as int), 0) as colour from (select id, row_number() over (order by {_cos('q.q', 'v')} desc, id) as r from nodes, q) where r <= 10"),
    "node_tooltips": _sql("nodes q0 life", f"""select id, 'Node ' || id || chr(10) || case when r <= 10 then printf('\U0001f3af Search Score: %.3f', s) || chr(10) else '' end || 'Cluster: ' || case when significance = 0 then 'None' else significance::varchar end || chr(10) || 'Significance: ' || significance || '/9' || chr(10) || printf('Life Score: %.2f', life) || chr(10) || '---' || chr(10) || left(content, 100) || '...' as title,
  case when r <= 10 then '\u2b50 ' else '' end || id || ': ' || left(content, 30) || '...' as display_label
from (select *, {_cos('q.q', 'v')} as s, row_number() over (order by {_cos('q.q', 'v')} desc, id) as r from life, q)"""),
    "similarity_to_all": _sql("nodes q3", f"select id, round({_cos('q.q', 'v')}, 6) as sim from nodes, q"),
}
