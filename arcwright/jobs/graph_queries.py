"""The registered graph queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import new_path, settle
from arcwright.operators import adjacency, blocks, compare, connectivity, containers, distance, edits, families, flow, matching, pairs, report, stats
from arcwright.operators.model import Graphs
from arcwright.sources import graph_text
from arcwright.sources.fixtures import load, oracle_prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, graph: str, work: Callable[[Graphs], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: work(load(spark, sf_dir, graph))
    if sql is not None:
        recursive, body = ("recursive ", sql) if "union\n" in sql or "recursive" in sql else ("", sql)
        ctes, _, final = body.replace("recursive:", "").rpartition("----")
        ORACLES[name] = f"with {recursive}{oracle_prelude(graph)}{',' + ctes if ctes.strip() else ''}\n{final}"


def all_pairs(g: Graphs) -> DataFrame:
    """All ordered pairs of each graph; for small graphs."""
    return distance.all_sources(g).join(g.vertices.select("graph_id", F.col("vid").alias("t")), "graph_id")


def _array_as_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


# adjacency
register("edge_multiplicity", "cs", adjacency.edge_multiplicity, "select graph_id, u, v, mult from mult")
register("edge_multiplicity_directed", "trade", adjacency.edge_multiplicity, "select graph_id, u, v, mult from mult")
register("underlying_multiplicity", "cs", adjacency.underlying_multiplicity, "select graph_id, u, v, ucount from upairs")
register("weight_matrix", "trade", adjacency.weight_matrix, "select graph_id, u, v, min_w from arcs")
_LIST = "select graph_id, u, string_agg(cast(v as varchar), ',' order by v) as neighbours from {} group by all"
register("out_neighbours", "click", lambda g: _array_as_text(adjacency.out_neighbours(g), "neighbours"), _LIST.format("arcs"))
register("underlying_neighbours", "purchases", lambda g: _array_as_text(adjacency.underlying_neighbours(g), "neighbours"), _LIST.format("nbrs"))
_PAIRS = "p as (select a.graph_id, a.vid as s, b.vid as t from vertices a join vertices b on a.graph_id = b.graph_id)"
register(
    "count_between",
    "click",
    lambda g: adjacency.count_between(g, all_pairs(g)),
    f"""{_PAIRS}
----select p.graph_id, s, t, coalesce(m.mult, 0) as n_arcs, case when s = t then coalesce(m.mult, 0) else coalesce(n.ucount, 0) end as n_joining
from p left join mult m on m.graph_id = p.graph_id and m.u = s and m.v = t left join nbrs n on n.graph_id = p.graph_id and n.u = s and n.v = t""",
)
register(
    "binary_adjacency",
    "click",
    adjacency.binary_adjacency,
    f"""{_PAIRS}
----select p.graph_id, s as u, string_agg(case when a.u is null then '0' else '1' end, '' order by t) as cells
from p left join arcs a on a.graph_id = p.graph_id and a.u = s and a.v = t group by p.graph_id, s""",
)
register("degrees", "cs", adjacency.degrees, "select graph_id, vid, degree, indeg, outdeg, cast(loops as bigint) as loops from deg")
register("degrees_directed", "trade", adjacency.degrees, "select graph_id, vid, degree, cast(indeg as bigint) as indeg, cast(outdeg as bigint) as outdeg, cast(loops as bigint) as loops from deg")
register("isolated_vertices", "daily", adjacency.isolated_vertices, "select d.graph_id, d.vid, v.name from deg d join vertices v on v.graph_id = d.graph_id and v.vid = d.vid where degree = 0")
register("loop_vertices", "trade", adjacency.loop_vertices, "select graph_id, src as vid, count(*) as loops from edges where src = dst group by all")
_ONCE = "select graph_id, count(*) as k from arcs join graphs using (graph_id) where (directed or u < v){} group by all"
register("distinct_arcs", "click", adjacency.distinct_arcs, f"x as ({_ONCE.format('')})\n----select graph_id, coalesce(k, 0) as distinct_arcs from graphs left join x using (graph_id)")
register("parallel_pairs", "order", adjacency.parallel_pairs, f"x as ({_ONCE.format(' and mult > 1')})\n----select graph_id, coalesce(k, 0) as parallel_pairs from graphs left join x using (graph_id)")
_FLAGS = """sf as (select g.graph_id,
  not exists (select 1 from edges e where e.graph_id = g.graph_id and src = dst) as no_loop,
  coalesce((select max(mult) from arcs a where a.graph_id = g.graph_id), 0) as most,
  coalesce((select max(ucount) from upairs a where a.graph_id = g.graph_id), 0) as umost from graphs g)"""
register("simple_flags", "click", adjacency.simple_flags, f"{_FLAGS}\n----select graph_id, no_loop and most <= 1 as is_simple, no_loop and umost <= 1 as is_underlying_simple, most > 1 as has_parallel from sf")
register(
    "parallel_slots",
    "local",
    adjacency.parallel_slots,
    """select graph_id, eid, cast(row_number() over (partition by graph_id, least(src, dst), greatest(src, dst) order by eid) - 1 as integer) as slot,
  count(*) over (partition by graph_id, least(src, dst), greatest(src, dst)) as slots, src > dst as reversed from edges""",
)

# statistics
_SIZE = "sz as (select g.graph_id, g.directed, (select count(*) from vertices v where v.graph_id = g.graph_id) as n, (select count(*) from edges e where e.graph_id = g.graph_id) as m from graphs g)"
register("order_size", "click", stats.order_size, f"{_SIZE}\n----select graph_id, n, m, case when directed then 'digraph' else 'graph' end as kind from sz")
_DENSITY = f"""{_SIZE}, da as ({_ONCE.format("")}), den as (
  select graph_id, n, m, directed, coalesce(k, 0) as k, case when n < 2 then 0 else coalesce(k, 0) / (case when directed then n * (n - 1) else n * (n - 1) / 2 end) end as density from sz left join da using (graph_id))"""
register(
    "density",
    "click",
    stats.density,
    f"""{_DENSITY}\n----select graph_id, round(density, 9) as density, case when n < 2 then 'n/a' when density <= 0.3 then 'Sparse' when density >= 0.7 then 'Dense' else 'Moderate' end as label,
  case when n >= 2 then floor(round(density, 9) * 100 + 0.5)::bigint end as percent from den""",
)
register("weight_summary", "local", stats.weight_summary, "select graph_id, sum(weight) as total, min(weight) as lightest, max(weight) as heaviest from graphs left join edges using (graph_id) group by all")
_KINDS = "k3 as (select graph_id, vid, 'total' as kind, degree from deg union all select graph_id, vid, 'in', indeg from deg union all select graph_id, vid, 'out', outdeg from deg)"
register("degree_stats", "cs", stats.degree_stats, f"{_KINDS}\n----select graph_id, kind, min(degree) as least, max(degree) as most, round(sum(degree) / count(*), 9) as mean from k3 group by all")
register(
    "degree_distribution",
    "cs",
    stats.degree_distribution,
    f"""{_KINDS}
----select graph_id, kind, degree, count(*) as freq, round(100.0::double * count(*) / (select count(*) from vertices v where v.graph_id = k3.graph_id), 9) as percent, min(vid) as first_vid
from k3 group by graph_id, kind, degree""",
)
_NAMES = f"""{_KINDS}, dm as (select k3.graph_id, kind, degree, k3.vid, name from k3 join vertices v on v.graph_id = k3.graph_id and v.vid = k3.vid)"""
register("degree_members", "daily", stats.degree_members, f"{_NAMES}\n----select * from dm")
register("degree_names", "mix", lambda g: stats.degree_names(g, 3), f"""{_NAMES}, dn as (select *, row_number() over (partition by graph_id, kind, degree order by vid) as r from dm)
----select graph_id, kind, degree, count(*) as freq, string_agg(name, ', ' order by vid) filter (r <= 3) as names, greatest(count(*) - 3, 0) as more from dn group by graph_id, kind, degree""")

# connectivity
_REACH = """reach as (
  select graph_id, vid as u, vid as v from vertices
  union
  select r.graph_id, r.u, n.v from reach r join nbrs n on n.graph_id = r.graph_id and n.u = r.v),
roots as (select graph_id, u as vid, min(v) as root from reach group by all)"""
# least labels, one row a vertex: ends on whole tables where listing all reached pairs does not
_LABELS = """roots(graph_id, vid, root) using key (graph_id, vid) as (
  select graph_id, vid, vid from vertices
  union
  select n.graph_id, n.v, min(r.root) from roots r join nbrs n on n.graph_id = r.graph_id and n.u = r.vid join recurring.roots o on o.graph_id = n.graph_id and o.vid = n.v
  where r.root < o.root group by n.graph_id, n.v)"""
register("connected_components", "purchases", connectivity.connected_components, f"recursive:{_LABELS}\n----select graph_id, vid, dense_rank() over (partition by graph_id order by root) - 1 as component from roots")
register("connected_components_corpus", "local", connectivity.connected_components, f"recursive:{_REACH}\n----select graph_id, vid, dense_rank() over (partition by graph_id order by root) - 1 as component from roots")
register("component_count", "local", connectivity.component_count, f"recursive:{_REACH}\n----select graph_id, count(distinct root) as components, count(distinct root) = 1 as connected from roots group by all")
register("component_members", "basket", connectivity.component_members, f"recursive:{_LABELS}\n----select graph_id, root, count(*) as size from roots group by all")
_SUMMARY = f"""recursive:{_LABELS},
cn as (select graph_id, root, count(*) as n from roots group by all),
ce as (select e.graph_id, root, count(*) as m, count(*) filter (src = dst) as loops from edges e join roots r on r.graph_id = e.graph_id and r.vid = e.src group by all)
----select graph_id, root, n, coalesce(m, 0) as m, coalesce(m, 0) = n - 1 and coalesce(loops, 0) = 0 as is_tree from cn left join ce using (graph_id, root)"""
register("component_summary", "basket", connectivity.component_summary, _SUMMARY)
_DREACH = """dreach as (
  select graph_id, vid as u, vid as v from vertices
  union
  select r.graph_id, r.u, a.v from dreach r join arcs a on a.graph_id = r.graph_id and a.u = r.v),
sccs as (select a.graph_id, a.u as vid, min(a.v) as scc from dreach a join dreach b on b.graph_id = a.graph_id and b.u = a.v and b.v = a.u group by all)"""
register("strong_components", "click", connectivity.strong_components, f"recursive:{_DREACH}\n----select graph_id, vid, scc from sccs")
register("strong_components_trade", "trade", connectivity.strong_components, f"recursive:{_DREACH}\n----select graph_id, vid, scc from sccs")
register("strong_components_steps", "steps", connectivity.strong_components, f"recursive:{_DREACH}\n----select graph_id, vid, scc from sccs")
register("connected_components_all", "cs", connectivity.connected_components, f"recursive:{_LABELS}\n----select graph_id, vid, dense_rank() over (partition by graph_id order by root) - 1 as component from roots")
register("component_summary_all", "purchases", connectivity.component_summary, _SUMMARY)
register("strong_count", "click", connectivity.strong_count, f"recursive:{_DREACH}\n----select graph_id, count(distinct scc) as strong_components, count(distinct scc) = 1 as strongly_connected from sccs group by all")
register(
    "disconnecting_set",
    "click",
    connectivity.disconnecting_set,
    f"""recursive:{_REACH}, {_SIZE},
kk as (select v.graph_id, v.vid, count(n.u) as k from vertices v left join nbrs n on n.graph_id = v.graph_id and n.u = v.vid group by all),
lo as (select *, row_number() over (partition by graph_id order by k, vid) as r from kk),
con as (select graph_id from roots group by all having count(distinct root) = 1)
----select n.graph_id, n.v as vid from lo join nbrs n on n.graph_id = lo.graph_id and n.u = lo.vid join sz on sz.graph_id = lo.graph_id where r = 1 and k < sz.n - 1 and lo.graph_id in (select graph_id from con)""",
)

# families
register("is_complete", "click", families.is_complete, f"{_DENSITY}\n----select graph_id, k = case when directed then n * (n - 1) else n * (n - 1) / 2 end as is_complete, m = 0 as is_empty from den")
_CC = f"{_REACH}, cc as (select graph_id, count(distinct root) as comps from roots group by all)"
register(
    "is_cycle_graph",
    "click",
    families.is_cycle_graph,
    f"""recursive:{_CC}, {_SIZE}, {_FLAGS}, dd as (select graph_id, bool_and(indeg = 1 and outdeg = 1) as one, bool_and(degree = 2) as two from deg group by all)
----select graph_id, case when directed then n >= 2 and no_loop and most <= 1 and comps = 1 and one else n >= 3 and no_loop and umost <= 1 and comps = 1 and two end as is_cycle_graph
from sz join sf using (graph_id) join cc using (graph_id) join dd using (graph_id)""",
)
_FOREST = f"""recursive:{_CC}, {_SIZE}, {_FLAGS}, hub as (select graph_id, max(k) as k, arg_min(u, [-k, u]) as u from (select v.graph_id, v.vid as u, count(n.u) as k from vertices v left join nbrs n on n.graph_id = v.graph_id and n.u = v.vid group by all) group by all),
ff as (select sz.graph_id, no_loop and m = n - comps as is_forest, no_loop and m = n - comps and comps = 1 as is_tree,
  no_loop and m = n - comps and comps = 1 and umost <= 1 and coalesce(k, 0) = n - 1 as is_star,
  case when no_loop and m = n - comps and comps = 1 and umost <= 1 and coalesce(k, 0) = n - 1 then u end as centre
from sz join sf using (graph_id) join cc using (graph_id) left join hub using (graph_id))"""
register("forest_flags", "local", families.forest_flags, f"{_FOREST}\n----select * from ff")
register("forest_flags_orders", "order", families.forest_flags, f"{_FOREST}\n----select * from ff")
register(
    "is_cyclic",
    "click",
    families.is_cyclic,
    f"""recursive:{_DREACH}
----select graph_id, exists (select 1 from edges e where e.graph_id = g.graph_id and src = dst) or exists (select 1 from sccs s where s.graph_id = g.graph_id group by scc having count(*) > 1) as is_cyclic from graphs g""",
)
_PARITY = """par as (
  select graph_id, vid as u, vid as v, 0 as side from vertices
  union
  select r.graph_id, r.u, n.v, 1 - r.side from par r join nbrs n on n.graph_id = r.graph_id and n.u = r.v),
pr as (select graph_id, u, min(v) as root from par group by all),
odd as (select distinct graph_id from par where u = v and side = 1 union select graph_id from edges where src = dst)"""
_BIPARTITE = f"""recursive:{_PARITY}, {_SIZE}, {_FLAGS},
cc as (select graph_id, count(distinct root) as comps from pr group by all),
pq as (select p.graph_id, count(distinct p.v) filter (side = 0) as p, count(distinct p.v) filter (side = 1) as q from par p join pr on pr.graph_id = p.graph_id and pr.u = p.u and p.u = pr.root group by all),
bi as (select graph_id, graph_id not in (select graph_id from odd) as is_bipartite,
  graph_id not in (select graph_id from odd) and comps = 1 and n >= 2 and no_loop and umost <= 1 and q > 0 and m = p * q as is_complete_bipartite,
  p as p0, q as q0 from sz join sf using (graph_id) join cc using (graph_id) join pq using (graph_id))
----select graph_id, is_bipartite, is_complete_bipartite, case when is_complete_bipartite then p0 end as p, case when is_complete_bipartite then q0 end as q from bi"""
for _name, _graph in (("bipartite", "click"), ("bipartite_daily", "daily"), ("bipartite_orders", "order")):
    register(_name, _graph, families.bipartite, _BIPARTITE)
register("bipartition_sides", "order", families.bipartition_sides, f"recursive:{_PARITY}\n----select p.graph_id, p.v as vid, p.side from par p join pr on pr.graph_id = p.graph_id and pr.u = p.u and p.u = pr.root")
_EULER = """recursive:{reach},
ep as (select e.graph_id, count(distinct root) as parts from edges e join roots r on r.graph_id = e.graph_id and r.vid = e.src group by all),
ds as (select graph_id, count(*) filter (degree % 2 = 1) as odd, count(*) filter (outdeg - indeg = 1) as plus, count(*) filter (outdeg - indeg = -1) as minus, count(*) filter (outdeg <> indeg) as off from deg group by all)
----select graph_id, case when parts is null then 'none' when parts > 1 then 'no'
  when (directed and off = 0) or (not directed and odd = 0) then 'yes'
  when (directed and plus = 1 and minus = 1 and off = 2) or (not directed and odd = 2) then 'semi' else 'no' end as eulerian,
  case when parts is null then 'no edges' when parts > 1 then parts || ' components have edges'
  when directed then case when off = 0 then 'every vertex is balanced' when eulerian = 'semi' then 'one vertex starts and one ends an open trail' else off || ' vertices are unbalanced' end
  when odd = 0 then 'every degree is even' else odd || ' vertices have odd degree' end as reason
from graphs join ds using (graph_id) left join ep using (graph_id)""".format(reach=_REACH)
register("eulerian_status", "click", families.eulerian_status, _EULER)
register("eulerian_status_local", "local", families.eulerian_status, _EULER)
register("eulerian_status_daily", "daily", families.eulerian_status, _EULER)
register("eulerian_status_mix", "mix", families.eulerian_status, _EULER)
_PATHS = """walk as (
  select graph_id, vid as s, vid as e, [vid] as path from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v) from walk w join arcs a on a.graph_id = w.graph_id and a.u = w.e where not list_contains(w.path, a.v))"""
register(
    "hamiltonian",
    "click",
    families.hamiltonian,
    f"""recursive:{_PATHS}, {_SIZE}
----select graph_id, n >= 2 and exists (select 1 from walk w join arcs a on a.graph_id = w.graph_id and a.u = w.e and a.v = w.s where w.graph_id = sz.graph_id and len(path) = n) as hamiltonian from sz""",
)
register("traceable", "click", families.traceable, f"recursive:{_PATHS}, {_SIZE}\n----select graph_id, exists (select 1 from walk w where w.graph_id = sz.graph_id and len(path) = n) as traceable from sz")

# distances
_HOPS = """bfs as (
  select graph_id, vid as s, vid as v, 0 as d from vertices
  union
  select b.graph_id, b.s, a.v, b.d + 1 from bfs b join {steps} a on a.graph_id = b.graph_id and a.u = b.v where b.d < {bound}),
hop as (select graph_id, s, v, min(d) as d from bfs group by all)"""
_HOP_OUT = "select a.graph_id, a.vid as s, b.vid as v, coalesce(h.d, -1) as hops from vertices a join vertices b on a.graph_id = b.graph_id left join hop h on h.graph_id = a.graph_id and h.s = a.vid and h.v = b.vid"
register("hop_distance", "click", distance.hop_distance, f"recursive:{_HOPS.format(steps='arcs', bound=5)}\n----{_HOP_OUT}")
register("underlying_hop_distance", "daily", distance.underlying_hop_distance, f"recursive:{_HOPS.format(steps='nbrs', bound=5)}\n----{_HOP_OUT}")
register("hop_distance_trade", "trade", distance.hop_distance, f"recursive:{_HOPS.format(steps='arcs', bound=25)}\n----{_HOP_OUT}")
register("hop_distance_orders", "order", distance.hop_distance, f"recursive:{_HOPS.format(steps='arcs', bound=26)}\n----{_HOP_OUT}")
_WAYS = """way as (
  select graph_id, vid as s, vid as v, [vid] as path, cast(0 as double) as d from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v), w.d + {w} from way w join arcs a on a.graph_id = w.graph_id and a.u = w.v where not list_contains(w.path, a.v)),
dist as (select graph_id, s, v, min(d) as d from way group by all)"""
_FULL = "select a.graph_id, a.vid as s, b.vid as v, coalesce(h.d, 'infinity'::double) as dist from vertices a join vertices b on a.graph_id = b.graph_id left join dist h on h.graph_id = a.graph_id and h.s = a.vid and h.v = b.vid"
register("distance_matrix", "click", distance.distance_matrix, f"recursive:{_WAYS.format(w='1')}\n----{_FULL}")
_RELAX = """rel as (
  select graph_id, vid as s, vid as v, cast(0 as double) as d, 0 as k from vertices
  union
  select graph_id, s, v, min(d), k from (select r.graph_id, r.s, a.v, r.d + a.min_w as d, r.k + 1 as k from rel r join arcs a on a.graph_id = r.graph_id and a.u = r.v where r.k < 12) x group by all),
dist as (select graph_id, s, v, min(d) as d from rel group by all)"""
register("weighted_distance", "trade", lambda g: distance.weighted_distance(g, distance.all_sources(g)), f"recursive:{_RELAX}\n----{_FULL}")
register("degree_centrality", "cs", distance.degree_centrality, f"{_SIZE}\n----select v.graph_id, v.vid, round(case when n > 1 then count(b.u) / (n - 1) else 0 end, 9) as centrality from vertices v join sz using (graph_id) left join nbrs b on b.graph_id = v.graph_id and b.u = v.vid group by v.graph_id, v.vid, n")
register(
    "closeness",
    "click",
    lambda g: distance.closeness(g, distance.all_sources(g)),
    f"""recursive:{_WAYS.format(w="1")}, {_SIZE}, r as (select graph_id, s, count(*) as reach, sum(d) as total from dist where s <> v group by all)
----select v.graph_id, v.vid, round(case when total > 0 then reach / total * reach / (n - 1) else 0 end, 9) as closeness from vertices v join sz using (graph_id) left join r on r.graph_id = v.graph_id and r.s = v.vid""",
)
register(
    "betweenness",
    "click",
    distance.betweenness,
    f"""recursive:{_WAYS.format(w="1")}, {_SIZE},
geo as (select w.graph_id, w.s, w.v as t, w.path from way w join dist d on d.graph_id = w.graph_id and d.s = w.s and d.v = w.v and d.d = w.d where w.s <> w.v),
cnt as (select graph_id, s, t, count(*) as c from geo group by all),
thru as (select g.graph_id, x.vid, sum(1.0::double / c) as b from geo g join cnt using (graph_id, s, t) join vertices x on x.graph_id = g.graph_id where list_contains(path, x.vid) and x.vid <> g.s and x.vid <> g.t group by all)
----select v.graph_id, v.vid, round(case when n > 2 then coalesce(b, 0) / ((n - 1) * (n - 2)) else 0 end, 9) as betweenness from vertices v join sz using (graph_id) left join thru on thru.graph_id = v.graph_id and thru.vid = v.vid""",
)

# without a vertex: what its least neighbour still reaches
_FLOOD = """flood as (
  select graph_id, u as gone, min(v) as v from nbrs group by all
  union
  select f.graph_id, f.gone, n.v from flood f join nbrs n on n.graph_id = f.graph_id and n.u = f.v where n.v <> f.gone)"""
_TWO = "floor(round({}, 9) * 100 + 0.5) / 100"
_VERTICES = f"""recursive:{_WAYS.format(w="{w}")}, {_SIZE}, {_FLOOD},
r as (select graph_id, s, count(*) as reach, sum(d) as total from dist where s <> v group by all),
far as (select graph_id, s, count(*) as k, max(d) as d from dist group by all),
geo as (select w.graph_id, w.s, w.v as t, w.path from way w join dist d on d.graph_id = w.graph_id and d.s = w.s and d.v = w.v and abs(d.d - w.d) < 1e-9 where w.s <> w.v),
cnt as (select graph_id, s, t, count(*) as c from geo group by all),
thru as (select g.graph_id, x.vid, sum(1.0::double / c) as b from geo g join cnt using (graph_id, s, t) join vertices x on x.graph_id = g.graph_id where list_contains(path, x.vid) and x.vid <> g.s and x.vid <> g.t group by all),
cut as (select distinct graph_id, u as vid from nbrs n where not exists (select 1 from flood f where f.graph_id = n.graph_id and f.gone = n.u and f.v = n.v)),
near as (select graph_id, u as vid, count(*) as k, min(v) as least from nbrs group by all),
under as (select graph_id, vid as u, vid as v from vertices union select x.graph_id, x.u, n.v from under x join nbrs n on n.graph_id = x.graph_id and n.u = x.v)
----select v.graph_id, v.vid, v.name, degree, indeg::bigint as indeg, outdeg::bigint as outdeg, loops::bigint as loops, degree = 0 as isolated, loops > 0 as has_loop, cut.vid is not null as cutpoint,
  coalesce(near.k, 0) as neighbours, (select min(u.v) from under u where u.graph_id = v.graph_id and u.u = v.vid) as component_root,
  far.k - 1 as reached, case when far.k = n then far.d end as eccentricity,
  {_TWO.format("case when n > 1 then coalesce(near.k, 0)::double / (n - 1) else 0 end")} as degree_centrality,
  {_TWO.format("case when total > 0 then reach / total * reach / (n - 1) else 0 end")} as closeness,
  {_TWO.format("case when n > 2 then coalesce(b, 0) / ((n - 1) * (n - 2)) else 0 end")} as betweenness
from vertices v join deg using (graph_id, vid) join sz using (graph_id) join far on far.graph_id = v.graph_id and far.s = v.vid left join cut on cut.graph_id = v.graph_id and cut.vid = v.vid
  left join near on near.graph_id = v.graph_id and near.vid = v.vid left join r on r.graph_id = v.graph_id and r.s = v.vid left join thru on thru.graph_id = v.graph_id and thru.vid = v.vid"""
register("vertex_report", "click", distance.vertex_report, _VERTICES.format(w="1"))
register("vertex_report_daily", "daily", distance.vertex_report, _VERTICES.format(w="1"))

# pairs
register(
    "pair_adjacency",
    "click",
    lambda g: pairs.pair_adjacency(g, all_pairs(g)),
    f"""{_PAIRS}
----select p.graph_id, s, t, coalesce(a.mult, 0) as n_there, coalesce(b.mult, 0) as n_back, case when s = t then coalesce(a.mult, 0) else 0 end as loops
from p left join mult a on a.graph_id = p.graph_id and a.u = s and a.v = t left join mult b on b.graph_id = p.graph_id and b.u = t and b.v = s""",
)
register(
    "pair_reachability",
    "click",
    lambda g: pairs.pair_reachability(g, all_pairs(g)),
    f"""recursive:{_WAYS.format(w="1")}, {_PAIRS}
----select p.graph_id, p.s, p.t, d is not null as reachable, cast(coalesce(d, -1) as integer) as hops, d as weight from p left join dist on dist.graph_id = p.graph_id and dist.s = p.s and dist.v = p.t""",
)
_TEXT = "array_to_string(path, ',')"
register(
    "simple_paths",
    "click",
    lambda g: _array_as_text(pairs.simple_paths(g, all_pairs(g)), "path"),
    f"recursive:{_PATHS}\n----select graph_id, s, e as t, cast(row_number() over (partition by graph_id, s, e order by len(path), path) - 1 as integer) as path_no, {_TEXT} as path from walk",
)
register("path_lengths", "click", lambda g: pairs.path_lengths(g, all_pairs(g)), f"recursive:{_PATHS}\n----select graph_id, s, e as t, cast(min(len(path) - 1) as integer) as shortest, cast(max(len(path) - 1) as integer) as longest, count(*) as paths from walk group by all")
_GEO = f"recursive:{_WAYS.format(w='1')}, geo as (select w.graph_id, w.s, w.v as t, w.path from way w join dist d on d.graph_id = w.graph_id and d.s = w.s and d.v = w.v and d.d = w.d)"
register("geodesics", "click", lambda g: _array_as_text(pairs.geodesics(g, all_pairs(g)), "path"), f"{_GEO}\n----select graph_id, s, t, {_TEXT} as path from geo")
register(
    "geodesic_edges",
    "click",
    lambda g: pairs.geodesic_edges(g, all_pairs(g)),
    f"""{_GEO}, st as (select distinct graph_id, s, t, path[i] as u, path[i + 1] as v from geo, range(1, 6) r(i) where i < len(path))
----select distinct st.graph_id, s, t, (select min(eid) from edges e where e.graph_id = st.graph_id and e.src = st.u and e.dst = st.v) as eid from st""",
)
register(
    "path_weight",
    "trade",
    lambda g: pairs.path_weight(g, pairs.geodesics(g, all_pairs(g), most=1000)).select(*pairs.KEY, "weight").distinct(),
    f"recursive:{_RELAX}\n----select graph_id, s, v as t, d as weight from dist where s <> v",
)
_TRAILS = """recursive:tr as (
  select graph_id, vid as s, vid as e, []::bigint[] as trail from vertices
  union
  select t.graph_id, t.s, x.dst, list_append(t.trail, x.eid) from tr t join edges x on x.graph_id = t.graph_id and x.src = t.e where not list_contains(t.trail, x.eid)),
ok as (select *, row_number() over (partition by graph_id, s, e order by trail) as r from tr where s <> e or len(trail) > 0)
----select graph_id, s, e as t, cast(row_number() over (partition by graph_id, s, e order by len(trail), trail) - 1 as integer) as trail_no, array_to_string(trail, ',') as trail from ok where r <= 300"""
for _name in ("trails", "trails_daily"):
    register(_name, "daily", lambda g: _array_as_text(pairs.trails(g, all_pairs(g)), "trail"), _TRAILS)
register(
    "walk_counts",
    "click",
    lambda g: pairs.walk_counts(g, all_pairs(g)),
    f"""recursive:{_SIZE}, {_PAIRS}, wc as (
  select graph_id, vid as s, vid as v, 0 as length, cast(1 as bigint) as c from vertices
  union
  select graph_id, s, v, length, cast(sum(c) as bigint) from (select w.graph_id, w.s, m.v, w.length + 1 as length, w.c * m.mult as c from wc w join mult m on m.graph_id = w.graph_id and m.u = w.v where w.length < 8) y group by all)
----select p.graph_id, p.s, p.t, cast(l.i as integer) as length, coalesce(c, 0)::decimal(38,0) as walks from p join sz using (graph_id) join range(1, 9) l(i) on l.i <= least(greatest(n, 4), 8)
left join wc on wc.graph_id = p.graph_id and wc.s = p.s and wc.v = p.t and wc.length = l.i""",
)
# s = t: out and back; else the first geodesic with its first step that can be gone back doubled
_EXAMPLE = f"""{_GEO}, g1 as (select graph_id, s, t, min(path) as path from geo where s <> t group by all),
mut as (select a.graph_id, a.u, a.v from arcs a join arcs b on b.graph_id = a.graph_id and b.u = a.v and b.v = a.u),
turn as (select g1.graph_id, g1.s, g1.t, g1.path, min(i) as i from g1, range(1, 30) r(i), mut m where i < len(path) and m.graph_id = g1.graph_id and m.u = path[i] and m.v = path[i + 1] group by all),
ew as (select graph_id, u as s, u as t, [u, min(v), u] as walk from mut group by graph_id, u
  union all select graph_id, s, t, list_concat(path[:i + 1], path[i:]) from turn)
----select graph_id, s, t, array_to_string(walk, ',') as walk from ew"""
for _name, _graph in (("example_walk", "click"), ("example_walk_daily", "daily")):
    register(_name, _graph, lambda g: _array_as_text(pairs.example_walk(g, all_pairs(g)), "walk"), _EXAMPLE)
register(
    "semipath",
    "click",
    lambda g: _array_as_text(pairs.semipath(g, all_pairs(g)), "path"),
    """recursive:uw as (
  select graph_id, vid as s, vid as e, [vid] as path from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v) from uw w join nbrs a on a.graph_id = w.graph_id and a.u = w.e where not list_contains(w.path, a.v)),
rk as (select *, row_number() over (partition by graph_id, s, e order by len(path), path) as r from uw)
----select graph_id, s, e as t, array_to_string(path, ',') as path from rk where r = 1""",
)

_ARROWS = """recursive:uw as (
  select graph_id, vid as s, vid as e, [vid] as path from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v) from uw w join nbrs a on a.graph_id = w.graph_id and a.u = w.e where not list_contains(w.path, a.v)),
best as (select graph_id, s, e as t, arg_min(path, list_prepend(len(path), path)) as path from uw group by all),
spot as (select b.graph_id, s, t, directed, i, path[i - 1] as p, path[i] as v from best b join graphs using (graph_id), range(1, 8) r(i) where i <= len(path)),
st as (select y.graph_id, s, t, i, x.name, case when i = 1 then '' when not directed then ' – ' when f.u is not null and k.u is not null then ' ↔ ' when f.u is not null then ' → ' else ' ← ' end as sign, i = 1 or f.u is not null as forth
  from spot y join vertices x on x.graph_id = y.graph_id and x.vid = y.v left join arcs f on f.graph_id = y.graph_id and f.u = y.p and f.v = y.v left join arcs k on k.graph_id = y.graph_id and k.u = y.v and k.v = y.p)
----select graph_id, s, t, string_agg(sign || name, '' order by i) as semipath, bool_and(forth) as directed_path from st group by graph_id, s, t"""
register("semipath_arrows", "daily", pairs.semipath_arrows, _ARROWS)
register("semipath_arrows_mix", "mix", pairs.semipath_arrows, None)


def _pair_report(g: Graphs) -> DataFrame:
    r = pairs.pair_report(g, all_pairs(g))
    listed = [F.array_join(F.transform(c, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), ";").alias(c) for c in ("geodesics", "paths", "trails")]
    walks = F.array_join(F.transform("walk_counts", lambda x: x.cast("string")), ",").alias("walk_counts")
    walk = F.array_join(F.transform("example_walk", lambda x: x.cast("string")), ",").alias("example_walk")
    return r.select(*pairs.KEY, "n_there", "n_back", "loops", "reachable", "hops", "weight", "n_geodesics", "more_geodesics", "shortest_path", "longest_path", "n_paths", "more_paths", "n_trails", "more_trails", "longest_trail", *listed, walks, walk, "semipath", "directed_path")


register("pair_report", "daily", _pair_report, None)

# comparison
register("complement", "click", compare.complement, "select a.graph_id, a.vid as u, b.vid as v from vertices a join vertices b on a.graph_id = b.graph_id and a.vid <> b.vid where not exists (select 1 from arcs x where x.graph_id = a.graph_id and x.u = a.vid and x.v = b.vid)")
register("complement_size", "purchases", compare.complement_size, f"{_DENSITY}\n----select graph_id, cast(case when directed then n * (n - 1) else n * (n - 1) / 2 end - k as bigint) as complement_size from den")


def next_pairs(g: Graphs, part: str = "@") -> DataFrame:
    """Graph pairs to compare: each graph and the next one of the same user (all one user without ``part``)."""
    user = F.split_part("graph_id", F.lit(part), F.lit(1)) if part == "@" else F.lit(0)
    order = F.col("graph_id") if part == "@" else F.col("graph_id").cast("long")
    after = F.lead("graph_id").over(Window.partitionBy(user).orderBy(order))
    return g.graphs.select(F.col("graph_id").alias("a_id"), after.alias("b_id")).filter("b_id is not null")


_NEXT_DAY = "gp as (select * from (select graph_id as a_id, lead(graph_id) over (partition by split_part(graph_id, '@', 1) order by graph_id) as b_id from graphs) z where b_id is not null)"
_GPAIRS = "gp as (select * from (select graph_id as a_id, lead(graph_id) over (order by cast(graph_id as bigint)) as b_id from graphs) z where b_id is not null)"
register(
    "label_subgraph",
    "click",
    lambda g: compare.label_subgraph(g, g, next_pairs(g, "")),
    f"""{_GPAIRS}, nm as (select m.graph_id, x.name as un, y.name as vn, mult from mult m join vertices x on x.graph_id = m.graph_id and x.vid = m.u join vertices y on y.graph_id = m.graph_id and y.vid = m.v),
al as (select gp.a_id, gp.b_id, x.name as un, y.name as vn from gp join vertices x on x.graph_id = gp.a_id join vertices y on y.graph_id = gp.a_id),
cmp as (select al.a_id, al.b_id, bool_and(coalesce(p.mult, 0) <= coalesce(q.mult, 0)) as le, bool_and(coalesce(p.mult, 0) = coalesce(q.mult, 0)) as eq
  from al left join nm p on p.graph_id = al.a_id and p.un = al.un and p.vn = al.vn left join nm q on q.graph_id = al.b_id and q.un = al.un and q.vn = al.vn group by all),
lab as (select gp.a_id, gp.b_id, bool_and(exists (select 1 from vertices y where y.graph_id = gp.b_id and y.name = x.name)) as all_in, count(*) as na,
  (select count(*) from vertices y where y.graph_id = gp.b_id) as nb from gp join vertices x on x.graph_id = gp.a_id group by gp.a_id, gp.b_id)
----select a_id, b_id, all_in and le as is_subgraph, all_in and eq as is_induced, all_in and eq and na = nb as same_labelled from lab join cmp using (a_id, b_id)""",
)
_NUMBERS = "m0 as (select a.graph_id, a.vid as u, b.vid as v, coalesce(m.mult, 0) as c from vertices a join vertices b on a.graph_id = b.graph_id left join mult m on m.graph_id = a.graph_id and m.u = a.vid and m.v = b.vid)"
# every injective image of a_id's vertices, held against all pairs of them; the least in the order of falling degree
_IMAGES = f"""recursive:{_NEXT_DAY}, {_SIZE}, img as (
  select gp.a_id, gp.b_id, []::bigint[] as image, x.n as n from gp join sz x on x.graph_id = a_id join sz y on y.graph_id = b_id where x.n {{op}} y.n and x.m {{op}} y.m
  union
  select p.a_id, p.b_id, list_append(p.image, v.vid), p.n from img p join vertices v on v.graph_id = p.b_id where len(p.image) < p.n and not list_contains(p.image, v.vid)),
{_NUMBERS}, good as (
  select f.a_id, f.b_id, f.image from img f join m0 x on x.graph_id = f.a_id join m0 y on y.graph_id = f.b_id and y.u = f.image[x.u + 1] and y.v = f.image[x.v + 1]
  where len(f.image) = f.n group by all having bool_and(x.c {{op}} y.c)),
turns as (select graph_id, list(vid order by degree desc, vid) as turn from deg group by all),
keyed as (select good.*, list_transform(turn, lambda v: image[v + 1]) as key from good join turns on turns.graph_id = a_id),
best as (select a_id, b_id, arg_min(image, key) as image from keyed group by all),
named as (select b.a_id, b.b_id, string_agg(x.name || '→' || y.name, ', ' order by x.vid) as mapping
  from best b join vertices x on x.graph_id = b.a_id join vertices y on y.graph_id = b.b_id and y.vid = b.image[x.vid + 1] group by all)
----select gp.a_id, gp.b_id, case when named.mapping is null then 'no' else 'yes' end as {{name}}, named.mapping from gp left join named using (a_id, b_id)"""


def _matched(find: Callable, g: Graphs) -> DataFrame:
    found = settle(find(g, g, next_pairs(g)), "matches")
    return found.drop("map").join(matching.mapping_string(found, g, g), matching.PAIR)


register("isomorphism", "daily", lambda g: _matched(matching.isomorphism, g), _IMAGES.format(op="=", name="isomorphic"))
register("subgraph_embedding", "daily", lambda g: _matched(matching.subgraph_embedding, g), _IMAGES.format(op="<=", name="embeds"))
register("compare_report", "daily", lambda g: compare.compare_report(g, g, next_pairs(g)), None)
register(
    "self_complementary",
    "daily",
    lambda g: matching.self_complementary(g).select("graph_id", "self_complementary"),
    f"""recursive:{_SIZE}, {_FLAGS}, cand as (select sz.graph_id, n from sz join sf using (graph_id) where no_loop and most <= 1 and 2 * m = n * (n - 1)),
perm as (
  select graph_id, []::bigint[] as image, n from cand
  union
  select p.graph_id, list_append(p.image, v.vid), p.n from perm p join vertices v on v.graph_id = p.graph_id where len(p.image) < p.n and not list_contains(p.image, v.vid)),
{_NUMBERS}, good as (
  select p.graph_id, p.image from perm p join m0 x on x.graph_id = p.graph_id join m0 y on y.graph_id = p.graph_id and y.u = p.image[x.u + 1] and y.v = p.image[x.v + 1]
  where len(p.image) = p.n group by all having bool_and(x.u = x.v or x.c + y.c = 1))
----select graph_id, graph_id in (select graph_id from good) as self_complementary from graphs""",
)

# connectivity numbers: the comparing engine tries every set of vertices
_SIDES = f"{_SIZE}, sides as (select graph_id, n, m.i as s from sz, range(1, 2048) m(i) where m.i < (1 << n) - 1)"
_LAMBDA = f"""{_SIDES}, cut as (
  select graph_id, s, coalesce(sum(mult) filter ((s >> a.u) & 1 = 1 and (s >> a.v) & 1 = 0), 0) as c from sides left join arcs a using (graph_id) group by all)
----select graph_id, case when n = 1 then 0 else (select min(c) from cut where cut.graph_id = sz.graph_id)::bigint end as edge_connectivity from sz"""
register("edge_connectivity", "daily", flow.edge_connectivity, _LAMBDA)
register("edge_connectivity_mix", "mix", flow.edge_connectivity, _LAMBDA)
_KAPPA = f"""recursive:{_SIZE}, gone as (select graph_id, n, m.i as s from sz, range(0, 2048) m(i) where m.i < (1 << n) - 1),
seen as (
  select graph_id, s, vid as u, vid as v from gone join vertices using (graph_id) where (s >> vid) & 1 = 0
  union
  select r.graph_id, r.s, r.u, a.v from seen r join arcs a on a.graph_id = r.graph_id and a.u = r.v where (r.s >> a.v) & 1 = 0),
held as (select graph_id, s, count(*) as pairs from seen group by all),
cuts as (select g.graph_id, min(bit_count(g.s)) as k from gone g join held using (graph_id, s) where pairs < (n - bit_count(g.s)) * (n - bit_count(g.s)) group by all)
----select graph_id, coalesce(k, n - 1)::bigint as vertex_connectivity from sz left join cuts using (graph_id)"""
register("vertex_connectivity", "daily", flow.vertex_connectivity, _KAPPA)
register("vertex_connectivity_click", "click", flow.vertex_connectivity, _KAPPA)
# up to 50 vertices: null above 40; held against a plain search in the tests
register("vertex_connectivity_basket", "basket", flow.vertex_connectivity, None)
register(
    "maximal_non_hamiltonian",
    "daily",
    families.maximal_non_hamiltonian,
    f"""recursive:{_SIZE}, round as (
  select graph_id, [0]::bigint[] as ring, n from sz where n >= 2
  union
  select r.graph_id, list_append(r.ring, v.vid), r.n from round r join vertices v on v.graph_id = r.graph_id where len(r.ring) < r.n and not list_contains(r.ring, v.vid)),
ends as (select graph_id, ring, ring[i] as u, ring[i % n + 1] as v from round, range(1, 6) k(i) where len(ring) = n and i <= n),
lack as (select e.graph_id, ring, count(*) filter (a.u is null) as k, min(e.u) filter (a.u is null) as u, min(e.v) filter (a.u is null) as v
  from ends e left join arcs a on a.graph_id = e.graph_id and a.u = e.u and a.v = e.v group by e.graph_id, ring),
miss as (select x.graph_id, x.vid as u, y.vid as v from vertices x join vertices y on x.graph_id = y.graph_id and x.vid <> y.vid
  where not exists (select 1 from arcs a where a.graph_id = x.graph_id and a.u = x.vid and a.v = y.vid))
----select graph_id, n >= 2 and not exists (select 1 from lack l where l.graph_id = sz.graph_id and l.k = 0)
  and not exists (select 1 from miss where miss.graph_id = sz.graph_id and not exists (select 1 from lack l where l.graph_id = miss.graph_id and l.k = 1 and l.u = miss.u and l.v = miss.v)) as maximal_non_hamiltonian
from sz""",
)

# edits and text forms
register("reverse_edges", "trade", lambda g: edits.reverse_edges(g, g.edges.filter("weight > 25").select("graph_id", "eid")), "select graph_id, eid, case when weight > 25 then dst else src end as src, case when weight > 25 then src else dst end as dst, weight from edges")
register("remove_vertices", "click", lambda g: edits.remove_vertices(g, g.vertices.filter("name = 'view'").select("graph_id", "vid")).edges, """
nv as (select graph_id, vid, row_number() over (partition by graph_id order by vid) - 1 as new from vertices where name <> 'view')
----select e.graph_id, row_number() over (partition by e.graph_id order by eid) - 1 as eid, a.new as src, b.new as dst, weight from edges e join nv a on a.graph_id = e.graph_id and a.vid = src join nv b on b.graph_id = e.graph_id and b.vid = dst""")
register("remove_edges", "local", lambda g: edits.remove_edges(g, g.edges.filter("weight > 40").select("graph_id", "eid")).edges, "select graph_id, row_number() over (partition by graph_id order by eid) - 1 as eid, src, dst, weight from edges where weight <= 40")
register("set_weights", "local", lambda g: edits.set_weights(g, g.edges.filter("weight = 30").select("graph_id", "eid", F.lit(1.5).alias("new_weight"))), "select graph_id, eid, src, dst, case when weight = 30 then 1.5 else weight end as weight from edges")
register("rename_vertices", "click", lambda g: edits.rename_vertices(g, g.vertices.filter("name = 'view'").select("graph_id", "vid", F.lit("look").alias("new_name"))), "select graph_id, vid, case when name = 'view' then 'look' else name end as name from vertices")
register("check_names", "click", lambda g: edits.check_names(g.vertices), "select graph_id, vid, name, case when length(name) > 4 then 'too long' end as reason from vertices")
register(
    "check_new_edges",
    "daily",
    lambda g: edits.check_new_edges(Graphs(g.graphs.withColumn("multi", F.lit(False)), g.vertices, g.edges), g.edges.select("graph_id", F.col("eid").alias("turn"), F.col("dst").alias("src"), F.col("src").alias("dst"))),
    """nb as (select graph_id, eid, dst as src, src as dst, row_number() over (partition by graph_id, dst, src order by eid) as r from edges)
----select graph_id, eid as turn, src, dst, case when src = dst then 'loop' when r > 1 or exists (select 1 from edges e where e.graph_id = nb.graph_id and e.src = nb.src and e.dst = nb.dst) then 'parallel' end as reason from nb""",
)
register("next_free_names", "local", lambda g: edits.next_free_names(g, 3), "select graph_id, cast(i as varchar) as name from graphs, range(0, 3) r(i)")
register("format_number", "local", lambda g: g.edges.select("graph_id", "eid", report.format_number(F.col("weight") / 8).alias("shown")), "select graph_id, eid, case when weight / 8 = floor(weight / 8) then cast(cast(weight / 8 as bigint) as varchar) else regexp_replace(printf('%.3f', weight / 8), '\\.?0+$', '') end as shown from edges")
register("round2", "local", lambda g: g.edges.select("graph_id", "eid", stats.round2(F.col("weight") / 7).alias("rounded")), "select graph_id, eid, floor(weight / 7 * 100 + 0.5) / 100 as rounded from edges")
register("path_string", "click", lambda g: report.path_string(pairs.semipath(g, all_pairs(g)), g, pairs.KEY).select(*pairs.KEY, "path_string"), """recursive:uw as (
  select graph_id, vid as s, vid as e, [vid] as path, name as shown from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v), w.shown || ' → ' || x.name from uw w join nbrs a on a.graph_id = w.graph_id and a.u = w.e join vertices x on x.graph_id = a.graph_id and x.vid = a.v where not list_contains(w.path, a.v)),
rk as (select *, row_number() over (partition by graph_id, s, e order by len(path), path) as r from uw)
----select graph_id, s, e as t, shown as path_string from rk where r = 1""")
register("overview_report", "daily", report.overview_report, None)
register("overview_report_mix", "mix", report.overview_report, None)

# blocks: the comparing engine deletes each vertex or pair and counts components anew
_GONE = """vreach as (
  select x.graph_id, x.vid as gone, a.vid as u, a.vid as v from vertices x join vertices a on a.graph_id = x.graph_id and a.vid <> x.vid
  union
  select r.graph_id, r.gone, r.u, n.v from vreach r join nbrs n on n.graph_id = r.graph_id and n.u = r.v where n.v <> r.gone),
vcomp as (select graph_id, gone, count(distinct root) as comps from (select graph_id, gone, u, min(v) as root from vreach group by all) y group by all),
cuts as (select v.graph_id, v.gone as vid from vcomp v join cc using (graph_id) where v.comps > cc.comps)"""
register("cutpoints", "click", blocks.cutpoints, f"recursive:{_CC}, {_GONE}\n----select graph_id, vid from cuts")
register(
    "nonseparable",
    "click",
    blocks.nonseparable,
    f"recursive:{_CC}, {_GONE}, {_SIZE}\n----select graph_id, comps = 1 and n >= 2 and graph_id not in (select graph_id from cuts) as nonseparable from sz join cc using (graph_id)",
)
_BRIDGES = """recursive:breach as (
  select p.graph_id, p.u as a, p.v as b, p.u as v from upairs p where ucount = 1
  union
  select r.graph_id, r.a, r.b, n.v from breach r join nbrs n on n.graph_id = r.graph_id and n.u = r.v and not (n.u = r.a and n.v = r.b) and not (n.u = r.b and n.v = r.a))
----select graph_id, u, v from upairs p where ucount = 1 and not exists (select 1 from breach r where r.graph_id = p.graph_id and r.a = p.u and r.b = p.v and r.v = p.v)"""
register("bridges", "click", blocks.bridges, _BRIDGES)
for _name, _graph in (("cutpoints_orders", "order"), ("cutpoints_basket", "basket"), ("cutpoints_local", "local")):
    register(
        _name,
        _graph,
        blocks.cutpoints,
        f"recursive:{_FLOOD}\n----select distinct graph_id, u as vid from nbrs n where not exists (select 1 from flood f where f.graph_id = n.graph_id and f.gone = n.u and f.v = n.v)",
    )
for _name, _graph in (("bridges_orders", "order"), ("bridges_basket", "basket")):
    register(_name, _graph, blocks.bridges, _BRIDGES)
# two vertices share a block if no third one parts them; a block is told by its two least vertices
_BLOCKS = f"""recursive:{_CC}, {_GONE}, {_SIZE},
whole as (select graph_id, u, v from vreach where u <> v group by graph_id, u, v, gone),
linked as (select r.graph_id, r.u, r.v from reach r join sz using (graph_id) left join whole w on w.graph_id = r.graph_id and w.u = r.u and w.v = r.v
  where r.u <> r.v group by r.graph_id, r.u, r.v, n having count(w.u) = n - 2),
heads as (select a.graph_id, a.u, a.v, row_number() over (partition by a.graph_id order by a.u, a.v) - 1 as block from linked a where a.u < a.v
  and not exists (select 1 from linked b join linked c on c.graph_id = b.graph_id and c.u = b.u where b.graph_id = a.graph_id and b.v = a.u and c.v = a.v and b.u < a.v and b.u <> a.u)),
bm as (select graph_id, block, u as vid from heads union all select graph_id, block, v from heads
  union all select h.graph_id, h.block, b.u from heads h join linked b on b.graph_id = h.graph_id and b.v = h.u join linked c on c.graph_id = h.graph_id and c.u = b.u and c.v = h.v)"""
for _name, _graph in (("block_members", "order"), ("block_members_daily", "daily")):
    register(_name, _graph, blocks.block_members, f"{_BLOCKS}\n----select graph_id, block, vid from bm")
register("block_count", "click", blocks.block_count, f"{_BLOCKS}\n----select graph_id, (select count(*) from heads h where h.graph_id = g.graph_id) as blocks from graphs g")
register("block_count_orders", "order", blocks.block_count, f"{_BLOCKS}\n----select graph_id, count(h.u) as blocks from graphs left join heads h using (graph_id) group by all")
register("wide_diameter", "click", containers.wide_diameter, None)
register("wide_diameter_daily", "daily", containers.wide_diameter, None)
register("container_detail", "daily", lambda g: _array_as_text(containers.container_detail(g), "numbers"), None)
register(
    "k_wide_distance_one",
    "click",
    lambda g: containers.k_wide_distance(g).filter("k = 1"),
    f"recursive:{_PATHS}\n----select graph_id, s, e as t, cast(1 as integer) as k, cast(min(len(path) - 1) as integer) as d_k from walk where s <> e group by all",
)
# from each path in turn, every path in order of vids that is disjoint from those taken joins it
_GREEDY = f"""recursive:{_PATHS}, way as (select graph_id, s, e as t, path[2:len(path) - 1] as inside, len(path) - 1 as length, row_number() over (partition by graph_id, s, e order by path) as r from walk where s <> e),
greedy as (
  select graph_id, s, t, r as seed, 0::bigint as i, inside as used, [length] as lengths from way
  union
  select graph_id, s, t, seed, r, case when fits then list_concat(used, inside) else used end, case when fits then list_append(lengths, length) else lengths end
  from (select f.graph_id, f.s, f.t, f.seed, f.used, f.lengths, w.inside, w.length, w.r, w.r <> f.seed and not list_has_any(f.used, w.inside) as fits from greedy f join way w on w.graph_id = f.graph_id and w.s = f.s and w.t = f.t and w.r = f.i + 1) as stepped)
----select graph_id, s, t, cast(k.i as integer) as k, cast(min(list_sort(lengths)[k.i]) as integer) as d_k from greedy, range(1, 7) k(i) where k.i <= len(lengths) group by all"""
register("k_wide_distance", "daily", containers.k_wide_distance, _GREEDY)
register("set_mode", "daily", lambda g: edits.set_mode(g, g.graphs.filter("graph_id < '5'").select("graph_id", F.lit(False).alias("directed"), F.lit(None).cast("boolean").alias("weighted"), F.lit(False).alias("multi"))).select("graph_id", "directed", "weighted", "multi"), "select graph_id, graph_id >= '5' as directed, weighted, graph_id >= '5' as multi from graphs")
register("edge_name", "daily", report.edge_name, "select e.graph_id, eid, '(' || a.name || '→' || b.name || ')' as edge_name from edges e join vertices a on a.graph_id = e.graph_id and a.vid = src join vertices b on b.graph_id = e.graph_id and b.vid = dst")
register("set_string", "daily", lambda g: report.set_string(blocks.block_members(g), g, ["graph_id", "block"]), f"{_BLOCKS}\n----select bm.graph_id, block, '{{' || string_agg(name, ',' order by bm.vid) || '}}' as text from bm join vertices v on v.graph_id = bm.graph_id and v.vid = bm.vid group by bm.graph_id, block")
register(
    "underlying_parents",
    "daily",
    lambda g: pairs.underlying_parents(g, distance.all_sources(g)),
    """recursive:uw as (
  select graph_id, vid as s, vid as e, [vid] as path from vertices
  union
  select w.graph_id, w.s, a.v, list_append(w.path, a.v) from uw w join nbrs a on a.graph_id = w.graph_id and a.u = w.e where not list_contains(w.path, a.v)),
best as (select graph_id, s, e as v, arg_min(path, list_prepend(len(path), path)) as path from uw group by all)
----select graph_id, s, v, cast(len(path) - 1 as integer) as hops, path[len(path) - 1] as parent from best""",
)


def _text_round_trip(g: Graphs) -> DataFrame:
    path = new_path(g.edges.sparkSession, "graphs")
    graph_text.write_graph_text(g, path)
    _, vertices, edges, _ = graph_text.parse_graph_text(graph_text.read_texts(g.edges.sparkSession, path))
    named = lambda end, out: vertices.select("graph_id", F.col("vid").alias(end), F.col("name").alias(out))
    return edges.join(named("src", "src_name"), ["graph_id", "src"]).join(named("dst", "dst_name"), ["graph_id", "dst"]).select("graph_id", "eid", "src_name", "dst_name", "weight")


def _adjacency_round_trip(g: Graphs) -> DataFrame:
    path = new_path(g.edges.sparkSession, "graphs")
    graph_text.write_adjacency_text(g, path)
    return graph_text.parse_adjacency_text(graph_text.read_texts(g.edges.sparkSession, path))[1]


register("graph_text", "click", _text_round_trip, "select e.graph_id, eid, a.name as src_name, b.name as dst_name, weight from edges e join vertices a on a.graph_id = e.graph_id and a.vid = src join vertices b on b.graph_id = e.graph_id and b.vid = dst")
register("adjacency_text", "local", _adjacency_round_trip, "select graph_id, u, v from upairs")
