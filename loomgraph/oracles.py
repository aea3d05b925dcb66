"""SQL equivalents of the queries, for DuckDB over the same tables."""

from __future__ import annotations

NEXT_LINE = """e as materialized (select distinct src, dst, 1.0::double as weight from (select l_partkey as src, lead(l_partkey) over
(partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where dst is not null and src <> dst)"""

SPARSE = """e as materialized (select src, dst, min(price) as weight from (select l_partkey as src, lead(l_partkey) over w as dst,
l_quantity as q, lead(l_quantity) over w as next_q, l_extendedprice as price from lineitem
window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
where dst is not null and src <> dst and q > 40 and next_q > 40 group by src, dst)"""

PRICED = SPARSE.replace(" and q > 40 and next_q > 40", "")

TOGETHER = """h as materialized (select distinct l_orderkey as o, l_partkey as p from lineitem),
e as materialized (select distinct a.p as src, b.p as dst from h a join h b on a.o = b.o where a.p <> b.p)"""

VERTICES = "v as materialized (select src as id from e union select dst from e)"
OUT = "od as materialized (select src as id, count(*) as k from e group by src)"
SOURCE = "s as materialized (select src as id from e group by src order by count(*) desc, src limit 1)"


def ranks(steps: int, graph: str = SPARSE) -> str:
    """CTEs r0 ... of PageRank: id, value, deviation."""
    parts = [graph, VERTICES, OUT, "n as materialized (select count(*) as n from v)", "r0 as materialized (select id, 1.0::double as value, 0.0::double as deviation from v)"]
    for k in range(1, steps + 1):
        parts.append(
            f"r{k} as materialized (select p.id, coalesce(g.value, p.value) as value, abs(coalesce(g.value, p.value) - p.value) as deviation from r{k - 1} p "
            f"left join (select e.dst, 0.5 * sum(r.value / od.k) + 0.5 / (select n from n) as value from e join r{k - 1} r on r.id = e.src "
            f"join od on od.id = e.src group by e.dst) g on g.dst = p.id)"
        )
    return "with " + ", ".join(parts)


def levels(graph: str, start: str, weighted: bool = False) -> str:
    """CTE d: (id, distance) of the vertices reached from the one row of ``start`` (id), to the fixpoint."""
    step = "r.distance + e.weight" if weighted else "r.distance + 1"
    return (
        f"with recursive {graph}, {VERTICES}, {start}, d(id, distance) using key (id) as (select id, 0.0::double from s union "
        f"select e.dst, min({step}) from d r join e on e.src = r.id left join recurring.d x on x.id = e.dst where x.id is null or {step} < x.distance group by e.dst)"
    )


FIRST = "s as materialized (select min(id) as id from v)"
SHOWN = "340282346638528859811704183484516925440.000000"
PAIRS = """l as materialized (select src, list_sort(list(dst)) as svalue from e group by src),
kv as materialized (select least(e.src, e.dst) as key, greatest(e.src, e.dst) as skey, l.svalue from e join l on l.src = e.src)"""

TRIANGLES = """pr as materialized (select least(src, dst) as a, greatest(src, dst) as b from e group by 1, 2 having count(*) = 2 and count(distinct src) = 2),
t as materialized (select pr.a as id, count(*) as triangles from pr join e x on x.src = pr.a and x.dst > pr.b join e y on y.src = pr.b and y.dst = x.dst group by 1)"""

ADJACENCY = "select v.id, coalesce(g.degree, 0) as degree, coalesce(g.neighbours, '') as neighbours from v left join (select src, count(*) as degree, string_agg(dst::varchar, ' ' order by dst) as neighbours from e group by src) g on g.src = v.id"

CLOSURE = "reach(a, b) as (select id, id from v union select reach.a, {to} from reach join {edges} on {on})"


def converged(steps: int = 40) -> str:
    chain = ranks(steps, NEXT_LINE)
    residuals = " union all ".join(f"select {k} as k, max(deviation) as d from r{k}" for k in range(1, steps + 1))
    every = " union all ".join(f"select {k} as k, id, value from r{k}" for k in range(1, steps + 1))
    return f"{chain} select id, round(value, 8) as rank from ({every}) where k = (select min(k) from ({residuals}) where d <= 1e-4)"


def kmeans(iterations: int = 3, k: int = 5) -> str:
    """Fixed first centres; squared distances in double precision."""
    x = "p as materialized (select vec_id as id, list_transform(embedding, lambda z: z::double) as x from embeddings)"
    parts = [x, f"c0 as materialized (select row_number() over (order by id) - 1 as c, x from (select * from p order by id limit {k}))"]
    near = "select id, arg_min(c, (d, c)) as cluster from (select p.id, c.c, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from p, {centres} c) group by id"
    for i in range(iterations):
        parts.append(f"a{i} as materialized ({near.format(centres=f'c{i}')})")
        parts.append(
            f"m{i} as materialized (select a.cluster as c, u.d, avg(u.z) as z from a{i} a join (select id, unnest(range(1, 65)) as d, unnest(x) as z from p) u on u.id = a.id group by 1, 2)"
        )
        parts.append(f"c{i + 1} as materialized (select c0.c, coalesce((select list(z order by d) from m{i} m where m.c = c0.c), c0.x) as x from c{i} c0)")
    return "with " + ", ".join(parts) + " " + near.format(centres=f"c{iterations}")


def sql() -> dict[str, str]:
    nl, sp, pr = (f"with {graph}, {VERTICES}" for graph in (NEXT_LINE, SPARSE, PRICED))
    moved = "deviation > 1e-4"
    out = {
        "S1_edge_list_scan": f"{nl} select src + 1 as src, dst + 1 as dst from e" .replace("src + 1", "src + (select case when min(src) = 0 then 1 else 0 end from e)").replace("dst + 1", "dst + (select case when min(src) = 0 then 1 else 0 end from e)"),
        "S2_data_lines": "select n_nationkey || ' ' || n_regionkey as line from nation where n_nationkey % 3 = 2",
        "S3_adjacency": f"{nl} select * from ({ADJACENCY}) where degree > 0",
        "S5_isolated_vertices": f"{pr}, {OUT} select g.id, coalesce(od.k, 0) as out_degree from (select unnest(range(1, (select max(id) from v) + 1)) as id) g left join od on od.id = g.id",
        "S7_hash_partition": f"{nl} select id, (id % 3)::int as part from v",
        "S8_neighbour_owner": f"{nl} select src, dst, (dst % 3)::int as loc from e",
        "S9_subgraphs": f"{nl} select src, dst, (src % 3)::int as part, (dst % 3)::int as loc from e",
        "S10_out_degree": f"{pr}, {OUT} select v.id, coalesce(od.k, 0) as out_degree from v left join od on od.id = v.id",
        "S11_in_degree": f"{pr} select v.id, coalesce(g.k, 0) as in_degree from v left join (select dst, count(*) as k from e group by dst) g on g.dst = v.id",
        "S12_summary": f"{nl} select a.part, a.n_vertices, coalesce(b.n_edges, 0) as n_edges from (select (id % 3)::int as part, count(*) as n_vertices from v group by 1) a left join (select (src % 3)::int as part, count(*) as n_edges from e group by 1) b on a.part = b.part",
        "S13_dump": f"{pr} {ADJACENCY}",
        "S14_path_lines": f"{levels(NEXT_LINE, FIRST)} select v.id, 'path_len(' || (select id from s) || ',' || v.id || '):' || coalesce(format('{{:.6f}}', d.distance), '{SHOWN}') as line from v left join d on d.id = v.id".replace("|| ',' ||", "|| ', ' ||"),
        "S15_integer_scan": "select o_custkey as v, count(*) as n from orders group by 1",
        "D1_initial_state": f"{nl}, {OUT} select v.id, coalesce(od.k, 0) as out_degree, 1.0::double as value, true as active from v left join od on od.id = v.id",
        "D2_active_filter": f"{ranks(1)} select id from r1 where {moved}",
        "D3_message_counts": f"{ranks(1)} select (e.dst % 3)::int as part, count(*) as n_messages from e join r1 on r1.id = e.src where {moved} group by 1",
        "D4_messages": f"{pr} select dst, src, 1.0::double as value, weight from e",
        "D5_shuffle": f"{pr} select (src % 4)::int as part, (dst % 4)::int as loc, dst, src, 1.0::double as value, weight from e",
        "D11_map_received": f"{pr} select (dst % 3)::int as part, dst as key, src as skey, 1.0::double + weight as value from e",
        "D6_message_order": f"{nl} select dst, src, row_number() over (order by dst, src) as position from e",
        "D7_predecessor_cache": f"{ranks(1)} select e.dst, e.src, round(case when {moved} then r1.value else 1.0 end, 8) as value, e.weight from e join r1 on r1.id = e.src",
        "D8_touched_vertices": f"{ranks(1)} select distinct e.dst as id from e join r1 on r1.id = e.src where {moved}",
        "D9_materialised": f"{pr} select v.id, 1.0::double as value, coalesce(a.t, '') as targets, coalesce(b.t, '') as sources from v left join (select src, string_agg(dst::varchar, ' ' order by dst) as t from e group by 1) a on a.src = v.id left join (select dst, string_agg(src::varchar, ' ' order by src) as t from e group by 1) b on b.dst = v.id",
        "D10_map_pairs": f"{pr}, {PAIRS} select key, skey, 1.0::double as value, len(svalue) as n_svalue from kv",
        "D12_pair_order": f"{pr}, {PAIRS} select key, skey, n, row_number() over (order by key, skey) as position from (select key, skey, count(*) as n from kv group by 1, 2)",
        "D14_group_by_key": f"{pr}, {PAIRS} select key, count(*) as n_pairs, count(distinct skey) as n_skeys from kv group by 1",
        "D15_group_by_pair": f"{pr}, {PAIRS} select key, skey, count(*) as n_pairs from kv group by 1, 2",
        "D16_reduce": f"{pr} select dst as key, round(max(weight) - min(weight), 6) as value from e group by 1",
        "D17_reduce_sum": f"{ranks(1, PRICED)} select id as dst, round(value, 8) as value from r1 where id in (select dst from e)",
        "D18_reduce_min": f"{pr} select dst, min(weight) as value from e group by 1",
        "D19_common_targets": f"{nl} select least(x.src, x.dst) as key, greatest(x.src, x.dst) as skey, (select count(*) from e a join e b on a.dst = b.dst where a.src = x.src and b.src = x.dst and a.dst > x.dst) as n_common from e x join e y on x.src = y.dst and x.dst = y.src where x.src < x.dst",
        "D20_update_cover": f"{ranks(1, PRICED)} select id, round(value, 8) as value from r1",
        "D21_update_accumulate": f"{pr} select v.id, 2.0 * coalesce(g.k, 0) as value from v left join (select dst, count(*) as k from e group by 1) g on g.dst = v.id",
        "D22_status": f"{ranks(2)} select id, {moved} as active from r2",
        "D23_residual": f"{ranks(2, PRICED)} select round(max(deviation), 8) as residual from r2",
        "D24_termination": f"{ranks(3)} select count(*) filter ({moved}) as n_active, (count(*) filter (not ({moved})) * 10000 // count(*))::bigint as converged from r3",
        "D25_iteration_cap": f"{ranks(3, PRICED)} select id, round(value, 8) as value from r3",
        "D27_metrics": f"{levels(NEXT_LINE, FIRST)}, {OUT}, n as (select count(*) as n from v) select step::int as step, round(100.0::double * (1 - (select count(*) from d where distance = step) / (select n from n)), 6) as converged_pct, 0.0::double as residual, 0.0::double as least_residual, (select sum(k)::bigint from d join od on od.id = d.id where distance = step - 1) as messages, (select 16 * sum(k)::bigint from d join od on od.id = d.id where distance = step - 1) as bytes from (select unnest(range(1, (select max(distance)::bigint + 2 from d))) as step)",
        "D29_errors": "select * from (values ('no header', 'GraphError'), ('malformed line', 'GraphError'), ('edge count', 'GraphError'), ('vertex range', 'GraphError'), ('none', 'read'), ('no file', 'FileNotFoundError')) t(fault, outcome)",
        "S14_written_result": f"{levels(NEXT_LINE, FIRST)} select v.id, d.distance as value from v left join d on d.id = v.id",
        "O4_sorted_values": "select p_brand, string_agg(p_name, '|' order by p_name) as names from part group by 1",
        "O6_sorted_edges": f"{pr} select dst, src, weight, row_number() over (order by dst, src) as position from e",
        "O7_sorted_keys": "select o_custkey as key, o_orderkey as skey, row_number() over (order by o_custkey, o_orderkey) as position from orders",
        "U3_reduce_in_python": f"{pr} select v.id, coalesce(g.m, 0.0::double) as median from v left join (select dst, round(median(weight), 4) as m from e group by 1) g on g.dst = v.id",
        "D28_totals": f"{levels(NEXT_LINE, FIRST)} select count(*) as messages, count(*) * 16 as bytes from d join e on e.src = d.id",
        "A1_pagerank": converged(),
        "A1_pagerank_fixed": f"{ranks(10)} select id, round(value, 8) as rank from r10",
        "A2_shortest_paths": f"{levels(NEXT_LINE, FIRST)} select v.id, d.distance from v left join d on d.id = v.id",
        "A2_shortest_paths_weighted": f"{levels(SPARSE, SOURCE, True)} select v.id, round(d.distance, 4) as distance from v left join d on d.id = v.id",
        "A2_shortest_paths_sentinel": f"{levels(SPARSE, SOURCE)} select v.id, coalesce(d.distance, 3.4028234663852886e38::double) as distance from v left join d on d.id = v.id",
        "A3_triangles": f"with {TOGETHER}, {VERTICES}, {TRIANGLES} select v.id, coalesce(t.triangles, 0) as triangles from v left join t on t.id = v.id",
        "A3_triangle_total": f"with {TOGETHER}, {TRIANGLES} select coalesce(sum(triangles), 0)::bigint as triangles from t",
        "A3_triangles_directed": f"{nl}, {TRIANGLES} select v.id, coalesce(t.triangles, 0) as triangles from v left join t on t.id = v.id",
        "A4_matrix_product": f"{sp} select a.src as i, b.dst as j, sum(round(100 * a.weight)::bigint * round(100 * b.weight)::bigint)::bigint as value from e a join e b on a.dst = b.src group by 1, 2",
        "A5_breadth_first": f"{levels(SPARSE, SOURCE)} select id, distance::bigint as level from d",
        "A6_connected_components": f"with recursive {SPARSE}, {VERTICES}, u as materialized (select src, dst from e union select dst, src from e), {CLOSURE.format(to='u.dst', edges='u', on='u.src = reach.b')} select a as id, min(b) as component from reach group by a",
        # an edge is in the forest unless lighter edges connect its ends
        "A7_spanning_forest": f"with recursive {SPARSE}, u as materialized (select *, row_number() over (order by weight, src, dst) as k from (select least(src, dst) as src, greatest(src, dst) as dst, min(weight) as weight from e group by 1, 2)), b as materialized (select src, dst, k from u union all select dst, src, k from u), reach(k, id) as (select k, src from u union select reach.k, b.dst from reach join b on b.src = reach.id and b.k < reach.k) select src, dst, weight from u where (k, dst) not in (select k, id from reach)",
        "A8_strong_components": f"with recursive {SPARSE}, {VERTICES}, {CLOSURE.format(to='e.dst', edges='e', on='e.src = reach.b')} select x.a as id, min(x.b) as component from reach x join reach y on x.a = y.b and x.b = y.a group by x.a",
        "A9_kmeans": kmeans(),
        "O1_sample_sort": "select v, min(position) as first, max(position) as last from (select o_custkey as v, row_number() over (order by o_custkey) as position from orders) group by v",
        "O2_sorted_ranges": "select count(*)::bigint as n, min(o_custkey) as low, max(o_custkey) as high, 0::bigint as overlaps from orders",
        "O3_sorted_lists": "select l_orderkey, string_agg(l_quantity::int::varchar, ' ' order by l_quantity) as quantities from lineitem group by 1",
        "O5_sorted_pairs": "select c_custkey, row_number() over (order by c_acctbal, c_custkey) as position from customer",
        "U1_vertex_program": f"{pr}, h1 as materialized (select id, max(x) as x from (select id, id as x from v union all select dst, src from e) group by 1), h2 as materialized (select id, max(x) as x from (select * from h1 union all select e.dst, h1.x from e join h1 on h1.id = e.src) group by 1), h3 as materialized (select id, max(x) as x from (select * from h2 union all select e.dst, h2.x from e join h2 on h2.id = e.src) group by 1) select id, x as largest from h3",
        "U2_map_in_python": f"{pr} select least(src, dst) as key, count(*) as n, round(sum(weight), 2) as value from e group by 1",
    }
    out["S4_renumbered"] = out["S1_edge_list_scan"]
    out["S6_validation"] = f"{nl} select (max(id) + (select case when min(src) = 0 then 1 else 0 end from e))::bigint as n_vertices, (select count(*) from e) as n_edges from v"
    return out
