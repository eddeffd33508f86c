"""DuckDB SQL for the core queries; tables are registered under their names."""

from __future__ import annotations

SPM = "SELECT o_custkey AS i, l_partkey AS c, SUM(l_quantity) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"
GRAPH = "SELECT src, dst FROM (SELECT l_partkey src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) dst FROM lineitem {where}) WHERE dst IS NOT NULL"
PARTS = GRAPH.format(where="")
SINKS = GRAPH.format(where="WHERE l_quantity >= 45")
NATIONS = "SELECT c_nationkey::BIGINT src, s_nationkey::BIGINT dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
VEC = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS x, round(o_totalprice) AS y FROM orders"
MAT = """SELECT a.r_regionkey::BIGINT i, b.r_regionkey::BIGINT j, count(l_orderkey)::BIGINT v FROM region a CROSS JOIN region b
LEFT JOIN (SELECT nc.n_regionkey ri, ns.n_regionkey rj, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey) t ON t.ri = a.r_regionkey AND t.rj = b.r_regionkey GROUP BY 1, 2"""
PTS = "SELECT vec_id id, (generate_subscripts(embedding, 1) - 1)::BIGINT j, unnest(embedding)::DOUBLE x, CASE WHEN label = 3 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END y FROM embeddings"


def pagerank(edges: str, vertices: str) -> str:
    """Power iteration with the stop rule, as a recursive query."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}),
ek AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) k FROM e),
r AS (
  SELECT 0 it, id, 1.0::DOUBLE / count(*) OVER () pr, count(*) OVER () n, 1.0::DOUBLE delta FROM ({vertices})
  UNION ALL
  SELECT it + 1, id, npr, n, sqrt(sum((npr - pr) * (npr - pr)) OVER ()) FROM (
    SELECT r.it, r.id, r.n, r.pr, 0.15::DOUBLE / r.n + 0.85::DOUBLE * coalesce(a.acc, 0) npr
    FROM r LEFT JOIN (SELECT ek.dst, sum(r.pr / ek.k) acc FROM r JOIN ek ON ek.src = r.id GROUP BY 1) a ON a.dst = r.id
    WHERE r.it < 100 AND NOT (r.it >= 3 AND r.delta < 1e-9)))
SELECT id, round(pr + 1e-13::DOUBLE, 9) pr FROM r WHERE it = (SELECT max(it) FROM r)"""


def knn(measure: str, minsim: float, k: int | None) -> str:
    m, term, own, sim = SPM, "a.v * b.v", "sum(v * v)", "dot / (x.n + y.n - dot)"
    if measure == "dot":
        sim = "dot"
    elif measure == "cosine":
        m = f"SELECT i, c, v / sqrt(sum(v * v) OVER (PARTITION BY i)) v FROM ({SPM})"
        sim = "dot"
    elif measure == "minmax":
        term, own = "least(a.v, b.v)", "sum(v)"
    top = "" if k is None else f"WHERE rank <= {k}"
    out = "round(sim, 6)" if measure == "cosine" else "sim"
    return f"""WITH m AS MATERIALIZED ({m}), nr AS (SELECT i, {own} n FROM m GROUP BY 1),
d AS (SELECT a.i q, b.i h, sum({term}) dot FROM m a JOIN m b USING (c) GROUP BY 1, 2),
s AS (SELECT q, h, {sim} sim FROM d JOIN nr x ON x.i = q JOIN nr y ON y.i = h),
k AS (SELECT q AS query, h AS neighbor, row_number() OVER (PARTITION BY q ORDER BY sim DESC, h) AS rank, sim FROM s WHERE sim >= {minsim})
SELECT query, neighbor, {'rank, ' if measure != 'cosine' else ''}{out} AS sim FROM k {top}"""


def normalize(what: str, norm: int) -> str:
    key = {"row": "i", "col": "c"}[what]
    s = f"sum({'v * v' if norm == 2 else 'v'}) OVER (PARTITION BY {key})"
    scaled = f"v / sqrt({s})" if norm == 2 else f"v / {s}"
    return f'SELECT i AS "row", c AS col, round({scaled}, 9) AS val FROM ({SPM})'


_PAGERANK_REPORT = pagerank(PARTS, "SELECT p_partkey id FROM part")
_PAGERANK_REPORT = f"SELECT max(it)::BIGINT iterations, max(n)::BIGINT n FROM ({_PAGERANK_REPORT[: _PAGERANK_REPORT.rindex('SELECT id')]}SELECT it, n FROM r)"

ORACLES = {
    "graph_out_degree": f"SELECT p_partkey id, count(src)::BIGINT degree FROM part LEFT JOIN ({SINKS}) ON src = p_partkey GROUP BY 1",
    "graph_out_degree_whole": f"SELECT p_partkey id, count(src)::BIGINT degree FROM part LEFT JOIN ({PARTS}) ON src = p_partkey GROUP BY 1",
    "graph_sinks": f"SELECT p_partkey id FROM part WHERE p_partkey NOT IN (SELECT src FROM ({SINKS}))",
    "graph_push": f"WITH e AS ({PARTS}), k AS (SELECT src, count(*) n FROM e GROUP BY 1) SELECT dst, round(sum(1.0::DOUBLE / n), 6) acc FROM e JOIN k USING (src) GROUP BY 1",
    "graph_reverse": f"SELECT dst, src, count(*)::BIGINT n_edges FROM ({PARTS}) GROUP BY 1, 2",
    "graph_incoming": f"WITH n AS (SELECT count(*) n FROM part) SELECT least((dst // (n // 7)), 6)::BIGINT owner, src, count(*)::BIGINT n_edges FROM ({PARTS}), n GROUP BY 1, 2",
    "graph_owner_blocks": "WITH n AS (SELECT count(*) n FROM part) SELECT p_partkey id, least((p_partkey // (n // 7)), 6)::BIGINT AS owner FROM part, n",
    "graph_sorted_adjacency": f"SELECT src, string_agg(dst::VARCHAR, ' ' ORDER BY dst) nbrs FROM ({PARTS}) GROUP BY 1",
    "pagerank_parts": pagerank(PARTS, "SELECT p_partkey id FROM part"),
    "pagerank_sinks": pagerank(SINKS, "SELECT p_partkey id FROM part"),
    "pagerank_nation": pagerank(NATIONS, "SELECT n_nationkey::BIGINT id FROM nation"),
    "pagerank_report": _PAGERANK_REPORT,
    "csr_stats": f"SELECT count(DISTINCT i)::BIGINT n_rows, count(DISTINCT c)::BIGINT n_cols, count(*)::BIGINT nnz, (SELECT max(k) FROM (SELECT count(*) k FROM ({SPM}) GROUP BY i))::BIGINT max_row FROM ({SPM})",
    "csr_compact_columns": f'SELECT i AS "row", (dense_rank() OVER (ORDER BY c) - 1)::BIGINT AS col, v AS val FROM ({SPM}) WHERE v >= 60',
    "csr_column_map": f"SELECT c AS col, (row_number() OVER (ORDER BY c) - 1)::BIGINT AS new_col FROM (SELECT DISTINCT c FROM ({SPM}) WHERE v >= 60)",
    "csr_compact_columns_whole": f'SELECT i AS "row", (dense_rank() OVER (ORDER BY c) - 1)::BIGINT AS col, v AS val FROM ({SPM})',
    "csr_column_map_whole": f"SELECT c AS col, (row_number() OVER (ORDER BY c) - 1)::BIGINT AS new_col FROM (SELECT DISTINCT c FROM ({SPM}))",
    "csr_row_sqnorms": f'SELECT i AS "row", sum(v * v) AS norm FROM ({SPM}) GROUP BY 1',
    "csr_col_sqnorms": f"SELECT c AS col, sum(v * v) AS norm FROM ({SPM}) GROUP BY 1",
    "csr_binary_norms": f'SELECT i AS "row", count(*)::DOUBLE AS norm FROM ({SPM}) GROUP BY 1',
    "csr_normalize_row_l1": normalize("row", 1),
    "csr_normalize_row_l2": normalize("row", 2),
    "csr_normalize_col_l1": normalize("col", 1),
    "csr_normalize_col_l2": normalize("col", 2),
    "csr_normalize_both_l2": f'SELECT i AS "row", c AS col, round(v / sqrt(sum(v * v) OVER (PARTITION BY c)), 9) AS val FROM (SELECT i, c, v / sqrt(sum(v * v) OVER (PARTITION BY i)) v FROM ({SPM}))',
    "csr_normalize_both_l1": f'SELECT i AS "row", c AS col, round(v / sum(v) OVER (PARTITION BY c), 9) AS val FROM (SELECT i, c, v / sum(v) OVER (PARTITION BY i) v FROM ({SPM}))',
    "csr_inverted_index": f"SELECT c AS col, string_agg(i::VARCHAR || ':' || v::BIGINT::VARCHAR, ' ' ORDER BY i, v) AS entries FROM ({SPM}) GROUP BY 1",
    "csr_row_index": f"""SELECT i AS "row", string_agg(c::VARCHAR || ':' || v::BIGINT::VARCHAR, ' ' ORDER BY c, v) AS entries FROM ({SPM}) GROUP BY 1""",
    "csr_pointers": f'SELECT i AS "row", (sum(count(*)) OVER (ORDER BY i) - count(*))::BIGINT AS ptr FROM ({SPM}) GROUP BY 1',
    "csr_slice_rows": f'SELECT i - 100 AS "row", c AS col, v AS val FROM ({SPM}) WHERE i >= 100 AND i < 400',
    "knn_jaccard": knn("jaccard", 0.05, 10),
    "knn_dot": knn("dot", 400, 10),
    "knn_cosine": knn("cosine", 0.1, None),
    "knn_minmax": knn("minmax", 0.05, 10),
    "knn_close": knn("jaccard", 0.4, 10),
    "knn_all": knn("jaccard", 0.05, None),
    "knn_query": f"WITH m AS ({SPM}), q AS (SELECT c, v FROM m WHERE i = (SELECT min(i) FROM m)), d AS (SELECT m.i h, sum(m.v * q.v) dot FROM m JOIN q USING (c) GROUP BY 1), n AS (SELECT i, sum(v * v) n FROM m GROUP BY 1), z AS (SELECT sum(v * v) n FROM q) SELECT h AS neighbor, dot / (n.n + z.n - dot) AS sim FROM d JOIN n ON n.i = h, z WHERE dot / (n.n + z.n - dot) >= 0.02 ORDER BY sim DESC, neighbor LIMIT 20",
    "sort_keys": "SELECT (row_number() OVER (ORDER BY l_partkey) - 1)::BIGINT pos, l_partkey AS value FROM lineitem",
    "sort_values": "SELECT l_partkey AS value FROM lineitem",
    "sort_locally": "SELECT l_partkey AS value FROM lineitem",
    "sort_balanced_blocks": "WITH k AS (SELECT row_number() OVER (ORDER BY l_partkey) - 1 pos, l_partkey AS value, count(*) OVER () n FROM lineitem) SELECT pos::BIGINT pos, value, least(pos // (n // 7), 6)::BIGINT block FROM k",
    "sort_pivot": 'SELECT floor(quantile_cont(l_partkey, 0.5))::BIGINT AS "pivot" FROM lineitem',
    "sort_pivot_split": 'WITH p AS (SELECT floor(quantile_cont(l_partkey, 0.5))::BIGINT AS "pivot" FROM lineitem), n AS (SELECT "pivot", (count(*) FILTER (WHERE l_partkey < "pivot"))::BIGINT lesser, (count(*) FILTER (WHERE l_partkey >= "pivot"))::BIGINT greater FROM lineitem, p GROUP BY 1) SELECT "pivot", lesser, greater, (CASE WHEN lesser / (lesser + greater) * 7 < 1 THEN ceil(lesser / (lesser + greater) * 7) ELSE floor(lesser / (lesser + greater) * 7) END)::BIGINT parts_lesser FROM n',
    "sort_check": "SELECT 0::BIGINT n_bad",
    "sort_check_input": "SELECT count(*)::BIGINT n_bad FROM (SELECT o_custkey v, lag(o_custkey) OVER (ORDER BY o_orderkey) p FROM orders) WHERE v < p",
    "prefix_scan": "SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey)::BIGINT AS before FROM orders",
    "kv_sort_desc": "SELECT o_totalprice AS key, o_orderkey AS val FROM orders",
    "kv_topk": "SELECT o_totalprice AS key, o_orderkey AS val FROM orders ORDER BY key DESC, val LIMIT 25",
    "time_span": "SELECT min(l_shipdate)::DATE first_start, max(l_shipdate)::DATE last_stop FROM lineitem",
    "vec_sum": f"SELECT round(sum(x), 2) AS sum FROM ({VEC}) WHERE i % 3 = 0",
    "vec_dot": f"SELECT sum(y * y) AS dot FROM ({VEC})",
    "vec_norm2": f"SELECT round(sqrt(sum(y * y)), 6) AS norm FROM ({VEC})",
    "vec_scale": f"SELECT i, y * 2.5::DOUBLE AS x FROM ({VEC})",
    "vec_axpy": f"SELECT i, y + x * 0.5::DOUBLE AS y FROM ({VEC})",
    "vec_max": f"SELECT max(x) AS max FROM ({VEC})",
    "vec_min": f"SELECT min(x) AS min FROM ({VEC})",
    "vec_argmax": f"SELECT i FROM ({VEC}) ORDER BY x DESC, i LIMIT 1",
    "vec_argmin": f"SELECT i FROM ({VEC}) ORDER BY x, i LIMIT 1",
    "vec_argmax_n": f"SELECT i FROM ({VEC}) ORDER BY x DESC, i LIMIT 1 OFFSET 6",
    "vec_incset": "SELECT i, (i + 5)::DOUBLE AS x FROM range(1000) t(i)",
    "vec_fill": "SELECT i, 7.5::DOUBLE AS x FROM range(1000) t(i)",
    "vec_fill2d": "SELECT i, j, 2.0::DOUBLE AS x FROM range(20) t(i), range(30) u(j)",
    "vec_clamp": f"SELECT i, least(greatest(x, 1000.0::DOUBLE), 100000.0::DOUBLE) AS x FROM ({VEC})",
    "lc_nonzero_columns": f"SELECT j, (row_number() OVER (ORDER BY j) - 1)::BIGINT new_j FROM (SELECT j FROM ({PTS}) GROUP BY 1 HAVING bool_or(x <> 0))",
    "lc_denominators": f"SELECT j, round(sum(x * x), 6) denominator FROM ({PTS}) GROUP BY 1 HAVING sum(x * x) > 0",
    "lc_mat_vec": f"SELECT id, round(sum(x * 0.5::DOUBLE), 6) xw FROM ({PTS}) GROUP BY 1",
    "lc_squared_error": f"SELECT round(sum((xw - y) * (xw - y)), 4) error FROM (SELECT id, sum(x * 0.5::DOUBLE) xw, max(y) y FROM ({PTS}) GROUP BY 1)",
    "mat_vec": f"SELECT a.i, sum(a.v * x.v)::BIGINT v FROM ({MAT}) a JOIN (SELECT r_regionkey::BIGINT j, (r_regionkey + 1)::BIGINT v FROM region) x USING (j) GROUP BY 1",
    "mat_mat": f"WITH a AS ({MAT}) SELECT a.i, b.j, sum(a.v * b.v)::BIGINT v FROM a JOIN a b ON a.j = b.i GROUP BY 1, 2",
    "mat_mat_purchases": f"WITH p AS MATERIALIZED ({SPM}) SELECT a.i, b.i AS j, sum(a.v * b.v) v FROM p a JOIN p b USING (c) GROUP BY 1, 2",
    "gauss_upper": f"""WITH RECURSIVE m AS MATERIALIZED ({MAT}), big AS (SELECT max(v) * count(DISTINCT i) d, count(DISTINCT i) n FROM m),
a AS (SELECT i, j, (v + CASE WHEN i = j THEN d ELSE 0 END)::DOUBLE v FROM m, big UNION ALL SELECT r_regionkey, n, (r_regionkey + 1)::DOUBLE FROM region, big),
s AS (SELECT 0 k, list(r ORDER BY i) m FROM (SELECT i, list(v ORDER BY j) r FROM a GROUP BY 1)
UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i - 1 < k THEN row WHEN i - 1 = k THEN list_transform(row, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(row, lambda x, c: x - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM s WHERE k < (SELECT n FROM big)),
f AS (SELECT unnest(m) r, generate_subscripts(m, 1) - 1 i FROM s WHERE k = (SELECT n FROM big))
SELECT i::BIGINT i, (generate_subscripts(r, 1) - 1)::BIGINT j, round(unnest(r), 9) v FROM f""",
    "demo_dot_partials": "SELECT i // 100000 AS part, count(*)::DOUBLE AS partial FROM range(400000) t(i) GROUP BY 1",
    "demo_dot_total": "SELECT 400000.0::DOUBLE AS total",
    "demo_trig": "SELECT task, round(sum(sin(i::DOUBLE) * tan(i::DOUBLE)), 4) AS total FROM range(15) t(task), range(1000) u(i) GROUP BY 1",
    "demo_threshold": "SELECT 12::BIGINT fired_at, 145::BIGINT final",
    "demo_fill": "SELECT i, j, round((i * j)::DOUBLE / 3.452::DOUBLE + (1000 - i), 6) AS v FROM range(1000) t(i), range(1000) u(j)",
}

#: Coordinate descent by a recursive query over the Gram matrix, two sweeps.
_LC = f"""WITH RECURSIVE p AS MATERIALIZED ({PTS}),
g AS MATERIALIZED (SELECT list(r ORDER BY j) m FROM (SELECT j, list(v ORDER BY k) r FROM (SELECT a.j, b.j k, sum(a.x * b.x) v FROM p a JOIN p b USING (id) GROUP BY 1, 2) GROUP BY 1)),
b AS MATERIALIZED (SELECT list(v ORDER BY j) b FROM (SELECT j, sum(x * y) v FROM p GROUP BY 1)),
yy AS (SELECT sum(y * y) v FROM (SELECT id, max(y) y FROM p GROUP BY 1)),
s AS (SELECT 0 s, list_transform(b, lambda x: 0.0::DOUBLE) w FROM b
UNION ALL SELECT s + 1, list_transform(w, lambda x, i: CASE WHEN i = s % len(w) + 1 THEN (b[i] - list_dot_product(m[i], w) + m[i][i] * x) / m[i][i] ELSE x END) FROM s, g, b WHERE s < 2 * len(w))
"""
#: Blocks of lists, put together, are the lists.
for _blocks, _lists in (("graph_adjacency_blocks", "graph_sorted_adjacency"), ("csr_inverted_index_blocks", "csr_inverted_index"), ("csr_row_index_blocks", "csr_row_index")):
    ORACLES[_blocks] = ORACLES[_lists]
for _grid, _join in (("knn_grid", "knn_jaccard"), ("knn_grid_minmax", "knn_minmax")):
    ORACLES[_grid] = ORACLES[_join]
ORACLES["lc_weights"] = _LC + "SELECT (generate_subscripts(w, 1) - 1)::BIGINT j, round(unnest(w), 6) w FROM s WHERE s = 2 * len(w)"
ORACLES["lc_error_trace"] = _LC + "SELECT (s // len(w))::BIGINT iteration, round(list_dot_product(w, list_transform(m, lambda r: list_dot_product(r, w))) - 2 * list_dot_product(w, b) + yy.v, 4) error FROM s, g, b, yy WHERE s % len(w) = 0"

#: What the text formats hold after they were written and read.
ORACLES["file_csr"] = f'SELECT i AS "row", c AS col, v AS val FROM ({SPM})'
ORACLES["file_adjacency"] = f"SELECT src, dst, count(*)::BIGINT n_edges FROM ({PARTS}) GROUP BY 1, 2"
ORACLES["file_points"] = "SELECT dense_rank() OVER (ORDER BY id) - 1 AS id, j, x, y AS label FROM (" + PTS + ")"
ORACLES["file_keys"] = "SELECT 0::BIGINT line, count(*)::VARCHAR AS value FROM lineitem UNION ALL SELECT row_number() OVER (ORDER BY l_partkey), l_partkey::VARCHAR FROM lineitem"
ORACLES["file_ranks"] = pagerank(NATIONS, "SELECT n_nationkey::BIGINT id FROM nation").replace("SELECT id, round(pr + 1e-13::DOUBLE, 9) pr", "SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS line, printf('%.3e', pr) AS value")
ORACLES["file_neighbors"] = f"SELECT (row_number() OVER (ORDER BY query, sim DESC, neighbor) - 1)::BIGINT AS line, concat_ws(' ', query, neighbor, printf('%.3f', sim)) AS value FROM ({ORACLES['knn_dot']})"
ORACLES["file_stats"] = "SELECT (count(*) + 1)::BIGINT nlines, (count(*) + 1)::BIGINT ntokens, 1::BIGINT max_line_tokens, (sum(length(l_partkey::VARCHAR) + 1) + length(count(*)::VARCHAR) + 1)::BIGINT nbytes FROM lineitem"
for _what in ("lc_weights", "lc_error_trace"):
    ORACLES[f"{_what}_residual"] = ORACLES[_what]
