"""SQL with the same results as the registered queries, from the definitions.

Partitions are unrolled level by level; a fixed point is looked for among the
levels that are unrolled.  Data edges come from their definition, level by level,
not from the closed form that the engine uses.
"""

from __future__ import annotations

from ..functions.terms import LIST_TERMS, LITERAL_NODE, RDF, RDF_TYPE, TYPE_NODE
from ..operators.rdf import NAMESPACE
from .driver_graphs import BASE, CONTAINS, CUSTOMER, EVENT, IN_NATION, IN_REGION, KIND, NATION, NEXT, ORDER, PART, PLACED_BY, PREDICATES, REGION

DEPTH = 5


def _id(kind: int, key: str) -> str:
    return f"{kind * KIND} + CAST({key} AS BIGINT)"


_STAR_E = f"""SELECT DISTINCT * FROM (
    SELECT {_id(ORDER, "o_orderkey")} AS s, CAST({PLACED_BY} AS BIGINT) AS p, {_id(CUSTOMER, "o_custkey")} AS o FROM orders
    UNION ALL SELECT {_id(CUSTOMER, "c_custkey")}, {IN_NATION}, {_id(NATION, "c_nationkey")} FROM customer
    UNION ALL SELECT {_id(NATION, "n_nationkey")}, {IN_REGION}, {_id(REGION, "n_regionkey")} FROM nation"""
_STAR_T = f"""SELECT {_id(ORDER, "o_orderkey")} AS node, o_orderstatus AS type FROM orders UNION ALL SELECT {_id(CUSTOMER, "c_custkey")}, c_mktsegment FROM customer
    UNION ALL SELECT {_id(NATION, "n_nationkey")}, 'Nation' FROM nation UNION ALL SELECT {_id(REGION, "r_regionkey")}, r_name FROM region"""
_PLUS_E = f"{_STAR_E} UNION ALL SELECT {_id(ORDER, 'l_orderkey')}, {CONTAINS}, {_id(PART, 'l_partkey')} FROM lineitem)"
_PLUS_T = f"{_STAR_T} UNION ALL SELECT {_id(PART, 'p_partkey')}, p_brand FROM part"
_CHAIN_E = f"""SELECT {_id(EVENT, "event_id")} AS s, CAST({NEXT} AS BIGINT) AS p, {_id(EVENT, "nxt")} AS o
    FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL"""
_CHAIN_T = f"SELECT {_id(EVENT, 'event_id')} AS node, event_type AS type FROM events"


def _graph(e: str, t: str) -> str:
    return f"WITH e AS MATERIALIZED ({e}), t AS MATERIALIZED ({t}), n AS MATERIALIZED (SELECT s AS node FROM e UNION SELECT o FROM e UNION SELECT node FROM t)"


_STAR = _graph(_STAR_E + ")", _STAR_T)


_P0_UNTYPED = ", p0 AS MATERIALIZED (SELECT node, min(node) OVER () AS b, count(*) OVER () AS c FROM n)"


def _levels(depth: int, min_support: int = 1, typed: bool = True) -> str:
    out = _P0_UNTYPED if not typed else """, p0 AS MATERIALIZED (SELECT node, min(node) OVER w AS b, count(*) OVER w AS c
        FROM (SELECT n.node, ts FROM n LEFT JOIN (SELECT node, list_sort(list(DISTINCT type)) AS ts FROM t GROUP BY node) x USING (node)) WINDOW w AS (PARTITION BY ts))"""
    for k in range(depth):
        out += f""", g{k} AS MATERIALIZED (SELECT s AS node, list_sort(list(DISTINCT {{'p': p, 'b': b}})) AS sig FROM e JOIN p{k} ON o = node GROUP BY s),
        p{k + 1} AS MATERIALIZED (SELECT node, min(node) OVER w AS b, count(*) OVER w AS c
            FROM (SELECT q.node, b, CASE WHEN c > {min_support} THEN sig END AS sig FROM p{k} q LEFT JOIN g{k} USING (node)) WINDOW w AS (PARTITION BY b, sig))"""
    return out


_REST = (
    ", every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, node, b, c FROM p{k}" for k in range(DEPTH + 1)) + ")"
    + """, sizes AS (SELECT k, count(DISTINCT b) AS n FROM every GROUP BY k), fix AS MATERIALIZED (SELECT min(x.k) AS last FROM sizes x JOIN sizes y ON y.k = x.k + 1 AND y.n = x.n),
    lv AS MATERIALIZED (SELECT every.* FROM every, fix WHERE k <= last),
    blk AS MATERIALIZED (SELECT b AS rep, CAST(min(k) AS INTEGER) AS start_level, CAST(max(k) AS INTEGER) AS end_level, c AS size, c = 1 AS is_singleton FROM (SELECT DISTINCT k, b, c FROM lv) GROUP BY b, c),
    ref AS MATERIALIZED (SELECT x.rep AS child_rep, x.start_level AS child_start, x.size AS child_size, y.rep AS parent_rep, y.start_level AS parent_start, y.size AS parent_size
        FROM blk x JOIN lv ON lv.node = x.rep AND lv.k = x.start_level - 1 JOIN blk y ON y.rep = lv.b AND lv.k BETWEEN y.start_level AND y.end_level),
    seen AS MATERIALIZED (SELECT DISTINCT o.k + 1 AS k, s.b AS sb, s.k AS sk, e.p, o.b AS ob FROM e, fix, lv s, lv o WHERE s.node = e.s AND o.node = e.o AND s.k = least(o.k + 1, last)),
    copies AS MATERIALIZED (SELECT seen.k, x.rep AS s_rep, x.start_level AS s_start, seen.p, y.rep AS o_rep, y.start_level AS o_start FROM seen
        JOIN blk x ON x.rep = sb AND sk BETWEEN x.start_level AND x.end_level JOIN blk y ON y.rep = ob AND seen.k - 1 BETWEEN y.start_level AND y.end_level),
    de AS MATERIALIZED (SELECT s_rep, s_start, p, o_rep, o_start, CAST(min(k) AS INTEGER) AS edge_start, CAST(max(k) AS INTEGER) AS edge_end FROM copies GROUP BY ALL),
    quo AS MATERIALIZED (SELECT DISTINCT s.k, s.b AS s, e.p, o.b AS o FROM e JOIN lv s ON s.node = e.s JOIN lv o ON o.node = e.o AND o.k = s.k),
    mem AS MATERIALIZED (SELECT DISTINCT rep, start_level, node FROM blk JOIN lv ON b = rep AND k BETWEEN start_level AND end_level),
    nm AS MATERIALIZED (SELECT rep, start_level, DIGEST AS iri FROM mem GROUP BY rep, start_level),
    ks AS (SELECT CAST(unnest(range(0, last + 1)) AS INTEGER) AS k FROM fix), ks1 AS (SELECT CAST(unnest(range(0, last + 2)) AS INTEGER) AS k FROM fix),
    stat AS (SELECT ks.k, (SELECT count(*) FROM blk WHERE ks.k BETWEEN start_level AND end_level) AS block_count, (SELECT count(*) FROM blk WHERE is_singleton AND ks.k BETWEEN start_level AND end_level) AS singleton_count,
        (SELECT count(*) FROM blk WHERE start_level <= ks.k) AS accumulated_block_count FROM ks),
    dec AS (SELECT ks1.k, (SELECT count(*) FROM de WHERE edge_start <= ks1.k) AS condensed, (SELECT count(*) FROM copies WHERE copies.k <= ks1.k) AS uncondensed FROM ks1)
    """
)
_DIGEST = "'digest_block-' || " + " || '-' || ".join([*(f"CAST(sum(CAST('0x' || substr(md5(CAST(node AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT)) AS BIGINT)" for i in range(4)), "count(*)"])
_REST = _REST.replace("DIGEST AS iri", f"{_DIGEST} AS iri")
_ALL = _STAR + _levels(DEPTH) + _REST
_UNTYPED = _STAR + _levels(DEPTH, typed=False) + _REST
#: Levels up to 1 only, and no edges of the last level into itself.
_LIMITED = _STAR + _levels(DEPTH) + _REST.replace("SELECT min(x.k) AS last FROM sizes x JOIN sizes y ON y.k = x.k + 1 AND y.n = x.n", "SELECT 1 AS last").replace("s.k = least(o.k + 1, last)", "s.k = o.k + 1")
_P = "SELECT node, b AS block, c AS size FROM "
_HASH = "'hash_block-' || base64(unhex(sha256(string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)))))"


def _line(s: str, p: str, o: str) -> str:
    return f"'<{NAMESPACE}' || {s} || '> ' || {p} || ' ' || {o} || ' .'"


_NS = lambda name: f"'<{NAMESPACE}{name}>'"
_QUOTED = lambda c: f"'\"' || CAST({c} AS VARCHAR) || '\"'"
_NAMED = lambda c: f"'<{NAMESPACE}' || {c} || '>'"
_PREDICATE = "CASE p " + " ".join(f"WHEN {k} THEN '<{v}>'" for k, v in PREDICATES.items()) + " END"
_SIZES = f"SELECT {_line('iri', _NS('size'), _QUOTED('size'))} AS value FROM blk JOIN nm USING (rep, start_level)"
_REFINES = f"""SELECT {_line("c.iri", _NS("refines"), _NAMED("q.iri"))} AS value FROM ref JOIN nm c ON c.rep = child_rep AND c.start_level = child_start JOIN nm q ON q.rep = parent_rep AND q.start_level = parent_start"""

_TRIPLES = f"""WITH raw AS (
    SELECT '{BASE}customer/' || c_custkey AS s, '{BASE}inNation' AS p, '{BASE}nation/' || c_nationkey AS o, 'iri' AS o_kind FROM customer
    UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}name', '"' || c_name || '"', 'literal' FROM customer
    UNION ALL SELECT '{BASE}customer/' || c_custkey, '{RDF}type', '{BASE}segment/' || c_mktsegment, 'iri' FROM customer
    UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}inRegion', '{BASE}region/' || n_regionkey, 'iri' FROM nation
    UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}name', '"' || n_name || '"@en', 'literal' FROM nation
    UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{RDF}type', '{BASE}Nation', 'iri' FROM nation
    UNION ALL SELECT '{BASE}region/' || r_regionkey, '{BASE}name', '"' || r_name || '"', 'literal' FROM region
    UNION ALL SELECT '{BASE}region/' || r_regionkey, '{RDF}first', '_:first' || r_regionkey, 'blank' FROM region
    UNION ALL SELECT '{BASE}region/' || r_regionkey, '{RDF}rest', '{RDF}nil', 'iri' FROM region),
    plain AS (SELECT DISTINCT s, p, CASE WHEN o_kind = 'literal' THEN '{LITERAL_NODE}' ELSE o END AS o, o_kind FROM raw),
    ent AS (SELECT row_number() OVER (ORDER BY iri) - 1 AS id, iri FROM (SELECT s AS iri FROM plain UNION SELECT o FROM plain)), pre AS (SELECT row_number() OVER (ORDER BY p) - 1 AS id, p AS iri FROM (SELECT DISTINCT p FROM plain))
    """  # fmt: skip
_LISTS = ", ".join(f"'{x}'" for x in LIST_TERMS)


def _metric(name: str, value: str, source: str) -> str:
    return f"SELECT k, '{name}' AS metric, CAST({value} AS BIGINT) AS value FROM {source}"


_SUM = "OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)"
_FULL = " UNION ALL ".join([
    _metric("vertices_condensed", "accumulated_block_count", "stat"), _metric("vertices_uncondensed", f"sum(block_count) {_SUM}", "stat"), _metric("vertices_quotient", "block_count", "stat"),
    _metric("singletons_condensed", "singleton_count", "stat"), _metric("singletons_quotient", "singleton_count", "stat"), _metric("singletons_uncondensed", f"sum(singleton_count) {_SUM}", "stat"),
    _metric("refines_condensed", "(SELECT count(*) FROM ref WHERE child_start <= ks.k)", "ks"), _metric("refines_uncondensed", "(SELECT coalesce(sum(block_count), 0) FROM stat WHERE stat.k BETWEEN 1 AND ks.k)", "ks"),
    _metric("data_edges_condensed", "condensed", "dec"), _metric("data_edges_uncondensed", "uncondensed", "dec"), _metric("data_edges_quotient", "count(*)", "quo GROUP BY k"),
])

_DEGREES = " UNION ALL ".join(f"""SELECT CAST(k AS INTEGER) AS k, '{name}' AS direction, degree, count(*) AS n_blocks FROM (SELECT k, count(*) AS degree FROM copies GROUP BY k, {x}_rep, {x}_start) GROUP BY k, degree""" for name, x in (("out", "s"), ("in", "o")))
_SPECIAL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{iri}' AS iri, (SELECT max(id) FROM {t} WHERE iri = '{iri}') AS id, (SELECT count(*) FROM {t}) AS total" for kind, t, iri in (("entity", "ent", LITERAL_NODE), ("entity", "ent", TYPE_NODE), ("predicate", "pre", RDF_TYPE)))

_CELLS = """
    , h AS (SELECT k / (SELECT greatest(max(k), 1) FROM lv) AS lk, c / (SELECT max(c) FROM lv) AS ls, count(DISTINCT b) AS w FROM lv GROUP BY k, c, lk, ls),
    cell AS (SELECT i, j, w, ls, (j + 1) / 16.0 - ls AS hi, j / 16.0 - ls AS lo FROM h, range(0, 16) a(i), range(0, 16) b(j) WHERE i / 15.0 > lk - 0.1 AND i / 15.0 < lk + 0.1)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w * (
        CASE WHEN hi <= -0.1 THEN 0 WHEN hi >= 0.1 THEN 1 ELSE 0.5 + 7.5 * hi - 250.0 * hi * hi * hi END - CASE WHEN lo <= -0.1 THEN 0 WHEN lo >= 0.1 THEN 1 ELSE 0.5 + 7.5 * lo - 250.0 * lo * lo * lo END) / 0.2), 6) AS density
    FROM cell GROUP BY i, j HAVING round(density, 6) > 0"""

ORACLE: dict[str, str] = {
    "triples_parsed": _TRIPLES + "SELECT s, p, o, o_kind FROM raw",
    "triples_plain": _TRIPLES + "SELECT DISTINCT s, p, o FROM plain",
    "triples_skip_literals": _TRIPLES + "SELECT DISTINCT s, p, o FROM plain WHERE o_kind <> 'literal'",
    "triples_skip_rdf_lists": _TRIPLES + f"SELECT DISTINCT s, p, o FROM plain WHERE s NOT IN ({_LISTS}) AND p NOT IN ({_LISTS}) AND o NOT IN ({_LISTS})",
    "triples_types_to_predicates": _TRIPLES + f"SELECT DISTINCT s, CASE WHEN p = '{RDF_TYPE}' THEN o ELSE p END AS p, CASE WHEN p = '{RDF_TYPE}' THEN '{TYPE_NODE}' ELSE o END AS o FROM plain",
    "entity_dictionary": _TRIPLES + "SELECT id, iri FROM ent",
    "predicate_dictionary": _TRIPLES + "SELECT id, iri FROM pre",
    "edges_encoded": _TRIPLES + "SELECT DISTINCT a.id AS s, pre.id AS p, b.id AS o FROM plain JOIN ent a ON a.iri = s JOIN pre ON pre.iri = p JOIN ent b ON b.iri = o",
    "triples_star": _STAR + "SELECT s, p, o FROM e",
    "graph_counts": _STAR + "SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM (SELECT s FROM e UNION SELECT o FROM e)) AS n_vertices",
    "relation_distribution": _STAR + "SELECT p, count(*) AS n_edges, min(s) AS min_s, max(s) AS max_s, min(o) AS min_o, max(o) AS max_o FROM e GROUP BY p",
    "out_degree_histogram": _STAR + "SELECT degree, count(*) AS n_nodes FROM (SELECT n.node, count(s) AS degree FROM n LEFT JOIN e ON s = node GROUP BY n.node) GROUP BY degree",
    "in_degree_histogram": _STAR + "SELECT degree, count(*) AS n_nodes FROM (SELECT n.node, count(o) AS degree FROM n LEFT JOIN e ON o = node GROUP BY n.node) GROUP BY degree",
    "reverse_edges": _STAR + "SELECT o AS s, p, s AS o FROM e",
    "graph_merge": _STAR + f"SELECT s, p, o FROM e UNION SELECT * FROM ({_CHAIN_E})",
    "predecessors": _STAR + "SELECT DISTINCT o, s FROM e",
    "consistency_check": _STAR + "SELECT DISTINCT s, p, o FROM e WHERE s % 7 = 0 OR o % 7 = 0",
    "binary_features": _STAR
    + f"SELECT s, p, o FROM e UNION SELECT {_id(CUSTOMER, 'c_custkey')}, CAST(100 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT), CAST(0 AS BIGINT) FROM customer "
    + f"UNION SELECT {_id(CUSTOMER, 'c_custkey')}, CAST(102 + c_nationkey % 2 AS BIGINT), 0 FROM customer",
    "p0_universal": _STAR + "SELECT node, min(node) OVER () AS block, count(*) OVER () AS size FROM n",
    "p0_typed": _STAR + _levels(0) + _P + "p0",
    "k1_partition": _STAR + _levels(1) + _P + "p1",
    "k2_partition": _STAR + _levels(2) + _P + "p2",
    "k2_partition_exact": _STAR + _levels(2) + _P + "p2",
    "min_support_partition": _STAR + _levels(3, 40) + _P + "p3",
    "fixpoint_partition": _ALL + _P + "lv, fix WHERE k = last",
    "plus_k2_partition": _graph(_PLUS_E, _PLUS_T) + _levels(2) + _P + "p2",
    "deep_chain_k5": _graph(_CHAIN_E, _CHAIN_T) + _levels(5) + _P + "p5",
    "feature_broadcast": _ALL + "SELECT node, c AS value FROM lv, fix WHERE k = last",
    "level_statistics": _ALL + "SELECT k, block_count, singleton_count, accumulated_block_count FROM stat",
    "block_size_histogram": _ALL + "SELECT CAST(k AS INTEGER) AS k, c AS size, count(DISTINCT b) AS n_blocks FROM lv GROUP BY k, c",
    "accumulated_size_histogram": _ALL + "SELECT ks.k, size, count(*) AS n_blocks FROM ks JOIN blk ON start_level <= ks.k GROUP BY ks.k, size",
    "block_intervals": _ALL + "SELECT rep, start_level, end_level, size, is_singleton FROM blk",
    "living_blocks_k1": _ALL + "SELECT rep, start_level, end_level, size, is_singleton FROM blk WHERE 1 BETWEEN start_level AND end_level",
    "singleton_ids": _ALL + "SELECT rep, start_level, -rep - 1 AS singleton_id FROM blk WHERE is_singleton",
    "refines_edges": _ALL + "SELECT child_rep, child_start, parent_rep, parent_start FROM ref",
    "singleton_refines": _ALL + "SELECT child_rep, child_start, parent_rep, parent_start FROM ref WHERE child_size = 1",
    "refines_with_sizes": _ALL + "SELECT child_rep, child_start, child_size, parent_rep, parent_start, parent_size FROM ref",
    "split_counts": _ALL
    + """SELECT CAST(k AS INTEGER) AS k, count(*) AS n_split_blocks, CAST(sum(size) AS BIGINT) AS n_split_vertices, CAST(sum(CASE WHEN largest = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_disappeared
        FROM (SELECT min(child_start) - 1 AS k, max(parent_size) AS size, max(child_size) AS largest FROM ref GROUP BY parent_rep, parent_start) GROUP BY k""",
    "new_block_statistics": _ALL + "SELECT start_level AS k, count(*) AS n_new_blocks, CAST(sum(size) AS BIGINT) AS n_new_vertices, CAST(sum(CASE WHEN is_singleton THEN 1 ELSE 0 END) AS BIGINT) AS n_new_singletons FROM blk GROUP BY 1",
    "data_edges_condensed": _ALL + "SELECT s_rep, s_start, p, o_rep, o_start, edge_start, edge_end FROM de",
    "edges_per_level": _ALL + "SELECT CAST(k AS INTEGER) AS k, count(*) AS n_edges FROM copies GROUP BY k",
    "data_edge_counts": _ALL + "SELECT k, condensed, uncondensed FROM dec",
    "quotient_k1": _ALL + "SELECT s, p, o FROM quo WHERE k = 1",
    "quotient_fixpoint": _ALL + "SELECT s, p, o FROM quo, fix WHERE k = last",
    "quotient_dense_ids": _ALL
    + """, q AS (SELECT s, p, o FROM quo, fix WHERE k = last), ids AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT s AS x FROM q UNION SELECT o FROM q))
        SELECT a.id AS s, p, b.id AS o FROM q JOIN ids a ON a.x = s JOIN ids b ON b.x = o""",
    "quotient_contains_k1": _ALL + "SELECT b AS block, node FROM lv WHERE k = 1",
    "quotient_edge_counts": _ALL + "SELECT CAST(k AS INTEGER) AS k, count(*) AS n_edges FROM quo GROUP BY k",
    "full_counts": _ALL + f"SELECT CAST(k AS INTEGER) AS k, metric, value FROM ({_FULL})",
    "summary_consistency": _ALL
    + "SELECT (SELECT count(*) FROM blk) AS n_blocks, (SELECT count(*) FROM blk WHERE start_level = 0) AS n_initial, (SELECT count(*) FROM ref) AS n_refines, (SELECT count(*) FROM blk WHERE start_level > 0) = (SELECT count(*) FROM ref) AS consistent",
    "block_members": _ALL + "SELECT rep, start_level, node FROM mem",
    "block_names_id_set": _ALL + "SELECT rep, start_level, 'id_block-' || string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS iri FROM mem GROUP BY rep, start_level",
    "block_names_hash": _ALL + f"SELECT rep, start_level, {_HASH} AS iri FROM mem GROUP BY rep, start_level",
    "block_names_digest": _ALL + "SELECT rep, start_level, iri FROM nm",
    "block_names_iri_set": _ALL + "SELECT rep, start_level, 'iri_block-' || string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS iri FROM mem GROUP BY rep, start_level",
    "rdf_sizes": _ALL + _SIZES,
    "rdf_contains": _ALL + f"SELECT {_line('iri', _NS('contains'), "'<' || CAST(node AS VARCHAR) || '>'")} AS value FROM mem JOIN nm USING (rep, start_level)",
    "rdf_refines": _ALL + _REFINES,
    "rdf_data": _ALL + f"SELECT DISTINCT {_line('a.iri', _PREDICATE, _NAMED('b.iri'))} AS value FROM de JOIN nm a ON a.rep = s_rep AND a.start_level = s_start JOIN nm b ON b.rep = o_rep AND b.start_level = o_start",
    "rdf_intervals": _ALL
    + f"SELECT {_line('iri', _NS('startLevel'), _QUOTED('start_level'))} AS value FROM blk JOIN nm USING (rep, start_level) UNION ALL SELECT {_line('iri', _NS('endLevel'), _QUOTED('end_level'))} FROM blk JOIN nm USING (rep, start_level)",
    "rdf_merged": _ALL + f"{_SIZES} UNION ALL {_REFINES}",
    "kde_grid": _ALL + _CELLS,
    "kde_grid_vertices": _ALL + _CELLS.replace("count(DISTINCT b) AS w", "count(DISTINCT b) * c AS w"),
    "kde_grid_uniform": _ALL + _CELLS.replace("0.5 + 7.5 * hi - 250.0 * hi * hi * hi", "(hi + 0.1) / 0.2").replace("0.5 + 7.5 * lo - 250.0 * lo * lo * lo", "(lo + 0.1) / 0.2"),
    "fixpoint_untyped": _UNTYPED + _P + "lv, fix WHERE k = last",
    "block_intervals_untyped": _UNTYPED + "SELECT rep, start_level, end_level, size, is_singleton FROM blk",
    "data_edges_untyped": _UNTYPED + "SELECT s_rep, s_start, p, o_rep, o_start, edge_start, edge_end FROM de",
    "data_edges_max_k": _LIMITED + "SELECT s_rep, s_start, p, o_rep, o_start, edge_start, edge_end FROM de",
    "quotient_k2": _ALL + "SELECT s, p, o FROM quo WHERE k = 2",
    "block_ids": _ALL + "SELECT rep, start_level, row_number() OVER (PARTITION BY start_level ORDER BY rep) - 1 AS local_id, row_number() OVER (ORDER BY start_level, rep) - 1 AS global_id FROM blk",
    "summary_degrees": _ALL + _DEGREES,
    "graph_metadata": _TRIPLES + _SPECIAL,
    "summary_differences": _ALL
    + """, own AS (SELECT rep, start_level, end_level, size FROM blk), few AS (SELECT b AS rep, CAST(min(k) AS INTEGER) AS start_level, CAST(max(k) AS INTEGER) AS end_level, c AS size FROM (SELECT DISTINCT k, b, c FROM lv WHERE k <= 1) GROUP BY b, c)
        SELECT 'first' AS side, * FROM (SELECT * FROM own EXCEPT SELECT * FROM few) UNION ALL SELECT 'second', * FROM (SELECT * FROM few EXCEPT SELECT * FROM own)""",
    "dirty_blocks_k1": _ALL + "SELECT DISTINCT x.b AS block FROM e JOIN lv x ON x.node = e.s AND x.k = 1 JOIN lv y ON y.node = e.o AND y.k = 1 JOIN blk ON rep = y.b AND start_level = 1",
}
