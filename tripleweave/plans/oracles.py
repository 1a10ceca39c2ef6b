"""The SQL each query is checked against, over the base tables.

Workload queries and joins are written on the tables themselves, so that the triples view is checked
with them; operators over all triples start from a view spelled out once more in SQL.
"""

from __future__ import annotations

from tripleweave.functions.terms import RDF_TYPE as TYPE
from tripleweave.operators.inference import CLASS_SUPERS, PREDICATE_SUPERS, PREFIX

TRIPLES = f"""triples AS (
SELECT '<region/'||r_regionkey||'>' AS s, '{TYPE}' AS p, '<Region>' AS o FROM region
UNION ALL SELECT '<nation/'||n_nationkey||'>', '{TYPE}', '<Nation>' FROM nation
UNION ALL SELECT '<customer/'||c_custkey||'>', '{TYPE}', '<Customer>' FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '{TYPE}', '<Supplier>' FROM supplier
UNION ALL SELECT '<part/'||p_partkey||'>', '{TYPE}', '<Part>' FROM part
UNION ALL SELECT '<order/'||o_orderkey||'>', '{TYPE}', '<Order>' FROM orders
UNION ALL SELECT '<region/'||r_regionkey||'>', '<name>', '"'||r_name||'"' FROM region
UNION ALL SELECT '<nation/'||n_nationkey||'>', '<name>', '"'||n_name||'"' FROM nation
UNION ALL SELECT '<customer/'||c_custkey||'>', '<name>', '"'||c_name||'"' FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '<name>', '"'||s_name||'"' FROM supplier
UNION ALL SELECT '<part/'||p_partkey||'>', '<name>', '"'||p_name||'"' FROM part
UNION ALL SELECT '<customer/'||c_custkey||'>', '<segment>', '"'||c_mktsegment||'"' FROM customer
UNION ALL SELECT '<part/'||p_partkey||'>', '<brand>', '"'||p_brand||'"' FROM part
UNION ALL SELECT '<order/'||o_orderkey||'>', '<status>', '"'||o_orderstatus||'"' FROM orders
UNION ALL SELECT '<order/'||o_orderkey||'>', '<priority>', '"'||o_orderpriority||'"' FROM orders
UNION ALL SELECT DISTINCT '<order/'||l_orderkey||'>', '<shipFlag>', '"'||l_returnflag||'"'
  FROM lineitem
UNION ALL SELECT '<nation/'||n_nationkey||'>', '<inRegion>', '<region/'||n_regionkey||'>' FROM nation
UNION ALL SELECT '<customer/'||c_custkey||'>', '<fromNation>', '<nation/'||c_nationkey||'>'
  FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '<basedIn>', '<nation/'||s_nationkey||'>' FROM supplier
UNION ALL SELECT '<order/'||o_orderkey||'>', '<placedBy>', '<customer/'||o_custkey||'>' FROM orders
UNION ALL SELECT DISTINCT '<order/'||l_orderkey||'>', '<contains>', '<part/'||l_partkey||'>'
  FROM lineitem
UNION ALL SELECT DISTINCT '<order/'||l_orderkey||'>', '<suppliedBy>', '<supplier/'||l_suppkey||'>'
  FROM lineitem
UNION ALL SELECT DISTINCT '<part/'||l_partkey||'>', '<soldBy>', '<supplier/'||l_suppkey||'>'
  FROM lineitem)"""
EDGES = f"""edges AS (SELECT s, p, o FROM triples WHERE o NOT LIKE '"%' AND p <> '{TYPE}')"""
PROPS = f"""props AS (SELECT s AS node, p, o FROM triples WHERE o LIKE '"%' OR p = '{TYPE}')"""
NODES = "nodes AS (SELECT s AS node FROM triples UNION SELECT o FROM triples)"
IDS = "ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM nodes)"
GRAPH_NODES = "nodes AS (SELECT s AS node FROM triples UNION SELECT o FROM edges)"
IDS_FROM_ONE = "ids AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM nodes)"
DERIVED = f"""derived AS (
SELECT '<customer/'||c_custkey||'>' AS s, '{TYPE}' AS p, '<Party>' AS o FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '{TYPE}', '<Party>' FROM supplier
UNION ALL SELECT '<customer/'||c_custkey||'>', '<locatedIn>', '<nation/'||c_nationkey||'>' FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '<locatedIn>', '<nation/'||s_nationkey||'>' FROM supplier)"""
CONTAINS = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
SUPPLIED = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
SOLD = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"

# The triangle of orders, parts and suppliers.
TRIANGLE = f"""SELECT '<order/'||l_orderkey||'>' AS ord, '<part/'||l_partkey||'>' AS part,
  '<supplier/'||l_suppkey||'>' AS sup
FROM {CONTAINS} JOIN {SOLD} USING (l_partkey) JOIN {SUPPLIED} USING (l_orderkey, l_suppkey)"""

# Orders whose customer and supplier share a nation.
NATION_CYCLE = f"""SELECT '<order/'||o_orderkey||'>' AS ord, '<customer/'||c_custkey||'>' AS cust,
  '<nation/'||c_nationkey||'>' AS nat, '<supplier/'||s_suppkey||'>' AS sup
FROM orders JOIN customer ON o_custkey = c_custkey JOIN {SUPPLIED} ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey"""

# What customers of one region ordered.
REGION_SALES = f"""SELECT '<order/'||o_orderkey||'>' AS ord, '<part/'||p_partkey||'>' AS part,
'"'||p_brand||'"' AS brand, '<customer/'||c_custkey||'>' AS cust,
'<nation/'||n_nationkey||'>' AS nat
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN {CONTAINS} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE n_regionkey = 1"""

# Neighbours both ways, the levels reached from the roots, and the weights per predicate. The walk is keyed by root
# and node: a node that has a level is not walked on from again.
LEVELS = f"""WITH RECURSIVE {TRIPLES}, {EDGES},
ways AS MATERIALIZED (SELECT s AS a, o AS b FROM edges UNION SELECT o, s FROM edges),
walk(root, node, level) USING KEY (root, node) AS (
  SELECT DISTINCT a, a, 0 FROM ways WHERE a IN ('<region/1>', '<supplier/3>', '<customer/7>')
  UNION
  SELECT w.root, b, min(w.level) + 1 FROM walk w JOIN ways ON a = w.node
    LEFT JOIN recurring.walk k ON k.root = w.root AND k.node = b WHERE k.node IS NULL GROUP BY w.root, b),
levels AS MATERIALIZED (SELECT root, node, level FROM walk)"""
LEVEL_WEIGHTS = f"""{LEVELS},
weighted AS MATERIALIZED (SELECT s, o, length(CAST(count(*) OVER (PARTITION BY p) AS VARCHAR)) AS weight FROM edges),
near AS MATERIALIZED (SELECT root || ' ' || o AS far, root, level, weight FROM weighted JOIN levels ON node = s),
ends AS MATERIALIZED (SELECT root || ' ' || node AS far, level AS far_level FROM levels),
sums AS (SELECT root, least(level, far_level) AS level, CAST(sum(weight) AS DOUBLE) AS w
  FROM near JOIN ends USING (far) GROUP BY 1, 2),
ranked AS (SELECT root, count(*) AS n_levels, round(var_pop(w), 2) AS weight_var FROM sums GROUP BY root)
SELECT root, n_levels, weight_var FROM ranked"""

# Sizes rise inRegion, basedIn, fromNation, placedBy: each of their edges brings in a new node, so the
# forest takes them all and its parts are then the regions. Sold parts come next, each bringing in one
# node and joining the regions of its suppliers; the two largest predicates have no new node to bring
# in and take edges only while regions stay apart.
FOREST = f"""WITH RECURSIVE {TRIPLES}, {EDGES},
home AS (SELECT s_suppkey, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
buyer AS (SELECT o_orderkey, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
start AS (SELECT DISTINCT r FROM (SELECT n_regionkey AS r FROM nation)),
via_part AS (SELECT DISTINCT x.r AS a, y.r AS b FROM
  (SELECT DISTINCT l_partkey, r FROM {SOLD} JOIN home ON l_suppkey = s_suppkey) x JOIN
  (SELECT DISTINCT l_partkey, r FROM {SOLD} JOIN home ON l_suppkey = s_suppkey) y USING (l_partkey)),
via_order AS (SELECT DISTINCT h.r AS a, b.r AS b FROM {SUPPLIED}
  JOIN home h ON l_suppkey = s_suppkey JOIN buyer b ON l_orderkey = o_orderkey),
both_ways AS (SELECT a, b FROM via_part UNION SELECT a, b FROM via_order UNION SELECT b, a FROM via_order),
reach1(r, t) AS (SELECT r, r FROM start UNION SELECT reach1.r, b FROM reach1 JOIN via_part ON a = t),
reach2(r, t) AS (SELECT r, r FROM start UNION SELECT reach2.r, b FROM reach2 JOIN both_ways ON a = t),
parts AS (SELECT (SELECT count(*) FROM start) AS n0,
  (SELECT count(DISTINCT m) FROM (SELECT r, min(t) AS m FROM reach1 GROUP BY r)) AS n1,
  (SELECT count(DISTINCT m) FROM (SELECT r, min(t) AS m FROM reach2 GROUP BY r)) AS n2),
sizes AS (SELECT p, count(*) AS n FROM edges GROUP BY p),
sold AS (SELECT count(DISTINCT l_partkey) AS n_parts FROM lineitem),
taken AS (SELECT p, n, CASE WHEN p = '<soldBy>' THEN n_parts + n0 - n1
  WHEN p = '<suppliedBy>' THEN n1 - n2 WHEN p = '<contains>' THEN 0 ELSE n END AS n_tree
  FROM sizes, parts, sold)
SELECT p, n_tree, n - n_tree AS n_rest FROM taken"""

# The rows of the same forest. Every part takes its first edge to a supplier; after that, and for the edges of
# orders to suppliers, an edge counts as one between the regions of its ends, and of each pair of regions
# only the first edge can be taken: the ten or fewer of either kind are tried in order on a list of labels.
FOREST_ROWS = f"""WITH RECURSIVE {TRIPLES}, {EDGES},
home AS (SELECT '<supplier/'||s_suppkey||'>' AS o, n_regionkey AS r FROM supplier
  JOIN nation ON s_nationkey = n_nationkey),
buyer AS (SELECT '<order/'||o_orderkey||'>' AS s, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
first_sold AS (SELECT s, min(o) AS o FROM edges WHERE p = '<soldBy>' GROUP BY s),
part AS (SELECT f.s, f.o, r FROM first_sold f JOIN home USING (o)),
bridges AS (
  SELECT 1 AS phase, e.s, e.p, e.o, part.r AS a, home.r AS b FROM edges e JOIN part ON part.s = e.s
    JOIN home ON home.o = e.o WHERE p = '<soldBy>' AND part.r <> home.r
  UNION ALL SELECT 2, e.s, e.p, e.o, buyer.r, home.r FROM edges e JOIN buyer ON buyer.s = e.s
    JOIN home ON home.o = e.o WHERE p = '<suppliedBy>' AND buyer.r <> home.r),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phase, least(a, b), greatest(a, b) ORDER BY s, o) AS n
  FROM bridges) WHERE n = 1),
cand AS (SELECT *, row_number() OVER (ORDER BY phase, s, o) AS k FROM firsts),
tried(k, labels, fresh) AS (SELECT CAST(0 AS BIGINT), (SELECT list(r ORDER BY r) FROM (SELECT unnest(range(max(r_regionkey) + 1)) AS r FROM region)), false
  UNION ALL SELECT c.k, list_transform(labels, lambda x: CASE WHEN x = labels[c.a + 1] THEN labels[c.b + 1] ELSE x END),
    labels[c.a + 1] <> labels[c.b + 1] FROM tried JOIN cand c ON c.k = tried.k + 1),
weights AS (SELECT p, CAST(count(*) AS DOUBLE) AS weight FROM edges GROUP BY p),
forest AS (
  SELECT s, p, o FROM edges WHERE p IN ('<inRegion>', '<basedIn>', '<fromNation>', '<placedBy>')
  UNION ALL SELECT s, '<soldBy>', o FROM first_sold
  UNION ALL SELECT s, p, o FROM cand JOIN tried USING (k) WHERE fresh)"""


def _university() -> str:
    classes = ", ".join(f"'<{PREFIX}{name}>'" for name in CLASS_SUPERS)
    rules = ", ".join(
        f"('<{PREFIX}{name}>', '<{PREFIX}{sup}>')" for name, sups in CLASS_SUPERS.items() for sup in sups
    )
    pred_rules = ", ".join(
        f"('<{PREFIX}{name}>', '<{PREFIX}{sup}>')"
        for name, sups in PREDICATE_SUPERS.items()
        for sup in sups
    )
    return f"""WITH base AS (
SELECT '<customer/'||c_custkey||'>' AS s, '{TYPE}' AS p,
  ([{classes}])[c_nationkey % {len(CLASS_SUPERS)} + 1] AS o FROM customer
UNION ALL SELECT '<supplier/'||s_suppkey||'>', '<{PREFIX}headOf>', '<nation/'||s_nationkey||'>' FROM supplier),
rules(cls, super) AS (VALUES {rules}),
pred_rules(pred, super) AS (VALUES {pred_rules})
SELECT s, p, o FROM base
UNION SELECT s, p, super FROM base JOIN rules ON o = cls WHERE p = '{TYPE}'
UNION SELECT s, super, o FROM base JOIN pred_rules ON p = pred"""


def _of_triples(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join((TRIPLES, *ctes)) + "\n" + select


def _order_of_customer(key: int) -> str:
    return f"SELECT '<order/'||o_orderkey||'>' AS x FROM orders WHERE o_custkey = {key}"


VERTEX_LINES = (
    "SELECT concat_ws(' ', id, node, p||'##PropObj##'||o) AS line FROM ids LEFT JOIN props USING (node)"
)
EDGE_LINES = (
    "SELECT a.id||' '||b.id||' '||p AS line FROM edges "
    "JOIN ids a ON a.node = s JOIN ids b ON b.node = o"
)
URGENT_FILLED = (
    "SELECT '<order/'||o_orderkey||'>' AS node FROM orders "
    "WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
)
BUYERS = (
    "SELECT '<customer/'||c_custkey||'>' AS who, '<nation/'||c_nationkey||'>' AS nat FROM customer "
    "UNION ALL SELECT '<supplier/'||s_suppkey||'>', '<nation/'||s_nationkey||'>' FROM supplier"
)


def oracle_sql() -> dict[str, str]:
    return {
        "read_triples": _of_triples("SELECT s, p, o FROM triples"),
        "read_weights": _of_triples(
            "SELECT p, CAST(count(*) AS DOUBLE) AS weight FROM triples GROUP BY p"
        ),
        "read_mixed": _of_triples(
            "SELECT s, p, o FROM triples UNION ALL "
            """SELECT '<customer/1>', '<says>', '"'||chr(39)||c_custkey||chr(39)||'"' FROM customer UNION ALL """
            "SELECT '<customer/1>', '<knows>', '<customer/'||c_custkey||'>' FROM customer"
        ),
        "rejected_lines": """SELECT unnest(['<customer/'||c_custkey||'> <says> "one two three',
            '<customer/'||c_custkey||'> <knows> <customer/1> <graph> .',
            '# <customer/'||c_custkey||'> <knows> <customer/1> .', '  <customer/'||c_custkey||'> <knows>', '   ',
            '<customer/1> <says> "'||c_custkey||'"@en and more .']) AS line FROM customer""",
        "answer_text": REGION_SALES,
        "inferred_text": _of_triples(
            "SELECT s, p, o FROM triples UNION SELECT s, p, o FROM derived", DERIVED
        ),
        "loaded_graph": _of_triples(
            f"SELECT 'vertex' AS kind, line FROM ({VERTEX_LINES}) UNION ALL "
            f"SELECT 'edge', line FROM ({EDGE_LINES}) UNION ALL "
            "SELECT 'next', CAST(max(id) + 1 AS VARCHAR) FROM ids",
            EDGES, GRAPH_NODES, IDS_FROM_ONE, PROPS,
        ),
        "write_triples": _of_triples("SELECT s||' '||p||' '||o||' .' AS line FROM triples"),
        "vertex_lines": _of_triples(VERTEX_LINES, NODES, IDS, PROPS),
        "edge_lines": _of_triples(EDGE_LINES, EDGES, NODES, IDS),
        "solution_lines": f"SELECT '###'||ord||' '||part||' '||sup||' ' AS line FROM ({TRIANGLE})",
        "classify_triples": _of_triples(
            f"""SELECT s, p, o, CASE WHEN o LIKE '"%' THEN 'literal' WHEN p = '{TYPE}' THEN 'type'
            ELSE 'object' END AS kind FROM triples"""
        ),
        "object_edges": _of_triples("SELECT s, p, o FROM edges", EDGES),
        "edges_by_predicate": _of_triples(
            "SELECT s, p, o FROM triples WHERE p IN ('<contains>', '<placedBy>')"
        ),
        "scan_pattern": "SELECT '<order/'||o_orderkey||'>' AS x, '<customer/'||o_custkey||'>' AS y FROM orders",
        "scan_any_predicate": "SELECT '<customer/'||c_custkey||'>' AS x, '<fromNation>' AS p "
        "FROM customer WHERE c_nationkey = 3 UNION ALL "
        "SELECT '<supplier/'||s_suppkey||'>', '<basedIn>' FROM supplier WHERE s_nationkey = 3",
        "const_term": "SELECT '<customer/'||c_custkey||'>' AS x FROM customer WHERE c_nationkey = 3",
        "const_subject": "SELECT DISTINCT '<part/'||l_partkey||'>' AS y FROM lineitem WHERE l_orderkey = 1",
        "filter_by_properties": URGENT_FILLED,
        "bind_property": "SELECT DISTINCT '<order/'||l_orderkey||'>' AS x, '\"'||l_returnflag||'\"' AS v "
        "FROM lineitem",
        "bind_class": _of_triples(f"SELECT s AS x, o AS c FROM triples WHERE p = '{TYPE}'"),
        "self_loop": "SELECT DISTINCT '<nation/'||c_nationkey||'>' AS x FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey "
        "JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey",
        "project_terms": """SELECT '<order/'||o_orderkey||'>' AS x, '<customer/'||c_custkey||'>' AS y,
            '<nation/3>' AS "<nation/3>", '"'||o_orderpriority||'"' AS z
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3""",
        "natural_join": "SELECT '<order/'||o_orderkey||'>' AS ord, '<customer/'||c_custkey||'>' AS cust, "
        "'<nation/'||c_nationkey||'>' AS nat FROM orders JOIN customer ON o_custkey = c_custkey",
        "cross_bindings": "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) * "
        f"(SELECT count(*) FROM part JOIN {SOLD} ON p_partkey = l_partkey) AS n",
        "extend_forward": "SELECT '<order/'||o_orderkey||'>' AS ord, '<customer/'||o_custkey||'>' AS cust, "
        f"'<part/'||l_partkey||'>' AS part FROM orders JOIN {CONTAINS} ON l_orderkey = o_orderkey",
        "extend_backward": "SELECT '<customer/'||c_custkey||'>' AS cust, '<order/'||o_orderkey||'>' AS ord "
        "FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3",
        "star_match": f"""SELECT '<order/'||o_orderkey||'>' AS ord, '"'||o_orderstatus||'"' AS status,
            '"'||o_orderpriority||'"' AS priority, '<customer/'||o_custkey||'>' AS cust,
            '<supplier/'||l_suppkey||'>' AS sup
            FROM orders JOIN {SUPPLIED} ON l_orderkey = o_orderkey""",
        "path_match": "SELECT '<order/'||o_orderkey||'>' AS ord, '<customer/'||c_custkey||'>' AS cust, "
        "'<nation/'||n_nationkey||'>' AS nat, '<region/'||n_regionkey||'>' AS reg FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        "cycle_match": NATION_CYCLE,
        "five_cycle": "SELECT '<order/'||o_orderkey||'>' AS ord, '<customer/'||c_custkey||'>' AS cust, "
        "'<nation/'||c_nationkey||'>' AS nat, '<supplier/'||s_suppkey||'>' AS sup, "
        "'<part/'||c.l_partkey||'>' AS part FROM orders JOIN customer ON o_custkey = c_custkey "
        f"JOIN {CONTAINS} c ON c.l_orderkey = o_orderkey JOIN {SOLD} d ON d.l_partkey = c.l_partkey "
        "JOIN supplier ON d.l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
        "subject_vertices": _of_triples(
            "SELECT s, p, o, id FROM triples JOIN ids ON node = s", NODES, IDS
        ),
        "object_vertices": _of_triples(
            "SELECT node, id FROM ids WHERE node IN (SELECT o FROM triples)", NODES, IDS
        ),
        "encode_edges": _of_triples(
            "SELECT a.id AS src, p, b.id AS dst FROM edges LEFT JOIN ids a ON a.node = s "
            "LEFT JOIN ids b ON b.node = o",
            EDGES,
            "part_edges AS (SELECT s, o FROM edges WHERE p IN ('<contains>', '<placedBy>'))",
            "nodes AS (SELECT s AS node FROM part_edges UNION SELECT o FROM part_edges)",
            IDS,
        ),
        "match_bgp": REGION_SALES,
        "match_pruned": REGION_SALES,
        "match_encoded": NATION_CYCLE,
        "exists_pattern": "SELECT '<part/'||p_partkey||'>' AS part FROM part "
        "WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
        "distinct_nodes": _of_triples("SELECT node FROM nodes", NODES),
        "distinct_edges": _of_triples("SELECT DISTINCT s, p, o FROM edges", EDGES),
        "node_properties": _of_triples("SELECT node, p, o FROM props", PROPS),
        "count_solutions": f"SELECT count(*) AS n FROM ({TRIANGLE})",
        "richest_record": _of_triples(
            "SELECT node AS id, CASE WHEN p IS NULL THEN 'object' ELSE 'subject' END AS record, p, o "
            "FROM nodes LEFT JOIN props USING (node)",
            NODES, PROPS,
        ),
        "predicate_weights": _of_triples(
            "SELECT p, CAST(count(*) AS DOUBLE) AS weight, count(DISTINCT s) AS n_subjects, "
            "count(DISTINCT o) AS n_objects FROM triples GROUP BY p"
        ),
        "node_degrees": _of_triples(
            "SELECT node, count(*) AS degree FROM "
            "(SELECT s AS node FROM edges UNION ALL SELECT o FROM edges) GROUP BY node",
            EDGES,
        ),
        "top_degree_node": _of_triples(
            "SELECT node, count(*) AS degree FROM "
            "(SELECT s AS node FROM edges UNION ALL SELECT o FROM edges) GROUP BY node "
            "ORDER BY degree DESC, node LIMIT 1",
            EDGES,
        ),
        "candidate_nodes": f"SELECT count(*) AS n FROM ({URGENT_FILLED})",
        "union_bindings": BUYERS,
        "merge_bindings": "SELECT who, nat, '<region/'||n_regionkey||'>' AS reg "
        f"FROM ({BUYERS}) JOIN nation ON nat = '<nation/'||n_nationkey||'>'",
        "all_vertices": _of_triples(
            "SELECT node, count(p) AS n_props FROM nodes LEFT JOIN props USING (node) GROUP BY node",
            NODES, PROPS,
        ),
        "derived_union": _of_triples(
            "SELECT s, p, o FROM triples UNION ALL SELECT s, p, o FROM derived", DERIVED
        ),
        "node_ids": _of_triples("SELECT node, id FROM ids", NODES, IDS),
        "extend_node_ids": _of_triples(
            "SELECT node, row_number() OVER (ORDER BY node NOT IN (SELECT node FROM early), node) - 1 AS id "
            "FROM nodes",
            NODES,
            "early AS (SELECT s AS node FROM triples WHERE p IN ('<fromNation>', '<inRegion>') "
            "UNION SELECT o FROM triples WHERE p IN ('<fromNation>', '<inRegion>'))",
        ),
        "encoded_vertices": _of_triples(
            "SELECT id, node, p, o FROM ids LEFT JOIN props USING (node)", NODES, IDS, PROPS
        ),
        "encoded_edges": _of_triples(
            "SELECT a.id AS src, p, b.id AS dst FROM edges JOIN ids a ON a.node = s JOIN ids b ON b.node = o",
            EDGES, NODES, IDS,
        ),
        "graph_vertices": _of_triples(VERTEX_LINES, EDGES, GRAPH_NODES, IDS_FROM_ONE, PROPS),
        "graph_edges": _of_triples(EDGE_LINES, EDGES, GRAPH_NODES, IDS_FROM_ONE),
        "infer_types": f"SELECT s, p, o FROM (WITH {DERIVED} SELECT * FROM derived) WHERE p = '{TYPE}'",
        "infer_predicates": f"SELECT s, p, o FROM (WITH {DERIVED} SELECT * FROM derived) "
        "WHERE p = '<locatedIn>'",
        "materialize": _of_triples(
            "SELECT s, p, o FROM triples UNION SELECT s, p, o FROM derived", DERIVED
        ),
        "lubm_rules": _university(),
        "min_spanning_forest": f"{FOREST_ROWS} SELECT s, p, o, weight FROM forest JOIN weights USING (p)",
        "non_tree_edges": f"{FOREST_ROWS} SELECT s, p, o FROM edges EXCEPT SELECT s, p, o FROM forest",
        "forest_by_predicate": FOREST,
        "hop_levels": f"{LEVELS} SELECT root, node, level FROM levels",
        "level_weights": LEVEL_WEIGHTS,
        "rank_roots": f"{LEVEL_WEIGHTS} ORDER BY n_levels, weight_var, root LIMIT 1",
        "w1": _order_of_customer(7),
        "w2": TRIANGLE,
        "w3": "SELECT '<customer/'||c_custkey||'>' AS x FROM customer WHERE c_nationkey = 3 UNION ALL "
        "SELECT '<supplier/'||s_suppkey||'>' FROM supplier WHERE s_nationkey = 3",
        "w4": """SELECT DISTINCT '<order/'||o_orderkey||'>' AS x, '"'||o_orderstatus||'"' AS y1,
            '"'||o_orderpriority||'"' AS y2, '"'||l_returnflag||'"' AS y3
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7""",
        "w5": "SELECT '<customer/'||c_custkey||'>' AS x FROM customer WHERE c_nationkey = 3",
        "w6": "SELECT '<supplier/'||s_suppkey||'>' AS x FROM supplier",
        "w7": "SELECT DISTINCT '<order/'||a.l_orderkey||'>' AS x, '<part/'||a.l_partkey||'>' AS y "
        "FROM lineitem a JOIN lineitem b USING (l_partkey) WHERE b.l_orderkey = 1",
        "w8": """SELECT '<order/'||o_orderkey||'>' AS x, '<customer/'||c_custkey||'>' AS y,
            '"'||o_orderpriority||'"' AS z
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3""",
        "w9": TRIANGLE,
        "w10": _order_of_customer(8),
        "w12": "SELECT '<order/'||o_orderkey||'>' AS x, '<customer/'||c_custkey||'>' AS y "
        "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
        "wtoy": "SELECT '<customer/'||c_custkey||'>' AS x, '<nation/'||c_nationkey||'>' AS y, "
        "'<order/'||o_orderkey||'>' AS z FROM orders JOIN customer ON o_custkey = c_custkey",
    }
