"""Nodes, ids and records."""

from helpers import TYPE, frame, solutions

from tripleweave.operators import nodes, stats
from tripleweave.plans import catalog
from tripleweave.sources import tables

TRIPLES = [
    ("b", "p", "a"),
    ("b", TYPE, "C"),
    ("b", "n", '"1"'),
    ("c", "p", "a"),
    ("a", "q", "a"),
]


def test_ids_are_dense_and_sorted(spark):
    rows = [(f"s{i % 97:03d}", "p", f"o{i:05d}") for i in range(5000)]
    found = nodes.node_ids(frame(spark, rows)).orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(5097))
    names = [r["node"] for r in found]
    assert names == sorted(names)


def test_ids_start_where_asked_and_extend(spark):
    first = nodes.node_ids(frame(spark, [("b", "p", "d")]), start=1)
    assert solutions(first.select("id", "node")) == [(1, "b"), (2, "d")]
    more = nodes.extend_node_ids(first, frame(spark, [("a", "p", "b"), ("c", "p", "e")]))
    assert solutions(more.select("id", "node")) == [
        (1, "b"), (2, "d"), (3, "a"), (4, "c"), (5, "e"),
    ]
    assert nodes.next_free_id(more) == 6
    assert nodes.next_free_id(more.where("id < 0"), start=1) == 1


def test_vertices(spark):
    df = frame(spark, TRIPLES)
    assert solutions(nodes.distinct_nodes(df)) == [('"1"',), ("C",), ("a",), ("b",), ("c",)]
    assert solutions(nodes.all_vertices(df)) == [
        ('"1"', 0), ("C", 0), ("a", 0), ("b", 2), ("c", 0),
    ]
    assert solutions(nodes.node_properties(df)) == sorted([("b", TYPE, "C"), ("b", "n", '"1"')])
    ids = nodes.node_ids(df)
    assert solutions(nodes.object_vertices(df, ids).select("node")) == [('"1"',), ("C",), ("a",)]
    assert nodes.subject_vertices(df, ids).columns == ["s", "p", "o", "id"]
    assert nodes.subject_vertices(df, ids).count() == 5
    edges = nodes.encoded_edges(df, ids)
    assert solutions(edges) == [(2, "q", 2), (3, "p", 2), (4, "p", 2)]
    known = ids.where("node <> 'c'")
    part = nodes.encoded_edges(df, known)
    assert part.count() == 3 and part.where("src IS NULL").count() == 1


def test_richest_record(spark):
    rows = [
        (1, "old", "n", '"1"'),
        (1, "new", "n", '"1"'),
        (1, "new", "n", '"2"'),
        (2, "bare", None, None),
        (2, "full", "n", '"1"'),
        (3, "bare", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, record string, p string, o string")
    assert solutions(nodes.richest_record(df).select("id", "record").distinct()) == [
        (1, "new"), (2, "full"), (3, "bare"),
    ]
    assert nodes.richest_record(df).count() == 4


def test_weights_and_degrees(spark):
    df = frame(spark, TRIPLES)
    found = {r["p"]: tuple(r)[1:] for r in stats.predicate_weights(df).collect()}
    assert found["p"] == (2.0, 2, 1)
    rough = {r["p"]: tuple(r)[1:] for r in stats.predicate_weights(df, approximate=True).collect()}
    assert rough == found
    edges = df.where("p in ('p', 'q')")
    assert solutions(stats.node_degrees(edges)) == [("a", 4), ("b", 1), ("c", 1)]
    assert tuple(stats.top_degree_node(edges).first()) == ("a", 4)
    assert tuple(stats.top_degree_node(frame(spark, [("y", "p", "x")])).first()) == ("x", 1)


def test_nodes_of_the_view_need_no_distinct_triples(spark, tmp_path):
    """Repeats go when nodes are made distinct: one shuffle, and one scan of the lines for all their predicates."""
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, None, None)]),
        "customer": ("c_custkey int, c_name string, c_nationkey int, c_mktsegment string", [(1, "C", 0, "M")]),
        "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "S", 0)]),
        "part": ("p_partkey int, p_name string, p_brand string", [(1, "P", "B")]),
        "orders": ("o_orderkey int, o_custkey int, o_orderstatus string, o_orderpriority string", [(1, 1, "F", "H")] * 2),
        "lineitem": (
            "l_orderkey int, l_partkey int, l_suppkey int, l_returnflag string",
            [(1, 1, 1, "A"), (1, 1, 1, "A"), (1, 2, None, "A"), (None, 1, 1, None)],
        ),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = catalog.queries()["distinct_nodes"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("struct<l_orderkey") == 1
    stated = {n for r in tables.triples(spark, str(tmp_path)).collect() for n in (r["s"], r["o"])}
    nodes_found = [r["node"] for r in found.collect()]
    assert len(nodes_found) == len(set(nodes_found)) and set(nodes_found) == stated
