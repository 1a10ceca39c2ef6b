"""What Spark is asked to do: pruned scans, no products, split hot keys."""

import time

import pytest
from pyspark.sql import functions as F

from tripleweave.operators import graph, inference, match, nodes, scans, stats
from tripleweave.operators.match import match_bgp, natural_join
from tripleweave.plans.workload import WORKLOAD
from tripleweave.session import cut
from tripleweave.sources import store, tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "triples")
    store.save_triples(tables.triples(spark, SF_DIR), path)
    return store.load_triples(spark, path)


def test_a_pattern_reads_its_predicate_and_needed_columns_only(triples):
    text = plan(scans.scan_pattern(triples, ("?x", "<placedBy>", "<customer/7>")))
    assert "(p" in text.split("PartitionFilters:")[1].split("]")[0]
    assert "= <placedBy>)" in text
    assert "EqualTo(o,<customer/7>)" in text
    assert "ReadSchema: struct<s:string,o:string>" in text
    only_subjects = plan(scans.scan_pattern(triples, ("?x", "<placedBy>", "?y")).select("x"))
    assert "ReadSchema: struct<s:string>" in only_subjects


def test_a_pattern_on_the_view_reads_one_table(spark):
    pattern = ("?x", "<fromNation>", "<nation/3>")
    text = plan(scans.scan_pattern(tables.triples_for(spark, SF_DIR, [pattern]), pattern))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


@pytest.mark.parametrize("name", [k for k in WORKLOAD if k != "w3"])
@pytest.mark.parametrize("prune", [False, True])
def test_no_products_and_no_python(triples, name, prune):
    text = plan(match_bgp(triples, WORKLOAD[name], prune=prune))
    for bad in ("CartesianProduct", "NestedLoop", "Python", "SinglePartition"):
        assert bad not in text


@pytest.fixture
def shuffled(spark):
    """Settings under which a few thousand rows are shuffled and looked at for skew."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.shuffle.partitions": "64",
    }
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


@pytest.fixture
def hot(spark):
    """Edges of which a third lead to one node, from several map tasks."""
    pattern = ("?s", "<contains>", "?o")
    return (
        tables.triples_for(spark, "/root/testdata/sf0.01", [pattern])
        .select(
            "s",
            "p",
            F.when(F.xxhash64("s") % 3 == 0, "hot").otherwise(F.col("o")).alias("o"),
        )
        .withColumn("s", F.concat("s", F.lit("/"), F.monotonically_increasing_id()))
        .repartition(8)
    )


def splits(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0].count("skew=true")


def test_a_hot_key_is_split_against_a_grouped_side(shuffled, hot):
    edges = hot.select(F.col("s").alias("x"), F.col("o").alias("y"))
    degrees = edges.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    joined = natural_join(edges, degrees)
    assert splits(joined)
    assert joined.count() == edges.count()


def test_a_hot_key_is_split_in_every_join_on_it(shuffled, hot):
    """Two tables with one row per node, then the hot edges: the third table is split as well."""
    nodes_once = hot.select(F.col("o").alias("y")).distinct()
    first = nodes_once.withColumn("a", F.upper("y"))
    second = nodes_once.withColumn("b", F.lower("y"))
    edges = hot.select(F.col("s").alias("x"), F.col("o").alias("y"))
    joined = natural_join(natural_join(first, second), edges)
    assert splits(joined)
    assert joined.count() == edges.count()


def test_hot_nodes_are_split_in_node_operators(shuffled, hot):
    ids = nodes.node_ids(hot)
    turned = hot.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    assert splits(nodes.subject_vertices(turned, ids))
    assert splits(nodes.encode_edges(hot, ids))
    literal = turned.select("s", "p", F.concat(F.lit('"'), "o", F.lit('"')).alias("o"))
    vertices = nodes.encoded_vertices(literal, nodes.node_ids(literal))
    assert splits(vertices)


def test_a_closing_extension_splits_hot_nodes(shuffled, hot):
    triples = hot.unionByName(hot.select("s", F.lit("<again>").alias("p"), "o"))
    wedge = [("?x", "<contains>", "?y"), ("?z", "<contains>", "?y"), ("?x", "<again>", "?z")]
    assert splits(match_bgp(triples, wedge))


def test_ids_are_numbered_by_range(spark, triples):
    """The sort is spread over range partitions; only one row per partition meets in one task."""
    text = plan(nodes.node_ids(triples))
    assert "BroadcastHashJoin" in text
    window = text.index("Window")
    assert "HashAggregate(keys=[__part" in text[window:]


@pytest.fixture
def small_broadcasts(spark):
    """Only tables of a few kilobytes are broadcast: the scans of the fixture count as large."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["w1", "w4", "w7", "w8", "w10", "w12"])
def test_a_query_held_by_a_constant_shuffles_no_predicate(triples, small_broadcasts, name):
    text = final_plan(match_bgp(triples, WORKLOAD[name]))
    assert "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text


def test_stepwise_gives_the_same_answer(triples):
    found = match_bgp(triples, WORKLOAD["w4"], stepwise=True)
    assert found.exceptAll(match_bgp(triples, WORKLOAD["w4"], stepwise=False)).isEmpty()
    assert found.count() == 25


def test_rules_and_weights_do_not_shuffle_triples(spark, triples, small_broadcasts):
    classes, predicates = tables.rules(spark)
    edges = scans.object_edges(triples)
    for df in (
        inference.infer_types(triples, classes),
        inference.infer_predicates(triples, predicates),
        graph._weighted(edges, stats.predicate_sizes(edges), 1.0),
    ):
        assert "Exchange hashpartitioning" not in final_plan(df)
    text = plan(inference.materialize(triples, classes, predicates)).split("== Initial Plan ==")[-1]
    assert text.count("FileScan") == 2


def test_the_plan_of_levels_does_not_grow_with_their_number(spark):
    chain = spark.range(200).selectExpr(
        "concat('n', lpad(id, 4, '0')) AS s", "'p' AS p", "concat('n', lpad(id + 1, 4, '0')) AS o"
    )
    sizes = {}
    for hops in (9, 25):
        found = graph.hop_levels(chain, ["n0000"], max_hops=hops)
        assert found.count() == hops + 1
        sizes[hops] = plan(found).count("FileScan")
    assert max(sizes.values()) <= graph.FOLD


@pytest.mark.parametrize("hot", [1, 1 << 20])
def test_no_round_of_levels_shuffles_the_edges(spark, shuffled, hot):
    """What meets the bucketed ways in a round is the frontier alone."""
    edges = scans.object_edges(tables.triples(spark, SF_DIR))
    table, salts = graph._bucketed_ways(edges, hot, 64)
    frontier = edges.select(F.lit(0).alias("at"), F.col("s").alias("node")).distinct()
    reached = graph._next_reached(spark.table(table), salts, frontier)
    text = plan(reached)
    join = text[text.index("SortMergeJoin") :].splitlines()[1:]
    other = join[0].index(":-") * " " + "+-"
    ways_side = join[: next(i for i, line in enumerate(join) if line.startswith(other))]
    assert any("Bucketed: true" in line for line in ways_side)
    assert not any("Exchange" in line for line in ways_side)
    assert (salts is None) == (hot > 1)
    spark.sql(f"DROP TABLE {table}")


def test_a_write_leaves_no_shuffle_files(spark):
    """They are deleted when the write ends, not when the driver next collects its garbage."""
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {name for i in range(found.length()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    kept = cut(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 10


def test_a_closing_step_keeps_the_shuffles_of_one_join_only(triples, small_broadcasts, monkeypatch):
    """What is found is written before it is checked, and what earlier patterns gave before both."""
    for name, written in (("w9", 1), ("w2", 2)):
        made = []
        monkeypatch.setattr(match, "cut", lambda df: made.append(cut(df)) or made[-1])
        found = match_bgp(triples, WORKLOAD[name])
        assert len(made) == written
        assert found.count() == 22649
