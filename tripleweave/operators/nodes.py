"""Nodes, their properties, and dense ids for both ends of an edge.

Properties stay rows ``(node, p, o)``: one node may own a large share of all triples, and an array per
node would gather them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions.terms import kind
from tripleweave.operators.joins import skew_join
from tripleweave.operators.scans import object_edges, properties
from tripleweave.session import cut

# Fixed value: monotonically_increasing_id keeps the row's place in its partition in these low bits.
PLACE_BITS = (1 << 33) - 1


def distinct_nodes(triples: DataFrame) -> DataFrame:
    """Every subject and object once, literals and classes included, as ``DF(node)``; one scan."""
    return triples.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def graph_nodes(triples: DataFrame) -> DataFrame:
    """Subjects and both ends of edges: the nodes of the graph without its literals and classes."""
    ends = F.when(kind() == "object", F.array("s", "o")).otherwise(F.array("s"))
    return triples.select(F.explode(ends).alias("node")).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each ``(s, p, o)`` once."""
    return edges.dropDuplicates(["s", "p", "o"])


def node_properties(triples: DataFrame) -> DataFrame:
    """The set of type and literal properties of each node, as ``DF(node, p, o)``."""
    return properties(triples).withColumnRenamed("s", "node")


def all_vertices(triples: DataFrame) -> DataFrame:
    """Nodes seen as subject or object, one row each with its number of properties."""
    ends = F.array(
        F.struct(F.col("s").alias("node"), (kind() != "object").cast("bigint").alias("n")),
        F.struct(F.col("o").alias("node"), F.lit(0).cast("bigint").alias("n")),
    )
    return (
        triples.select(F.inline(ends))
        .groupBy("node")
        .agg(F.sum("n").alias("n_props"))
    )


def richest_record(records: DataFrame) -> DataFrame:
    """Of several records per id keep the one with most properties; ties go to the later name.

    ``records`` has one row ``(id, record, p, o)`` per property, with null ``p`` and ``o`` for a record
    without any. Only counts are compared; the rows of the chosen records follow by a semi join.
    """
    best = (
        records.groupBy("id", "record")
        .agg(F.count("p").alias("n"))
        .groupBy("id")
        .agg(F.max(F.struct("n", "record")).alias("top"))
        .select("id", F.col("top.record").alias("record"))
    )
    return records.join(best, ["id", "record"], "left_semi")


def subject_vertices(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach the vertex columns of ``nodes`` to each triple by its subject."""
    own = nodes.withColumnRenamed("node", "s")
    return skew_join(triples, own, ["s"]).select(
        "s", "p", "o", *(c for c in nodes.columns if c != "node")
    )


def object_vertices(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices that occur as an object. Objects are made distinct first, so a hot one is one row."""
    objects = triples.select(F.col("o").alias("node")).distinct()
    return nodes.join(objects, "node", "left_semi")


def number_rows(rows: DataFrame, columns: list[str], start: int = 0) -> DataFrame:
    """``rows`` with a dense ``id`` in the order of ``columns``: a global sort over range partitions,
    numbered inside each one, plus the number of rows in the partitions before. Place and partition are
    written out first, so that a lost executor cannot make the two disagree."""
    placed = cut(
        rows.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(PLACE_BITS).alias("__place"),
        )
    )
    # One row per partition, whatever the number of rows.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    )
    return placed.join(F.broadcast(offsets), "__part").select(
        *rows.columns, (F.col("__place") + F.col("__offset") + F.lit(start)).alias("id")
    )


def number_nodes(nodes: DataFrame, start: int = 0) -> DataFrame:
    """Dense ids in node order, as ``DF(node, id)``."""
    return number_rows(nodes.select("node"), ["node"], start)


def node_ids(triples: DataFrame, start: int = 0) -> DataFrame:
    """A dense id per node, in node order from ``start``, as ``DF(node, id)``."""
    return number_nodes(distinct_nodes(triples), start)


def next_free_id(dictionary: DataFrame, start: int = 0) -> int:
    """The id the next new node would get."""
    last = dictionary.agg(F.max("id")).first()[0]
    return start if last is None else last + 1


def extend_node_ids(dictionary: DataFrame, triples: DataFrame) -> DataFrame:
    """Give ids to the nodes of ``triples`` the dictionary does not have, after its last id."""
    new = distinct_nodes(triples).join(dictionary, "node", "left_anti")
    return dictionary.select("node", "id").unionByName(number_nodes(new, next_free_id(dictionary)))


def encode_edges(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace both ends by their ids, as ``DF(src, p, dst)``; an end the dictionary does not have is null."""
    source = dictionary.select(F.col("node").alias("s"), F.col("id").alias("src"))
    target = dictionary.select(F.col("node").alias("o"), F.col("id").alias("dst"))
    return skew_join(skew_join(edges, source, ["s"], "left"), target, ["o"], "left").select("src", "p", "dst")


def encoded_edges(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The edge table of a triples frame over ids."""
    return encode_edges(object_edges(triples), dictionary)


def encoded_vertices(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The vertex table over ids: a row ``(id, node, p, o)`` per property, one with nulls for a node
    without properties. Two joins instead of an outer one, which could not split a hot node's
    properties."""
    props = node_properties(triples)
    with_props = skew_join(props, dictionary, ["node"]).select("id", "node", "p", "o")
    missing = F.lit(None).cast("string")
    without = dictionary.join(props.select("node").distinct(), "node", "left_anti").select(
        "id", "node", missing.alias("p"), missing.alias("o")
    )
    return with_props.unionByName(without)
