"""Filters and projections over a triples frame ``(s, p, o)``.

A triples frame is a set: the readers and ``distinct_edges`` remove repeats once, so no operator here
has to shuffle for that again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import RDF_TYPE, Pattern, full_pattern, is_var, kind


def classify(triples: DataFrame) -> DataFrame:
    """Tag each triple ``type``, ``literal`` or ``object`` in a column ``kind``."""
    return triples.select("s", "p", "o", kind().alias("kind"))


def object_edges(triples: DataFrame) -> DataFrame:
    """The edges of the graph: triples that link two nodes other than by class membership."""
    return triples.where(~F.col("o").startswith('"') & (F.col("p") != RDF_TYPE)).select("s", "p", "o")


def properties(triples: DataFrame) -> DataFrame:
    """The triples that describe their subject: literals and class memberships."""
    return triples.where(F.col("o").startswith('"') | (F.col("p") == RDF_TYPE)).select("s", "p", "o")


def edges_by_predicate(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """Edges with one of the given predicates; prunes partitions of a store kept by predicate."""
    return object_edges(triples).where(F.col("p").isin(list(predicates)))


def scan_pattern(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows matching one pattern, one column per variable.

    Constants become comparisons on the scan. A variable that occurs twice in the pattern compares the
    two columns. A pattern without variables gives a frame without columns.
    """
    first: dict[str, str] = {}
    for column, term in zip(("s", "p", "o"), full_pattern(pattern)):
        if not is_var(term):
            triples = triples.where(F.col(column) == term)
        elif term in first:
            triples = triples.where(F.col(column) == F.col(first[term]))
        else:
            first[term] = column
    return triples.select(*(F.col(column).alias(term[1:]) for term, column in first.items()))


def filter_by_properties(triples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Nodes that carry every given ``(predicate, object)`` pair, as ``DF(node)``.

    One pass: keep the wanted triples, count them per subject. As triples are a set, a subject has all
    pairs exactly if its count is the number of pairs.
    """
    wanted = list(dict.fromkeys((full_pattern(("?x", p, o))[1], o) for p, o in pairs))
    if not wanted:
        raise ValueError("give at least one (predicate, object) pair")
    matches = reduce(
        lambda a, b: a | b, [(F.col("p") == p) & (F.col("o") == o) for p, o in wanted]
    )
    return (
        triples.where(matches)
        .groupBy(F.col("s").alias("node"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(wanted))
        .select("node")
    )


def candidate_nodes(triples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Number of nodes that carry every given pair, as ``DF(n)``."""
    return filter_by_properties(triples, pairs).agg(F.count(F.lit(1)).alias("n"))
