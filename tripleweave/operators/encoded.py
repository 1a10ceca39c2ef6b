"""Matching over ids instead of terms.

Long terms make every shuffle wide. Encoded once, both ends of a triple are eight bytes each, joins and
checks run on numbers, and only the rows of the answer are turned back into terms. The predicate stays a
string: it is the partition of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import Pattern, full_pattern, is_var
from tripleweave.operators.joins import skew_join
from tripleweave.operators.match import match_bgp

# Fixed value: an id no node has, for constants the dictionary does not know.
UNKNOWN = -1


def encode_triples(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All triples over ids, as ``DF(s bigint, p string, o bigint)``.

    A term the dictionary does not have becomes null, which no pattern binds: make the dictionary from the
    triples (``node_ids``) or extend it by them first.
    """
    source = dictionary.select(F.col("node").alias("s"), F.col("id").alias("s_id"))
    target = dictionary.select(F.col("node").alias("o"), F.col("id").alias("o_id"))
    return skew_join(skew_join(triples, source, ["s"], "left"), target, ["o"], "left").select(
        F.col("s_id").alias("s"), "p", F.col("o_id").alias("o")
    )


def encode_patterns(patterns: list[Pattern], dictionary: DataFrame) -> list[tuple]:
    """Patterns with their constant ends as ids; looks up one row per constant."""
    full = [full_pattern(p) for p in patterns]
    places = {t for s, _, o in full for t in (s, o)}
    if places & {p for _, p, _ in full if is_var(p)}:
        raise ValueError("a variable may not stand for a predicate and for a node")
    constants = sorted(t for t in places if not is_var(t))
    ids = {}
    if constants:
        rows = dictionary.where(F.col("node").isin(constants)).select("node", "id").collect()
        ids = {r["node"]: r["id"] for r in rows}

    def encoded(term: str) -> str | int:
        return term if is_var(term) else ids.get(term, UNKNOWN)

    return [(encoded(s), p, encoded(o)) for s, p, o in full]


def decode(bindings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Turn the id columns of a binding table back into terms."""
    columns = bindings.columns
    for name, dtype in bindings.dtypes:
        if dtype == "bigint":
            terms = dictionary.select(F.col("id").alias(name), F.col("node").alias("__term"))
            bindings = (
                skew_join(bindings, terms, [name]).drop(name).withColumnRenamed("__term", name)
            )
    return bindings.select(*columns)


def match_encoded(
    encoded: DataFrame,
    dictionary: DataFrame,
    patterns: list[Pattern],
    weights: DataFrame | None = None,
    prune: bool = False,
    stepwise: bool | None = None,
) -> DataFrame:
    """Solutions over ids, one column per variable; ``decode`` gives the terms."""
    over_ids = encode_patterns(patterns, dictionary)
    return match_bgp(encoded, over_ids, weights, prune=prune, stepwise=stepwise)
