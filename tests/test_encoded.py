"""Matching over ids gives the same answer as over terms."""

import pytest
from helpers import TYPE, frame, solutions

from tripleweave.operators import encoded, nodes
from tripleweave.operators.match import match_bgp

TRIPLES = [
    ("a", TYPE, "C"), ("b", TYPE, "C"), ("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a"),
    ("b", "q", "a"), ("a", "n", '"1"'),
]
QUERIES = [
    [("?x", "rdf:type", "C"), ("?x", "p", "?y")],
    [("?x", "p", "?y"), ("?y", "p", "?z"), ("?z", "q", "?x")],
    [("a", "n", "?v")],
    [("?x", "p", "unknown")],
    [("?x", "?r", "a"), ("a", "p", "b")],
    [("a", "p", "nobody"), ("?x", "p", "?y")],
]


@pytest.mark.parametrize("patterns", QUERIES)
def test_same_answer(spark, patterns):
    df = frame(spark, TRIPLES)
    ids = nodes.node_ids(df)
    over_ids = encoded.match_encoded(encoded.encode_triples(df, ids), ids, patterns)
    wanted = match_bgp(df, patterns)
    found = encoded.decode(over_ids, ids)
    assert found.columns == wanted.columns
    assert solutions(found) == solutions(wanted)


def test_a_variable_is_a_predicate_or_a_node(spark):
    df = frame(spark, TRIPLES)
    ids = nodes.node_ids(df)
    with pytest.raises(ValueError, match="predicate"):
        encoded.encode_patterns([("?x", "?r", "?y"), ("?r", "p", "?z")], ids)
