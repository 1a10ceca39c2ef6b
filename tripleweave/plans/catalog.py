"""One query per operator and workload entry, each over the whole sales tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import RDF_TYPE, Pattern
from tripleweave.operators import encoded, graph, inference, match, nodes, scans, stats
from tripleweave.plans import jobs
from tripleweave.plans.workload import CYCLE, W3, W8, W9, WORKLOAD
from tripleweave.session import cut, literal_table, scratch_path, tune
from tripleweave.sources import tables, text

Query = Callable[[SparkSession, str], DataFrame]

#: How the graphs that queries write as text are packed.
PACKED = "gzip"
URGENT_FILLED = [(RDF_TYPE, "<Order>"), ("<status>", '"F"'), ("<priority>", '"1-URGENT"')]
ROOTS = ["<region/1>", "<supplier/3>", "<customer/7>"]
WEIGHTED = [
    ("?ord", "<contains>", "?part"),
    ("?ord", RDF_TYPE, "<Order>"),
    ("?part", "<brand>", "?brand"),
    ("?ord", "<placedBy>", "?cust"),
    ("?cust", "<fromNation>", "?nat"),
    ("?nat", "<inRegion>", "<region/1>"),
]


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.triples(tune(spark), sf_dir)


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with repeats, for operators that make its nodes distinct: no triple is shuffled for that first."""
    return tables.raw_triples(tune(spark), sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.object_edges(_view(spark, sf_dir))


def _bgp(spark: SparkSession, sf_dir: str, patterns: list[Pattern], **options) -> DataFrame:
    return match.match_bgp(tables.triples_for(tune(spark), sf_dir, patterns), patterns, **options)


def _scan(spark: SparkSession, sf_dir: str, pattern: Pattern) -> DataFrame:
    return scans.scan_pattern(tables.triples_for(tune(spark), sf_dir, [pattern]), pattern)


# --- sources and sinks -------------------------------------------------------------------------


def read_triples(spark, sf_dir):
    path = scratch_path(spark)
    text.write_triples(_view(spark, sf_dir), path, PACKED)
    return text.read_triples(spark, path)


def _mixed_lines(spark, sf_dir):
    """The view as lines, with lines made of the customers that are no triples, or are in spite of a comment."""
    path = scratch_path(spark)
    key = F.col("c_custkey").cast("string")
    broken = [
        F.concat(F.lit("<customer/"), key, F.lit('> <says> "one two three')),
        F.concat(F.lit("<customer/"), key, F.lit("> <knows> <customer/1> <graph> .")),
        F.concat(F.lit("# <customer/"), key, F.lit("> <knows> <customer/1> .")),
        F.concat(F.lit("  <customer/"), key, F.lit("> <knows>")),
        F.lit("   "),
        F.concat(F.lit('<customer/1> <says> "'), key, F.lit('"@en and more .')),
        F.concat(F.lit("<customer/1> <says> \"'"), key, F.lit("'\" . # say \"w\"")),
        F.concat(F.lit("<customer/1> <knows> <customer/"), key, F.lit(">.")),
    ]
    customers = tables.table(spark, sf_dir, "customer").select(F.explode(F.array(*broken)).alias("line"))
    text.write_lines(text.triple_lines(_view(spark, sf_dir)).unionByName(customers), path, PACKED)
    return path


def rejected_lines(spark, sf_dir):
    return text.rejected_lines(spark, _mixed_lines(spark, sf_dir))


def read_mixed(spark, sf_dir):
    """What is read beside rejected lines; rejected and read lines together are all lines."""
    return text.read_triples(spark, _mixed_lines(spark, sf_dir), distinct=False)


def read_weights(spark, sf_dir):
    path = scratch_path(spark)
    text.weight_lines(stats.predicate_weights(_view(spark, sf_dir))).write.text(path)
    return text.read_weights(spark, path)


def write_triples(spark, sf_dir):
    path = scratch_path(spark)
    text.write_triples(_view(spark, sf_dir), path, PACKED)
    return spark.read.text(path).withColumnRenamed("value", "line")


def vertex_lines(spark, sf_dir):
    return text.vertex_lines(encoded_vertices(spark, sf_dir))


def edge_lines(spark, sf_dir):
    return text.edge_lines(encoded_edges(spark, sf_dir))


def solution_lines(spark, sf_dir):
    return text.solution_lines(_bgp(spark, sf_dir, W9))


# --- the jobs on text files ---------------------------------------------------------------------


def _text(spark, sf_dir):
    path = scratch_path(spark)
    text.write_triples(_view(spark, sf_dir), path, PACKED)
    return path


def answer_text(spark, sf_dir):
    """Text and a file of weights in, solutions out."""
    weights = scratch_path(spark)
    text.weight_lines(stats.predicate_sizes(_view(spark, sf_dir))).write.text(weights)
    return jobs.answer(spark, _text(spark, sf_dir), WEIGHTED, weights)


def inferred_text(spark, sf_dir):
    """Text in, text with all that follows out; read again without a set's comparison."""
    target = scratch_path(spark)
    jobs.add_inferred(spark, _text(spark, sf_dir), target, tables.rules(spark), PACKED)
    return text.read_triples(spark, target, distinct=False)


def loaded_graph(spark, sf_dir):
    """Text in, vertex and edge lines out, with the next free id on a line of its own."""
    vertices, edges = scratch_path(spark), scratch_path(spark)
    free = jobs.load_graph(spark, _text(spark, sf_dir), vertices, edges, compression=PACKED)
    parts = [("vertex", spark.read.text(vertices)), ("edge", spark.read.text(edges))]
    lines = [df.select(F.lit(kind).alias("kind"), F.col("value").alias("line")) for kind, df in parts]
    last = literal_table(spark, [("next", str(free))], ["kind", "line"])
    return lines[0].unionByName(lines[1]).unionByName(last)


# --- projections, filters, predicates ----------------------------------------------------------


def classify_triples(spark, sf_dir):
    return scans.classify(_view(spark, sf_dir))


def edges_by_predicate(spark, sf_dir):
    predicates = ["<contains>", "<placedBy>"]
    view = tables.triples_for(tune(spark), sf_dir, [("?s", p, "?o") for p in predicates])
    return scans.edges_by_predicate(view, predicates)


def filter_by_properties(spark, sf_dir):
    view = tables.triples_for(tune(spark), sf_dir, [("?x", p, o) for p, o in URGENT_FILLED])
    return scans.filter_by_properties(view, URGENT_FILLED)


def candidate_nodes(spark, sf_dir):
    view = tables.triples_for(tune(spark), sf_dir, [("?x", p, o) for p, o in URGENT_FILLED])
    return scans.candidate_nodes(view, URGENT_FILLED)


def self_loop(spark, sf_dir):
    """Nations that buy from a supplier of their own, out of all nation-to-nation trade edges."""
    patterns = [
        ("?ord", "<placedBy>", "?cust"),
        ("?cust", "<fromNation>", "?buyer"),
        ("?ord", "<suppliedBy>", "?sup"),
        ("?sup", "<basedIn>", "?seller"),
    ]
    trade = (
        _bgp(spark, sf_dir, patterns)
        .select(F.col("buyer").alias("s"), F.lit("<buysFrom>").alias("p"), F.col("seller").alias("o"))
        .distinct()
    )
    return match.match_bgp(trade, [("?x", "<buysFrom>", "?x")])


# --- joins -------------------------------------------------------------------------------------


def natural_join(spark, sf_dir):
    return match.natural_join(
        _scan(spark, sf_dir, ("?ord", "<placedBy>", "?cust")),
        _scan(spark, sf_dir, ("?cust", "<fromNation>", "?nat")),
    )


def cross_bindings(spark, sf_dir):
    """Solutions of two unconnected pattern sets, counted without multiplying them out."""
    patterns = [
        ("?cust", "<fromNation>", "<nation/3>"),
        ("?cust", "<segment>", "?seg"),
        ("?part", "<brand>", "?brand"),
        ("?part", "<soldBy>", "?sup"),
    ]
    view = tables.triples_for(tune(spark), sf_dir, patterns)
    return match.count_solutions(*match.match_components(view, patterns))


def extend_forward(spark, sf_dir):
    step = ("?ord", "<contains>", "?part")
    return match.extend(
        _scan(spark, sf_dir, ("?ord", "<placedBy>", "?cust")),
        tables.triples_for(spark, sf_dir, [step]),
        step,
    )


def extend_backward(spark, sf_dir):
    step = ("?ord", "<placedBy>", "?cust")
    return match.extend(
        _scan(spark, sf_dir, ("?cust", "<fromNation>", "<nation/3>")),
        tables.triples_for(spark, sf_dir, [step]),
        step,
    )


def subject_vertices(spark, sf_dir):
    view = _view(spark, sf_dir)
    return nodes.subject_vertices(view, node_ids(spark, sf_dir))


def object_vertices(spark, sf_dir):
    view = _view(spark, sf_dir)
    return nodes.object_vertices(view, node_ids(spark, sf_dir))


def encode_edges(spark, sf_dir):
    """Edges over ids, with a dictionary of the nodes of orders and parts only."""
    view = _view(spark, sf_dir)
    some = scans.edges_by_predicate(view, ["<contains>", "<placedBy>"])
    return nodes.encode_edges(scans.object_edges(view), nodes.node_ids(some))


def match_weighted(spark, sf_dir):
    weights = stats.predicate_sizes(tables.triples_for(tune(spark), sf_dir, WEIGHTED))
    return _bgp(spark, sf_dir, WEIGHTED, weights=weights)


def match_encoded(spark, sf_dir):
    """The cycle over ids, its answer turned back into terms."""
    view = tables.triples_for(tune(spark), sf_dir, CYCLE)
    dictionary = nodes.node_ids(view)
    found = encoded.match_encoded(encoded.encode_triples(view, dictionary), dictionary, CYCLE)
    return encoded.decode(found, dictionary)


def exists_pattern(spark, sf_dir):
    sold = ("?ord", "<contains>", "?part")
    return match.exists_pattern(
        _scan(spark, sf_dir, ("?part", RDF_TYPE, "<Part>")),
        tables.triples_for(spark, sf_dir, [sold]),
        sold,
    )


# --- aggregations ------------------------------------------------------------------------------


def distinct_edges(spark, sf_dir):
    return nodes.distinct_edges(scans.object_edges(_repeated(spark, sf_dir)))


def count_solutions(spark, sf_dir):
    return match.count_solutions(_bgp(spark, sf_dir, W9))


def richest_record(spark, sf_dir):
    """Each node known as an object (no properties) and as a subject (with its own): keep the richer."""
    view = _view(spark, sf_dir)
    as_object = view.select(
        F.col("o").alias("id"),
        F.lit("object").alias("record"),
        F.lit(None).cast("string").alias("p"),
        F.lit(None).cast("string").alias("o"),
    ).distinct()
    as_subject = nodes.node_properties(view).select(
        F.col("node").alias("id"), F.lit("subject").alias("record"), "p", "o"
    )
    return nodes.richest_record(as_object.unionByName(as_subject))


# --- set operations ----------------------------------------------------------------------------


def union_bindings(spark, sf_dir):
    return match.union_bindings(
        _scan(spark, sf_dir, ("?who", "<fromNation>", "?nat")),
        _scan(spark, sf_dir, ("?who", "<basedIn>", "?nat")).select("nat", "who"),
    )


def merge_bindings(spark, sf_dir):
    """Same columns are united, then another table is joined on."""
    return match.merge_bindings(
        match.merge_bindings(
            _scan(spark, sf_dir, ("?who", "<fromNation>", "?nat")),
            _scan(spark, sf_dir, ("?who", "<basedIn>", "?nat")),
        ),
        _scan(spark, sf_dir, ("?nat", "<inRegion>", "?reg")),
    )


# --- dictionary encoding -----------------------------------------------------------------------


def node_ids(spark, sf_dir):
    return nodes.node_ids(_repeated(spark, sf_dir))


def extend_node_ids(spark, sf_dir):
    """Number the nodes of customers and nations first, then add those of the whole view."""
    view = _view(spark, sf_dir)
    first = scans.edges_by_predicate(view, ["<fromNation>", "<inRegion>"])
    return nodes.extend_node_ids(nodes.node_ids(first), view)


def encoded_vertices(spark, sf_dir):
    view = _view(spark, sf_dir)
    return nodes.encoded_vertices(view, node_ids(spark, sf_dir))


def encoded_edges(spark, sf_dir):
    view = _view(spark, sf_dir)
    return nodes.encoded_edges(view, node_ids(spark, sf_dir))


def graph_vertices(spark, sf_dir):
    """The vertex lines of the graph loader: no literals or classes, ids from one."""
    view = _view(spark, sf_dir)
    dictionary = nodes.number_nodes(nodes.graph_nodes(_repeated(spark, sf_dir)), start=1)
    return text.vertex_lines(nodes.encoded_vertices(view, dictionary))


def graph_edges(spark, sf_dir):
    """The edge lines that go with ``graph_vertices``."""
    view = _view(spark, sf_dir)
    dictionary = nodes.number_nodes(nodes.graph_nodes(_repeated(spark, sf_dir)), start=1)
    return text.edge_lines(nodes.encoded_edges(view, dictionary))


# --- inference ---------------------------------------------------------------------------------


def infer_types(spark, sf_dir):
    return inference.infer_types(_view(spark, sf_dir), tables.rules(spark)[0])


def infer_predicates(spark, sf_dir):
    return inference.infer_predicates(_view(spark, sf_dir), tables.rules(spark)[1])


def materialize(spark, sf_dir, distinct=True):
    return inference.materialize(_view(spark, sf_dir), *tables.rules(spark), distinct=distinct)


def lubm_rules(spark, sf_dir):
    university = tables.university_triples(tune(spark), sf_dir)
    return inference.materialize(university, *inference.lubm_rules(spark))


def w3(spark, sf_dir):
    """Over what the rules derive, rewritten into patterns over stated triples."""
    rules = tables.rules(tune(spark))
    stated = [p for forms in inference.stated_patterns(W3, *rules).values() for p in forms]
    return inference.match_derivable(tables.triples_for(spark, sf_dir, stated), W3, *rules)


# --- graph operators ---------------------------------------------------------------------------


def _kept_edges(spark, sf_dir):
    """The edges written out, for operators that read them several times: the tables are gone over once."""
    return cut(_edges(spark, sf_dir))


def _digit_weights(edges):
    """A small whole weight per predicate: the number of digits of its size."""
    digits = F.length(F.col("weight").cast("bigint").cast("string")).cast("double")
    return stats.predicate_sizes(edges).select("p", digits.alias("weight"))


def _forest(edges):
    return graph.min_spanning_forest(edges, stats.predicate_sizes(edges))


def min_spanning_forest(spark, sf_dir):
    return _forest(_kept_edges(spark, sf_dir))


def non_tree_edges(spark, sf_dir):
    edges = _kept_edges(spark, sf_dir)
    return graph.non_tree_edges(edges, _forest(edges))


def forest_by_predicate(spark, sf_dir):
    """How many edges of each predicate the forest takes, and leaves out."""
    edges = _kept_edges(spark, sf_dir)
    forest = cut(_forest(edges))
    rest = graph.non_tree_edges(edges, forest)
    parts = forest.select("p", F.lit(1).alias("tree")).unionByName(
        rest.select("p", F.lit(0).alias("tree"))
    )
    return parts.groupBy("p").agg(
        F.sum("tree").alias("n_tree"), F.sum(1 - F.col("tree")).alias("n_rest")
    )


def hop_levels(spark, sf_dir):
    return graph.hop_levels(_kept_edges(spark, sf_dir), ROOTS)


def level_weights(spark, sf_dir):
    edges = _kept_edges(spark, sf_dir)
    found = graph.level_weights(edges, graph.hop_levels(edges, ROOTS), _digit_weights(edges))
    return found.select("root", "n_levels", F.round("weight_var", 2).alias("weight_var"))


def rank_roots(spark, sf_dir):
    """The best root of the given ones."""
    return graph.rank_roots(level_weights(spark, sf_dir)).limit(1)


def queries() -> dict[str, Query]:
    def on_view(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_view(spark, sf_dir))

    def on_edges(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(_edges(spark, sf_dir))

    def scan(*pattern: str) -> Query:
        return partial(_scan, pattern=pattern)

    def bgp(patterns: list[Pattern], **options) -> Query:
        return partial(_bgp, patterns=patterns, **options)

    return {
        "read_triples": read_triples,
        "read_mixed": read_mixed,
        "rejected_lines": rejected_lines,
        "read_weights": read_weights,
        "write_triples": write_triples,
        "vertex_lines": vertex_lines,
        "edge_lines": edge_lines,
        "solution_lines": solution_lines,
        "answer_text": answer_text,
        "inferred_text": inferred_text,
        "loaded_graph": loaded_graph,
        "classify_triples": classify_triples,
        "object_edges": on_view(scans.object_edges),
        "edges_by_predicate": edges_by_predicate,
        "scan_pattern": scan("?x", "<placedBy>", "?y"),
        "scan_any_predicate": on_view(lambda t: scans.scan_pattern(t, ("?x", "?p", "<nation/3>"))),
        "const_term": scan("?x", "<fromNation>", "<nation/3>"),
        "const_subject": scan("<order/1>", "<contains>", "?y"),
        "filter_by_properties": filter_by_properties,
        "bind_property": scan("?x", "<shipFlag>", "?v"),
        "bind_class": scan("?x", "rdf:type", "?c"),
        "self_loop": self_loop,
        "project_terms": bgp(W8, keep_constants=True),
        "natural_join": natural_join,
        "cross_bindings": cross_bindings,
        "extend_forward": extend_forward,
        "extend_backward": extend_backward,
        "star_match": bgp(
            [
                ("?ord", "<status>", "?status"),
                ("?ord", "<priority>", "?priority"),
                ("?ord", "<placedBy>", "?cust"),
                ("?ord", "<suppliedBy>", "?sup"),
            ]
        ),
        "path_match": bgp(
            [
                ("?ord", "<placedBy>", "?cust"),
                ("?cust", "<fromNation>", "?nat"),
                ("?nat", "<inRegion>", "?reg"),
            ]
        ),
        "cycle_match": bgp(CYCLE),
        "five_cycle": bgp(
            [
                ("?ord", "<placedBy>", "?cust"),
                ("?cust", "<fromNation>", "?nat"),
                ("?sup", "<basedIn>", "?nat"),
                ("?part", "<soldBy>", "?sup"),
                ("?ord", "<contains>", "?part"),
            ]
        ),
        "subject_vertices": subject_vertices,
        "object_vertices": object_vertices,
        "encode_edges": encode_edges,
        "match_bgp": match_weighted,
        "match_pruned": bgp(WEIGHTED, prune=True),
        "match_encoded": match_encoded,
        "exists_pattern": exists_pattern,
        "distinct_nodes": lambda spark, sf_dir: nodes.distinct_nodes(_repeated(spark, sf_dir)),
        "distinct_edges": distinct_edges,
        "node_properties": on_view(nodes.node_properties),
        "count_solutions": count_solutions,
        "richest_record": richest_record,
        "predicate_weights": on_view(stats.predicate_weights),
        "node_degrees": on_edges(stats.node_degrees),
        "top_degree_node": on_edges(stats.top_degree_node),
        "candidate_nodes": candidate_nodes,
        "union_bindings": union_bindings,
        "merge_bindings": merge_bindings,
        "all_vertices": on_view(nodes.all_vertices),
        "derived_union": partial(materialize, distinct=False),
        "node_ids": node_ids,
        "extend_node_ids": extend_node_ids,
        "encoded_vertices": encoded_vertices,
        "encoded_edges": encoded_edges,
        "graph_vertices": graph_vertices,
        "graph_edges": graph_edges,
        "infer_types": infer_types,
        "infer_predicates": infer_predicates,
        "materialize": materialize,
        "lubm_rules": lubm_rules,
        "min_spanning_forest": min_spanning_forest,
        "non_tree_edges": non_tree_edges,
        "forest_by_predicate": forest_by_predicate,
        "hop_levels": hop_levels,
        "level_weights": level_weights,
        "rank_roots": rank_roots,
        "w3": w3,
        **{key: bgp(w) for key, w in WORKLOAD.items() if key not in ("w3", "cycle_match")},
    }
