"""A triples view over sales tables (regions, nations, customers, suppliers, parts, orders, lines).

The view is a lazy union. For a set of patterns it has one scan per predicate: a filter on ``p`` reaches
each of them as a comparison of two constants, so a pattern reads only the table columns of its own
predicate. For an operator over all triples it has one scan per table.
Entity keys are unique in their tables; only branches over order lines need a distinct, which is done
on the short keys before the terms are spelled out.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.session import literal_table
from tripleweave.functions.terms import RDF_TYPE, Pattern, full_pattern, is_var
from tripleweave.operators.inference import CLASS_SUPERS, PREFIX


class Branch(NamedTuple):
    """The triples of one predicate: a table and the three terms made from each of its rows."""

    source: DataFrame
    s: Column
    p: str
    o: Column
    cls: str | None  # the object, where it is the same for the whole branch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"<{kind}/"), F.col(key).cast("string"), F.lit(">"))


def text(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


def _branch(source: DataFrame, s: Column, p: str, o: Column | str) -> Branch:
    if isinstance(o, str):
        return Branch(source, s, p, F.lit(o), o)
    return Branch(source, s, p, o, None)


def _branches(spark: SparkSession, sf_dir: str, distinct: bool = True) -> list[Branch]:
    region, nation, customer, supplier, part, orders, lineitem = (
        table(spark, sf_dir, t)
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    )

    def pairs(*cols: str) -> DataFrame:
        return lineitem.select(*cols).distinct() if distinct else lineitem

    entities = [
        ("region", region, "r_regionkey"),
        ("nation", nation, "n_nationkey"),
        ("customer", customer, "c_custkey"),
        ("supplier", supplier, "s_suppkey"),
        ("part", part, "p_partkey"),
        ("order", orders, "o_orderkey"),
    ]
    of_nation = iri("nation", "n_nationkey")
    of_customer = iri("customer", "c_custkey")
    of_order = iri("order", "o_orderkey")
    of_line = iri("order", "l_orderkey")
    return [
        *(
            _branch(df, iri(kind, key), RDF_TYPE, f"<{kind.capitalize()}>")
            for kind, df, key in entities
        ),
        *(
            _branch(df, iri(kind, key), "<name>", text(f"{key[0]}_name"))
            for kind, df, key in entities
            if kind != "order"
        ),
        _branch(customer, of_customer, "<segment>", text("c_mktsegment")),
        _branch(part, iri("part", "p_partkey"), "<brand>", text("p_brand")),
        _branch(orders, of_order, "<status>", text("o_orderstatus")),
        _branch(orders, of_order, "<priority>", text("o_orderpriority")),
        _branch(pairs("l_orderkey", "l_returnflag"), of_line, "<shipFlag>", text("l_returnflag")),
        _branch(nation, of_nation, "<inRegion>", iri("region", "n_regionkey")),
        _branch(customer, of_customer, "<fromNation>", iri("nation", "c_nationkey")),
        _branch(supplier, iri("supplier", "s_suppkey"), "<basedIn>", iri("nation", "s_nationkey")),
        _branch(orders, of_order, "<placedBy>", iri("customer", "o_custkey")),
        _branch(
            pairs("l_orderkey", "l_partkey"), of_line, "<contains>", iri("part", "l_partkey")
        ),
        _branch(
            pairs("l_orderkey", "l_suppkey"), of_line, "<suppliedBy>", iri("supplier", "l_suppkey")
        ),
        _branch(
            pairs("l_partkey", "l_suppkey"),
            iri("part", "l_partkey"), "<soldBy>", iri("supplier", "l_suppkey"),
        ),
    ]


def _terms(branch: Branch) -> list[Column]:
    return [branch.s.alias("s"), F.lit(branch.p).alias("p"), branch.o.alias("o")]


def _by_predicate(branches: list[Branch]) -> DataFrame:
    """One scan per predicate: a pattern reads the columns of its own predicate only."""
    return reduce(DataFrame.unionByName, [b.source.select(*_terms(b)) for b in branches])


def _by_table(branches: list[Branch]) -> DataFrame:
    """One scan per table: a reader of all triples goes over each table once."""
    sources: dict[int, list[Branch]] = {}
    for b in branches:
        sources.setdefault(id(b.source), []).append(b)
    return reduce(
        DataFrame.unionByName,
        [
            group[0].source.select(F.inline(F.array(*(F.struct(*_terms(b)) for b in group))))
            for group in sources.values()
        ],
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a set of triples."""
    return _by_table(_branches(spark, sf_dir))


def triples_for(spark: SparkSession, sf_dir: str, patterns: list[Pattern]) -> DataFrame:
    """The part of the view that can match one of the patterns, with a scan of its own per predicate."""
    full = [full_pattern(p) for p in patterns]

    def can_match(b: Branch) -> bool:
        return any(
            is_var(p) or (p == b.p and (not b.cls or is_var(o) or o == b.cls)) for _, p, o in full
        )

    branches = _branches(spark, sf_dir)
    matching = [b for b in branches if can_match(b)]
    return _by_predicate(matching) if matching else _by_predicate(branches[:1]).where(F.lit(False))


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as the tables give it, with repeated triples (one per order line)."""
    return _by_table(_branches(spark, sf_dir, distinct=False))


# The rules of the view, (class, derived class) and (predicate, derived predicate).
CLASS_RULES = [("<Customer>", "<Party>"), ("<Supplier>", "<Party>")]
PREDICATE_RULES = [("<fromNation>", "<locatedIn>"), ("<basedIn>", "<locatedIn>")]


def rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        literal_table(spark, CLASS_RULES, ["cls", "super"]),
        literal_table(spark, PREDICATE_RULES, ["pred", "super"]),
    )


def university_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables seen through the university vocabulary, to exercise its rules.

    Each customer belongs to the class that its nation's number picks; each supplier heads its nation.
    """
    classes = F.array(*(F.lit(f"<{PREFIX}{name}>") for name in CLASS_SUPERS))
    picked = F.element_at(classes, F.col("c_nationkey") % len(CLASS_SUPERS) + 1)
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return _by_table(
        [
            _branch(customer, iri("customer", "c_custkey"), RDF_TYPE, picked),
            _branch(
                supplier,
                iri("supplier", "s_suppkey"), f"<{PREFIX}headOf>", iri("nation", "s_nationkey"),
            ),
        ]
    )
