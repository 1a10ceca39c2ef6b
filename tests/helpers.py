"""A naive evaluator to compare with, and small conveniences."""

from __future__ import annotations

from tripleweave.functions.terms import RDF_TYPE

TYPE = RDF_TYPE


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "s string, p string, o string")


def solutions(df):
    """The rows as a sorted list of tuples, in column order."""
    return sorted(tuple(r) for r in df.collect())


def brute_force(triples, patterns):
    """All bindings by trying every triple for every pattern; columns in first-seen order."""
    names = list(dict.fromkeys(t for pat in patterns for t in pat if t.startswith("?")))
    found = [{}]
    for pattern in patterns:
        grown = []
        for binding in found:
            for triple in triples:
                new = dict(binding)
                if all(
                    new.setdefault(t, v) == v if t.startswith("?") else t == v
                    for t, v in zip(pattern, triple)
                ):
                    grown.append(new)
        found = grown
    return sorted({tuple(b[n] for n in names) for b in found})
