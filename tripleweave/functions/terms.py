"""Terms: plain strings. ``?x`` is a variable, ``"..."`` a literal, anything else an IRI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the IRI of the class-membership predicate.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

# Fixed value: the short form accepted in patterns.
SHORT_TYPE = "rdf:type"

Pattern = tuple[str, str, str]


def is_var(term: str | int) -> bool:
    """Encoded constants are numbers, every other term is a string."""
    return isinstance(term, str) and term.startswith("?")


def is_literal(term: str) -> bool:
    return term.startswith('"')


def pattern_vars(pattern: Pattern) -> list[str]:
    """Variable names of one pattern, first seen first, without the question mark."""
    return list(dict.fromkeys(t[1:] for t in pattern if is_var(t)))


def full_pattern(pattern: Pattern) -> Pattern:
    """The pattern with a short ``rdf:type`` predicate written out."""
    s, p, o = pattern
    return (s, RDF_TYPE if p == SHORT_TYPE else p, o)


def check_names(patterns: list[Pattern]) -> None:
    """Refuse variables that differ only by case: Spark resolves columns without it."""
    seen: dict[str, str] = {}
    for name in (v for pat in patterns for v in pattern_vars(pat)):
        if not name:
            raise ValueError("a variable needs a name after '?'")
        if seen.setdefault(name.lower(), name) != name:
            raise ValueError(f"variables ?{seen[name.lower()]} and ?{name} differ only by case")


def kind(p: str = "p", o: str = "o") -> Column:
    """``literal``, ``type`` or ``object``; a literal object wins over the type predicate."""
    return (
        F.when(F.col(o).startswith('"'), "literal")
        .when(F.col(p) == RDF_TYPE, "type")
        .otherwise("object")
    )
