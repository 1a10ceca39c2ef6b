"""Joining binding tables, and matching whole sets of triple patterns.

A binding table is a DataFrame with one string column per variable. All joins are equi-joins on the
columns two tables share, so Spark picks broadcast, hash or sort-merge by size and splits hot keys at
run time. Nothing here multiplies tables that share no column: patterns that fall into unconnected parts
are answered part by part (``match_components``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.terms import (
    RDF_TYPE,
    Pattern,
    check_names,
    full_pattern,
    is_literal,
    is_var,
    pattern_vars,
)
from tripleweave.operators.joins import skew_join
from tripleweave.operators.scans import scan_pattern
from tripleweave.session import cut

#: Gives the rows of a triples frame that match a pattern, one column per variable.
Scan = Callable[[DataFrame, Pattern], DataFrame]

# Fixed value: a scan with no more continuations per node than this is grown along without comparing the others.
FEW = 16
# Fixed value: a scan with no more rows per node than this is packed into one row per node to check others by.
MANY = 256


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on all shared columns; columns of ``a`` first, then the new ones of ``b``."""
    shared = shared_columns(a, b)
    if not shared:
        raise ValueError(f"no shared column between {a.columns} and {b.columns}")
    return skew_join(a, b, shared).select(*a.columns, *(c for c in b.columns if c not in shared))


def union_bindings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append the rows of ``b``, its columns put in the order of ``a``; repeats are kept."""
    return a.unionByName(b)


def merge_bindings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union if both tables have the same columns, else natural join; without columns in ``a``, ``b``."""
    if not a.columns:
        return b
    return union_bindings(a, b) if set(a.columns) == set(b.columns) else natural_join(a, b)


def extend(bindings: DataFrame, triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Grow bindings by one pattern, in whichever direction its bound end lies."""
    return natural_join(bindings, scan_pattern(triples, pattern))


def exists_pattern(
    bindings: DataFrame, triples: DataFrame, pattern: Pattern, scan: Scan = scan_pattern
) -> DataFrame:
    """Keep the bindings for which the pattern has at least one match."""
    found = scan(triples, pattern)
    if not found.columns:
        return bindings.where(found.select(F.lit(1).alias("one")).exists())
    shared = shared_columns(bindings, found)
    if not shared:
        raise ValueError(f"{pattern} shares no variable with {bindings.columns}")
    if len(shared) < len(found.columns):
        found = found.select(*shared).distinct()  # a hot node is one row to look up
    return skew_join(bindings, found, shared, "left_semi").select(*bindings.columns)


def _most_rows(scans: list[DataFrame], keys: list[list[str]]) -> list[int]:
    """For each scan the most rows that one key has; all in one job, which gives the driver a number per scan."""
    most = [
        scan.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
        for scan, key in zip(scans, keys)
    ]
    rows = reduce(DataFrame.unionByName, [m.select(F.lit(i).alias("i"), "n") for i, m in enumerate(most)]).collect()
    scans[0].sparkSession._jvm.System.gc()  # what was shuffled to count is not kept beside what is shuffled to join
    found = {r["i"]: r["n"] or 0 for r in rows}
    return [found[i] for i in range(len(scans))]


def _extend_packed(bindings: DataFrame, scan: DataFrame, checks: list[DataFrame], new: str) -> DataFrame:
    """Grow bindings along ``scan`` and keep what all ``checks`` have, a binding staying one row until the end.

    Its continuations travel as an array, so that a join shuffles each binding once and not once per continuation.
    Every node of a scan becomes a row of its own; no scan may have many rows per node. Repeats are kept.
    What is found is written before each check, so that no more than one join's shuffles are kept at a time.
    """

    def packed(rows: DataFrame) -> DataFrame:
        key = shared_columns(bindings, rows)
        return rows.dropna(subset=key).groupBy(*key).agg(F.collect_list(new).alias("__met"))

    found = natural_join(bindings, packed(scan).withColumnRenamed("__met", "__new"))
    for check in checks:
        # Whether a node has a value twice is found once per node, not once per binding.
        once = F.size(F.array_distinct("__met")) == F.size("__met")
        met = natural_join(cut(found), packed(check).withColumn("__once", once))
        kept = F.filter("__new", lambda x: F.array_contains("__met", x))
        repeated = F.flatten(F.transform("__new", lambda x: F.filter("__met", lambda y: y == x)))
        found = met.select(*bindings.columns, F.when(F.col("__once"), kept).otherwise(repeated).alias("__new"))
    return found.select(*bindings.columns, F.explode("__new").alias(new))


def extend_closed(bindings: DataFrame, scans: list[DataFrame]) -> DataFrame:
    """Bind one new variable that several pattern scans restrict at once.

    Growing along one scan and checking the others afterwards would build every pair around a hot
    node. If one scan has ``FEW`` continuations per node at most, all bindings grow along it; where no other scan
    has more than ``MANY`` rows per node, a binding is shuffled once with all of its continuations. Else a scan
    that has each value of the new variable once at most is joined to another scan first, which leaves that
    one no longer, and the bindings meet both in one join without a row too many. Else each binding grows
    along the scan that offers it the fewest continuations, counted per node beforehand. Scans that are not
    grown along only check the result. For a triangle this keeps the intermediate rows within edges^1.5
    whatever the degrees are, or within ``FEW`` times the bindings.
    """
    new = next(c for c in scans[0].columns if c not in bindings.columns)
    keys = [shared_columns(bindings, scan) for scan in scans]
    most = _most_rows(scans, keys)
    if min(most) <= FEW:
        first = most.index(min(most))
        others = scans[:first] + scans[first + 1 :]
        if most[first] > 1 and max(most) <= MANY:
            return _extend_packed(bindings, scans[first], others, new)
        return reduce(natural_join, others, natural_join(bindings, scans[first]))
    once = [n <= 1 for n in _most_rows(scans, [[new]] * len(scans))]
    if any(once):
        others = [scan for scan, single in zip(scans, once) if not single]
        singles = [scan for scan, single in zip(scans, once) if single]
        others = others or [singles.pop(0)]
        scans = [reduce(natural_join, singles, others[0]), *others[1:]]
        return natural_join(bindings, scans[0]) if len(scans) == 1 else extend_closed(bindings, scans)
    counts = [f"__n{i}" for i in range(len(scans))]
    turns = range(len(scans))
    single = all(len(key) == 1 for key in keys)

    def term(key: list[str]) -> Column:
        return F.col(key[0]) if single else F.array(*key)

    def joined_with(rows: DataFrame, shift: int, on: list[str]) -> DataFrame:
        """Join every row with the scan ``shift`` places after the one it grows along, in one join:
        the scans are stacked and told apart by the turn they serve."""
        of_turn = [(i + shift) % len(scans) for i in turns]
        stacked = reduce(
            DataFrame.unionByName,
            [
                scans[j].select(F.lit(i).alias("__turn"), term(keys[j]).alias("__key"), new)
                for i, j in zip(turns, of_turn)
            ],
        )
        key = F.coalesce(
            *(F.when(F.col("__turn") == i, term(keys[j])) for i, j in zip(turns, of_turn))
        )
        return rows.withColumn("__key", key).join(stacked, ["__turn", "__key", *on]).drop("__key")

    rows = bindings
    for scan, key, n in zip(scans, keys, counts):
        rows = skew_join(rows, scan.groupBy(*key).agg(F.count(F.lit(1)).alias(n)), key)
    turn = F.array_position(F.array(*counts), F.least(*counts)) - 1
    rows = rows.withColumn("__turn", turn.cast("int")).drop(*counts)
    rows = joined_with(rows, 0, [])
    for shift in turns[1:]:
        rows = joined_with(rows, shift, [new])
    return rows.select(*bindings.columns, new)


def _components(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns grouped so that no variable occurs in two groups."""
    groups: list[tuple[set[str], list[Pattern]]] = []
    for pattern in patterns:
        names = set(pattern_vars(pattern))
        touching = [g for g in groups if g[0] & names]
        groups = [g for g in groups if not g[0] & names]
        names = names.union(*(g[0] for g in touching))
        groups.append((names, [p for g in touching for p in g[1]] + [pattern]))
    return [sorted(g[1], key=patterns.index) for g in groups]


def _weight_of(weights: DataFrame | None, patterns: list[Pattern]) -> dict[str, float]:
    """Weights of the query's own predicates: at most one row per pattern reaches the driver."""
    if weights is None:
        return {}
    used = sorted({p for _, p, _ in patterns if not is_var(p)})
    rows = (
        weights.where(F.col("p").isin(used)).groupBy("p").agg(F.max("weight").alias("weight"))
    ).collect()
    return {r["p"]: r["weight"] for r in rows}


def join_order(patterns: list[Pattern], weight: dict[str, float]) -> list[list[Pattern]]:
    """The steps in which connected patterns are joined, never leaving the bound variables.

    Starts at a constant if there is one, checks a pattern as soon as its variables are bound, and
    binds next the variable that most patterns restrict, then the one with the lightest pattern, then an
    object of what is bound before a subject (a hub is the object of many), then the first in the text.
    Patterns that bind the same variable make up one step.
    """

    def weight_of(pattern: Pattern) -> float:
        return weight.get(pattern[1], 0.0)

    def start_rank(pattern: Pattern) -> tuple:
        s, p, o = pattern
        rank = 2 if p == RDF_TYPE else int(is_var(s) and is_var(o))
        return rank, weight_of(pattern), patterns.index(pattern)

    def step_rank(step: list[Pattern]) -> tuple:
        backward = all(o[1:] in bound for _, _, o in step)
        return -len(step), min(map(weight_of, step)), backward, patterns.index(step[0])

    start = min(patterns, key=start_rank)
    steps = [[start]]
    bound = set(pattern_vars(start))
    todo = [p for p in patterns if p != start]
    while todo:
        closed = [p for p in todo if bound.issuperset(pattern_vars(p))]
        if closed:
            steps += [[p] for p in closed]
        else:
            by_new: dict[frozenset, list[Pattern]] = {}
            for pattern in todo:
                names = set(pattern_vars(pattern))
                if names & bound:
                    by_new.setdefault(frozenset(names - bound), []).append(pattern)
            step = min(by_new.values(), key=step_rank)
            step = sorted(step, key=weight_of)
            new = set(pattern_vars(step[0])) - bound
            steps.append(step if len(new) == 1 else step[:1])
            bound |= new
        todo = [p for p in todo if p not in {q for step in steps for q in step}]
    return steps


def _without_dead_ends(
    scans: dict[Pattern, DataFrame], order: list[Pattern]
) -> dict[Pattern, DataFrame]:
    """Filter each scan, last to first, by the scans that are joined to it later.

    A filtered scan is written out before others are filtered by it, as it is read again when the scans are joined:
    else each use would filter it anew, with all that it was filtered by.
    """
    scans, whole = dict(scans), dict(scans)
    for i in range(len(order) - 1, 0, -1):
        if scans[order[i]] is not whole[order[i]]:
            scans[order[i]] = cut(scans[order[i]])
        later = scans[order[i]]
        earlier = next(p for p in order[:i] if set(scans[p].columns) & set(later.columns))
        shared = shared_columns(scans[earlier], later)
        alive = later.select(*shared).distinct()
        kept = skew_join(scans[earlier], alive, shared, "left_semi")
        scans[earlier] = kept.select(*scans[earlier].columns)
    return scans


def _held_by_constant(pattern: Pattern) -> bool:
    """Whether a pattern names one of its ends; a class does not count, it may hold most nodes."""
    s, p, o = pattern
    return not is_var(s) or (not is_var(o) and p != RDF_TYPE)


def _match_connected(
    triples: DataFrame,
    patterns: list[Pattern],
    weight: dict[str, float],
    prune: bool,
    stepwise: bool | None,
    scan: Scan,
) -> DataFrame:
    steps = join_order(patterns, weight)
    if stepwise is None:
        stepwise = _held_by_constant(steps[0][0])
    scans = {p: scan(triples, p) for p in patterns}
    if prune:
        scans = _without_dead_ends(scans, [p for step in steps for p in step])
    bindings = scans[steps[0][0]]
    for i, step in enumerate(steps[1:]):
        # Before several scans are joined at once, shuffles made so far are let go.
        if stepwise or (i > 0 and len(step) > 1):
            bindings = cut(bindings)
        # A pattern whose columns are all bound only filters, as triples are a set. As an inner join
        # Spark may also broadcast a small binding table instead of shuffling the scan.
        if len(step) == 1:
            bindings = natural_join(bindings, scans[step[0]])
        else:
            bindings = extend_closed(bindings, [scans[p] for p in step])
    return bindings


def match_components(
    triples: DataFrame,
    patterns: list[Pattern],
    weights: DataFrame | None = None,
    prune: bool = False,
    stepwise: bool | None = None,
    scan: Scan = scan_pattern,
) -> list[DataFrame]:
    """Solutions of the patterns, one binding table per connected part.

    The solutions of the whole set are all combinations of one row per table; keeping the tables apart
    holds the same answer without multiplying it out. Patterns without variables are existence tests
    on every table.
    """
    check_names(patterns)
    todo = list(dict.fromkeys(full_pattern(p) for p in patterns))
    if not todo:
        raise ValueError("give at least one pattern")
    ground = [p for p in todo if not pattern_vars(p)]
    linked = [p for p in todo if pattern_vars(p)]
    weight = _weight_of(weights, linked)
    tables = []
    for part in _components(linked):
        names = list(dict.fromkeys(v for p in part for v in pattern_vars(p)))
        found = _match_connected(triples, part, weight, prune, stepwise, scan)
        tables.append(found.select(*names))
    if not tables:
        tables = [triples.sparkSession.range(1).select()]
    for pattern in ground:
        tables = [exists_pattern(table, triples, pattern, scan) for table in tables]
    return tables


def match_bgp(
    triples: DataFrame,
    patterns: list[Pattern],
    weights: DataFrame | None = None,
    keep_constants: bool = False,
    prune: bool = False,
    stepwise: bool | None = None,
    scan: Scan = scan_pattern,
) -> DataFrame:
    """All solutions of a connected set of triple patterns, one column per variable.

    ``weights`` (``p, weight``) makes light predicates come first. ``keep_constants`` adds a column
    for each constant end of an edge pattern, named after it, in first-seen order. ``prune`` first
    drops the triples that no later pattern can continue; for patterns without cycles every
    intermediate row then leads to a solution, which pays where many edges of hot nodes lead nowhere.
    ``stepwise`` writes the binding table out before each join, so that its true size decides how the
    join runs. By default that is done where the first pattern names one of its ends: what follows from
    a constant is often small, and then large predicates are scanned without being shuffled.
    ``scan`` finds the matches of one pattern (``inference.derivable`` finds derived ones as well).
    """
    tables = match_components(triples, patterns, weights, prune, stepwise, scan)
    if len(tables) > 1:
        raise ValueError(
            "the patterns fall into parts without a shared variable: "
            f"{[t.columns for t in tables]}; use match_components"
        )
    return project_terms(tables[0], patterns) if keep_constants else tables[0]


def match_star(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Patterns about one subject, over a store bucketed by subject (``store.load_bucketed``).

    The rows of a subject lie in the bucket of the same number under every predicate, so that the
    patterns are joined bucket by bucket and no scan is shuffled. In exchange the rows of a hot subject
    are one task's; use ``match_bgp`` where subjects are that uneven.
    """
    check_names(patterns)
    todo = list(dict.fromkeys(full_pattern(p) for p in patterns))
    subjects = {s for s, _, _ in todo}
    if len(subjects) != 1 or not is_var(next(iter(subjects))):
        raise ValueError(f"the patterns are about several subjects or a constant: {sorted(subjects)}")
    names = list(dict.fromkeys(v for p in todo for v in pattern_vars(p)))
    found = scan_pattern(triples, todo[0])
    for pattern in todo[1:]:
        more = scan_pattern(triples, pattern)
        found = found.join(more, shared_columns(found, more))
    return found.select(*names)


def project_terms(bindings: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Columns for all terms in first-seen order, constant ends of edge patterns included."""
    terms: list[str] = []
    for s, p, o in map(full_pattern, patterns):
        edge = p != RDF_TYPE and not is_literal(o)
        terms += [t for t in (s, p, o) if is_var(t) or (edge and t != p)]
    return bindings.select(
        *(
            F.col(t[1:]) if is_var(t) else F.lit(t).alias(t)
            for t in dict.fromkeys(terms)
        )
    )


def count_solutions(*tables: DataFrame) -> DataFrame:
    """Number of solutions, as ``DF(n)``; for several parts the product of their counts."""
    counts = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("part"), "n")
        for i, t in enumerate(tables)
    ]
    one_row = reduce(DataFrame.unionByName, counts).agg(
        *(F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(len(counts)))
    )
    return one_row.select(reduce(lambda a, b: a * b, map(F.col, one_row.columns)).alias("n"))
