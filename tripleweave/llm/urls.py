"""URL filters: host and path rules, and path templates judged by their labelled purity.

A page that no rule fits is judged by the template of its path. Per host, path segments become a tree;
segments that vary (numbers, long mixed tokens, or one of many different children none of which is common)
become wildcards, from the root down, so that what is below a wildcard is counted under the wildcard. Neither
test changes when pages are repeated. Siblings whose labels do not differ beyond chance are merged with the
rest of their parent. A branch is rejected when its share of good labels, smoothed towards the share of all, is
below a limit; the limit is the one that best tells bad from good among labels held back, of pages that no rule
fits. If none tells them apart, nothing is rejected. Everything is DataFrame functions; a host with a third of
all pages is counted in pre-aggregated rows, and joined back over splittable shuffles. The levels of the tree are
written tables of different paths; two single rows, the share of all and the limit, pass through the driver.

Defined cases: a url that is null or has no ``://`` has an empty host and path and no template of its own
beyond the empty one. A null page id stays null and has no labels; repeated rows are judged one by one. Pages
without labels on their branch get the share of all and so are allowed. Segments beyond the tree's ``LEVELS`` are
one wildcard, so that the longest path costs no more than its length. Of limits that do equally well the lowest
counts. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.joins import skew_join
from tripleweave.session import cut, discard

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with its path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

LEVELS = 8  # depth of the tree; what is deeper is one wildcard
MAX_CHILDREN = 50  # a node with more different children than this, all of them rare, is a wildcard
RARE = 10  # a child is rare if its parent has this many times its pages
DIFFERS = 2.576  # standard errors between a branch and its parent for the branch to stand alone
PRIOR_WEIGHT = 2.0  # labels that the share of all counts for in a branch
STEPS = 20  # limits tried: multiples of a STEPS-th of the share of all,
TRIED = 18  # up to this many; a branch that is less than a tenth worse than all pages is never rejected
REST = "<rest>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The part after the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null."""
    fits = (
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    )
    return reduce(lambda a, b: F.coalesce(a, b), fits)


def segments_of(path: Column) -> Column:
    """The non-empty segments of a path, those that look like values already as wildcards.

    A wildcard keeps the lexical class it came from: numbers, or long tokens that mix letters and digits.
    A file ending stays, so that ``12.html`` and ``12`` differ. What is deeper than the tree is one wildcard.
    """
    whole = F.filter(F.split(path, "/", -1), lambda x: x != "")
    rest = F.when(F.size(whole) > LEVELS, F.array(F.lit(REST))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.slice(whole, 1, LEVELS), rest)
    number = r"^[0-9]+(\.[A-Za-z]+)?$"
    token = r"^(?=[^.]*[0-9])[0-9A-Za-z_-]{12,}(\.[A-Za-z]+)?$"
    return F.transform(
        parts,
        lambda x: F.when(x.rlike(number), F.concat(F.lit("<n>"), F.regexp_extract(x, number, 1)))
        .when(x.rlike(token), F.concat(F.lit("<t>"), F.regexp_extract(x, token, 1)))
        .otherwise(x),
    )


def shape_of(path: Column) -> Column:
    """The segments of a path as one string; segments hold no slash, so none are confused."""
    return F.array_join(segments_of(path), "/")


def templates(shapes: DataFrame) -> DataFrame:
    """``(host, shape, template)`` for ``shapes(host, shape, n)``, one row each.

    Level by level, a node is (host, its template so far); where it has more than ``MAX_CHILDREN`` different
    children and none of them holds a ``RARE``-th of its pages, they become one child ``*`` before the next level
    is counted. Levels are as many as the deepest path has. ``template`` is an array of segments.
    """
    segs = F.split("shape", "/", -1)
    tree = cut(shapes.select("host", "shape", "n", F.lit("").alias("node")))
    deepest = tree.agg(F.max(F.size(segs))).first()[0] or 0
    for depth in range(deepest):
        steps = tree.withColumn("seg", F.get(segs, F.lit(depth)))
        children = steps.filter("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.sum("n").alias("n"))
        wide = (
            children.groupBy("host", "node")
            .agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("top"))
            .filter((F.col("kinds") > MAX_CHILDREN) & (F.col("top") * RARE <= F.col("n")))
            .select("host", "node", F.lit(True).alias("wild"))
        )
        piece = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg"))
        grown = piece if depth == 0 else F.concat("node", F.lit("/"), piece)
        node = F.when(F.col("seg").isNull(), F.col("node")).otherwise(grown).alias("node")
        below = cut(skew_join(steps, wide, ["host", "node"], "left").select("host", "shape", "n", node))
        discard(tree)
        tree = below
    return tree.select("host", "shape", F.split("node", "/", -1).alias("template"))


def branches(labelled: DataFrame) -> DataFrame:
    """``(host, template, branch)`` with similar branches merged, from ``labelled(host, template, n, good)``.

    ``n`` and ``good`` count labels. A node stands alone where its share of good labels differs from its
    parent's by more than chance; a template belongs to its deepest node that stands alone, or to the whole
    host.
    """
    node = F.array_join(F.slice("template", F.lit(1), F.col("depth")), "/")
    steps = labelled.select(
        "host", "template", "n", "good", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth")
    ).withColumn("node", node)
    stats = steps.groupBy("host", "depth", "node").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    above = stats.select(
        "host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), F.col("n").alias("un"), F.col("good").alias("ug")
    )
    up = F.when(F.col("depth") == 1, F.lit("")).otherwise(F.regexp_replace("node", "/[^/]*$", ""))
    pairs = skew_join(stats.filter("depth > 0").withColumn("up", up), above, ["host", "depth", "up"])
    share = (F.col("ug") + 1) / (F.col("un") + 2)
    gap = F.abs(F.col("good") / F.col("n") - share)
    alone = pairs.filter(
        (F.col("n") > 0) & (gap > DIFFERS * F.sqrt(share * (1 - share) / F.col("n")))
    ).select("host", "depth", "node", F.lit(True).alias("alone"))
    marked = skew_join(steps, alone, ["host", "depth", "node"], "left")
    own = F.when((F.col("depth") == 0) | F.col("alone"), F.struct("depth", "node"))
    return marked.groupBy("host", "template").agg(F.max(own)["node"].alias("branch"))


def held_back(page_id: Column) -> Column:
    """Whether the label of a page is kept for choosing the limit: one in four, by a hash of the id."""
    return F.substring(F.md5(page_id.cast("string")), 1, 1) < "4"


def limit_of(pooled: DataFrame, rate: float) -> float:
    """The limit that best tells bad from good in ``pooled(purity, held_n, held_good)``, 0 if none does.

    Best is the largest difference between the share of bad labels and the share of good ones below it.
    """
    total = "sum(held_n - held_good) AS bad, sum(held_good) AS good"
    tried = pooled.filter("held_n > 0").select("*", F.explode(F.sequence(F.lit(1), F.lit(TRIED))).alias("k"))
    hit = F.when(F.col("purity") < F.lit(rate) * F.col("k") / STEPS, 1).otherwise(0)
    counts = tried.groupBy("k").agg(
        F.sum(hit * (F.col("held_n") - F.col("held_good"))).alias("hit_bad"),
        F.sum(hit * F.col("held_good")).alias("hit_good"),
        *(F.expr(x) for x in total.split(", ")),
    )
    gain = F.col("hit_bad") * F.col("good") - F.col("hit_good") * F.col("bad")
    best = counts.select(F.max(F.struct(gain.alias("gain"), (-F.col("k")).alias("k"))).alias("b")).first()["b"]
    return rate * -best["k"] / STEPS if best and best["gain"] > 0 else 0.0


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for ``pages(page_id, url)``.

    ``labels(page_id, good)`` may cover some pages, on at most one row each.
    """
    url = F.col("url")
    parsed = (
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("shape", shape_of(F.col("path")))
        .withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    )
    marks = labels.filter("page_id IS NOT NULL AND good IS NOT NULL").select("page_id", "good")
    free = parsed.select("page_id", "host", "shape", F.col("hit").isNull().alias("free"))
    known = skew_join(free, marks, ["page_id"], "left").withColumn("held", held_back(F.col("page_id")))
    total = lambda hit: F.sum(F.when(hit, 1).otherwise(0))
    seen, own = F.col("good").isNotNull(), ~F.col("held")
    asked = F.col("held") & F.col("free")
    shapes = cut(
        known.groupBy("host", "shape").agg(
            F.count("*").alias("pages"),
            total(seen & own).alias("n"),
            total(F.col("good") & own).alias("good"),
            total(seen & asked).alias("held_n"),
            total(F.col("good") & asked).alias("held_good"),
        )
    )
    counts = ["n", "good", "held_n", "held_good"]
    tree = templates(shapes.select("host", "shape", F.col("pages").alias("n")))
    named = cut(skew_join(shapes, tree, ["host", "shape"]).drop("pages"))
    discard(shapes)
    discard(tree)
    labelled = named.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in counts))
    placed = skew_join(labelled, branches(labelled.select("host", "template", "n", "good")), ["host", "template"])
    placed = cut(placed)
    n, good = placed.agg(F.sum("n"), F.sum("good")).first()
    rate = good / n if n else 0.0
    purity = (F.col("good") + F.lit(PRIOR_WEIGHT * rate)) / (F.col("n") + PRIOR_WEIGHT)
    pooled = placed.groupBy("host", "branch").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("purity", purity)
    limit = limit_of(pooled, rate)
    rejected = pooled.filter(F.col("purity") < limit).select("host", "branch", F.lit("block").alias("method"))
    bad_templates = skew_join(placed.select("host", "template", "branch"), rejected, ["host", "branch"])
    bad_shapes = skew_join(
        named.select("host", "shape", "template"),
        bad_templates.select("host", "template", "method"),
        ["host", "template"],
    ).select("host", "shape", "method")
    return skew_join(parsed, bad_shapes, ["host", "shape"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "method", F.lit("allow")).alias("verdict"),
    )
