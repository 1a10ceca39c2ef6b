"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per failed
rule; a policy is a named mask over those bits, so that changing or comparing policies never touches the
texts again. Everything is DataFrame functions.

Defined cases: a null or blank text has no words and zero measures, and fails ``too_few_words``. A null
id stays null. Repeated rows are judged one by one. Other columns of the input are ignored, whatever
their names. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5

# Failure condition of each rule over the measures; the position is the bit, so new rules go to the end.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "shouting": "10 * n_capitals > 3 * word_chars",
}
BASE = "2024-base"
CURRENT = "2024-full"
POLICIES = {BASE: ["too_few_words", "repeated_windows"], CURRENT: list(RULES)}


def mask(policy: str) -> int:
    """The bits a policy looks at."""
    bits = {name: 1 << i for i, name in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def _repeated_words(words: str, hashes: str) -> tuple[Column, Column]:
    """Positions of windows found more than once, sorted by window, and the words they cover."""
    by_hash = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    at = F.col("__sorted")
    repeated = F.filter(
        at,
        lambda x, i: (x["h"] == F.get(at, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(at, i - 1)["h"])),
    )
    return by_hash, F.array_sort(F.transform(repeated, lambda x: x["i"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures per document, each taken in a single pass over its words and lines.

    Windows of five words are compared by a 64-bit hash within their document only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE, -1)).alias("__words"),
        lines.alias("__lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    words = F.col("__words")
    window = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, WINDOW))),
    )
    counted = parts.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        window.alias("__hashes"),
    )
    by_hash, positions = _repeated_words("__words", "__hashes")
    kept = [c for c in counted.columns if c != "__hashes"]
    placed = counted.select(*kept, by_hash.alias("__sorted")).select(*kept, positions.alias("__at"))
    at = F.col("__at")
    steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return placed.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with ``failed``: a bigint with the bit of every rule the document fails."""
    bits = (
        F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        for i, condition in enumerate(RULES.values())
    )
    failed = F.lit(0).cast("long")
    for bit in bits:
        failed = failed.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a document of a ledger passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept without the rule.

    The ledger is first counted by its masked bits, which leaves at most one row per combination of
    rules; all else is bitwise aggregation of those rows. Rules are listed even over an empty ledger.
    """
    used = [(name, 1 << i) for i, name in enumerate(RULES) if name in POLICIES[policy]]
    combos = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in used))
    each = combos.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    others = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    found = each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(F.col("bits") == F.col("bit")).alias("n_only_this"),
        total(others == 0).alias("n_kept_without"),
    )
    listed = book.sparkSession.createDataFrame([(n,) for n, _ in used], "rule string")
    zero = {"n_failing": 0, "n_only_this": 0, "n_kept_without": 0}
    return listed.join(found, "rule", "left").fillna(zero).withColumn("policy", F.lit(policy))
