"""Measures by plain Python, bits and ablations by counting."""

import random
import re

from tripleweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def texts():
    rng = random.Random(7)
    some = ["", None, " \n\t ", "a b c d e a b c d e", "x\n\nx\n x \nx", "\x1c a b   c", "é# $5 |<>|", "a " * 3000]
    return some + [rng.choice([" ", "\n", " \t"]).join(rng.choices("ab*\n", k=rng.randint(0, 60))) for _ in range(200)]


def test_measures(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (None, "A b", None), rows[3]], "doc_id bigint, text string, n_words string")
    book = quality.ledger(docs)
    got = [r for r in book.collect() if r.doc_id is not None]
    assert len(got) == len(rows) + 1
    for r in got:
        want = plain(rows[r.doc_id][1])
        assert {k: r[k] for k in want} == want
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    book = quality.ledger(spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")).cache()
    failed = [r.failed for r in book.collect()]
    for policy in quality.POLICIES:
        bits = quality.mask(policy)
        assert book.filter(quality.passes(policy)).count() == sum(not f & bits for f in failed)
        for r in quality.ablations(book, policy).collect():
            bit = 1 << list(quality.RULES).index(r.rule)
            assert r.n_failing == sum(bool(f & bit) for f in failed)
            assert r.n_only_this == sum(f & bits == bit for f in failed)
            assert r.n_kept_without == sum(not f & bits & ~bit for f in failed)
    assert quality.ablations(book.limit(0), quality.BASE).count() == 2
