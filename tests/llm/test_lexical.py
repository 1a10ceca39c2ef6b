"""Ranked search against scoring every document, whatever the sketches and blocks are."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tripleweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for i, text in items:
        if i is not None:
            queries.setdefault(i, Counter()).update(plain_terms(text))
    out = []
    for item, query in queries.items():
        scored = []
        for doc, count in counts:
            if doc is None or not count:
                continue
            m = 25 + 75 * count.total() * n_docs // n_terms
            score = 0
            for term, times in query.items():
                if count[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * weight * (10**9 * count[term] // (1000 * count[term] + 8 * m))
            if score:
                scored.append((-score, doc))
        out += [(item, r, doc, -score) for r, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "naïve", "x1", "ABC"]
    docs = [(i, " -".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1].swapcase()) for i in range(25)]  # a group of copies, with ties
    docs += [(7, docs[7][1]), (900, None), (901, ""), (902, "--- !"), (None, docs[1][1]), (903, "w1 " * 3000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(20)]
    items += [(30, docs[3][1]), (31, None), (32, "nowhere"), (33, "w1 w1 w1"), (33, "w2"), (None, "w1"), (34, "ÜNDER")]
    return docs, items


def searched(spark, docs, items, k=lexical.K):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, sketch string").repartition(3)
    wanted = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, score int")
    return sorted(tuple(r) for r in lexical.search(lexical.index(frame), wanted, k).collect())


@pytest.mark.parametrize("cells", [4, 512])
def test_same_as_scoring_all(spark, monkeypatch, cells):
    docs, items = corpus(random.Random(cells), 120)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "ENTRIES", 2000)
    assert searched(spark, docs, items) == plain_search(docs, items, 10)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(random.Random(9), 60)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 9)
    assert searched(spark, docs, items, 3) == plain_search(docs, items, 3)


def test_empty_tables(spark):
    docs, items = [(1, "a b"), (2, None)], [(1, "a")]
    assert searched(spark, docs, items[:0]) == []
    assert searched(spark, docs[1:], items) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lexical.search(lexical.index(empty), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_bounds_are_upper_bounds_and_save_work():
    rng = random.Random(2)
    texts = [" ".join(f"t{min(int(rng.expovariate(0.01)), 4000)}" for _ in range(200)).encode() for _ in range(300)]
    counts = [Counter(lexical.terms_of(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    rows = [(q, t, 1, df[t]) for q in range(10) for t in set(lexical.terms_of(texts[q])[:30])]
    block = lexical.Block(rows, len(texts), 200 * len(texts))
    n = np.full(len(texts), 200)
    bounds, scores = block.bounds(lexical.sketches(counts, lexical._Cells()), n), block.scores(texts, n)
    assert (bounds >= scores).all()
    tenth = np.sort(scores, axis=0)[-10]
    assert (bounds >= tenth).mean() < 0.1


def test_many_occurrences_and_heavy_queries_stay_exact():
    text = b"a " * 100_000 + b"b"
    rows = [(1, b"a", 10**9, 1), (1, b"b", 1, 2)]
    block = lexical.Block(rows, 50, 10**6)
    assert not block.exact
    n = np.array([100_001])
    m = 25 + 75 * 100_001 * 50 // 10**6
    a, b = (math.floor(1000 * math.log(102 / (2 * df + 1))) for df in (1, 2))
    score = 10**9 * a * (10**9 * 100_000 // (10**8 + 8 * m)) + b * (10**9 // (1000 + 8 * m))
    assert block.scores([text], n).tolist() == [[score]]
    assert block.bounds(lexical.sketches([Counter(lexical.terms_of(text))], lexical._Cells()), n)[0, 0] >= score
