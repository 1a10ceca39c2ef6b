"""Runs against all lags of short sequences, and the defined cases."""

import random

import numpy as np
import pytest

from tripleweave.llm import periods, queries


def plain_runs(words, least=12):
    """Every maximal stretch of every lag, with the least lag it has."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words):
    gone = {i for s, n, p in plain_runs(words) for i in range(s + p, s + n)}
    return " ".join(str(w) for i, w in enumerate(words) if i not in gone)


def sequences(rng):
    def letters(n, k):
        return [rng.randrange(k) for _ in range(n)]

    fibonacci, other, morse = [0], [0, 1], [0]
    while len(other) < 200:
        fibonacci, other = other, other + fibonacci
    while len(morse) < 200:
        morse += [1 - x for x in morse]
    yield from (other[:200], morse[:200] * 2, [], [0], [0] * 300)
    for k in (1, 2, 3, 50):
        for _ in range(12):
            unit, inner = letters(rng.randrange(1, 90), k), letters(rng.randrange(1, 4), 2)
            yield letters(rng.randrange(200), k)
            yield letters(rng.randrange(20), k) + (unit * 12)[: rng.randrange(1, 300)] + letters(5, k)
            # Runs of one period that touch, out of step: their periods start at the seams.
            yield [x for _ in range(3) for x in (inner * 100)[rng.randrange(3) :][: rng.randrange(15, 120)]]
            half = (inner * 100)[: rng.randrange(1, 120)]
            yield half + half + half[: rng.randrange(len(half) + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_every_run_of_many_sequences(seed):
    docs = sorted(sequences(random.Random(seed)), key=lambda d: -len(d))
    codes, begins = [], []
    for k, doc in enumerate(docs):
        begins.append(len(codes))
        codes += [*doc, -1 - k]
    found = periods.runs_of(np.array(codes, np.int64), [len(d) for d in docs])
    want = [(s + b, s + b + n, p) for b, d in zip(begins, docs) for s, n, p in plain_runs(d)]
    assert sorted(map(tuple, found.tolist())) == sorted(want)


def test_a_very_long_text_with_a_long_period():
    unit = np.random.default_rng(0).integers(0, 1000, 4321)
    codes = np.r_[7, 7, np.tile(unit, 100), 5, -1]
    assert [7, 7, 5] != unit[[-1, 0, 0]].tolist()
    assert periods.runs_of(codes, [len(codes) - 1]).tolist() == [[2, 2 + 432_100, 4321]]
    assert periods.runs_of(np.r_[np.zeros(500_000, np.int64), -1], [500_000]).tolist() == [[0, 500_000, 1]]


def test_hashes_that_agree_by_accident_are_looked_into(monkeypatch):
    monkeypatch.setattr(periods, "mixed", lambda x: (x.astype(np.uint64) & np.uint64(1)))
    rng = random.Random(5)
    doc = [rng.randrange(6) for _ in range(30)] * 4
    found = periods.runs_of(np.array([*doc, -1], np.int64), [len(doc)])
    assert sorted((s, e - s, p) for s, e, p in found.tolist()) == plain_runs(doc)


def test_defined_cases(spark):
    long = " ".join(["a b c"] * 30_000)
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", "x"), (None, "u v " * 6, "x"),
        (5, "u v " * 6, "x"), (5, "u v " * 6, "x"), (6, long, "x"), (7, "ü " * 12, "x"), (8, "u v " * 5, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periods.scan(docs).collect()}
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 1, (), "one"), (None, 12, ((0, 12, 2),), "u v"),
        (5, 12, ((0, 12, 2),), "u v"), (6, 90_000, ((0, 90_000, 3),), "a b c"), (7, 12, ((0, 12, 1),), "ü"),
        (8, 10, (), "u v u v u v u v u v"),
    }
    assert periods.scan(docs).count() == len(rows)
    assert periods.scan(docs.limit(0)).count() == 0


def test_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_BYTES", 64)
    rng = random.Random(3)
    docs = [(i, " ".join(map(str, s))) for i, s in enumerate(sequences(rng)) if i < 60]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for r in periods.scan(frame).collect():
        words = docs[r.doc_id][1].split()
        assert [tuple(x) for x in r.runs] == plain_runs(words)
        assert r.collapsed == plain_collapsed(words)


def test_planted_periods_follow_the_checksum(spark):
    import zlib

    docs = spark.createDataFrame([(i, f" a{i}\tb c\nd e f g ") for i in range(60)] + [(None, "x y")], "doc_id bigint, text string")
    for r in queries.with_planted_periods(docs).collect():
        if r.doc_id is None:
            assert r.text == "x y"
            continue
        h = zlib.crc32(str(r.doc_id).encode())
        words = [f"a{r.doc_id}", *"bcdefg"]
        if h % 10 == 0:
            g, n = h // 10, 7
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        else:
            assert r.text.split() == words
