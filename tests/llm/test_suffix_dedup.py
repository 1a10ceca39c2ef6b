"""Suffix order, anchors and removals against plain searches."""

import hashlib
import random

import numpy as np
import pytest

from tripleweave.llm import suffix_dedup, suffixes


def plain(docs, length):
    first = {}
    for doc, text in docs:
        raw, key = (text or "").encode(), float("inf") if doc is None else doc
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for doc, text in docs:
        raw, key, gone = (text or "").encode(), float("inf") if doc is None else doc, set()
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key:
                gone.update(range(i, i + length))
        spans = sum(i - 1 not in gone for i in gone)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        out.append((doc, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n):
    say = lambda k: "".join(rng.choice(["the ", "é", "ab", "x", "\n"]) for _ in range(k))
    shared = [say(rng.randint(20, 60)) for _ in range(6)]
    docs = [(i, "".join(rng.choice([say(15), rng.choice(shared)]) for _ in range(rng.randint(0, 9)))) for i in range(n)]
    docs += [(None, shared[0] * 2), (None, shared[0] * 2), (n + 1, None), (n + 2, ""), docs[3], (-5, docs[4][1])]
    docs += [(n + 3, "a" * 400), (n + 4, "b" + "a" * 300), (n + 5, say(9000)), (n + 6, docs[2][1] * 3)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(40))
def test_minima_of_windows(seed):
    rng = np.random.default_rng(seed)
    length, letters = int(rng.integers(9, 20)), rng.integers(1, 4)
    counts = rng.integers(1, 12, rng.integers(1, 12))
    strings = [rng.integers(97, 97 + letters, w + length - 1).astype(np.uint8) for w in counts]
    size = np.array([len(s) for s in strings])
    owner = rng.integers(0, 100, len(strings))
    got = suffixes.window_minima(np.concatenate(strings), np.cumsum(size) - size, counts, owner, length)
    best = {}
    for s, w, o in zip(strings, counts, owner):
        for j in range(w):
            best[s[j : j + length].tobytes()] = min(best.get(s[j : j + length].tobytes(), 999), o)
    assert got.tolist() == [best[s[j : j + length].tobytes()] for s, w in zip(strings, counts) for j in range(w)]


def test_suffixes_come_out_in_order():
    rng = np.random.default_rng(9)
    counts = rng.integers(1, 40, 200)
    text = rng.integers(97, 99, int((counts + 49).sum())).astype(np.uint8)
    start = np.cumsum(counts + 49) - counts - 49
    placed, _ = suffixes.sort_windows(text, start, counts, 50)
    found = [text[p : p + 50].tobytes() for p in placed]
    assert len(found) == counts.sum() and found == sorted(found)


@pytest.mark.parametrize("block, bucket", [(1 << 21, 6 << 20), (300, 2000), (1, 500)])
def test_removals(spark, block, bucket):
    docs = corpus(random.Random(block), 60)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, block string").repartition(4)
    found = suffix_dedup.scan(frame, length=50, block=block, bucket=bucket).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(docs, 50)


def test_clean_keeps_rows_and_columns(spark):
    passage = "this is a passage of more than fifty bytes, é, that repeats in texts. "
    docs = [
        (1, "one " + passage, 9, "a"),
        (2, "two " + passage + "end", 9, "b"),
        (3, passage, 9, None),
        (4, None, None, None),
        (5, "  ", 2, "c"),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint, __size string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.clean(frame.withColumnRenamed("__size", "block")).collect()}
    assert got == {1: ("one " + passage, 4 + len(passage), "a"), 2: ("twoend", 6, "b"), 4: (None, None, None), 5: ("  ", 2, "c")}
    assert suffix_dedup.clean(frame.drop("__size").limit(0)).count() == 0


def test_a_passage_in_every_document_has_no_large_group(spark):
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = say(200)
    docs = [(i, say(60) + passage + say(60)) for i in range(1500)] + [(1500, None), (3, docs_text := say(60) + passage * 2)]
    docs += [(3, docs_text)] * 2
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    bucket, length = 2000, 50
    known, buckets = suffix_dedup._known(frame, "doc_id", "text", length, 4000, bucket)
    plainly = lambda blob: len(suffix_dedup._unpack(blob))
    sizes = {}
    for r in suffix_dedup._strings(known, buckets, length).collect():
        sizes[r.bucket] = sizes.get(r.bucket, 0) + plainly(r.blob)
    assert max(sizes) >= buckets, "some bucket should be split"
    assert max(sizes.values()) < 2 * suffix_dedup.HOT * bucket
    found = suffix_dedup.scan(frame, length=length, block=4000, bucket=bucket).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(docs, length)
