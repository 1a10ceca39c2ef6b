"""The chosen-path join against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from tripleweave.llm import chosen_path


def plain_set(text, width):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(docs, width=4):
    sets = {d: plain_set(t, width) for d, t in docs}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if b < a and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def corpus(rng):
    docs = []
    for n in (60, 100, 150, 200):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(8):
            near = list(base)
            for _ in range(k * n // 100):
                near[rng.randrange(n)] = f"n{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(near)))
    # One passage in many documents, of which few are near copies.
    passage = [f"p{i}" for i in range(100)]
    docs += [(100 + i, " ".join(passage + [f"o{i // 2}x{k}" for k in range(40)] + ["end"] * (i % 2))) for i in range(60)]
    # Many near copies of one text, and a chain whose ends are far apart.
    base = [f"b{i}" for i in range(120)]
    docs += [(300 + i, " ".join(base[:7 * (i % 17)] + [f"i{i}"] + base[7 * (i % 17) :])) for i in range(60)]
    docs += [(400 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 100))) for i in range(12)]
    return docs


def components(spark, docs, **options):
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, class string, root int")
    return {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame.repartition(4), **options).collect()}


@pytest.mark.parametrize("leaf,depth", [(512, 20), (10, 20), (10, 1)])
def test_same_components_as_all_pairs(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    docs = corpus(random.Random(leaf))
    assert components(spark, docs) == plain_components(docs)


def test_five_words_and_fingerprints_first(spark):
    docs = corpus(random.Random(1))
    assert components(spark, docs, width=5, fingerprints=True) == plain_components(docs, 5)


def test_defined_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (None, "one"), (None, "lost"),
        (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d E"), (9, "x " * 50_000), (10, "X " * 9), (7, "other words under one id"),
    ]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, n bigint")
    found = sorted(map(tuple, chosen_path.near_duplicates(docs).collect()), key=repr)
    want = [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 6), (None, 1, None),
        (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 1, 9), (10, 1, 9), (7, 2, 7),
    ]
    assert found == sorted(want, key=repr)
    kept = chosen_path.deduplicate(docs, link_empty=True)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 4, 6, 7, 7, 7, 9]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0


def test_hashes_of_words_and_shingles():
    rng = np.random.default_rng(2)
    texts = [b"", b" ", b"One", b"one  TWO three", b"x" * 200 + b" y", b"\t", "\u00e4 \u00c4 b".encode(), b"x" * 63, b"x" * 65]
    texts += [b" ".join(bytes(rng.integers(97, 100, rng.integers(1, 20)).tolist()) for _ in range(30)) for _ in range(20)]
    seen = {}
    for width in (1, 4, 5):
        for text, found in zip(texts, chosen_path.hashed(texts, width)):
            words = text.lower().split()
            want = [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
            assert len(found) == len(want)
            for w, h in zip(want, found.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_tokens_and_tree_rates():
    """Common tokens follow the similarity, and a pair at 0.8 meets in a tree about as often as stated."""
    rng = np.random.default_rng(3)
    common, met = [], []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 800, np.uint64)
        x, y = (chosen_path.tokens(np.r_[both, rng.integers(0, 1 << 63, 100, np.uint64)]) for _ in range(2))
        common.append((x == y).sum())
        for tree in chosen_path.TREE_SEEDS:
            keys = [set(chosen_path.children(np.array([tree]), t[None, :])[1].tolist()) for t in (x, y)]
            met.append(bool(keys[0] & keys[1]))
    assert abs(np.mean(common) / chosen_path.TOKENS - 0.8) < 0.01
    assert min(common) >= chosen_path.RESEMBLING
    assert abs(np.mean(met) - (1 - np.exp(-1.1))) < 0.03


def test_small_nodes_of_all_levels_are_compared_together(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 3)
    calls, levels, close, large = [], [], chosen_path._close, chosen_path._large_links
    monkeypatch.setattr(chosen_path, "_close", lambda *a: calls.append(1) or close(*a))
    monkeypatch.setattr(chosen_path, "_large_links", lambda *a: levels.append(1) or large(*a))
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(common + [f"w{rng.random()}" for _ in range(6)])) for i in range(8)] + [(9, " ".join(common))]
    assert components(spark, docs) == plain_components(docs)
    assert len(levels) > 0 and len(calls) == 2
