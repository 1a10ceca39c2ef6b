"""Gradients, windows, and accuracy on held-out documents."""

import zlib

import numpy as np
import pytest

from tripleweave.llm import gru, toxicity

SF = "/root/testdata/sf0.1"


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in gru.fresh(5, 3, 4, rng).items()}
    projected, mask = rng.standard_normal((6, 2, 4, 9)), np.ones((6, 4))
    mask[4:, 1] = mask[2:, 2] = 0
    trace = {}
    g, d = gru.backward(p, trace, mask, gru.forward(p, projected, mask, trace))
    loss = lambda: (gru.forward(p, projected, mask) ** 2).sum() / 2
    for array, slope in [*((p[k], v) for k, v in g.items()), (projected, d)]:
        flat = array.ravel()
        for i in rng.integers(len(flat), size=4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - slope.ravel()[i]) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 80, 81, 1000])
def test_windows_overlap_and_cover_all(n):
    rows, counts = toxicity.window_rows([np.arange(n, dtype=np.int32)], 10**6)
    starts = toxicity.window_starts(n)
    assert counts.tolist() == [len(starts)] == [len(rows)]
    assert set(range(n)) <= set(rows.ravel().tolist())
    assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left_semi").select("doc_id", "text")
    rows = docs.join(labels, "doc_id").collect()
    frame = docs.selectExpr("*", "'x' AS score_of").unionByName(
        spark.createDataFrame([(None, None, None), (-1, "", ""), (-2, "a", ""), (5, "twice", "")], "doc_id bigint, text string, score_of string")
    )
    found = toxicity.with_score(frame, labels).collect()
    assert len(found) == docs.count() + 4 and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(scores[r.doc_id] >= toxicity.THRESHOLD) == bool(r.toxic) for r in held]
    assert sum(right) / len(right) > 0.85
    toxic = [scores[r.doc_id] >= toxicity.THRESHOLD for r in held if r.toxic]
    assert sum(toxic) / len(toxic) > 0.6
    pairs = [(scores[a.doc_id], scores[b.doc_id]) for a in held if a.toxic for b in held if not b.toxic]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.9
    kept = toxicity.reject(frame, labels)
    assert kept.columns == frame.columns


def _plain(model, words):
    """The logit of one window, word by word and number by number."""
    p, size = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN
    inputs = []
    for w in words:
        padded = b" " + w + b" "
        grams = [
            ((padded[i] * 0x9E37 + padded[i + 1] * 0x79B9 + padded[i + 2] * 0x3C6F1) * 0x2545F491 >> 11) % toxicity.TRIGRAMS
            for i in range(len(w))
        ]
        chars = [sum(p["chars"][g][k] for g in grams) / len(grams) for k in range(toxicity.CHAR_DIM)]
        inputs.append([*p["words"][model.known.get(w, 0)], *chars])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    sides = []
    for d, order in ((0, inputs), (1, inputs[::-1])):
        h, states = [0.0] * size, []
        for x in order:
            a = [sum(v * p["input"][d][i][j] for i, v in enumerate(x)) + p["bias"][d][0][j] for j in range(3 * size)]
            b = [sum(h[i] * p["state"][d][i][j] for i in range(size)) for j in range(3 * size)]
            z = [sigmoid(a[j] + b[j]) for j in range(size)]
            r = [sigmoid(a[size + j] + b[size + j]) for j in range(size)]
            c = [np.tanh(a[2 * size + j] + r[j] * b[2 * size + j]) for j in range(size)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(size)]
            states.append(h)
        sides.append(states if d == 0 else states[::-1])
    both = [f + b for f, b in zip(*sides)]
    energy = []
    for s in both:
        inner = [np.tanh(sum(v * p["attend"][i][j] for i, v in enumerate(s)) + p["attend_bias"][j]) for j in range(toxicity.ATTENTION)]
        energy.append(np.exp(sum(v * w for v, w in zip(inner, p["attend_out"]))))
    pooled = [sum(e * s[k] for e, s in zip(energy, both)) / sum(energy) for k in range(2 * size)]
    return sum(v * w for v, w in zip(pooled, p["out"])) + p["out_bias"][0]


def test_scores_against_a_plain_loop():
    rng = np.random.default_rng(4)
    vocabulary = [b"a", b"bad", b"good", "\u00e9t\u00e9".encode(), b"longer", b"w0rd"]
    model = toxicity.Model({b"bad": 1, b"good": 2}, rng)
    model.slope, model.offset = 1.5, -0.25
    docs = [[vocabulary[i] for i in rng.integers(0, 6, n)] for n in (1, 5, 48, 49, 130)]
    for words, score in zip(docs, model.scores(docs)):
        best = max(_plain(model, words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(words)))
        assert score == pytest.approx(1 / (1 + np.exp(-(1.5 * best - 0.25))), abs=1e-4)


def test_clashing_names_and_repeated_ids(spark):
    rows = [(i, f"text {i}", "old", i) for i in (1, 2, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Score string, __score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    scored = toxicity.with_score(docs, labels)
    assert scored.columns == ["doc_id", "text", "__score", "score"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.reject(docs, labels, threshold=2).columns == docs.columns
    assert toxicity.reject(docs, labels, threshold=2).count() == 4
    ids = [r[0] for r in toxicity.sample(docs.unionByName(docs), labels).collect()]
    assert len(ids) == len(set(ids))
    with pytest.raises(ValueError):
        toxicity.with_score(docs, labels, score_col="Text")


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert [r.score for r in toxicity.with_score(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.with_score(docs.limit(0), labels).count() == 0
