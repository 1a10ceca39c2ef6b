"""Toxicity scores of whole documents by a recurrent network over words and their characters.

A word's input is its own embedding (words seen in several training documents; all others share none) next
to the mean embedding of its character trigrams, word ends included. A bidirectional gated recurrent
network with attention pooling scores windows of words; windows overlap and cover the whole text, and a
document scores as its highest window.

Training is in numpy on the driver, on at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents, chosen by a
hash of their id: the bound of the sample. A label is known for a document, not for its windows: each epoch
trains toxic documents on the window that now scores highest, clean ones on their highest and on random
windows. A last logistic fit on held-back sample documents makes scores comparable to probabilities.
Scoring runs in tasks with the model broadcast; its size depends on the parameters only.

Defined cases: a null or wordless text is one empty window. A null id is scored and counts as not held
out. Repeated rows are scored one by one. Labels of documents that are absent, null labels and labels of
held-out ids are not used; several labels of one id count as toxic if one is; of several texts of one id the
least in order is learned from. Without a toxic and a clean
document in the sample there is nothing to learn and every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm import gru
from tripleweave.llm.arrow import map_batches, raw_texts, share, slices

WINDOW, STRIDE = 48, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 1 << 15
MIN_DOCS = 8
DROPOUT, DECAY = 0.5, 0.05
MAX_TOXIC, MAX_CLEAN = 1500, 2500
EPOCHS, BATCH, RATE = 10, 256, 0.01
MIN_STEPS, MAX_EPOCHS = 600, 30  # small samples take smaller batches and more epochs
PATIENCE = 4  # epochs without a better ranking of the held-back documents before training ends
THRESHOLD = 0.3
F32 = np.float32
#: ASCII that is no letter or digit separates words, A-Z is lower-cased, all other bytes stay.
WORDS = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of words with a space at either end, and where each word's begin."""
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    inside = line[1:-1] != 32
    codes = (line[:-2] * 0x9E37 + line[1:-1] * 0x79B9 + line[2:] * 0x3C6F1) * 0x2545F491 >> 11
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (codes[inside] % TRIGRAMS).astype(np.int32), np.cumsum(lengths) - lengths


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap and cover ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Model:
    """Embeddings, network and calibration; ``known`` maps trained words to rows of ``words`` from 1."""

    def __init__(self, known: dict[bytes, int], rng: np.random.Generator):
        self.known = known
        self.p = gru.fresh(WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION, rng)
        self.p["words"] = (rng.standard_normal((len(known) + 1, WORD_DIM)) * 0.1).astype(F32)
        self.p["words"][0] = 0
        self.p["chars"] = (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.3).astype(F32)
        self.slope, self.offset = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One vector per different word, with the rows it was made of."""
        rows = np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))
        grams, begins = trigrams(words)
        sums = np.add.reduceat(self.p["chars"][grams], begins, axis=0)
        counts = np.diff(np.append(begins, len(grams)))
        return np.concatenate([self.p["words"][rows], sums / counts[:, None].astype(F32)], axis=1), rows, grams, counts

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors times the input weights of both directions, with a zero row for padding at the end."""
        both = vectors @ self.p["input"] + self.p["bias"]
        return np.concatenate([both, np.zeros_like(both[:, :1])], axis=1)

    def logits(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all documents, and the number of windows of each."""
        index: dict[bytes, int] = {}
        ids = [np.array([index.setdefault(w, len(index)) for w in words], np.int32) for words in docs]
        rows, counts = window_rows(ids, len(index))
        if not index:
            return np.full(len(rows), self.p["out_bias"][0]), counts
        table = self.projected(self.inputs(list(index))[0])
        parts = []
        for k in range(0, len(rows), 1024):
            at = rows[k : k + 1024].T
            mask = (at < len(index)).astype(F32)
            parts.append(gru.forward(self.p, table[:, at].transpose(1, 0, 2, 3), mask))
        return np.concatenate(parts), counts

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        logits, counts = self.logits(docs)
        if not len(counts):
            return np.empty(0)
        best = np.maximum.reduceat(logits, np.cumsum(counts) - counts)
        return 1 / (1 + np.exp(-np.clip(self.slope * best.astype(float) + self.offset, -30, 30)))


def window_rows(ids: list[np.ndarray], padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all documents as rows of word numbers, and how many each document has."""
    counts, blocks = np.empty(len(ids), np.int64), []
    for k, own in enumerate(ids):
        if len(own) < WINDOW:
            own = np.concatenate([own, np.full(WINDOW - len(own), padding, np.int32)])
        starts = np.array(window_starts(len(own)))
        counts[k] = len(starts)
        blocks.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW)[starts])
    return (np.concatenate(blocks) if blocks else np.empty((0, WINDOW), np.int32)), counts


def _epoch(model: Model, optimizer: gru.Adam, words: list[bytes], rows, labels, batch: int, rng) -> None:
    """One pass of gradient steps over windows, given as rows of word numbers."""
    p, padding = model.p, len(words)
    for k in range(0, len(rows), batch):
        at, y = rows[k : k + batch].T, labels[k : k + batch]
        own, place = np.unique(at, return_inverse=True)
        place = place.reshape(at.shape)
        real = own[own < padding]
        if not len(real):
            continue
        vectors, word_rows, grams, counts = model.inputs([words[i] for i in real])
        dropped = rng.random(len(real)) < DROPOUT  # such words are as good as unknown in this step
        vectors[dropped, :WORD_DIM], word_rows[dropped] = p["words"][0], 0
        table = model.projected(vectors)
        mask = (at < padding).astype(F32)
        trace: dict = {}
        logits = gru.forward(p, table[:, place].transpose(1, 0, 2, 3), mask, trace)
        error = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(F32)
        g, d_projected = gru.backward(p, trace, mask, error)
        d_table = np.zeros_like(table)
        np.add.at(d_table, (slice(None), place.ravel()), d_projected.transpose(1, 0, 2, 3).reshape(2, -1, table.shape[2]))
        d_table = d_table[:, : len(real)]
        g["bias"] = d_table.sum(axis=1, keepdims=True)
        g["input"] = vectors.T @ d_table
        d_vectors = np.einsum("dnk,dik->ni", d_table, p["input"])
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], word_rows, d_vectors[:, :WORD_DIM])
        g["words"][0] = 0
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], grams, np.repeat(d_vectors[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        optimizer.step(p, g)
        p["words"][1:, 1:] *= F32(1 - DECAY * optimizer.rate * 10)
        p["chars"][:, 1:] *= F32(1 - DECAY * optimizer.rate * 10)


def _calibrate(model: Model, logits: np.ndarray, labels: np.ndarray) -> None:
    """Fit slope and offset of the highest logits by Newton steps with halving, pulled towards 1 and 0."""
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(float)

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.05 * ((w - [1.0, 0.0]) ** 2).sum())

    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - labels) + 0.1 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        while np.abs(step).max() > 1e-6 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    if w[0] > 0:
        model.slope, model.offset = float(w[0]), float(w[1])


def _highest(model: Model, docs: list[list[bytes]]) -> np.ndarray:
    logits, counts = model.logits(docs)
    return np.maximum.reduceat(logits, np.cumsum(counts) - counts)


def _ranking(logits: np.ndarray, labels: np.ndarray) -> float:
    """The share of pairs of a toxic and a clean document that are in the right order."""
    toxic, clean = logits[labels == 1], np.sort(logits[labels == 0])
    if not len(toxic) or not len(clean):
        return 0.0
    below = np.searchsorted(clean, toxic, "left") + np.searchsorted(clean, toxic, "right")
    return float(below.mean() / 2 / len(clean))


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Smoothed log odds of documents with a feature, between -1 and 1."""
    odds = np.log((toxic + 2) / (n_toxic + 4)) - np.log((clean + 2 * n_clean / n_toxic) / (n_clean + 4 * n_clean / n_toxic))
    return np.clip(odds / 3, -1, 1).astype(F32)


def _informed(model: Model, docs: list[list[bytes]], labels: np.ndarray) -> None:
    """Start the first number of every embedding at the log odds its documents show."""
    words = np.zeros((2, len(model.known) + 1))
    chars = np.zeros((2, TRIGRAMS))
    for own, y in zip(docs, labels):
        if own:
            different = list(set(own))
            words[int(y), [model.known.get(w, 0) for w in different]] += 1
            chars[int(y), np.unique(trigrams(different)[0])] += 1
    n = max(1.0, labels.sum()), max(1.0, len(labels) - labels.sum())
    model.p["words"][1:, 0] = _log_odds(words[1, 1:], words[0, 1:], *n)
    model.p["chars"][:, 0] = _log_odds(chars[1], chars[0], *n)


def fit(docs: list[list[bytes]], labels: np.ndarray, seed: int = 0) -> Model | None:
    """Train on word lists and their 0/1 labels; every fifth document is for the calibration only."""
    if not 0 < labels.sum() < len(labels):
        return None
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    for words in docs:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    known = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_DOCS))}
    model = Model(known, rng)
    order = rng.permutation(len(docs))
    back = order[: len(docs) // 5] if len(docs) >= 50 else order
    used = order[len(docs) // 5 :] if len(docs) >= 50 else order
    _informed(model, [docs[d] for d in used], labels[used])
    words = sorted(seen)
    index = {w: i for i, w in enumerate(words)}
    ids = [np.array([index[w] for w in docs[d]], np.int32) for d in used]
    rows, counts = window_rows(ids, len(words))
    begins, y = np.cumsum(counts) - counts, labels[used]
    optimizer = gru.Adam(model.p, RATE)
    weight = max(1, int(round((len(y) - y.sum()) / max(1, y.sum()) / 2)))
    best = begins + (rng.random(len(y)) * counts).astype(np.int64)
    size = int((y == 0).sum()) * 4
    batch = int(np.clip(size // 25, 32, BATCH))
    epochs = int(np.clip(MIN_STEPS * batch // max(1, size), EPOCHS, MAX_EPOCHS))
    kept: tuple = (-1.0, epochs, None)
    for epoch in range(epochs):
        if epoch >= 2:
            logits = np.concatenate([model.logits([docs[d] for d in used[k : k + 500]])[0] for k in range(0, len(used), 500)])
            best = np.array([b + int(np.argmax(logits[b : b + n])) for b, n in zip(begins, counts)])
        chance = [begins + (rng.random(len(y)) * counts).astype(np.int64) for _ in range(2 if epoch >= 2 else 3)]
        clean = y == 0
        if epoch < 2:
            toxic = np.concatenate([c[~clean] for c in chance])
        else:
            toxic = np.repeat(best[~clean], weight)
        at = np.concatenate([toxic, best[clean], *(c[clean] for c in chance)])
        target = np.concatenate([np.ones(len(toxic)), np.zeros(len(at) - len(toxic))])
        mixed = rng.permutation(len(at))
        _epoch(model, optimizer, words, rows[at[mixed]], target[mixed], batch, rng)
        if epoch >= 2:
            quality = _ranking(_highest(model, [docs[d] for d in back]), labels[back])
            if quality > kept[0]:
                kept = quality, epoch, {k: v.copy() for k, v in model.p.items()}
            if epoch - kept[1] >= PATIENCE or quality == 1 and epoch >= EPOCHS // 2:
                break
    model.p = kept[2] or model.p
    _calibrate(model, _highest(model, [docs[d] for d in back]), labels[back])
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labelled documents to learn from: ``(text, toxic)``, bounded by MAX_TOXIC and MAX_CLEAN."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("__id"), "toxic").filter("toxic IN (0, 1) AND __id IS NOT NULL")
    one = ids.filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    draw = lambda y, n: one.filter(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    # At most MAX_TOXIC + MAX_CLEAN ids.
    chosen = F.broadcast(draw(1, MAX_TOXIC).unionByName(draw(0, MAX_CLEAN)))
    own = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("text"))
    # One row per id: an id on very many rows must not reach the driver as often.
    return own.join(chosen, "__id").groupBy("__id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    rows = sorted(sample(docs, labels, id_col, text_col).collect(), key=lambda r: (r[0], r.text or ""))
    words = [(r.text or "").encode().translate(WORDS).split() for r in rows]
    return fit(words, np.array([r.toxic for r in rows], float))


def _scorer(model: Model | None, text_col: str) -> Callable[[pa.RecordBatch], pa.Array]:
    def score(batch: pa.RecordBatch) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(batch.num_rows))
        return pa.array(model.scores([t.translate(WORDS).split() for t in raw_texts(batch, text_col)]), pa.float64())

    return score


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score"):
    """``docs`` with a score between 0 and 1; ``labels`` is ``(doc_id, toxic)``. A column of the score's name, in
    whatever case, is replaced unless it is the text."""
    if score_col.lower() == text_col.lower():
        raise ValueError(f"the score cannot take the name of the text, {text_col}")
    shared = share(docs.sparkSession, train(docs, labels, id_col, text_col))

    kept = docs.drop(*(c for c in docs.columns if c.lower() == score_col.lower()))

    def run(batches):
        score = _scorer(shared(), text_col)
        for batch in slices(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, score(batch)], names=[*batch.schema.names, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept, run, f"{fields}, `{score_col}` double")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD):
    """``docs`` whose score is below the threshold, with all their columns."""
    name = "__score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_score(docs, labels, id_col, text_col, name).filter(F.col(name) < threshold).drop(name)
