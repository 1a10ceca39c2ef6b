"""Ranked lexical search with hashed max-sketches.

The index has a row per document with its text, its number of terms and a sketch: every term is hashed to a cell in
each of ``HASHES`` tables of ``CELLS`` cells, and a cell keeps the largest number of occurrences among its
terms. The least of a term's cells is no less than its true number of occurrences, and a term's impact
grows with it, so the sketch gives an upper bound of every score. Beside the documents the index
has the number of documents per term.

Queries are looked up in batches: for a batch of documents one lookup and one matrix product give the
bounds of all documents for all queries. Documents are then scored exactly in descending order of their bounds, until no
bound reaches the k-th best score found by the task so far. Sketches decide only which documents are scored, so
the result is exact. A task passes on at most k documents per query.

Scores: N documents have at least one term, L counts all their terms, n those of one document, df the documents
with a term and tf its occurrences in one. A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``, and adds that
times ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + (75 n N) div L``. All but the logarithm is done in integers.

Broadcast are the terms of one block of queries: at most about ``BLOCK_ITEMS`` queries with ``BLOCK_TERMS``
different terms in all; each block goes over the index once. A longer query is a block of its own.

Defined cases: a null, empty or blank text has no terms and is never found; a query without terms finds
nothing. A document without id counts in N, L and df but cannot be named, so it is not ranked. Repeated rows of a document are ranked each, next to each other.
Rows of one query id are one query with all their terms; a query without id is left out. Equal scores are ranked by
document id. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, raw_texts, share, slices
from tripleweave.operators.joins import skew_join
from tripleweave.session import cut, scratch_path

CELLS, HASHES = 512, 2
K = 10
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 14
#: Counts a cell can hold; a full one stands for any number, whose impact is below MOST.
FULL, MOST = 255, 1_000_000
#: Different terms a task counts before it passes their counts on, and entries of a batch's matrices.
HELD_TERMS, ENTRIES = 1 << 18, 1 << 22
BATCH_BYTES = 1 << 22
SALTS = 64
# Letters and digits, lower-cased A to Z, everything beyond ASCII; all other bytes separate terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class Index(NamedTuple):
    """``documents(doc_id, n, sketch, text)``, ``vocabulary(term, df)``, and the totals N and L."""

    documents: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


def cells_of(term: bytes) -> list[int]:
    """The term's cell in each table, numbered through."""
    h = xxhash.xxh64_intdigest(term)
    return [k * CELLS + (h >> 24 * k) % CELLS for k in range(HASHES)]


class _Cells(dict):
    """Cells of the terms a task has met."""

    def __missing__(self, term: bytes) -> list[int]:
        if len(self) >= HELD_TERMS:
            self.clear()
        cells = self[term] = cells_of(term)
        return cells


def sketches(counts: list[Counter], known: dict[bytes, list[int]]) -> np.ndarray:
    """One row of cells per document."""
    out = np.zeros((len(counts), HASHES * CELLS), np.uint8)
    row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    if len(row):
        n = np.fromiter((min(x, FULL) for c in counts for x in c.values()), np.uint8, len(row))
        cells = np.array([known[t] for c in counts for t in c], np.int64)
        order = np.argsort(n, kind="stable")  # of several values for one cell the last, largest stays
        for k in range(HASHES):
            out[row[order], cells[order, k]] = n[order]
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("text", pa.string()), ("term", pa.binary())]
    )
    df: Counter = Counter()
    known = _Cells()

    def counted() -> pa.RecordBatch:
        of = {
            "kind": pa.array(["term"] * len(df), pa.string()),
            "n": pa.array(df.values(), pa.int64()),
            "term": pa.array(df.keys(), pa.binary()),
        }
        arrays = [of.get(f.name, pa.nulls(len(df), f.type)) for f in schema]
        df.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in (part for whole in batches for part in slices(iter([whole]), "text", BATCH_BYTES)):
        counts = [Counter(terms_of(raw)) for raw in raw_texts(batch, "text")]
        for count in counts:
            df.update(count.keys())
        of = {
            "kind": pa.array(["document"] * len(counts), pa.string()),
            "doc_id": batch.column("doc_id"),
            "n": pa.array([c.total() for c in counts], pa.int64()),
            "sketch": pa.array([s.tobytes() for s in sketches(counts, known)], pa.binary()),
            "text": batch.column("text"),
        }
        arrays = [of.get(f.name, pa.nulls(len(counts), f.type)) for f in schema]
        found = pa.RecordBatch.from_arrays(arrays, schema=schema)
        yield found.filter(pa.array([bool(c) for c in counts], pa.bool_()))
        if len(df) > HELD_TERMS:
            yield counted()
    if df:
        yield counted()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """Index documents in one pass, as a table at ``path`` or in the checkpoint folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "kind string, doc_id bigint, n bigint, sketch binary, text string, term binary"
    map_batches(own, _indexed, schema).write.partitionBy("kind").parquet(path)
    return load(spark, path)


def load(spark, path: str) -> Index:
    """An index that has been written before."""
    schema = "doc_id bigint, n bigint, sketch binary, text string, term binary, kind string"
    rows = spark.read.schema(schema).parquet(path)
    documents = rows.filter("kind = 'document'").select("doc_id", "n", "sketch", "text")
    vocabulary = rows.filter("kind = 'term'").groupBy("term").agg(F.sum("n").alias("df"))
    totals = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(documents, vocabulary, totals[0], totals[1])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms_of(raw)) for raw in raw_texts(batch, "text")]
        ids = [i for i, c in zip(batch.column("item_id").to_pylist(), counts) for _ in c]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([t for c in counts for t in c], pa.binary()),
                pa.array([x for c in counts for x in c.values()], pa.int64()),
            ],
            names=["item_id", "term", "times"],
        )


class Block:
    """Queries by terms, ready to be scored against many documents.

    ``rows`` are ``(item_id, term, times, df)`` of terms that some document has.
    """

    def __init__(self, rows: list[tuple[int, bytes, int, int]], n_docs: int, n_terms: int):
        self.items = sorted({r[0] for r in rows})
        self.place = {t: j for j, t in enumerate(sorted({r[1] for r in rows}))}
        self.n_docs, self.n_terms = n_docs, n_terms
        item = {i: q for q, i in enumerate(self.items)}
        weights = np.zeros((len(self.place), len(self.items)), np.int64)
        for i, term, times, df in rows:
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            weights[self.place[term], item[i]] += times * weight
        self.cells = np.array([cells_of(t) for t in self.place], np.int64).reshape(-1, HASHES)
        # Products of whole numbers are exact in doubles up to 2^53; beyond that bounds get some air.
        self.exact = bool(weights.sum(axis=0).max(initial=0) * MOST < 2**53)
        self.air = 1.0 if self.exact else 1 + 1e-9
        self.weights = weights.astype(np.float64) if self.exact else weights
        self.doubles = weights.astype(np.float64)

    def _impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + 75 * n * self.n_docs // self.n_terms
        return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m[:, None], 1)

    def bounds(self, sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, documents by queries."""
        seen = sketch[:, self.cells[:, 0]]
        for k in range(1, HASHES):
            np.minimum(seen, sketch[:, self.cells[:, k]], out=seen)
        of_count = self._impact(np.arange(FULL + 1)[None, :], n).astype(np.float64)
        of_count[:, FULL] = MOST
        return np.take_along_axis(of_count, seen.astype(np.int64), axis=1) @ self.doubles * self.air

    def scores(self, texts: list[bytes], n: np.ndarray) -> np.ndarray:
        tf = np.zeros((len(texts), len(self.place)), np.int64)
        for row, raw in zip(tf, texts):
            at = [j for t in terms_of(raw) if (j := self.place.get(t)) is not None]
            row += np.bincount(np.array(at, np.int64), minlength=len(row))
        return (self._impact(tf, n).astype(self.weights.dtype) @ self.weights).astype(np.int64)


class _Best:
    """The k best documents per query so far: by score, then by smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.scores = np.zeros((n_queries, k), np.int64)
        self.ids = np.full((n_queries, k), np.iinfo(np.int64).max)

    def reached_by(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        worst, last = self.scores[:, -1], self.ids[:, -1]
        return (bounds > worst) | ((bounds == worst) & (ids < last) & (bounds > 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is documents by queries."""
        k = self.ids.shape[1]
        ids = np.concatenate([self.ids, np.broadcast_to(ids, scores.T.shape)], axis=1)
        scores = np.concatenate([self.scores, scores.T], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _rescored(block: Block, best: _Best, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, texts: list[bytes]) -> None:
    """Score documents, given by ascending id, until no bound reaches the best ones."""
    bounds = block.bounds(sketch, n)
    queries = np.arange(bounds.shape[1])
    while True:
        top = bounds.argmax(axis=0)
        chosen = np.unique(top[best.reached_by(bounds[top, queries], ids[top])])
        if not len(chosen):
            return
        best.add(ids[chosen], block.scores([texts[i] for i in chosen], n[chosen]))
        bounds[chosen] = -1


def _searched(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(len(block.items), k)
    for batch in (part for whole in batches for part in slices(iter([whole]), "text", BATCH_BYTES)):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        texts, n = raw_texts(batch, "text"), batch.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        step = max(1, ENTRIES // max(len(block.place), len(block.items), 1))
        for start in range(0, len(order), step):
            part = order[start : start + step]
            _rescored(block, best, ids[part], n[part], sketch[part], [texts[i] for i in part])
    found = best.scores > 0
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(block.items, np.int64), found.sum(axis=1))),
            pa.array(best.ids[found]),
            pa.array(best.scores[found]),
        ],
        names=["item_id", "doc_id", "score"],
    )


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Rows ``(item_id, term, times, df)`` block by block; one block is on the driver at a time."""
    sizes = queries.groupBy("item_id").agg(F.count("*").alias("n"))
    short = F.col("n") <= BLOCK_TERMS
    items, terms = sizes.filter(short).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_blocks = max(-(-items // BLOCK_ITEMS), -(-terms // BLOCK_TERMS))
    sized = cut(skew_join(queries, sizes, ["item_id"]))
    for b in range(n_blocks):
        mine = sized.filter(short & (F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b))
        yield [tuple(r) for r in mine.select("item_id", "term", "times", "df").collect()]
    for row in sizes.filter(~short).select("item_id").toLocalIterator():
        mine = sized.filter(F.col("item_id") == row.item_id)
        yield [tuple(r) for r in mine.select("item_id", "term", "times", "df").toLocalIterator()]


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def search(
    found: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k highest-scoring documents of each query."""
    spark = items.sparkSession
    own = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    terms = map_batches(own.filter("item_id IS NOT NULL"), _query_terms, "item_id bigint, term binary, times bigint")
    terms = cut(terms.groupBy("item_id", "term").agg(F.sum("times").alias("times")))
    wanted = cut(terms.select("term").distinct())
    df = cut(skew_join(found.vocabulary, wanted, ["term"], "left_semi"))
    named = found.documents.filter("doc_id IS NOT NULL")
    parts = []
    for rows in _blocks(skew_join(terms, df, ["term"]).select("item_id", "term", "times", "df")):
        shared = share(spark, Block([(i, bytes(t), x, d) for i, t, x, d in rows], found.n_docs, found.n_terms))
        run = lambda batches, shared=shared: _searched(batches, shared(), k)
        part = map_batches(named, run, "item_id bigint, doc_id bigint, score bigint")
        # Every task has sent up to k rows per query: first among a share of the ids, then among the rest.
        salted = part.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        parts.append(cut(_first(salted, ["item_id", "salt"], k).select("item_id", "doc_id", "score")))
    if not parts:
        empty = "item_id bigint, rank int, doc_id bigint, score bigint"
        return spark.createDataFrame([], empty)
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return _first(all_parts, ["item_id"], k).select("item_id", "rank", "doc_id", "score")
