"""SimHash near-duplicates with covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its word shingles. Documents with equal fingerprints are one
class. Classes within ``RADIUS`` bits are found with masks that leave no pair out: every bit position has
a label, a non-zero vector of RADIUS + 1 bits, and every such vector v gives a table whose key keeps the
bits whose label has an odd product with v. Up to RADIUS differing bits span a space too small to hold
all vectors, so some v is orthogonal to all of their labels, and in its table the two keys agree.

Within a bucket, members are compared with numpy and only a forest of true links is passed on, never the
pairs. Buckets above ``BUCKET`` members are first dealt out anew by the same construction over the bits
their key leaves free, which bounds a bucket by the number of patterns of the remaining bits.

Defined cases: a null or blank text has fingerprint zero and is linked like any other. A text of fewer
words than a shingle is one shingle. Documents without id are fingerprinted and linked through their
class, which only others can name: a component of such documents alone has a null id. Repeated rows stay
rows. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, raw_texts
from tripleweave.llm.components import components
from tripleweave.operators.joins import skew_join
from tripleweave.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 2048


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = raw.lower().split()  # on bytes both know ASCII only, as wanted
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where over half of the hashes have them set.

    Counts run in byte lanes, 255 hashes at a time, so that no lane overflows.
    """
    n = len(hashes)
    if not n:
        return 0
    lanes = np.zeros((-(-n // 255) * 255,), np.uint64)
    lanes[:n] = hashes
    lanes = lanes.reshape(-1, 255)
    counts = np.empty(64, np.int64)
    for bit in range(8):
        part = ((lanes >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = part.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a bigint of the same 64 bits."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(raw)) for raw in raw_texts(batch, "text")]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(own, run, "doc_id bigint, fp bigint")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """One mask over ``bits`` per non-zero vector; two patterns within the radius agree under some mask."""
    n = 2 ** (radius + 1)
    label = {bit: k % (n - 1) + 1 for k, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (label[b] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(column: str, tables: list[int]) -> Column:
    """Exploded (table, key) of a fingerprint under every mask."""
    parts = (
        F.struct(F.lit(t).alias("table"), F.col(column).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
        for t, m in enumerate(tables)
    )
    return F.explode(F.array(*parts))


def _roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """Per member of a bucket, the position of the first member it is linked to, over any links.

    Members are visited from one to those within reach of it; a visited one is compared with those not
    yet reached only, so that a dense group costs little more than one comparison per member.
    """
    root = np.full(len(fps), -1)
    left = np.arange(len(fps))
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        root[first] = first
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= radius
            reached, left = left[near], left[~near]
            root[reached] = first
            queue.extend(reached.tolist())
    return root


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (member, first member) of the linked members of each run of equal buckets."""
    held: pa.Table | None = None

    def edges(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in ("table", "key", "sub", "subkey")]
        fps = table.column("fp").to_numpy().view(np.uint64)
        reps = table.column("rep").to_numpy()
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = np.concatenate([[0], new, [len(fps)]])
        a, b = [], []
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
        a.append(reps[pairs + 1])
        b.append(reps[pairs])
        for start, stop in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2]):
            root = _roots(fps[start:stop], radius)
            child = np.flatnonzero(root != np.arange(len(root)))
            a.append(reps[start + child])
            b.append(reps[start + root[child]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        same = np.ones(table.num_rows, bool)
        for c in ("table", "key", "sub", "subkey"):
            values = table.column(c).to_numpy()
            same &= values == values[-1] if len(values) else same
        last = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        held = table.slice(last)
        if last:
            yield edges(table.slice(0, last))
    if held is not None and held.num_rows:
        yield edges(held)


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` of a forest that connects just what links within the radius connect.

    ``classes(fp, rep)`` has each fingerprint once, with a number standing for it.
    """
    tables = masks(list(range(64)), radius)
    dealt = classes.select("fp", "rep", _keys("fp", tables).alias("k")).select("fp", "rep", "k.*")
    crowded = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = skew_join(dealt, crowded, ["table", "key"])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    anew = F.lit(None).cast("array<struct<sub:int,subkey:bigint>>")
    for t, m in enumerate(tables):
        free = [b for b in range(64) if not m >> b & 1]
        parts = F.array(
            *(
                F.struct(F.lit(s).alias("sub"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("subkey"))
                for s, x in enumerate(masks(free, radius))
            )
        )
        anew = F.when(F.col("table") == t, parts).otherwise(anew)
    spread = met.select(
        "table", "key", "fp", "rep", F.explode(F.when(F.col("n") > bucket, anew).otherwise(whole)).alias("s")
    ).select("table", "key", "s.*", "fp", "rep")
    keys = ["table", "key", "sub", "subkey"]
    grouped = spread.repartition(*keys).sortWithinPartitions(*keys, "rep")
    return map_batches(grouped, lambda it: _forest(it, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document; the id is the smallest document id reachable."""
    marked = cut(fingerprints(docs, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # A class without any document id still links others: it stands for itself by a negative number.
    rep = F.coalesce("least", -1 - F.monotonically_increasing_id())
    classes = cut(classes.select("fp", rep.alias("rep")))
    roots = components(links(classes, radius))
    # Negative stand-ins must not win over real ids, so the smallest real id is taken per component.
    member = skew_join(classes, roots.withColumnRenamed("node", "rep"), ["rep"], "left")
    member = cut(member.select("fp", "rep", F.coalesce("root", "rep").alias("root")))
    names = member.filter("rep >= 0").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = skew_join(member.select("fp", "root"), names, ["root"], "left").select("fp", "component_id")
    return skew_join(marked, named, ["fp"], "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; documents without id stay."""
    found = near_duplicates(docs, id_col, text_col, radius)
    copies = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    return docs.join(copies.distinct(), id_col, "left_anti")
