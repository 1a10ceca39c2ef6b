"""Removal of byte strings that an earlier document has, with suffix arrays sorted in two stages.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller
id, judged on the input. Matches never cross documents; overlaps count.

A suffix array over all documents would need one place that holds them. Instead every window of LENGTH
bytes is assigned, by its content alone, to an anchor: its first 16-byte gram of least hash. Equal windows
have equal anchors, so it suffices to sort suffixes anchor by anchor, and only where an anchor occurs in
more than one document. Documents are packed into blocks of about ``BLOCK`` bytes; the passes are

1. every block sends the set of its anchors, seven bytes each, to buckets, which answer with one bit per
   anchor, whether another document has it, and into how many parts the bucket is split;
2. every block sends, for those, the strings their windows cover, equal ones once with the smallest id;
   a bucket builds the suffix array of its strings (``suffixes.sort_windows``), takes neighbours with a
   common prefix of LENGTH together, and answers with one bit per window: whether a smaller id has it;
3. every block removes what is covered.

A passage in a third of all documents thus reaches a bucket once per block, not once per document. The strings
at its edges do differ from document to document, yet have the passage's anchors. So anchors are sent with the
bytes of their strings, and a bucket that would get more than ``HOT`` times its share is split: its strings are cut
into single windows, which a hash of all their bytes deals to the parts. Equal windows meet in one part. What passes
write is deleted as soon as it is read for the last time.

Defined cases: a null text is empty and stays null. A null id counts as larger than any other; documents
with equal ids, or without, do not remove each other's bytes. Texts below LENGTH bytes are left alone.
Where a removal cuts a character, the rest of the character goes as well (``clean`` only; counts and digests
of ``scan`` are of bytes). Other columns pass through ``clean``; ``scan`` ignores them. Empty tables are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, map_groups, raw_texts
from tripleweave.llm.suffixes import anchors, gather, span_hashes, window_minima
from tripleweave.session import cut, discard

LENGTH = 50
BLOCK = 2 << 20
BUCKET = 3 << 20
HOT = 8  # a bucket with strings of more than this many times BUCKET bytes is split
GROWTH = 16  # bytes of single windows, with their ids, per byte of the strings they are cut from
LAST = np.iinfo(np.int64).max
TAG = np.uint64((1 << 47) - 1)
PACKED = "block bigint, size bigint, data binary, rest binary"


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows dealt into blocks: the texts as one run of bytes, everything else as an Arrow stream."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[list[bytes], pa.RecordBatch]] = []
    size = 0

    def packed():
        texts = [t for own, _ in held for t in own]
        rest = pa.Table.from_batches([b for _, b in held]).combine_chunks()
        lengths = pa.array([len(t) for t in texts], pa.int64())
        rest = rest.append_column("__size", lengths).to_batches()[0]
        row = [number], [size], [_pack(b"".join(texts))], [_pack(_ipc(rest))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["block", "size", "data", "rest"])

    for batch in batches:
        texts = raw_texts(batch, "__text")
        missing = batch.column("__text").is_null()
        others = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
        rest = pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in others), missing],
            names=[*(batch.schema.names[i] for i in others), "__missing"],
        )
        start = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= block:
                held.append((texts[start : i + 1], rest.slice(start, i + 1 - start)))
                yield packed()
                held, size, start, number = [], 0, i + 1, number + 1
        if start < len(texts):
            held.append((texts[start:], rest.slice(start)))
    if held:
        yield packed()


class _Block:
    """One block's bytes, documents and runs of windows, sorted by bucket and anchor."""

    def __init__(self, data: bytes, rest: bytes, buckets: int, length: int):
        with pa.ipc.open_stream(_unpack(rest)) as stream:
            self.rest = stream.read_next_batch()
        self.length, self.buckets = length, buckets
        self.bytes = _unpack(data)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum(self.rest.column("__size").to_numpy())
        ids = self.rest.column("__id").fill_null(LAST).to_numpy()
        start, stop, grams, doc = anchors(self.data, self.ends, length)
        bucket, tag = (grams % np.uint64(buckets)).astype(np.int64), (grams >> np.uint64(17)) & TAG
        order = np.lexsort((ids[doc], tag, bucket))
        self.start, self.stop, self.bucket, self.tag = start[order], stop[order], bucket[order], tag[order]
        self.id = ids[doc[order]]
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.tag[1:] != self.tag[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else order
        self.count = np.diff(np.append(self.first, len(order)))

    def tags(self) -> Iterator[tuple[int, int, bytes]]:
        """Per bucket the anchors, seven bytes each.

        Six bytes are the anchor, their top bit telling that two documents here have it; the seventh is the
        binary logarithm, rounded up, of the bytes of its strings.
        """
        last = self.first + self.count - 1
        several = (self.id[self.first] != self.id[last]).astype(np.uint64)
        packed = (self.tag[self.first] | several << np.uint64(47)).astype("<u8")
        packed = packed.view(np.uint8).reshape(-1, 8)[:, :7].copy()
        if len(packed):
            size = np.add.reduceat(self.stop - self.start + self.length - 1, self.first)
            packed[:, 6] = np.ceil(np.log2(size))
        own = self.bucket[self.first]
        for a, b in _groups(own):
            yield int(own[a]), b - a, packed[a:b].tobytes()

    def keep(self, answers: list[dict] | None) -> None:
        """Drop the runs of anchors that no other document has, split hot buckets, and find equal strings."""
        own, repeated = self.bucket[self.first], np.zeros(len(self.first), bool)
        parts = np.ones(len(self.first), np.int64)
        told = {a["bucket"]: a for a in answers or []}
        for a, b in _groups(own):
            answer = told[int(own[a])]
            repeated[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a)
            parts[a:b] = answer["parts"]
        runs, parts = np.repeat(repeated, self.count), np.repeat(parts, self.count)
        split = runs & (parts > 1)
        whole = runs & ~split
        windows = (self.stop - self.start)[split]
        place = _expand(self.start[split], windows)
        dealt = (span_hashes(self.data, place, place + self.length) >> np.uint64(33)).astype(np.int64)
        part = self.buckets * (1 + dealt % np.repeat(parts[split], windows)) + np.repeat(self.bucket[split], windows)
        self.bucket = np.concatenate([self.bucket[whole], part])
        self.id = np.concatenate([self.id[whole], np.repeat(self.id[split], windows)])
        self.stop = np.concatenate([self.stop[whole], place + 1])
        self.start = np.concatenate([self.start[whole], place])
        size = self.stop - self.start + self.length - 1
        hashes = span_hashes(self.data, self.start, self.start + size)
        order = np.lexsort((self.id, hashes, size, self.bucket))
        self.start, self.stop, self.bucket, self.id = (x[order] for x in (self.start, self.stop, self.bucket, self.id))
        size, hashes = size[order], hashes[order]
        same = (self.bucket[1:] == self.bucket[:-1]) & (size[1:] == size[:-1]) & (hashes[1:] == hashes[:-1])
        at = np.flatnonzero(same) + 1
        left, right = gather(self.data, self.start[at - 1], size[at]), gather(self.data, self.start[at], size[at])
        differ = np.add.reduceat(left != right, np.cumsum(size[at]) - size[at]) if len(at) else at
        same[at[differ > 0] - 1] = False
        self.first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
        self.count = np.diff(np.append(self.first, len(order)))

    def strings(self) -> Iterator[tuple[int, int, bytes]]:
        """Per bucket the different strings: window counts, smallest ids, bytes."""
        own = self.bucket[self.first]
        for a, b in _groups(own):
            at = self.first[a:b]
            windows = self.stop[at] - self.start[at]
            text = gather(self.data, self.start[at], windows + self.length - 1)
            parts = windows.astype("<i4").tobytes(), self.id[at].astype("<i8").tobytes(), text.tobytes()
            yield int(own[a]), b - a, _pack(b"".join(parts))

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Bytes covered by a window that a smaller document has."""
        hit = np.zeros(len(self.data), bool)
        own = self.bucket[self.first]
        for a, b in _groups(own):
            at = self.first[a:b]
            windows = self.stop[at] - self.start[at]
            bits = np.unpackbits(np.frombuffer(_unpack(answers[int(own[a])]), np.uint8), count=windows.sum())
            places = _expand(self.start[at], windows)
            hit[places[bits.astype(bool)]] = True
            # Equal strings of later documents lose all of their windows to the first one here.
            lead = np.repeat(at, self.count[a:b])
            span = np.arange(at[0], at[0] + len(lead))
            later = span[self.id[span] > self.id[lead]]
            size = self.stop[later] - self.start[later]
            hit[_expand(self.start[later], size)] = True
            # Those with the very id of the first one share its answer.
            twin = span[(self.id[span] == self.id[lead]) & (span != lead)]
            size = self.stop[twin] - self.start[twin]
            hit[_expand(self.start[twin], size)] |= hit[_expand(self.start[lead[twin - at[0]]], size)]
        sums = np.concatenate([[0], np.cumsum(hit)])
        n = np.arange(len(hit))
        return sums[n + 1] > sums[np.maximum(n - self.length + 1, 0)]


def _groups(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(sorted_values)]
    return list(zip(bounds[:-1], bounds[1:]))


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _repeated(table: pa.Table, bucket: int) -> pa.Table:
    """Which anchors of each block occur in another document, one bit each, and the parts of the bucket."""
    tags, logs = [], []
    for blob in table.column("blob").to_pylist():
        rows = np.frombuffer(blob, np.uint8).reshape(-1, 7)
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :6] = rows[:, :6]
        tags.append(wide.view("<u8").ravel())
        logs.append(rows[:, 6])
    flat = np.concatenate(tags)
    _, place, count = np.unique(flat & TAG, return_inverse=True, return_counts=True)
    several = count > 1
    several[place[flat > TAG]] = True
    size = int(np.exp2(np.concatenate(logs)[several[place]].astype(float)).sum())
    parts = 1 if size <= HOT * bucket else -(-size * GROWTH // bucket)
    bits = np.split(several[place], np.cumsum([len(t) for t in tags])[:-1])
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": [np.packbits(b).tobytes() for b in bits],
            "parts": pa.array([parts] * len(bits), pa.int64()),
        }
    )


def _minima(table: pa.Table, length: int) -> pa.Table:
    """Which windows of each block's strings a smaller document has: one bit each."""
    counts, ids, texts, sizes = [], [], [], table.column("n").to_pylist()
    for n, blob in zip(sizes, table.column("blob")):
        raw = _unpack(blob.as_py())
        counts.append(np.frombuffer(raw, "<i4", n).astype(np.int64))
        ids.append(np.frombuffer(raw, "<i8", n, 4 * n))
        texts.append(np.frombuffer(raw, np.uint8, offset=12 * n))
    windows, owner, text = np.concatenate(counts), np.concatenate(ids), np.concatenate(texts)
    size = windows + length - 1
    start = np.cumsum(size) - size
    # Equal strings of several blocks are sorted once, under the smallest id.
    order = np.lexsort((owner, span_hashes(text, start, start + size), size))
    hashes = span_hashes(text, start, start + size)[order]
    same = (size[order][1:] == size[order][:-1]) & (hashes[1:] == hashes[:-1])
    at = np.flatnonzero(same) + 1
    left, right = gather(text, start[order[at - 1]], size[order[at]]), gather(text, start[order[at]], size[order[at]])
    differ = np.add.reduceat(left != right, np.cumsum(size[order[at]]) - size[order[at]]) if len(at) else at
    same[at[differ > 0] - 1] = False
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    chosen = order[np.flatnonzero(np.concatenate([[True], ~same]))]
    own = gather(text, start[chosen], size[chosen])
    least = window_minima(own, np.cumsum(size[chosen]) - size[chosen], windows[chosen], owner[chosen], length)
    of = np.empty(len(order), np.int64)
    of[order] = group
    begin = (np.cumsum(windows[chosen]) - windows[chosen])[of]
    smaller = gather(least, begin, windows) < np.repeat(owner, windows)
    per_block = np.add.reduceat(windows, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    bits = np.split(smaller, np.cumsum(per_block)[:-1])
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": [_pack(np.packbits(b).tobytes()) for b in bits],
        }
    )


ANSWER = "block bigint, bucket bigint, bits binary"
SENT = "bucket bigint, block bigint, n bigint, blob binary"


def _send(blocks: DataFrame, use: Callable, buckets: int, length: int) -> DataFrame:
    """What ``use`` yields of every block, by bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sent = list(use(row, _Block(row["data"], row["rest"], buckets, length)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in sent], pa.int64()),
                        pa.array([row["block"]] * len(sent), pa.int64()),
                        pa.array([n for _, n, _ in sent], pa.int64()),
                        pa.array([x for _, _, x in sent], pa.binary()),
                    ],
                    names=["bucket", "block", "n", "blob"],
                )

    return map_batches(blocks, run, SENT)


def _answered(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with the answers of all buckets to them; a block without any has null."""
    parts = [c for c in answers.columns if c != "block"]
    own = answers.groupBy("block").agg(F.collect_list(F.struct(*parts)).alias(name))
    return blocks.join(own, "block", "left")


def _as_dict(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["bucket"]: a["bits"] for a in answers or []}


def _known(docs: DataFrame, id_col: str, text_col: str, length: int, block: int, bucket: int) -> tuple[DataFrame, int]:
    """Blocks with what the buckets say of their anchors, and the number of buckets."""
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(
        F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), *(F.col(f"`{c}`") for c in others)
    )
    packed = cut(map_batches(own, lambda it: _blocks(it, block), PACKED))
    buckets = max(1, -(-(packed.agg(F.sum("size")).first()[0] or 0) // bucket))
    tags = _send(packed, lambda row, b: b.tags(), buckets, length)
    told = map_groups(tags, "bucket", lambda t: _repeated(t, bucket), ANSWER + ", parts bigint")
    known = cut(_answered(packed, told, "repeated"))
    discard(packed, collect=True)
    return known, buckets


def _strings(known: DataFrame, buckets: int, length: int) -> DataFrame:
    """What the blocks send to the buckets and their parts."""

    def strings(row, b):
        b.keep(row["repeated"])
        return b.strings()

    return _send(known, strings, buckets, length)


def _mark(docs: DataFrame, id_col: str, text_col: str, length: int, block: int, bucket: int, finish: Callable, schema: str):
    known, buckets = _known(docs, id_col, text_col, length, block, bucket)
    sent = _strings(known, buckets, length)
    minima = cut(map_groups(sent, "bucket", lambda t: _minima(t, length), ANSWER))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row["data"], row["rest"], buckets, length)
                b.keep(row["repeated"])
                yield finish(b, b.covered(_as_dict(row["minima"])))

    return map_batches(_answered(known, minima, "minima"), run, schema)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(b: _Block, gone: np.ndarray) -> pa.RecordBatch:
        begins = b.ends - b.rest.column("__size").to_numpy()
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inside = begins[begins < len(gone)]
        opens[inside] = gone[inside]
        removed = [int(gone[a:z].sum()) for a, z in zip(begins, b.ends)]
        digests = [hashlib.sha256(b.data[a:z][~gone[a:z]].tobytes()).hexdigest() for a, z in zip(begins, b.ends)]
        return pa.RecordBatch.from_arrays(
            [
                b.rest.column("doc_id"),
                pa.array(b.ends - begins, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([int(opens[a:z].sum()) for a, z in zip(begins, b.ends)], pa.int64()),
                pa.array(digests),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _mark(own, "doc_id", "text", length, block, bucket, finish, schema)


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """``docs`` with repeated strings removed; a document that loses all but white space is dropped.

    A column ``n_chars`` is brought up to date.
    """
    columns = docs.columns

    def finish(b: _Block, gone: np.ndarray) -> pa.RecordBatch:
        begins = b.ends - b.rest.column("__size").to_numpy()
        missing = b.rest.column("__missing").to_pylist()
        texts, keep = [], []
        for i, (a, z) in enumerate(zip(begins, b.ends)):
            own = gone[a:z]
            text = b.data[a:z][~own].tobytes().decode("utf-8", "ignore")
            if own.any() and not text.strip():
                continue
            keep.append(i)
            texts.append(None if missing[i] else text)
        left = b.rest.take(pa.array(keep, pa.int64()))
        new = {text_col: pa.array(texts, pa.string())}
        if "n_chars" in columns:
            new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        arrays = [new[c] if c in new else left.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _mark(docs, id_col, text_col, length, block, bucket, finish, fields)
