"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items are put into one suffix automaton. Every document streams its words through it;
the automaton keeps the length of the longest suffix of the words read so far that occurs in some item.
Whenever that length reaches the window, the last words are a window of an item.

The automaton is broadcast, so its size is bounded: items are cut into overlapping pieces and dealt over
as many blocks of about ``BLOCK_WORDS`` words as they need. Each block is one pass over the documents, the
hits of earlier passes travelling along in a written table. One block suffices for usual test sets.

Words: A-Z in lower case, then runs of ASCII letters, digits and non-ASCII characters.

Defined cases: a null or wordless text has no hits; so has every text if no item has a word. An item of
fewer words than the window is one window by itself. Items that repeat an id count once; items without id
hit words but are not listed. Repeated documents are judged one by one. An empty table gives an empty
result. Columns of other names pass through ``clean`` untouched; ``scan`` ignores them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, raw_texts, replaced, share
from tripleweave.session import cut

WINDOW = 10
BLOCK_WORDS = 100_000
PIECE_WORDS = 5_000
MAX_COVERAGE = 0.5

#: Bytes of words stay, A-Z in lower case; all else is space. Bytes from 128 are parts of characters.
NORMAL = bytes(
    b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
WORD = re.compile(rb"[^\x20]+")
HIT_TYPE = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
HIT = "struct<n_words:bigint,runs:array<bigint>,items:array<bigint>>"


class Automaton:
    """A generalised suffix automaton of items; states are list positions, 0 the start."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: dict[int, set] = {}
        self.short_ends: dict[int, set] = {}

    def add(self, words: list[bytes], item: int | None, short: bool) -> None:
        """Add one item, or a piece of one. Every state that a prefix ends in notes the item."""
        last = 0
        for word in words:
            last = self._extend(last, word)
            if not short:
                self.ends.setdefault(last, set()).add(item)
        if short:
            self.short_ends.setdefault(last, set()).add((len(words), item))

    def _state(self, length: int, nexts: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nexts)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The part of state ``q`` that is one word longer than ``p``, as a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def finish(self) -> None:
        """Work out, per state, the items of its last window and the short items that end in it."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        items: dict[int, set] = {}
        for s in reversed(order):
            own = items.setdefault(s, set())
            own |= self.ends.get(s, set())
            up = self.link[s]
            if self.length[up] >= self.window:
                items.setdefault(up, set()).update(own)
        self.windows: dict[int, tuple] = {}
        self.shorts: dict[int, tuple] = {}
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.window:
                deeper = self.length[up] >= self.window
                self.windows[s] = self.windows[up] if deeper else tuple(items[s])
            if found := (*self.short_ends.get(s, ()), *self.shorts.get(up, ())):
                self.shorts[s] = found
        self.ends, self.short_ends = {}, {}

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit words as ascending half-open runs, and the items whose windows occur."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        shorts, windows, start = self.shorts, self.windows, self.next[0]
        runs: list[tuple[int, int]] = []
        found: set = set()
        state = matched = 0
        for t, word in enumerate(words):
            to = nexts[state].get(word)
            if to is None:
                if word not in start:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = nexts[state].get(word)
                matched = length[state]
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                found.update(windows[state])
            if state in shorts:
                for n, item in shorts[state]:
                    if n <= matched:
                        reach = max(reach, n)
                        found.add(item)
            if reach:
                begin = t + 1 - reach
                while runs and runs[-1][1] >= begin:
                    begin = min(begin, runs.pop()[0])
                runs.append((begin, t + 1))
        return runs, found


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """Automata over all items, each of about ``BLOCK_WORDS`` words; one is on the driver at a time."""

    def pieces(batches):
        step = PIECE_WORDS - window + 1
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), raw_texts(batch, "text")
            rows = [
                (i, w[k : k + PIECE_WORDS], len(w) < window)
                for i, x in zip(ids, texts)
                if (w := x.translate(NORMAL).split())
                for k in range(0, max(1, len(w) - window + 1), step)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                    pa.array([r[2] for r in rows], pa.bool_()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                ],
                names=["id", "words", "short", "n"],
            )

    items = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    cut_up = cut(map_batches(items, pieces, "id bigint, words array<binary>, short boolean, n bigint"))
    n_blocks = max(1, -(-(cut_up.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks))
    for b in range(n_blocks):
        automaton = Automaton(window)
        for row in cut_up.filter(block == b).toLocalIterator():
            automaton.add([bytes(w) for w in row.words], row.id, row.short)
        automaton.finish()
        yield automaton


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(a + b):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    hit_col: str = "__hit",
) -> DataFrame:
    """``docs`` with a struct of the word count, the runs of hit words (from, to, from, ...) and the items."""
    out, spark = docs, docs.sparkSession
    for k, automaton in enumerate(_blocks(benchmark, item_col, item_text_col, window)):
        shared = share(spark, automaton)
        first = k == 0

        def run(batches, shared=shared, first=first):
            automaton = shared()
            for batch in batches:
                before = [None] * batch.num_rows if first else batch.column(hit_col).to_pylist()
                hits = []
                for raw, old in zip(raw_texts(batch, text_col), before):
                    words = raw.translate(NORMAL).split()
                    runs, found = automaton.stream(words)
                    if old:
                        flat = old["runs"]
                        runs = _merge(runs, list(zip(flat[::2], flat[1::2])))
                        found.update(old["items"])
                    found.discard(None)
                    hits.append({"n_words": len(words), "runs": [x for r in runs for x in r], "items": sorted(found)})
                kept = [i for i, n in enumerate(batch.schema.names) if n != hit_col]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), pa.array(hits, HIT_TYPE)],
                    names=[*(batch.schema.names[i] for i in kept), hit_col],
                )

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        out = map_batches(out if first else cut(out), run, f"{fields}, `{hit_col}` {HIT}")
    return out


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW):
    """``(doc_id, n_words, n_hit, items, runs)`` per document; ``runs`` as word positions, half open."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hit, runs = F.col("__hit"), F.col("__hit.runs")
    lengths = F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return mark(own, benchmark, window=window).select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        hit["items"].alias("items"),
        runs.alias("runs"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage=MAX_COVERAGE):
    """``docs`` without hit spans; a document is dropped if more than ``max_coverage`` of its words are hit.

    A span reaches from the first byte of its first word to the last byte of its last. A column ``n_chars``
    is brought up to date.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for i, (raw, hit) in enumerate(zip(raw_texts(batch, text_col), batch.column("__hit").to_pylist())):
                runs = list(zip(hit["runs"][::2], hit["runs"][1::2]))
                if sum(b - a for a, b in runs) > max_coverage * hit["n_words"]:
                    continue
                keep.append(i)
                if runs:
                    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
                    done, parts = 0, []
                    for a, b in runs:
                        parts.append(raw[done : at[a][0]])
                        done = at[b - 1][1]
                    raw = b"".join([*parts, raw[done:]])
                    texts.append(raw.decode())
                else:
                    texts.append(batch.column(text_col)[i].as_py())
            left = batch.take(pa.array(keep, pa.int64())).select(columns)
            new = {text_col: pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield replaced(left, new)

    return map_batches(mark(docs, benchmark, text_col=text_col, window=window), run, docs.schema)
