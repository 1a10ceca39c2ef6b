"""Periodic runs in word sequences, found with minimizers at several scales.

A run is a stretch of words with smallest period q and at least ``max(MIN_WORDS, 2q)`` words that no
neighbouring word extends. Periods up to ``SHORT`` are found by comparing every word with the one p places
on, for each p. Longer ones are searched scale by scale; scale w (8, 16, ...) finds the periods from 2w - 1
to 4w - 2. The w words from a position on are its content; of every w positions in a row the one whose
content hashes lowest is selected. Inside a run the selected positions repeat one period later, with equal
contents, so that two selected positions with equal contents are a seed, whose period is their distance. A
seed is extended to both sides by hashes of prefixes, and every run so found is compared word by word.

Contents that are periodic themselves (period up to w / 2) are not selected, which keeps equal ones more
than w / 2 apart and the number of seeds in proportion to the words. What that leaves out are runs whose
first period lies inside a run of smaller period and whose second one lies in the next such run; they are
seeded where two runs of one period touch. So every run is found, whatever the text. By Fine and Wilf's
theorem the smallest period of a stretch is the first one it is found with.

A batch of documents is one sequence, with a separator of its own between any two documents, so that
there is no run across them. Work and memory are in proportion to the words of a batch, times the logarithm
of the longest document's length.

Defined cases: a null, empty or blank text has no words and no runs, and an empty collapsed text. A null id
stays null. Repeated rows are judged one by one. Other columns are ignored, whatever their names. A very long
text makes a batch of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, raw_texts, slices

MIN_WORDS = 12
FIRST_SCALE = 8
#: Periods compared directly: all that the first scale does not find.
SHORT = 2 * FIRST_SCALE - 2
#: Bytes of text searched at a time; a longer document is a batch of its own.
BATCH_BYTES = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
# Any odd number is a base whose powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class _Contents:
    """Hashes of any stretch of a sequence: equal stretches have equal hashes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes) * _powers(BASE, n), out=self.prefix[1:])
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]

    def windows(self, width: int, n: int) -> np.ndarray:
        return (self.prefix[width : n + 1] - self.prefix[: n + 1 - width]) * self.inverse[: n + 1 - width]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int, step: int) -> np.ndarray:
        """How far the sequence agrees from ``a`` and ``b > a`` on (``step`` 1) or before them (-1)."""
        far = np.zeros(len(a), np.int64)
        for bit in reversed(range(max(1, limit.bit_length()))):
            more = far + (1 << bit)
            fits = b + more < len(self.prefix) if step > 0 else a >= more
            x, y, length = a[fits], b[fits], more[fits]
            if step < 0:
                x, y = x - length, y - length
            good = np.flatnonzero(fits)[self.of(x, length) == self.of(y, length)]
            far[good] = more[good]
        return far


def _stretches(codes: np.ndarray, period: int, least: int) -> np.ndarray:
    """Runs ``(start, end, period)`` of one period, by direct comparison."""
    same = np.flatnonzero(codes[period:] == codes[:-period])
    if not len(same):
        return np.empty((0, 3), np.int64)
    new = np.flatnonzero(np.diff(same) > 1)
    start, stop = same[np.r_[0, new + 1]], same[np.r_[new, len(same) - 1]] + 1
    long = stop - start >= max(period, least - period)
    start, stop = start[long], stop[long]
    return np.stack([start, stop + period, np.full(len(start), period)], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, np.any(runs[1:, :2] != runs[:-1, :2], axis=1)]] if len(runs) else runs


def _extended(codes: np.ndarray, contents: _Contents, at: np.ndarray, period: np.ndarray, limit: int) -> np.ndarray:
    """The runs that seeds ``codes[at] == codes[at + period]`` lie in."""
    start = at - contents.common(at, at + period, limit, -1)
    stop = at + contents.common(at, at + period, limit, 1)
    good = stop - start >= period
    found = np.unique(np.stack([start, stop + period, period], axis=1)[good], axis=0)
    sure, left = [], []
    for s, e, p in found.tolist():
        if np.array_equal(codes[s : e - p], codes[s + p : e]):
            sure.append((s, e, p))
        else:  # two different stretches of one hash: look for the run among all stretches of this period
            left.append(p)
    again = [_stretches(codes, p, 2 * p) for p in sorted(set(left))]
    return np.concatenate([np.array(sure, np.int64).reshape(-1, 3), *again])


def _seeds(contents: _Contents, runs: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods at which scale ``width`` seeds runs among the first ``n`` words."""
    low, high = 2 * width - 1, 4 * width - 1
    window = contents.windows(width, n)
    small = runs[(2 * runs[:, 2] <= width) & (runs[:, 1] - runs[:, 0] >= width)]
    # Position in the low half: of equal hashes the leftmost is the least.
    least = (mixed(window) >> np.uint64(33) << np.uint64(32) | np.arange(len(window), dtype=np.uint64)).view(np.int64)
    if len(small):
        cover = np.zeros(len(window) + 1, np.int64)
        inside = small[small[:, 0] < len(window)]
        np.add.at(cover, inside[:, 0], 1)
        np.add.at(cover, np.minimum(inside[:, 1] - width + 1, len(window)), -1)
        least[np.cumsum(cover[:-1]) > 0] = np.iinfo(np.int64).max
    reach = 1
    while reach < width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    chosen = least[least != np.iinfo(np.int64).max] & 0xFFFFFFFF
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]] if len(chosen) else chosen
    key = window[chosen]
    order = np.argsort(key, kind="stable")
    chosen, key = chosen[order], key[order]
    at, period = [], []
    first, shift = np.arange(len(chosen)), 1
    while len(first := first[first + shift < len(chosen)]):
        distance = chosen[first + shift] - chosen[first]
        going = (key[first + shift] == key[first]) & (distance < high)
        first, distance = first[going], distance[going]
        at.append(chosen[first[distance >= low]])
        period.append(distance[distance >= low])
        shift += 1
    # Where two runs of one small period touch.
    long = small[small[:, 1] - small[:, 0] >= low]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    for (s, e, d), (s2, e2, d2) in zip(long[:-1].tolist(), long[1:].tolist()):
        if d == d2 and s2 <= e and s2 - width >= 0:
            may = np.arange(low, min(high, e - s + 1, e2 - s2 + 1))
            before = np.full(len(may), s2 - width)
            may = may[contents.of(before, width) == contents.of(before + may, width)]
            at.append(np.full(len(may), s2 - 1))
            period.append(may)
    return (np.concatenate(at), np.concatenate(period)) if at else (chosen[:0], chosen[:0])


def runs_of(codes: np.ndarray, sizes: list[int], min_words: int = MIN_WORDS) -> np.ndarray:
    """All runs ``(start, end, period)`` of a sequence made of documents of the given ``sizes``.

    Documents come longest first, each followed by a separator that occurs nowhere else; ``sizes`` do not
    count it.
    """
    if not sizes:
        return np.empty((0, 3), np.int64)
    least = min(FIRST_SCALE, min_words)
    runs = _smallest(np.concatenate([_stretches(codes, p, least) for p in range(1, min(SHORT + 1, len(codes) + 1))]))
    ends = np.cumsum(np.array(sizes) + 1)
    width, contents = FIRST_SCALE, None
    while 2 * (2 * width - 1) <= sizes[0]:
        contents = contents or _Contents(codes)
        n = int(ends[sum(size >= 2 * (2 * width - 1) for size in sizes) - 1])
        at, period = _seeds(contents, runs, width, n)
        if len(at):
            runs = _smallest(np.concatenate([runs, _extended(codes, contents, at, period, sizes[0])]))
        width *= 2
    return runs[runs[:, 1] - runs[:, 0] >= np.maximum(min_words, 2 * runs[:, 2])]


def _marked(batches, min_words):
    for batch in (part for whole in batches for part in slices(iter([whole]), "text", BATCH_BYTES)):
        words = [raw.split() for raw in raw_texts(batch, "text")]
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        known: dict[bytes, int] = {}
        codes: list[int] = []
        begins = np.zeros(len(words), np.int64)
        for k, i in enumerate(order):
            begins[k] = len(codes)
            codes += [known.setdefault(w, len(known)) for w in words[i]]
            codes.append(-1 - k)
        found = runs_of(np.array(codes, np.int64), [len(words[i]) for i in order], min_words)
        owner = np.searchsorted(begins, found[:, 0], side="right") - 1
        runs: list[list[dict]] = [[] for _ in words]
        kept = [None] * len(words)
        for k in np.unique(owner).tolist():
            own = found[owner == k] - np.array([begins[k], begins[k], 0])
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            drop = np.zeros(len(words[order[k]]) + 1, np.int64)
            np.add.at(drop, own[:, 0] + own[:, 2], 1)
            np.add.at(drop, own[:, 1], -1)
            stays = np.cumsum(drop[:-1]) == 0
            kept[order[k]] = [w for w, stay in zip(words[order[k]], stays.tolist()) if stay]
            runs[order[k]] = [{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()]
        collapsed = [b" ".join(w if some is None else some) for w, some in zip(words, kept)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(runs, pa.list_(RUN_TYPE)),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per document: its runs by start and period, and its words joined
    by single spaces without those that any run holds after its first period."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string"
    return map_batches(own, lambda batches: _marked(batches, min_words), schema)
