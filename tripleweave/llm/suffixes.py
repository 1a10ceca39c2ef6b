"""Sorting suffixes in two stages, and what one block of text contributes to the search for repeats.

All of this runs inside tasks, on blocks of bounded size, with numpy.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
GRAM = 16
MIX = 0xD6E8FEB86659FD93
BASE = 0x9E3779B97F4A7C15
#: One odd number per byte value; any odd numbers do, as long as every task uses the same.
VALUES = (np.cumprod(np.full(256, 0x2545F4914F6CDD1D, U)) ^ U(0x5851F42D4C957F2C)) * U(BASE) | U(1)


def _power(e: int) -> np.uint64:
    return U(pow(BASE, e, 1 << 64))


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A hash of every run of ``width`` bytes (a power of two), by joining hashes of half the width."""
    h, n = VALUES[data], 1
    while n < width:
        h, n = h[:-n] * _power(n) + h[n:], 2 * n
    h *= U(MIX)
    h ^= h >> U(32)
    return h * U(MIX)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: first window, end of the run, hash of the anchor, document.

    A window is ``length`` bytes of one document. Its anchor is its first gram of least hash, so equal
    windows have equal anchors, in whatever documents they are. Consecutive windows with one anchor make
    a run.
    """
    width = length - GRAM + 1
    parts = []
    chunk = 1 << 16
    for at in range(0, len(data) - length + 1, chunk - width + 1):
        grams = gram_hashes(data[at : at + chunk + GRAM - 1])
        # The low bits hold the place, which makes the least one unique and tells where it is.
        least, n = grams & ~U(chunk - 1) | np.arange(len(grams), dtype=U), 1
        while 2 * n <= width:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        count = len(grams) - width + 1
        least = np.minimum(least[:count], least[width - n : width - n + count])
        place = (least & U(chunk - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((first + at, np.append(first[1:], count) + at, grams[place[first]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, U), none
    start, stop, grams = (np.concatenate(p) for p in zip(*parts))
    # A run may go on from chunk to chunk or reach over the end of a document: it is cut at either.
    doc, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    over = np.flatnonzero(last > doc)
    more = [(start[i], stop[i], grams[i], d) for i in over for d in range(doc[i] + 1, last[i] + 1)]
    if more:
        begins = np.concatenate([[0], ends[:-1]])
        extra = [np.array(x) for x in zip(*((max(a, begins[d]), b, g, d) for a, b, g, d in more))]
        start, stop, grams, doc = (np.concatenate(p) for p in zip((start, stop, grams, doc), extra))
    stop = np.minimum(stop, ends[doc] - length + 1)
    real = stop > start
    return start[real], stop[real], grams[real].astype(U), doc[real]


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, from sums over prefixes."""
    inverse = U(pow(BASE, -1, 1 << 64))
    powers = np.cumprod(np.concatenate([[U(1)], np.full(len(data), inverse, U)]))
    sums = np.concatenate([[U(0)], np.cumsum(VALUES[data] * powers[:-1])])
    back = np.cumprod(np.concatenate([[U(1)], np.full(len(data), U(BASE), U)]))
    return (sums[stop] - sums[start]) * back[start] * U(MIX)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    total = np.cumsum(size)
    if not len(total):
        return data[:0]
    return data[np.arange(total[-1]) + np.repeat(start - (total - size), size)]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts as they do."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    n = len(text) + 56
    words = np.zeros(n, U)
    for k in range(8):
        words = words << U(8) | padded[k : k + n]
    return words


def sort_windows(text: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> tuple:
    """Positions of all windows of strings, sorted by their bytes, and flags of the first of equal ones.

    String k starts at ``start[k]`` and has ``windows[k]`` windows, hence ``windows[k] + length - 1`` bytes.
    Two stages: suffixes smaller than their successor are sorted directly; each other one is put behind its
    successor's place by scanning the buckets of first bytes upwards. Order is exact to ``length`` bytes.
    Last, neighbours are compared for a common prefix of ``length``.
    """
    ends = start + windows + length - 1
    final = np.zeros(len(text), bool)
    final[ends - 1] = True
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True) | final)
    change = np.repeat(change, np.diff(np.concatenate([[-1], change])))  # where the run of a byte ends
    following = np.append(text[1:], 0)
    smaller = ~final[change] & (text[change] < following[change])
    # Needed: windows, and what follows them up to a suffix that is sorted directly.
    direct = np.flatnonzero(smaller)
    k = np.searchsorted(direct, start + windows - 1)
    stop = np.where(k < len(direct), np.append(direct, 0)[k], len(text))
    stop = np.minimum(stop, ends - 1) + 1
    edge = np.zeros(len(text) + 1, np.int8)
    edge[start] += 1
    np.add.at(edge, stop, -1)
    needed = np.cumsum(edge[:-1]).astype(bool)
    words = _words(text)
    direct = np.flatnonzero(smaller & needed)
    steps = [*range(0, length - 8, 8), length - 8]
    direct = direct[np.lexsort([words[direct + s] for s in reversed(steps)])]

    induced = needed & ~smaller
    opening = np.zeros(len(text), bool)
    opening[start] = True
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def before(at: np.ndarray) -> np.ndarray:
        at = at[~opening[at]] - 1
        return at[induced[at]]

    def deal(at: np.ndarray) -> None:
        at = at[np.argsort(text[at], kind="stable")]
        heads = text[at]
        for part in np.split(at, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
            if len(part):
                buckets[text[part[0]]].append(part)

    deal((ends - 1)[induced[ends - 1]])  # a string's end is smaller than any byte
    bounds = np.searchsorted(text[direct], np.arange(257))
    order = []
    for byte in range(256):
        now = np.concatenate(buckets[byte]) if buckets[byte] else direct[:0]
        while len(now):
            order.append(now)
            now = before(now)
            same = text[now] == byte
            deal(now[~same])
            now = now[same]
        own = direct[bounds[byte] : bounds[byte + 1]]
        order.append(own)
        deal(before(own))
    placed = np.concatenate(order)
    edge[:] = 0
    edge[start] += 1
    np.add.at(edge, start + windows, -1)
    placed = placed[np.cumsum(edge[:-1]).astype(bool)[placed]]
    equal = np.flatnonzero(words[placed[1:]] == words[placed[:-1]]) + 1
    for s in steps[1:]:
        equal = equal[words[placed[equal] + s] == words[placed[equal - 1] + s]]
    first = np.ones(len(placed), bool)
    first[equal] = False
    return placed, first


def window_minima(text: np.ndarray, start: np.ndarray, windows: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For every window of every string, in order, the least owner of a string with an equal window."""
    placed, first = sort_windows(text, start, windows, length)
    string = np.repeat(np.arange(len(start)), windows + length - 1)
    heads = np.flatnonzero(first)
    least = np.minimum.reduceat(owner[string[placed]], heads)
    of = np.full(len(text), -1, np.int64)
    of[placed] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(placed))))
    return least[of[of >= 0]]
