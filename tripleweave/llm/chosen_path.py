"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set of shingles is reduced to ``TOKENS`` minwise tokens; two sets share about as many of them as their
Jaccard similarity says. Documents are dealt to the nodes of random trees: at a node every token is kept with a
probability of ``BRANCH / (similarity * TOKENS)``, by a hash that the node and the token determine, and a document
goes on to one child per kept token of its own. Similar documents keep common tokens and meet again; a pair
at the least similarity has ``BRANCH`` > 1 common children on average. A node of at most ``LEAF`` documents is compared
exhaustively. A larger one is first compared with a few leaders, by signatures and then the sets of those that resemble
them; the leaders then leave it, and the others branch on.
Beyond ``DEPTH`` levels nodes no longer branch and lose leaders until they are small or connected, so that no pair
of a node is left out. ``TREES`` independent trees give the recall: a leaf's pair at the least similarity is missed
by one tree with a probability of 0.33, by all with 0.00002, and by 0.03 at worst after ten levels of branching.

What is linked is certain: every link is decided on the whole sets, with integers. Documents with equal sets
are one class from the start, of which one text only is looked at. The first ``EARLY`` trees go first; then
most linked classes get a common root, and nodes whose members have one root are not compared again. So
of a group of near copies only a spanning part of the links is ever written, and connected groups cost
later trees nothing. Signatures travel with the members of a node; whole sets follow only those whose signature
resembles another's.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing (``link_empty`` makes all of
them one class instead). A text of fewer words than a shingle is one shingle. A document without id takes the
component of its class, null if no document of the class has an id. Repeated rows are linked like copies. Other columns are ignored, whatever
their names. A very long text is one row, whose set is in memory once per worker. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, raw_texts, slices
from tripleweave.llm.components import components
from tripleweave.llm.simhash import majority, masks
from tripleweave.operators.joins import skew_join
from tripleweave.session import cut, discard

SHINGLE = 4
#: The least similarity as a fraction, compared in whole numbers.
SIMILAR = (4, 5)
TOKENS, TREES, BRANCH = 128, 12, 1.1
#: Trees after which roots are brought up to date for the first time; they find most links.
EARLY = 2
LEAF, LEADERS, DEPTH = 2048, 8, 20
#: Bytes of a word up to which words are hashed together.
LONG_WORD = 64
BATCH_BYTES = 1 << 22
SPACES = np.isin(np.arange(256), np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
#: Common tokens from which on whole sets are compared: four standard deviations below the least similarity.
RESEMBLING = 84
RANDOM = np.random.default_rng(11)
FACTORS = RANDOM.integers(1 << 30, 1 << 32, TOKENS, np.uint32) | np.uint32(1)
MASKS = RANDOM.integers(0, 1 << 32, TOKENS, np.uint32)
TREE_SEEDS = RANDOM.integers(0, 1 << 63, TREES, np.uint64)
KEPT = np.uint64(int(BRANCH * SIMILAR[1] / (SIMILAR[0] * TOKENS) * 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(line: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of every word ``line[start:stop]``, eight bytes at a time; very long words are hashed one by one."""
    size = stops - starts
    eights = np.lib.stride_tricks.as_strided(np.frombuffer(line + bytes(8), np.uint64, 1), (len(line) + 1,), (1,))
    out = size.astype(np.uint64)
    for at in range(0, LONG_WORD, 8):
        rest = np.flatnonzero(size > at) if at else np.arange(len(size))
        if not len(rest):
            break
        bits = 8 * np.minimum(size[rest] - at, 8).astype(np.uint64)
        part = eights[starts[rest] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        out[rest] = mixed(out[rest] ^ part)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(line[starts[i] : stops[i]])
    return out


def hashed(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text a hash of every shingle of its lower-cased words, repeats included."""
    line = b" " + b" ".join(texts).lower() + b" "
    space = SPACES[np.frombuffer(line, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    words = word_hashes(line, starts, stops)
    firsts = np.searchsorted(starts, np.r_[1, 1 + np.cumsum([len(t) + 1 for t in texts])])
    shingles = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        shingles = mixed(shingles ^ words[k : k + len(shingles)])
    out = []
    for first, stop in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        n = stop - first
        if n >= width:
            out.append(shingles[first : stop - width + 1])
            continue
        one = np.full(min(n, 1), n, np.uint64)
        for k in range(first, stop):
            one = mixed(one ^ words[k])
        out.append(one)
    return out


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set that is not empty, each made of its place and value."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        least = np.minimum(least, ((high[at : at + 1024] ^ MASKS[:, None]) * FACTORS[:, None]).min(axis=1))
    return mixed(least + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))


def children(nodes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows keep which child, of documents at ``nodes`` with tokens ``own`` (a row each)."""
    chance = mixed(nodes[:, None] ^ mixed(own))
    row, place = np.nonzero(chance < KEPT)
    return row, mixed(chance[row, place] + np.uint64(1))


def _marks(batches: Iterator[pa.RecordBatch], width: int, fingerprints: bool) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(iter([whole]), "text", BATCH_BYTES)):
        out: dict[str, list] = {c: [] for c in ("class", "n", "fp", "signature", "trees", "keys")}
        for hashes in hashed(raw_texts(batch, "text"), width):
            own = np.unique(hashes)
            signature, trees, keys = b"", [], []
            if len(own):
                all_tokens = tokens(own)
                signature = (all_tokens & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                tree, key = children(TREE_SEEDS, all_tokens[None, :])
                trees, keys = tree.tolist(), key.view(np.int64).tolist()
            fp = majority(hashes) if fingerprints else 0
            found = (hashlib.sha256(own.tobytes()).digest()[:16], len(own), fp, signature, trees, keys)
            for values, value in zip(out.values(), found):
                values.append(value)
        types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
        arrays = [pa.array(values, t) for values, t in zip(out.values(), types)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *out])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, with the groups' bounds."""

    def starts(table: pa.Table) -> np.ndarray:
        values = [table.column(c).to_numpy() for c in keys]
        return np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held:
            last = held[-1]
            if all(last.column(c)[-1].as_py() == table.column(c)[0].as_py() for c in keys) and not len(starts(table)):
                held.append(table)
                continue
            table = pa.concat_tables([*held, table])
        new = starts(table)
        if len(new):
            whole = table.slice(0, int(new[-1])).combine_chunks()
            yield whole, np.r_[0, new]
            table = table.slice(int(new[-1]))
        held = [table]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]


def _similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others are similar to one, decided on the whole sets, none of them empty."""
    part, whole = SIMILAR
    sizes = np.array([len(x) for x in others], np.int64)
    good = whole * np.minimum(sizes, len(one)) >= part * np.maximum(sizes, len(one))
    chosen = np.flatnonzero(good)
    if len(chosen):
        values = np.concatenate([others[i] for i in chosen])
        at = np.minimum(np.searchsorted(one, values), len(one) - 1)
        common = np.add.reduceat((one[at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes[chosen])[:-1]])
        good[chosen] = whole * common >= part * (len(one) + sizes[chosen] - common)
    return good


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of one byte per token."""
    for batch in batches:
        short = [np.frombuffer(x, np.uint16).astype(np.uint8).tobytes() for x in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(short, pa.binary())], names=["rep", "signature"])


def _resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each node whose signature resembles that of a member with another root."""
    for table, bounds in _whole_groups(batches, ["key"]):
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, TOKENS)
        root = table.column("root").to_numpy()
        hit = np.zeros(len(root), bool)
        sizes = np.diff(bounds)
        pair = bounds[:-1][sizes == 2]
        near = ((signature[pair] == signature[pair + 1]).sum(axis=1) >= RESEMBLING) & (root[pair] != root[pair + 1])
        hit[pair[near]] = hit[pair[near] + 1] = True
        for start, stop in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2]):
            for x in range(start, stop - 1):
                rest = slice(x + 1, stop)
                near = ((signature[rest] == signature[x]).sum(axis=1) >= RESEMBLING) & (root[rest] != root[x])
                hit[rest] |= near
                hit[x] |= near.any()
        yield from table.select(["key", "rep", "root"]).filter(pa.array(hit)).to_batches()


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect, in every node, all members that links of members connect."""
    for table, bounds in _whole_groups(batches, ["key"]):
        sets, root = _sets(table), table.column("root").to_numpy()
        rep, a, b = table.column("rep").to_numpy(), [], []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            left = np.arange(start, stop)
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    reached = root[left] == root[x]
                    may = np.flatnonzero(~reached)
                    good = may[_similar_to(sets[x], [sets[i] for i in left[may]])] if len(may) else may
                    a += [rep[x]] * len(good)
                    b += rep[left[good]].tolist()
                    reached[good] = True
                    queue += left[reached].tolist()
                    left = left[~reached]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _led(batches: Iterator[pa.RecordBatch], branching: bool) -> Iterator[pa.RecordBatch]:
    """Members of large nodes with the leaders they resemble, and the children they go on to; leaders stay behind."""
    places = np.arange(TOKENS, dtype=np.uint64) << np.uint64(16)
    for table, bounds in _whole_groups(batches, ["key", "salt"]):
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, TOKENS)
        root, rep, key = (table.column(c).to_numpy() for c in ("root", "rep", "key"))
        is_leader = table.column("lead").to_numpy()
        leads, on = [[] for _ in rep], [[] for _ in rep]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            first = start + int(is_leader[start:stop].sum())
            for h in range(start, first):
                near = ((signature[first:stop] == signature[h]).sum(axis=1) >= RESEMBLING) & (root[first:stop] != root[h])
                for i in (first + np.flatnonzero(near)).tolist():
                    leads[i].append(int(rep[h]))
            going = np.flatnonzero(~np.isin(rep[first:stop], rep[start:first])) + first
            if branching and len(going):
                row, child = children(key[going].view(np.uint64), signature[going].astype(np.uint64) + places)
                for i, c in zip(going[row].tolist(), child.view(np.int64).tolist()):
                    on[i].append(c)
            else:
                for i in going.tolist():
                    on[i].append(int(key[i]))
        out = [pa.array(rep), pa.array(root), *(pa.array(x, pa.list_(pa.int64())) for x in (leads, on))]
        yield from pa.table(out, names=["rep", "root", "leads", "keys"]).filter(pa.array(is_leader == 0)).to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the members put with a leader, those whose sets are similar to its own; it comes first."""
    for table, bounds in _whole_groups(batches, ["lead", "salt"]):
        sets, rep, a, b = _sets(table), table.column("rep").to_numpy(), [], []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            good = _similar_to(sets[start], sets[start + 1 : stop])
            a += rep[start + 1 : stop][good].tolist()
            b += [int(rep[start])] * int(good.sum())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


MEMBER = "key bigint, rep bigint, root bigint"


def _open(members: DataFrame) -> DataFrame:
    """Members of nodes that have members of different roots, with the node's size and its least root."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return cut(skew_join(members, sizes.filter("low < high").drop("high"), ["key"]))


def _near(small: DataFrame, signatures: DataFrame) -> DataFrame:
    return cut(map_batches(_with(small.drop("n", "low"), signatures, "key"), _resembling, MEMBER))


def _close(near: DataFrame, sets: DataFrame) -> DataFrame:
    return cut(map_batches(_with(near, sets, "key"), _leaf_links, "a bigint, b bigint"))


def _rooted(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.select("key", "rep", F.col("rep").alias("root"))
    named = skew_join(members.select("key", "rep"), found, ["rep"], "left")
    return named.select("key", "rep", F.coalesce("root", "rep").alias("root"))


def _with(members: DataFrame, of_rep: DataFrame, *group: str) -> DataFrame:
    """Members with a column of their classes, sorted by node."""
    return skew_join(members, of_rep, ["rep"]).repartition(*group).sortWithinPartitions(*group, "rep")


class _Sets:
    """Whole sets of classes, fetched when they are first needed."""

    def __init__(self, fetch: Callable[[DataFrame], DataFrame]):
        self.fetch, self.tables = fetch, []

    def of(self, reps: DataFrame) -> DataFrame:
        wanted = reps.select("rep").distinct()
        for table in self.tables:
            wanted = wanted.join(table.select("rep"), "rep", "left_anti")
        self.tables.append(cut(self.fetch(wanted)))
        return reduce(DataFrame.unionByName, self.tables)

    def discard(self) -> None:
        for table in self.tables:
            discard(table)


def _parts(n: str) -> tuple:
    """All parts of a group of ``n`` members, and a member's own."""
    parts = F.ceil(F.col(n) / LEAF).cast("bigint")
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("salt"), F.pmod(F.xxhash64("rep"), parts).alias("salt")


def _large_links(large: DataFrame, signatures: DataFrame, sets: _Sets, level: int) -> tuple[DataFrame, DataFrame]:
    """Links of the large nodes' leaders, and the members that go on from there.

    A part of a node, or of those that resemble one leader, is one task's; leaders are sent to each of its parts.
    """
    slot = F.when(F.col("root") == F.col("low"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("rep"), F.lit(LEADERS)))
    first = F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(level)))
    chosen = cut(large.groupBy("key", "n", slot.alias("slot")).agg(first.alias("x")).select("key", "n", "x.*"))
    every, own = _parts("n")
    heads = chosen.select("key", every, F.lit(1).alias("lead"), "rep", "root")
    rows = large.select("key", own, F.lit(0).alias("lead"), "rep", "root").unionByName(heads)
    rows = skew_join(rows, signatures, ["rep"]).repartition("key", "salt")
    rows = rows.sortWithinPartitions("key", "salt", F.desc("lead"), "rep")
    schema = "rep bigint, root bigint, leads array<bigint>, keys array<bigint>"
    led = cut(map_batches(rows, lambda batches: _led(batches, level < DEPTH), schema))
    pairs = cut(led.select("rep", F.explode("leads").alias("lead")).distinct())
    sizes = cut(pairs.groupBy("lead").agg(F.count("*").alias("n")))
    whole = sets.of(pairs.select("rep").unionByName(sizes.select(F.col("lead").alias("rep"))))
    heads = sizes.select("lead", every, F.lit(1).alias("head"), F.col("lead").alias("rep"))
    members = skew_join(pairs, sizes, ["lead"]).select("lead", own, F.lit(0).alias("head"), "rep")
    both = skew_join(members.unionByName(heads), whole, ["rep"]).repartition("lead", "salt")
    both = both.sortWithinPartitions("lead", "salt", F.desc("head"), "rep")
    found = cut(map_batches(both, _confirmed, "a bigint, b bigint"))
    named = skew_join(found, chosen.select(F.col("rep").alias("b"), "root").distinct(), ["b"])
    better = cut(named.groupBy(F.col("a").alias("rep")).agg(F.min("root").alias("better")))
    on = skew_join(led.select("rep", "root", F.explode("keys").alias("key")), better, ["rep"], "left")
    on = cut(on.select("key", "rep", F.coalesce("better", "root").alias("root")))
    for table in (chosen, led, pairs, sizes, better):
        discard(table)
    return found, on


def _towards_roots(new: list[DataFrame]) -> DataFrame:
    """``(rep, root)`` of linked classes after two steps towards the smallest class reachable: enough to tell most
    linked members of a node, for a small part of the rounds that whole components take."""
    edges = reduce(DataFrame.unionByName, new)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    top = low.select(F.col("rep").alias("root"), F.col("root").alias("top"))
    found = cut(skew_join(low, top, ["root"]).select("rep", F.col("top").alias("root")))
    discard(low)
    return found


def links(signatures: DataFrame, members: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(rep, root)`` of classes that are linked with others.

    ``signatures(rep, signature)`` has the classes, ``members(key, rep)`` deals them to nodes, of which those with odd keys
    wait for the links of the others, and ``fetch`` gives the whole sets ``(rep, shingles)`` of some.
    """
    short = cut(map_batches(signatures, _shortened, "rep bigint, signature binary"))
    crowded = _open(members.select("key", "rep", F.col("rep").alias("root")))
    small, large = crowded.filter(F.col("n") <= LEAF), crowded.filter(F.col("n") > LEAF)
    sets = _Sets(fetch)
    near = _near(small, short)
    whole = sets.of(near)
    found, new = None, []
    for turn in (0, 1):
        mine = F.col("key").bitwiseAND(F.lit(1).cast("long")) == turn
        leaves = near.filter(mine) if found is None else _open(_rooted(near.filter(mine), found)).drop("n", "low")
        now, level, lesser = large.filter(mine), 0, []
        if found is not None:
            now = _open(_rooted(now, found))
        while not (big := now.filter(F.col("n") > LEAF)).isEmpty():
            by_leaders, on = _large_links(big, signatures, sets, level)
            new.append(by_leaders)
            now, level = _open(on), level + 1
            discard(on, collect=True)
            lesser.append(now.filter(F.col("n") <= LEAF))
        # Small nodes tell later levels nothing: those of all levels are compared together.
        if lesser:
            more = _near(reduce(DataFrame.unionByName, lesser), short)
            leaves, whole = leaves.unionByName(more), sets.of(more)
        new.append(_close(leaves, whole))
        if found is None:
            found = _towards_roots(new)
    out = cut(components(reduce(DataFrame.unionByName, new)).toDF("rep", "root"))
    for table in (crowded, short, near, found, *new):
        discard(table)
    sets.discard()
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    link_empty: bool = False,
    fingerprints: bool = False,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document; a component is named by its smallest id.

    With ``fingerprints`` the covering masks of SimHash deal the classes to nodes as well, before the trees do.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, class binary, n bigint, fp bigint, signature binary, trees array<int>, keys array<bigint>"
    marked = cut(map_batches(own, lambda batches: _marks(batches, width, fingerprints), schema))
    columns = [F.first(c).alias(c) for c in ("n", "fp", "signature", "trees", "keys")]
    classes = marked.groupBy("class").agg(F.min("id").alias("least"), *columns)
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    linked = classes.filter("n > 0 AND least IS NOT NULL")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of some classes, from the text of one of their documents."""

        def run(batches):
            for batch in (part for whole in batches for part in slices(iter([whole]), "text", BATCH_BYTES)):
                sets = [np.unique(hashes).tobytes() for hashes in hashed(raw_texts(batch, "text"), width)]
                right = [hashlib.sha256(s).digest()[:16] == c for s, c in zip(sets, batch.column("class").to_pylist())]
                found = pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"])
                yield found.filter(pa.array(right, pa.bool_()))

        owners = cut(skew_join(linked.select("rep", F.col("least").alias("id"), "class"), wanted, ["rep"], "left_semi"))
        texts = skew_join(own, owners, ["id"]).select("rep", "class", "text")
        return map_batches(texts, run, "rep bigint, shingles binary").dropDuplicates(["rep"])

    # The lowest bit of a key tells whether its node waits for others.
    even = lambda key: F.col(key).bitwiseAND(F.lit(-2).cast("long"))
    zipped = linked.select("rep", F.explode(F.arrays_zip("trees", "keys")).alias("x")).select("rep", "x.*")
    late = (F.col("trees") >= EARLY).cast("long")
    members = zipped.select((even("keys") + late).alias("key"), "rep")
    if fingerprints:
        tables = (
            F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")))
            for t, m in enumerate(masks(list(range(64))))
        )
        dealt = linked.select(F.explode(F.array(*tables)).alias("key"), "rep")
        members = members.unionByName(dealt.select(even("key").alias("key"), "rep"))
    roots = links(linked.select("rep", "signature"), members, sets_of)
    told = skew_join(classes, roots, ["rep"], "left").select("class", "least", "n", F.coalesce("root", "rep").alias("root"))
    told = cut(told)
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(skew_join(told, smallest, ["root"]).select("class", "component_id"))
    discard(classes)
    named = skew_join(marked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class"), told, ["class"])
    alone = F.lit(False) if link_empty else F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    link_empty: bool = False,
    fingerprints: bool = False,
) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; documents without id stay."""
    found = near_duplicates(docs, id_col, text_col, width, link_empty, fingerprints)
    copies = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    return docs.join(copies.distinct(), id_col, "left_anti")
