"""Chat formatting as prefix trees: what conversations share at their start is emitted once.

Conversations whose first turns are equal form a tree of turns. The forest is laid out depth first in one
stream of tokens: each node (a formatted turn) appears once, right after its ancestors or their other
descendants. With every node come its span in the stream, the position its first token has in its own
conversation, the spans its tokens may attend to besides earlier ones of its own (its ancestors, as
intervals), and the span of tokens that count for the loss.

How: a conversation's path is the list of hashes of its turns. Conversations are sorted by path over
ranges, and each is compared with the one before it only: it adds the nodes below the prefix they share.
Spans then follow from running sums within partitions and one row of totals per partition. No tree, however
many conversations share its root, is ever held in one place; a partition holds the path of one
conversation at a time.

The template marks a turn as ``<|role|>text<|end|>``. Inside texts and roles every string that could be
read as a control string, of this template or of common others, gets one backslash after its opening
character for each time it is escaped, so that reading takes one away again. Control strings of the
template become tokens of their own, which no text can produce.

Defined cases: a null text or role is empty. Turns are ordered by turn number, nulls first, then role and
text; repeated turns stay. A null conversation id is a conversation like any other. Other columns are
ignored. An empty table gives empty results. A conversation is read as one row, as its digest needs it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches
from tripleweave.operators.joins import skew_join
from tripleweave.session import cut

# Control strings of this template and of widespread ones.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
_BODY = r"(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>|pad>|unk>|mask>)"
CONTROL = re.compile(r"([<\[])(\\*)" + _BODY)
ESCAPED = re.compile(r"([<\[])\\(\\*)" + _BODY)
ROLE_END = re.compile(r"(\|)(\\*)(>)")
ROLE_ENDED = re.compile(r"(\|)\\(\\*)(>)")
LEARNED = "assistant"
#: Splits text so that common words and their leading space are single tokens; a vocabulary's usual pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def escape(text: str) -> str:
    """Make every control string in a text harmless; ``unescape`` is the inverse for any text."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """As for texts; the closing mark is escaped as well."""
    return ROLE_END.sub(r"\1\\\2\3", escape(role))


def unescape_role(role: str) -> str:
    return unescape(ROLE_ENDED.sub(r"\1\2\3", role))


class Tokens:
    """A byte-pair vocabulary with three control tokens after its last id."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.open = max(table.values()) + 1
        self.controls = {self.open: OPEN, self.open + 1: CLOSE, self.open + 2: END}

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Tokens of one formatted turn, and the part of them that is text."""
        head = [self.open, *self.model.encode_ordinary(escape_role(role)), self.open + 1]
        body = self.model.encode_ordinary(escape(text))
        return [*head, *body, self.open + 2], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        """Tokens back as formatted text."""
        out, plain = [], []
        for i in ids:
            if i in self.controls:
                out += [self.model.decode_bytes(plain), self.controls[i].encode()]
                plain = []
            else:
                plain.append(i)
        return b"".join([*out, self.model.decode_bytes(plain)]).decode()

    def read_turn(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn's tokens, unescaped."""
        split = ids.index(self.open + 1)
        role, text = self.model.decode_bytes(ids[1:split]), self.model.decode_bytes(ids[split + 1 : -1])
        return unescape_role(role.decode()), unescape(text.decode())


def vocabulary(spark: SparkSession, path: str):
    """A broadcast of a vocabulary file of ranks, read on the driver; such files hold a few MB at most."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(ranks) -> Callable[[], Tokens]:
    held: list[Tokens] = []

    def get() -> Tokens:
        if not held:
            held.append(Tokens(ranks.value))
        return held[0]

    return get


PATHS = (
    "conv bigint, path binary, nodes array<struct<key:binary,tokens:array<int>,loss_from:int,loss_to:int>>"
)


def _conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return own.groupBy(F.col("conv_id").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


NODE = pa.struct([("key", pa.binary()), ("tokens", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32())])


def _paths(conversations: DataFrame, ranks) -> DataFrame:
    """Conversations with their path (16 bytes per turn) and the formatted turns along it."""
    get = _encoder(ranks)

    def run(batches):
        tokens = get()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                paths, nodes = [], []
                for turns in part.column("turns").to_pylist():
                    own = []
                    for t in turns:
                        digest = hashlib.sha256(f"{len(t['role'])} {t['role']} {t['text']}".encode()).digest()[:16]
                        ids, begin, end = tokens.turn(t["role"], t["text"])
                        learned = t["role"] == LEARNED
                        own.append({"key": digest, "tokens": ids, "loss_from": begin if learned else 0, "loss_to": end if learned else 0})
                    paths.append(b"".join(n["key"] for n in own))
                    nodes.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), pa.array(paths, pa.binary()), pa.array(nodes, pa.list_(NODE))],
                    names=["conv", "path", "nodes"],
                )

    return map_batches(conversations, run, PATHS)


LAID = (
    "kind string, part int, conv bigint, depth int, start bigint, n int, stack array<bigint>, sizes array<int>, "
    "path binary, first_path binary, spine array<int>, tokens array<int>, loss_from int, loss_to int"
)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b)) // 16
    return next((k for k in range(n) if a[16 * k : 16 * k + 16] != b[16 * k : 16 * k + 16]), n)


def _lay_out(batches):
    """Nodes, leaves and one row of totals of a sorted partition, with starts counted from its own start."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in LAID.split(", ")]
    path, stack, sizes, total = b"", [], [], 0
    first, spine = None, []

    def packed(rows):
        columns = {n: [r.get(n) for r in rows] for n in names}
        types = {"kind": pa.string(), "conv": pa.int64(), "start": pa.int64(), "stack": pa.list_(pa.int64())}
        types |= {n: pa.list_(pa.int32()) for n in ("sizes", "spine", "tokens")}
        types |= {n: pa.binary() for n in ("path", "first_path")}
        return pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.int32())) for n in names], names=names)

    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = []
            for c in batch.slice(k, 64).to_pylist():
                keep = _shared(path, c["path"])
                path, stack, sizes = c["path"], stack[:keep], sizes[:keep]
                for depth in range(keep, len(c["nodes"])):
                    node = c["nodes"][depth]
                    n = len(node["tokens"])
                    rows.append(
                        {"kind": "node", "part": part, "conv": c["conv"], "depth": depth, "start": total, "n": n}
                        | {"stack": list(stack), "sizes": list(sizes), "tokens": node["tokens"]}
                        | {"loss_from": node["loss_from"], "loss_to": node["loss_to"]}
                    )
                    stack.append(total)
                    sizes.append(n)
                    total += n
                if first is None:
                    first, spine = path, list(sizes)
                rows.append({"kind": "leaf", "part": part, "conv": c["conv"], "stack": list(stack), "sizes": list(sizes)})
            yield packed(rows)
    if first is not None:
        last = {"kind": "part", "part": part, "start": total, "path": path, "first_path": first}
        yield packed([last | {"stack": stack, "sizes": sizes, "spine": spine}])


def _bases(parts: list) -> list[tuple]:
    """Per partition (part, shift, removed, carried): how its own starts become starts in the stream.

    Its first ``removed`` tokens are nodes that the stream has already, at ``carried``; the rest moves by
    ``shift``.
    """
    out, base, path, stack = [], 0, b"", []
    for p in sorted(parts, key=lambda r: r.part):
        shared = _shared(path, p.first_path)
        removed = sum(p.spine[:shared])
        shift = base - removed
        out.append((p.part, shift, removed, stack[:shared]))
        stack = [stack[i] if x < removed else x + shift for i, x in enumerate(p.stack)]
        base, path = shift + p.start, p.path
    return out


def forest(turns: DataFrame, ranks) -> tuple[DataFrame, DataFrame]:
    """Nodes and leaves of the forest of ``turns(conv_id, turn, role, text)``; ``ranks`` is a ``vocabulary``.

    Nodes: start, n_tokens, depth, position, ancestors (merged [begin, end) intervals of the stream),
    tokens, loss_from and loss_to (within the node), conv (a conversation it comes from). Leaves: conv and
    the starts of its nodes from the root on; equal conversations have a leaf each and share all nodes.
    """
    spark = turns.sparkSession
    paths = cut(_paths(_conversations(turns), ranks))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.repartitionByRange(count, "path", "conv").sortWithinPartitions("path", "conv")
    laid = cut(map_batches(ordered, _lay_out, LAID))
    # One row per partition, with the path of one conversation.
    totals = laid.filter("kind = 'part'").select("part", "start", "path", "first_path", "stack", "spine")
    schema = "part int, shift bigint, removed bigint, carried array<bigint>"
    bases = spark.createDataFrame(_bases(totals.collect()), schema)
    placed = laid.join(F.broadcast(bases), "part").withColumn("local", F.col("stack"))
    moved = F.transform(
        "local",
        lambda x, i: F.when(x < F.col("removed"), F.get("carried", i)).otherwise(x + F.col("shift")),
    )
    placed = placed.withColumn("stack", moved)
    begins = F.filter("stack", lambda x, i: (i == 0) | (F.get("ends", i - 1) != x))
    stops = F.filter("ends", lambda x, i: (i == F.size("ends") - 1) | (F.get("stack", i + 1) != x))
    nodes = (
        placed.filter("kind = 'node' AND start >= removed")
        .withColumn("ends", F.transform("stack", lambda x, i: x + F.get("sizes", i)))
        .withColumns({"begin": begins, "end": stops})
        .select(
            (F.col("start") + F.col("shift")).alias("start"),
            F.col("n").alias("n_tokens"),
            "depth",
            F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position"),
            F.arrays_zip("begin", "end").alias("ancestors"),
            "tokens",
            "loss_from",
            "loss_to",
            "conv",
        )
    )
    return nodes, placed.filter("kind = 'leaf'").select("conv", F.col("stack").alias("starts"))



def read_back(nodes: DataFrame, leaves: DataFrame, ranks) -> DataFrame:
    """Conversations from the stream: ``(conv, formatted, turns, loss)``.

    ``formatted`` is the text of all tokens, ``turns`` their roles and texts unescaped, ``loss`` the text of
    the tokens that count for the loss, unescaped span by span.
    """
    get = _encoder(ranks)
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches):
        tokens = get()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                formatted, turns, losses = [], [], []
                for own in part.column("nodes").to_pylist():
                    formatted.append("".join(tokens.text(n["tokens"]) for n in own))
                    turns.append([dict(zip(("role", "text"), tokens.read_turn(n["tokens"]))) for n in own])
                    spans = (n["tokens"][n["loss_from"] : n["loss_to"]] for n in own)
                    losses.append("".join(unescape(tokens.text(s)) for s in spans))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), pa.array(formatted), pa.array(turns, pa.list_(turn)), pa.array(losses)],
                    names=["conv", "formatted", "turns", "loss"],
                )

    steps = leaves.select("conv", F.posexplode("starts").alias("depth", "start"))
    found = skew_join(steps, nodes.select("start", "tokens", "loss_from", "loss_to"), ["start"])
    node = F.struct("depth", "tokens", "loss_from", "loss_to")
    whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    schema = "conv bigint, formatted string, turns array<struct<role:string,text:string>>, loss string"
    return map_batches(whole, run, schema)
