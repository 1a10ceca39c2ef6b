"""Escaping, layout and reading back of prefix trees."""

import random

import pytest

from tripleweave.llm import chat_tree

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string"


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(8)
    bits = ["<", "[", "\\", "|", ">", "/", "s", "INST]", "SYS>>", "<|end|>", "</s>", "[/INST]", "<<SYS>>", "a", "|>", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        hidden = chat_tree.escape(text)
        assert chat_tree.unescape(hidden) == text
        assert chat_tree.unescape_role(chat_tree.escape_role(text)) == text
        assert not any(c in hidden for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert "|>" not in chat_tree.escape_role(text)


@pytest.mark.parametrize("seed", range(3))
def test_forest_reads_back_and_shares_starts(spark, seed):
    rng = random.Random(seed)
    say = ["hi", "", "</s>", "<|end|>", "é è", None, "long text " * 40]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", None, "tool|>x"]) if t else "user"
            rows.append((c, t, role, rng.choice(say[: 2 if t < 2 else None]), "x"))
    rows += [(None, 0, "user", "hi", None), (None, None, "assistant", "no turn", ""), (3, 0, "user", "hi", "again"), (-1, 5, "assistant", "x", "")]
    ranks = chat_tree.vocabulary(spark, RANKS)
    nodes, leaves = chat_tree.forest(spark.createDataFrame(rows, TURNS), ranks)
    told = {r.conv: r for r in chat_tree.read_back(nodes, leaves, ranks).collect()}

    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    paths = {c: tuple((r, x) for *_, r, x in sorted(own)) for c, own in convs.items()}
    assert set(told) == set(paths)
    for c, path in paths.items():
        assert [(t.role, t.text) for t in told[c].turns] == list(path)
        assert told[c].loss == "".join(x for r, x in path if r == "assistant")
        plain = "".join(f"<|{chat_tree.escape_role(r)}|>{chat_tree.escape(x)}<|end|>" for r, x in path)
        assert told[c].formatted == plain

    found = sorted(nodes.collect(), key=lambda n: n.start)
    assert len(found) == len({p[:k] for p in paths.values() for k in range(1, len(p) + 1)})
    by_start, position = {}, 0
    for n in found:
        assert n.start == position and len(n.tokens) == n.n_tokens
        position += n.n_tokens
        by_start[n.start] = n
    for leaf in leaves.collect():
        chain = [by_start[s] for s in leaf.starts]
        for k, n in enumerate(chain):
            assert n.depth == k and n.position == sum(x.n_tokens for x in chain[:k])
            attended = [i for a in n.ancestors for i in range(a.begin, a.end)]
            assert attended == [i for x in chain[:k] for i in range(x.start, x.start + x.n_tokens)]
            assert all(a.end < b.begin for a, b in zip(n.ancestors, n.ancestors[1:]))
    # Depth first: a node's descendants follow it without a gap.
    open_nodes = []
    parents = {leaf.starts[k]: leaf.starts[k - 1] for leaf in leaves.collect() for k in range(1, len(leaf.starts))}
    for n in found:
        while open_nodes and open_nodes[-1] != parents.get(n.start):
            open_nodes.pop()
        assert n.depth == len(open_nodes)
        open_nodes.append(n.start)


def test_empty(spark):
    ranks = chat_tree.vocabulary(spark, RANKS)
    nodes, leaves = chat_tree.forest(spark.createDataFrame([], TURNS), ranks)
    assert nodes.count() == 0 and chat_tree.read_back(nodes, leaves, ranks).count() == 0
