"""Near copies against all pairs of five-word shingle sets, and the pipeline's stage."""

import random

import corpus_pipeline
import pyarrow.parquet as pq

from tripleweave.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    sets, root = {d: plain_set(t) for d, t in docs}, {d: d for d, _ in docs}
    for i, a in enumerate(sorted(sets)):
        for b in sorted(sets)[:i]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_all_pairs_at_the_least_similarity_and_below(spark):
    rng = random.Random(8)
    docs = []
    for n in (60, 100, 100, 200, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(7):
            near = list(base)
            for _ in range(k * n // 100):
                near[rng.randrange(n)] = f"n{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(near)))
    # A crowded bucket in which a passage is shared, but few are near copies.
    passage = [f"p{i}" for i in range(100)]
    docs += [(100 + i, " ".join(passage + [f"o{i // 2}x{k}" for k in range(35)] + ["end"] * (i % 2))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "few words"), (203, "Few  WORDS"), (204, "other words")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(None, docs[0][1], "x")], "doc_id bigint, text string, lang string")
    want = plain_components(docs)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect() if r.doc_id is not None} == want
    kept = near_copies.deduplicate(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {None, *want.values()}
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_stage_drops_a_copy_with_one_word_more_or_changed(spark):
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    text = base[3]["text"]
    words = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text), (2, text + " end"), (3, words), (4, words.replace("word50", "changed")), (5, "something else entirely")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def test_stage_links_by_fingerprint_too(spark, monkeypatch):
    """Texts within three bits of each other but below 0.8 are one group, and links of both kinds are followed."""
    words = [f"word{i}" for i in range(100)]
    changed = words[:50] + ["changed"] + words[51:]
    rows = [(1, "a b c d e f g h"), (2, " ".join(words)), (3, " ".join(changed)), (4, "nothing like the others"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = spark.createDataFrame([(1, 7, 1), (3, 5, 1), (2, 99, 2), (4, 98, 4), (None, 97, None)], "doc_id bigint, fp bigint, component_id bigint")
    assert sorted(r.doc_id or 0 for r in near_copies.deduplicate(docs).collect()) == [0, 1, 2, 4]
    monkeypatch.setattr(near_copies.simhash, "near_duplicates", lambda *a: marked)
    assert sorted(r.doc_id or 0 for r in near_copies.deduplicate(docs).collect()) == [0, 1, 4]
