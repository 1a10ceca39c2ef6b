"""Hits, items and cleaned texts against a search for every window."""

import random
import re

from tripleweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id bigint, text string, n_chars bigint, hit string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        parts = words(item_text)
        if not parts:
            continue
        size = min(window, len(parts))
        wanted = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(item)
    return len(own), len(hit), sorted(found)


def cases(rng, n):
    vocabulary = ["a", "b", "C", "é", "x1"]
    say = lambda k: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([0, 1, 2, 4, 6, 9]))) for i in range(12)]
    items += [(3, say(5)), (None, say(5)), (20, None), (21, "  "), (22, items[4][1])]
    docs = [(i, say(rng.randint(0, 30)), 0, "x") for i in range(n)]
    return docs + [(None, "a b c", 0, None), (900, None, 0, ""), (901, "", 0, ""), docs[0], (902, say(3000), 0, "")], items


def test_scan_finds_what_a_search_finds(spark, monkeypatch):
    rng = random.Random(1)
    for block in (100_000, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        docs, items = cases(rng, 150)
        frame = spark.createDataFrame(docs, DOC)
        found = decontaminate.scan(frame, spark.createDataFrame(items, "item_id bigint, text string"), window=4)
        got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found.collect())
        want = sorted((d[0] or -1, *brute(d[1], items, 4)) for d in docs)
        assert got == want


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 6)
    rng = random.Random(2)
    docs, items = cases(rng, 80)
    items.append((50, " ".join(rng.choice("ab") for _ in range(100))))
    found = decontaminate.scan(
        spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, text string"), window=4
    )
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((d[0] or -1, *brute(d[1], items, 4)) for d in docs)


def test_clean_cuts_spans_and_drops_covered_texts(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    docs = [
        (1, "keep this. One, two THREE four! and that é", 5, "x"),
        (2, "one two three four five", 5, "x"),
        (3, "nothing here", 5, None),
        (4, None, None, None),
    ]
    out = decontaminate.clean(spark.createDataFrame(docs, DOC), items, window=3)
    assert sorted(out.collect()) == [
        (1, "keep this. ! and that é", 23, "x"),
        (3, "nothing here", 12, None),
        (4, None, None, None),
    ]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(none, items).count() == 0
    one = spark.createDataFrame([(1, "a b", 3, "")], DOC)
    assert decontaminate.scan(one, items).first().n_hit == 0
    assert decontaminate.clean(one, items).collect() == one.collect()
