"""Rules over sentences, against a plain walk."""

import random

from tripleweave.llm import licenses


def test_notices_and_long_texts(spark):
    grant, keep, as_is = (licenses.SENTENCES[k] for k in ("mit-grant", "mit-keep", "as-is"))
    docs = [
        (1, "Words.\nReleased under the MIT License.", "a"),
        (2, f"Copyright me.\n{grant.upper()}:\n{keep}. {as_is}!", "b"),
        (3, f"{as_is}. {keep}. {grant}.", "c"),
        (4, f"{grant}. 1.\n2.\n3.\n4.\n{keep}. {as_is}", "d"),
        (5, None, None),
        (6, "", ""),
        (None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0. ", ""),
    ]
    found = licenses.recognise(spark.createDataFrame(docs, "doc_id bigint, text string, hits string"))
    got = {r.doc_id: [(x.license, x.first_place, x.n_places) for x in r.licenses] for r in found.collect()}
    assert got == {1: [("MIT", 1, 1)], 2: [("MIT", 1, 1)], 3: [], 4: [], 5: [], 6: [], None: [("CC-BY-NC-4.0", 0, 2)]}
    assert found.limit(0).count() == 0


def test_ordered_rules_with_gaps(spark):
    catalog = {n: n for n in "abc"}
    rules = [("AB", ["a", "b"]), ("ABC", ["a", "b", "c"]), ("CA", ["c", "a"])]
    rng = random.Random(11)
    docs = [(i, "\n".join(rng.choice("abcxy") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for r in licenses.recognise(frame, catalog=catalog, rules=rules, gap=1).collect():
        parts = docs[r.doc_id][1].split("\n")
        want = []
        for name, rule in rules:
            places = []
            for i, p in enumerate(parts):
                at = i if p == rule[0] else None
                for step in rule[1:]:
                    if at is not None:
                        at = next((k for k in range(at + 1, min(at + 3, len(parts))) if parts[k] == step), None)
                if at is not None:
                    places.append(i)
            if places:
                want.append((places[0], name, len(places)))
        assert [tuple(x) for x in r.licenses] == sorted(want)
