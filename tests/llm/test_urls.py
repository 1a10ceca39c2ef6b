"""Hosts, paths, rules, templates and verdicts of hand-made urls."""

from tripleweave.llm import urls

PAGES = "page_id bigint, url string, host string"


def judged(spark, rows, labels=()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], PAGES)
    marks = spark.createDataFrame(list(labels), "page_id bigint, good boolean")
    return {r.page_id: r for r in urls.judge(pages, marks).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x=/y#z"),
        (2, "https://example.com/en/"),
        (3, "https://a.example.com/en"),
        (4, "x://b.net/es/1"),
        (5, "x://net/fr/"),
        (6, "x://bnet/fr/"),
        (7, "no scheme"),
        (8, None),
        (9, "h://a.com"),
        (10, "h://a.com?q=://b.net/es/"),
        (11, "h://É.COM/a b"),
    ]
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in judged(spark, rows).items()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("example.com", "/en/", "example.com/en/", "block"),
        3: ("a.example.com", "/en", "com/", "allow"),
        4: ("b.net", "/es/1", "net/es/", "block"),
        5: ("net", "/fr/", "net/fr/", "block"),
        6: ("bnet", "/fr/", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("a.com", "", None, "allow"),
        10: ("a.com", "", None, "allow"),
        11: ("É.com", "/a b", "com/", "allow"),
    }


def test_bad_templates_are_rejected_and_only_they(spark):
    rows, labels = [], []
    for i in range(600):
        branch = ("spam", "news")[i % 2]
        rows.append((i, f"http://h.org/{branch}/{i}.html"))
        if i < 400:
            labels.append((i, branch == "news"))
    rows += [(1000 + i, f"http://h.org/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(120)]
    got = judged(spark, rows, labels)
    assert {got[i].verdict for i in range(0, 600, 2)} == {"block"}
    assert {got[i].verdict for i in range(1, 600, 2)} | {got[1000 + i].verdict for i in range(120)} == {"allow"}


def test_varying_segments_become_wildcards(spark):
    shapes = [("h", f"tag/n{chr(97 + i % 26)}{chr(97 + i // 26)}/x", 1) for i in range(100)] + [("h", "en/<n>", 50), ("h", "", 1)]
    frame = spark.createDataFrame(shapes, "host string, shape string, n bigint")
    found = {tuple(r.template) for r in urls.templates(frame).collect()}
    assert found == {("tag", "*", "x"), ("en", "<n>"), ("",)}


def test_empty_tables(spark):
    assert judged(spark, []) == {}


def test_wildcards_are_made_from_the_root_down(spark):
    names = [f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    # Every name has only a few slugs; together, below one wildcard, they vary.
    shapes = [("h", f"u/{name}/{name}{k}x/edit", 1) for name in names for k in "ab"] + [("h", "u", 5), ("g", "u/a/b", 1)]
    schema = "host string, shape string, n bigint"
    found = {tuple(r.template) for r in urls.templates(spark.createDataFrame(shapes, schema)).collect()}
    assert found == {("u", "*", "*", "edit"), ("u",), ("u", "a", "b")}
    often = [(h, shape, 1000 * n) for h, shape, n in shapes]
    assert found == {tuple(r.template) for r in urls.templates(spark.createDataFrame(often, schema)).collect()}
    common = [*shapes, ("h", "u/common/x/edit", 60)]
    assert ("u", "common", "x", "edit") in {
        tuple(r.template) for r in urls.templates(spark.createDataFrame(common, schema)).collect()
    }


def test_the_limit_follows_labels_held_back(spark):
    rows, labels = [], []
    for i in range(2000):
        branch = ("a", "b", "c")[i % 3]
        rows.append((i, f"http://h.org/{branch}/{i}"))
        labels.append((i, i % 10 < {"a": 9, "b": 8, "c": 3}[branch]))
    got = judged(spark, rows, labels)
    assert [got[i].verdict for i in range(3)] == ["allow", "allow", "block"]
    good = judged(spark, rows, [(i, True) for i, _ in rows])
    assert {r.verdict for r in good.values()} == {"allow"}


def test_no_ids_repeated_rows_and_very_long_paths(spark):
    deep = "http://h.org/" + "/".join(f"s{i}" for i in range(100_000))
    rows = [(None, "http://h.org/a/1"), (None, "http://h.org/a/1"), (7, deep), (7, deep)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], PAGES)
    marks = spark.createDataFrame([(7, False), (None, False)], "page_id bigint, good boolean")
    found = urls.judge(pages, marks).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in found) == [(0, "h.org", "allow")] * 2 + [(7, "h.org", "allow")] * 2
    assert [r.path for r in found if r.page_id == 7] == [deep.removeprefix("http://h.org")] * 2
