"""The pipeline on planted cases, stage by stage, and against brute force for what plain search can tell."""

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tripleweave.llm import toxicity

CLEAN = "fresh words about rivers and hills number {i} " + "that nobody else has written on page {i} of book {i} "


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    kept = [r for r in base.to_pylist()]
    n = max(r["doc_id"] for r in kept) + 1
    passage = "This passage of more than fifty bytes is found in several of the planted documents, "
    item = "a question that only the benchmark should ever ask of any model at all"
    extra = [
        ("copy", kept[3]["text"]),
        ("near", kept[5]["text"] + " end"),  # two bits from the text itself
        ("first", CLEAN.format(i=1) + passage),
        ("second", passage + CLEAN.format(i=2)),
        ("leak", CLEAN.format(i=3) + item + " and more words follow"),
        ("only", item),
        ("clean", CLEAN.format(i=4)),
        ("null", None),
        ("blank", ""),
    ]
    ids = {name: n + i for i, (name, _) in enumerate(extra)}
    rows = kept + [{"doc_id": ids[k], "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for k, t in extra]
    pq.write_table(pa.Table.from_pylist(rows, base.schema), folder / "documents.parquet")
    bench = pq.read_table("/root/testdata/sf0.001/benchmark.parquet")
    more = pa.Table.from_pylist([{"item_id": 999, "text": item}], bench.schema)
    pq.write_table(pa.concat_tables([bench, more]), folder / "benchmark.parquet")
    pq.write_table(pq.read_table("/root/testdata/sf0.01/labels.parquet"), folder / "labels.parquet")
    return str(folder), ids, passage, item


def test_stages(spark, planted, monkeypatch):
    folder, ids, passage, item = planted
    monkeypatch.setattr(toxicity, "MAX_EPOCHS", 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(out.collect(), out.schema)
        tables.append({r.doc_id: r for r in docs.collect()})
    toxic, near, cut, clean, encoded = tables
    assert set(toxic) >= set(near) >= set(cut) >= set(clean) == set(encoded)
    if {3, 5} <= set(toxic):
        assert ids["copy"] not in near and ids["near"] not in near
    assert ids["clean"] in encoded and clean[ids["clean"]].text == CLEAN.format(i=4)
    assert passage in cut[ids["first"]].text and passage not in cut[ids["second"]].text
    assert item not in clean[ids["leak"]].text and "and more words follow" in clean[ids["leak"]].text
    assert ids["only"] not in clean
    for r in clean.values():
        assert r.n_chars == len(r.text or "") or r.text is None
    seen = {}
    for d in sorted(cut):
        raw = (near[d].text or "").encode()
        left = (cut[d].text or "").encode()
        repeats = [s for i in range(len(raw) - 49) if seen.get(s := raw[i : i + 50], d) < d]
        assert (left == raw) == (not repeats)
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], d)
    assert all(r.parity and r.round_trip for r in encoded.values())


def test_run_is_the_stages(spark, planted, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_EPOCHS", 2)
    found = corpus_pipeline.run(spark, planted[0])
    assert {"doc_id", "ids"} <= set(found.columns) and found.count() > 0
