"""Fingerprints against their definition, links and components against all pairs."""

import random

import xxhash

from tripleweave.llm import simhash


def plain_fingerprint(text):
    raw = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    names = sorted(fps, key=lambda d: d)
    root = {d: d for d in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in names}


def test_masks_cover_every_small_difference():
    for bits in (list(range(64)), list(range(0, 64, 2))):
        tables = simhash.masks(bits)
        rng = random.Random(3)
        for _ in range(3000):
            difference = sum(1 << b for b in rng.sample(bits, rng.randint(0, 3)))
            assert any(not difference & m for m in tables)


def test_fingerprints_follow_the_definition(spark):
    rng = random.Random(4)
    texts = ["", None, "  ", "A", "a B", "Ünï cÖde  Straße\tx\x0b y", "a b c a b c a b c " * 300]
    texts += [" ".join(rng.choice("abcdE") for _ in range(rng.randint(0, 700))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(5)
    fps = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << b
            fps[fp] = fps.get(fp, len(fps))
    by_id = {i: fp for fp, i in fps.items()}
    classes = spark.createDataFrame([(simhash._signed(fp), i) for fp, i in fps.items()], "fp bigint, rep bigint")
    for bucket in (simhash.BUCKET, 3):
        edges = simhash.links(classes, bucket=bucket)
        found = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {i: found.get(i, i) for i in by_id} == plain_components(by_id)


def test_near_duplicates_of_documents(spark):
    rng = random.Random(6)
    base = [[rng.choice(["w%d" % i for i in range(50)]) for _ in range(400)] for _ in range(6)]
    docs = []
    for words in base:
        for k in range(5):
            near = list(words)
            for _ in range(k):
                near[rng.randrange(len(near))] = "new"
            docs.append((len(docs) + 1, " ".join(near), "x"))
    docs += [(90, None, None), (91, "", None), (None, docs[0][1], None), docs[3], (None, "nobody else", "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, fp string")
    found = simhash.near_duplicates(frame).collect()
    want = plain_components({d: plain_fingerprint(t) for d, t, _ in docs if d is not None})
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == sorted(
        (d, want[d]) for d, _, _ in docs if d is not None
    )
    assert sorted((r.component_id for r in found if r.doc_id is None), key=str) == [1, None]
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {None, *want.values()}
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
