"""Parity with the sentencepiece library, round trips and hand-made models."""

import random
import struct

import pytest
import sentencepiece

from tripleweave.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", None, " ", "a", "  two  spaces", "é日本語🎉\x00", "<s> </s> <0x0A>", "a\n\tb" * 50, "x" * 500, "word " * 3000]


def test_ids_are_those_of_sentencepiece(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "b"), (3, "a")], "doc_id bigint, text string")
    found = pieces.encode(docs.selectExpr("*", "'x' AS ids"), MODEL)
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == reference.encode(text) and r.parity and r.round_trip
        assert r.n_bytes_as_pieces == sum(reference.is_byte(i) for i in r.ids)
    back = {r.doc_id: r.text for r in pieces.decode(found, MODEL).collect()}
    assert back == {None: "b"} | {i: t or "" for i, t in enumerate(TEXTS)}
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def _codec():
    raw = open(MODEL, "rb").read()
    model = pieces.parse(raw)
    return pieces.Codec(model, pieces.build(model).to_str()), sentencepiece.SentencePieceProcessor(model_proto=raw)


def test_parity_by_word_is_parity_of_the_text():
    codec, reference = _codec()
    rng = random.Random(1)
    parts = [" ", "  ", "a", "word", "\u2581", "<s>", "<unk>", "<0x0A>", "\n", "\t", "\x00", "é", "日本", "🎉", "\u0301", "x" * 60, "\u00a0", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    ids, back, parity = codec.encode(texts, reference)
    assert parity == [reference.encode(t) == own for t, own in zip(texts, ids)]
    assert back == codec.whole.decode_batch([reference.encode(t) for t in texts], skip_special_tokens=False)


def test_wrong_ids_are_noticed():
    codec, reference = _codec()

    class Swapped:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **kw):
            return [type("E", (), {"ids": e.ids[::-1]}) for e in self.inner.encode_batch_fast(texts, **kw)]

        def decode_batch(self, *args, **kw):
            return self.inner.decode_batch(*args, **kw)

    codec.words = Swapped(codec.words)
    text = "Unquestionably incomprehensible"
    ids, back, parity = codec.encode([text, ""], reference)
    assert back[0] != text and parity == [False, True] and back[1] == ""


def _field(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 127 | 128 if number > 15 else number << 3, *([number >> 4] if number > 15 else []), value])
    tag = number << 3 | (5 if isinstance(value, float) else 2)
    body = struct.pack("<f", value) if isinstance(value, float) else bytes([len(value)]) + value
    return bytes([tag]) + body


def unigram(byte_fallback):
    own = [("<unk>", 0.0, 2)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else [])
    own += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -3.5), ("b", -3.6), ("ab", -4.0), ("▁ab", -4.2), ("ba", -5.0), ("é", -6.0)]]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in own)
    out += _field(2, _field(3, 1) + _field(35, int(byte_fallback)))
    return out + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models(byte_fallback):
    raw = unigram(byte_fallback)
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = pieces.build(pieces.parse(raw))
    for text in ["", "ab", "abba  ab", " b a ", "éa", "zzé" if byte_fallback else "z", "ba" * 40]:
        assert own.encode(text).ids == reference.encode(text), text


def test_broken_models_are_refused():
    with pytest.raises((ValueError, IndexError)):
        pieces.parse(open(MODEL, "rb").read()[:1000])


def test_parts_that_no_piece_joins_are_learned_once():
    codec, reference = _codec()
    texts = ["alpha, beta.\nGamma", "alpha. beta,\nGamma!", "", "Gamma\n\n" + "beta " * 90_000 + "日本", "\U0001f389alpha"]
    ids, back, parity = codec.encode(texts, reference)
    assert ids == [reference.encode(t) for t in texts] and back == texts and all(parity)
    assert "Gamma" in codec.known and not any(c in w[1:] for w in codec.known for c in ",.!\n")
    assert len(codec.known) < 20


def test_shared_kinds_of_characters_change_no_ids(monkeypatch):
    monkeypatch.setattr(pieces, "KINDS", 16)
    monkeypatch.setattr(pieces, "KNOWN", 5)
    codec, reference = _codec()
    for text in ["Mixed, words. été 日本 12345\n", "  other\twords, then ", "Mixed again\x00"]:
        assert codec.encode([text, "a"], reference) == ([reference.encode(text), reference.encode("a")], [text, "a"], [True, True])
