"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read field by field; from it a tokenizer is built anew: the normaliser, the marker
for spaces, the scores (unigram) or the merges that scores imply (byte-pair), and bytes for characters
without a piece. Texts are encoded in batches over several threads, and each text's ids are compared with
those of the sentencepiece library over the same model. Where no piece of a model goes on after the end of a
word, a word has the same ids in any text, and in a byte-pair model so has what lies between two places where no piece has the
two characters next to each other, as no merge can cross them: then the different parts of a task are encoded and decoded once,
up to ``KNOWN`` at a time, and compared with sentencepiece once where the model leaves texts as they are. A decoded
text is joined from what the ids of its parts stand for, never from the text.

Defined cases: a null or empty text has no ids and counts as equal. Repeated rows are encoded one by one,
null ids pass through, other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.arrow import map_batches, slices

# Fixed values of the format: the space marker, kinds of pieces and of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
SLICE = 1 << 19
THREADS = 2
KNOWN = 200_000
#: Numbers for characters that pieces join; with more characters than these some parts are longer than needed.
KINDS = 2048
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message, unparsed where they are not varints."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield number, value
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size, at = _varint(data, at)
        if at + size > len(data):
            raise ValueError("a model file ends within a field")
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_spaces: bool = True
    suffix_marks: bool = False


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.suffix_marks = bool(trainer.get(24, 0))
        elif number == 3:
            norm = dict(fields(value))
            model.charsmap = norm.get(2, b"")
            model.dummy_prefix = bool(norm.get(3, 1))
            model.squeeze = bool(norm.get(4, 1))
            model.mark_spaces = bool(norm.get(5, 1))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join into a piece, the best result first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            if piece[:k] in ids and piece[k:] in ids:
                found.append((-model.pieces[i][1], i, k, piece[:k], piece[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def by_word(model: Model) -> bool:
    """Whether words can be encoded one by one: no piece crosses a word's end, none is cut out beforehand."""
    used = [(p, kind) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)]
    return not any(kind == USER_DEFINED or MARK in p.lstrip(MARK) for p, kind in used)


def build(model: Model):
    """A tokenizer of the tokenizers library that does what the model says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_marks or not model.mark_spaces:
        raise ValueError("only models that mark spaces, in front of words, are supported")
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        inner = models.Unigram([p[:2] for p in model.pieces], unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        name = None if unknown is None else model.pieces[unknown][0]
        inner = models.BPE(vocabulary, merges(model), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is not supported")
    tokenizer = Tokenizer(inner)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if by_word(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    ending = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ending])
    return tokenizer


class Codec:
    """Encodes and decodes texts; parts that no piece joins once each where the model allows it."""

    def __init__(self, model: Model, description: str):
        from tokenizers import Tokenizer, decoders, normalizers

        self.description = description
        self.words = Tokenizer.from_str(description) if by_word(model) else None
        self.prefix = MARK if model.dummy_prefix else ""
        self.plain = not model.charsmap and not model.squeeze
        self.known: dict[str, int] = {}  # places of known parts in the three columns below
        self.ids = pa.array([], pa.list_(pa.int32()))
        self.told = pa.array([], pa.string())  # what the ids of known parts decode to
        self.right = np.zeros(0, bool)  # whether sentencepiece has the same ids
        if self.words is not None:
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = None
            self.words.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
            # Pieces that are characters stand for themselves; parts with other pieces go through the decoder.
            self.names = pa.array([p.replace(MARK, " ") if kind == NORMAL else "" for p, _, kind in model.pieces])
            self.named = np.array([kind == NORMAL and p != "" for p, _, kind in model.pieces])
            # Unknown characters next to each other are one piece, unless they become bytes.
            self.bytewise = model.byte_fallback and sum(kind == BYTE for _, _, kind in model.pieces) == 256
            self._find_joints(model)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.description)

    def _find_joints(self, model: Model) -> None:
        """Which characters stand next to each other in a piece, by kind; kinds beyond ``KINDS`` share numbers."""
        fine = self.bytewise and model.kind == BPE
        pairs = {p[i : i + 2] for p, _, kind in model.pieces if kind not in (UNKNOWN, CONTROL, BYTE) for i in range(len(p) - 1)}
        chars = sorted({c for pair in pairs for c in pair} - {MARK})
        number = {MARK: 1} | {c: 2 + i % (KINDS - 2) for i, c in enumerate(chars)}
        self.kinds = np.zeros(0x110000, np.uint16)
        self.kinds[[ord(c) for c in number]] = list(number.values())
        self.joined = np.full((KINDS, KINDS), not fine)
        if fine:
            self.joined[[number[x] for x, _ in pairs], [number[y] for _, y in pairs]] = True
        else:
            self.joined[:, 1] = False
            self.joined[1, 1] = True
        # A character that joins with none, to put before parts that are given to sentencepiece.
        self.lead = next(c for c in map(chr, range(0x110000)) if c not in number)

    def _normal(self, text: str) -> str:
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        return self.prefix + text.replace(" ", MARK) if text else ""

    def _parts(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of normal texts, one after the other, and the bounds of each text's own."""
        line = "".join(texts)
        starts, size = [], 0
        ends = np.cumsum([0] + [len(t) for t in texts])
        for at in range(0, len(line), SLICE):
            # One character more on either side tells whether the outer ones are joined.
            chars = np.frombuffer(line[max(at - 1, 0) : at + SLICE].encode("utf-32-le"), np.uint32)
            kinds = self.kinds[chars]
            new = np.concatenate([np.ones(int(at == 0), bool), ~self.joined[kinds[:-1], kinds[1:]]])
            chars = chars[len(chars) - len(new) :]
            new[ends[(ends >= at) & (ends < at + len(new))] - at] = True
            widths = np.ones(len(chars), np.int32)
            for least in (0x80, 0x800, 0x10000):
                widths += chars >= least
            before = np.cumsum(widths)
            starts.append(size + (before - widths)[new])
            size += int(before[-1])
        data = line.encode()
        offsets = np.concatenate([*starts, [size]]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        bytes_before = np.cumsum([0] + [len(t.encode()) for t in texts])
        return parts, np.searchsorted(offsets, bytes_before)

    def columns(self, texts: list[str], reference) -> tuple[pa.ListArray, list[str], list[bool]]:
        """Ids of texts, the texts that the ids decode to, and whether the ids are those of ``reference``."""
        if self.words is None:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.whole.decode_batch(ids, skip_special_tokens=False)
            return pa.array(ids, pa.list_(pa.int32())), back, self._same(texts, ids, reference)
        if len(self.known) > KNOWN:
            self.known.clear()
            self.ids, self.told, self.right = self.ids[:0], self.told[:0], self.right[:0]
        # Parts are taken as they are only if the model neither changes characters nor drops spaces.
        whole = not (self.plain and self.prefix and self.bytewise)
        parts, bounds = self._parts([self._normal(t) for t in texts])
        coded = parts.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in different if w not in self.known], None if whole else reference)
        places = np.array([self.known[w] for w in different], np.int64)[coded.indices.to_numpy()]
        found = self.ids.take(pa.array(places))
        ids = pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[bounds]), found.values)
        back = self._joined(self.told.take(pa.array(places)), bounds)
        if whole:
            return ids, back, self._same(texts, ids.to_pylist(), reference)
        wrong = np.r_[0, np.cumsum(~self.right[places])]
        return ids, back, (wrong[bounds[1:]] == wrong[bounds[:-1]]).tolist()

    def encode(self, texts: list[str], reference) -> tuple[list[list[int]], list[str], list[bool]]:
        """The same with ids as lists."""
        ids, back, parity = self.columns(texts, reference)
        return ids.to_pylist(), back, parity

    @staticmethod
    def _same(texts: list[str], ids: list[list[int]], reference) -> list[bool]:
        return [reference.encode(t) == own for t, own in zip(texts, ids)]

    def _learn(self, words: list[str], reference) -> None:
        """Encode new parts, decode their ids and, given a reference, compare the two encodings."""
        if not words:
            return
        found = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        ids = pa.array(found, pa.list_(pa.int32()))
        flat, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
        names = self.names.take(ids.values)
        told = pa.array(_joined_texts(names, bounds), pa.string())
        other = np.add.reduceat(np.r_[~self.named[flat], False], bounds[:-1]).astype(bool)
        other |= bounds[1:] == bounds[:-1]
        if other.any():
            back = self.words.decode_batch([found[i] for i in np.flatnonzero(other)], skip_special_tokens=False)
            told = pc.replace_with_mask(told, pa.array(other), pa.array(back, pa.string()))
        right = np.ones(len(words), bool)
        if reference is not None:
            lead = reference.encode(self.lead)
            theirs = reference.encode([self.lead + w.replace(MARK, " ") for w in words], num_threads=1)
            right = np.array([their == lead + own for their, own in zip(theirs, found)])
        self.known.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.ids = pa.concat_arrays([self.ids, ids])
        self.told = pa.concat_arrays([self.told, told])
        self.right = np.concatenate([self.right, right])

    def _joined(self, told: pa.StringArray, bounds: np.ndarray) -> list[str]:
        texts = _joined_texts(told, bounds)
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.prefix else texts


def _joined_texts(parts: pa.StringArray, bounds: np.ndarray) -> list[str]:
    """Strings next to each other as one, from each bound to the next."""
    if not len(parts):
        return [""] * (len(bounds) - 1)
    offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset)[bounds]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.copy()), parts.buffers()[2]).to_numpy(zero_copy_only=False).tolist()


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS
) -> DataFrame:
    """``(doc_id, ids, n_bytes_as_pieces, round_trip, parity)`` per document.

    ``round_trip``: decoding gives the text back; ``parity``: the ids are those of sentencepiece. The model
    file is read on the driver; model files hold a few MB at most.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    model = parse(raw)
    shared = docs.sparkSession.sparkContext.broadcast((build(model).to_str(), raw))
    is_byte = np.array([kind == BYTE for _, _, kind in model.pieces])

    def run(batches):
        import os

        # Read once, when the worker first encodes; more threads than a task has cores only cost memory.
        os.environ |= {"TOKENIZERS_PARALLELISM": str(threads > 1).lower(), "RAYON_NUM_THREADS": str(threads)}
        import sentencepiece

        description, data = shared.value
        codec = Codec(parse(data), description)
        reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, back, parity = codec.columns(texts, reference)
            n_bytes = np.r_[0, np.cumsum(is_byte[ids.values.to_numpy()])][ids.offsets.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    ids,
                    pa.array(np.diff(n_bytes), pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back)]),
                    pa.array(parity),
                ],
                names=["doc_id", "ids", "n_bytes_as_pieces", "round_trip", "parity"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_bytes_as_pieces bigint, round_trip boolean, parity boolean"
    return map_batches(own, run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids; null or empty ids give an empty text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(build(parse(f.read())).to_str())

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = tokenizer.decode_batch([i or [] for i in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
