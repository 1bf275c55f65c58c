"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from a rank vocabulary.

Each vocabulary entry becomes a piece: its bytes mapped to printable characters, scored by its negative rank, with
identity normalisation. Sentencepiece merges the best-scored neighbours first, leftmost on ties, which is the order of
ranks. Pre-tokens come from the vocabulary's pattern; a pre-token that is an entry is taken whole, as the rank library
does. Where that library's Unicode version puts a code point into another class of the pattern than ours, a stand-in of the right class
takes its place while the pattern is matched. Decoding maps ids to pieces and characters back to bytes.

Cases: null text and empty text give no ids and the hash of no bytes; null ids stay; repeated rows each give a row;
an empty table gives an empty result; other columns are ignored. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MEMORY = 48 << 20  # bytes of remembered pre-tokens, their overhead included


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece i is the i-th entry by rank; after the last comes the unknown piece."""
    chars = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    size = len(ranks) + 1
    trainer = _field(3, 2) + _field(4, size) + _field(40, size - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normal))


def stand_ins(pattern: str, step: int = 1 << 15) -> dict[int, str]:
    """For each code point that the rank library and our pattern engine put into different classes of the pattern, one that both
    put where the rank library puts it. Code points are tried `step` at a time."""
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    names = sorted(set(re.findall(r"\\[pP]\{\^?\w+\}|\\[sSdDwW]", pattern)))
    engines = [(tiktoken.Encoding("class", pat_str=n, mergeable_ranks=single, special_tokens={}), regex.compile(n)) for n in names]
    usual: dict[tuple[bool, ...], str] = {}
    odd: dict[int, tuple[bool, ...]] = {}
    for a in range(0, 0x110000, step):
        every = "".join(chr(c) for c in range(a, a + step) if not 0xD800 <= c < 0xE000)
        theirs = [set(e.decode(e.encode_ordinary(every))) for e, _ in engines]
        ours = [set(p.findall(every)) for _, p in engines]
        differ = set().union(*(x ^ y for x, y in zip(theirs, ours, strict=True)))
        odd |= {ord(c): tuple(c in x for x in theirs) for c in differ}
        if a < 0x3100:  # beyond ASCII, so that no sign that the pattern names is taken
            for c in every[0xA0 if a == 0 else 0 : max(0, 0x3100 - a)]:
                if c not in differ:
                    usual.setdefault(tuple(c in x for x in ours), c)
    return {c: usual[kind] for c, kind in odd.items()}


class Codec:
    """Encodes texts to ids as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, model: bytes, ids: np.ndarray, pattern: str, odd: dict[int, str] | None = None):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model)
        self.pattern, self.odd = regex.compile(pattern), odd or {}
        self.odd_set = set(map(chr, self.odd))
        self.beyond = re.compile(f"[{chr(min(self.odd, default=0x10FFFF))}-\U0010ffff]").search
        chars = byte_characters()
        self.char = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        pieces = [bytes(back[c] for c in self.sp.IdToPiece(i)) for i in range(len(ids))]
        self.bytes_of = dict(zip(ids.tolist(), pieces, strict=True))
        self.whole = {p: struct.pack("<I", i) for i, p in self.bytes_of.items()}
        self.ids = ids.astype("<u4")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        rest, shown = [], []
        for w in words:
            raw = w.encode()
            if (one := self.whole.get(raw)) is not None:
                self.known[w] = one
                self.held += 120 + len(raw)
            else:
                rest.append(w)
                shown.append(raw.decode("latin-1").translate(self.char))
        for w, got in zip(rest, self.sp.encode(shown, num_threads=1) if shown else [], strict=True):
            self.known[w] = self.ids[got].tobytes()
            self.held += 200 + 4 * len(w) + 4 * len(got)

    def encode(self, text: str) -> bytes:
        if text.isascii() or not self.beyond(text) or self.odd_set.isdisjoint(text):
            words = self.pattern.findall(text)
        else:
            words = [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        if missing := list(set(words).difference(self.known)):
            self.learn(missing)
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked for, ids (array of long).

    The model is built once on the driver and travels with the task: its size is that of the vocabulary file.
    """
    ranks = read_ranks(path)
    model, ids, odd = serialise(ranks), np.array(sorted(ranks.values()), "<u4"), stand_ins(pattern)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in common.slices(batches):
            codec = codec or Codec(model, ids, pattern, odd)
            n, sha, back, same, kept = [], [], [], [], []
            for text in b.column(1).to_pylist():
                got = codec.encode(text)
                raw = codec.decode(got)
                n.append(len(got) // 4)
                sha.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == text.encode())
                if keep_ids:
                    kept.append(np.frombuffer(got, "<u4").astype(np.int64))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(same)]
            if keep_ids:
                flat = np.concatenate(kept)
                at = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"][: len(cols)])

    return common.arrow_map(common.texts(docs, id_col, text_col), run, kind)
