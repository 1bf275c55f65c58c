"""Alignment of two tokenizers' tokens: a label for each byte, spans between common ends by regex, pair counts over the corpus.

A is a byte-level BPE (tokenizers file) that encodes space + text, B a piece model with byte fallback (sentencepiece file) that encodes
text and adds the space itself; their tokens spell the same bytes. Each byte is labelled none, A-end, B-end or both; a regex takes the label string
apart after each both-label, and the labels in a span count its group's tokens. At a both-label the A and the B token that end there are linked.

Texts are cut before a lone space between two characters that aren't white space. A's pre-tokens end there, and no piece of B has its
space anywhere but in front (checked), so both tokenizers give the same tokens for the parts as for the whole, and a group ends. Equal parts are encoded
once while they are remembered. A text with a part whose bytes differ is encoded again as a whole, and decides as a whole.

A text's links are kept as distinct pairs and how often it holds each, written once in the shared folder. Their sums over the corpus are a
table of vocabulary pairs; a small one (MOST_PAIRS) is broadcast to the texts' pairs, a larger one is joined by pair.

Cases: null and empty texts, and texts whose bytes differ, have no tokens: zeros, and '' for the groups; strings of special tokens are plain
text; rows without or with repeated doc_id each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_characters
from .counts import pieces

MEMORY = 96 << 20  # bytes of remembered parts, their overhead included: those met lately, and those met before them
PART_BYTES = 1 << 14  # characters of new parts that are encoded together
_PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)
MOST_PAIRS = 2_000_000
_BOTH = 1 << 32
_B_IDS = 1 << 20  # a pair's code is a * _B_IDS + b
_SPAN = re.compile(rb"[0-2]*3")  # labels: 0 none, 1 A-end, 2 B-end, 3 both


class Aligner:
    """Encodes parts by both tokenizers and groups their tokens."""

    def __init__(self, a_model: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b_model)
        back = {c: i for i, c in enumerate(byte_characters())}
        self.a_bytes: dict[int, bytes] = {}
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(back[c] for c in piece)
        self.b_bytes = [self._piece(i) for i in range(self.b.GetPieceSize())]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array(list(map(len, self.b_bytes)))
        ids = range(max(len(self.a_size), len(self.b_size)))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{sign}" for i in ids], object) for sign in ",|;")
        if any(b" " in p.lstrip(b" ") for p in self.b_bytes):
            raise ValueError("a piece of the second tokenizer has a space after another character")
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.held = 0

    def _piece(self, i: int) -> bytes:
        piece = self.b.IdToPiece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.IsByte(i) else piece.replace("▁", " ").encode()

    def _grouped(self, raw: bytes, a: list[int], b: list[int], ends: np.ndarray) -> list[tuple] | None:
        """(groups as text, pair codes, n_a * 2^32 + n_b) of the parts of raw that end at `ends`; None unless both tokenizers spell raw and end where parts do."""
        xs, ys = np.array(a, np.int64), np.array(b, np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        label = np.zeros(len(raw), np.uint8)
        label[np.cumsum(self.a_size[xs]) - 1] = 1
        label[np.cumsum(self.b_size[ys]) - 1] |= 2
        if not (label[ends - 1] == 3).all():
            return None
        end = np.cumsum(np.array(list(map(len, _SPAN.findall((label + ord("0")).tobytes()))), np.int64))
        to_a, to_b = (np.cumsum((label & mark) > 0)[end - 1] for mark in (1, 2))  # labels up to the end of each span
        of_a, of_b = (np.diff(x, prepend=0) for x in (to_a, to_b))  # tokens of each group
        pairs = xs[to_a - 1] * _B_IDS + ys[to_b - 1]
        shown = np.empty(len(xs) + len(ys), object)  # each group's A tokens, then its B tokens
        at_a, at_b = np.arange(len(xs)) + np.repeat(to_b - of_b, of_a), np.arange(len(ys)) + np.repeat(to_a, of_b)
        shown[at_a], shown[at_b] = self.comma[xs], self.comma[ys]
        shown[at_a[to_a - 1]], shown[at_b[to_b - 1]] = self.bar[xs[to_a - 1]], self.semicolon[ys[to_b - 1]]
        groups = np.searchsorted(end, ends) + 1  # groups up to the end of each part
        n_a, n_b = (np.diff(x[groups - 1], prepend=0) for x in (to_a, to_b))
        words, z, first = shown.tolist(), (to_a + to_b)[groups - 1].tolist(), 0
        out, low = [], 0
        codes = pairs.tobytes()
        for g, t, n in zip(groups.tolist(), z, (n_a * _BOTH + n_b).tolist(), strict=True):
            out.append(("".join(words[first:t]), codes[8 * low : 8 * g], n))
            first, low = t, g
        return out

    def alone(self, part: str) -> tuple | None:
        """As _grouped, of one part, which begins with the space that B adds."""
        raw = part.encode()
        got = self._grouped(raw, self.a.encode(part, add_special_tokens=False).ids, self.b.encode(part[1:]), np.array([len(raw)]))
        return got[0] if got else None

    def learn(self, texts: list[list[str]]) -> None:
        """Remembers the parts of all texts; once there are too many, those that haven't been met since the last time are forgotten."""
        if self.held > MEMORY // 2:
            self.before, self.known, self.held = self.known, {}, 0
        new = set().union(*texts).difference(self.known)
        again = new.intersection(self.before)
        self._remember(again, map(self.before.__getitem__, again))
        todo, size = [], 0
        for part in new - again:
            if not _PLAIN.fullmatch(part):
                self._remember([part], [self.alone(part)])
                continue
            todo.append(part)
            size += len(part)
            if size >= PART_BYTES:
                self._together(todo)
                todo, size = [], 0
        if todo:
            self._together(todo)

    def _together(self, parts: list[str]) -> None:
        """Plain parts one after the other are a text that is cut into them again, so they are encoded as one."""
        text = "".join(parts)
        raw = text.encode()
        ends = np.cumsum(list(map(len, parts)) if len(raw) == len(text) else [len(p.encode()) for p in parts])
        got = self._grouped(raw, self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]), ends)
        self._remember(parts, got or map(self.alone, parts))

    def _remember(self, parts: Iterable[str], found: Iterable[tuple | None]) -> None:
        for part, got in zip(parts, found, strict=True):
            self.known[part] = got
            self.held += 350 + 2 * len(part) + (len(got[0]) + len(got[1]) if got else 0)

    def text(self, parts: list[str]) -> tuple | None:
        """(groups as text, pair codes, n_a * 2^32 + n_b) of the text that the parts make, None where either tokenizer's bytes differ from it."""
        each = list(map(self.known.__getitem__, parts))
        if None in each:
            return self.alone("".join(parts))
        shown, pairs, n = zip(*each, strict=True)
        return "".join(shown), b"".join(pairs), sum(n)


@lru_cache(maxsize=1)
def _aligner(a_model: str, b_model: bytes) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(a_model, b_model)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`, null without tokens), links: array<struct<pair, n>>, each distinct pair (a id * 2^20
    + b id) of tokens that end together and how often the text holds it."""
    with open(a_path, encoding="utf-8") as f:
        a_model = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    kind = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<pair:long,n:long>>"
    link = pa.struct([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in common.slices(batches):
            aligner = _aligner(a_model, b_model)
            cut = [pieces(" " + text) if text else [] for text in b.column(1).to_pylist()]
            aligner.learn(cut)
            n_a, n_b, n_groups, groups, codes, times = [], [], [], [], [], []
            for parts in cut:
                shown, pairs, n = parts and aligner.text(parts) or (None, b"", 0)
                distinct, often = np.unique(np.frombuffer(pairs, np.int64), return_counts=True)
                for column, value in ((n_a, n // _BOTH), (n_b, n % _BOTH), (n_groups, len(pairs) // 8), (groups, shown and shown[:-1]), (codes, distinct), (times, often)):
                    column.append(value)
            at = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32))
            links = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (codes, times)], fields=list(link)))
            cols = [b.column(0), *[pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups)], pa.array(groups, pa.string()), links]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return common.arrow_map(common.texts(docs, id_col, text_col), run, kind)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (over all links), best (no other pair of its B id has a higher count); links: pair, n."""
    counted = links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % _B_IDS)
    counted = common.written(counted, "pair-counts")  # as many rows as pairs of the two vocabularies occur
    top = counted.groupBy("b").agg(F.max("count").alias("top"))
    return counted.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def report(found: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; found: rows of align."""
    digest = F.when(F.col("groups").isNull(), "").otherwise(F.sha2("groups", 256))
    kept = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), digest.alias("groups_sha256"), "links")
    kept = common.written(kept, "alignments")
    links = kept.select("row", F.inline("links"))
    counts = common.written(pair_counts(links), "pairs")
    counts = F.broadcast(counts) if counts.count() <= most_pairs else counts
    of = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return kept.drop("links").join(of, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
