"""Language-model scores by a probabilistic suffix tree.

A text is a sequence of symbols: the bytes of its lower-cased words, a space after each word, one end. The tree's contexts are
up to DEPTH symbols long. A context stays if it is frequent enough (a share of all training symbols: LEAST_SHARE up to 10^8 symbols,
then falling with the fifth root of their number, so that the tree grows with the corpus, but more slowly: a share of 2e-7 at 100 TB)
and if its next-symbol distribution diverges from that of its longest proper suffix by GAIN nats over all its occurrences.
Of 2 million symbols about 1 % of the contexts that the share admits stay, 17,000. Distributions are smoothed towards the
shorter context's (Witten-Bell, with ESCAPE times as much weight on it). Contexts are closed under suffixes and prefixes, so the longest
suffix state follows from the last one and the symbol: an automaton, which runs over many segments of texts at once. Bytes too
rare to be in any context share a column of it, their probabilities in proportion to their counts. Segments begin DEPTH symbols
early, so cutting a long text changes nothing.

The base score is that of single words. Word counts are exact and of any size: blocks of documents list their distinct words,
whose counts are added up by word, joined back to the lists and gathered by block. Words of very many blocks get their counts from a
broadcast (they have more than HEAVY blocks and a SHARE of all places, so there are SHARE of them at most). The base score gives the same
mass to each unknown word, however many there are, so it is no distribution and easily good on few documents.

Cases: a null or empty text has one token, its end; repeated rows each give a row; without training texts all counts are 0 and all
symbols equally likely; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
LEAST_SHARE = 3e-6
GAIN = 12.0
ESCAPE = 2.5
HEAVY, SHARE = 1000, 50_000
SEGMENT = 512
SPACE, END = 32, 10
_U = np.uint64


def stream(words: common.Words, pads: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first of each text): `pads` ends, then the words with a space after each, then an end."""
    texts = len(words.off) - 1
    size = np.bincount(words.text, weights=words.length + 1, minlength=texts).astype(np.int64) + pads + 1
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.full(first[-1], SPACE, np.uint8)
    w = np.arange(len(words.start))
    shift = np.repeat(w + (words.text + 1) * pads + words.text, words.length)
    kept = words.data[words.inside]
    out[np.arange(len(kept)) + shift] = kept
    for j in range(pads):
        out[first[:-1] + j] = END
    out[first[1:] - 1] = END
    return out, first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[new], np.add.reduceat(n, new) if len(new) else n


def gram_counts(texts: DataFrame, depth: int) -> DataFrame:
    """gram (context and next symbol as bytes of a long), n; added up within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for b in common.slices(batches):
            s, first = stream(common.Words(*common.utf8(b.column(1)), hashed=False), depth)
            real = np.ones(len(s), bool)
            for j in range(depth):
                real[first[:-1] + j] = False
            key = np.zeros(len(s), _U)
            for j in range(depth + 1):
                key[j:] |= s[: len(s) - j].astype(_U) << _U(8 * j)
            key = np.sort(key[real])
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            keys.append(key[new])
            counts.append(np.diff(np.append(new, len(key))))
            size += len(new)
            if size > 800_000:
                k, n = _merge(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > 500_000:
                    yield from _rows(k, n)
                    keys, counts, size = [], [], 0
        if keys:
            yield from _rows(*_merge(keys, counts))

    return common.arrow_map(texts, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _rows(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(k), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(k[a : a + (1 << 16)].astype(np.int64)), pa.array(n[a : a + (1 << 16)].astype(np.int64))], ["gram", "n"])


class Tree:
    """The automaton: next state and log10 probability for each state and symbol class."""

    def __init__(self, contexts: dict[bytes, dict[int, int]], depth: int, least: float = 0.0):
        """contexts: next-symbol counts of the contexts that stay, the empty one included; least: how often a byte must occur to be in one."""
        root = np.zeros(256)
        for x, n in contexts.get(b"", {}).items():
            root[x] = n
        common_ = np.flatnonzero(root >= max(1, least))
        self.size = len(common_) + 1  # the last class: all other bytes
        self.of = np.full(256, self.size - 1, np.uint8 if self.size < 256 else np.uint16)
        self.of[common_] = np.arange(len(common_))
        names = {b""}
        for s in contexts:
            names |= {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        self.names = sorted(names, key=lambda s: (len(s), s))
        at = {s: i for i, s in enumerate(self.names)}
        p = np.zeros((len(at), self.size))
        step = np.zeros((len(at), self.size), np.int32)
        mass = (root + 0.5) / (root.sum() + 128)
        np.add.at(p[0], self.of.astype(np.int64), mass)
        children: dict[bytes, list[tuple[int, int]]] = {}
        for i, s in enumerate(self.names[1:], 1):
            children.setdefault(s[:-1], []).append((s[-1], i))
        for i, s in enumerate(self.names):
            if i:
                up = at[s[1:]]
                p[i], step[i] = p[up], step[up]
                if c := contexts.get(s):
                    n = np.zeros(self.size)
                    np.add.at(n, self.of[list(c)].astype(np.int64), list(c.values()))
                    kinds = len(c)
                    p[i] = (n + ESCAPE * kinds * p[up]) / (n.sum() + ESCAPE * kinds)
            for x, child in children.get(s, ()):
                if self.of[x] < self.size - 1:
                    step[i, self.of[x]] = child
        own = mass / np.bincount(self.of, weights=mass, minlength=self.size)[self.of]
        self.extra = np.log10(np.where(own > 0, own, 1)).astype(np.float32)  # of a byte within its class
        # one column more: past the end of a text nothing changes
        self.step = np.ascontiguousarray(np.column_stack([step, np.arange(len(at))]).astype(np.int32)).ravel()
        self.cost = np.column_stack([np.log10(np.maximum(p, 1e-300)), np.zeros(len(at))]).astype(np.float32).ravel()
        self.depth, self.width = depth, self.size + 1

    def scores(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a stream with `depth` pads."""
        n = np.diff(first) - self.depth
        parts = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), parts)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[text] + inner * SEGMENT  # the pads, or the symbols before
        count = np.minimum(SEGMENT, n[text] - inner * SEGMENT)
        order = np.argsort(-count, kind="stable")
        start, count = start[order], count[order]
        coded, extra = np.append(self.of[symbols], self.of[:1]), np.append(self.extra[symbols], self.extra[:1])
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        live = len(start)
        for t in range(self.depth + (int(count[0]) if len(count) else 0)):
            while live and count[live - 1] + self.depth <= t:
                live -= 1
            at = state[:live] * self.width + coded[start[:live] + t]
            if t >= self.depth:
                total[:live] += self.cost[at] + extra[start[:live] + t]
            state[:live] = self.step[at]
        return np.bincount(text[order], weights=total, minlength=len(n))


def learn(grams: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, gain: float = GAIN) -> Tree:
    """The tree from gram counts: frequency and divergence are tested where the counts are, only contexts that stay are gathered."""
    grams = common.written(grams, "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Tree({b"": {}}, depth)
    least = max(2.0, total * least_share * min(1.0, (total / 1e8) ** -0.2))
    context = lambda d: F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * d) - 1))
    tables = {}
    for d in range(depth + 1):
        t = grams.groupBy(context(d).alias("s"), F.col("gram").bitwiseAND(F.lit(255)).alias("x")).agg(F.sum("n").alias("n"))
        often = t.groupBy("s").agg(F.sum("n").alias("of")).where(F.col("of") >= least)
        tables[d] = common.written(t.join(often, "s"), f"contexts{d}")
    contexts: dict[bytes, dict[int, int]] = {}
    for d in range(depth, -1, -1):
        t = tables[d]
        if d:
            up = tables[d - 1].select(F.col("s").alias("up"), F.col("x").alias("ux"), (F.col("n") / F.col("of")).alias("q"))
            both = t.join(up, (F.col("up") == F.col("s").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))) & (F.col("ux") == F.col("x")))
            far = both.groupBy("s").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("of") / F.col("q"))).alias("gain")).where(F.col("gain") >= gain)
            t = t.join(far, "s", "left_semi")
        rows = t.select("s", "x", "n").toPandas()  # only contexts that stay
        for s, x, n in zip(rows["s"].tolist(), rows["x"].tolist(), rows["n"].tolist(), strict=True):
            contexts.setdefault(s.to_bytes(d, "big"), {})[x] = n
    return Tree(contexts, depth, least)


_BLOCK = "block long, doc_id array<long>, held_out array<boolean>, n_words array<long>, score array<double>, word array<long>, n array<long>, use binary"
_PLACES = 23  # bits of a word's place in its block's list


def _block_row(number: int, parts: list[tuple]) -> pa.RecordBatch:
    """One block from the documents, words and scores of its slices."""
    ids, held, n_words, score, text, hashes = (np.concatenate([p[i] for p in parts]) if i else sum((p[0] for p in parts), []) for i in range(6))
    text = np.repeat(np.arange(len(n_words)), n_words)
    kinds, own = np.unique(hashes, return_inverse=True)
    n = np.bincount(own[~held[text]], minlength=len(kinds)) if len(kinds) else np.empty(0, np.int64)
    pairs, times = np.unique(text << 32 | own, return_counts=True)
    at = np.searchsorted(pairs >> 32, np.arange(len(n_words) + 1))
    use = np.concatenate((at, np.diff(pairs & 0xFFFFFFFF, prepend=0), times)).astype("<i4")
    one = lambda v, kind: pa.array([v], pa.list_(kind))
    cols = [pa.array([number], pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(n_words, pa.int64()), one(score, pa.float64()), one(kinds.view(np.int64), pa.int64()), one(n.astype(np.int64), pa.int64()), pa.array([zlib.compress(use.tobytes(), 1)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _BLOCK.split(", ")])


def _blocks(texts: DataFrame, tree: Tree, block_bytes: int) -> DataFrame:
    """A row for each block of documents: its distinct words with their training counts, and each document's use of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20
        parts, size = [], 0
        for b in common.slices(batches):
            data, off = common.utf8(b.column(1))
            words = common.Words(data, off)
            parts.append((b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), words.n, tree.scores(*stream(words, tree.depth)), np.empty(0, np.int64), words.hash))
            size += len(data)
            if size >= block_bytes:
                yield _block_row(number, parts)
                parts, size, number = [], 0, number + 1
        if parts:
            yield _block_row(number, parts)

    return common.arrow_map(texts, run, _BLOCK)


def _counted(words: DataFrame, counts: DataFrame, most: int, places: int) -> DataFrame:
    """words (word, place) with the count c of each; those of very many blocks aren't dealt by word."""
    limit = max(HEAVY, places // SHARE)
    light = counts.where(F.col("blocks") <= limit).select("word", "c")
    if most <= limit:
        return words.join(light, "word")
    heavy = F.broadcast(counts.where(F.col("blocks") > limit).select("word", "c"))
    return words.join(heavy, "word").unionByName(words.join(heavy, "word", "left_anti").join(light, "word"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_share: float = LEAST_SHARE, gain: float = GAIN, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out (crc32(doc_id as text) mod 5 is 1), n_tokens, n_known, train_tokens, base_score, score.

    The model and the base counts come from documents that aren't held out.
    """
    texts = common.texts(docs, id_col, text_col)
    texts = texts.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    tree = learn(gram_counts(texts.where("not held_out"), depth), depth, least_share, gain)
    blocks = common.written(_blocks(texts, tree, block_bytes), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("word", "n")).alias("i", "w"))
    words = words.select(F.shiftleft("block", _PLACES).bitwiseOR(F.col("i").cast("long")).alias("place"), F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    counts = common.written(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")).where("c > 0"), "word-counts")
    total, kinds, most, places = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.max("blocks"), F.sum("blocks")).first()
    ends = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0))).first()[0]
    total, kinds = total + ends, kinds + (ends > 0)
    found = _counted(words.select("word", "place"), counts, most or 0, places or 0).select(F.shiftrightunsigned("place", _PLACES).alias("block"), F.col("place").bitwiseAND(F.lit((1 << _PLACES) - 1)).cast("int").alias("i"), "c")
    found = found.groupBy("block").agg(F.collect_list(F.struct("i", "c")).alias("found"))
    rows = blocks.select("block", "doc_id", "held_out", "n_words", "score", F.size("word").alias("kinds"), "use").join(found, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(name)[r] for name in b.schema.names}
                c = np.zeros(row["kinds"].as_py())
                if (own := row["found"].values) is not None:
                    c[own.field("i").to_numpy(zero_copy_only=False)] = own.field("c").to_numpy(zero_copy_only=False)
                n = len(row["doc_id"].values)
                use = np.frombuffer(zlib.decompress(row["use"].as_py()), "<i4").astype(np.int64)
                at, rest = use[: n + 1], use[n + 1 :]
                own, times = np.cumsum(rest[: at[-1]]), rest[at[-1] :]
                text = np.repeat(np.arange(n), np.diff(at))
                base = np.bincount(text, weights=times * log(c[own]), minlength=n) + log(float(ends))
                known = np.bincount(text, weights=times * (c[own] > 0), minlength=n).astype(np.int64) + (ends > 0)
                words = row["n_words"].values.to_numpy()
                cols = [row["doc_id"].values, row["held_out"].values, pa.array(words + 1), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), row["score"].values]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return common.arrow_map(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
