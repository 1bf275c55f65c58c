"""Benchmark decontamination by training suffix arrays.

Each batch of documents is a shard: its words become ids of the test vocabulary (0: not in it), and a sparse suffix
array sorts the positions from which a whole test window could still match, by their next `window` words. Every test window
is binary-searched in it, which gives all positions that match one. Longest matches come from the order of suffixes alone: the test
set has a full suffix array (by doubling), a matched position's place in it is found by binary search, and what the position has in
common with its two neighbours there is its longest match and a location of it. Occurrences are never paired, so texts and items that repeat a word
many times cost no more than others. Common prefixes are compared by prefix hashes.

The test set travels to the tasks as a broadcast of at most about `slice_bytes` of text (an item stays whole). A larger set takes
several passes over the texts, one for each slice, of which only texts with hits are written, so neither the driver nor a task
ever holds more than a slice.

Cases: null and empty texts have no words and are clean; an item of fewer than `window` words, but not none, is one
window; items without words never match; equal items are counted each; repeated document rows each give a row; an
empty table gives an empty result; other columns are ignored, or carried along whole. Of several places of one longest match, one is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import common

SLICE_BYTES = 4 << 20


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ids, in order, by doubling the length that is compared."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n and rank.max(initial=0) < n - 1:
        key = (rank + 1) * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        k *= 2
    return order


class Prefixes:
    """Hashes of the prefixes of a sequence of ids, from which those of all its stretches follow."""

    BASE = common.U(0x9E3779B97F4A7C15)

    def __init__(self, ids: np.ndarray):
        # sum of value * BASE ** -i would need inverses; value * BASE ** i compares after a shift by the distance of the places
        self.power = np.concatenate((np.ones(1, common.U), np.multiply.accumulate(np.full(len(ids), self.BASE))))
        self.sum = np.concatenate((np.zeros(1, common.U), np.cumsum(common.mix(ids.astype(common.U) + common.U(3)) * self.power[:-1])))

    def __call__(self, start: np.ndarray, size: np.ndarray, shift: np.ndarray, power: np.ndarray) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * power[shift]


class TestSet:
    """Windows of a slice of test items, and the shards' searches for them."""

    def __init__(self, item_ids: list[str], item_texts: list[str], window: int):
        data, off = common.utf8(pa.array(item_texts, pa.string()))
        words = common.Words(data, off, common.ALNUM)
        self.window, self.item_ids = window, np.array(item_ids, object)
        self.vocabulary = np.unique(words.hash)
        ids = self.ids(words.hash)
        start, size = [], []
        for i, n in enumerate(words.n.tolist()):
            here = np.arange(max(1, n - window + 1) if n else 0)
            start.append(words.first[i] + here)
            size.append(np.full(len(here), min(n, window)))
        start = np.concatenate(start) if start else np.empty(0, np.int64)
        size = np.concatenate(size) if size else np.empty(0, np.int64)
        keys = self.keys(ids, start, size)
        order = np.lexsort((keys, size)) if len(keys) else np.empty(0, np.int64)
        keys, size, start = keys[order], size[order], start[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (size[1:] != size[:-1])
        self.key, self.size = keys[new], size[new]
        self.shortest = int(self.size.min()) if len(self.size) else 0
        self.high = self.keys(ids, start[new], self.size, fill=0xFFFFFFFF)
        group = np.cumsum(new) - 1
        item = words.text[start] if len(start) else np.empty(0, np.int64)
        own = pd.DataFrame({"key": group, "item": item}).drop_duplicates().sort_values(["key", "item"])
        self.owner = own["item"].to_numpy()
        self.owners = np.searchsorted(own["key"].to_numpy(), np.arange(len(self.key) + 1))
        # the items one after the other, a 0 after each, and their suffixes in order
        place = np.arange(len(ids)) + words.text
        self.flat = np.zeros(len(ids) + len(words.n), np.uint32)
        self.flat[place] = ids
        self.item = np.repeat(np.arange(len(words.n)), words.n + 1)
        self.first = words.first[:-1] + np.arange(len(words.n))
        self.last = self.first + words.n
        order = suffix_array(self.flat)
        self.suffixes = order[self.flat[order] > 0]
        self.hashes = Prefixes(self.flat)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)

    def keys(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int = 0) -> np.ndarray:
        """The next `size` ids (at most a window) from each start as bytes that sort as the words do."""
        rows = np.full((len(start), self.window), fill, ">u4")
        for j in range(self.window):
            has = size > j
            rows[has, j] = ids[start[has] + j]
        return rows.view(f"S{4 * self.window}").ravel()

    def search(self, words: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every match in the shard."""
        none = np.empty(0, np.int64)
        if not len(self.key) or not len(words.hash):
            return none, none
        ids = self.ids(words.hash)
        ends = np.where(ids == 0, np.arange(len(ids)), len(ids))
        ends = np.minimum.accumulate(ends[::-1])[::-1]
        reach = np.minimum(ends, words.first[words.text + 1]) - np.arange(len(ids))
        at = np.flatnonzero(reach >= self.shortest)
        suffix = self.keys(ids, at, np.minimum(reach[at], self.window))
        order = np.argsort(suffix, kind="stable")
        sorted_keys = suffix[order]
        low = np.searchsorted(sorted_keys, self.key, "left")
        high = np.searchsorted(sorted_keys, self.high, "right")
        n = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[order[low[window] + inner]], window

    def items_of(self, text: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs, sorted."""
        pairs = np.unique(np.stack([text, window], 1), axis=0)
        n = self.owners[pairs[:, 1] + 1] - self.owners[pairs[:, 1]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[np.repeat(self.owners[pairs[:, 1]], n) + inner]
        return np.unique(np.stack([np.repeat(pairs[:, 0], n), item], 1), axis=0)

    def longest(self, ids: np.ndarray, hashes: Prefixes, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place in the test set) of the longest match from each place of a shard; reach: words it may take there."""
        power = hashes.power if len(hashes.power) > len(self.hashes.power) else self.hashes.power

        def common_words(t: np.ndarray) -> np.ndarray:
            low, high = np.zeros(len(at), np.int64), np.minimum(reach, self.last[self.item[t]] - t)
            up, down = np.maximum(t - at, 0), np.maximum(at - t, 0)
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = hashes(at, mid, up, power) == self.hashes(t, mid, down, power)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes))
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(self.suffixes) - 1)
            t = self.suffixes[mid]
            n = common_words(t)
            after = (n < reach) & (ids[np.minimum(at + n, len(ids) - 1)] > self.flat[t + n])  # an item's end is a 0
            after &= low < high
            low, high = np.where(after, mid + 1, low), np.where(after | (low >= high), high, mid)
        above, below = self.suffixes[np.maximum(low - 1, 0)], self.suffixes[np.minimum(low, len(self.suffixes) - 1)]
        n_above, n_below = common_words(above), common_words(below)
        return np.maximum(n_above, n_below), np.where(n_above > n_below, above, below)

    def matches(self, words: common.Words, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, item, doc_word, item_word, n_words of the longest match of a window or more from each matched place. A match that is no longer than
        a short item's window is that item's."""
        ids = self.ids(words.hash)
        best = pd.DataFrame({"at": at, "size": self.size[window], "key": window}).sort_values(["at", "size"]).groupby("at", sort=True).last()
        p = best.index.to_numpy()
        ends = np.append(np.flatnonzero(ids == 0), len(ids))
        reach = np.minimum(ends[np.searchsorted(ends, p)], words.first[words.text[p] + 1]) - p
        n, t = self.longest(ids, Prefixes(ids), p, reach)
        short = n < self.window
        item = np.where(short, self.owner[np.minimum(self.owners[best["key"].to_numpy()], len(self.owner) - 1)], self.item[t])
        item_word = np.where(short, 0, t - self.first[self.item[t]])
        return words.text[p], item, p - words.first[words.text[p]], item_word, np.where(short, best["size"].to_numpy(), n)


LOCATION = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"
_KIND = "doc_id long, n_words long, n_hit long, longest long, items array<string>, items_sha256 string, contaminated boolean"


def _hits(tests: TestSet, words: common.Words) -> tuple[list[list[int]], list[list[str]], list[list[dict]]]:
    """Per text: hit stretches (first and end word, one after the other), items, longest matches that aren't inside another."""
    n_texts = len(words.n)
    spans, items, matches = ([[] for _ in range(n_texts)] for _ in range(3))
    at, win = tests.search(words)
    if not len(at):
        return spans, items, matches
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.size[win], -1)
    inside = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)[:-1], [0]))
    step = np.diff(inside)
    a, z = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # one run may cross from a text into the next: cut it there
    cuts = [c for c in words.first[1:-1].tolist() if c < len(words.hash) and c and inside[c] and inside[c + 1]]
    a, z = np.union1d(a, cuts).astype(np.int64), np.union1d(z, cuts).astype(np.int64)
    for s, e in zip(a.tolist(), z.tolist(), strict=True):
        t = words.text[s]
        spans[t] += [s - int(words.first[t]), e - int(words.first[t])]
    for t, item in tests.items_of(words.text[at], win).tolist():
        items[t].append(tests.item_ids[item])
    for t, item, doc_word, item_word, n in zip(*[x.tolist() for x in tests.matches(words, at, win)], strict=True):
        if not matches[t] or doc_word + n > matches[t][-1]["doc_word"] + matches[t][-1]["n_words"]:
            matches[t].append({"item_id": tests.item_ids[item], "doc_word": doc_word, "item_word": item_word, "n_words": n})
    return spans, items, matches


def _outermost(matches: list[dict]) -> list[dict]:
    """Matches of several slices without those inside another."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["doc_word"], -m["n_words"], m["item_id"])):
        if not out or m["doc_word"] + m["n_words"] > out[-1]["doc_word"] + out[-1]["n_words"]:
            out.append(m)
    return out


def _columns(doc_id: pa.Array, n_words: np.ndarray, spans: list, items: list, matches: list, percent: int) -> list[pa.Array]:
    n_hit, kept = [], []
    for own, named in zip(spans, items, strict=True):
        hit, last = 0, 0
        for s, e in sorted(zip(own[::2], own[1::2], strict=True)):
            hit += max(0, e - max(s, last))
            last = max(last, e)
        n_hit.append(hit)
        kept.append(sorted(set(named)))
    n_hit = np.array(n_hit, np.int64)
    longest = pa.array([max((m["n_words"] for m in own), default=0) for own in matches], pa.int64())
    sha = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in kept], pa.string())
    return [doc_id, pa.array(n_words), pa.array(n_hit), longest, pa.array(kept, pa.list_(pa.string())), sha, pa.array((n_hit > 0) & (100 * n_hit >= percent * n_words))]


def _sent(tests: DataFrame, window: int):
    """The arrays of a slice of tests, built once and sent to every executor as a broadcast of bounded size."""
    rows = tests.collect()  # at most about slice_bytes of text
    return tests.sparkSession.sparkContext.broadcast(TestSet([r["item"] or "" for r in rows], [r["text"] for r in rows], window))


def scan(docs: DataFrame, bench: DataFrame, window: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES, carry: bool = False, locations: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any match), longest (words of its longest verbatim match, of a window or
    more), items (sorted as strings), contaminated (n_hit > 0 and 100 * n_hit >= percent * n_words); row (all columns, if carried);
    matches (if located)."""
    tests = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))
    df = common.texts(docs, id_col, text_col, carry)
    if n_slices > 1:
        df = _with_hits(df, tests, n_slices, window)
        sent = None
    else:
        sent = _sent(tests, window)
    kept = [f for f in df.schema.fields if f.name == "row"] + ([StructField("matches", _parse_datatype_string(LOCATION))] if locations else [])
    schema = StructType([*_parse_datatype_string(_KIND).fields, *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            words = common.Words(*common.utf8(b.column(1)), common.ALNUM, hashed=sent is not None)
            found = _hits(sent.value, words) if sent else tuple([x or [] for x in b.column(c).to_pylist()] for c in ("spans", "items", "matches"))
            found = (*found[:2], found[2] if sent else [_outermost(m) for m in found[2]])
            cols = _columns(b.column(0), words.n, *found, percent)
            cols += ([b.column("row")] if carry else []) + ([pa.array(found[2], pa.list_(_MATCH))] if locations else [])
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return common.arrow_map(df, run, schema)


_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])


def _with_hits(df: DataFrame, tests: DataFrame, n_slices: int, window: int) -> DataFrame:
    """df with spans, items and matches over all slices. Each slice is one pass over the texts, which are written once; only
    texts with hits leave a pass, so one slice at a time is in memory, on the driver too."""
    df = common.written(df.withColumn("key", F.monotonically_increasing_id()), "texts")
    parts = []
    for i in range(n_slices):
        sent = _sent(tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_slices)) == i), window)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                spans, items, matches = _hits(sent.value, common.Words(*common.utf8(b.column(1)), common.ALNUM))
                has = pa.array([bool(x) for x in spans])
                cols = [b.column("key"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(_MATCH))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "spans", "items", "matches"]).filter(has)

        hits = common.arrow_map(df.select("doc_id", "text", "key"), run, f"key long, spans array<long>, items array<string>, matches {LOCATION}")
        parts.append(common.written(hits, "hits"))
        sent.destroy()
    hits = reduce(DataFrame.unionByName, parts)
    hits = hits.groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")])  # at most a row a slice
    return df.join(hits, "key", "left").select(*[c for c in df.columns if c != "key"], "spans", "items", "matches")


def remove_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    return scan(docs, bench, carry=True, **options).where(~F.col("contaminated")).select("row.*")
