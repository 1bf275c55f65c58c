"""Periodic runs of words, found by bit-parallel lags.

Each text's words are numbered and the numbers cut into bit planes, each one big integer with a bit for each word. At lag q a plane
XOR itself shifted by q marks the words that differ in it from the word q further; the OR over the planes leaves zeros where words q apart
are equal. AND with itself, shifted by 1, 2, 4 and so on, leaves the places where a sufficiently long stretch of them starts. A stretch of a
multiple of a run's period has the same ends as the run, which has been seen at its smallest period by then.

Lags are tried upwards to a quarter of the words. In texts of more than SIEVE words a lag is tried only if it can hold a run: a run of
period q >= 2^k has a multiple c of 2^k among its first q words, and the GRAM words at c, c + q and c + 2q are the same; where a run of a smaller
period covers c to c + 2q there is none of period q. So a text of n words takes about n log n steps and no lag with a run is left out.

Cases: null and empty texts have no words and no runs; rows without doc_id are texts like others; repeated rows each give a row; an empty
table gives an empty result; other columns are ignored. Words are compared as bytes, without case folding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 6, 4  # words of a run, and periods in it
SIEVE, GRAM = 1 << 15, 8
_FEW = 4  # planes that are looked at first
_RUN = "struct<start:long,length:long,period:long>"


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of each word's number as one integer, word 0 lowest."""
    kinds, ids = np.unique(ids, return_inverse=True)
    rows = [np.packbits((ids >> b) & 1, bitorder="little") for b in range(max(1, int(len(kinds) - 1).bit_length()))]
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def _long_enough(same: int, m: int) -> int:
    """Bits where m set bits begin."""
    have = 1
    while have < m and same:
        step = min(have, m - have)
        same &= same >> step
        have += step
    return same


def _stretches(bits: int, n: int) -> tuple[list[int], list[int]]:
    """First and past-the-last places of the runs of set bits."""
    raw = np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").view(np.int8)
    edge = np.diff(raw, prepend=0, append=0)
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def runs(ids: np.ndarray, sieve: int = SIEVE) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period; ids: a number for each word."""
    n = len(ids)
    if n < LEAST:
        return []
    few, rest, found, seen = (kinds := planes(ids))[:_FEW], kinds[_FEW:], [], set()
    reach = np.zeros(n, np.int64) if n > sieve else None
    for q in range(1, n // TIMES + 1) if reach is None else _lags(ids, reach):
        m, mask, differ = max(LEAST, TIMES * q) - q, (1 << (n - q)) - 1, 0
        for plane in few:
            differ |= plane ^ (plane >> q)
        if not (long := _long_enough(mask & ~differ, m)):
            continue
        if rest:
            for plane in rest:
                differ |= plane ^ (plane >> q)
            if not (long := _long_enough(mask & ~differ, m)):
                continue
        for a, z in zip(*_stretches(long, n), strict=True):
            end = z + m - 1 + q
            if (a, end) not in seen:
                seen.add((a, end))
                found.append((a, end - a, q))
                if reach is not None:
                    np.maximum(reach[a:end], end, out=reach[a:end])
    return sorted(found, key=lambda r: (r[0], r[2]))


def _lags(ids: np.ndarray, reach: np.ndarray, most: int = 1 << 20) -> Iterator[int]:
    """The lags that can hold a run, upwards; reach: for each word the furthest end of the runs found so far that cover it."""
    n = len(ids)
    yield from range(1, min(GRAM, n // TIMES + 1))
    gram = np.zeros(n - GRAM + 1, common.U)
    value = common.mix(ids.astype(common.U) + common.U(29))
    for j in range(GRAM):
        gram += value[j : j + len(gram)] * (common.mix(np.array([j + 31], common.U)) | common.U(1))
    step = GRAM
    while step <= n // TIMES:
        rows, lags = len(gram) // step - 1, set()
        block = max(1, most // step)
        for r in range(0, rows, block):
            k = min(block, rows - r)
            at, offset = np.nonzero(gram[(r + 1) * step : (r + 1 + k) * step].reshape(k, step) == gram[r * step : (r + k) * step : step][:, None])
            c, q = (at + r) * step, offset + step
            ok = (c + 3 * q <= n) & (c + 2 * q + GRAM <= n)
            c, q = c[ok], q[ok]
            lags.update(np.unique(q[(gram[c] == gram[c + 2 * q]) & (reach[c] < c + 2 * q)]).tolist())
        last = rows * step + step  # the checkpoint whose lags reach beyond the last whole row
        for c in range(max(0, (rows - 1) * step), min(last, len(gram)), step):
            q = np.arange(step, min(2 * step, (n - c) // 3 + 1))
            q = q[c + 2 * q + GRAM <= n]
            lags.update(q[(gram[c] == gram[c + q]) & (gram[c] == gram[c + 2 * q]) & (reach[c] < c + 2 * q)].tolist())
        yield from (q for q in sorted(lags) if q <= n // TIMES)
        step *= 2


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start, then period) and collapsed: the words joined by a space,
    without those that a run holds beyond its first period."""
    kind = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            w = common.Words(*common.utf8(b.column(1)), hashed=False, lower=False)
            at = np.concatenate(([0], np.cumsum(w.length)))
            spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.length), [None, pa.py_buffer(at), pa.py_buffer(w.data[w.inside])])
            ids = spelled.dictionary_encode().indices.to_numpy() if len(w.length) else np.empty(0, np.int32)
            drop, all_runs = np.zeros(len(ids) + 1, np.int32), []
            for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                all_runs.append(own := runs(ids[x:y]))
                for start, length, period in own:
                    drop[x + start + period] += 1
                    drop[x + start + length] -= 1
            keep = np.cumsum(drop[:-1]) == 0
            n = np.array([len(r) for r in all_runs])
            flat = np.array([r for own in all_runs for r in own], np.int64).reshape(-1, 3)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(row)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.n), listed, joined(w, keep)], ["doc_id", "n_words", "runs", "collapsed"])

    return common.arrow_map(common.texts(docs, id_col, text_col), run, kind)


def joined(w: common.Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    start, size = w.start[keep], w.length[keep]
    after = np.cumsum(size + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    move = np.repeat(start - (after - size - 1), size)
    place = np.arange(len(move)) + np.repeat(np.arange(len(size)), size)
    out[place] = w.data[place + move]
    n = np.bincount(w.text[keep], minlength=len(w.n))
    end = np.concatenate(([0], after))[np.cumsum(n)]
    first = np.concatenate(([0], end[:-1]))
    raw = out.tobytes()
    return pa.array([raw[a : z - 1].decode() if z > a else "" for a, z in zip(first.tolist(), end.tolist(), strict=True)], pa.string())


def strongest(found: Column) -> Column:
    """Of an array of runs that with the greatest exact length / period, then the smallest start, then period; null if there is none."""

    def better(s: Column, r: Column) -> Column:
        more, as_much = r["length"] * s["period"], s["length"] * r["period"]
        ahead = (more > as_much) | ((more == as_much) & ((r["start"] < s["start"]) | ((r["start"] == s["start"]) & (r["period"] < s["period"]))))
        return F.when(s["start"].isNull() | ahead, r).otherwise(s)

    return F.aggregate(found, F.lit(None).cast(_RUN), better)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, where of each id with h = crc32(id as text) divisible by 10 the words from the (h / 10 mod n)-th on repeat with the period that
    h gives (a known share of texts then has runs); other texts, and texts without an id, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def repeated(s: Column) -> Column:
        n, g = F.size(s["w"]).cast("long"), F.floor(s["h"] / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(s["w"], place(i).cast("int"))), " ")

    words = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    new = F.get(F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), lambda s: F.when(F.size(s["w"]) > 0, repeated(s))), F.lit(0))
    return docs.withColumn(text_col, F.when(h % 10 == 0, F.coalesce(new, F.col(text_col))).otherwise(F.col(text_col)))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    top = found.withColumn("top", strongest(F.col("runs")))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("(top.length * 1000) div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
