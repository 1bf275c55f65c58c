"""Similarity joins for the matching-blocks ratio: twice the characters in matching blocks over both lengths.

The ratio is no metric, but it is bounded by what can be counted. Matched characters are common to both texts as multisets; and as M matched ones of
S in all stand in at most S - 2M + 1 blocks, at least 3M - S - 1 pairs of neighbouring characters are common too. Both bounds are overlaps of sets
of numbered tokens ("the second e"), so a prefix filter loses no pair: with the rarest tokens first, two texts that reach the threshold share one of
the first n - least + 1 of each, least being the overlap that the shortest possible partner asks for. Pairs of characters serve where the threshold makes them
selective, single characters for lower ones and for texts so short that no pair need be common. Only what passes both bounds on whole texts is matched.

Where tokens don't select, as in long texts of a small vocabulary, texts meet in groups instead: a task holds a group of texts of a class of lengths, as bits
of their numbered runs of characters, and streams those of like length past it; a matrix product gives what any two have in common. What is matched lies in few
blocks: no more than S - 2M + 1, and for a second text of 200 characters or more no more than its characters that aren't popular, and one, as difflib begins a
block at such a character only, or at the start of both texts. So most of the runs of similar texts are common. What passes is bounded by the longest common
subsequence. Time is quadratic within a class of lengths, but no pair is written or shuffled before, and a text moves once for each group of like length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from lorespark.functions import ship
from lorespark.functions import text as T
from lorespark.functions.scratch import cut

_EPS, _PAIRS_FROM = 1e-9, 0.8
FEW_PAIRS = 100_000_000  # of texts whose lengths allow the ratio: up to so many are held against each other without a look at their tokens
LOOK = 2000  # so many texts show whether tokens select
GROUP_TEXTS, GROUP_CHARS = 1 << 14, 1 << 25  # what a task holds
BLOCK_TEXTS, BLOCK_CHARS = 1024, 1 << 20  # of them, and of those that pass by, are multiplied at once
ROWS = 256
POPULAR = 200  # difflib: from this length on, characters of over a hundredth of the second text, and one, begin no block


def ratio(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks, longest blocks first; an Arrow function. Not quite symmetric."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=True).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(of, DoubleType())(a, b)


def long_enough(a: Column, b: Column, threshold: float) -> Column:
    """Whether two lengths allow the ratio: the shorter text cannot match more than itself."""
    return 2 * F.least(a, b) >= threshold * (a + b) - _EPS


def least_pairs(total: Column, threshold: float) -> Column:
    """Pairs of characters that texts of so many characters in all must have in common."""
    return F.ceil((1.5 * threshold - 1) * total - 1 - _EPS)


def _limit(threshold: float) -> float:
    """Texts of up to so many characters join by single characters."""
    if threshold < _PAIRS_FROM:
        return math.inf
    needs = lambda n: math.ceil((1.5 * threshold - 1) * (n + math.ceil(threshold * n / (2 - threshold) - _EPS)) - 1 - _EPS)
    return max((n for n in range(1, 200) if needs(n) < 1), default=0)


def numbered(of: Column) -> Column:
    """An array of tokens, each with the number of its occurrence: "e 1", "e 2". An Arrow function, so that texts aren't taken apart into rows."""

    def number(arrays: pd.Series) -> pd.Series:
        def one(tokens) -> list[str]:
            seen: dict[str, int] = {}
            out = []
            for t in tokens:
                seen[t] = n = seen.get(t, 0) + 1
                out.append(f"{t} {n}")
            return out

        return arrays.map(one)

    return F.pandas_udf(number, ArrayType(StringType()))(of)


def _prefixes(texts: DataFrame, tokens: str, least: Column) -> DataFrame:
    """s, n, left, right, token: of each text the rarest size - least + 1 tokens of the array."""
    rows = texts.select("s", F.explode(tokens).alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df"))
    own = rows.join(often, "token").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))  # one text's own
    rows = own.join(texts.select("s", "n", "left", "right"), "s").select("s", "n", "left", "right", F.explode(F.slice("all", F.lit(1), F.greatest(F.size("all") - least + 1, F.lit(0)).cast("int"))).alias("x"))
    return rows.where("x.df > 1").select("s", "n", "left", "right", F.col("x.token").alias("token"))


def candidates(texts: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """x, y: pairs of different texts, x of the left and y of the right side, that can reach the threshold; texts: s (each once), left, right. once: only
    those with x < y."""
    if not 2 / 3 < threshold <= 1:
        raise ValueError("the threshold must be over two thirds")
    texts = cut(texts.where(F.length("s") > 0).select("s", F.length("s").alias("n"), "left", "right"))
    width = math.log((2 - threshold) / threshold) + _EPS
    own = F.floor(F.log("n") / width)  # lengths that allow the ratio are of one class or of two beside each other
    rows = texts.groupBy(own.alias("class")).agg(F.count("*").alias("k"), F.sum("n").alias("chars"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).collect()
    sizes = {r["class"]: r for r in rows}  # as many as there are classes
    most = sum(r["k"] * (r["k"] / 2 + (sizes[c + 1]["k"] if c + 1 in sizes else 0)) for c, r in sizes.items())
    groups = {c: max(math.ceil(r["k"] / GROUP_TEXTS), math.ceil(r["chars"] / GROUP_CHARS)) for c, r in sizes.items()}
    # tokens move the texts that they are of: as many characters as the squares of lengths
    if most <= FEW_PAIRS or sum(r["squares"] for r in rows) > most or not _select(texts, own, sum(r["k"] for r in rows), threshold):
        return _in_groups(texts, own, groups, threshold, once)
    texts = cut(_with_tokens(texts))
    found = None
    for tokens, holds in _tokens(texts, threshold):
        side = lambda c, rows, at: rows.select("token", F.col("s").alias(c), F.col("n").alias(f"n{c}"), at.alias("class"))
        both = side("x", tokens.where("left"), own).join(side("y", tokens.where("right"), F.explode(F.array(own - 1, own, own + 1))), ["token", "class"])
        both = both.where((F.col("x") < F.col("y") if once else F.col("x") != F.col("y")) & long_enough(F.col("nx"), F.col("ny"), threshold) & holds).select("x", "y")
        found = both if found is None else found.unionByName(both)
    return _bounded(found.distinct(), texts, threshold)


def _with_tokens(texts: DataFrame) -> DataFrame:
    return texts.withColumns({"one": numbered(T.characters(F.col("s"))), "two": numbered(T.neighbours(F.col("s")))})


def _select(texts: DataFrame, own: Column, many: int, threshold: float) -> bool:
    """Whether few of the pairs of like length share a rare token, judged by some texts; either way of `candidates` finds the same pairs."""
    some = cut(_with_tokens(texts.where(F.pmod(F.xxhash64("s"), F.lit(max(many // LOOK, 1))) == 0)))
    at = lambda rows, name, of: rows.select("token", of.alias("class")).groupBy("token", "class").agg(F.count("*").alias(name))
    rows = [at(t.where("left"), "a", own).join(at(t.where("right"), "b", F.explode(F.array(own - 1, own, own + 1))), ["token", "class"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0 for t, _ in _tokens(some, threshold)]
    k = {r[0]: r[1] for r in some.groupBy(own).count().collect()}
    return sum(rows) <= sum(v * (v / 2 + k.get(c + 1, 0)) for c, v in k.items()) / 5


def _tokens(texts: DataFrame, threshold: float) -> list[tuple[DataFrame, Column]]:
    """The prefixes of texts and the condition on a pair's lengths (nx, ny) under which they lose none."""
    low = F.col("n") + F.ceil(threshold * F.col("n") / (2 - threshold) - _EPS)  # both lengths, with the shortest partner
    limit = _limit(threshold)
    reach = limit if math.isinf(limit) else math.floor(limit * (2 - threshold) / threshold)
    systems = []
    if limit >= 1:
        short = texts if math.isinf(reach) else texts.where(F.col("n") <= reach)
        systems.append((_prefixes(short, "one", F.ceil(threshold / 2 * low - _EPS)), F.lit(True) if math.isinf(limit) else F.least("nx", "ny") <= limit))
    if not math.isinf(limit):
        systems.append((_prefixes(texts.where(F.col("n") > limit), "two", least_pairs(low, threshold)), F.lit(True)))
    return systems


def _in_groups(texts: DataFrame, own: Column, groups: dict[int, int], threshold: float, once: bool) -> DataFrame:
    """candidates by groups of texts of a class of lengths, past each of which go its own texts, half of its class's other groups and all of the next class;
    groups: how many a class has."""
    spark = texts.sparkSession
    ship.shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    order = sorted(groups, key=lambda c: (-groups[c], c))  # classes of many texts take longest and begin first
    first = dict(zip(order, np.cumsum([0, *(groups[c] for c in order)]).tolist(), strict=False))
    plan = [(c, first[c], g, first.get(c - 1, 0), groups.get(c - 1, 0)) for c, g in groups.items()]
    sizes = F.broadcast(spark.createDataFrame(plan, "class long, first int, groups int, below int, others int"))
    rows = texts.select("s", "n", "left", "right", own.alias("class")).join(sizes, "class").withColumn("g", F.pmod(F.xxhash64("s"), F.col("groups")).cast("int"))
    half = F.floor(F.col("groups") / 2)
    ahead = F.transform(F.sequence(F.lit(0), half), lambda d: F.struct((F.col("first") + F.pmod(F.col("g") - d, F.col("groups"))).cast("int").alias("id"), F.when(d == 0, 0).otherwise(1).alias("role")))
    # of an even number of groups, those half around meet in one of both only
    twice = (F.col("groups") % 2 == 0) & (F.col("g") < half)
    ahead = F.slice(ahead, F.lit(1), F.size(ahead) - F.when(twice, 1).otherwise(0))
    below = F.when(F.col("others") > 0, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda d: F.struct((F.col("below") + d).cast("int").alias("id"), F.lit(1).alias("role")))).otherwise(F.slice(ahead, 1, 0))
    rows = rows.select(F.explode(F.concat(ahead, below)).alias("to"), "n", "s", "left", "right").select("to.id", "to.role", "n", "s", "left", "right")
    rows = rows.repartitionById(max(sum(groups.values()), 1), "id").sortWithinPartitions("id", "role", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _passing(batches, threshold):
            pairs = [(p, q) for (p, pl, _), (q, _, qr) in zip(x, y, strict=True) if pl and qr] + [(q, p) for (p, _, pr), (q, ql, _) in zip(x, y, strict=True) if ql and pr]
            pairs = [(p, q) for p, q in pairs if not once or p < q]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([q for _, q in pairs], pa.string())], ["x", "y"])

    return rows.mapInArrow(run, "x string, y string")


def _passing(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[list, list]]:
    """Lists of texts (s, left, right) that may be similar, in step; batches: id, role, n, s, left, right in order of the first three. Of a group (id), texts of role 0
    are held and meet each other; those of role 1 meet them, a block at a time."""
    at, held, block, chars = None, [], [], 0
    for batch in batches:
        ids, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
        starts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(roles) != 0)) + 1).tolist(), len(texts)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if lo == hi:
                continue
            if at != (ids[lo], roles[lo]):
                if block:
                    yield from _meet(held, block, at[1] == 0, threshold)
                held, block, chars = (held if at and at[0] == ids[lo] else []), [], 0
                at = ids[lo], roles[lo]
            for k in range(lo, hi):
                block.append(texts[k])
                chars += len(texts[k][0])
                if len(block) >= BLOCK_TEXTS or chars >= BLOCK_CHARS:
                    yield from _meet(held, block, at[1] == 0, threshold)
                    block, chars = [], 0
    if block:
        yield from _meet(held, block, at[1] == 0, threshold)


def _meet(held: list, block: list, joins: bool, threshold: float) -> Iterator[tuple[list, list]]:
    """What `block` and the blocks held have alike; joins: it is then held too."""
    b = Block(block, threshold, held[0] if held else None)
    if joins:
        held.append(b)
    for a in held:
        low, high = math.ceil(threshold * b.n[0] / (2 - threshold) - 0.01), math.floor((2 - threshold) * b.n[-1] / threshold + 0.01)
        if a.n[0] <= high and a.n[-1] >= low and (found := near(a, b, threshold)):
            yield [a.texts[i] for i, _ in found], [b.texts[j] for _, j in found]


class Block:
    """Texts (s, left, right) in order of length: their lengths n, the most blocks of characters that difflib matches in each (`most`), bits of their runs, and how many runs share
    a bit with another of the text (`lost`)."""

    def __init__(self, texts: list, threshold: float, like: Block | None = None):
        self.texts = texts
        self.n = np.array([len(s) for s, _, _ in texts], np.int64)
        n = int(self.n[-1])
        self.q = like.q if like else 1 if threshold < _PAIRS_FROM else 2 if threshold < 0.88 else 3 if n < 600 else 4  # by trial, as the bits are
        bits = like.bits.shape[1] if like else 1 << min(max(math.ceil(math.log2((4.5 if n < 234 else 3) * n)), 7), 13)
        codes = np.frombuffer("".join(s for s, _, _ in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        of = np.repeat(np.arange(len(texts)), self.n)
        start = np.cumsum(self.n) - self.n
        _, often = _occurrences(codes << np.uint64(32), of)
        rare = np.add.reduceat((often <= (self.n // 100 + 1)[of]).astype(np.int64), start)
        self.most = np.where(self.n < POPULAR, np.inf, rare).astype(np.float32)
        self.kinds = np.bincount(of * 64 + (codes % np.uint64(64)).astype(np.int64), minlength=64 * len(texts)).reshape(-1, 64).astype(np.int32)
        runs = np.zeros(max(len(codes) - self.q + 1, 0), np.uint64)  # runs of one hash count as equal
        for j in range(self.q):
            runs = (runs + codes[j : j + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        whole = (np.arange(len(codes)) + self.q <= (start + self.n)[of])[: len(runs)]
        runs, of = runs[whole], of[: len(runs)][whole]
        number, _ = _occurrences(runs, of)
        mixed = (runs + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
        self.bits = np.zeros((len(texts), bits), np.uint8)
        self.bits[of, (mixed % np.uint64(bits)).astype(np.int64)] = 1
        self.lost = (np.maximum(self.n - self.q + 1, 0) - self.bits.sum(axis=1, dtype=np.int64)).astype(np.float32)


def _occurrences(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, given the ascending numbers of the texts that they are of: its number among equal ones of its text, and how many those are. Values whose first 53 bits
    are equal count as equal."""
    keys = of.astype(np.uint64) << np.uint64(53) | values >> np.uint64(11)  # up to 2,048 texts; the same of a value in all blocks
    order = np.argsort(keys)
    v = keys[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(v)))
    number, often = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    number[order] = np.arange(len(v)) - np.repeat(at, size)
    often[order] = np.repeat(size, size)
    return number, often


def near(a: Block, b: Block, threshold: float) -> list[tuple[int, int]]:
    """Places in a and b of texts that are bounded by the ratio and stand on different sides; of one block, each pair once."""
    found, its = [], b.bits.astype(np.float32).T
    n, m = a.n.astype(np.float32), b.n.astype(np.float32)
    for k in range(0, len(n), ROWS):
        of = slice(k, k + ROWS)
        total = np.add.outer(n[of], m)
        need = np.minimum(np.maximum.outer(a.most[of], b.most), (1 - threshold) * total + 0.01)  # blocks, less one
        need *= 1 - a.q
        total *= threshold / 2
        need += total
        need -= np.minimum.outer(a.lost[of], b.lost)
        need -= a.q - 1 + 0.01
        common = a.bits[of].astype(np.float32) @ its
        at = np.flatnonzero(common >= need)  # of the flat matrix, which is faster
        found.append(at + k * len(m))
    x, y = np.divmod(np.concatenate(found), len(m))
    if a is b:
        x, y = x[x < y], y[x < y]
    side = lambda of: np.array([(left, right) for _, left, right in of.texts], bool)
    left, right = side(a), side(b)
    both = a.n[x] + b.n[y]
    keep = (2 * np.minimum(a.n[x], b.n[y]) >= threshold * both - 1e-6) & (left[x, 0] & right[y, 1] | left[x, 1] & right[y, 0])
    x, y, both = x[keep], y[keep], both[keep]
    # characters are counted by classes, which can only make texts more alike
    keep = np.concatenate([np.abs(a.kinds[x[k : k + 65536]] - b.kinds[y[k : k + 65536]]).sum(axis=1) for k in range(0, max(len(x), 1), 65536)]) <= (1 - threshold) * both + 1e-6
    out, places, last = [], {}, -1
    for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
        s, t = a.texts[i][0], b.texts[j][0]
        if i != last:
            places, last = {}, i
            for p, c in enumerate(s):
                places[c] = places.get(c, 0) | 1 << p
        if s != t and reaches(places, len(s), t, math.ceil(threshold / 2 * (len(s) + len(t)) - 1e-6)):
            out.append((i, j))
    return out


def reaches(places: dict[str, int], size: int, y: str, need: int) -> bool:
    """Whether a text of that size, given by the places of each character as bits, and y can have `need` characters in common in one order: the longest common
    subsequence by bits, first of so much of both as unlike texts need to miss more than they may."""
    spare_x, spare_y = size - need, len(y) - need
    if min(spare_x, spare_y) < 0:
        return False
    for j in sorted({min(len(y), 4 * spare_y + 8), len(y)}):
        k = min(size, j + spare_x)  # what y's first j match lies in the first k
        full = state = (1 << k) - 1
        for c in y[:j]:
            u = state & places.get(c, 0)
            state = (state + u | state - u) & full
        if k - state.bit_count() < j - spare_y:
            return False
    return True


def _bounded(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (x, y) whose common characters, and common pairs of characters, allow the ratio."""
    side = lambda c: texts.select(F.col("s").alias(c), F.col("one").alias(f"one_{c}"), F.col("two").alias(f"two_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    total = F.length("x") + F.length("y")
    common = lambda name: F.size(F.array_intersect(f"{name}_x", f"{name}_y"))
    return both.where((common("one") >= threshold / 2 * total - _EPS) & (common("two") >= least_pairs(total, threshold))).select("x", "y")


def similar_texts(left: DataFrame, right: DataFrame | None, threshold: float, places: int = 6) -> DataFrame:
    """x, y, similarity, reverse: different texts (column s) of both tables, or of one, whose ratio is threshold or more in either order; reverse is the ratio
    of y to x. Of one table, pairs come once, x < y."""
    sides = left.select("s").distinct().select("s", F.lit(True).alias("left"), F.lit(right is None).alias("right"))
    if right is not None:
        other = right.select("s").distinct().select("s", F.lit(False).alias("left"), F.lit(True).alias("right"))
        sides = sides.unionByName(other).groupBy("s").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    pairs = candidates(sides, threshold, once=right is None)
    pairs = cut(pairs)  # few, and matching them is the costly part
    pairs = pairs.withColumns({"similarity": F.round(ratio(F.col("x"), F.col("y")), places), "reverse": F.round(ratio(F.col("y"), F.col("x")), places)})
    return cut(pairs.where(F.greatest("similarity", "reverse") >= threshold))


def similar_pairs(items: DataFrame, key: str, text: str, threshold: float, ranked: bool = False) -> DataFrame:
    """a, b, similarity of items a < b with different texts whose ratio is threshold or more. Equal texts are compared once; the rows are as many as there are such pairs.
    ranked: of texts with copies, only the k-th items of both by key make a row, and what one text has more of goes with the other's last, so rows grow with the
    copies and not with their product; no two texts lose their link."""
    one = items.select(F.col(key).alias("id"), F.col(text).alias("s")).where("s is not null")
    pairs = similar_texts(one, None, threshold)
    side = lambda c: one.select(F.col("s").alias(c), F.col("id").alias(f"i{c}"))
    both = _ranked(pairs, one) if ranked else pairs.join(side("x"), "x").join(side("y"), "y")
    first = F.col("ix") < F.col("iy")
    both = both.withColumns({"a": F.least("ix", "iy"), "b": F.greatest("ix", "iy"), "similarity": F.when(first, F.col("similarity")).otherwise(F.col("reverse"))}).where(F.col("similarity") >= threshold)
    if ranked:  # the ratio may hold in one order of the texts only, which other copies have
        both = both.withColumn("least", F.min("spare").over(Window.partitionBy("x", "y"))).where("spare = least")
    return both.select("a", "b", "similarity")


def _ranked(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """pairs with ix, iy (items of x and y) of equal rank, spare false; and, spare, of the first item of each text with the other's last."""
    items = one.join(pairs.select(F.explode(F.array("x", "y")).alias("s")).distinct(), "s", "left_semi")
    items = cut(items.select("s", "id", F.row_number().over(Window.partitionBy("s").orderBy("id")).alias("k")))
    ends = items.groupBy("s").agg(F.max("k").alias("many"), F.min("id").alias("low"), F.max("id").alias("high"))
    end = lambda c: ends.select(F.col("s").alias(c), *[F.col(name).alias(f"{name}_{c}") for name in ("many", "low", "high")])
    pairs = pairs.join(end("x"), "x").join(end("y"), "y")
    most = F.greatest("many_x", "many_y")

    def side(c: str) -> DataFrame:
        own = items.select(F.col("s").alias(c), F.col("id").alias(f"i{c}"), "k")
        places = F.sequence("k", F.when(F.col("k") == F.col(f"many_{c}"), most).otherwise(F.col("k")))
        return pairs.join(own, c).withColumn("k", F.explode(places))

    rows = side("x").join(side("y").select("x", "y", "k", "iy"), ["x", "y", "k"]).select("x", "y", "similarity", "reverse", "ix", "iy", F.lit(False).alias("spare"))
    spare = pairs.where(most > 1).select("x", "y", "similarity", "reverse", F.explode(F.array(F.struct(F.col("low_x").alias("ix"), F.col("high_y").alias("iy")), F.struct(F.col("high_x").alias("ix"), F.col("low_y").alias("iy")))).alias("i"))
    return rows.unionByName(spare.select("x", "y", "similarity", "reverse", "i.ix", "i.iy", F.lit(True).alias("spare")))
