"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash gives each element one random permutation of the registers, drawn step by step, and value step + r at
the register of that step; so registers are filled evenly (lower variance than independent minima), and an element set
stops once no further step can lower any register. A batch's elements take their steps together.

Plan. Equal sets fold into their smallest id. Signatures are cut into bands. In each bucket members are linked to
its smallest one and verified on their full texts: first each document with the FIRST hubs that it meets most often, then with
those others that are still in another group. Links are grouped. What is left are pairs in different groups in buckets of
three or more. Where the members outside the largest group fit in one block (BLOCK members, BLOCK_SHINGLES shingles), they are compared
with the bucket's blocks on full sets, which takes copies in proportion to its members. Other buckets are split first: sets at 80 % similarity share one of the rarest 20 % of either's shingles, so their members meet by those (counts are taken
over all members of such buckets), and only where different groups meet; no pair is lost. Texts that merely share common
passages don't meet there. Hot shingles are compared block by block. Only one link of each document to each other group leaves a task.

With 32 bands of 4, a pair at similarity 0.8 shares no band with probability 5e-8; pairs that share one are all found.

Cases: texts without words have an empty set, linked with nothing; texts of fewer than k words have their whole
sequence as one shingle; null texts are empty; other columns are ignored; an empty table gives an empty result; a row without
doc_id is linked with nothing and kept (component_id null); rows that repeat a doc_id are one document: each is answered, and a doc_id
with several texts is linked with what any of them is linked with; where that document is kept, all its rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, graph

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
FIRST = 3
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # a block's members and shingles, on average
_BITS = 25
_U = np.uint64


def signatures(elements: np.ndarray, first: np.ndarray, m: int = REGISTERS, chunk: int = 1 << 15) -> np.ndarray:
    """One row of m registers for each set; elements first[i]:first[i + 1] are the i-th set's."""
    out = np.full((len(first) - 1, m), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(elements), chunk):
        part = elements[a : a + chunk]
        owner = np.searchsorted(first[1:], np.arange(a, a + len(part)), "right")
        low, owner = owner[0], owner - owner[0]
        got = _signatures(part, owner, int(owner[-1]) + 1, m)
        out[low : low + len(got)] = np.minimum(out[low : low + len(got)], got)
    return out


def _signatures(element: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    h = np.full((sets, m), 0xFFFFFFFF, np.uint32)
    rank = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
    row, step = np.arange(len(element)), np.arange(1, m + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for j in range(m):
        draw = common.mix(element + step[j])
        k = j + ((draw >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        value = (_U(j) << _U(_BITS) | (draw & _U((1 << _BITS) - 1))).astype(np.uint32)
        place = rank[row, k]
        rank[row, k] = rank[row, j]
        np.minimum.at(h.ravel(), owner * m + place, value)
        open_ = h.max(axis=1) >= (j + 1) << _BITS
        if not open_.any():
            break
        if (go := open_[owner]).sum() < 0.7 * len(go):
            element, owner, rank = element[go], owner[go], rank[go]
            row = np.arange(len(element))
    return h


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), bands (hash of each band), sig (registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            words = common.Words(*common.utf8(b.column(1)))
            s, first = common.shingles(words, k)
            n = np.diff(first)
            sig = signatures(s, first)
            total = np.concatenate((np.zeros(1, _U), np.cumsum(common.mix(s + _U(11)))))
            other = np.concatenate((np.zeros(1, _U), np.cumsum(common.mix(s + _U(13)))))
            d1, d2 = total[first[1:]] - total[first[:-1]], other[first[1:]] - other[first[:-1]]
            rows = sig.reshape(len(n), BANDS, ROWS).astype(_U)
            band = np.tile(common.mix(np.arange(BANDS, dtype=_U) + _U(17)), (len(n), 1))
            for j in range(ROWS):
                band = common.mix(band ^ rows[:, :, j])
            flat = pa.array(band.view(np.int64).ravel())
            at = pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32))
            cols = [b.column(0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(at, flat), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    return common.arrow_map(common.texts(docs, id_col, text_col), run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices([whole], 1 << 20, 2):
                sets = [common.shingles(common.Words(*common.utf8(b.column(i))), k) for i in (2, 3)]
                keep = []
                for i in range(b.num_rows):
                    x, y = (s[f[i] : f[i + 1]] for s, f in sets)
                    both = np.sort(np.concatenate((x, y)))
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(same > 0 and 100 * same >= percent * (len(both) - same))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    one = docs.where("doc_id is not null")
    with_a = pairs.join(one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return common.arrow_map(with_b.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    sk = common.written(sketches(docs, k, id_col, text_col), "sketches")
    own = ["d1", "d2", "n_shingles"]
    full = sk.where("n_shingles > 0 and doc_id is not null")
    rep = common.written(full.groupBy(own).agg(F.min("doc_id").alias("rep")), "representatives")
    reps = full.join(rep.select(*own, F.col("rep").alias("doc_id")), [*own, "doc_id"], "left_semi").dropDuplicates([*own, "doc_id"])
    bands = common.written(reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")), "bands")
    hubs = bands.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    member = common.written(bands.join(hubs, "band"), "members")
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = member.where(F.col("doc_id") != F.col("hub.doc_id")).where(near(F.col("n"), F.col("hub.n")))
    star = star.groupBy(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).count()
    order = Window.partitionBy("a").orderBy(F.desc("count"), "b")  # BANDS rows at most for each text
    star = common.written(star.select("a", "b", F.row_number().over(order).alias("place")), "stars")
    text = candidates(common.texts(docs, id_col, text_col), member.select("doc_id").distinct())
    links = common.written(verified(star.where(F.col("place") <= FIRST).select("a", "b"), text, k, percent).distinct(), "verified")
    roots = common.written(graph.components(links.unionByName(_several(full, rep, own))), "roots")

    others = _rooted(_rooted(star.where(F.col("place") > FIRST), roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    others = common.written(others.select("a", "b"), "others")
    more = [] if others.isEmpty() else [common.written(verified(others, text, k, percent).distinct(), "verified-others")]
    more.append(common.written(residual(member, roots, text, k, percent), "verified-rest"))
    more = [m for m in more if not m.isEmpty()]
    if more:
        joined = reduce(DataFrame.unionByName, [roots.select(F.col("node").alias("a"), F.col("root").alias("b")), *more])
        roots = graph.components(joined)
    root = rep.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*own, F.coalesce("root", "rep").alias("root"))
    found = sk.select("doc_id", *own).join(root, own, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def _several(full: DataFrame, rep: DataFrame, own: list[str]) -> DataFrame:
    """Links between the representatives of the texts of one doc_id, where it has several."""
    many = full.groupBy("doc_id").agg(F.min(F.struct(*own)).alias("x"), F.max(F.struct(*own)).alias("y")).where("x <> y").select("doc_id")
    of = full.join(many, "doc_id", "left_semi").join(rep, own).select("doc_id", F.col("rep").alias("a")).distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").where("a <> b").select("a", "b")


def _rooted(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """df with the root of a node, itself where it has no links."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def candidates(text: DataFrame, ids: DataFrame, most_ids: int = 500_000) -> DataFrame:
    """The texts of the documents that share a bucket with another, written once for all that reads them. A list of ids that is
    small (8 MB) is broadcast, so that the other texts aren't shuffled."""
    ids = common.written(ids, "candidate-ids")
    few = ids.count() <= most_ids
    return common.written(text.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "candidates")


def residual(member: DataFrame, roots: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different groups so far: of each document to each group, one."""
    rest = _rooted(member.where("size > 2").select("band", "doc_id", "n"), roots, "doc_id", "root")
    rest = common.written(rest, "rooted")  # keys and members apart, so that the join can split a key that many have
    rest = common.written(rest.join(common.written(_mixed(rest, "band"), "mixed-keys"), "band"), "mixed")
    placed = rest.where("n_other = 1").withColumnRenamed("band", "key")
    large = common.written(rest.where("n_other > 1").select("doc_id", "n", "root").distinct(), "large")
    if not large.isEmpty():
        rare = common.written(prefixes(large, text, k, percent), "rare")
        placed = placed.unionByName(rare.join(_mixed(rare, "shingle"), "shingle").withColumnRenamed("shingle", "key"))
    return _compared(placed, text, k, percent)


def _mixed(rest: DataFrame, key: str) -> DataFrame:
    """Keys whose members are in several groups: the largest group (top), the blocks of its members and of the others."""
    parts = rest.groupBy(key, "root").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    mixed = parts.groupBy(key).agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.max(F.struct("size", "n")).alias("most"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
    blocks = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    return mixed.where("kinds > 1").select(key, "top", blocks(F.col("most.size"), F.col("most.n")).alias("n_top"), blocks(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n")).alias("n_other"))


def prefixes(members: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """shingle, doc_id, n, root: each member by its rarest shingles, one more than it may lack and still be similar enough.

    Shingles of one member alone meet nobody and are left out. A shingle's members are dealt by AQE's splitting of skewed joins.
    """
    sets = shingle_sets(text.join(members, "doc_id", "left_semi"), k)
    one = sets.select("doc_id", "n", F.explode("shingles").alias("shingle"))
    one = common.written(one.distinct(), "shingles")
    often = common.written(one.groupBy("shingle").count(), "shingle-counts")  # apart, so that hot keys of the join can be split
    ranked = one.join(often, "shingle").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("all"))  # one text's own set
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = ranked.select("doc_id", "n", F.explode(F.slice("all", F.lit(1), spare.cast("int"))).alias("x")).where("x.count > 1")
    return first.select(F.col("x.shingle").alias("shingle"), "doc_id", "n").join(members.select("doc_id", "root").distinct(), "doc_id").select("shingle", "doc_id", "n", "root")


def _compared(rest: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of one key in different groups, compared block by block on full sets; rest: key, doc_id, root, top, n_top, n_other."""
    sets = shingle_sets(text.join(rest.select("doc_id").distinct(), "doc_id", "left_semi"), k).select("doc_id", "n", "set").distinct()
    other = F.col("root") != F.col("top")
    own = F.pmod(F.xxhash64("doc_id"), F.when(other, F.col("n_other")).otherwise(F.col("n_top"))).cast("int")
    rest = rest.join(sets, ["doc_id", "n"]).withColumns({"other": other, "own": own})
    # a cell is a block of other members (i) and a block of the top group's (j) or again of others (-1 - j)
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_top = F.transform(count("n_top"), lambda j: cell(F.col("own"), j))
    with_others = F.transform(count("n_other"), lambda j: cell(F.least("own", j), -1 - F.greatest("own", j)))
    cells = F.when(other, F.concat(with_top, with_others)).otherwise(F.transform(count("n_other"), lambda i: cell(i, F.col("own"))))
    placed = rest.select("key", F.explode(cells).alias("cell"), F.struct("doc_id", "root", "other", "own", "set").alias("m"))
    groups_ = placed.groupBy("key", "cell").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1).select("cell.i", "cell.j", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for r in range(b.num_rows):
                i, j, m = (b.column(c)[r] for c in range(3))
                for x, y in _cell_links(i.as_py(), j.as_py(), m.values, percent):
                    a.append(min(x, y))
                    z.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return common.arrow_map(groups_, run, "a long, b long").distinct()


def _cell_links(i: int, j: int, members: pa.StructArray, percent: int) -> list[tuple[int, int]]:
    """For each member of block i and each other group in the cell, its best link."""
    doc, root, other, own = (members.field(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "root", "other", "own"))
    sets = [np.frombuffer(x, _U) for x in members.field("set").to_pylist()]
    left = np.flatnonzero(other & (own == i))
    right = np.flatnonzero(~other) if j >= 0 else np.flatnonzero(other & (own == -1 - j))
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets])
    kinds, coded = np.unique(np.concatenate([sets[x] for x in right]), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size[right])))[:-1]
    has, found = np.zeros(len(kinds), np.int32), []
    for x in left:
        at = np.minimum(np.searchsorted(kinds, sets[x]), len(kinds) - 1)
        at = at[kinds[at] == sets[x]]
        has[at] = 1
        same = np.add.reduceat(has[coded], first)
        has[at] = 0
        ok = np.flatnonzero((100 * same >= percent * (size[x] + size[right] - same)) & (root[right] != root[x]))
        best: dict[int, int] = {}
        for y in ok[np.argsort(-same[ok], kind="stable")].tolist():
            best.setdefault(int(root[right[y]]), int(doc[right[y]]))
        found += [(int(doc[x]), y) for y in best.values()]
    return found


def shingle_sets(text: DataFrame, k: int) -> DataFrame:
    """doc_id, n, set (the sorted shingle hashes as bytes) and shingles (as an array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            s, first = common.shingles(common.Words(*common.utf8(b.column(1))), k)
            each = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(s.view(np.int64)))
            cols = [b.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array([s[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary()), each]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "set", "shingles"])

    return common.arrow_map(text.select("doc_id", "text"), run, "doc_id long, n long, set binary, shingles array<long>")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns and rows; rows without an id stay."""
    kept = groups(docs, k, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col))
    named = docs.where(F.col(id_col).isNotNull()).join(kept.distinct(), id_col, "left_semi").select(*docs.columns)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
