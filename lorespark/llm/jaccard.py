"""N-gram Jaccard join by vertical partitioning: fragments of the global n-gram order, partial overlaps counted apart and summed per pair.

The global order is that of 64-bit hashes of the k-word shingles. It is cut into fragments of equal width; a text's set falls into one segment a
fragment. Two sets that are similar enough differ in at most d shingles, so with d + 1 + e fragments at least 1 + e of their segments are the same.
Sets are of size classes with a scheme (number of fragments) each; a set also takes part in the scheme of the class below if that holds sets
small enough to be similar. Segments' digests are the join's keys. Slight segments, of fewer than SLIGHT shingles, are none, unless a set has more than e of them: if both sets
have more, they meet by those too, else the same segments can't all be slight. So no link is lost, and texts that merely share frequent shingles or common
passages seldom meet: a whole segment, some six to eight shingles from all over the text, must be the same.

Plan. Equal sets fold into their smallest id. Each set is paired with the smallest one in its buckets, first with the FIRST that it meets most often. For
a pair, the same segments count whole, by their digests; sizes of the others bound the overlap from above, which accepts or rejects most pairs
without their shingles. For what is left, only segments that differ are read again, as rows (text, fragment), which spreads a text with very many
partners over its fragments; each overlap is counted apart, natively, and summed per pair. Links are grouped by star rounds; pairs of other
members that are still in different groups follow, and where a bucket holds several groups at the end its members are compared block by block.

Cases: texts without words have an empty set, linked with nothing; texts of fewer than k words have their whole sequence as one shingle; null texts
are empty; other columns are ignored; an empty table gives an empty result; a row without doc_id is linked with nothing (component_id null);
rows that repeat a doc_id are one document: each is answered, and a doc_id with several texts is linked with what any of them is linked with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, graph, minhash

FIRST, SLIGHT, PAIRED = 1, 3, 128
_U = np.uint64
_CUT = pa.struct([("scheme", pa.int32()), ("whole", pa.bool_()), ("sizes", pa.list_(pa.int32())), ("sigs", pa.list_(pa.int64()))])


class Schemes:
    """Size classes and the number of fragments of each: class s holds sizes low[s] to low[s + 1] - 1."""

    def __init__(self, percent: int, most: int = 1 << 40):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        low = [1]
        while low[-1] < most:
            low.append(max(low[-1] + 1, -(-low[-1] * 122 // percent)))
        self.percent, self.low = percent, np.array(low)
        self.fragments, self.spare = [], []
        for top in low[1:]:
            n = top - 1
            differ = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
            self.spare.append(2 + differ // 13)
            self.fragments.append(differ + 1 + self.spare[-1] if differ else 0)

    def of(self, n: int) -> list[int]:
        """The schemes of a set of n shingles, its own class's last; none if only equal sets are similar."""
        own = int(np.searchsorted(self.low, n, "right")) - 1
        below = own > 0 and (int(self.low[own]) - 1) * 100 >= n * self.percent
        return [s for s in ([own - 1] * below + [own]) if self.fragments[s]]

    def bounds(self, elements: np.ndarray, s: int) -> np.ndarray:
        """Where the fragments of scheme s begin among sorted elements; one more entry for the end."""
        place = (elements >> _U(32)) * _U(self.fragments[s]) >> _U(32)
        return np.searchsorted(place, np.arange(self.fragments[s] + 1, dtype=_U))


def digests(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of two mixes of the elements: differences of them are digests of segments, or of the set."""
    zero = np.zeros(1, _U)
    return tuple(np.concatenate((zero, np.cumsum(common.mix(elements + _U(x))))) for x in (11, 13))


def sketches(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), cuts: for each scheme the sizes and digests of all segments, and whether slight ones count."""
    schemes = Schemes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            s, first = common.shingles(common.Words(*common.utf8(b.column(1)), lower=True), k)
            sum1, sum2 = digests(s)
            own, scheme, whole, sizes, sigs = [0], [], [], [], []
            for x, z in zip(first[:-1], first[1:], strict=True):
                for c in schemes.of(int(z - x)) if z > x else ():
                    at = x + schemes.bounds(s[x:z], c)
                    size = np.diff(at)
                    name = common.mix(np.arange(len(size), dtype=_U) + _U(c << 40))
                    scheme.append(c)
                    whole.append(bool((size < SLIGHT).sum() > schemes.spare[c]))
                    sizes.append(size)
                    sigs.append(common.mix(sum1[at[1:]] - sum1[at[:-1]] ^ name).view(np.int64))
                own.append(len(scheme))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sizes]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *v]).astype(kind))) for v, kind in ((sizes, np.int32), (sigs, np.int64))]
            cuts = pa.StructArray.from_arrays([pa.array(scheme, pa.int32()), pa.array(whole, pa.bool_()), *lists], fields=list(_CUT))
            d1, d2 = (x[first[1:]] - x[first[:-1]] for x in (sum1, sum2))
            cols = [b.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(own, pa.int32()), cuts)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "d1", "d2", "cuts"])

    kind = "doc_id long, n_shingles long, d1 long, d2 long, cuts array<struct<scheme:int,whole:boolean,sizes:array<int>,sigs:array<long>>>"
    return common.arrow_map(common.texts(docs, id_col, text_col), run, kind)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets (a, b; da and db: their d1) that are not ruled out, with scheme, differ (fragments whose segments differ), same (shingles in the
    same segments) and linked (same is enough); sets: doc_id, n, d1, cuts. The common scheme is that of the lower class of the two."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("d1").alias(f"d{x}"), F.col("cuts").alias(f"cuts_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    own = lambda x: F.get(f"cuts_{x}", F.size(f"cuts_{x}") - 1)["scheme"]
    both = both.withColumn("scheme", F.least(own("a"), own("b")))
    cut = lambda x: F.get(F.filter(f"cuts_{x}", lambda c: c["scheme"] == F.col("scheme")), F.lit(0)).alias(x * 2)
    both = both.select("a", "b", "na", "nb", "da", "db", "scheme", cut("a"), cut("b")).where("aa is not null and bb is not null")
    each = F.arrays_zip(F.col("aa.sigs").alias("x"), F.col("bb.sigs").alias("y"), F.col("aa.sizes").alias("p"), F.col("bb.sizes").alias("q"))
    total = lambda value: F.aggregate("each", F.lit(0).cast("long"), lambda s, e: s + value(e))
    most = lambda e: F.least(e["p"], e["q"]) - (e["p"] == e["q"]).cast("int")
    both = both.withColumn("each", each).select(
        "a", "b", "na", "nb", "da", "db", "scheme",
        total(lambda e: F.when(e["x"] == e["y"], e["p"]).otherwise(0)).alias("same"),
        total(lambda e: F.when(e["x"] == e["y"], e["p"]).otherwise(most(e))).alias("most"),
        F.filter(F.transform("each", lambda e, i: F.when((e["x"] != e["y"]) & (e["p"] > 0) & (e["q"] > 0), i)), lambda i: i.isNotNull()).alias("differ"),
    )
    enough = lambda c: F.col(c) * 100 >= (F.col("na") + F.col("nb") - F.col(c)) * percent
    return both.where(enough("most")).withColumn("linked", enough("same"))


def segments(need: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """role, doc_id, d1, scheme, fragment, elements: the segments that are needed; need: role, doc_id, d1, scheme, fragments."""
    schemes = Schemes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            s, first = common.shingles(common.Words(*common.utf8(b.column(1))), k)
            sum1, _ = digests(s)
            digest = (sum1[first[1:]] - sum1[first[:-1]]).view(np.int64)
            row, fragment, part = [], [], []
            d1, scheme = b.column("d1").to_numpy(), b.column("scheme").to_numpy()
            for i in np.flatnonzero(digest == d1).tolist():
                own = s[first[i] : first[i + 1]]
                at = schemes.bounds(own, int(scheme[i]))
                for f in b.column("fragments")[i].values.to_numpy(zero_copy_only=False).tolist():
                    row.append(i)
                    fragment.append(f)
                    part.append(own[at[f] : at[f + 1]])
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32))
            elements = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, _U), *part]).view(np.int64)))
            take = pa.array(row, pa.int64())
            cols = [*[b.column(c).take(take) for c in ("role", "doc_id", "d1", "scheme")], pa.array(fragment, pa.int32()), elements]
            yield pa.RecordBatch.from_arrays(cols, ["role", "doc_id", "d1", "scheme", "fragment", "elements"])

    rows = text.join(need, "doc_id").select("doc_id", "text", "role", "d1", "scheme", "fragments")
    return common.arrow_map(rows, run, "role string, doc_id long, d1 long, scheme int, fragment int, elements array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union."""
    known = common.written(bounded(pairs, sets, percent), "bounded")
    known_links = known.where("linked").select("a", "b")
    apart = known.where("not linked").select("a", "b", "na", "nb", "da", "db", "scheme", "same", F.explode("differ").alias("fragment"))
    need = [apart.groupBy(F.lit(x).alias("role"), F.col(x).alias("doc_id"), F.col(f"d{x}").alias("d1"), "scheme").agg(F.collect_set("fragment").alias("fragments")) for x in "ab"]
    found = common.written(segments(need[0].unionByName(need[1]), text, k, percent), "segments")
    of = lambda x: found.where(F.col("role") == x).select(F.col("doc_id").alias(x), F.col("d1").alias(f"d{x}"), "scheme", "fragment", F.col("elements").alias(f"el_{x}"))
    joined = apart.join(of("a"), ["a", "da", "scheme", "fragment"]).join(of("b"), ["b", "db", "scheme", "fragment"])
    partial = joined.select("a", "b", "na", "nb", "da", "db", "same", F.size(F.array_intersect("el_a", "el_b")).alias("overlap"))
    summed = partial.groupBy("a", "b", "na", "nb", "da", "db", "same").agg(F.sum("overlap").alias("more")).withColumn("n", F.col("same") + F.col("more"))
    return known_links.unionByName(summed.where(F.col("n") * 100 >= (F.col("na") + F.col("nb") - F.col("n")) * percent).select("a", "b")).distinct()


def residual(member: DataFrame, star: DataFrame, roots: DataFrame, sets: DataFrame, text: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Links (a, b) between members of one bucket that are in different groups so far. In buckets of up to PAIRED members each pair of them
    is taken on, which makes PAIRED / 2 pairs a member at most; larger ones that hold several groups are compared block by block."""
    rest = minhash._rooted(member.where("size > 2").select("band", "doc_id", "n", "size"), roots, "doc_id", "root")
    rest = common.written(rest, "rooted")
    mixed = rest.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    small = common.written(rest.where(F.col("size") <= PAIRED).join(mixed, "band", "left_semi"), "mixed")
    side = lambda x: small.select("band", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"root_{x}"))
    pairs = side("b").join(side("a"), "band").where("b < a and root_a <> root_b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = common.written(pairs.select("a", "b").distinct().join(star.select("a", "b"), ["a", "b"], "left_anti"), "pairs-of-buckets")
    large = rest.where(F.col("size") > PAIRED).select("band", "doc_id", "n", "size").join(mixed, "band", "left_semi")
    out = [] if pairs.isEmpty() else [confirmed(pairs, sets, text, k, percent)]
    large = common.written(rest.where(F.col("size") > PAIRED).join(mixed, "band", "left_semi").select("band", "doc_id", "n", "size"), "large-mixed")
    return out if large.isEmpty() else [*out, minhash.residual(large, roots, text, k, percent)]


def groups(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    sk = common.written(sketches(docs, k, percent, id_col, text_col), "cuts")
    own = ["d1", "d2", "n_shingles"]
    full = sk.where("n_shingles > 0 and doc_id is not null").select("doc_id", *own)
    rep = common.written(full.groupBy(own).agg(F.min("doc_id").alias("rep")), "representatives")
    sets = sk.where("n_shingles > 0").join(rep.select(*own, F.col("rep").alias("doc_id")), [*own, "doc_id"], "left_semi").dropDuplicates([*own, "doc_id"])
    sets = common.written(sets.select("doc_id", F.col("n_shingles").alias("n"), "d1", "cuts"), "sets")
    counted = F.when(F.col("cut.whole"), F.col("cut.sigs")).otherwise(F.filter("cut.sigs", lambda _, i: F.get("cut.sizes", i) >= SLIGHT))
    marks = sets.select("doc_id", "n", F.explode("cuts").alias("cut")).select("doc_id", "n", F.explode(counted).alias("band"))
    hubs = common.written(marks.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    member = common.written(marks.join(hubs, "band"), "members")
    star = member.where("doc_id <> hub").groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).count()
    order = Window.partitionBy("a").orderBy(F.desc("count"), "b")  # one text's hubs, as many as its segments at most
    star = common.written(star.select("a", "b", F.row_number().over(order).alias("place")), "stars")
    text = minhash.candidates(common.texts(docs, id_col, text_col), member.select("doc_id").distinct())
    links = common.written(confirmed(star.where(F.col("place") <= FIRST).select("a", "b"), sets, text, k, percent), "confirmed")
    roots = common.written(graph.components(links.unionByName(minhash._several(full, rep, own))), "roots")

    others = minhash._rooted(minhash._rooted(star.where(F.col("place") > FIRST), roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    others = common.written(others.select("a", "b"), "others")
    more = [] if others.isEmpty() else [common.written(confirmed(others, sets, text, k, percent), "confirmed-others")]
    more += [common.written(m, "confirmed-rest") for m in residual(member, star, roots, sets, text, k, percent)]
    if more := [m for m in more if not m.isEmpty()]:
        roots = graph.components(reduce(DataFrame.unionByName, [roots.select(F.col("node").alias("a"), F.col("root").alias("b")), *more]))
    root = rep.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*own, F.coalesce("root", "rep").alias("root"))
    found = sk.select("doc_id", *own).join(root, own, "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
