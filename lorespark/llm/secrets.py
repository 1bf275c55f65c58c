"""Secret scans: fixed forms, and a randomness test battery with length-aware false-discovery control.

Fixed forms are assignments, access keys and long hex runs. The battery takes other runs of 20 or more token characters,
infers an encoding (hex, base32, letters and digits, base64) and computes three statistics: chi-squared of the symbol counts against
a uniform alphabet, the number of runs of character classes, and the serial correlation of neighbouring symbols. Each becomes a
p-value under two hypotheses, and the three are combined by Fisher's method:

* uniform: the run is random over its alphabet (chi-squared one-sided, the others two-sided);
* natural: the run is text whose symbols coincide, whose classes stay and whose neighbours resemble each other at least as much as the
  stated bounds say (one-sided tests).

Benjamini-Hochberg runs over all runs of the corpus within each length class, twice: runs rejected as uniform are no secrets;
of the others, those rejected as natural are. Both thresholds come from one histogram of p-values. Only Spark expressions are used.

Cases: null texts are empty; texts without findings have zero counts and the hash of nothing; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored, or carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

ASSIGN = r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
NATURAL_COINCIDENCE = 0.06  # least share of equal symbol pairs in natural text, of any language: the sum of squared symbol shares
NATURAL_SPREAD = 0.002  # most variance of a symbol's share in natural text: the sum of cubed shares less the square of the former
NATURAL_SWITCHES = 0.12  # most neighbours in natural text that differ in character class, as a share
ONE_CASE_SWITCHES = 0.06  # the same where letters are of one case, so that only digits interrupt them
CLASSES = (32, 48, 1 << 30)  # upper ends of the length classes
RATE, BINS = 0.05, 320
LENIENT = 2.0  # -log10 p below which no run is called uneven, however many runs the corpus has

_encodings = ((16, "^[0-9a-f]+$", "0123456789abcdef"), (16, "^[0-9A-F]+$", "0123456789ABCDEF"), (32, "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (36, "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"), (36, "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (62, "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (64, ".", "+-/_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def _fixed(text: Column) -> list[Column]:
    enough = lambda t, whole: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 6)
    return [native.spans(text, ASSIGN, "assign", 0, enough), native.spans(text, ACCESS, "access", 1), native.spans(text, HEX, "hex", 2)]


def _pick(token: Column, values: list) -> Column:
    """By the token's encoding."""
    out = F.lit(values[-1])
    for (_, shape, _), v in list(zip(_encodings, values, strict=True))[-2::-1]:
        out = F.when(token.rlike(shape), F.lit(v)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """struct<chi, z_chi, z_runs, z_serial, uniform, natural>: the statistics, and -log10 p of the combined tests."""
    body = F.rtrim(token, F.lit("="))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def parts(s: Column) -> Column:
        t, alphabet = s["t"], s["alphabet"]
        chars = F.split(t, "")
        counts = F.transform(F.array_distinct(chars), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        kinds = F.split(F.translate(t, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", "0" * 10 + "A" * 26 + "a" * 26 + "+" * 4), "")
        share = lambda p: F.length(F.regexp_replace(alphabet, p, "")) / F.length(alphabet)
        same = sum((share(p) * share(p) for p in ("[^0-9]", "[^A-Z]", "[^a-z]", "[^+/_-]")), F.lit(0.0))
        code = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double"))
        n = F.greatest(F.length(t), F.lit(2)).cast("double")
        pairs = total(F.transform(counts, lambda c: c * (c - 1)))
        return F.struct(s["k"].cast("double").alias("k"), n.alias("n"), pairs.alias("pairs"), kinds.alias("kinds"), same.alias("same"), code.alias("code"), (total(code) / n).alias("mean"))

    def tests(s: Column) -> Column:
        n, k, same = s["n"], s["k"], s["same"]
        next_to = lambda x, f: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)
        chi = k / n * (s["pairs"] + n) - n
        m = k - 1  # Wilson and Hilferty's transform
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / m, F.lit(1 / 3)) - (1 - 2 / (9 * m))) / F.sqrt(2 / (9 * m))
        runs = 1.0 + total(next_to(s["kinds"], lambda x, y: (x != y).cast("double")))
        z_runs = (runs - 1 - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same) + 0.25)
        dev = F.transform(s["code"], lambda c: c - s["mean"])
        spread = F.greatest(total(F.transform(dev, lambda d: d * d)), F.lit(1e-9))
        z_serial = (total(next_to(dev, lambda x, y: x * y)) / spread + 1 / n) * F.sqrt(n)
        return F.struct(k.alias("k"), n.alias("n"), s["pairs"].alias("pairs"), runs.alias("runs"), chi.alias("chi"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"))

    def logs(s: Column) -> Column:
        """-ln p of each test, under both hypotheses."""
        c, n = NATURAL_COINCIDENCE, s["n"]
        spread = F.sqrt(2 * c * (1 - c) / (n * (n - 1)) + 4 * NATURAL_SPREAD / n)
        even = native.let((c - s["pairs"] / (n * (n - 1))) / spread, lambda z: F.when(z > 0, z * z / 2 + F.log(z * math.sqrt(2 * math.pi) + 2)).otherwise(0.0))
        q = F.when(s["k"] <= 36, ONE_CASE_SWITCHES).otherwise(NATURAL_SWITCHES)
        chernoff = lambda r: F.when(r > q, (n - 1) * (r * F.log(r / q) + (1 - r) * F.log((1 - r) / (1 - q)))).otherwise(0.0)
        switches = native.let(F.least((s["runs"] - 1) / (n - 1), F.lit(1 - 1e-9)), chernoff)
        alike = native.let(s["z_serial"], lambda z: -F.log(1 - _upper(z)))  # neighbours of natural text don't repel each other
        both_sides = F.transform(F.array(s["z_runs"], s["z_serial"]), lambda z: -F.log(F.greatest(2 * _upper(F.abs(z)), F.lit(1e-300))))
        uniform = native.let(s["z_chi"], lambda z: -F.log(_upper(z))) + total(both_sides)
        return F.struct(*[s[x].alias(x) for x in ("chi", "z_chi", "z_runs", "z_serial")], uniform.alias("u"), (even + switches + alike).alias("v"))

    def combined(s: Column) -> Column:
        return F.struct(*[s[x].alias(x) for x in ("chi", "z_chi", "z_runs", "z_serial")], _fisher(s["u"]).alias("uniform"), _fisher(s["v"]).alias("natural"))

    start = F.struct(body.alias("t"), _pick(body, [k for k, _, _ in _encodings]).alias("k"), _pick(body, [a for _, _, a in _encodings]).alias("alphabet"))
    return native.let(native.let(native.let(native.let(start, parts), tests), logs), combined)


def _upper(z: Column) -> Column:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 26.2.17, to 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.least(F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300)), F.lit(1 - 1e-12))


def _fisher(logs: Column) -> Column:
    """-log10 p of three tests, from the sum of their -ln p."""
    return (logs - F.log(1 + logs + logs * logs / 2)) / math.log(10)


def _class(length: Column) -> Column:
    return sum(((length >= c).cast("int") for c in CLASSES[:-1]), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.floor(p * 10), F.lit(BINS - 1)).cast("int")


def least_rejected(counts: list[int], rate: float = RATE) -> float:
    """The least -log10 p that Benjamini-Hochberg rejects, from the numbers of runs by tenths of it; infinite if none."""
    m, above, best = sum(counts), 0, math.inf
    for b in range(len(counts) - 1, 0, -1):
        above += counts[b]
        if above and 10 ** (-b / 10) * m <= rate * above:
            best = b / 10
    return best


def thresholds(runs: DataFrame) -> list[tuple[float, float]]:
    """For each length class from which -log10 p on a run is uneven, and from which it isn't natural; over all runs (found, test)."""
    bins = runs.groupBy(_class(F.length("found")).alias("class"), _bin(F.col("test.uniform")).alias("u"), _bin(F.col("test.natural")).alias("n"))
    rows = bins.count().collect()  # at most classes * BINS * BINS
    out = []
    for c in range(len(CLASSES)):
        own = [r for r in rows if r["class"] == c]
        uniform, natural = [0] * BINS, [0] * BINS
        for r in own:
            uniform[r["u"]] += r["count"]
        uneven = max(least_rejected(uniform), LENIENT)
        for r in own:
            natural[r["n"] if r["u"] / 10 < uneven else 0] += r["count"]
        out.append((uneven, least_rejected(natural)))
    return out


def _runs(text: Column) -> Column:
    return native.spans(text, RUN, "random", 3)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text, found (array of start, rank, end, kind, found, by start and rank); row if carried."""
    rest = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] * carry
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    runs = df.where(F.col("text").rlike(RUN)).select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("found"))
    least = thresholds(runs.select("found", battery(F.col("found")).alias("test")))

    base = F.concat(*_fixed(F.col("text")))

    def free(x: Column, base: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    def secret(x: Column) -> Column:
        limit = lambda i: F.get(F.array(*[F.lit(float(v[i])) for v in least]), _class(F.length(x["found"])))
        found = lambda t: (_bin(t["uniform"]) / 10 < limit(0)) & (_bin(t["natural"]) / 10 >= limit(1))
        return F.get(F.transform(F.array(battery(x["found"])), found), F.lit(0))

    df = df.withColumn("base", base).withColumn("runs", _runs(F.col("text")))
    extra = F.when(F.size("runs") > 0, F.filter("runs", lambda x: free(x, F.col("base")) & secret(x))).otherwise(F.col("runs"))
    return df.select("doc_id", "text", F.array_sort(F.concat("base", extra)).alias("found"), *["row"] * carry)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return find(docs, id_col, text_col).select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "random")], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with all their columns; every span in the text gives way to the mark (spans that touch, to one), and
    length_col, if any, is the new length. Texts without findings stay as they are, nulls too."""

    def merge(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        grown = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["end"]).alias("b"))))
        return F.when((F.size(s) > 0) & (F.element_at(s, -1)["b"] >= x["start"]), grown).otherwise(F.concat(s, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b")))))

    df = find(docs, id_col, text_col, carry=True)
    spans = F.aggregate("found", F.array().cast("array<struct<a:long,b:long>>"), merge)
    df = df.withColumn("merged", F.when(F.size("found") > 0, spans).otherwise(F.array().cast("array<struct<a:long,b:long>>")))
    n = F.size("merged")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("merged"), i - 1)["b"])
    end = lambda i: F.when(i == n, F.length("text")).otherwise(F.get(F.col("merged"), i)["a"])
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("text"), (start(i) + 1).cast("int"), (end(i) - start(i)).cast("int")))
    new = F.when(n > 0, F.array_join(gaps, mark)).otherwise(F.col(f"row.{text_col}"))
    df = df.withColumn("new", new)
    changed = {text_col: F.col("new")} | ({length_col: F.when(n > 0, F.length("new")).otherwise(F.col(f"row.{length_col}"))} if length_col else {})
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])
