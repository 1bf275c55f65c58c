"""Column expressions that the native operators share: matches with their places, and keyed permutations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body) -> Column:
    """body of the value, evaluated once: what a lambda closes over would be evaluated again at each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(lengths: Column, gaps: Column) -> Column:
    """Start (0-based) of each match: the sum of gaps up to it and of matches before it.

    Two levels of sums, so that a text with many matches takes about n * 64 steps, not n * n.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def of_blocks(s: Column) -> Column:
        def start(x: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            return F.get(s["before"], b) + total(F.slice(s["step"], b * _BLOCK + 1, i - b * _BLOCK)) + F.get(s["gaps"], i)

        return F.transform(s["step"], start)

    def of_sums(s: Column) -> Column:
        before = F.transform(s["sums"], lambda _, b: total(F.slice(s["sums"], F.lit(1), b)))
        return let(F.struct(s["step"].alias("step"), s["gaps"].alias("gaps"), before.alias("before")), of_blocks)

    def of_steps(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(s["step"]) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(s["step"], b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(F.struct(s["step"].alias("step"), s["gaps"].alias("gaps"), sums.alias("sums")), of_sums)

    step = F.zip_with(lengths, F.slice(gaps, F.lit(1), F.size(lengths)), lambda n, g: n + g)  # a gap and its match
    return let(F.struct(step.alias("step"), gaps.alias("gaps")), of_steps)


def spans(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """array<struct<start, rank, end, kind, found>> of the leftmost non-overlapping matches, in code points.

    keep: (text, whole matches) -> array of booleans for which matches count.
    """
    kind_of = "array<struct<start:long,rank:int,end:long,kind:string,found:string>>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    kept = keep(text, whole) if keep else F.transform(whole, lambda x: F.lit(True))

    def placed(s: Column) -> Column:
        lengths = F.transform(s["w"], lambda x: F.length(x).cast("long"))
        return F.arrays_zip(starts(lengths, s["g"]).alias("a"), s["w"].alias("w"), s["k"].alias("k"))

    at = let(F.struct(whole.alias("w"), gaps.alias("g"), kept.alias("k")), placed)
    rows = F.transform(F.filter(at, lambda x: x["k"]), lambda x: F.struct(x["a"].alias("start"), F.lit(rank).alias("rank"), (x["a"] + F.length(x["w"])).alias("end"), F.lit(kind).alias("kind"), x["w"].alias("found")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array()).cast(kind_of)


def replaced(text: Column, pattern: str, by) -> Column:
    """text with every match m of the pattern replaced by by(m)."""
    gaps = F.split(text, pattern, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), by)
    joined = F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _draw(key: str, kind, i: Column, x: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), i.cast("string"), x.cast("string"), modulus.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, kind, rounds: int = 10) -> Column:
    """struct<a, b>: a keyed permutation of the pairs a < mod_a, b < mod_b (an even number of rounds keeps the halves)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        m = F.when(i % 2 == 0, mod_a).otherwise(mod_b).cast("long")
        return F.struct(s["b"].alias("a"), ((s["a"] + _draw(key, kind, i, s["b"], m)) % m).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)


_CHUNK = 22  # digits of base 36 in two halves that a long holds


def permuted_digits(digits: Column, key: str, kind: str, base: int = 10) -> Column:
    """A string of digits of the base (10 or 36, lower case), permuted within its length; long ones chunk by chunk."""
    power = F.array(*[F.lit(base**k) for k in range(_CHUNK // 2 + 1)])
    shown = lambda x, n: F.lpad(x.cast("string") if base == 10 else F.lower(F.conv(x.cast("string"), 10, base)), n, "0")

    def one(c: Column, i: Column) -> Column:
        n = F.length(c)
        u = F.floor(n / 2).cast("int")
        left, right = (F.conv(x, base, 10).cast("long") for x in (F.concat(F.lit("0"), F.substring(c, F.lit(1), u)), F.substring(c, u + 1, n - u)))
        got = feistel(left, right, F.get(power, u), F.get(power, n - u), key, F.concat_ws("/", F.lit(kind), i.cast("string")))
        return let(got, lambda s: F.concat(F.when(u > 0, shown(s["a"], u)).otherwise(F.lit("")), shown(s["b"], n - u)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / _CHUNK).cast("int")), lambda i: F.substring(digits, i * _CHUNK + 1, F.lit(_CHUNK)))
    return F.when(F.length(digits) == 0, digits).otherwise(F.array_join(F.transform(chunks, one), ""))


def walked(start: Column, step, ok, most: int = 64) -> Column:
    """step(start), step of that and so on, to the first value that is ok: a permutation of the values that are, if step is one."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), step(start), lambda s, _: F.when(ok(s), s).otherwise(step(s)))


def permuted_number(x: Column, size: int, key: str, kind: str, ok=lambda v: F.lit(True)) -> Column:
    """A number below size that is ok, permuted among those: the Feistel over the next square, walked until it falls among them."""
    side = int(size**0.5)
    side += side * side < size
    step = lambda v: let(feistel(F.floor(v / side), v % side, F.lit(side), F.lit(side), key, kind), lambda s: s["a"] * side + s["b"])
    return walked(x.cast("long"), step, lambda s: (s < size) & ok(s))


def luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits, as a string."""
    digit = lambda c, i: F.when(i % 2 == 0, F.floor(c * 2 / 10) + c * 2 % 10).otherwise(c)
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: digit(c.cast("int"), i))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda s, v: s + v)
    return ((10 - total % 10) % 10).cast("string")


def luhn_valid(digits: Column) -> Column:
    return luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)


def likeness(a: Column, b: Column, bits: int) -> Column:
    """Share of equal bits of two arrays of longs."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return 1 - apart / bits
