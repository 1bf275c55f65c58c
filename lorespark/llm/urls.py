"""URL filters: rules by host and path, and for all other URLs the likelihood ratio of two character models.

Two variable-order Markov models (up to two characters of context, Witten-Bell smoothing towards shorter contexts) are
trained on accepted and on rejected URLs, each text once, so that no host weighs by its pages: those that rules allow, and those
that rules block or that have a rejected term as a whole word of host or path. The last labels of the host that rules name, and first segments
of the path as long as those that rules name (en, so also es), are left out of what the models read, for they would only learn the rules again; all else of host and
path is read, numbers folded. A URL is blocked
if its log-likelihood difference per character lies below a threshold, calibrated on a fifth of the accepted texts and of those with
a rejected term, both kept from training. Both models are tables over 41 symbols cubed, whatever the input, so their join is a broadcast
of bounded size. Only DataFrame functions are used.

Cases: a null URL or one without "://" has an empty host and path and is judged on the empty text (allowed); equal URLs are scored
once; without accepted or without rejected training URLs nothing is blocked by the models; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
REJECTED_TERMS = ("adult", "ads", "bets", "casino", "escort", "malware", "phish", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "xxx")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789.-/_"
SIZE = len(SYMBOLS) + 1  # and one for all others and the ends
ACCEPTED_LOSS = 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to /, ? or #, A-Z lower-cased; path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """df (host, path) with rule (its text, null if none fits), ruled (allow or block) and stem (what the rule leaves)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = F.col("host"), F.col("path")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    labels = [h.split(".") for _, h, _ in rules]
    segments = [p.strip("/").split("/") for _, _, p in rules if p.strip("/")]
    own, tail = host, path
    if labels:
        named = "|".join(sorted({re.escape(x) for h in labels for x in h}))
        own = F.regexp_replace(host, rf"(?:^|\.)(?:{named})(?:\.(?:{named})){{0,{max(map(len, labels)) - 1}}}$", "")
    if segments:
        sizes = "|".join(f"[^/]{{{n}}}" for n in sorted({len(x) for p in segments for x in p}))
        tail = F.regexp_replace(path, f"^(?:/(?:{sizes})(?=/|$)){{0,{max(map(len, segments))}}}", "")
    tail = F.regexp_replace(tail, r"[0-9]+", "0")
    return df.withColumns({"rule": rule, "ruled": ruled, "stem": F.concat(own, F.lit("/"), F.lower(tail))})


def grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and gram: number of each three neighbouring symbols of stem (two ends before it, one after)."""
    coded = F.transform(F.split("stem", ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(SYMBOLS), c)))
    codes = F.concat(F.array(F.lit(0), F.lit(0)), coded, F.array(F.lit(0)))
    df = df.select(*keys, codes.alias("codes"))
    each = F.transform(F.sequence(F.lit(0), F.size("codes") - 3), lambda i: (F.get("codes", i) * SIZE + F.get("codes", i + 1)) * SIZE + F.get("codes", i + 2))
    return df.select(*keys, F.explode(each).alias("gram"))


def ratios(counted: DataFrame) -> DataFrame:
    """gram and ratio (ln of its probability when accepted less that when rejected), over all SIZE ** 3 grams."""
    grid = counted.sparkSession.range(SIZE**3).select(F.col("id").cast("int").alias("gram"))
    df = grid.join(counted.select("gram", "good", "bad"), "gram", "left").na.fill(0, ["good", "bad"])
    df = df.withColumns({"x": F.col("gram") % SIZE, "b": F.floor(F.col("gram") / SIZE) % SIZE, "a": F.floor(F.col("gram") / SIZE**2)})
    for c in ("good", "bad"):
        one = lambda *by: F.sum(c).over(Window.partitionBy(*by))  # noqa: B023, E731
        df = df.withColumns({f"{c}_bx": one("b", "x"), f"{c}_b": one("b"), f"{c}_ab": one("a", "b"), f"{c}_x": one("x")})
        kinds = lambda v, *by: F.size(F.collect_set(F.when(F.col(v) > 0, F.col("x"))).over(Window.partitionBy(*by)))
        df = df.withColumns({f"{c}_tab": kinds(c, "a", "b"), f"{c}_tb": kinds(f"{c}_bx", "b")})
        total = F.sum(c).over(Window.partitionBy(F.col("gram") * 0))
        p0 = (F.col(f"{c}_x") + 1) / (total + SIZE)
        p1 = (F.col(f"{c}_bx") + F.col(f"{c}_tb") * p0) / F.greatest(F.col(f"{c}_b") + F.col(f"{c}_tb"), F.lit(1))
        p1 = F.when(F.col(f"{c}_b") > 0, p1).otherwise(p0)
        p2 = (F.col(c) + F.col(f"{c}_tab") * p1) / F.greatest(F.col(f"{c}_ab") + F.col(f"{c}_tab"), F.lit(1))
        df = df.withColumn(f"{c}_p", F.when(F.col(f"{c}_ab") > 0, p2).otherwise(p1))
    return df.select("gram", (F.log("good_p") - F.log("bad_p")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, terms=REJECTED_TERMS, loss: float = ACCEPTED_LOSS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (of URLs without a rule: mean log-likelihood difference)."""
    host, path = parts(F.coalesce(F.col(url_col), F.lit("")))
    df = with_rule(pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)
    term = F.arrays_overlap(F.split("stem", "[^a-z]+"), F.array(*map(F.lit, terms)).cast("array<string>"))
    df = df.withColumn("stem", F.coalesce("stem", F.lit("")))
    has = lambda v: F.max((F.col("ruled") == v).cast("int"))
    stems = df.groupBy("stem").agg(F.coalesce(has("allow"), F.lit(0)).alias("good"), F.coalesce(has("block"), F.lit(0)).alias("bad"))
    stems = stems.withColumns({"bad": F.when(term, 1).otherwise(F.col("bad")), "good": F.when(term, 0).otherwise(F.col("good"))})
    stems = stems.withColumn("aside", (F.pmod(F.xxhash64("stem"), F.lit(5)) == 0) & ((F.col("good") > 0) | term))
    counted = grams(stems.where("good + bad > 0 and not aside"), ["good", "bad"]).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    table = ratios(counted)
    scored = grams(stems, ["stem", "aside", "good"]).join(F.broadcast(table), "gram").groupBy("stem", "aside", "good").agg(F.avg("ratio").alias("score"))
    scored = common.written(scored, "scored-stems")  # apart, so that the join below can split a stem that most pages share
    cut, good, bad = _threshold(scored, stems, loss)
    score = F.when(F.lit(bool(good and bad)), F.col("score")).otherwise(F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(score < cut, "block").otherwise("allow"))
    return df.join(scored.select("stem", "score"), "stem").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.round(score, 6)).alias("score"))


def _threshold(scored: DataFrame, stems: DataFrame, loss: float) -> tuple[float, int, int]:
    """Halfway between the score below which the stated share of accepted URLs falls and that above which as many with a
    rejected term lie (both of those kept from training); without the latter, the former; at most 0, where the models agree."""
    quantile = lambda good, q: F.expr(f"percentile_approx(score, {q}, 10000) FILTER (WHERE good = {good})")
    low, high = scored.where("aside").agg(quantile(1, loss), quantile(0, 1 - loss)).first()
    low = min(0.0, low if low is not None else 0.0)
    n = stems.agg(F.sum("good"), F.sum("bad")).first()
    return (low + high) / 2 if high is not None and high < low else low, n[0] or 0, n[1] or 0
