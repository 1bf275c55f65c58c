"""Text functions: normalisation, tokens, n-grams, canonical identities."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

TOKEN = r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*"
# Code point ranges whose runs give single characters and neighbouring pairs.
UNSPACED = r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0002FA1F"
_LETTER = rf"(?:(?![{UNSPACED}])[^\W_])"
_MIXED = re.compile(rf"(?P<run>[{UNSPACED}]+)|{_LETTER}(?:[._-]?{_LETTER})*(?:[._-](?=[{UNSPACED}]))?")


def tokens(text: Column) -> Column:
    """Lower-cased words that may join over . _ and -; for scripts that separate words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def mixed_tokens(text: str | None) -> list[str]:
    """Words of compatibility-normalised, case-folded text, as one pattern has them: words may join over . _ and -; a run of a
    script without word breaks gives its characters, then its neighbouring pairs."""
    out: list[str] = []
    for m in _MIXED.finditer(unicodedata.normalize("NFKC", text or "").casefold()):
        run = m["run"]
        out.extend([m[0]] if run is None else [*run, *map("".join, zip(run, run[1:], strict=False))])
    return out


def mixed_script_tokens(text: Column) -> Column:
    def of(s: pd.Series) -> pd.Series:
        return s.map(mixed_tokens)

    return pandas_udf(of, ArrayType(StringType()))(text)


def folded_label(text: Column) -> Column:
    """Compatibility-normalised, trimmed, case-folded, white space collapsed."""

    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).strip().casefold()))

    return pandas_udf(of, StringType())(text)


def label(text: Column) -> Column:
    """The native form of folded_label, for texts without special folding."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def squeezed(text: Column) -> Column:
    """Lower-cased without any white space, for leakage comparisons."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


# The entities that texts of web pages have most, and their characters; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """text with the usual entities as characters."""
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def characters(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.split(text, "")


def _joined(text: Column, n: int, short: Column) -> Column:
    """Each n neighbouring characters as a string, in order: shifted slices of the characters, which are taken apart once."""

    def of(c: Column) -> Column:
        out = c
        for i in range(1, n):
            out = F.zip_with(out, F.slice(c, i + 1, F.greatest(F.size(c) - i, F.lit(0))), lambda x, y: F.concat(x, y))
        return F.when(F.size(c) >= n, F.slice(out, F.lit(1), F.size(c) - n + 1)).otherwise(short)

    return F.get(F.transform(F.array(characters(text)), of), F.lit(0))


def neighbours(text: Column) -> Column:
    """The pairs of neighbouring characters, in order; none in texts of one character."""
    return _joined(text, 2, F.array().cast("array<string>"))


def character_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters; a shorter text is its own."""
    return F.array_distinct(_joined(text, n, F.array(text)))


def jaccard(a: Column, b: Column) -> Column:
    of = lambda both: F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))
    return F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), of), F.lit(0))


def contains_word(text: Column, term: Column) -> Column:
    """Whether term stands in text between characters that aren't ASCII word characters; other terms: anywhere."""
    quoted = F.regexp_replace(term, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    bounded = F.regexp(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), quoted, F.lit(r"(?![A-Za-z0-9_])")))
    return F.when(term.rlike(r"^[\x00-\x7F]+$"), bounded).otherwise(F.contains(text, term))


def occurs(text: Column, term: Column) -> Column:
    """Verbatim, or with all but word characters left out on both sides."""
    bare = lambda c: F.regexp_replace(c, r"[^\w]+", "")
    return F.contains(text, term) | ((F.length(bare(term)) > 0) & F.contains(bare(text), bare(term)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces and nulls kept; nested structs must be sorted by the caller."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def identity(kind: str, payload: dict[str, Column], version: str = "2.0") -> Column:
    """{kind}_v2_ and the SHA-256 of the canonical JSON of version, kind and payload."""
    inner = F.struct(*[payload[k].alias(k) for k in sorted(payload)])
    envelope = canonical_json({"identity_schema_version": F.lit(version), "kind": F.lit(kind), "payload": inner})
    return F.concat(F.lit(f"{kind}_v2_"), F.sha2(envelope, 256))


def pair_identity(kind: str, a: Column, b: Column) -> Column:
    """The same for both orders of a and b."""
    return identity(kind, {"first": F.least(a, b), "second": F.greatest(a, b)})


def name_uuid(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, natively: SHA-1 over the namespace's bytes and the name's."""
    raw = F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Long spellings of column types and the short ones.
TYPE_SPELLINGS = {"character varying": "varchar", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "timetz"}


def clean_type(name: Column) -> Column:
    """A column type in its short spelling, lower case, with its length or precision; spaces collapse, those at commas go.
    Null for blank names and for names with control characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), r" ?, ?", ",")
    for long, short in TYPE_SPELLINGS.items():
        s = F.replace(s, F.lit(long), F.lit(short))
    return F.when((F.length(s) > 0) & ~s.rlike(r"\p{C}"), s)


def clean_comment(text: Column, most: int = 1000) -> Column:
    """Control characters become spaces, white space collapses, and the length is bounded."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), 1, most)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
