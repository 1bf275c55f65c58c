"""Personal data: format-preserving Feistel pseudonyms, in Spark expressions alone.

Card numbers (13 to 19 digits, Luhn), phone numbers (assigned country codes, 7 to 15 digits), IPv4 addresses, bank accounts (IBAN,
modulo 97), social security numbers, calendar dates and mail addresses are validated, then permuted by a keyed Feistel network within
their format: equal values get equal pseudonyms in every document and spelling, different values different ones. Check digits
stay right, separators in place, country codes and the last label of a mail's domain as they are; social security numbers stay
valid ones, dates stay dates. There is one permutation of days for all spellings; it keeps days after the 12th of a month among themselves, so that a
month-first date (which no day-first date can be) stays one. Letters and digits of mail names and domains are permuted as digits of
base 36, in lower case: a label of one letter has 36 images, and letters beyond ASCII next to a mail name are no part of it. The permutation needs no table, so nothing is gathered or
joined. The key is a secret: there is no default.

Cases: null texts stay null and empty ones empty, with no findings; a null doc_id stays null; repeated rows each give a row; an empty
table gives an empty result; other columns are ignored; an empty key is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
DATE = r"(?<![\w-])(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]\d[./][01]\d[./](?:19|20)\d\d|[01]\d/[0-3]\d/(?:19|20)\d\d)(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
CARD = r"(?<![\w.-])\d{13,19}(?![\w-])|(?<![\w.-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\w-])"
ANY = "|".join(f"(?:{p})" for p in (MAIL, IP, DATE, IBAN, SSN, PHONE, CARD))
KINDS = ("mail", "ip", "date", "iban", "ssn", "phone", "card")
# The country codes of one and two digits; all others have three.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
EPOCH, DAYS = "1900-01-01", 73049  # to 2099-12-31


def kind_of(m: Column) -> Column:
    """The kind of a match, null where its validation fails."""
    digits = F.regexp_replace(m, r"\D", "")
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "mail")
        .when(whole(IP), "ip")
        .when(whole(DATE), F.when(_days(m).between(0, DAYS - 1), "date"))
        .when(m.rlike("^[A-Z]{2}"), F.when(_iban_rest(F.regexp_replace(m, " ", "")) == 1, "iban"))
        .when(whole(SSN), F.when(_ssn_valid(digits), "ssn"))
        .when(whole(CARD), F.when(native.luhn_valid(digits), "card"))
        .when(F.length(digits).between(7, 15) & (~m.startswith("+") | digits.rlike(f"^{COUNTRY}")), "phone")
    )


def _ssn_valid(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|9)|^.{3}00|0000$")


def _month_first(m: Column) -> Column:
    return m.rlike(r"^[01]\d/(?:1[3-9]|[23]\d)/")


def _date(m: Column) -> Column:
    part = lambda *at: F.concat_ws("-", *[F.substring(m, a, n) for a, n in at])
    iso = F.when(m.rlike(r"^\d{4}"), m).when(_month_first(m), part((7, 4), (1, 2), (4, 2))).otherwise(part((7, 4), (4, 2), (1, 2)))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _days(m: Column) -> Column:
    return F.coalesce(F.datediff(_date(m), F.lit(EPOCH).cast("date")), F.lit(-1))


def _iban_rest(s: Column) -> Column:
    """Remainder of an account number modulo 97, letters as 10 to 35."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("long"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _laid_back(m: Column, digits: Column) -> Column:
    """The digits in m's places, separators kept."""
    gaps = F.split(m, "[0-9]", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")


def _laid_in(m: Column, signs: Column, kind: str = "[A-Za-z0-9]") -> Column:
    """The signs, one by one, in the places that m has for them."""
    return F.array_join(F.transform(F.split(m, kind, -1), lambda g, i: F.concat(g, F.substring(signs, i + 1, F.lit(1)))), "")


def _mail(m: Column, key: str) -> Column:
    """Letters and digits of the name and of all labels of the domain but the last, permuted as digits of base 36."""
    name, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)))
    new = lambda x, kind: _laid_in(x, native.permuted_digits(F.regexp_replace(x, "[^a-z0-9]", ""), key, kind, 36))
    return F.concat(new(name, "mail"), F.lit("@"), new(inner, "domain"), F.substring_index(domain, ".", -1))


def pseudonym(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    mail = _mail(m, key)
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    ip = F.transform(F.array(native.permuted_number(F.aggregate(parts, F.lit(0).cast("long"), lambda s, v: s * 256 + v), 1 << 32, key, "ip")), lambda x: F.concat_ws(".", *[(F.floor(x / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)]))
    of = lambda v: F.date_add(F.lit(EPOCH).cast("date"), v.cast("int"))
    late = lambda v: F.dayofmonth(of(v)) > 12
    moved = lambda ok: native.permuted_number(_days(m), DAYS, key, "date", ok)
    day = F.when(F.dayofmonth(_date(m)) > 12, moved(late)).otherwise(moved(lambda v: ~late(v)))
    shape = F.when(m.rlike(r"^\d{4}"), "yyyy-MM-dd").when(_month_first(m), "MM/dd/yyyy").otherwise(F.concat(F.lit("dd"), F.substring(m, 3, 1), F.lit("MM"), F.substring(m, 6, 1), F.lit("yyyy")))
    date = native.let(F.struct(of(day).alias("d"), shape.alias("s")), lambda x: F.when(x["s"] == "yyyy-MM-dd", x["d"].cast("string")).when(x["s"] == "MM/dd/yyyy", F.date_format(x["d"], "MM/dd/yyyy")).otherwise(F.concat(F.date_format(x["d"], "dd"), F.substring(x["s"], 3, 1), F.date_format(x["d"], "MM"), F.substring(x["s"], 6, 1), F.date_format(x["d"], "yyyy"))))
    code = F.when(m.startswith("+"), F.regexp_extract(digits, f"^{COUNTRY}", 0)).otherwise(F.lit(""))
    phone = F.concat(code, native.permuted_digits(F.substring(digits, F.length(code) + 1, F.length(digits)), key, "phone"))
    ssn = native.walked(digits, lambda d: native.permuted_digits(d, key, "ssn"), _ssn_valid)
    body = native.permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.transform(F.array(body), lambda b: F.concat(b, native.luhn_digit(b)))
    account = _iban(m, key)
    kind = kind_of(m)
    return (
        F.when(kind == "mail", mail)
        .when(kind == "ip", F.get(ip, F.lit(0)))
        .when(kind == "date", date)
        .when(kind == "iban", account)
        .when(kind == "card", _laid_back(m, F.get(card, F.lit(0))))
        .when(kind == "phone", _laid_back(m, phone))
        .when(kind == "ssn", _laid_back(m, ssn))
        .otherwise(m)
    )


def _iban(m: Column, key: str) -> Column:
    """The digits of the account part are permuted, then the two check digits are set anew."""
    s = F.regexp_replace(m, " ", "")
    part = F.substring(s, F.lit(5), F.length(s))
    new = native.permuted_digits(F.regexp_replace(part, r"\D", ""), key, "iban")
    rest = F.transform(F.array(new), lambda d: _laid_back(part, d))
    whole = F.transform(rest, lambda r: F.concat(F.substring(s, 1, 2), F.lpad((98 - _iban_rest(F.concat(F.substring(s, 1, 2), F.lit("00"), r))).cast("string"), 2, "0"), r))
    return F.get(F.transform(whole, lambda w: F.array_join(F.transform(F.split(m, "[A-Z0-9]", -1), lambda g, i: F.concat(g, F.substring(w, i + 1, F.lit(1)))), "")), F.lit(0))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_mail ... n_card (validated findings of each kind), n_found."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col("text")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = text.rlike("[0-9@]")  # as every pattern has; spares most texts the long pattern
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), kind_of)).otherwise(F.array().cast("array<string>"))
    new = F.when(some, native.replaced(text, ANY, lambda m: pseudonym(m, key))).otherwise(text)
    df = df.select("doc_id", new.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda k: k == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return df.select("doc_id", "text", *counts, F.size(F.filter("found", lambda k: k.isNotNull())).cast("long").alias("n_found"))
