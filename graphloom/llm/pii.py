"""Format-preserving pseudonyms with DataFrame functions only.

Validated numbers and dates (and the digits and letters of mail addresses) are permuted within their format by a
keyed generalised Feistel network over Z_a x Z_b: each round adds a keyed hash of one half to the other, modulo that
half's size, so a value maps to one value of its format and equal values stay linked across documents.

Kinds: mail address (letters and digits, runs permuted per length; the top-level domain stays), IPv4 address,
payment card (13-19 digits together, or grouped 4-4-4-4 or 4-6-5; Luhn-valid before and after), telephone number (country
code, by the numbering plan's prefixes, and punctuation stay; North American numbers keep valid area and exchange codes),
ISO date and day.month.year, month/day/year or else day/month/year date (valid calendar days of 1800-2199), IBAN (together,
or in groups of four of which all but the first are digits; mod-97 valid before and after).

The key is part of the plan, so whoever can read the cluster's plans can read a digest of it that gives the same
pseudonyms; the key itself appears nowhere.
"""

from __future__ import annotations

import hashlib
import os
import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

ROUNDS = 8
#: Names the environment variable that holds the production key.
KEY_NAME = "GRAPHLOOM_PII_KEY"
#: Random keys by application, where the environment names none.
_DRAWN: dict[str, str] = {}


def default_key(spark: SparkSession) -> str:
    """The key of the environment; without one, a fixed key on a local master and a random one of the application elsewhere."""
    key = os.environ.get(KEY_NAME)
    if key:
        return key
    if spark.sparkContext.master.startswith("local"):
        return "local test key"
    at = spark.sparkContext.applicationId
    if at not in _DRAWN:
        warnings.warn(f"{KEY_NAME} is not set: a random key is drawn, and pseudonyms agree within this application only")
        _DRAWN[at] = secrets.token_hex(32)
    return _DRAWN[at]


MAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: [0-9]{4}){1,6}(?: [0-9]{1,3})?)"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
NUMBERS = rf"(?:{IPV4})(?![0-9]|\.[0-9])|(?:{DATE})(?![0-9])|(?:{PHONE})(?![0-9])|(?:{CARD})(?![0-9])"
FOUND = rf"(?<![A-Za-z0-9._%+-])(?:{MAIL})|(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])|(?<![0-9A-Za-z+]|[0-9][.-])(?:{NUMBERS})"
#: Country codes of one and two digits in the international numbering plan; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _hash(key: str, label: Column, i: int, half: Column) -> Column:
    """Keyed 52-bit number of a half."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), label, F.lit(str(i)), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, label: Column, key: str = "", rounds: int = ROUNDS) -> Column:
    """struct<l, r>: a keyed permutation of (left, right) in Z_a x Z_b, one for each *label*."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def go(state: Column, i: int) -> Column:
        if i == rounds:
            return state
        if i % 2 == 0:
            step = lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _hash(key, label, i, s["l"]), b.cast("bigint")).alias("r"))
        else:
            step = lambda s: F.struct(F.pmod(s["l"] + _hash(key, label, i, s["r"]), a.cast("bigint")).alias("l"), s["r"].alias("r"))
        return let(state, lambda s: go(step(s), i + 1))

    return go(start, 0)


def _digits(value: Column, n: Column) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def permute_digits(digits: Column, label: str, key: str = "") -> Column:
    """A string of 1 to 36 digits as another one of its length.  (A single digit is half of two, so it is shifted only.)"""
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    power = lambda m: F.rpad(F.lit("1"), m + 1, "0").cast("bigint")
    out = feistel(
        F.when(k > 0, F.substring(digits, F.lit(1), k).cast("bigint")).otherwise(0),
        F.substring(digits, k + 1, n - k).cast("bigint"),
        power(k),
        power(n - k),
        F.concat(F.lit(f"{label}:"), n.cast("string")),
        key,
    )
    return let(out, lambda s: F.concat(F.when(k > 0, _digits(s["l"], k)).otherwise(""), _digits(s["r"], n - k)))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2), lambda d: d - 9 * (d > 9).cast("int")))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def _refill(pattern: Column, digits: Column) -> Column:
    """*pattern* with its digits replaced, one by one, by *digits*."""
    chars = F.split(pattern, "")
    zero = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def step(acc: Column, ch: Column) -> Column:
        number = ch.rlike("[0-9]")
        return F.struct(F.concat(acc["text"], F.when(number, F.substring(digits, acc["at"], F.lit(1))).otherwise(ch)).alias("text"), (acc["at"] + number.cast("int")).alias("at"))

    return F.aggregate(chars, zero, step, lambda acc: acc["text"])


def _card(digits: Column, key: str) -> Column:
    """All but the check digit permuted, then the check digit that makes the number valid."""
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _ipv4(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    at = lambda p, i: F.element_at(p, i)
    mixed = let(parts, lambda p: feistel(at(p, 1) * 256 + at(p, 2), at(p, 3) * 256 + at(p, 4), F.lit(65536), F.lit(65536), F.lit("ipv4"), key))
    return let(mixed, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))


def _date(value: Column, key: str) -> Column:
    """A valid day of 1800-2199 (146,097 = 189 x 773 days) as another one, in the same notation."""
    iso = value.rlike("^[0-9]{4}-")
    mark = F.substring(value, 3, 1)
    forms = [(iso, "yyyy-MM-dd"), (~iso & (mark == "."), "dd.MM.yyyy"), (~iso & (mark == "/"), "MM/dd/yyyy"), (~iso & (mark == "/"), "dd/MM/yyyy")]
    forms = [(c & F.try_to_timestamp(value, F.lit(f)).isNotNull(), f) for c, f in forms]
    day = F.coalesce(*[F.when(c, F.try_to_timestamp(value, F.lit(f)).cast("date")) for c, f in forms])
    number = F.datediff(day, F.lit("1800-01-01").cast("date"))
    mixed = feistel(F.floor(number / 773), number % 773, F.lit(189), F.lit(773), F.lit("date"), key)
    moved = let(mixed, lambda s: F.date_add(F.lit("1800-01-01").cast("date"), (s["l"] * 773 + s["r"]).cast("int")))
    return F.when((number >= 0) & (number < 146097), F.coalesce(*[F.when(c, F.date_format(moved, f)) for c, f in forms]))


def _phone(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    country = F.when(value.startswith("+"), F.length(F.regexp_extract(value, COUNTRY, 1))).otherwise(0)

    def north_american(d: Column) -> Column:
        """Area and exchange codes start with 2-9: 800 area codes x 8,000,000 others."""
        area, rest = F.substring(d, F.lit(1), F.lit(3)).cast("bigint") - 200, F.substring(d, F.lit(4), F.lit(7)).cast("bigint") - 2_000_000
        mixed = feistel(area, rest, F.lit(800), F.lit(8_000_000), F.lit("nanp"), key)
        return let(mixed, lambda s: F.concat((s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string")))

    def body(d: Column) -> Column:
        own = F.substring(d, country + 1, F.length(d))
        return F.concat(F.substring(d, F.lit(1), country), F.when(own.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), north_american(own)).otherwise(permute_digits(own, "phone", key)))

    valid = F.length(digits).between(7, 15)
    return F.when(valid, let(let(digits, body), lambda d: _refill(value, d)))


def _letters(run: Column, key: str) -> Column:
    """A run of letters (or digits) of one case, permuted as numbers of base 26 in pieces of up to eight."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"

    def piece(p: Column) -> Column:
        n = F.length(p)
        low = F.lower(p)
        value = lambda s: F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.instr(F.lit(alphabet), c) - 1)
        k = F.floor(n / 2).cast("int")
        text = lambda v, m: F.concat_ws("", F.transform(F.sequence(F.lit(1), m), lambda i: F.substring(F.lit(alphabet), (F.floor(v / F.pow(F.lit(26.0), m - i)) % 26 + 1).cast("int"), F.lit(1))))
        power = lambda m: F.pow(F.lit(26.0), m).cast("bigint")
        left = F.when(k > 0, value(F.substring(low, F.lit(1), k))).otherwise(0)
        mixed = feistel(left, value(F.substring(low, k + 1, n - k)), power(k), power(n - k), F.concat(F.lit("letters:"), n.cast("string")), key)
        out = let(mixed, lambda s: F.concat(F.when(k > 0, text(s["l"], k)).otherwise(""), text(s["r"], n - k)))
        return F.when(p.rlike("^[A-Z]"), F.upper(out)).otherwise(out)

    digits = lambda p: permute_digits(p, "mail", key)
    pieces = F.regexp_extract_all(run, F.lit("[a-z]{1,8}|[A-Z]{1,8}|[0-9]{1,17}|[^a-zA-Z0-9]+"), F.lit(0))
    return F.concat_ws("", F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), digits(p)).when(p.rlike("^[a-zA-Z]"), piece(p)).otherwise(p)))


def _mail(value: Column, key: str) -> Column:
    """Everything before the top-level domain; that domain stays."""
    head = F.regexp_extract(value, r"^(.*\.)[A-Za-z]+$", 1)
    return F.concat(_letters(head, key), F.regexp_extract(value, r"([A-Za-z]+)$", 1))


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)


def _iban_digits(value: Column) -> Column:
    """The account part, country and check digits as decimal digits (letters are 10 to 35)."""
    return F.concat_ws("", F.transform(F.split(value, ""), lambda c: (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1).cast("string")))


def _iban(found: Column, key: str) -> Column:
    moved = let(F.replace(found, F.lit(" "), F.lit("")), lambda v: _plain_iban(v, key))
    return F.when(found.contains(" "), F.regexp_replace(moved, "(.{4})(?!$)", "$1 ")).otherwise(moved)


def _plain_iban(value: Column, key: str) -> Column:
    country, body = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    valid = _mod97(_iban_digits(F.concat(body, F.substring(value, 1, 4)))) == 1
    moved = let(_letters(body, key), lambda b: F.concat(country, F.lpad((98 - _mod97(_iban_digits(F.concat(b, country, F.lit("00"))))).cast("string"), 2, "0"), b))
    return F.when(valid, moved)


def pseudonym(found: Column, key: str) -> Column:
    """struct<kind, value> of one match; kind is null where validation fails and the match stays."""
    digits = F.regexp_replace(found, "[ -]", "")
    whole = lambda p: found.rlike(f"^(?:{p})$")
    row = lambda kind, value: let(value, lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, found).alias("value")))
    is_card = whole(CARD) & digits.rlike("^[0-9]{13,19}$")
    card = F.when(luhn_sum(digits) % 10 == 0, let(_card(digits, key), lambda d: _refill(found, d)))
    return (
        F.when(found.contains("@"), row("mail", _mail(found, key)))
        .when(whole(IPV4), row("ipv4", _ipv4(found, key)))
        .when(whole(DATE), row("date", _date(found, key)))
        .when(is_card, row("card", card))
        .when(whole(PHONE), row("phone", _phone(found, key)))
        .when(whole(IBAN), row("iban", _iban(found, key)))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), found.alias("value")))
    )


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """*docs* with personal numbers, dates and addresses in ``text`` replaced, plus ``pii_kinds`` (one per replacement).

    A null text stays null, a text without any stays as it is; repeated rows get equal pseudonyms; other columns
    pass through (``pii_kinds`` is replaced); an empty table stays empty; texts of any length are read whole, within a row.
    Without *key*, :func:`default_key` holds.
    """
    key = hashlib.sha256((key or default_key(docs.sparkSession)).encode()).hexdigest()
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    has = text.rlike("[0-9@]") & text.rlike(FOUND)

    def build(found: Column) -> Column:
        gaps = F.split(text, FOUND, -1)
        values = F.transform(found, lambda f: pseudonym(f, key))

        def join(v: Column) -> Column:
            pieces = F.flatten(F.zip_with(gaps, v, lambda g, x: F.array(g, F.coalesce(x["value"], F.lit("")))))
            return F.struct(F.concat_ws("", pieces).alias("text"), F.filter(F.transform(v, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

        return let(values, join)

    made = F.when(has, let(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), build))
    new = common.fresh("_made", docs.columns)
    out = docs.select(*[c for c in docs.columns if c != "pii_kinds"], made.alias(new))
    return out.select(
        *[F.coalesce(F.col(new)["text"], text).alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "pii_kinds"],
        F.coalesce(F.col(new)["kinds"], F.array().cast("array<string>")).alias("pii_kinds"),
    )


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonymize(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_kinds", lambda x: x == k)).cast("bigint").alias(f"n_{k}")
    return made.select("doc_id", "text", *map(count, ("mail", "ipv4", "date", "card", "phone", "iban")))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pseudonyms in ``text``; every row stays, in the columns of *docs*; n_chars is counted anew."""
    columns = docs.columns
    own = common.fresh("_row", columns)
    rest = F.struct(*[F.col(c) for c in columns if c != "text"]).alias(own)
    made = pseudonymize(docs.select(rest, "text")).select(F.col(own), "text")
    length = F.length("text").cast("bigint")
    return made.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(own)[c].alias(c) for c in columns])
