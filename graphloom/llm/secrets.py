"""Secret scans with DataFrame functions only.

Three base patterns, and a sliding window of Shannon entropy over candidate strings: a fold keeps the counts of the
window's characters and the sum of c*log2(c) (fixed point), and each step only updates the entering and the leaving
character.  Thresholds depend on the candidate's character class; an allow-list suppresses known harmless shapes.

Base matches and harmless parts are blotted out before candidates are looked for, so they suppress the windows that would
meet them and no others.  Candidates are folded in chunks that overlap by a window, which keeps the work in proportion to
their length.  No pattern repeats a group of open length: such a repeat takes a stack frame each time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

# Fixed values of the contract: base patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 characters: a shorter run holds no longer match
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 characters: matches are maximal runs
ASSIGN_PART = 12

WINDOW = 20
CHUNK = 237  # and WINDOW - 1 characters of what follows
BLOT = "\x01"
#: After the assignments are blotted out: whole matches, and what is left of one that a blot cut.
ACCESS_BLOT = r"AKIA[A-Z0-9]{14,}|AKIA[A-Z0-9]*+(?=\x01)"
HEX_BLOT = r"(?<=\x01)[0-9a-f]++|(?<![0-9a-f])[0-9a-f]{16,}+|(?<![0-9a-f])[0-9a-f]++(?=\x01)"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: (class, whole-candidate pattern, least bits per character in a window of 20); the first class that matches holds.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.75),
)
#: Harmless candidates: without a digit, without a letter, UUIDs.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Harmless parts: file paths, documented sample keys, alphabets, eight equal characters.
ALLOW_PARTS = r"(?:/[a-z_]++){3}[a-z_/]*+|(?i:example|sample|placeholder|abcdefgh|01234567)|([A-Za-z0-9+/_=-])\1{7,}+"
KINDS = ("assign", "access", "hex", "entropy")
_ONE = 1 << 20  # fixed point of the entropy sums
_CLOGC = [round(c * math.log2(c) * _ONE) if c else 0 for c in range(WINDOW + 2)]


def _blotted(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """*text* with its matches (whose *group* has *least* characters or more) replaced by as many blots."""

    def put(found: Column) -> Column:
        blots = F.transform(found, lambda m: F.repeat(F.lit(BLOT), F.length(m)))
        if group:
            parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            blots = F.zip_with(F.zip_with(found, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), blots, lambda x, b: F.when(F.length(x["p"]) >= least, b).otherwise(x["m"]))
        both = F.zip_with(F.split(text, pattern, -1), blots, lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))
        return F.array_join(both, "")

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), put)).otherwise(text)


def _fold(chunk: Column, most: Column) -> Column:
    """struct<first, last>: the first and last window end (1-based) of *chunk* whose sum is at most *most*; 0, 0 if there is none.

    The counts are kept as one string, a character for each ASCII code.
    """
    table = F.array(*[F.lit(x).cast("bigint") for x in _CLOGC])
    zero = F.struct(F.lit("A" * 128).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 65

    def put(counts: Column, code: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr((n + 65).cast("bigint")), code + 1, F.lit(1))

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = F.element_at(codes, i)
            leaves = F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))
            full = i > WINDOW

            def left(n: Column) -> Column:
                """Counts and sum once the leaving character, met *n* times, went."""
                return F.struct(
                    F.when(full, put(acc["counts"], leaves, n - 1)).otherwise(acc["counts"]).alias("counts"),
                    F.when(full, acc["total"] + F.get(table, n - 1) - F.get(table, n)).otherwise(acc["total"]).alias("total"),
                )

            def entered(rest: Column) -> Column:
                def out(n: Column) -> Column:
                    total = rest["total"] + F.get(table, n + 1) - F.get(table, n)
                    hot = (i >= WINDOW) & (total <= most)
                    return F.struct(
                        put(rest["counts"], enters, n + 1).alias("counts"),
                        total.alias("total"),
                        F.when(hot & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"),
                        F.when(hot, i).otherwise(acc["last"]).alias("last"),
                    )

                return let(count(rest["counts"], enters), out)

            return let(let(F.greatest(count(acc["counts"], leaves), F.lit(1)), left), entered)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda acc: F.struct(acc["first"], acc["last"]))

    return let(F.transform(F.split(chunk, ""), F.ascii), scan)


def _hot_hull(candidate: Column, bits: Column) -> Column:
    """struct<first, last>: the first and last window end (1-based) with at least *bits*; nulls if there is none."""
    # H = log2(W) - sum / W, so H >= bits is sum <= W * (log2(W) - bits)
    most = ((F.lit(math.log2(WINDOW)) - bits) * WINDOW * _ONE).cast("bigint")

    def hulls(pieces: Column, most: Column) -> Column:
        chunk = lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, WINDOW - 1))
        at = lambda end, i: F.when(end > 0, end.cast("bigint") + i.cast("bigint") * CHUNK)
        return F.transform(pieces, lambda p, i: let(_fold(chunk(p, i), most), lambda h: F.struct(at(h["first"], i).alias("first"), at(h["last"], i).alias("last"))))

    pieces = F.regexp_extract_all(candidate, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    ends = lambda hs: F.struct(F.array_min(F.transform(hs, lambda h: h["first"])).alias("first"), F.array_max(F.transform(hs, lambda h: h["last"])).alias("last"))
    # the threshold is bound to a variable too: as an expression, each step would match the whole candidate again
    return let(let(most, lambda m: let(pieces, lambda p: hulls(p, m))), ends)


def blotted(text: Column) -> Column:
    """*text* without what the base patterns find, and without harmless parts, at its length."""
    text = _blotted(text, ASSIGN, 2, ASSIGN_PART)
    for pattern in (ACCESS_BLOT, HEX_BLOT, ALLOW_PARTS):
        text = _blotted(text, pattern)
    return text


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """array<struct<start,end>>, one for each candidate of :func:`blotted` text with a window that reaches its class's entropy: from its first such window to its last."""
    spans = F.filter(common.spans_of(text, CANDIDATE), lambda s: ~s["match"].rlike("|".join(f"(?:{a})" for a in allow)))
    bits = lambda m: F.coalesce(*[F.when(m.rlike(p), F.lit(b)) for _, p, b in CLASSES], F.lit(9.0))
    hulls = F.transform(
        spans,
        lambda s: let(
            _hot_hull(s["match"], bits(s["match"])),
            lambda h: F.struct((s["start"] + h["first"] - WINDOW).alias("start"), (s["start"] + h["last"]).alias("end"), h["last"].alias("last")),
        ),
    )
    return F.filter(hulls, lambda h: h["last"].isNotNull())


def _row(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("bigint").alias("end"), F.lit(kind).alias("kind"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """*docs* (with ``text``) plus ``base_spans`` and ``spans``: arrays of (start, rank, end, kind), code points.

    A null or empty text has no spans.  Entropy spans never overlap base spans.  Rows stay rows: repeated rows are scanned each,
    an empty table stays empty, other columns pass through (columns of the two new names are replaced).  Time grows in
    proportion to the text, also where one candidate fills it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    other = [c for c in docs.columns if c not in ("base_spans", "spans")]
    parts, base = common.fresh("_parts", docs.columns), common.fresh("_base", docs.columns)
    blots = common.fresh("_blots", docs.columns)
    # blots first, in a projection of their own: what reads them must not repeat them
    found = docs.select("*", F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20,}+"), F.array(blotted(text))).alias(blots))
    found = found.select(
        *other,
        F.struct(
            F.filter(common.spans_of(text, ASSIGN, 2), lambda s: F.length(s["part"]) >= ASSIGN_PART).alias("assign"),
            common.spans_of(text, ACCESS).alias("access"),
            common.spans_of(text, HEX).alias("hex"),
            F.coalesce(F.element_at(F.transform(F.col(blots), lambda t: entropy_spans(t)), 1), F.array().cast("array<struct<start:bigint,end:bigint,last:bigint>>")).alias("entropy"),
        ).alias(parts),
    )
    rows_of = lambda kind: F.transform(F.col(parts)[kind], lambda s: _row(kind, s["start"], s["end"]))
    found = found.select("*", F.concat(*map(rows_of, KINDS[:3])).alias(base))
    spans = F.concat(F.col(base), rows_of("entropy"))
    return found.select(*other, F.col(base).alias("base_spans"), spans.alias("spans"))


def secret_digests(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("entropy")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(scan_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
