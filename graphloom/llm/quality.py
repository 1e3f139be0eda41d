"""Quality rules: fixed base rules and robust multivariate outliers, with DataFrame functions only.

Each text gives a vector of transformed rates.  Per (language, source) the minimum covariance determinant is sought
by concentration steps from three deterministic starts (coordinate medians with MADs, medians with the floors alone, all
rows' mean and covariance): each step keeps the rows of smallest Mahalanobis distance and takes their mean and covariance,
and the start that ends with the smallest determinant is taken.  Rows are summarised per group with partial
aggregation, so a source that holds most rows is no hot task.  Every group's estimate is pooled with its language's, and
that with all rows', as if PRIOR rows of the wider one were added; so few rows give a wide estimate, without a switch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
#: name, floor of the standard deviation: shifts under a few floors are no reason to reject a text.
FEATURES = (("word_length", 0.15), ("symbols", 0.2), ("dup_lines", 0.12), ("repeats", 0.12), ("capitals", 0.08))
UNIT = 1000  # features are whole thousandths, so sums are exact and independent of row order
SUPPORT = 0.75  # share of rows in the concentrated subset
STEPS = 3
STARTS = 3
PRIOR = 50  # rows of the wider estimate that each estimate is pooled with
#: Chance that a row of a normal population is rejected; rules must keep clean texts.
TAIL = 1e-6
#: Groups of estimates that may be broadcast (each about 200 bytes); beyond that the join is salted.
BROADCAST_GROUPS = 20_000
SALTS = 32
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
KEYS = ["level", "g_lang", "g_source"]


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


#: Makes the covariance of the concentrated subset that of a whole normal population.
CONSISTENCY = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)


def _word_array(text: Column) -> Column:
    plain = text
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda i, j: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))
        starts = F.filter(F.transform(ordered, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]).otherwise(-1)), lambda i: i >= 0)
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"))
        return F.aggregate(F.array_sort(starts), zero, step, lambda acc: acc["total"])

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(pairs, covered))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(n >= WINDOW, let(hashes, count)).otherwise(F.lit(0).cast("bigint"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """*docs* plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals (null text: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("*", text.alias("_text")).select("*", _word_array(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.WORD))
    plain = F.col("_text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    long = lambda x, name: x.cast("bigint").alias(name)
    per_row = split.select(
        *docs.columns,
        long(F.size("_words"), "n_words"),
        long(F.aggregate("_words", F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w)), "word_chars"),
        long(F.length("_text") - F.length(plain), "n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        long(F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", "")), "n_capitals"),
    )
    return per_row.select(
        "*", long(F.col("_lines")["all"], "n_lines"), long(F.col("_lines")["all"] - F.col("_lines")["distinct"], "n_dup_lines")
    ).drop("_lines")


def _features() -> list[Column]:
    """Whole thousandths; rates are shrunk by pseudo-counts, so short texts do not stand out by chance."""
    n, chars = F.col("n_words"), F.col("word_chars")
    values = (
        F.log((chars + 50) / (n + 10)),
        F.log1p(F.lit(10) * F.col("n_symbols") / (n + 20)),
        F.col("n_dup_lines") / (F.col("n_lines") + 10),
        F.col("n_repeat_words") / (n + 50),
        F.sqrt(F.col("n_capitals") / (chars + 50)),
    )
    return [F.round(v * UNIT).cast("bigint").alias(f"x{i}") for i, v in enumerate(values)]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row under its (language, source), its language, and all."""
    blank = F.lit("").alias("g_source")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("g_lang"), F.col("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("g_lang"), blank),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("g_lang"), blank),
    )
    xs = [f"x{i}" for i in range(P)]
    return rows.select(F.inline(levels), *xs)


def _join_groups(rows: DataFrame, groups: DataFrame, n_groups: int, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with their group's estimate.  The estimates are broadcast if they are few; else each is repeated per salt."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[f"x{i}" for i in range(P)]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def _squared_distance() -> Column:
    """Mahalanobis distance under columns m0.. (centre) and w00.. (inverse Cholesky factor, by rows)."""
    z = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    parts = []
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * z[j]
        parts.append(y * y)
    return sum(parts[1:], parts[0])


def _factor(groups: DataFrame, *keep: str) -> DataFrame:
    """From means m*, covariances c*: the inverse Cholesky factor of the floored covariance, unrolled, and its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") + (FEATURES[i][1] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                value = value / F.col(f"l{i}{i}")
            groups = groups.withColumn(f"w{i}{j}", value)
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00"))
    return groups.select(*keep, *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS), det.alias("det"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """h, means m* and covariances c* per group; sums of whole numbers are exact."""
    exact = lambda x: F.sum(x.cast("decimal(30,0)")).cast("double")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("h"), *[exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)], *[exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    )
    mean = lambda i: F.col(f"s{i}") / F.col("h") / UNIT
    return sums.select(
        *keys, "h", *[mean(i).alias(f"m{i}") for i in range(P)], *[(F.col(f"s{i}{j}") / F.col("h") / (UNIT * UNIT) - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in PAIRS]
    )


def _starts(levels: DataFrame) -> DataFrame:
    """start, KEYS, m*, c*: the three starts of each group."""
    medians = levels.groupBy(*KEYS).agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"d{i}") for i in range(P)])
    medians = common.materialize(medians, "medians")
    near = _join_groups(levels, medians, medians.count(), KEYS)
    spread = near.groupBy(*KEYS).agg(
        *[F.first(f"d{i}").alias(f"d{i}") for i in range(P)], *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"d{i}")), F.lit(0.5)).alias(f"s{i}") for i in range(P)]
    )
    centre = [(F.col(f"d{i}") / UNIT).alias(f"m{i}") for i in range(P)]
    mad = [(F.pow(1.4826 * F.col(f"s{i}") / UNIT, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    none = [F.lit(0.0).alias(f"c{i}{j}") for i, j in PAIRS]
    whole = _sums(levels, KEYS).drop("h")
    spread = common.materialize(spread, "spread")
    return (
        spread.select(F.lit(0).alias("start"), *KEYS, *centre, *mad)
        .unionByName(spread.select(F.lit(1).alias("start"), *KEYS, *centre, *none))
        .unionByName(whole.select(F.lit(2).alias("start"), "*"))
    )


def minimum_determinants(rows: DataFrame) -> DataFrame:
    """KEYS, h, m*, c* per group of *rows* (g_lang, g_source, x0..): of the starts, the one whose last step has the smallest determinant."""
    levels, keys = _levels(rows), ["start", *KEYS]
    groups = common.materialize(_factor(_starts(levels), *keys), "estimates")
    n_groups = groups.count()
    moments = None
    for _ in range(STEPS):
        # distances in steps of 1/64 octave: few values, so exact percentiles need little memory
        dealt = levels.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
        near = _join_groups(dealt, groups, n_groups, keys).withColumn("q", F.floor(F.log2(F.lit(1.0) + _squared_distance()) * 64).cast("bigint"))
        limit = common.materialize(near.groupBy(*keys).agg(F.percentile("q", F.lit(SUPPORT)).alias("most")), "limits")
        kept = _join_groups(near, limit, n_groups, keys).filter(F.col("q") <= F.col("most"))
        scaled = [(CONSISTENCY * F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
        moments = common.materialize(_sums(kept, keys).select(*keys, "h", *[f"m{i}" for i in range(P)], *scaled), "moments")
        groups = common.materialize(_factor(moments, *keys), "estimates")
    values = ["h", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]
    ended = moments.join(groups.select(*keys, F.round("det", 9).alias("det")), keys)
    best = ended.groupBy(*KEYS).agg(F.min(F.struct("det", "start", *values)).alias("best"))
    return best.select(*KEYS, *(f"best.{v}" for v in values))


def _pooled(groups: DataFrame, means: list[Column], covariances: dict[tuple[int, int], Column]) -> DataFrame:
    """KEYS, m*, c* of *groups*, each with PRIOR rows of a wider population of these moments added."""
    own, wide = F.col("h") / (F.col("h") + PRIOR), F.lit(float(PRIOR)) / (F.col("h") + PRIOR)
    apart = [F.col(f"m{i}") - means[i] for i in range(P)]
    return groups.select(
        *KEYS,
        *[(own * F.col(f"m{i}") + wide * means[i]).alias(f"m{i}") for i in range(P)],
        *[(own * F.col(f"c{i}{j}") + wide * covariances[i, j] + own * wide * apart[i] * apart[j]).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def robust_estimates(rows: DataFrame) -> DataFrame:
    """g_lang, g_source, centre m* and inverse Cholesky factor w* per group of *rows* (g_lang, g_source, x0..)."""
    best = common.materialize(minimum_determinants(rows), "determinants")
    top = best.filter("level = 2").first()  # one row
    get = lambda name: F.lit(top[name] if top else 0.0)
    langs = _pooled(best.filter("level = 1"), [get(f"m{i}") for i in range(P)], {(i, j): get(f"c{i}{j}") for i, j in PAIRS})
    wider = langs.select("g_lang", *[F.col(f"m{i}").alias(f"pm{i}") for i in range(P)], *[F.col(f"c{i}{j}").alias(f"pc{i}{j}") for i, j in PAIRS])
    sources = best.filter("level = 0").join(wider, "g_lang")
    pooled = _pooled(sources, [F.col(f"pm{i}") for i in range(P)], {(i, j): F.col(f"pc{i}{j}") for i, j in PAIRS})
    return common.materialize(_factor(pooled, "g_lang", "g_source"), "estimates")


def quality_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Per row of *docs* (text, and lang and source if it has them): ``row`` (a struct of the columns *carry*), the statistics, base_failed, the feature vector.

    Null and empty texts have no words and fail the base rule; texts of any length are read whole, by array functions
    within a row; null languages and sources form groups of their own; repeated rows are judged each; an empty table gives
    an empty result.  The input's columns are inside ``row``, so none clashes.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("\x00")) if c in docs.columns else F.lit("")
    packed = docs.select(F.struct(*carry).alias("row"), "text", known("lang").alias("g_lang"), known("source").alias("g_source"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return text_statistics(packed).drop("text").select("*", failed.alias("base_failed"), *_features())


def judge(stats: DataFrame) -> DataFrame:
    """Adds distance2 and kept (false if base_failed, else distance2 within CUTOFF) to the rows of :func:`quality_statistics`; *stats* is read several times.

    A group without a row that passes the base rules has no estimate; its rows' distance2 is null.
    """
    groups = robust_estimates(stats.filter(~F.col("base_failed")).select("g_lang", "g_source", *[f"x{i}" for i in range(P)]))
    sides = [f"m{i}" for i in range(P)] + [f"w{i}{j}" for i, j in PAIRS]
    out = _join_groups(stats, groups.select("g_lang", "g_source", *sides), groups.count(), ["g_lang", "g_source"], "left").withColumn("distance2", _squared_distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF)
    return out.withColumn("kept", kept).drop(*sides)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    stats = common.materialize(quality_statistics(docs, ["doc_id"]), "quality")
    return judge(stats).select("row.doc_id", *STATS, "kept", "distance2")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that pass, in the columns of *docs*."""
    common.release(spark)
    stats = common.materialize(quality_statistics(docs, docs.columns), "quality")
    common.release(spark)
    judged = judge(stats)
    common.release(spark)
    return judged.filter("kept").select("row.*")
