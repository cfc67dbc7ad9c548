"""Quality rules: robust multivariate outliers among documents of one language and source.

Every text becomes counts (``text_stats``) and a vector of log ratios (``vector``). Per language and source,
and per language for groups of few rows, a regularised minimum-covariance-determinant estimate (Rousseeuw &
Van Driessen 1999; deterministic starts as in Hubert, Rousseeuw & Verdonck 2012; a floor on every variance as
in Boudt et al. 2020, because most texts share exact zeros) gives centre and scatter; a text whose squared
Mahalanobis distance exceeds the cut is rejected.

One concentration step is one aggregation: rows are summed per group and narrow distance bin (count, sums,
products), the bins that hold the nearest ``SHARE`` of a group's rows are found by running counts, and their
sums are the next centre and scatter. What is shuffled is bins, not rows, so a hot source costs no skew.
Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import stored

from .expressions import let, words

MIN_WORDS = 10  # base rule: fewer words fail
MAX_REPEAT = 20  # base rule: a larger percentage of words in repeated windows fails
WINDOW = 5
SHARE = 0.75  # part of a group that the determinant is minimised over
STEPS = 4  # concentration steps per start
MIN_ROWS = 200  # groups with fewer rows take the estimate of their language, then none
TAIL = 1e-6  # a clean text's chance of rejection under the fitted normal
# Smallest standard deviation per component, in log units: below it differences do not count as evidence. Repeats,
# which the base rule already bounds and which show in two components, get twice the width.
FLOORS = (0.15, 0.5, 1.0, 1.0, 0.5, 0.5)
D = len(FLOORS)
BINS = 8  # distance bins per octave
X = [f"x{i}" for i in range(D)]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, d: int) -> float:
    """Chi-squared distribution for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


# A truncated normal's covariance is too small by this factor.
CONSISTENT = SHARE / chi2_cdf(chi2_quantile(SHARE, D), D + 2)
CONSISTENT_975 = 0.975 / chi2_cdf(chi2_quantile(0.975, D), D + 2)


def _repeat_words(ws: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text. Windows are told apart by a 64-bit hash."""
    def covered(at):
        # Sorted starts of repeated windows: each adds up to five words not covered by the next.
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(hs):
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(ps):
            twice = F.filter(
                ps,
                lambda p, k: (p["h"] == F.get(ps, k + 1)["h"]).eqNullSafe(True)
                | ((k > 0) & (p["h"] == F.get(ps, F.greatest(k - 1, F.lit(0)))["h"])),
            )
            return F.sort_array(F.transform(twice, lambda p: p["i"]))

        return let(let(pairs, starts), covered)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(WINDOW)])
    )
    counted = let(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(repeated(hs)),
    )
    return F.when(F.size(ws) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def text_stats(text: Column) -> Column:
    """Struct of the five base counts and the further counts of the vector. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    zero = F.lit(0).cast("long")

    def chars(keep):
        return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    counted = let(
        lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("u"))
    )
    of_words = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n"),
            F.aggregate(ws, zero, lambda a, w: a + F.length(w)).alias("chars"),
            _repeat_words(ws).alias("repeat"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), counted.alias("l")),
        lambda s: F.struct(
            s["w"]["n"].alias("n_words"), s["w"]["chars"].alias("word_chars"),
            chars("#*$%&|<>").alias("n_symbols"), (s["l"]["n"] - s["l"]["u"]).alias("n_dup_lines"),
            s["w"]["repeat"].alias("n_repeat_words"), s["l"]["n"].alias("n_lines"),
            chars("A-Z").alias("n_upper"), chars("!?.,;:()").alias("n_marks"),
        ),
    )


def vector(s: Column) -> list[Column]:
    """The transformed statistics: mean word length and five rates per hundred, as logarithms."""

    def rate(n, of):
        return F.log1p(F.lit(100.0) * n / F.greatest(of, F.lit(1).cast("long")))

    n = s["n_words"]
    return [
        F.log(F.greatest(s["word_chars"], F.lit(1).cast("long")) / F.greatest(n, F.lit(1).cast("long"))),
        rate(s["n_symbols"], n), rate(s["n_dup_lines"], s["n_lines"]), rate(s["n_repeat_words"], n),
        rate(s["n_upper"], s["word_chars"]), rate(s["n_marks"], n),
    ]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (F.lit(100) * s["n_repeat_words"] > F.lit(MAX_REPEAT) * s["n_words"])


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from the joined centre m0.. with whitening rows v_i_j."""
    total = None
    for i in range(D):
        y = None
        for j in range(i + 1):
            part = F.col(f"v_{i}_{j}") * (F.col(X[j]) - F.col(f"m{j}"))
            y = part if y is None else y + part
        total = y * y if total is None else total + y * y
    return total


def _whitened(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, m_i, v_i_j (inverse Cholesky factor) and log_det, from count ``n`` and sums ``s_i``, ``p_i_j``."""
    n = F.col("n").cast("double")
    columns = [(F.col(f"s_{i}") / n).alias(f"m{i}") for i in range(D)]
    for i in range(D):
        for j in range(i + 1):
            cov = F.col(f"p_{i}_{j}") / n - F.col(f"s_{i}") / n * (F.col(f"s_{j}") / n)
            cov = cov * factor + (FLOORS[i] ** 2 if i == j else 0.0)
            columns.append(F.round(cov, 10).alias(f"c_{i}_{j}"))
    out = moments.select(*keys, *columns)
    for j in range(D):
        pivot = F.col(f"c_{j}_{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        # The floor bounds a pivot from below; greatest() only guards against rounding.
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[j] ** 2 / 4))))
        below = {}
        for i in range(j + 1, D):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = value / F.col(f"l_{j}_{j}")
        out = out.withColumns(below) if below else out
    for step in range(D):  # diagonals of the inverse factor, outward
        row = {}
        for j in range(D - step):
            i = j + step
            if step == 0:
                row[f"v_{i}_{j}"] = F.lit(1.0) / F.col(f"l_{i}_{i}")
            else:
                acc = None
                for k in range(j, i):
                    part = F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}")
                    acc = part if acc is None else acc + part
                row[f"v_{i}_{j}"] = -acc / F.col(f"l_{i}_{i}")
        out = out.withColumns(row)
    log_det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(D)), F.lit(0.0))
    kept = [f"m{i}" for i in range(D)] + [f"v_{i}_{j}" for i in range(D) for j in range(i + 1)]
    return out.select(*keys, *kept, log_det.alias("log_det"))


def _sums() -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")] + [F.sum(X[i]).alias(f"s_{i}") for i in range(D)]
    return out + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p_{i}_{j}") for i in range(D) for j in range(i + 1)]


GROUP = ["level", "g_lang", "g_source"]
KEYS = [*GROUP, "start"]


def _levels(stats: DataFrame) -> DataFrame:
    """Every row twice: in its language and source, and in its language as a whole."""
    blank = F.lit(None).cast("string")
    groups = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), blank.alias("g_source")),
    )
    return stats.withColumn("g", F.explode(groups)).select("*", "g.*").drop("g")


def fit_groups(stats: DataFrame) -> DataFrame:
    """Centre and scatter per group with at least ``MIN_ROWS`` rows, from stats rows (lang, source, x0..)."""
    rows = _levels(stats.select("lang", "source", *X))
    sizes = rows.groupBy(*GROUP).agg(*_sums())
    large = sizes.where(F.col("n") >= MIN_ROWS)
    # Start 0: classical estimate. Start 1: coordinatewise medians, with the floors as scales.
    classical = _whitened(large.withColumn("start", F.lit(0)), KEYS, 1.0)
    medians = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(X)]
    ).where(F.col("n") >= MIN_ROWS)
    unit = [F.lit(1.0 / FLOORS[i] if i == j else 0.0).alias(f"v_{i}_{j}") for i in range(D) for j in range(i + 1)]
    robust = medians.select(
        *GROUP, F.lit(1).alias("start"), *[f"m{i}" for i in range(D)], *unit, F.lit(0.0).alias("log_det")
    )
    params = stored(classical.unionByName(robust), "mcd-start")
    for step in range(STEPS):
        params = stored(_concentrated(rows, params, step == STEPS - 1), "mcd-step")
    best = Window.partitionBy(*GROUP).orderBy("log_det", "start")
    chosen = params.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    return stored(_reweighted(rows, chosen), "mcd")


def _near(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with the estimate of their group, and d2: the squared distance from it."""
    same = (F.col("level") == F.col("p_level")) & F.col("g_lang").eqNullSafe(F.col("p_g_lang"))
    same = same & F.col("g_source").eqNullSafe(F.col("p_g_source"))
    joined = rows.join(params.withColumnsRenamed({g: f"p_{g}" for g in GROUP}), same)
    return joined.withColumn("d2", _distance())


def _concentrated(rows: DataFrame, params: DataFrame, last: bool) -> DataFrame:
    """One concentration step for all groups and starts."""
    bin_of = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS).cast("int")
    bins = _near(rows, params).withColumn("bin", bin_of).groupBy(*KEYS, "bin").agg(*_sums())
    before = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEYS)
    inside = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "total", F.sum("n").over(whole)
    ).where(F.col("before") < F.ceil(F.col("total") * F.lit(SHARE)))
    names = ["n", *[f"s_{i}" for i in range(D)], *[f"p_{i}_{j}" for i in range(D) for j in range(i + 1)]]
    return _whitened(inside.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in names]), KEYS, CONSISTENT)


def _reweighted(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Final estimate from the rows within the 97.5 % ellipsoid of the chosen one."""
    inside = _near(rows, chosen).where(F.col("d2") <= chi2_quantile(0.975, D))
    return _whitened(inside.groupBy(*GROUP).agg(*_sums()), GROUP, CONSISTENT_975)


def judge(rows: DataFrame, groups: DataFrame, tail: float = TAIL) -> DataFrame:
    """rows (lang, source, x0.., base_failed) with distance and kept; groups without an estimate keep their rows."""
    passed = rows
    for level in (0, 1):
        part = groups.where(F.col("level") == level).drop("level", "log_det")
        part = part.withColumnsRenamed({"g_lang": "__l", "g_source": "__s"})
        on = F.col("lang").eqNullSafe(F.col("__l"))
        on = on & F.col("source").eqNullSafe(F.col("__s")) if level == 0 else on
        passed = passed.join(part, on, "left").withColumn(f"__d{level}", _distance()).select(
            *[F.col(f"`{c}`") for c in passed.columns], f"__d{level}"
        )
    far = F.coalesce("__d0", "__d1")
    return passed.withColumn("distance", far).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(far <= chi2_quantile(1 - tail, D), F.lit(True))
    ).drop("__d0", "__d1")


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """Carried columns, lang, source, the counts, base_failed and x0.. of every row of ``docs``."""
    # Exploding one struct keeps later filters above the counts, which would else be computed for each of them again.
    once = F.explode(F.array(text_stats(F.col("text"))))
    rows = docs.select(*carried, "lang", "source", once.alias("__stats"))
    s = F.col("__stats")
    return rows.select(
        *carried, "lang", "source", *[s[n].alias(n) for n in STATS], base_failed(s).alias("base_failed"),
        *[x.alias(X[i]) for i, x in enumerate(vector(s))],
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, distance, kept.

    Null or empty text: no words, so the base rule fails. Null languages or sources form groups of their own.
    Estimates are fitted on the rows that pass the base rules. Repeated rows count each time; other columns
    are ignored; an empty table gives an empty result.
    """
    stats = stored(statistics(docs, "doc_id"), "quality-stats")
    groups = fit_groups(stats.where(~F.col("base_failed")))
    return judge(stats, groups).select("doc_id", *STATS, "base_failed", "distance", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    names = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "text", "lang", "source")
    fitted = stored(statistics(docs).drop(*STATS), "quality-stats").where(~F.col("base_failed"))
    kept = judge(statistics(renamed, "__row"), fit_groups(fitted)).where("kept")
    return kept.select(*[F.col("__row")[c].alias(c) for c in names])


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_verdicts(docs).select("doc_id", *STATS, "base_failed", "kept", F.round("distance", 3).alias("distance"))
