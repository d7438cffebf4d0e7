"""Robust multivariate outliers, in DataFrame operations only.

Per language and source, the minimum-covariance-determinant estimate of a vector of text statistics: from the
medians and from random elemental sets, concentration steps keep the closest rows and re-estimate centre and
scatter from them; the start with the smallest determinant goes on until it settles.  A group's estimate is
drawn towards its language's as if that had a few more rows, and a language's towards that of all rows.
Documents whose squared Mahalanobis distance passes a chi-square quantile are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, persist

#: The statistics, each with the standard deviation that is added to the estimated scatter: shares that are 0 in
#: most documents have no scatter of their own.
VECTOR = {"word_length": 0.05, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15, "upper": 0.05}
COVERAGE = 0.75
CUTOFF = 0.9999
#: Random elemental starts, steps that all starts make, and steps that the best makes at most to settle.
RANDOM, EARLY, LATE = 4, 2, 12
SETTLED = 1e-3
#: Rows that the estimate of the language, or of all, counts for in that of a group.
PRIOR_ROWS = 30
#: Distances are ranked by bins of 1/512 in log2; those in the bin of the last row needed all belong.
BIN = 512
#: Estimates are broadcast up to so many rows, else joined by a shuffle whose skew Spark splits.
BROADCAST_ROWS = 20_000


def _repeat_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of 8 that occur twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), covered)))


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of the whole text and the transformed vector of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        F.filter(F.split("_text", SPACE), lambda w: w != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # one struct per row: the text is read by one projection and isn't carried on
    rows = base.select("doc_id", "lang", "source", F.struct(counted.alias("w"), of_lines.alias("l"), _count(F.col("_text"), r"[#*$%&|<>]").cast("long").alias("n_symbols"), _count(F.col("_text"), r"\p{Lu}").cast("long").alias("n_upper")).alias("s"))
    rows = rows.select("doc_id", "lang", "source", "s.w.*", "s.l.*", "s.n_symbols", "s.n_upper")
    share = lambda n, of: F.asin(F.sqrt(F.least(F.col(n) / F.greatest(F.col(of), F.lit(1)), F.lit(1.0))))
    return rows.select(
        "*",
        F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)).alias("word_length"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("n_upper", "word_chars").alias("upper"),
    )


def chi_square_quantile(p: float, k: int) -> float:
    """The value below which a chi-square variable of k degrees stays with probability p, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return low


def chi_square_cdf(x: float, k: int) -> float:
    """The lower incomplete gamma function's series."""
    a, half = k / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def consistency(h: float, k: int) -> float:
    """What the scatter of the closest share h of normal rows is multiplied by."""
    return h / chi_square_cdf(chi_square_quantile(h, k), k + 2)


def _with_inverse(moments: DataFrame, names: list[str], factor: float, floors: dict[str, float]) -> DataFrame:
    """``moments`` (means m_i, covariances c_i_j) with w_i_j (rows of the inverse Cholesky factor) and log_det."""
    p = len(names)
    out = moments
    for i in range(p):
        for j in range(i + 1):
            value = F.greatest(F.col(f"c_{i}_{j}"), F.lit(0.0)) if i == j else F.col(f"c_{i}_{j}")
            value = value * F.lit(factor) + (F.lit(floors[names[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                out = out.withColumn(f"w_{i}_{j}", 1.0 / F.col(f"l_{i}_{i}"))
            else:
                terms = sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j + 1, i)), F.col(f"l_{i}_{j}") * F.col(f"w_{j}_{j}"))
                out = out.withColumn(f"w_{i}_{j}", -terms / F.col(f"l_{i}_{i}"))
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(1, p)), F.log("l_0_0"))
    return out.select(*moments.columns, *[f"w_{i}_{j}" for i in range(p) for j in range(i + 1)], (2 * log_det).alias("log_det"))


def _distance(names: list[str]) -> Column:
    total = F.lit(0.0)
    for i in range(len(names)):
        z = sum((F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}")) for j in range(1, i + 1)), F.col(f"w_{i}_0") * (F.col(names[0]) - F.col("m_0")))
        total = total + z * z
    return total


def _moments(names: list[str]) -> list[Column]:
    """Means and covariances; every one is a sum that Spark combines before it shuffles."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return [F.count("*").alias("rows"), *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs]]


def estimates(rows: DataFrame, keys: list[str], coverage: float = COVERAGE, random: int = RANDOM, floors: dict[str, float] = VECTOR) -> DataFrame:
    """Per value of ``keys``: total (rows), rows (the closest ones), m_i and c_i_j of the minimum-covariance-
    determinant estimate, before consistency factor and floors.

    ``rows`` has a column hash, by which elemental sets of one row more than there are statistics are drawn.
    """
    names = list(floors)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    factor = consistency(coverage, len(names))
    quantiles = rows.groupBy(*keys).agg(*[F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, n in enumerate(names)], F.count("*").alias("rows"))
    quantiles = persist(quantiles, "mcd-rows")
    groups, totals = quantiles.count(), quantiles.select(*keys, F.col("rows").alias("total"))
    small = lambda frame, n: F.broadcast(frame) if n <= BROADCAST_ROWS else frame
    diagonal = [(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs]
    by_median = quantiles.select(F.lit(0).alias("start"), *keys, "rows", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(len(names))], *diagonal)
    size = len(names) + 1
    # Spark keeps the least of every task before the shuffle
    drawn = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", *names))).filter(F.col("_n") <= size * random)
    by_sets = drawn.withColumn("start", F.ceil(F.col("_n") / size).cast("int")).groupBy("start", *keys).agg(*_moments(names))
    now = persist(_with_inverse(by_median.unionByName(by_sets), names, 1.0, floors), "mcd")
    group, told, last = ["start", *keys], random + 1, None
    for step in range(EARLY + LATE):
        model = now.select(*group, *[f"m_{i}" for i in range(len(names))], *[f"w_{i}_{j}" for i, j in pairs])
        ranked = rows.join(small(model, groups * told), keys).withColumn("bin", F.floor(F.log2(_distance(names) + 1e-9) * BIN).cast("int"))
        bins = ranked.groupBy(*group, "bin").agg(F.count("*").alias("n"))
        upto = Window.partitionBy(*group).orderBy("bin")
        held = bins.withColumn("upto", F.sum("n").over(upto)).join(small(totals, groups), keys).filter(F.col("upto") >= F.ceil(F.col("total") * coverage))
        limit = persist(held.groupBy(*group).agg(F.min("bin").alias("limit")), "mcd-limit")
        closest = ranked.select(*group, *names, "bin").join(small(limit, groups * told), group).filter("bin <= limit")
        now = _with_inverse(closest.groupBy(*group).agg(*_moments(names)), names, factor, floors)
        if step == EARLY - 1:
            now = now.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct("log_det", "start")).alias("best")).select("best.*")
            told = 1
        now = persist(now, "mcd")
        if step >= EARLY - 1:
            # only a number comes to the driver
            fall = last and now.join(last, keys).agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
            if last and (fall is None or fall < SETTLED):
                break
            last = now.select(*keys, F.col("log_det").alias("before"))
    return now.join(totals, keys).select(*keys, "total", "rows", *[f"m_{i}" for i in range(len(names))], *[f"c_{i}_{j}" for i, j in pairs])


def drawn_towards(own: DataFrame, prior: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """``own`` with centre and covariances averaged with those of ``prior``, which counts for ``weight`` rows."""
    cells = [c for c in own.columns if c[:2] in ("m_", "c_")]
    both = own.join(prior.select(*keys, *[F.col(c).alias(f"p_{c}") for c in cells]), keys) if keys else own.crossJoin(F.broadcast(prior.select(*[F.col(c).alias(f"p_{c}") for c in cells])))
    mixed = [((F.col("rows") * F.col(c) + F.lit(float(weight)) * F.col(f"p_{c}")) / (F.col("rows") + F.lit(float(weight)))).alias(c) for c in cells]
    return both.select(*[c for c in own.columns if c not in cells], *mixed)


def robust_outliers(docs: DataFrame, coverage: float = COVERAGE, cutoff: float = CUTOFF, prior_rows: float = PRIOR_ROWS, **columns: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance (squared, null if base_failed), cut, group_rows, kept.

    base_failed: fewer than 20 words, or more than 30 in 100 words in repeated 8-word windows.  Such rows are
    not kept and take no part in the estimates.  A null text has no words, so it fails.  Null languages and
    sources are groups of their own.  One rule holds for groups of all sizes: the estimate of a group with n
    closest rows is n parts its own and ``prior_rows`` parts its language's, which is drawn to that of all rows
    in the same way.  group_rows is the number of rows in a group's estimate.
    """
    marked = statistics(docs, **columns).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    # a null and the text "" must not share a key, nor may nulls be lost in a join
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c)))
    rows = persist(marked.withColumn("k_lang", key("lang")).withColumn("k_source", key("source")), "statistics")
    names = list(VECTOR)
    cut = chi_square_quantile(cutoff, len(names))
    # all three levels at once: a row counts in its group, in its language and in all
    level = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("k_lang"), b.alias("k_source"))
    one, two, none = F.col("k_lang"), F.col("k_source"), F.lit("")
    fine = rows.filter("not base_failed").select(F.xxhash64("doc_id", *names).alias("hash"), *names, F.explode(F.array(level(0, one, two), level(1, one, none), level(2, none, none))).alias("l"))
    found = persist(estimates(fine.select("l.*", "hash", *names), ["level", "k_lang", "k_source"], coverage), "mcd-final")
    at = lambda n, *drop: found.filter(F.col("level") == n).drop("level", *drop)
    by_lang = drawn_towards(at(1, "k_source"), at(2, "k_lang", "k_source"), [], prior_rows)
    by_group = drawn_towards(at(0), by_lang, ["k_lang"], prior_rows)
    model = persist(_with_inverse(by_group, names, consistency(coverage, len(names)), VECTOR).drop("log_det", "total"), "mcd-groups")
    small = model.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(model) if small else model, ["k_lang", "k_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(names)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(cut), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", F.lit(cut).alias("cut"), F.col("rows").alias("group_rows"), kept.alias("kept"))
