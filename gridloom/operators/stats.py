"""Error metrics, regressions and histograms, as aggregates.

Sums over pairs skip rows where either side is missing, as masked arrays do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hexagon, histogram_bin, missing


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both columns are there."""
    return df.where(missing(F.col(x)).isNotNull() & missing(F.col(y)).isNotNull())


def correlation(x: str, y: str) -> Column:
    """Pearson's r; NULL where a side is constant.

    Constant by its ends: merged over partitions, the variance of equal values is not always 0.
    """
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    varied = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), spread))


def errors(df: DataFrame, by: Sequence[str], predicted: str, real: str) -> DataFrame:
    """(by, n, mae, mse, r) of each tile, model or whatever ``by`` names."""
    gap = F.col(predicted) - F.col(real)
    return pairs(df, predicted, real).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), correlation(predicted, real).alias("r")
    )


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, total, mean, std) with the population's standard deviation."""
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def entropy(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int = 128) -> DataFrame:
    """(by, entropy): Shannon's, in bits, of a fixed-range histogram."""
    counts = df.withColumn("_bin", histogram_bin(F.col(value), low, high, bins)).where("_bin IS NOT NULL").groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N
    total = F.sum("_n").cast("double")
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))) / total).alias("entropy"))


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = (), critical: float | None = None) -> DataFrame:
    """(by, n, slope, intercept, r2, stderr, ...) of y on x; with ``critical`` the interval too.

    ``critical`` is the t quantile of the interval (``t_quantile``).  Constant x: NULL; constant y:
    slope and errors are 0.  Constant by its ends, as in ``correlation``.
    """
    own = pairs(df, x, y)
    a, b, zero = F.col(x), F.col(y), F.lit(0.0)
    level, flat = F.min(x) == F.max(x), F.min(y) == F.max(y)
    out = own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(~level, F.when(flat, zero).otherwise(F.regr_slope(b, a))).alias("slope"),
        F.when(~level, F.when(flat, F.min(y).cast("double")).otherwise(F.regr_intercept(b, a))).alias("intercept"),
        F.when(~level, F.when(flat, F.lit(1.0)).otherwise(F.regr_r2(b, a))).alias("r2"),
        F.when(level, zero).otherwise(F.regr_sxx(b, a)).alias("_sxx"),
        F.when(flat, zero).otherwise(F.regr_syy(b, a)).alias("_syy"),
        F.when(level | flat, zero).otherwise(F.regr_sxy(b, a)).alias("_sxy"),
        F.avg(x).alias("_mx"),
    )
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0))
    out = out.withColumn("stderr", F.sqrt(F.try_divide(rest, F.col("_sxx"))))
    out = out.withColumn("intercept_stderr", F.col("stderr") * F.sqrt(F.col("_sxx") / F.col("n") + F.col("_mx") * F.col("_mx")))
    if critical is not None:
        out = out.withColumns({"slope_low": F.col("slope") - critical * F.col("stderr"), "slope_high": F.col("slope") + critical * F.col("stderr")})
    return out.drop("_sxx", "_syy", "_sxy", "_mx")


def inference(fit: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``ols`` rows with p_value of the slope and t-based slope_low, slope_high, intercept_low, intercept_high.

    NULL where there are fewer than three points; with a perfect fit p is 0, but NaN if its slope is 0
    (0 by 0: a constant y).  Rows are fits, not data.
    """
    p, q = F.pandas_udf(_p_values, "double"), F.pandas_udf(lambda n: n.map(lambda v: t_quantile((1 + confidence) / 2, v - 2) if v > 2 else None), "double")
    t = F.try_divide(F.col("slope"), F.col("stderr"))
    perfect = (F.col("n") > 2) & (F.col("stderr") == 0)
    out = fit.withColumns({"p_value": F.when(perfect, F.when(F.col("slope") == 0, float("nan")).otherwise(0.0)).otherwise(p(t, "n")), "_q": q("n")})
    for c, e in (("slope", "stderr"), ("intercept", "intercept_stderr")):
        out = out.withColumns({f"{c}_low": F.col(c) - F.col("_q") * F.col(e), f"{c}_high": F.col(c) + F.col("_q") * F.col(e)})
    return out.drop("_q")


def _p_values(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_incomplete_beta((m - 2) / 2, 0.5, (m - 2) / (m - 2 + v * v)) if m > 2 and v == v else None for v, m in zip(t, n)], dtype="float64")


def robust_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, slope_hc0, intercept_hc0): ordinary fit, sandwich (HC0) standard errors.

    Two passes: the fit, then sums of squared residuals times powers of x; each is one row.
    """
    own = pairs(df, x, y)
    fit = own.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_m"), F.regr_sxx(F.col(y), F.col(x)).alias("_sxx")
    )
    met = own.join(F.broadcast(fit))  # one row
    e2 = F.pow(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"), 2)
    d = F.col(x) - F.col("_m")
    # With centred x the bread is diagonal: var(slope) = S d2 e2 / sxx^2, and the mean's error adds in.
    sums = met.groupBy("slope", "intercept", "_n", "_m", "_sxx").agg(F.sum(e2).alias("s0"), F.sum(d * e2).alias("s1"), F.sum(d * d * e2).alias("s2"))
    n, m, sxx = F.col("_n"), F.col("_m"), F.col("_sxx")
    of_slope = F.col("s2") / (sxx * sxx)
    of_intercept = F.col("s0") / (n * n) - 2 * m * F.col("s1") / (n * sxx) + m * m * of_slope
    return sums.select("slope", "intercept", F.sqrt(of_slope).alias("slope_hc0"), F.sqrt(of_intercept).alias("intercept_hc0"))


def fitted_band(fit: DataFrame, points: int = 100, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """(x, y, y_low, y_high): a power law over ``points`` log-spaced x between 10**low and 10**high."""
    step = (high - low) / (points - 1)
    xs = fit.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit(step)))))
    at = lambda s: F.pow("x", F.col(s)) * F.exp("intercept")
    return xs.select("x", at("slope").alias("y"), at("slope_low").alias("y_low"), at("slope_high").alias("y_high"))


def hexbin(df: DataFrame, x: str, y: str, size_x: float, size_y: float) -> DataFrame:
    """(hx, hy, n, log_n) of a hexagonal histogram."""
    hx, hy = hexagon(F.col(x), F.col(y), size_x, size_y)
    return pairs(df, x, y).groupBy(hx.alias("hx"), hy.alias("hy")).agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))


def value_positions(px: DataFrame, value: str = "value") -> DataFrame:
    """(value, n, first_row, first_col): where values are, without gathering lists of positions."""
    return px.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "col")).alias("_f")).select(value, "n", F.col("_f.row").alias("first_row"), F.col("_f.col").alias("first_col"))


def positions(px: DataFrame, value: str = "value") -> DataFrame:
    """(value, row, col, ordinal): every position of every value, one row each instead of a list a value.

    Ordinals count from 0 within a raster row, so that a value of any frequency stays spread out.
    """
    at = F.row_number().over(Window.partitionBy(value, "row").orderBy("col")) - 1
    return px.select(value, "row", "col").withColumn("ordinal", at)


def discriminator_loss(df: DataFrame, by: Sequence[str], fake: str, real: str, kind: str = "logits") -> DataFrame:
    """(by, d_loss): mean of the two terms, with logits (softplus) or least squares."""
    if kind == "logits":
        softplus = lambda c: F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))
        terms = softplus(F.col(fake)), softplus(-F.col(real))
    else:
        terms = F.pow(F.col(fake), 2), F.pow(F.col(real) - 1, 2)
    return df.groupBy(*by).agg(((F.avg(terms[0]) + F.avg(terms[1])) / 2).alias("d_loss"))


def generator_loss(df: DataFrame, by: Sequence[str], fake: str, predicted: str, real: str, weight: float = 100.0, kind: str = "logits") -> DataFrame:
    """(by, g_loss): adversarial term plus ``weight`` times the mean absolute error."""
    c = F.col(fake)
    term = F.greatest(-c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c))) if kind == "logits" else F.pow(c - 1, 2)
    return df.groupBy(*by).agg((F.avg(term) + weight * F.avg(F.abs(F.col(predicted) - F.col(real)))).alias("g_loss"))


def t_cdf(t: float, df: float) -> float:
    """Student's t distribution, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    tail = 0.5 * _incomplete_beta(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    """Its inverse, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total
