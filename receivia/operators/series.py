"""Diagnostics over many series at once; panels have series_key, t (from 1 without gaps) and y.

All of it is windows, aggregates and array functions; only the tails of a few distributions are looked up in Python, a row a series.
Series too short for a statistic give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Published upper points of the KPSS statistic of a level, with their probabilities.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
#: Published response surfaces of the unit-root statistic with a constant, in powers of 1 / n.
UNIT_ROOT_POINTS = {
    "1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "10pct": (-2.56677, -1.5384, -2.809),
}
#: Its published probabilities, as normal scores in powers of the statistic below and above a border.
UNIT_ROOT_BORDER, UNIT_ROOT_ENDS = -1.61, (-18.83, 2.74)
UNIT_ROOT_BELOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def of_series() -> WindowSpec:
    return W.partitionBy("series_key")


def in_order() -> WindowSpec:
    return of_series().orderBy("t")


def _months_by_key(df: DataFrame, key: str | None, period: str, value: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A row per key with all periods of the data (_months), and the value of one of them, absent ones as 0. Keys, periods
    and values all come from one table of sums; each reads all its columns, so that Spark makes it once."""
    k = F.lit("all") if key is None else F.col(key)
    by = df.groupBy(k.alias("series_key"), F.col(period).alias("month")).agg(F.sum(value).cast("double").alias("y"))
    months = by.groupBy("month").agg(F.count("y").alias("_n")).filter("_n >= 0").select("month").withColumn("t", F.row_number().over(W.orderBy("month")))
    dated = by.join(F.broadcast(months), "month", "left")  # a few hundred periods at most
    known = F.map_from_entries(F.filter(F.collect_list(F.struct("t", "y")), lambda r: r["t"].isNotNull()))
    keys = dated.groupBy("series_key").agg(F.when(F.col("series_key").isNotNull(), known).alias("_y"))
    every = months.agg(F.array_sort(F.collect_list(F.struct("t", "month"))).alias("_months"))
    return keys.crossJoin(F.broadcast(every)), lambda r: F.coalesce(F.try_element_at("_y", r["t"]), F.lit(0.0))


def panel(df: DataFrame, key: str | None, period: str, value: str) -> DataFrame:
    """series_key, t, month, y with every period of the data for every key, absent ones as 0. A key's periods
    meet in one row before absent ones are added, so that what follows finds its rows by series_key without moving them."""
    whole, y = _months_by_key(df, key, period, value)
    rows = F.transform("_months", lambda r: F.struct(r["t"].alias("t"), r["month"].alias("month"), y(r).alias("y")))
    return whole.select("series_key", F.inline(rows))


def panel_rows(df: DataFrame, key: str | None, period: str, value: str) -> DataFrame:
    """A panel with a row per key: series_key and y, the values of all periods in their order."""
    whole, y = _months_by_key(df, key, period, value)
    return whole.select("series_key", F.transform("_months", y).alias("y"))


def autocorrelation(p: DataFrame, lags: int = 8) -> DataFrame:
    """series_key, lag, acf, ci for lags 0 to lags."""
    c = p.withColumn("d", F.col("y") - F.avg("y").over(of_series())).withColumn("n", F.count("*").over(of_series()))
    products = [F.coalesce(F.col("d") * F.lag("d", k).over(in_order()), F.lit(0.0)).alias(f"p{k}") if k else (F.col("d") * F.col("d")).alias("p0") for k in range(lags + 1)]
    by = c.select("series_key", "n", *products).groupBy("series_key", "n").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(lags + 1)])
    rows = by.select("series_key", "n", "p0", F.posexplode(F.array(*[F.col(f"p{k}") for k in range(lags + 1)])).alias("lag", "p")).filter("lag < n")
    return rows.select("series_key", "lag", "n", F.round(F.try_divide("p", "p0"), 6).alias("acf"), F.round(1.96 / F.sqrt("n"), 6).alias("ci"), F.try_divide("p", "p0").alias("_raw"))


def ljung_box(p: DataFrame, lags: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Statistic and p value per even number of lags; the tail of even degrees is a finite sum."""
    a = autocorrelation(p, max(lags)).filter("lag > 0")
    out = []
    for m in lags:
        q = F.sum(F.when(F.col("lag") <= m, F.col("_raw") * F.col("_raw") / (F.col("n") - F.col("lag")))) * F.max("n") * (F.max("n") + 2)
        by = a.groupBy("series_key").agg(q.alias("q"))
        tail = F.exp(-F.col("q") / 2) * sum((F.pow(F.col("q") / 2, k) / math.factorial(k) for k in range(m // 2)), F.lit(0.0))
        out.append(by.select("series_key", F.lit(m).alias("lags"), F.round("q", 6).alias("stat"), F.round(tail, 6).alias("p")))
    return sum_union(out)


def sum_union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


def kpss(p: DataFrame, lags: int = 1) -> DataFrame:
    """Level stationarity statistic with a Bartlett window of a given number of lags."""
    c = p.withColumn("e", F.col("y") - F.avg("y").over(of_series()))
    c = c.withColumn("s", F.sum("e").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    cross = [F.coalesce(F.col("e") * F.lag("e", k).over(in_order()), F.lit(0.0)).alias(f"c{k}") for k in range(1, lags + 1)]
    by = c.select("series_key", "e", "s", *cross).groupBy("series_key").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("e") * F.col("e")).alias("ee"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    var = (F.col("ee") + sum((2 * (1 - k / (lags + 1)) * F.col(f"c{k}") for k in range(1, lags + 1)), F.lit(0.0))) / F.col("n")
    return by.select("series_key", F.round(F.try_divide(F.col("ss") / (F.col("n") * F.col("n")), var), 6).alias("stat"))


def automatic_kpss(p: DataFrame) -> DataFrame:
    """series_key, lags, stat, p: the lag comes from each series' own autocovariances; p is interpolated
    between the published points, 0.10 and 0.01 beyond them. Series of one value give null."""
    c = p.withColumn("e", F.col("y") - F.avg("y").over(of_series()))
    c = c.withColumn("s", F.sum("e").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("t", "e")))  # one number per month
    by = c.groupBy("series_key").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.transform(rows, lambda r: r["e"]).alias("e"))

    def up_to(last):
        return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def product(k):
        """Sum of e times e, k months apart."""
        return F.aggregate(F.sequence(k + 1, F.col("n")), F.lit(0.0), lambda a, i: a + F.get("e", i - 1) * F.get("e", i - 1 - k))

    def total(of, term):
        return F.aggregate(of, F.lit(0.0), lambda a, k: a + term(k))

    first = F.least(F.floor(F.pow("n", F.lit(2 / 9))).cast("int"), F.col("n") - 1)
    by = by.filter("n > 1").withColumn("first", F.transform(up_to(first), lambda k: F.struct(k.alias("k"), (product(k) * 2 / F.col("n")).alias("v"))))
    by = by.withColumn("s1", total(F.col("first"), lambda r: r["k"] * r["v"])).withColumn("s0", F.col("ee") / F.col("n") + total(F.col("first"), lambda r: r["v"]))
    width = 1.1447 * F.pow(F.pow(F.try_divide("s1", "s0"), F.lit(2.0)), F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3))
    by = by.withColumn("lags", F.least(F.floor(width).cast("int"), F.col("n") - 1))
    var = (F.col("ee") + total(up_to(F.col("lags")), lambda k: 2 * (1 - k / (F.col("lags") + 1)) * product(k))) / F.col("n")
    by = by.withColumn("x", F.try_divide(F.col("ss") / (F.col("n") * F.col("n")), var))
    tail = F.when(F.col("x") <= KPSS_POINTS[0][0], F.lit(KPSS_POINTS[0][1]))
    for (a, pa), (b, pb) in zip(KPSS_POINTS, KPSS_POINTS[1:]):
        tail = tail.when(F.col("x") <= b, pa + (F.col("x") - a) / (b - a) * (pb - pa))
    tail = tail.when(F.col("x").isNotNull(), F.lit(KPSS_POINTS[-1][1]))
    return by.select("series_key", "lags", F.round("x", 6).alias("stat"), F.round(tail, 6).alias("p"))


def decompose(p: DataFrame, period: int = 12) -> DataFrame:
    """Additive trend, season and rest; series under two periods are refused and left out."""
    half = period // 2
    w = in_order().rowsBetween(-half, half)
    inner = in_order().rowsBetween(-half + 1, half - 1)
    whole = p.withColumn("n", F.count("*").over(of_series())).filter(F.col("n") >= 2 * period)
    full = F.count("*").over(w) == period + 1
    trend = F.when(full, ((F.sum("y").over(w) - F.sum("y").over(inner)) / 2 + F.sum("y").over(inner)) / period)
    d = whole.withColumn("trend", trend).withColumn("_m", F.col("t") % period)
    season = d.withColumn("_s", F.avg(F.col("y") - F.col("trend")).over(W.partitionBy("series_key", "_m")))
    means = season.select("series_key", "_m", "_s").distinct().groupBy("series_key").agg(F.avg("_s").alias("_a"))
    return season.join(means, "series_key").select("series_key", "t", "y", F.round("trend", 4).alias("trend"), F.round(F.col("_s") - F.col("_a"), 4).alias("seasonal"), F.round(F.col("y") - F.col("trend") - F.col("_s") + F.col("_a"), 4).alias("resid"))


def chow(p: DataFrame, split: int) -> DataFrame:
    """F statistic of a break in a linear trend at split (first t of the second part)."""
    def parts(cond):
        x, y = F.when(cond, F.col("t").cast("double")), F.when(cond, F.col("y"))
        n, sx, sy = F.count(x), F.sum(x), F.sum(y)
        sxx, syy, sxy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n, F.sum(x * y) - sx * sy / n
        return n, syy - F.try_divide(sxy * sxy, sxx)

    (n, r), (n1, r1), (n2, r2) = parts(F.lit(True)), parts(F.col("t") < split), parts(F.col("t") >= split)
    by = p.groupBy("series_key").agg(n.alias("n"), r.alias("r"), n1.alias("n1"), r1.alias("r1"), n2.alias("n2"), r2.alias("r2"))
    stat = F.try_divide((F.col("r") - F.col("r1") - F.col("r2")) / 2, (F.col("r1") + F.col("r2")) / (F.col("n") - 4))
    return by.select("series_key", F.when((F.col("n1") >= 3) & (F.col("n2") >= 3) & (F.col("n") > 4), F.round(stat, 6)).alias("stat"))


# Regression on constant, trend and first harmonic, as grouped sums; x1 to x3 are trend, sin and cos.

PAIRS = ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))


def harmonic(p: DataFrame, period: int = 12) -> DataFrame:
    """series_key, t, y, n, the regressors x1 to x3 and, as z1 to z3 and zy, their distances from the series' means."""
    a = 2 * math.pi * F.col("t") / period
    d = p.select("series_key", "t", "y", F.col("t").cast("double").alias("x1"), F.sin(a).alias("x2"), F.cos(a).alias("x3"), F.count("*").over(of_series()).alias("n"))
    return d.withColumns({z: F.col(x) - F.avg(x).over(of_series()) for x, z in (("x1", "z1"), ("x2", "z2"), ("x3", "z3"), ("y", "zy"))})


def _products(a: str, out: str) -> list:
    return [F.sum(F.col(f"{a}{i}") * F.col(f"{a}{j}")).alias(f"{out}{i}{j}") for i, j in PAIRS]


def inverse(by: DataFrame, a: str, out: str) -> DataFrame:
    """Adds the inverse of the symmetric matrix a11 to a33; null where there is none."""
    a11, a12, a13, a22, a23, a33 = (F.col(f"{a}{i}{j}") for i, j in PAIRS)
    minors = (a22 * a33 - a23 * a23, a13 * a23 - a12 * a33, a12 * a23 - a13 * a22, a11 * a33 - a13 * a13, a12 * a13 - a11 * a23, a11 * a22 - a12 * a12)
    names = [f"{out}{i}{j}" for i, j in PAIRS]
    by = by.withColumns(dict(zip(names, minors, strict=True)))
    by = by.withColumn("_det", a11 * F.col(names[0]) + a12 * F.col(names[1]) + a13 * F.col(names[2]))
    return by.withColumns({c: F.try_divide(c, "_det") for c in names}).drop("_det")


def form(inv: str, u: str, v: str):
    """u' inverse v of two vectors of three columns."""
    return sum((F.col(f"{inv}{min(i, j)}{max(i, j)}") * F.col(f"{u}{i}") * F.col(f"{v}{j}") for i in (1, 2, 3) for j in (1, 2, 3)), F.lit(0.0))


def fits(d: DataFrame) -> DataFrame:
    """Per series of harmonic(): n, coefficients b0 to b3, sums of squares and the inverse i11 to i33; series under five months are left out."""
    by = d.filter("n > 4").groupBy("series_key", "n").agg(*_products("z", "a"), *_products("x", "m"), *[F.sum(F.col(f"z{i}") * F.col("zy")).alias(f"c{i}") for i in (1, 2, 3)], *[F.avg(f"x{i}").alias(f"u{i}") for i in (1, 2, 3)], F.avg("y").alias("mean"), F.sum(F.col("zy") * F.col("zy")).alias("yy"))
    by = inverse(inverse(by, "a", "i"), "m", "j")
    by = by.withColumns({f"b{i}": sum((F.col(f"i{min(i, j)}{max(i, j)}") * F.col(f"c{j}") for j in (1, 2, 3)), F.lit(0.0)) for i in (1, 2, 3)})
    return by.withColumn("b0", F.col("mean") - F.col("b1") * F.col("u1") - F.col("b2") * F.col("u2") - F.col("b3") * F.col("u3"))


def _with_residuals(d: DataFrame, f: DataFrame) -> DataFrame:
    inside = F.col("b1") * F.col("z1") + F.col("b2") * F.col("z2") + F.col("b3") * F.col("z3")
    return d.drop("n").join(f, "series_key").withColumn("h", inside).withColumn("e", F.col("zy") - F.col("h"))


def residuals(p: DataFrame) -> DataFrame:
    """series_key, t, e: residuals of trend and first harmonic; series under five months are left out."""
    d = harmonic(p)
    return _with_residuals(d, fits(d)).select("series_key", "t", "e")


def regression(p: DataFrame) -> DataFrame:
    """One row per series of eight months or more that is not constant: coefficients with their t values, R2, F,
    Breusch-Pagan, the F of the squared fit (RESET) and the variance inflation of each regressor (no constant)."""
    d = harmonic(p)
    f = fits(d).filter("n >= 8 AND yy > 0")
    r = _with_residuals(d, f)
    # Squared residuals (q) and squared fits (w) about their means, regressed through the same inverse.
    q, w = F.col("e") * F.col("e"), F.col("h") * F.col("h")
    r = r.withColumns({"q": q - F.avg(q).over(of_series()), "w": w - F.avg(w).over(of_series())})
    again = r.groupBy("series_key").agg(F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("e") * F.col("w")).alias("ew"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("w") * F.col("w")).alias("ww"), *[F.sum(F.col(f"z{i}") * F.col(v)).alias(f"{v}{i}") for v in "qw" for i in (1, 2, 3)])
    by = f.join(again, "series_key")
    s2 = F.col("ee") / (F.col("n") - 4)
    drop = F.try_divide(F.col("ew") * F.col("ew"), F.col("ww") - form("i", "w", "w"))  # what the squared fit takes from ee
    r2 = 1 - F.col("ee") / F.col("yy")
    ts = {"const_t": F.try_divide("b0", F.sqrt(s2 * (1 / F.col("n") + form("i", "u", "u"))))} | {f"{x}_t": F.try_divide(f"b{i}", F.sqrt(s2 * F.col(f"i{i}{i}"))) for i, x in ((1, "trend"), (2, "sin"), (3, "cos"))}
    return by.select(
        "series_key", "n", F.col("b0").alias("const"), F.col("b1").alias("trend"), F.col("b2").alias("sin"), F.col("b3").alias("cos"), *[v.alias(k) for k, v in ts.items()],
        r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 4)).alias("adj_r2"), F.try_divide((F.col("yy") - F.col("ee")) / 3, s2).alias("f"),
        (F.col("n") * F.try_divide(form("i", "q", "q"), F.col("qq"))).alias("breusch_pagan"), F.try_divide(drop, (F.col("ee") - drop) / (F.col("n") - 5)).alias("reset_f"),
        *[(F.col(f"m{i}{i}") * F.col(f"j{i}{i}")).alias(f"vif_{x}") for i, x in ((1, "trend"), (2, "sin"), (3, "cos"))],
    )


def _less(v: str):
    return lambda a, b: a - F.col(v) * b


def partial_autocorrelation(p: DataFrame, lags: int = 8) -> DataFrame:
    """series_key, lag, pacf for lags 0 to the least of lags and n / 2 - 1: Durbin-Levinson on autocovariances scaled by n - lag.
    Series under eight months or of one value are left out."""
    a = autocorrelation(p, lags).filter(f"n >= 8 AND lag <= least({lags}, n div 2 - 1)")
    by = a.groupBy("series_key").agg(*[F.max(F.when(F.col("lag") == k, F.col("_raw") * F.col("n") / (F.col("n") - k))).alias(f"r{k}") for k in range(lags + 1)], F.max("lag").alias("most"))
    by = by.filter("r0 IS NOT NULL").withColumns({"v0": F.lit(1.0), "v1": F.col("r1"), "phi": F.array("r1")})
    for k in range(2, lags + 1):
        back, ahead = (F.array(*[F.col(f"r{j}") for j in order]) for order in (range(k - 1, 0, -1), range(1, k)))

        def dot(x):
            return F.aggregate(F.zip_with("phi", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

        by = by.withColumn(f"v{k}", F.try_divide(F.col(f"r{k}") - dot(back), 1 - dot(ahead)))
        by = by.withColumn("phi", F.concat(F.zip_with("phi", F.reverse("phi"), _less(f"v{k}")), F.array(f"v{k}")))
    return by.select("series_key", "most", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(lags + 1)])).alias("lag", "pacf")).filter("lag <= most").drop("most")


def residual_checks(resid: DataFrame) -> DataFrame:
    """Durbin-Watson and Jarque-Bera of residuals (series_key, t, e)."""
    d = resid.withColumn("_d", F.col("e") - F.lag("e").over(in_order()))
    by = d.groupBy("series_key").agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("dd"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.skewness("e").alias("s"), F.kurtosis("e").alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return by.select("series_key", F.round(F.try_divide("dd", "ee"), 6).alias("durbin_watson"), F.round(jb, 6).alias("jarque_bera"), F.round(F.exp(-jb / 2), 6).alias("jb_p"), F.round("s", 6).alias("skew"), F.round(F.col("k") + 3, 6).alias("kurtosis"))


# What needs a search or a wide design, as small numpy helpers on one series.


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, y - x @ b


def design(t: np.ndarray, period: int = 12) -> np.ndarray:
    """Constant, trend and first harmonic of times t, which count from 1."""
    a = 2 * np.pi * t / period
    return np.column_stack([np.ones_like(t), t, np.sin(a), np.cos(a)])


def r_squared(y: np.ndarray, e: np.ndarray) -> float:
    around = ((y - y.mean()) ** 2).sum()
    return 1 - (e @ e) / around if around > 0 else math.nan


def beta_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom, by the incomplete beta's continued fraction."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def chi2_tail(q: float, df: int) -> float:
    """P(chi2 > q): a finite sum for even df, built on erfc for odd."""
    if df % 2 == 0:
        return math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(df // 2))
    out, term = math.erfc(math.sqrt(q / 2)), math.sqrt(2 * q / math.pi) * math.exp(-q / 2)
    for k in range(1, df, 2):
        out += term
        term *= q / (k + 2)
    return out


@F.pandas_udf(DoubleType())
def chi2_three(q: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with three degrees of freedom, for one aggregated row per series."""
    return pd.Series([math.nan if math.isnan(a) else chi2_tail(max(a, 0.0), 3) for a in q])


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of F, for one aggregated row per series."""
    return pd.Series([math.nan if math.isnan(a) else beta_tail(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)])


# Nested designs from one matrix of products per series, in array functions. A design is an array of columns, of
# which the last is what is explained; Gaussian elimination of its products, in the order of its columns,
# gives the sum of squares that is left after each of them.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def up_to(last: Column) -> Column:
    """Whole numbers from 0 to last."""
    return F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def products(design_: Column) -> Column:
    """The products of all pairs of columns, row by row in one array."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    return F.flatten(F.transform(design_, lambda x: F.transform(design_, lambda y: dot(x, y))))


def eliminated(gram: Column, k: Column) -> Column:
    """The products of k columns after elimination: row i is as it was when column i was its pivot. A pivot that is
    nothing but rounding of a column that those before it span is passed over, and is 0."""
    at = lambda m, i, j: F.get(m, (i * k + j).cast("int"))

    def step(m: Column, p: Column) -> Column:
        pivot = at(m, p, p)
        whole = pivot > 1e-10 * at(gram, p, p)

        def entry(v: Column, n: Column) -> Column:
            i, j = F.floor(n / k), n % k
            return F.when((i > p) & whole, v - at(m, i, p) * at(m, p, j) / pivot).when((i == p) & ~whole, F.lit(0.0)).otherwise(v)

        return F.transform(m, entry)

    return F.aggregate(up_to(k - 2), gram, step)


def explained(u: Column, k: Column, columns: Column) -> Column:
    """What the first columns take from the sum of squares of the last column."""
    at = lambda i, j: F.get(u, (i * k + j).cast("int"))
    return F.aggregate(up_to(columns - 1), F.lit(0.0), lambda acc, i: acc + F.when(at(i, i) > 0, at(i, k - 1) * at(i, k - 1) / at(i, i)).otherwise(0.0))


def _by_series(p: DataFrame) -> DataFrame:
    """series_key, n and e: the values about their mean, by month (one number a month)."""
    rows = F.array_sort(F.collect_list(F.struct("t", "y")))
    by = p.groupBy("series_key").agg(rows.alias("rows"), F.avg("y").alias("mean"), F.count("*").cast("int").alias("n"))
    return by.select("series_key", "n", F.transform("rows", lambda r: r["y"] - F.col("mean")).alias("e"))


#: Terms of the normal distribution's series, enough for arguments up to 7.
NORMAL_TERMS = 90


def normal_below(x: Column) -> Column:
    """The standard normal distribution function."""
    odd = [1.0]
    for k in range(1, NORMAL_TERMS):
        odd.append(odd[-1] / (2 * k + 1))
    terms = F.aggregate(F.array(*map(F.lit, reversed(odd))), F.lit(0.0), lambda acc, c: acc * x * x + c)
    return F.when(x < -7, 0.0).when(x > 7, 1.0).otherwise(0.5 + x * terms * F.exp(-x * x / 2) / math.sqrt(2 * math.pi))


def unit_roots(p: DataFrame, least: int = 10) -> DataFrame:
    """series_key, stat, lags, p and critical values (one_pct, five_pct, ten_pct) of the unit-root statistic with a
    constant. The lags of differences are those with the least AIC over the months that all of them have; all
    come from one elimination. Series of fewer than least months or of one value give no row."""
    by = _by_series(p).filter((F.col("n") >= least) & (F.array_max("e") > F.array_min("e")))
    d = F.transform(up_to(F.col("n") - 2), lambda i: F.get("e", i + 1) - F.get("e", i))
    by = by.withColumn("d", d).withColumn("most", F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int"))

    def columns(rows: Column, lags: Column) -> tuple[Column, Column, Column, Column]:
        """Constant, level, lagged differences and difference, as arrays of columns, for rows (numbers of differences)."""
        one = lambda c: F.array(c)
        lagged = F.transform(F.filter(up_to(lags), lambda k: k > 0), lambda k: F.transform(rows, lambda r: F.get("d", r - k)))
        return one(F.transform(rows, lambda r: F.lit(1.0))), one(F.transform(rows, lambda r: F.get("e", r))), lagged, one(F.transform(rows, lambda r: F.get("d", r)))

    def best(rows: Column) -> Column:
        const, level, lagged, now = columns(rows, F.col("most"))
        n, k = F.size(rows).cast("double"), F.col("most") + 3
        total = lambda g: F.get(g, k * k - 1)

        def score(g: Column, u: Column) -> Column:
            aic = lambda lags: n * F.log((total(g) - explained(u, k, lags + 2)) / n) + 2 * lags
            return F.array_min(F.transform(up_to(F.col("most")), lambda lags: F.struct(aic(lags).alias("aic"), lags.alias("lags"))))["lags"]

        return let(products(F.concat(const, level, lagged, now)), lambda g: let(eliminated(g, k), lambda u: score(g, u)))

    after = lambda first: F.filter(up_to(F.col("n") - 2), lambda r: r >= first)
    by = by.withColumn("lags", let(after(F.col("most")), best))

    def statistic(rows: Column) -> Column:
        const, level, lagged, now = columns(rows, F.col("lags"))
        n, k = F.size(rows), F.col("lags") + 3

        def of(g: Column, u: Column) -> Column:
            rest = F.get(g, k * k - 1) - explained(u, k, k - 1)
            at = (k - 2) * k
            return F.try_divide(F.get(u, at + k - 1), F.sqrt(F.get(u, at + k - 2) * rest / (n - k + 1)))

        return let(products(F.concat(const, lagged, level, now)), lambda g: let(eliminated(g, k), lambda u: of(g, u)))

    by = by.withColumn("stat", let(after(F.col("lags")), statistic)).withColumn("used", (F.col("n") - 1 - F.col("lags")).cast("double"))
    x = F.col("stat")
    power = lambda c, of: sum((v * F.pow(of, F.lit(float(k))) for k, v in enumerate(c)), F.lit(0.0))
    tail = F.when(x > UNIT_ROOT_ENDS[1], 1.0).when(x < UNIT_ROOT_ENDS[0], 0.0).when(x <= UNIT_ROOT_BORDER, normal_below(power(UNIT_ROOT_BELOW, x))).when(x.isNotNull(), normal_below(power(UNIT_ROOT_ABOVE, x)))
    names = {"1pct": "one_pct", "5pct": "five_pct", "10pct": "ten_pct"}
    return by.select("series_key", "stat", "lags", tail.alias("p"), *[power(c, 1 / F.col("used")).alias(names[at]) for at, c in UNIT_ROOT_POINTS.items()])


def chi2_above(q: Column, df: Column, most: int = 12) -> Column:
    """P(chi2 > q) for 1 to most degrees of freedom: finite sums."""
    even, odd = F.lit(0.0), 2 * normal_below(-F.sqrt(q))
    out = F.lit(None).cast("double")
    for k in range(1, most + 1):
        half = (k - 2) / 2 if k % 2 == 0 else k / 2 - 1
        if k % 2 == 0:
            even = even + F.pow(q / 2, F.lit(half)) / math.gamma(half + 1) * F.exp(-q / 2)
        elif k > 1:
            odd = odd + F.pow(q / 2, F.lit(half)) / math.gamma(half + 1) * F.exp(-q / 2)
        out = F.when(df == k, even if k % 2 == 0 else odd).otherwise(out)
    return out


def white(p: DataFrame, period: int = 12, least: int = 10) -> DataFrame:
    """series_key, stat, df, p of White's test of the squared residuals of trend and first harmonic: they are
    explained by the regressors and all their products, of which those that others span don't count. Series of
    fewer than least months or of one value, and those with no more months than regressors, give no row."""
    squared = residuals(p).select("series_key", "t", (F.col("e") * F.col("e")).alias("y"))
    several = p.groupBy("series_key").agg(F.max("y").alias("a"), F.min("y").alias("b")).filter("a > b").select("series_key")
    by = _by_series(squared).filter(F.col("n") >= least).join(several, "series_key")
    rows = F.filter(up_to(F.col("n")), lambda t: t > 0)
    x = [lambda t: F.lit(1.0), lambda t: t.cast("double"), lambda t: F.sin(2 * math.pi * t / period), lambda t: F.cos(2 * math.pi * t / period)]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    product = lambda i, j: F.transform(rows, lambda t: x[i](t) * x[j](t))
    design_ = F.concat(F.array(*[product(i, j) for i, j in pairs]), F.array("e"))
    k = F.lit(len(pairs) + 1)

    def of(g: Column, u: Column) -> Column:
        pivots = F.size(F.filter(up_to(k - 2), lambda i: F.get(u, i * k + i) > 0))
        return F.struct((F.col("n") * F.try_divide(explained(u, k, k - 1), F.get(g, k * k - 1))).alias("stat"), (pivots - 1).alias("df"))

    fitted = by.withColumn("w", let(products(design_), lambda g: let(eliminated(g, k), lambda u: of(g, u)))).filter("n > w.df + 1")
    return fitted.select("series_key", "w.stat", "w.df", chi2_above(F.col("w.stat"), F.col("w.df")).alias("p"))


def diagnostics(p: DataFrame) -> DataFrame:
    """series_key, stat, value: regression, specification and unit-root statistics of every series."""

    r, rest = regression(p), F.col("n") - 4
    t = ("const", "trend", "sin", "cos")
    tails = {f"ols_{x}_p": f_tail(F.col(f"{x}_t") * F.col(f"{x}_t"), F.lit(1), rest) for x in t} | {"ols_f_p": f_tail("f", F.lit(3), rest), "reset_p": f_tail("reset_f", F.lit(1), rest - 1)}
    values = {f"ols_{x}": F.col(x) for x in (*t, "r2", "adj_r2", "f")} | {x: F.col(x) for x in ("breusch_pagan", "reset_f", "vif_trend", "vif_sin", "vif_cos")}
    values["breusch_pagan_p"] = chi2_three("breusch_pagan")
    wide = r.select("series_key", *[v.alias(k) for k, v in (values | tails).items()])
    names = [*values, *tails]
    fitted = wide.select("series_key", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in names])).alias("r")).select("series_key", "r.stat", "r.value")
    partial = partial_autocorrelation(p).select("series_key", F.concat(F.lit("pacf_"), "lag").alias("stat"), F.col("pacf").alias("value"))
    def long(df: DataFrame, names: dict[str, str]) -> DataFrame:
        return df.select("series_key", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(c).cast("double").alias("value")) for k, c in names.items()])).alias("r")).select("series_key", "r.stat", "r.value")

    tests = [long(white(p), {"white": "stat", "white_p": "p"})]
    steps = p.withColumn("y", F.col("y") - F.lag("y").over(in_order())).filter("t > 1").withColumn("t", F.col("t") - 1)
    for name, of in (("adf_level", p), ("adf_diff", steps)):
        tests.append(long(unit_roots(of), {name: "stat", f"{name}_lags": "lags", f"{name}_p": "p", f"{name}_1pct": "one_pct", f"{name}_5pct": "five_pct", f"{name}_10pct": "ten_pct"}))
    return sum_union([fitted, partial, *tests])
