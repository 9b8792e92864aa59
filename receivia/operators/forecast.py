"""Forecasts of many series at once; panels have series_key, t (from 1 without gaps) and y."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.operators.series import PAIRS, design, form, inverse, least_squares, residuals

STEPS = "series_key string, step int, model string, forecast double"


def naive(p: DataFrame, horizon: int) -> DataFrame:
    last = p.groupBy("series_key").agg(F.max_by("y", "t").alias("f"))
    return last.select("series_key", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.lit("naive").alias("model"), F.col("f").alias("forecast"))


def drift(p: DataFrame, horizon: int) -> DataFrame:
    """The last value and the mean step from the first to it."""
    by = p.groupBy("series_key").agg(F.max_by("y", "t").alias("b"), F.min_by("y", "t").alias("a"), F.count("*").alias("n"))
    steps = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select("series_key", "step", F.lit("drift").alias("model"), (F.col("b") + F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.col("n") - 1), F.lit(0.0)) * F.col("step")).alias("forecast"))


def difference_ar(p: DataFrame, horizon: int) -> DataFrame:
    """First differences as a first-order autoregression by conditional least squares, without a
    constant; k steps ahead the last difference is carried on by powers of its coefficient."""
    o = W.partitionBy("series_key").orderBy("t")
    d = p.withColumn("d", F.col("y") - F.lag("y").over(o))
    d = d.withColumn("l", F.lag("d").over(o))
    by = d.groupBy("series_key").agg(F.try_divide(F.sum(F.col("d") * F.col("l")), F.sum(F.when(F.col("d").isNotNull(), F.col("l") * F.col("l")))).alias("phi"), F.max_by("y", "t").alias("b"), F.max_by("d", "t").alias("last"))
    steps = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    carried = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0.0), lambda a, k: a + F.pow(F.coalesce(F.col("phi"), F.lit(0.0)), k.cast("double")))
    return steps.select("series_key", "step", F.lit("difference_ar").alias("model"), (F.col("b") + F.coalesce("last", F.lit(0.0)) * carried).alias("forecast"))


# Fits of one series.


def _holt_errors(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors for zero initial level and slope, and how they depend on the two. y has months by series."""
    out = []
    for start, trend, own in ((0.0, 0.0, y), (1.0, 0.0, 0 * y), (0.0, 1.0, 0 * y)):
        errors, level, slope = np.empty(y.shape), start, trend
        for i, v in enumerate(own):
            errors[i] = v - level - slope
            before, level = level, a * v + (1 - a) * (level + slope)
            slope = b * (level - before) + (1 - b) * slope
        out.append(errors)
    return out[0], out[1], out[2]


def _solved(e: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares and best start of each series (a column) from its errors and how they depend on the start."""
    sse, start = np.empty(e.shape[1]), np.empty((len(by), e.shape[1]))
    for s in range(e.shape[1]):
        start[:, s], rest = least_squares(np.column_stack([-g[:, s] for g in by]), np.ascontiguousarray(e[:, s]))
        sse[s] = rest @ rest
    return sse, start


def _holt_at(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares and best start, of one series or of many (months by series)."""
    sse, start = _solved(*_holt_errors(y.reshape(len(y), -1), a, b))
    return sse.reshape(y.shape[1:]), start.reshape(-1, *y.shape[1:])


def _without(x: np.ndarray, y: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Columns of y less their part along those of x."""
    product = x * y
    part = product.sum(axis=0)
    size = np.multiply(x, x, out=product).sum(axis=0) if size is None else size
    np.multiply(x, np.divide(part, size, out=np.zeros_like(size), where=size > 0), out=product)
    return np.subtract(y, product, out=product)


def _holt_losses(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squares as _holt_at gives them, for many parameters (and series: months first) at once."""
    level, slope, step = np.zeros((3, *a.shape)), np.zeros((3, *a.shape)), np.empty((3, *a.shape))
    level[1], slope[2] = 1.0, 1.0
    errors, ab = np.empty((3, len(y), *a.shape)), a * b
    for i, v in enumerate(y):
        e = errors[:, i]
        np.negative(np.add(level, slope, out=step), out=e)
        e[0] += v
        level += slope
        level += np.multiply(a, e, out=step)
        slope += np.multiply(ab, e, out=step)
    rest, by_level, by_slope = errors
    size = (by_level * by_level).sum(axis=0)
    by_slope = _without(by_level, by_slope, size)
    rest = _without(by_slope, _without(by_level, rest, size))
    return np.multiply(rest, rest, out=by_slope).sum(axis=0)


def _ses_losses(y: np.ndarray, a: np.ndarray) -> np.ndarray:
    e, g = np.empty((len(y), *a.shape)), np.empty((len(y), *a.shape))
    level, lead = np.zeros(a.shape), np.ones(a.shape)
    for i, v in enumerate(y):
        e[i], g[i] = v - level, lead
        level, lead = level + a * (v - level), lead * (1 - a)
    rest = _without(g, e)
    return (rest * rest).sum(axis=0)


def _search(losses, low: list[float], high: list[float], series: int = 1, rounds: int = 7, points: int = 7) -> np.ndarray:
    """The best point (axis by series) of a grid of each series that closes in on its best cell; losses takes
    the grids' coordinates as series by point."""
    low, high = [np.repeat(np.array(x, float)[:, None], series, axis=1) for x in (low, high)]
    for _ in range(rounds):
        axes = np.linspace(low, high, points, axis=-1)
        n = len(axes)
        grid = np.stack([np.broadcast_to(x.reshape(series, *[points if j == n - 1 - i else 1 for j in range(n)]), (series, *[points] * n)).reshape(series, -1) for i, x in enumerate(axes)])
        at = losses(*grid).argmin(axis=1)
        best = np.take_along_axis(grid, np.broadcast_to(at[None, :, None], (n, series, 1)), axis=2)[..., 0]
        step = (high - low) / (points - 1)
        low, high = np.maximum(best - step, low), np.minimum(best + step, high)
    return best


#: Series that a search takes together, so that its arrays stay in the processor's cache.
HOLT_TOGETHER, SES_TOGETHER = 16, 128


def _together(fit, y: np.ndarray, horizon: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and sums of squares of all rows of y (series by months), size series at a time."""
    f, sse = np.empty((len(y), horizon)), np.empty(len(y))
    for i in range(0, len(y), size):
        f[i : i + size], sse[i : i + size] = fit(y[i : i + size].T, horizon)
    return f, sse


def _holt(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    n = y.shape[1]
    a, b = _search(lambda a, b: _holt_losses(y[:, :, None], a, a * b), [1e-4, 1e-4], [0.9999, 0.9999], n)
    b = a * b
    sse, (level, slope) = _holt_at(y, a, b)
    for v in y:
        before, level = level, a * v + (1 - a) * (level + slope)
        slope = b * (level - before) + (1 - b) * slope
    return level[:, None] + slope[:, None] * np.arange(1, horizon + 1), sse


def _ses(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    n = y.shape[1]
    (a,) = _search(lambda a: _ses_losses(y[:, :, None], a), [1e-4], [0.9999], n)
    e, g = np.empty(y.shape), np.empty(y.shape)
    level, lead = np.zeros(n), np.ones(n)
    for i, v in enumerate(y):
        e[i], g[i] = v - level, lead
        level, lead = level + a * (v - level), lead * (1 - a)
    sse, (start,) = _solved(e, -g)
    return np.repeat((level + lead * start)[:, None], horizon, axis=1), sse


def fits_holt(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear trend smoothing of many series (rows) of one length: forecasts and sums of squares. The start is solved for."""
    return _together(_holt, y, horizon, HOLT_TOGETHER)


def fits_ses(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    return _together(_ses, y, horizon, SES_TOGETHER)


def fit_holt(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    """Forecast, sum of squares, parameters of one series."""
    f, sse = fits_holt(y[None], horizon)
    return f[0], float(sse[0]), 4


def fit_ses(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    f, sse = fits_ses(y[None], horizon)
    return f[0], float(sse[0]), 2


def fit_fourier(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    b, e = least_squares(design(np.arange(1, len(y) + 1, dtype=float)), y)
    return design(np.arange(len(y) + 1, len(y) + horizon + 1, dtype=float)) @ b, float(e @ e), 4


def fit_naive(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    return np.full(horizon, y[-1]), float((np.diff(y) ** 2).sum()), 0


def fit_drift(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    slope = (y[-1] - y[0]) / max(1, len(y) - 1)
    return y[-1] + slope * np.arange(1, horizon + 1), float(((np.diff(y) - slope) ** 2).sum()), 1


def fit_difference_ar(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float, int]:
    d = np.diff(y)
    below = d[:-1] @ d[:-1]
    phi = (d[1:] @ d[:-1]) / below if below > 0 else 0.0
    return y[-1] + d[-1] * np.cumsum(phi ** np.arange(1, horizon + 1)), float(((d[1:] - phi * d[:-1]) ** 2).sum()), 1


MODELS = {"naive": fit_naive, "drift": fit_drift, "ses": fit_ses, "holt": fit_holt, "fourier": fit_fourier, "difference_ar": fit_difference_ar}
#: Those that take many series at once.
MANY = {"ses": fits_ses, "holt": fits_holt}
#: A winner among these gives way to Holt.
PLAIN = ("naive", "drift", "fourier")


#: Series of one length that a fit is given at once.
TOGETHER = 512


def in_rows(p: DataFrame) -> DataFrame:
    """A panel with a row per series: series_key and y, its values in their order."""
    rows = F.array_sort(F.collect_list(F.struct("t", "y")))  # one number per month
    return p.groupBy("series_key").agg(F.transform(rows, lambda r: r["y"].cast("double")).alias("y"))


def _fitted(whole: DataFrame, fit: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, values: int = 0) -> DataFrame:
    """fit over many series at once: it takes keys and values (series by months) of series of one length, TOGETHER of them
    or, where values is given, as many as hold so many values. Batches of rows with a series each (as in_rows) are what a
    task sees."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for months, same in pdf.groupby(pdf["y"].map(len)):
                together = max(1, values // max(1, months)) if values else TOGETHER
                for i in range(0, len(same), together):
                    some = same.iloc[i : i + together]
                    yield fit(some["series_key"].to_numpy(), np.stack([np.asarray(y, float) for y in some["y"]]))

    return whole.mapInPandas(each, schema)


def model_forecast(p: DataFrame, model: str, horizon: int) -> DataFrame:
    """Forecasts of every series by one model of MODELS."""

    def fit(keys: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        f = MANY[model](y, horizon)[0] if model in MANY else np.array([MODELS[model](v, horizon)[0] for v in y])
        return pd.DataFrame({"series_key": keys.repeat(horizon), "step": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(y)), "model": model, "forecast": f.ravel()})

    return _fitted(in_rows(p), fit, STEPS)


def information(p: DataFrame) -> DataFrame:
    """In-sample AIC and BIC of the fitted models, by their sums of squares."""

    def fit(keys: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        n, out = y.shape[1], []
        for name, k in (("ses", 2), ("holt", 4), ("fourier", 4), ("difference_ar", 1)):
            sse = MANY[name](y, 1)[1] if name in MANY else np.array([MODELS[name](v, 1)[1] for v in y])
            base = n * np.log(np.maximum(sse, 1e-300) / n)
            out.append(pd.DataFrame({"series_key": keys, "model": name, "aic": base + 2 * k, "bic": base + k * np.log(n)}))
        return pd.concat(out)

    return _fitted(in_rows(p), fit, "series_key string, model string, aic double, bic double")


def closed_information(p: DataFrame) -> DataFrame:
    """In-sample AIC and BIC of the models that sums alone fit (fourier, difference_ar), as information() has them."""
    fourier = residuals(p).groupBy("series_key").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.count("*").alias("n")).select("series_key", F.lit("fourier").alias("model"), "sse", "n", F.lit(4).alias("k"))
    o = W.partitionBy("series_key").orderBy("t")
    d = p.withColumn("d", F.col("y") - F.lag("y").over(o)).withColumn("l", F.lag("d").over(o))
    both = F.col("d").isNotNull() & F.col("l").isNotNull()
    sums = d.groupBy("series_key").agg(F.count("*").alias("n"), *[F.sum(F.when(both, F.col(x) * F.col(y))).alias(x + y) for x, y in ("dd", "dl", "ll")]).filter("n > 2")
    gain = F.when(F.col("ll") > 0, F.col("dl") * F.col("dl") / F.col("ll")).otherwise(0.0)
    both_models = fourier.unionByName(sums.select("series_key", F.lit("difference_ar").alias("model"), (F.col("dd") - gain).alias("sse"), "n", F.lit(1).alias("k")))
    base = F.col("n") * F.log(F.greatest(F.col("sse"), F.lit(1e-300)) / F.col("n"))
    return both_models.select("series_key", "model", (base + 2 * F.col("k")).alias("aic"), (base + F.col("k") * F.log("n")).alias("bic"))


FOLDS = "series_key string, fold int, model string, actual double, forecast double"


def expanding(p: DataFrame, least: int = 10, period: int = 12) -> DataFrame:
    """One-step forecasts of the closed models (naive, drift, difference_ar, fourier) from every origin with at
    least least points. Each origin's fit is made from running sums up to it: one window over a series, whose
    months are never copied."""
    a = 2 * math.pi * F.col("t") / period
    xs = {"x1": F.col("t").cast("double"), "x2": F.sin(a), "x3": F.cos(a)}
    o = W.partitionBy("series_key").orderBy("t")
    before = o.rowsBetween(W.unboundedPreceding, -1)
    d = p.select("series_key", "t", "y", *[x.alias(k) for k, x in xs.items()], (F.col("y") - F.lag("y").over(o)).alias("d"))
    d = d.withColumn("l", F.lag("d").over(o))
    sums = {f"s{i}": F.sum(f"x{i}").over(before) for i in (1, 2, 3)} | {"sy": F.sum("y").over(before)}
    sums |= {f"p{i}{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")).over(before) for i, j in PAIRS} | {f"q{i}": F.sum(F.col(f"x{i}") * F.col("y")).over(before) for i in (1, 2, 3)}
    sums |= {"dl": F.sum(F.col("d") * F.col("l")).over(before), "ll": F.sum(F.when(F.col("d").isNotNull(), F.col("l") * F.col("l"))).over(before), "y0": F.first("y").over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "y1": F.lag("y").over(o)}
    r = d.withColumns(sums).filter(F.col("t") > least).withColumn("n", F.col("t") - 1)
    r = r.withColumns({f"a{i}{j}": F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i, j in PAIRS} | {f"c{i}": F.col(f"q{i}") - F.col(f"s{i}") * F.col("sy") / F.col("n") for i in (1, 2, 3)} | {f"z{i}": F.col(f"x{i}") - F.col(f"s{i}") / F.col("n") for i in (1, 2, 3)})
    r = inverse(r, "a", "i")
    phi = F.when(F.col("ll") > 0, F.col("dl") / F.col("ll")).otherwise(0.0)
    models = {"naive": F.col("y1"), "drift": F.col("y1") + F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), F.col("n") - 1), F.lit(0.0)), "difference_ar": F.col("y1") + phi * F.col("l"), "fourier": F.col("sy") / F.col("n") + form("i", "z", "c")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), f.alias("forecast")) for k, f in models.items()]))
    return r.select("series_key", F.col("t").cast("int").alias("fold"), F.col("y").alias("actual"), each.alias("m")).select("series_key", "fold", "m.model", "actual", "m.forecast").filter("forecast IS NOT NULL")


def _gains(a: np.ndarray, b: np.ndarray, months: int, trend: bool) -> np.ndarray:
    """What a one-step error changes from the second or third month on, where the start is always the best for the months
    so far: its weight in the sum of squares, what it adds to the next prediction and (with a trend) to the slope. These
    follow from the parameters alone: the start's uncertainty as a variance that each month lessens. (month, kind, *a.shape)"""
    known, ab, out = 2 if trend else 1, a * b, np.zeros((months, 3 if trend else 2, *a.shape))
    keep = 1 - a - ab if trend else 1 - a
    level, both, slope = keep * keep, 0.0, 0.0
    if trend:
        rest, last, first = (1 - a) ** 2, 1 + keep, 1 - ab
        level, both, slope = rest + last * last, rest + last * first, rest + first * first
    for i in range(known, months):
        w = 1 / (1 + level)
        out[i, 0] = w
        if not trend:
            out[i, 1] = 1 - keep * w
            level = keep * keep * (level * w)
            continue
        slope = slope - both * both * w
        level, both = level * w, both * w
        out[i, 1], out[i, 2] = 1 - (1 - a) * w, ab * w + both
        met, own = keep * level + both, keep * both + slope
        level, both, slope = keep * met + own, own - ab * met, ab * ab * level - 2 * ab * both + slope
    return out


class _Smoothing:
    """Trend smoothing (or, without a slope, simple smoothing) from all origins at once, of many series of one length
    (rows of y) or of one. Each month's error is weighted so that the sum of squares is that of the best start for the
    months so far; an origin then reads its loss from the running sum. Origins that search the same cell of parameters
    share one run over the months; what parameters alone decide is run once a cell for all series."""

    def __init__(self, y: np.ndarray, least: int, trend: bool):
        self.shape, y = y.shape[:-1], np.atleast_2d(y)
        self.middle = y.mean(axis=1)  # a level's start is free, so that a shift of all values changes no more than it
        self.y, self.least, self.trend = np.ascontiguousarray((y - self.middle[:, None]).T), least, trend
        self.origins = y.shape[1] - least

    def run(self, a: np.ndarray, b: np.ndarray, of: np.ndarray, read: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """What read takes of the sums of squares and predictions (rows of points) that each origin meets. a and b are
        (cell, point); of has the cell of each series' origin."""
        many, points = len(of), a.shape[1]
        keys = np.sort((np.add(of * many, np.arange(many)[:, None]) * self.origins + np.arange(self.origins)).ravel())
        codes, origin = np.divmod(keys, self.origins)  # runs of one series and cell, by cell; in each its origins
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        cell, series = np.divmod(codes[first], many)
        first = np.append(first, len(codes))
        found = np.empty(of.shape, int if points > 1 else float)
        size = max(1, GAINS // (points * len(self.y)))
        for low in range(0, len(a), size):
            high = min(len(a), low + size)
            gains = _gains(a[low:high], b[low:high], len(self.y) - 1, self.trend)
            begin, end = np.searchsorted(cell, (low, high))
            for i in range(begin, end, max(1, RUNS // points)):
                j = min(end, i + max(1, RUNS // points))
                own = slice(first[i], first[j])
                runs = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                self._follow(gains, cell[i:j] - low, series[i:j], runs, origin[own], points, read, found)
        return found

    def _follow(self, gains: np.ndarray, cell: np.ndarray, series: np.ndarray, runs: np.ndarray, origin: np.ndarray, points: int, read: Callable[[np.ndarray, np.ndarray], np.ndarray], found: np.ndarray) -> None:
        """Runs over the months, those of the latest origins first, so that the others can end before them; runs and
        origin say which run each origin reads."""
        last = np.zeros(len(cell), int)
        np.maximum.at(last, runs, origin)
        order = np.argsort(-last, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        cell, series = cell[order], series[order]
        running = np.searchsorted(-last[order], -np.arange(self.origins), side="right")
        by = np.argsort(origin.astype(np.int32), kind="stable")
        rows, owner = place[runs][by], series[place[runs]][by]
        ends = np.searchsorted(origin[by], np.arange(self.origins + 1))
        one = cell[0] == cell[-1] and (cell == cell[0]).all()
        shape = (len(cell), points)
        sse, p, s, e, t = np.zeros(shape), np.empty(shape), np.zeros(shape), np.empty(shape), np.empty(shape)
        y = self.y[:, series]

        def gain(i: int, kind: int, m: int) -> np.ndarray:
            """The error times a gain."""
            if one:
                return np.multiply(e[:m], gains[i, kind, cell[0]], out=t[:m])
            np.take(gains[i, kind], cell[:m], axis=0, out=t[:m], mode="clip")
            return np.multiply(t[:m], e[:m], out=t[:m])

        for i in range(len(y) - 1):
            o = i + 1 - self.least
            m = running[max(0, o)]
            if m == 0:
                break
            if i == 0:
                p[:] = y[0][:, None]
            elif i == 1 and self.trend:
                p[:], s[:] = (2 * y[1] - y[0])[:, None], (y[1] - y[0])[:, None]
            else:
                np.subtract(y[i, :m, None], p[:m], out=e[:m])
                sse[:m] += np.multiply(gain(i, 0, m), e[:m], out=t[:m])
                if self.trend:
                    s[:m] += gain(i, 2, m)
                    p[:m] += s[:m]
                p[:m] += gain(i, 1, m)
            if o >= 0 and ends[o + 1] > ends[o]:
                these = slice(ends[o], ends[o + 1])
                found[owner[these], o] = read(sse, p, rows[these])

    def forecasts(self, rounds: int = 7, points: int = 7) -> np.ndarray:
        """One-step forecasts; the parameters of each origin come from a grid that closes in on its best cell."""
        axes, of = 2 if self.trend else 1, np.zeros((self.y.shape[1], self.origins), int)
        low, high = np.full((axes, 1, 1), 1e-4), np.full((axes, 1, 1), 0.9999)
        steps = np.stack(np.meshgrid(*[np.linspace(0, 1, points)] * axes, indexing="ij")).reshape(axes, 1, -1)
        of_trend = lambda x: x[1] if axes > 1 else np.zeros_like(x[0])
        for _ in range(rounds):
            grid = low + (high - low) * steps
            at = of * steps.shape[2] + self.run(grid[0], of_trend(grid), of, lambda sse, p, rows: sse.take(rows, axis=0).argmin(axis=1))
            # cells of the next round: points of this round's that some origin found best
            chosen = np.zeros(grid[0].size, bool)
            chosen[at] = True
            of, chosen = (np.cumsum(chosen) - 1)[at], np.flatnonzero(chosen)
            cell, point = np.divmod(chosen, steps.shape[2])
            best, step = grid[:, cell, point][..., None], ((high - low) / (points - 1))[:, cell]
            low, high = np.maximum(best - step, low[:, cell]), np.minimum(best + step, high[:, cell])
        ahead = self.run(best[0], of_trend(best), of, lambda sse, p, rows: p[rows, 0])
        return (self.middle[:, None] + ahead).reshape(*self.shape, -1)


#: Points of cells, by months, whose gains are made together, and points of runs that are followed together, so that the
#: arrays stay in the processor's cache.
GAINS, RUNS = 1_000_000, 25_088
#: Values of series that a search from all origins is given at once: the more series, the more share a cell.
SEARCHED = 327_680


def _smoothed(y: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """One-step forecasts (series by origin) of ses and holt from every origin; none where no series has one."""
    return {name: _Smoothing(y, least, trend).forecasts() for name, trend in (("ses", False), ("holt", True)) if y.shape[1] > least}


def smoothed_folds(p: DataFrame, least: int = 10) -> DataFrame:
    """One-step forecasts of ses and holt from every origin with at least least points."""

    def fit(keys: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        n = y.shape[1] - least
        out = [pd.DataFrame({"series_key": keys.repeat(n), "fold": np.tile(np.arange(least + 1, y.shape[1] + 1, dtype=np.int32), len(y)), "model": name, "actual": y[:, least:].ravel(), "forecast": f.ravel()}) for name, f in _smoothed(y, least).items()]
        return pd.concat(out) if out else pd.DataFrame(columns=["series_key", "fold", "model", "actual", "forecast"])

    return _fitted(in_rows(p), fit, FOLDS)


def rolling_origin(p: DataFrame, least: int = 10) -> DataFrame:
    """series_key, fold, model, actual, forecast: one-step forecasts of all models of MODELS from every origin
    with at least least points."""
    return expanding(p, least).unionByName(smoothed_folds(p, least))


def _closed(y: np.ndarray, least: int, period: int = 12) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """What expanding() gives, of many series of one length (rows of y): by model the months that have a forecast, counted
    from 0, and the forecasts (month by series). Sums run as there, one month after the other."""
    y, at = y.T, np.arange(least, y.shape[1])
    t, before = np.arange(1, len(y) + 1), lambda v: np.cumsum(v, axis=0)[at - 1]
    angles = [2 * math.pi * k / period for k in t.tolist()]
    x = np.stack([t.astype(float), [math.sin(k) for k in angles], [math.cos(k) for k in angles]])
    n, last = at[:, None].astype(float), y[at - 1]
    d, lagged = np.zeros_like(y), np.zeros_like(y)
    d[1:], lagged[2:] = y[1:] - y[:-1], y[1:-1] - y[:-2]
    dl, ll = before(d * lagged), before(lagged * lagged)
    phi = np.divide(dl, ll, out=np.zeros_like(dl), where=ll > 0)
    sy, sx, qs = before(y), [before(v)[:, None] for v in x], [before(v[:, None] * y) for v in x]
    z, c = [v[at, None] - s / n for v, s in zip(x, sx, strict=True)], [q - s * sy / n for q, s in zip(qs, sx, strict=True)]
    a11, a12, a13, a22, a23, a33 = (before(x[i - 1] * x[j - 1])[:, None] - sx[i - 1] * sx[j - 1] / n for i, j in PAIRS)
    minors = (a22 * a33 - a23 * a23, a13 * a23 - a12 * a33, a12 * a23 - a13 * a22, a11 * a33 - a13 * a13, a12 * a13 - a11 * a23, a11 * a22 - a12 * a12)
    det = a11 * minors[0] + a12 * minors[1] + a13 * minors[2]
    there = det[:, 0] != 0
    inv = {pair: np.divide(m, det, out=np.zeros_like(det), where=det != 0) for pair, m in zip(PAIRS, minors, strict=True)}
    fourier = sy / n + sum((inv[min(i, j), max(i, j)] * z[i - 1] * c[j - 1] for i in (1, 2, 3) for j in (1, 2, 3)), 0.0)
    drift = last + np.divide(last - y[0], n - 1, out=np.zeros_like(last), where=n > 1)
    moved = at > 1  # two differences at least
    return {"naive": (at, last), "drift": (at, drift), "difference_ar": (at[moved], (last + phi * lagged[at])[moved]), "fourier": (at[there], fourier[there])}


def model_errors(rows: DataFrame, least: int = 10, digits: int = 6) -> DataFrame:
    """errors() of rolling_origin(), of series that are a row each (as in_rows gives them): they are summed up where the
    forecasts are made, so that no fold leaves its task."""
    sums = ["squares", "sizes", "ratios", "above", "smapes"]

    def fit(keys: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        if y.shape[1] <= least:
            return pd.DataFrame(columns=["series_key", "model", *sums, "folds"])
        out, whole = [], np.arange(least, y.shape[1])
        found = _closed(y, least) | {name: (whole, f.T) for name, f in _smoothed(y, least).items()}
        for name, (at, f) in found.items():
            if not len(at):
                continue
            e, a, f = np.abs(y.T[at] - f), np.abs(y.T[at]), np.abs(f)
            smape = np.divide(2 * e, a + f, out=np.zeros_like(e), where=a + f > 0)
            terms = (e * e, e, np.divide(e, a, out=np.zeros_like(e), where=a > 0), (a > 0).astype(float), smape)
            # one origin after the other, as Spark adds rows
            out.append(pd.DataFrame({"series_key": keys, "model": name} | {k: np.add.accumulate(v)[-1] for k, v in zip(sums, terms, strict=True)} | {"folds": len(at)}))
        return pd.concat(out)

    found = _fitted(rows, fit, f"series_key string, model string, {', '.join(f'{k} double' for k in sums)}, folds long", SEARCHED)
    mean = lambda k: F.col(k) / F.col("folds")
    return found.select("series_key", "model", *_rounded(F.sqrt(mean("squares")), mean("sizes"), F.try_divide("ratios", "above"), mean("smapes"), digits), "folds")


def _rounded(rmse: Column, mae: Column, ratio: Column, smape: Column, digits: int) -> list[Column]:
    return [F.round(rmse, digits).alias("rmse"), F.round(mae, digits).alias("mae"), F.round(ratio * 100, digits).alias("mape"), F.round(smape * 100, digits).alias("smape")]


def errors(folds: DataFrame, digits: int = 6) -> DataFrame:
    """RMSE, MAE, MAPE over actuals other than 0, SMAPE and number of folds per series and model."""
    e, a, f = F.col("actual") - F.col("forecast"), F.abs("actual"), F.abs("forecast")
    smape = F.when(a + f > 0, 2 * F.abs(e) / (a + f)).otherwise(0.0)
    return folds.groupBy("series_key", "model").agg(*_rounded(F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg(F.when(a > 0, F.abs(e) / a)), F.avg(smape), digits), F.count("*").alias("folds"))


def choose(scores: DataFrame) -> DataFrame:
    """The model with the least RMSE per series; a plain one gives way to Holt where it was fitted."""
    by = scores.groupBy("series_key").agg(F.min_by("model", F.struct("rmse", "model")).alias("winner"), F.max(F.col("model") == "holt").alias("_holt"))
    return by.select("series_key", "winner", F.when(F.col("winner").isin(*PLAIN) & F.col("_holt"), "holt").otherwise(F.col("winner")).alias("model"))


def scenarios(forecast: DataFrame, sigma: DataFrame) -> DataFrame:
    """Base, lower (not under 0) and upper at 1.96 deviations (series_key, sigma) times root step."""
    half = 1.96 * F.col("sigma") * F.sqrt("step")
    return forecast.join(sigma, "series_key").select("series_key", "step", F.col("forecast").alias("base"), F.greatest(F.lit(0.0), F.col("forecast") - half).alias("lower"), (F.col("forecast") + half).alias("upper"))


def panel_forecast(p: DataFrame, horizon: int = 6, least: int = 6) -> DataFrame:
    """Holt for every series; short or constant ones repeat their last value, as the method says,
    with the population deviation."""

    def fit(keys: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        steps = np.arange(1, horizon + 1, dtype=np.int32)
        f, sigma = np.repeat(y[:, -1:], horizon, axis=1), np.array([np.std(v) for v in y])
        fitted = np.ptp(y, axis=1) > 0 if y.shape[1] >= least else np.zeros(len(y), bool)
        if fitted.any():
            f[fitted], sse = fits_holt(y[fitted], horizon)
            sigma[fitted] = np.sqrt(sse / max(1, y.shape[1] - 1))
        half = 1.96 * sigma[:, None] * np.sqrt(steps)
        method = np.where(fitted, "holt", "naive_fallback").repeat(horizon)
        return pd.DataFrame({"series_key": keys.repeat(horizon), "step": np.tile(steps, len(y)), "method": method, "forecast": np.maximum(f, 0).ravel(), "lower": np.maximum(f - half, 0).ravel(), "upper": (f + half).ravel()})

    return _fitted(in_rows(p), fit, "series_key string, step int, method string, forecast double, lower double, upper double")
