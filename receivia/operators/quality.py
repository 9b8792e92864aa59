"""Data-quality checks: missing values, duplicates, reconciliation, outliers, control totals, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivia.functions.scalars import blank, net_value, ratio


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls or blanks per column, in one pass."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count_if(blank(F.col(c))).alias("n_missing"), F.round(ratio(F.count_if(blank(F.col(c))), F.count(F.lit(1))) * 100, 6).alias("missing_pct"))
    return df.agg(F.array(*map(one, columns)).alias("a")).select(F.inline("a"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def mark_repeats(df: DataFrame, keys: list[str], column: str = "repeated") -> DataFrame:
    """All copies marked, the first included."""
    again = repeated_keys(df, keys).select(*keys, F.lit(True).alias("_again"))
    return df.join(again, keys, "left").withColumn(column, F.coalesce("_again", F.lit(False))).drop("_again")


def many_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def reconcile(lines: DataFrame, headers: DataFrame, variant: str = "relative", tolerance: float = 1.0) -> DataFrame:
    """Invoices with the sum of their lines, the difference and whether it passes.

    variant "absolute": at most tolerance; "relative": at most tolerance or 1 % of the total,
    whichever is more; "strict": less than tolerance.
    """
    by = lines.groupBy("invoice_no").agg(F.sum("line_total").alias("line_sum"))
    met = headers.join(by, "invoice_no", "left").select("invoice_no", F.col("reported_total").cast("double").alias("reported_total"), F.coalesce(F.col("line_sum").cast("double"), F.lit(0.0)).alias("line_sum"))
    diff = F.abs(F.round(F.col("reported_total") - F.col("line_sum"), 6))
    limit = F.greatest(F.lit(tolerance), F.abs("reported_total") * 0.01) if variant == "relative" else F.lit(tolerance)
    return met.withColumn("diff", diff).withColumn("passes", diff < limit if variant == "strict" else diff <= limit)


def paid_plus_remaining(headers: DataFrame, share: float = 0.02) -> DataFrame:
    """Whether at most share of the invoices differ from paid + remaining by more than 1."""
    off = F.abs(F.col("reported_total") - F.col("paid") - F.col("remaining")) > 1
    by = headers.agg(F.count_if(off).alias("n_off"), F.count("*").alias("n"))
    return by.withColumn("passes", F.coalesce(F.col("n_off") <= share * F.col("n"), F.lit(True)))


def formula_check(lines: DataFrame) -> DataFrame:
    """Residuals of line totals against quantity x price less both rates."""
    want = net_value(F.col("qty").cast("double"), F.col("unit_price"), F.col("disc").cast("double"), F.col("tax").cast("double"))
    r = F.abs(F.col("line_total").cast("double") - want)
    return lines.agg(F.round(F.avg(r), 6).alias("mean_abs"), F.round(F.max(r), 6).alias("max_abs"), F.round(ratio(F.count_if(r <= 1), F.count("*")) * 100, 6).alias("within_1_pct"))


def outliers(lines: DataFrame, key: str = "item_code", value: str = "unit_price", least: int = 8, times: float = 3.0) -> DataFrame:
    """Per key with at least least priced, paid lines: the fence of times the quartile distance
    around the quartiles and how many values lie outside. A distance of 0 makes every other value
    an outlier."""
    x = F.col(value).cast("double")
    priced = lines.filter(~F.col("is_bonus") & (x > 0)).select(key, x.alias("x"))
    fence = priced.groupBy(key).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= least)
    far = times * (F.col("q")[1] - F.col("q")[0])
    fence = fence.select(key, "n", F.round(F.col("q")[0] - far, 3).alias("low"), F.round(F.col("q")[1] + far, 3).alias("high"))
    return priced.join(fence, key).groupBy(key, "n", "low", "high").agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("n_outliers"))


def control_totals(found: DataFrame, stated: DataFrame, key: str = "key") -> DataFrame:
    """stated (key, stated) against found (key, found); rows that differ."""
    return stated.join(found, key, "full").filter(~F.col("stated").eqNullSafe(F.col("found"))).select(key, "stated", "found")


def counters(lines: DataFrame) -> DataFrame:
    """Negative, zero and free lines, their share, and the ranges of the fields."""
    rng = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in ("qty", "line_total", "disc", "tax") for n, f in (("min", F.min), ("max", F.max))]
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col("qty") < 0).alias("n_negative_qty"), F.count_if(F.col("line_total") == 0).alias("n_zero"), F.count_if("is_bonus").alias("n_free"), F.round(ratio(F.count_if("is_bonus"), F.count("*")) * 100, 6).alias("free_pct"), *rng)


def abnormal(lines: DataFrame, price: float = 5000, qty: float = 5000) -> DataFrame:
    return lines.agg(F.count_if(F.col("unit_price") > price).alias("n_price"), F.count_if(F.col("qty") > qty).alias("n_qty"), F.count_if((F.col("unit_price") < 0) | (F.col("qty") < 0)).alias("n_negative"))


def bonus_counts(lines: DataFrame) -> DataFrame:
    """Lines marked free and without a price; and those of them with a quantity."""
    free = F.col("is_bonus") & (F.col("unit_price") == 0)
    return lines.agg(F.count_if(free & (F.col("qty") > 0)).alias("n_with_qty"), F.count_if(free).alias("n_free"), F.coalesce(F.sum(F.when(free, F.col("qty"))).cast("double"), F.lit(0.0)).alias("free_qty"))


def zero_invoices(headers: DataFrame, nulls_too: bool = True) -> DataFrame:
    zero = F.col("reported_total") == 0
    return headers.filter(F.coalesce(zero, F.lit(nulls_too)))


def report(lines: DataFrame, columns: list[str], ranges: tuple[str, ...] = ("qty", "line_total", "disc", "tax"), price: float = 5000, qty: float = 5000) -> DataFrame:
    """check, dimension, value: one report on lines (missing values of columns, distinct keys, negative, zero, free and
    abnormal lines, ranges, residuals of the totals) from one pass, the wide row of which is turned."""
    x = lambda c: F.col(c).cast("double")
    r = F.abs(x("line_total") - net_value(x("qty"), F.col("unit_price"), x("disc"), x("tax")))
    free = F.col("is_bonus")
    found = {("rows", "lines"): F.count("*")} | {("missing", c): F.count_if(blank(F.col(c))) for c in columns}
    found |= {("lines", k): F.count_if(c) for k, c in {"negative": F.col("qty") < 0, "zero": F.col("line_total") == 0, "free": free, "free_priced": free & (F.col("unit_price") > 0), "high_price": F.col("unit_price") > price, "high_qty": F.col("qty") > qty}.items()}
    found |= {("share", "free"): ratio(F.count_if(free), F.count("*")), ("residual", "mean"): F.avg(r), ("residual", "max"): F.max(r), ("residual", "within_1"): ratio(F.count_if(r <= 1), F.count("*"))}
    found |= {(n, c): f(x(c)) for c in ranges for n, f in (("least", F.min), ("most", F.max))}
    wide = lines.agg(*[F.round(v.cast("double"), 6).alias(f"{a}:{b}") for (a, b), v in found.items()])
    long = wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "name", "value")
    return long.select(F.split("name", ":")[0].alias("check"), F.split("name", ":")[1].alias("dimension"), "value")


def checks(rows: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """name, passed, detail from (name, one-row table, condition on it)."""
    one = lambda name, df, ok: df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed")).select(F.lit(name).alias("name"), "passed", "n_failed")
    return reduce(DataFrame.unionByName, (one(*r) for r in rows))


def require(found: DataFrame) -> None:
    """Raises if a check of found failed; the message names the failed ones."""
    failed = [r["name"] for r in found.filter(~F.col("passed")).select("name").orderBy("name").collect()]  # a row per check
    if failed:
        raise AssertionError(f"failed checks: {', '.join(failed)}")
