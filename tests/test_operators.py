"""Small cases with results worked out by hand."""

import datetime as dt
import decimal
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from receivia.functions import scalars as S
from receivia.operators import attribution, forecast, quality, receivables, sales, series
from receivia.plans import catalog, view
from receivia.sources import readers, sinks

D = dt.date
REVENUE = [2928292.96, 2152970.97, 3326914.495, 2442991.52, 3163361.15, 2116277.735, 2642056.17, 3042711.98, 3873847.08, 3711622.74, 3032455.14, 3173527.23, 2678931.71, 3465996.21, 3313076.35, 4492997.3, 4164840.63, 3867490.79]


def one(df):
    return df.first().asDict()


def test_fifo(spark):
    bills = spark.createDataFrame([("C1", 1, D(2026, 3, 1), 100.0), ("C1", 2, D(2026, 5, 20), 200.0), ("C1", 3, D(2026, 7, 5), 300.0), ("C2", 4, D(2026, 6, 10), 200.0), ("C3", 5, D(2026, 6, 1), 50.0), ("C5", 6, D(2026, 6, 30), 100.0)], "customer_code string, invoice_no long, invoice_date date, t double").withColumn("reported_total", F.col("t").cast("decimal(18,4)"))
    owed = spark.createDataFrame([("C1", 450.0), ("C2", 500.0), ("C3", -50.0), ("C4", 80.0), ("C5", 100.0)], "customer_code string, b double").withColumn("balance", F.col("b").cast("decimal(18,4)"))
    by = {r["customer_code"]: r for r in receivables.overdue(receivables.fifo(bills, owed, "2026-07-16", "2026-06-30"), "2026-07-16").collect()}
    assert set(by) == {"C1", "C2", "C4", "C5"}
    assert (by["C1"]["d31_60"], by["C1"]["current"], by["C1"]["days_overdue"], by["C1"]["dominant"]) == (150, 300, 27, "current")
    assert (by["C2"]["d31_60"], by["C2"]["d120p"], by["C2"]["overdue"], by["C2"]["days_overdue"], by["C2"]["dominant"]) == (200, 300, 500, 6, "d120p")
    assert (by["C4"]["d120p"], by["C4"]["oldest"], by["C5"]["d1_30"]) == (80, None, 100)
    assert sum(r["balance"] for r in by.values()) == 1130 and sum(r["overdue"] for r in by.values()) == 830


def test_pareto_and_concentration(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0)], "k string, line_total double")
    assert [r["abc"] for r in sales.pareto_abc(df, "k").orderBy("rank").collect()] == ["A", "A", "B", "C"]
    assert one(sales.concentration(df, "k"))["n80"] == 2
    df = spark.createDataFrame([("a", 60.0), ("b", 25.0), ("c", 15.0)], "k string, line_total double")
    assert [r["abc"] for r in sales.pareto_abc(df, "k").orderBy("rank").collect()] == ["A", "B", "C"]
    assert (one(sales.concentration(df, "k"))["n80"], one(sales.concentration(df, "k"))["hhi"]) == (2, 4450)


def test_xyz(spark):
    rows = [(k, m, q) for k, qs in {"a": (10, 10, 10, 10), "b": (10, 5, 10, 5), "c": (12, 2, 4, 6), "d": (10,), "e": (0, 0, 0, 0)}.items() for m, q in enumerate(qs)]
    by = {r["k"]: (r["cv"], r["xyz"]) for r in sales.xyz(spark.createDataFrame(rows, "k string, month int, qty int"), "k").collect()}
    assert by == {"a": (0.0, "X"), "b": (0.3849, "X"), "c": (0.7201, "Y"), "d": (2.0, "Z"), "e": (None, "Z")}


def test_parsing(spark):
    df = spark.createDataFrame([("1,200",), ("x",), ("12.5-",), (None,), (" ",)], "c string")
    got = df.select(S.parse_number(F.col("c")).cast("double").alias("n"), S.parse_number_or_zero(F.col("c")).cast("double").alias("z")).collect()
    assert [r["n"] for r in got] == [1200, None, None, None, None] and [r["z"] for r in got] == [1200, 0, -12.5, 0, 0]
    dates = spark.createDataFrame([("2025/2/1",), ("2025-10-01",), ("no",)], "c string").select(S.parse_date(F.col("c")).alias("d")).collect()
    assert [r["d"] for r in dates] == [D(2025, 2, 1), D(2025, 10, 1), None]
    names = spark.createDataFrame([("مفروم  صافى   400",)], "c string").select(S.display_name(F.col("c")).alias("n"))
    assert one(names)["n"] == "مفروم صافي 400"


@pytest.mark.parametrize(("rate", "want"), [(None, 0), (0.69, 0), (0.70, 0.01), (0.79, 0.01), (0.80, 0.02), (0.89, 0.02), (0.90, 0.03), (0.94, 0.03), (0.95, 0.05), (1.0, 0.05), (2.0, 0.05)])
def test_incentive(spark, rate, want):
    assert one(spark.createDataFrame([(rate,)], "r double").select(S.incentive(F.col("r")).alias("i")))["i"] == want


def test_attribution(spark):
    who = spark.createDataFrame([("c1", "Ali", "r1"), ("c2", "Sara", "r1"), ("c3", "sara ", "r2")], "customer_code string, customer_name string, rep string")
    got = attribution.attribute(spark.createDataFrame([("Ali", 100.0), ("Sara", 50.0), ("Zed", 25.0)], "customer_name string, amount double"), who, who)
    assert one(attribution.reconciled(got)) == {"attributed": 100, "unmatched": 75, "total": 175, "n_unmatched": 2}


def test_codes_and_status(spark):
    codes = spark.createDataFrame([("1,003",), ("1,007",), ("438",), ("007",)], "code string")
    aliases = spark.createDataFrame([("1007", "007")], "alias string, code string")
    assert sorted(r["code"] for r in attribution.canonical_codes(codes, "code", aliases).collect()) == ["007", "007", "1003", "438"]
    st_ = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (5.0, 0.0), (5.0, None), (5.0, 5.0)], "t double, r double").select(S.invoice_status(F.col("t"), F.col("r")).alias("s"))
    assert [r["s"] for r in st_.collect()] == ["zero", "zero", "paid", "paid", "unpaid"]


def test_arrears(spark):
    who = spark.createDataFrame([("a", "r", 10.0), ("b", "r", 10.0), ("c", "r", 10.0), ("d", "r", -5.0)], "customer_code string, rep string, net double")
    bills = spark.createDataFrame([("a", D(2026, 6, 4)), ("b", D(2026, 6, 3)), ("d", D(2026, 6, 4))], "customer_code string, invoice_date date")
    by = {r["customer_code"]: r for r in receivables.arrears(who, bills, "2026-07-04").collect()}
    assert [by[k]["arrears_amount"] for k in "abcd"] == [0, 10, 10, 0] and by["d"]["credit_balance"] == 5


def test_outliers_mean_and_reconciliation(spark):
    prices = spark.createDataFrame([("i", False, 10.0)] * 7 + [("i", False, 20.0)] + [("j", False, 10.0)] * 7, "item_code string, is_bonus boolean, unit_price double")
    assert [(r["item_code"], r["low"], r["high"], r["n_outliers"]) for r in quality.outliers(prices).collect()] == [("i", 10, 10, 1)]
    assert one(sales.weighted_mean(spark.createDataFrame([(10, 1), (20, 3), (99, -5)], "v int, w int"), "v", "w"))["weighted_mean"] == 17.5
    lines = spark.createDataFrame([(1, 50.9), (2, 51.5), (3, 1009.0)], "invoice_no int, line_total double")
    heads = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 1000.0)], "invoice_no int, reported_total double")
    check = lambda v: [r["passes"] for r in quality.reconcile(lines, heads, v).orderBy("invoice_no").collect()]
    assert check("relative") == [True, False, True] and check("absolute") == [True, False, False]


def test_gate(spark):
    found = quality.checks([("good", spark.range(3), F.col("id") >= 0), ("bad", spark.range(3), F.col("id") > 0)])
    with pytest.raises(AssertionError, match="bad"):
        quality.require(found)


def test_page_rows(spark):
    words = spark.createDataFrame([("d", 1, float(i), y, str(i)) for i, y in enumerate((10.0, 10.4, 27.0, 27.3, 44.0))], "doc string, page int, x0 double, y0 double, word string")
    assert [r["row"] for r in readers.page_rows(words, 6).orderBy("x0").collect()] == [1, 1, 2, 2, 3]
    assert {r["a"] for r in readers.page_table(words, 6, [("a", 0, 99)]).collect()} == {"1 0", "3 2", "4"}


def test_invoice_texts(spark, tmp_path):
    text = "## invoice 77 — 2025/2/1\ncode: 1,003\nname: Ann\nphone: 5\n1 A7 blue tin 400 2 10.5 0.1 0.0 18.9\n2 B1 cup 3 4 0 12\nnot a line\ntotal: 1,030.9\n"
    blocks = spark.createDataFrame([(text,)], "value string")
    rows = readers.fenced_invoices(blocks).collect()
    assert [(r["invoice_no"], r["invoice_date"], r["customer_code"], r["seq"], r["item_code"], float(r["line_total"])) for r in rows] == [("77", D(2025, 2, 1), "1,003", 1, "A7", 18.9)]
    assert float(rows[0]["invoice_reported_total"]) == 1030.9 and float(rows[0]["qty"]) == 2
    assert readers.fenced_invoices(blocks, least_numbers=4).count() == 2
    piped = "## invoice 8 — 2026/6/1\n| 1 | A7 | tin | box | 2 | 10 | 0 | 0 | 20 |\n| x |\n**total**: 20\n"
    row = one(readers.piped_invoices(spark.createDataFrame([(piped,)], "value string")))
    assert (row["invoice_no"], row["item_code"], float(row["line_total"]), float(row["invoice_reported_total"])) == ("8", "A7", 20, 20)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5), ("008", float("nan"))], "code string, x double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["code"] for r in readers.read_csv(spark, str(tmp_path / "c"), "code string, x double").collect()) == ["007", "008"]
    assert readers.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    assert sorted(r["payload"] for r in sinks.payload(df).collect()) == ['{"code":"007","x":1.5}', '{"code":"008"}']
    seen, obs = sinks.logged(df, "n", "NOT isnan(x)")
    seen.count()
    assert obs.get == {"found": 2, "parsed": 1, "failed": 1}


def golden(spark):
    return spark.createDataFrame([("all", i + 1, f"2025-{i + 1:02d}", y) for i, y in enumerate(REVENUE)], "series_key string, t int, month string, y double")


def test_published_diagnostics(spark):
    p = golden(spark)
    acf = {r["lag"]: r["acf"] for r in series.autocorrelation(p).collect()}
    assert math.isclose(acf[1], 0.3929996, abs_tol=1e-6)
    lb = {r["lags"]: (r["stat"], r["p"]) for r in series.ljung_box(p).collect()}
    assert np.allclose(lb[4], (6.427288, 0.169430), atol=1e-5) and np.allclose(lb[8], (7.735983, 0.459676), atol=1e-5)
    assert math.isclose(one(series.kpss(p))["stat"], 0.598775, abs_tol=1e-5)
    assert math.isclose(one(series.chow(p, 13))["stat"], 1.186361, rel_tol=1e-4) and math.isclose(one(series.chow(p, 10))["stat"], 0.182334, rel_tol=1e-4)
    d = {r["stat"]: r["value"] for r in series.diagnostics(p).collect()}
    want = {"ols_r2": 0.4512096, "breusch_pagan": 0.635293, "white": 2.313578, "white_p": 0.969858, "reset_f": 1.52158, "vif_trend": 1.079585, "vif_sin": 1.064168, "vif_cos": 1.015418, "adf_level": -1.045082, "adf_diff": -6.599071, "pacf_2": 0.2525747}
    want |= {"ols_const": 2430328.3212, "ols_trend": 81573.8721, "ols_sin": -43329.17443, "ols_cos": -57026.92948, "ols_const_p": 3.306033e-07, "ols_trend_p": 0.00516234, "ols_sin_p": 0.8211956, "ols_cos_p": 0.7578432, "ols_adj_r2": 0.3336116, "ols_f_p": 0.03390749}
    want |= {"adf_level_p": 0.7364686, "adf_level_lags": 7, "adf_level_1pct": -4.331573, "adf_level_5pct": -3.23295, "adf_level_10pct": -2.7487, "adf_diff_p": 6.807868e-09, "adf_diff_lags": 5}
    want |= {"breusch_pagan_p": 0.8883074, "reset_p": 0.2392191, "pacf_0": 1, "pacf_1": 0.4161173, "pacf_3": -0.5252069, "pacf_8": -0.4398976}
    assert {k: True for k in want} == {k: math.isclose(d[k], v, rel_tol=2e-4) for k, v in want.items()}
    k = one(series.automatic_kpss(p))
    assert k["lags"] == 1 and math.isclose(k["stat"], 0.598775, abs_tol=1e-5) and math.isclose(k["p"], 0.0227477, abs_tol=1e-6)
    r = one(series.residual_checks(series.residuals(p)))
    assert math.isclose(r["durbin_watson"], 2.068883, abs_tol=1e-5) and math.isclose(r["jarque_bera"], 0.793274, abs_tol=1e-5)
    assert series.decompose(p).count() == 0  # under two periods


def test_short_and_flat_series(spark):
    """Flat series and those too short for a statistic give no row or null; the automatic lag is that of a plain loop."""
    rows = [("flat", t, 5.0) for t in range(1, 21)] + [("one", 1, 3.0)] + [("three", t, float(t * t)) for t in (1, 2, 3)]
    walk = np.random.default_rng(7).normal(0, 1, 60).cumsum()
    p = spark.createDataFrame(rows + [("walk", t + 1, float(y)) for t, y in enumerate(walk)], "series_key string, t int, y double")
    assert {r["series_key"] for r in series.regression(p).collect()} == {"walk"} and {r["series_key"] for r in series.diagnostics(p).collect()} == {"walk"}
    kpss = {r["series_key"]: r for r in series.automatic_kpss(p).collect()}
    assert kpss.keys() == {"flat", "three", "walk"} and kpss["flat"]["stat"] is None and kpss["flat"]["p"] is None
    n, e = len(walk), walk - walk.mean()
    v = [(e[k:] @ e[: n - k]) / (n / 2) for k in range(n)]
    first = int(n ** (2 / 9))
    lags = min(n - 1, int(1.1447 * ((sum(k * v[k] for k in range(1, first + 1)) / (e @ e / n + sum(v[1 : first + 1]))) ** 2) ** (1 / 3) * n ** (1 / 3)))
    stat = (e.cumsum() @ e.cumsum()) / n**2 / (e @ e / n + sum((1 - k / (lags + 1)) * v[k] for k in range(1, lags + 1)))
    assert lags > 1 and kpss["walk"]["lags"] == lags and math.isclose(kpss["walk"]["stat"], stat, abs_tol=1e-6)
    e = {r["t"]: r["e"] for r in series.residuals(p.filter("series_key = 'walk'")).collect()}
    want = series.least_squares(series.design(np.arange(1, 61, dtype=float)), walk)[1]
    assert np.allclose([e[t] for t in range(1, 61)], want, atol=1e-9)


def test_published_forecasts(spark):
    e = {r["model"]: r["rmse"] for r in forecast.errors(forecast.rolling_origin(golden(spark))).collect()}
    assert math.isclose(e["naive"], 607964.52, rel_tol=1e-4) and math.isclose(e["drift"], 634149.42, rel_tol=1e-4) and math.isclose(e["fourier"], 797781.77, rel_tol=1e-4)
    assert math.isclose(e["holt"], 515504.80, rel_tol=0.05) and min(e, key=e.get) == "holt"
    short = spark.createDataFrame([("s", 1, "m", 5.0), ("s", 2, "n", 5.0)], "series_key string, t int, month string, y double")
    assert {r["method"] for r in forecast.panel_forecast(short).collect()} == {"naive_fallback"}


def test_whole_panels(spark):
    """Every origin of every series from 10 months on, for the whole and every brand; 6 steps ahead."""
    data = "/root/testdata/sf0.001"
    found = catalog.QUERIES["model_errors"](spark, data).collect()
    brands = {r["series_key"] for r in catalog.QUERIES["brand_naive_forecast"](spark, data).collect()}
    months = view.Sales(spark, data).lines.select("month").distinct().count()
    assert {r["series_key"] for r in found} == brands | {"all"} and {r["folds"] for r in found} == {months - 10}
    ahead = catalog.QUERIES["brand_difference_ar_six_steps"](spark, data).collect()
    assert {(r["series_key"], r["step"]) for r in ahead} == {(b, k) for b in brands for k in range(1, 7)}
    for of, column in (("customer", "customer_code"), ("item", "item_code")):
        keys = view.Sales(spark, data).lines.select(column).distinct().count()
        assert catalog.QUERIES[f"{of}_panel_forecast"](spark, data).count() == 6 * keys
        assert {f"{of}_model_errors", f"{of}_model_choice", f"{of}_model_information"} <= catalog.QUERIES.keys()


def test_searched_losses():
    y = np.random.default_rng(4).normal(50, 9, 30)
    a, b = np.array([0.1, 0.5, 0.9]), np.array([0.05, 0.2, 0.8])
    assert np.allclose(forecast._holt_losses(y, a, b), [forecast._holt_at(y, *x)[0] for x in zip(a, b, strict=True)])


def test_errors(spark):
    folds = spark.createDataFrame([("s", "m", 100.0, 110.0), ("s", "m", 0.0, 5.0), ("s", "m", 200.0, 180.0)], "series_key string, model string, actual double, forecast double")
    r = one(forecast.errors(folds))
    assert r["mape"] == 10 and math.isclose(r["smape"], 73.35004, abs_tol=1e-5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 400), st.integers(1, 900)), min_size=1, max_size=8), st.integers(-50, 1500))
def test_fifo_keeps_balance(spark, bills, balance):
    heads = spark.createDataFrame([(c, i, D(2025, 1, 1) + dt.timedelta(days=d), float(a)) for i, (c, d, a) in enumerate(bills)], "customer_code string, invoice_no long, invoice_date date, reported_total double")
    owed = spark.createDataFrame([("a", float(balance))], "customer_code string, balance double")
    total = receivables.fifo(heads, owed, "2026-02-01", "2025-12-01").agg(F.sum("unpaid")).first()[0] or 0
    assert math.isclose(total, max(0, balance), abs_tol=0.01)


def test_month_of_text(spark):
    texts = {"2025-3": "2025-03", "2025-03-09": "2025-03", " 2025/11/2": "2025-11", "2025.1": "2025-01", "202507": "2025-07", "2025-13": None, "2025-0": None, "20250709": None, "x2025-1": None, "": None}
    found = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", S.month_of_text(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in found} == texts | {None: None}


def test_blocks_of_one_large_file(spark, tmp_path):
    """A file is split at headings: several tasks, no block lost or cut."""
    blocks = [f"## invoice {i} — 2025/1/2\nline {i}\n" + "x" * 300 for i in range(4000)]
    (tmp_path / "one.txt").write_text("\n".join(blocks) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        found = readers.read_blocks(spark, str(tmp_path / "one.txt"))
        assert found.rdd.getNumPartitions() > 4
        assert sorted(r["value"].rstrip("\n") for r in found.collect()) == sorted(b.removeprefix("## ") for b in blocks)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labels_and_fence(spark):
    text = "## fatura 9 — 2025/3/4\nkod: outside\n```\nkod: C1\nisim: Ada\n1 A7 tin box 2 10 0.1 18\n2 A8 jar 1 5 0 0.1 4.5\n```\ntoplam: 22.5\n3 A9 after 1 1 0 0 1\n"
    names = readers.LABELS | {"code": "kod", "name": "isim", "total": "toplam"}
    rows = sorted(readers.fenced_invoices(spark.createDataFrame([(text,)], "value string"), least_numbers=4, labels=names).collect(), key=lambda r: r["seq"])
    assert [(r["seq"], r["item_name"], r["customer_code"], r["customer_name"], float(r["line_total"]), r["tax_pct"] and float(r["tax_pct"])) for r in rows] == [(1, "tin box", "C1", "Ada", 18, None), (2, "jar", "C1", "Ada", 4.5, 0.1)]
    assert float(rows[0]["invoice_reported_total"]) == 22.5


def test_nested_nan(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, (nan, [{"k": nan, "l": 2.0}, None]), inf, None), (2, None, 1.0, [nan, 3.0])], "i int, s struct<a: double, b: array<map<string, double>>>, x float, y array<double>")
    one_, two = (r.asDict(True) for r in sinks.without_nan(df).orderBy("i").collect())
    assert one_ == {"i": 1, "s": {"a": None, "b": [{"k": None, "l": 2.0}, None]}, "x": None, "y": None} and two == {"i": 2, "s": None, "x": 1.0, "y": [None, 3.0]}


def test_nested_sets(spark):
    rows = [("r1", "b1", "i1", 5, 1), ("r1", "b1", "i2", 9, 1), ("r1", "b2", "i1", 20, 1), ("r2", "b1", "i9", 100, 2), ("r3", "b1", "i1", 0, 0), ("r3", "b1", "i2", 0, 0)]
    df = spark.createDataFrame([(a, b, c, decimal.Decimal(v), q) for a, b, c, v, q in rows], "rep string, brand string, item_code string, line_total decimal(12,2), qty int")
    got = sorted((r["first"], r["last"], r["level"], r["rep"], r["brand"], r["item_code"], r["sales"]) for r in sales.nested_sets(df, ("rep", "brand", "item_code")).collect())
    r1 = [(4, 9, 1, "r1", None, None, 34), (5, 6, 2, "r1", "b2", None, 20), (6, 6, 3, "r1", "b2", "i1", 20), (7, 9, 2, "r1", "b1", None, 14), (8, 8, 3, "r1", "b1", "i2", 9), (9, 9, 3, "r1", "b1", "i1", 5)]
    r2, r3 = [(1, 3, 1, "r2", None, None, 100), (2, 3, 2, "r2", "b1", None, 100), (3, 3, 3, "r2", "b1", "i9", 100)], [(10, 13, 1, "r3", None, None, 0), (11, 13, 2, "r3", "b1", None, 0), (12, 12, 3, "r3", "b1", "i1", 0), (13, 13, 3, "r3", "b1", "i2", 0)]
    assert got == r2 + r1 + r3
    assert sales.nested_sets(df.limit(0), ("rep", "brand")).count() == 0


def test_unit_roots_against_least_squares(spark):
    """Statistic and lags as plain least squares give them, with the lags that AIC chooses."""
    rng = np.random.default_rng(3)
    made = {"walk": 1e6 + np.cumsum(rng.normal(0, 1e4, 40)), "noise": rng.gamma(2, 100, 60), "sparse": np.where(rng.random(80) < 0.3, rng.gamma(2, 100, 80), 0.0), "short": rng.normal(0, 1, 9), "flat": np.ones(20)}
    p = spark.createDataFrame([(k, i + 1, "m", float(v)) for k, y in made.items() for i, v in enumerate(y)], "series_key string, t int, month string, y double")

    def plain(y, lags, drop):
        d, at = np.diff(y), np.arange(drop, len(y) - 1)
        x = np.column_stack([np.ones(len(at)), *(d[at - k] for k in range(1, lags + 1)), y[at] - y.mean()])
        b, rest = np.linalg.lstsq(x, d[at], rcond=None)[0], 0
        rest = d[at] - x @ b
        s2 = rest @ rest / (len(at) - x.shape[1])
        return b[-1] / np.sqrt(s2 * np.linalg.pinv(x.T @ x)[-1, -1]), len(at) * np.log(rest @ rest / len(at)) + 2 * lags

    found = {r["series_key"]: r for r in series.unit_roots(p).collect()}
    assert found.keys() == {"walk", "noise", "sparse"}
    for k, r in found.items():
        y = made[k]
        most = min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2)
        lags = min(range(most + 1), key=lambda n: plain(y, n, most)[1])
        assert r["lags"] == lags and math.isclose(r["stat"], plain(y, lags, lags)[0], rel_tol=1e-6) and 0 <= r["p"] <= 1
    tested = {r["series_key"]: r for r in series.white(p).collect()}
    assert tested.keys() == {"walk", "noise", "sparse"} and all(r["df"] == 8 and 0 < r["p"] < 1 for r in tested.values())


def test_smoothing_of_all_origins():
    y = np.random.default_rng(1).gamma(2, 100, 30) + np.arange(30) * 3
    for trend, fit in ((True, forecast.fit_holt), (False, forecast.fit_ses)):
        assert np.allclose(forecast._Smoothing(y, 10, trend).forecasts(), [fit(y[:n], 1)[0][0] for n in range(10, 30)], rtol=1e-3)


def test_fits_of_many_series(spark):
    """Series fitted together get what each gets by itself; no grouped call runs once a series."""
    y = np.random.default_rng(9).gamma(2, 50, (40, 24))
    for many, one_fit in ((forecast.fits_holt, forecast.fit_holt), (forecast.fits_ses, forecast.fit_ses)):
        f, sse = many(y, 3)
        for i, v in enumerate(y):
            alone = one_fit(v, 3)
            assert np.array_equal(f[i], alone[0]) and sse[i] == alone[1]
    for trend in (False, True):
        assert np.array_equal(forecast._Smoothing(y, 10, trend).forecasts(), [forecast._Smoothing(v, 10, trend).forecasts() for v in y])
    p = spark.createDataFrame([(f"s{k}", t + 1, str(t), float(v)) for k in range(3) for t, v in enumerate(y[k][: 24 - k])], "series_key string, t int, month string, y double")
    for found in (forecast.information(p), forecast.panel_forecast(p), forecast.smoothed_folds(p)):
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.select("series_key").distinct().count() == 3
    assert forecast.smoothed_folds(p).count() == 2 * (14 + 13 + 12)


def plain_smoothing(y, trend):
    """The next value by the same grids, with each start solved for by least squares."""

    def at(a, b):
        runs = []
        for level, slope, own in ((0.0, 0.0, y), (1.0, 0.0, 0 * y), (0.0, 1.0, 0 * y))[: 3 if trend else 2]:
            e = np.empty(len(y))
            for i, v in enumerate(own):
                e[i] = v - level - slope
                level, slope = level + slope + a * e[i], slope + a * b * e[i]
            runs.append((e, level + slope))
        start = np.linalg.lstsq(np.column_stack([-e for e, _ in runs[1:]]), runs[0][0], rcond=None)[0]
        rest = runs[0][0] + sum(k * e for k, (e, _) in zip(start, runs[1:], strict=True))
        return rest @ rest, runs[0][1] + sum(k * ahead for k, (_, ahead) in zip(start, runs[1:], strict=True))

    low, high = np.full(2, 1e-4), np.full(2, 0.9999)
    for _ in range(7):
        grid = [(a, b) for a in np.linspace(low[0], high[0], 7) for b in (np.linspace(low[1], high[1], 7) if trend else [0.0])]
        best, step = np.array(min(grid, key=lambda x: at(*x)[0])), (high - low) / 6
        low, high = np.maximum(best - step, low), np.minimum(best + step, high)
    return at(*best)[1]


def test_origins_of_sparse_series():
    """Every origin of a batch gets what a plain search gives it. Signs turned in place on spaced numbers
    (np.negative) made this batch's forecasts wrong from origin 29 on."""
    rng = np.random.default_rng(59)
    y = np.where(rng.random((4, 40)) < 0.3, rng.gamma(2, 100, (4, 40)), 0.0)
    for trend in (True, False):
        found = forecast._Smoothing(y, 10, trend).forecasts()
        assert np.array_equal(found, [forecast._Smoothing(v, 10, trend).forecasts() for v in y])
        for series_, origin in ((0, 0), (1, 12), (3, 27), (0, 29), (2, 29), (3, 29)):
            assert math.isclose(found[series_, origin], plain_smoothing(y[series_, : 10 + origin], trend), rel_tol=1e-9)
    flat = forecast._Smoothing(np.append(np.zeros(14), [5.0, 0.0]), 10, True).forecasts()
    assert (flat[:5] == 0).all() and flat[5] != 0


def test_model_errors_are_summed_where_folds_are_made(spark):
    """As errors() of all folds; but a task gives a row for each series and model, and its panel is read once."""
    rng = np.random.default_rng(2)
    made = {"dense": rng.gamma(2, 100, 30), "sparse": np.where(rng.random(30) < 0.3, rng.gamma(2, 100, 30), 0.0), "late": np.append(np.zeros(20), rng.gamma(2, 100, 10)), "flat": np.full(30, 7.0), "short": rng.gamma(2, 100, 11), "none": rng.gamma(2, 100, 10)}
    p = spark.createDataFrame([(k, i + 1, str(i), float(v)) for k, y in made.items() for i, v in enumerate(y)], "series_key string, t int, month string, y double")
    for least in (10, 1):
        want = {(r["series_key"], r["model"]): r for r in forecast.errors(forecast.rolling_origin(p, least)).collect()}
        found = forecast.model_errors(forecast.in_rows(p), least).collect()
        assert len(found) == len(want) == 6 * (6 - (least == 10))
        for r in found:
            other = want[r["series_key"], r["model"]]
            assert r["folds"] == other["folds"] and all((r[k] is None and other[k] is None) or math.isclose(r[k], other[k], rel_tol=1e-9, abs_tol=2e-6) for k in ("rmse", "mae", "mape", "smape"))
    for name in ("item_model_errors", "customer_model_errors", "item_model_choice", "customer_model_choice"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Union" not in plan and "fold#" not in plan


def test_panel_with_a_row_per_key(spark):
    lines = spark.createDataFrame([("a", "1", 2.0), ("a", "3", 4.0), ("b", "2", 5.0), ("b", "2", 1.0), (None, "1", 7.0)], "k string, m string, v double")
    assert sorted((r["series_key"] or "", r["y"]) for r in series.panel_rows(lines, "k", "m", "v").collect()) == [("", [0.0, 0.0, 0.0]), ("a", [2.0, 0.0, 4.0]), ("b", [0.0, 6.0, 0.0])]


def test_panel_moves_its_rows_once(spark):
    """After the sums, a key's periods meet once: neither absent periods nor windows over a series move rows again."""
    lines = spark.createDataFrame([("a", "1", 2.0), ("a", "3", 4.0), ("b", "2", 5.0), ("b", "2", 1.0), (None, "1", 7.0)], "k string, m string, v double")
    p = series.panel(lines, "k", "m", "v")
    assert sorted((r["series_key"] or "", r["t"], r["month"], r["y"]) for r in p.collect()) == [("", t, str(t), 0.0) for t in (1, 2, 3)] + [("a", 1, "1", 2.0), ("a", 2, "2", 0.0), ("a", 3, "3", 4.0), ("b", 1, "1", 0.0), ("b", 2, "2", 6.0), ("b", 3, "3", 0.0)]
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(series_key")
    assert moved(forecast.expanding(series.panel(lines, "k", "m", "v"))) == 1


def test_quartiles_without_all_values_in_one_task(spark):
    rng = np.random.default_rng(3)
    a, b = np.concatenate([rng.normal(0, 50, 301), np.zeros(40), np.full(60, 7.25)]), rng.integers(1, 6, 401).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, 2.0)], "a double, b double")
    assert "percentile" not in sales.profile(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    found = {r["column"]: r for r in sales.profile(df, ["a", "b"]).collect()}
    for c, values in (("a", a), ("b", np.append(b, 2.0))):
        assert found[c]["n"] == len(values) and np.allclose([found[c][k] for k in ("p25", "p50", "p75")], np.quantile(values, [0.25, 0.5, 0.75]), atol=1e-6)
    assert sales.profile(df.filter("a > 1e9"), ["a"]).collect()[0]["p50"] is None


def test_lines_lie_by_invoice(spark):
    """Invoice texts group lines where the join with invoices left them; points of a chart come from one pass."""
    m, plain = view.Sales(spark, "/root/testdata/sf0.001"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = lambda df, key: df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({key}#")
        assert moved(m.lines.groupBy("invoice_no", "customer_code").count(), "invoice_no") == 2  # lines and invoices
        points = catalog.QUERIES["rank_against_variation"](spark, m.sf_dir)
        assert "customer" not in points._jdf.queryExecution().executedPlan().toString()  # counts of customers aren't asked for
        want = sales.rank_against_variation(sales.item_table(m.goods), sales.xyz(m.sold, "item_code"), "item_code")
        assert sorted(map(tuple, points.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_nested_sets_read_lines_alike(spark):
    """Every branch of the plan reads the same columns of lines, so that Spark makes their sums once."""
    plan = catalog.QUERIES["hierarchy_intervals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    read = [line.split("FileScan parquet ")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet [l_" in line]
    assert read and len({",".join(sorted(c.split("#")[0].strip("[") for c in r.split(","))) for r in read}) == 1


@pytest.mark.parametrize("name", ["monthly_series", "mean_of_monthly_ratios"])
def test_lines_pass_by_their_invoices(spark, name):
    """No task sorts the lines that meet their invoices: it holds its invoices only."""
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [invoice_no" not in plan


@pytest.mark.parametrize("name", ["mean_of_monthly_ratios", "monthly_series", "revenue_variation", "revenue_bridge", "months_by_revenue"])
def test_tasks_of_invoices_grow_with_lines(spark, name):
    """Twice the splits of the file of lines are met by twice the tasks, whatever the session's number of them."""
    plain, tasks = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for split in ("60000", "30000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            tasks.append({int(line.split("hashpartitioning(")[1].split(")")[0].split(", ")[1]) for line in plan.splitlines() if "Exchange hashpartitioning(invoice_no#" in line})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", plain)
    assert tasks == [{8}, {16}]  # 2 and 4 splits of 116,347 bytes
    if name == "mean_of_monthly_ratios":  # an invoice is held for its sum, in Spark's two steps, and for no distinct count
        assert sum("HashAggregate(keys=[month#" in line and "invoice_no#" in line.split("]")[0] for line in plan.splitlines()) == 2


def test_small_tables_keep_to_the_session(spark):
    """Where the session has shuffle partitions enough, Spark may join them; by a number of its own each would be a task."""
    plan = view.Sales(spark, "/root/testdata/sf0.001").dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 2 and "REPARTITION_BY_NUM" not in plan  # 1 split, 4 tasks


def test_monthly_ratios_are_those_of_the_series(spark):
    """Also where an invoice has several months or customers, or none of either, and where a month has no invoice."""
    rows = [("1", "a", "x", 6), ("1", "a", "x", 1), ("1", "a", "y", 2), ("1", "b", "x", 4), ("2", "a", "x", 3), ("2", "a", None, 3), ("2", None, "x", 8), (None, "c", "x", None), ("3", "c", "x", 5), ("3", "d", "x", None)]
    lines = spark.createDataFrame([(m, i, c, v, 1) for m, i, c, v in rows], "month string, invoice_no string, customer_code string, line_total int, qty int")
    found = {tuple(r) for r in sales.monthly_ratios(lines).collect()}
    assert found == {tuple(r) for r in sales.monthly_series(lines).select("month", "revenue_per_invoice").collect()}
    assert found == {("1", 6.5), ("2", 14.0), ("3", 2.5), (None, None)}


def test_item_summary_sums_lines_before_names(spark):
    """Lines are read once and summed by item before names join; an item with several rows counts its lines for each."""
    plan = catalog.QUERIES["item_summary_of_period"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1
    lines = spark.createDataFrame([("a", "1", 2, 6), ("a", "2", 1, 0), ("a", "2", 3, 9), ("b", "1", 5, 5), ("c", "2", 7, 0), ("d", "2", 1, 1)], "item_code string, month string, qty int, line_total int")
    items = spark.createDataFrame([("a", "y"), ("a", "z"), ("a", "z"), ("b", "x"), ("c", None), (None, "n")], "item_code string, item_name string")
    found = {r["item_code"]: (r["qty"], r["paid_qty"], r["paid_value"], r["n_lines"], r["item_name"], r["avg_price"]) for r in sales.item_summary(lines, items, F.col("month") == "2").collect()}
    assert found == {"a": (12.0, 9.0, 27.0, 6, "z", 3.0), "c": (7.0, 0.0, 0.0, 1, None, None)}
