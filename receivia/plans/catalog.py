"""Registered queries over the sales model, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.functions.scalars import clip, display_name, invoice_status, month_label, month_of_text, parse_date, parse_number, parse_number_or_zero, rate_class, ratio, to_numbers, usable_name
from receivia.operators import attribution, finance, forecast, quality, receivables, sales, series
from receivia.plans.view import AS_OF, CUTOFF, Sales, sql
from receivia.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a function of the sales model under its name, with its SQL."""

    def put(f: Callable[[Sales], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Sales(spark, sf_dir))
        if text is not None:
            ORACLES[f.__name__] = sql(text)
        return f

    return put


MONTHLY = """, m AS (SELECT month, CAST(sum(line_total) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS qty, count(DISTINCT invoice_no) AS n_invoices, count(DISTINCT customer_code) AS n_customers FROM lines GROUP BY month)"""


@query(MONTHLY + """ SELECT month, revenue, qty, n_invoices, n_customers, round(revenue / n_invoices, 6) AS revenue_per_invoice, round(revenue / qty, 6) AS avg_price,
  round((revenue - lag(revenue, 1) OVER w) / lag(revenue, 1) OVER w * 100, 6) AS mom_pct, round((revenue - lag(revenue, 12) OVER w) / lag(revenue, 12) OVER w * 100, 6) AS yoy_pct FROM m WINDOW w AS (ORDER BY month)""")
def monthly_series(m: Sales) -> DataFrame:
    return sales.monthly_series(m.dealt)


def _pareto(key: str) -> str:
    return f""", p AS (SELECT {key}, sum(line_total) AS v FROM lines GROUP BY {key}), r AS (SELECT {key}, CAST(v AS DOUBLE) AS value, row_number() OVER (ORDER BY v DESC, {key}) AS rank, CAST(sum(v) OVER (ORDER BY v DESC, {key} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum_value, CAST(sum(v) OVER () AS DOUBLE) AS whole, count(*) OVER () AS n FROM p)"""


@query(_pareto("customer_code") + """ SELECT customer_code, value, rank, round(rank / n * 100, 6) AS rank_pct, cum_value, round(cum_value / whole * 100, 6) AS cum_pct, CASE WHEN cum_value / whole * 100 <= 80 THEN 'A' WHEN cum_value / whole * 100 <= 95 THEN 'B' ELSE 'C' END AS abc FROM r""")
def pareto_abc_customers(m: Sales) -> DataFrame:
    return sales.pareto_abc(m.sold, "customer_code")


@query(_pareto("item_code") + """ SELECT CASE WHEN cum_value / whole * 100 <= 80 THEN 'A' WHEN cum_value / whole * 100 <= 95 THEN 'B' ELSE 'C' END AS abc, count(*) AS n FROM r GROUP BY 1""")
def abc_counts_items(m: Sales) -> DataFrame:
    return sales.class_counts(sales.pareto_abc(m.rows, "item_code"), "abc")


@query(_pareto("customer_code") + """ SELECT round(sum((value / whole) * (value / whole)) * 10000, 4) AS hhi, round(sum(value) FILTER (rank <= 5) / sum(value) * 100, 4) AS top5_pct, round(sum(value) FILTER (rank <= 10) / sum(value) * 100, 4) AS top10_pct, round(sum(value) FILTER (rank <= 20) / sum(value) * 100, 4) AS top20_pct, count(*) FILTER (cum_value - value < 0.8 * whole) AS n80, count(*) AS n_keys FROM r""")
def concentration_customers(m: Sales) -> DataFrame:
    return sales.concentration(m.sold, "customer_code")


@query(_pareto("customer_code") + """ SELECT CASE WHEN rank <= 5 THEN '01-05' WHEN rank <= 10 THEN '06-10' WHEN rank <= 20 THEN '11-20' ELSE 'rest' END AS band, round(sum(value), 4) AS value, count(*) AS n FROM r GROUP BY 1""")
def concentration_bands(m: Sales) -> DataFrame:
    return sales.concentration_bands(m.sold, "customer_code")


XYZ = """, g AS (SELECT item_code, month, CAST(sum(qty) AS DOUBLE) AS v FROM lines GROUP BY 1, 2), grid AS (SELECT i.item_code, mm.month, coalesce(v, 0) AS v FROM (SELECT DISTINCT item_code FROM g) i CROSS JOIN (SELECT DISTINCT month FROM lines) mm LEFT JOIN g ON g.item_code = i.item_code AND g.month = mm.month),
 z AS (SELECT item_code, round(avg(v), 4) AS mean, round(stddev_samp(v) / avg(v), 4) AS cv, CASE WHEN round(stddev_samp(v) / avg(v), 6) <= 0.5 THEN 'X' WHEN round(stddev_samp(v) / avg(v), 6) <= 1 THEN 'Y' ELSE 'Z' END AS xyz FROM grid GROUP BY item_code)"""


@query(XYZ + " SELECT item_code, mean, cv, xyz FROM z")
def xyz_items(m: Sales) -> DataFrame:
    return sales.xyz(m.sold, "item_code")


@query(XYZ + _pareto("item_code") + """, k AS (SELECT item_code, CASE WHEN cum_value / whole * 100 <= 80 THEN 'A' WHEN cum_value / whole * 100 <= 95 THEN 'B' ELSE 'C' END AS abc FROM r)
 SELECT abc, count(*) FILTER (xyz = 'X') AS X, count(*) FILTER (xyz = 'Y') AS Y, count(*) FILTER (xyz = 'Z') AS Z FROM k JOIN z USING (item_code) GROUP BY abc""")
def abc_xyz_matrix(m: Sales) -> DataFrame:
    return sales.class_matrix(sales.pareto_abc(m.sold, "item_code"), sales.xyz(m.sold, "item_code"), "item_code")


@query(""", b AS (SELECT month, dense_rank() OVER (ORDER BY month DESC) AS back FROM (SELECT DISTINCT month FROM lines)), g AS (SELECT customer_code, coalesce(CAST(sum(line_total) FILTER (back BETWEEN 1 AND 3) AS DOUBLE), 0) AS last, coalesce(CAST(sum(line_total) FILTER (back BETWEEN 4 AND 6) AS DOUBLE), 0) AS prior FROM lines JOIN b USING (month) GROUP BY 1)
 SELECT customer_code, last, prior, CASE WHEN prior <> 0 THEN round((last - prior) / prior * 100, 4) END AS growth_pct FROM g""")
def growth_last_quarter(m: Sales) -> DataFrame:
    return sales.growth_of_last_periods(m.sold, "customer_code")


@query(""", y AS (SELECT left(month, 4) AS year, right(month, 2) AS mon, CAST(sum(line_total) AS DOUBLE) AS v FROM lines GROUP BY 1, 2), s AS (SELECT mon, avg(v) AS mean, count(*) AS years FROM y GROUP BY mon), i AS (SELECT mon, years, round(mean / avg(mean) OVER () * 100, 1) AS idx FROM s)
 SELECT mon, years, idx, CASE WHEN idx >= 110 THEN 'peak' WHEN idx <= 90 THEN 'trough' ELSE 'normal' END AS level, years < 2 AS thin FROM i""")
def seasonality_index(m: Sales) -> DataFrame:
    return sales.seasonality(m.sold)


@query(""", b AS (SELECT brand, CAST(sum(line_total) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS qty, count(DISTINCT customer_code) AS n_customers FROM lines GROUP BY 1) SELECT *, round(revenue / sum(revenue) OVER () * 100, 4) AS share_pct FROM b""")
def brand_shares(m: Sales) -> DataFrame:
    return sales.share_table(m.goods, "brand")


@query(" SELECT month, brand, CAST(sum(line_total) AS DOUBLE) AS value FROM lines GROUP BY 1, 2")
def month_brand_matrix(m: Sales) -> DataFrame:
    return sales.matrix(m.goods, "month", "brand")


@query(""", g AS (SELECT rep, brand, sum(line_total) AS v FROM lines GROUP BY 1, 2) SELECT r.rep, b.brand, CAST(coalesce(v, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT rep FROM lines) r CROSS JOIN (SELECT DISTINCT brand FROM lines) b LEFT JOIN g ON g.rep = r.rep AND g.brand = b.brand""")
def rep_brand_heatmap(m: Sales) -> DataFrame:
    return sales.zero_filled(m.lines.withColumn("line_total", F.col("line_total").cast("decimal(38,6)")), ["rep"], "brand", "line_total").select("rep", "brand", F.col("line_total").cast("double").alias("value"))


def _top(order: str, k: int, least: int = 1) -> str:
    return f" SELECT item_code, CAST(sum(line_total) AS DOUBLE) AS value, count(*) AS n_rows FROM lines GROUP BY 1 HAVING count(*) >= {least} ORDER BY sum(line_total) {order}, item_code LIMIT {k}"


@query(_top("DESC", 10))
def top_items(m: Sales) -> DataFrame:
    return sales.top_k(m.rows, "item_code", 10)


@query(_top("ASC", 15, 5))
def bottom_items(m: Sales) -> DataFrame:
    return sales.top_k(m.rows, "item_code", 15, least_rows=5, lowest=True)


@query(""", g AS (SELECT brand, item_code, sum(line_total) AS v FROM lines GROUP BY 1, 2), r AS (SELECT brand, item_code, CAST(v AS DOUBLE) AS value, row_number() OVER (PARTITION BY brand ORDER BY v DESC, item_code) AS rank FROM g) SELECT * FROM r WHERE rank <= 8""")
def top_items_per_brand(m: Sales) -> DataFrame:
    return sales.top_k_per_group(m.goods, "brand", "item_code", 8)


@query(""", g AS (SELECT customer_code, brand, item_code, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(line_total) AS DOUBLE) AS sales FROM lines GROUP BY 1, 2, 3), w AS (SELECT CAST(sum(line_total) AS DOUBLE) AS whole FROM lines)
 SELECT customer_code, brand, item_code, qty, sales, CASE WHEN qty <> 0 THEN sales / qty END AS avg_price, round(sales / whole * 100, 6) AS share_pct FROM g, w""")
def hierarchy_leaves(m: Sales) -> DataFrame:
    return sales.hierarchy(m.goods)


@query(" SELECT rep, brand, CAST(sum(line_total) AS DOUBLE) AS sales, CAST(sum(qty) AS DOUBLE) AS qty, CAST(grouping(rep, brand) AS INTEGER) AS gid FROM lines GROUP BY ROLLUP (rep, brand)")
def hierarchy_rollup(m: Sales) -> DataFrame:
    return sales.rolled_up(m.lines, ("rep", "brand"))


@query()
def hierarchy_tree(m: Sales) -> DataFrame:
    return sales.tree(m.lines, "rep", "brand", "item_code").select("rep", F.to_json(F.struct("sales", "qty", "children")).alias("tree"))


@query(""", leaf AS (SELECT rep, brand, item_code, sum(line_total) AS v, sum(qty) AS q FROM lines GROUP BY 1, 2, 3), mid AS (SELECT rep, brand, sum(v) AS v, sum(q) AS q, count(*) + 1 AS size FROM leaf GROUP BY 1, 2), top AS (SELECT rep, sum(v) AS v, sum(q) AS q, sum(size) + 1 AS size FROM mid GROUP BY 1),
 t AS (SELECT *, 1 + coalesce(sum(size) OVER (ORDER BY v DESC, rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM top), b AS (SELECT mid.*, t.f + 1 + coalesce(sum(mid.size) OVER (PARTITION BY rep ORDER BY mid.v DESC, brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM mid JOIN t USING (rep)), l AS (SELECT leaf.*, b.f + row_number() OVER (PARTITION BY rep, brand ORDER BY leaf.v DESC, item_code) AS f FROM leaf JOIN b USING (rep, brand))
 SELECT rep, brand, item_code, CAST(level AS INTEGER) AS level, CAST(f AS BIGINT) AS first, CAST(f + size - 1 AS BIGINT) AS last, CAST(v AS DOUBLE) AS sales, CAST(q AS DOUBLE) AS qty FROM (SELECT rep, NULL AS brand, NULL AS item_code, 1 AS level, f, size, v, q FROM t UNION ALL SELECT rep, brand, NULL, 2, f, size, v, q FROM b UNION ALL SELECT rep, brand, item_code, 3, f, 1, v, q FROM l)""")
def hierarchy_intervals(m: Sales) -> DataFrame:
    return sales.nested_sets(m.lines, ("rep", "brand", "item_code"))


ITEM = """, t AS (SELECT item_code, min(item_name) AS item_name, min(brand) AS brand, sum(line_total) AS v, CAST(sum(qty) AS DOUBLE) AS qty, max(pack) AS pack, count(DISTINCT customer_code) AS n_customers, count(*) AS n_lines,
  CAST(sum(line_total) FILTER (unit_price > 0) AS DOUBLE) / nullif(CAST(sum(qty) FILTER (unit_price > 0) AS DOUBLE), 0) AS price, min(unit_price) FILTER (unit_price > 0) AS lo, max(unit_price) FILTER (unit_price > 0) AS hi FROM lines GROUP BY 1)"""


@query(ITEM + """ SELECT item_code, item_name, brand, CAST(v AS DOUBLE) AS sales, qty, CASE WHEN pack > 0 THEN round(qty / pack, 6) END AS boxes, n_customers, n_lines, round(price, 6) AS avg_price, round(lo, 6) AS min_price, round(hi, 6) AS max_price, round(CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100, 6) AS share_pct, CAST(row_number() OVER (ORDER BY v DESC, item_code) AS INTEGER) AS rank FROM t""")
def item_table(m: Sales) -> DataFrame:
    return sales.item_table(m.goods)


@query(""", n AS (SELECT item_code, item_name, count(*) AS c FROM lines GROUP BY 1, 2), nm AS (SELECT item_code, item_name FROM n QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY c DESC, item_name) = 1)
 SELECT item_code, qty, paid_qty, paid_value, n_lines, item_name, round(paid_value / nullif(paid_qty, 0), 6) AS avg_price FROM (SELECT item_code, CAST(sum(qty) AS DOUBLE) AS qty, coalesce(CAST(sum(qty) FILTER (line_total > 0) AS DOUBLE), 0) AS paid_qty, coalesce(CAST(sum(line_total) FILTER (line_total > 0) AS DOUBLE), 0) AS paid_value, count(*) AS n_lines FROM lines WHERE month >= '2000-01' GROUP BY 1) JOIN nm USING (item_code)""")
def item_summary_of_period(m: Sales) -> DataFrame:
    return sales.item_summary(m.sold, m.items, F.col("month") >= "2000-01")


@query(""", h AS (SELECT customer_code, sum(reported_total) AS v, CAST(sum(paid) AS DOUBLE) AS paid, count(DISTINCT invoice_no) AS n_invoices FROM headers GROUP BY 1), l AS (SELECT customer_code, count(DISTINCT item_code) AS n_items, CAST(sum(qty) AS DOUBLE) AS units, sum(CASE WHEN pack > 0 THEN CAST(qty AS DOUBLE) / pack END) AS boxes FROM lines GROUP BY 1)
 SELECT customer_code, CAST(v AS DOUBLE) AS sales, paid, n_invoices, coalesce(n_items, 0) AS n_items, coalesce(units, 0) AS units, round(coalesce(boxes, 0), 4) AS boxes, round(CAST(v AS DOUBLE) / n_invoices, 6) AS avg_invoice, CAST(row_number() OVER (ORDER BY v DESC, customer_code) AS INTEGER) AS rank FROM h LEFT JOIN l USING (customer_code)""")
def customer_table(m: Sales) -> DataFrame:
    return sales.customer_table(m.headers, m.goods)


@query(""" SELECT h.customer_code, coalesce(CAST(sum(reported_total) FILTER (reported_total <> 0) AS DOUBLE), 0) AS sales, count(*) AS n_invoices, count(*) FILTER (coalesce(reported_total, 0) = 0) AS n_zero, any_value(customer_name) AS customer_name, round(count(*) FILTER (coalesce(reported_total, 0) = 0) / count(*) * 100, 6) AS zero_pct FROM headers h LEFT JOIN customers c ON h.customer_code = c.customer_code GROUP BY 1""")
def customer_summary(m: Sales) -> DataFrame:
    return sales.customer_summary(m.headers, m.customers)


KPI = """, h AS (SELECT CAST(sum(reported_total) AS DOUBLE) AS sales, CAST(sum(paid) AS DOUBLE) AS paid, CAST(sum(remaining) AS DOUBLE) AS outstanding, count(DISTINCT customer_code) AS n_customers, count(DISTINCT invoice_no) AS n_invoices, count(*) FILTER (coalesce(reported_total, 0) = 0) AS n_zero FROM headers), l AS (SELECT CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(line_total) AS DOUBLE) AS net_sales, round(CAST(sum(line_total) FILTER (qty > 0 AND line_total > 0) AS DOUBLE) / CAST(sum(qty) FILTER (qty > 0 AND line_total > 0) AS DOUBLE), 6) AS avg_price, round(sum(CASE WHEN pack > 0 THEN CAST(qty AS DOUBLE) / pack END), 2) AS boxes FROM lines)"""


@query(KPI + " SELECT h.*, l.*, round(sales / n_invoices, 6) AS avg_invoice, round(paid / sales, 6) AS paid_rate FROM h, l")
def portfolio_kpis(m: Sales) -> DataFrame:
    return sales.kpis(m.headers, m.goods)


@query(KPI + " SELECT sales, qty, n_invoices, n_customers, n_zero, round(n_zero / n_invoices * 100, 6) AS zero_pct FROM h, l")
def grand_totals(m: Sales) -> DataFrame:
    return sales.grand_totals(m.headers, m.goods)


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lines"


@query(" " + " UNION ALL ".join(map(_profile, ("qty", "gross", "unit_price"))))
def numeric_profile(m: Sales) -> DataFrame:
    return sales.profile(m.rows, ["qty", "gross", "unit_price"])


@query(""", a AS (SELECT item_code, list_sort(list(unit_price)) AS a FROM lines WHERE unit_price > 0 GROUP BY 1 HAVING count(*) >= 3 ORDER BY item_code LIMIT 10)
 SELECT item_code, round(a[1], 6) AS low, round(a[CAST(floor((len(a) - 1) * 0.25) AS INTEGER) + 1], 6) AS q1, round(a[CAST(floor((len(a) - 1) * 0.5) AS INTEGER) + 1], 6) AS median, round(a[CAST(floor((len(a) - 1) * 0.75) AS INTEGER) + 1], 6) AS q3, round(a[len(a)], 6) AS high FROM a""")
def price_five_numbers(m: Sales) -> DataFrame:
    return sales.five_numbers(m.rows.filter("unit_price > 0"), "item_code", "unit_price")


@query(""", g AS (SELECT customer_code, CAST(sum(line_total) AS DOUBLE) / count(DISTINCT month) AS x FROM lines GROUP BY 1) SELECT round(avg(x), 4) AS mean, round(median(x), 4) AS median, count(*) AS n FROM g""")
def revenue_per_active_month(m: Sales) -> DataFrame:
    return sales.per_active_month(m.sold)


@query(MONTHLY + " SELECT round(avg(revenue), 4) AS mean, round(stddev_samp(revenue), 4) AS std, round(stddev_samp(revenue) / avg(revenue), 6) AS cv FROM m")
def revenue_variation(m: Sales) -> DataFrame:
    return sales.variation(sales.monthly_series(m.dealt), "revenue")


@query(MONTHLY + " SELECT round(avg(round(revenue / n_invoices, 6)), 4) AS mean_revenue_per_invoice FROM m")
def mean_of_monthly_ratios(m: Sales) -> DataFrame:
    return sales.mean_of_ratios(sales.monthly_ratios(m.dealt))


@query(""", x AS (SELECT CAST(reported_total AS DOUBLE) AS x FROM headers WHERE reported_total > 0), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT CAST(least(29, floor((x - lo) / ((hi - lo) / 30))) AS INTEGER) AS bin, count(*) AS n FROM x, s GROUP BY 1""")
def invoice_histogram(m: Sales) -> DataFrame:
    return sales.histogram(m.headers, "reported_total")


@query(" SELECT invoice_date AS day, CAST(sum(reported_total) AS DOUBLE) AS sales, CAST(sum(paid) AS DOUBLE) AS paid FROM headers GROUP BY 1")
def daily_sales(m: Sales) -> DataFrame:
    return sales.daily(m.headers)


TOP10 = ", top AS (SELECT item_code FROM lines GROUP BY 1 ORDER BY sum(line_total) DESC, item_code LIMIT 10)"


@query(TOP10 + " SELECT item_code, invoice_date AS day, CAST(sum(line_total) AS DOUBLE) AS sales, CAST(sum(qty) AS DOUBLE) AS qty FROM lines WHERE item_code IN (SELECT item_code FROM top) GROUP BY 1, 2")
def daily_sales_of_top_items(m: Sales) -> DataFrame:
    return sales.daily_of(m.sold, sales.top_k(m.sold, "item_code", 10))


@query(TOP10 + " SELECT item_code, month, CAST(sum(line_total) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(line_total) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS avg_price FROM lines WHERE item_code IN (SELECT item_code FROM top) GROUP BY 1, 2")
def months_of_top_items(m: Sales) -> DataFrame:
    return sales.months_of_top_items(m.sold)


@query(""", a AS (SELECT customer_code FROM lines GROUP BY 1 ORDER BY sum(line_total) DESC, 1 LIMIT 8), b AS (SELECT brand FROM lines GROUP BY 1 ORDER BY sum(line_total) DESC, 1 LIMIT 8) SELECT customer_code, brand, CAST(sum(line_total) AS DOUBLE) AS value FROM lines WHERE customer_code IN (SELECT * FROM a) AND brand IN (SELECT * FROM b) GROUP BY 1, 2""")
def customer_brand_flows(m: Sales) -> DataFrame:
    return sales.flows(m.goods, "customer_code", "brand")


RADAR = ("sales", "paid", "n_invoices", "n_items", "units")


@query(""", h AS (SELECT customer_code, sum(reported_total) AS v, CAST(sum(paid) AS DOUBLE) AS paid, count(DISTINCT invoice_no) AS n_invoices FROM headers GROUP BY 1), l AS (SELECT customer_code, count(DISTINCT item_code) AS n_items, CAST(sum(qty) AS DOUBLE) AS units FROM lines GROUP BY 1),
 t AS (SELECT customer_code, CAST(v AS DOUBLE) AS sales, paid, n_invoices, coalesce(n_items, 0) AS n_items, coalesce(units, 0) AS units FROM h LEFT JOIN l USING (customer_code) ORDER BY v DESC, customer_code LIMIT 5) SELECT customer_code, """ + ", ".join(f"round(CAST({c} AS DOUBLE) / max({c}) OVER (), 6) AS {c}" for c in RADAR) + " FROM t")
def customer_radar(m: Sales) -> DataFrame:
    return sales.radar(sales.customer_table(m.headers, m.goods), list(RADAR))


@query(" SELECT h.customer_code, CAST(sum(reported_total) AS DOUBLE) AS sales, any_value(CAST(net AS DOUBLE)) AS balance FROM headers h JOIN customers c ON h.customer_code = c.customer_code WHERE net IS NOT NULL GROUP BY 1")
def sales_against_balance(m: Sales) -> DataFrame:
    return sales.scatter(sales.customer_table(m.headers, m.goods), m.customers)


@query(MONTHLY + """ SELECT month, revenue, round(coalesce(sum(revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS bar_start, round(coalesce(sum(revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + revenue, 4) AS bar_end, round(coalesce(revenue - lag(revenue) OVER (ORDER BY month), 0), 4) AS change FROM m""")
def revenue_bridge(m: Sales) -> DataFrame:
    return sales.bridge(sales.monthly_series(m.dealt).select("month", "revenue"), "month", "revenue")


@query(ITEM + ", n AS (SELECT count(DISTINCT month) AS months FROM lines) SELECT t.item_code, t.qty, t.pack, round(CAST(v AS DOUBLE) / t.qty, 6) AS avg_price, CASE WHEN pack > 0 THEN round(t.qty / pack, 6) END AS boxes, CASE WHEN pack > 0 THEN t.qty / pack / months END AS boxes_a_month FROM t, n")
def pack_requirement(m: Sales) -> DataFrame:
    return sales.pack_requirement(m.goods)


@query(" SELECT customer_code, customer_name, rep FROM customers WHERE contains(lower(customer_name || ' ' || rep), 'china')")
def search_customers(m: Sales) -> DataFrame:
    return sales.search(m.customers, "China", ["customer_name", "rep"]).select("customer_code", "customer_name", "rep")


@query(""", l1 AS (SELECT * FROM lines WHERE month >= '1998-01' AND month <= '1998-02' AND brand = (SELECT min(brand) FROM lines)), h1 AS (SELECT * FROM headers WHERE month >= '1998-01' AND month <= '1998-02' AND status = 'F' AND invoice_no IN (SELECT invoice_no FROM l1))
 SELECT count(*) AS n_lines, CAST(sum(line_total) AS DOUBLE) AS net, (SELECT count(*) FROM h1) AS n_invoices FROM l1 WHERE invoice_no IN (SELECT invoice_no FROM h1)""")
def cross_filtered(m: Sales) -> DataFrame:
    brand = m.table("part").agg(F.min("p_brand")).first()[0]
    lines, headers, _ = sales.cross_filter(m.lines, m.headers, m.customers.withColumn("bucket", F.lit("all")), months=["1998-01", "1998-02"], brands=[brand], statuses=["F"])
    return lines.agg(F.count("*").alias("n_lines"), F.sum("line_total").cast("double").alias("net")).crossJoin(headers.agg(F.count("*").alias("n_invoices")))


@query(""", h AS (SELECT coalesce(month, 'all') AS month, CAST(sum(reported_total) AS DOUBLE) AS sales, CAST(sum(paid) AS DOUBLE) AS paid, count(*) AS n_invoices FROM headers GROUP BY ROLLUP (month)), l AS (SELECT coalesce(month, 'all') AS month, CAST(sum(line_total) AS DOUBLE) AS net_sales, CAST(sum(qty) AS DOUBLE) AS qty, count(*) AS n_lines FROM lines GROUP BY ROLLUP (month)) SELECT * FROM h FULL JOIN l USING (month)""")
def monthly_bundle(m: Sales) -> DataFrame:
    return sales.monthly_bundle(m.headers, m.sold)


@query(""", s AS (SELECT invoice_date AS date, 'invoice' AS kind, CAST(invoice_no AS VARCHAR) AS ref, reported_total AS amount FROM headers WHERE customer_code = '7' UNION ALL SELECT date, 'receipt', CAST(doc_ref AS VARCHAR), -amount FROM receipts WHERE customer_code = '7')
 SELECT date, kind, ref, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER (ORDER BY date, kind, ref ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM s""")
def customer_statement(m: Sales) -> DataFrame:
    return sales.statement(m.headers, m.receipts, "7")


# Finance


@query(""", d AS (SELECT CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(line_total) AS DOUBLE) AS net FROM lines WHERE NOT is_bonus) SELECT gross, net, round(gross - net, 4) AS deduction, round((gross - net) / gross * 100, 6) AS deduction_pct FROM d""")
def deductions(m: Sales) -> DataFrame:
    return finance.deductions(m.rows)


PRICE = """, price AS (SELECT item_code, CAST(sum(line_total) FILTER (line_total > 0) AS DOUBLE) / CAST(sum(qty) FILTER (line_total > 0) AS DOUBLE) AS price FROM lines GROUP BY 1)"""


@query(PRICE + """, f AS (SELECT item_code, CAST(sum(qty) AS DOUBLE) AS q FROM lines WHERE is_bonus GROUP BY 1), v AS (SELECT sum(q) AS free_qty, round(sum(q * coalesce(price, 0)), 2) AS free_value FROM f LEFT JOIN price USING (item_code)), r AS (SELECT CAST(sum(line_total) AS DOUBLE) AS revenue FROM lines) SELECT free_qty, free_value, revenue, round(free_value / revenue * 100, 4) AS free_pct FROM v, r""")
def free_goods(m: Sales) -> DataFrame:
    return finance.free_goods(m.sold)


@query(PRICE + """, f AS (SELECT customer_code, CAST(sum(qty) AS DOUBLE) AS free_qty, round(sum(CAST(qty AS DOUBLE) * coalesce(price, 0)), 4) AS free_value FROM lines LEFT JOIN price USING (item_code) WHERE is_bonus GROUP BY 1), w AS (SELECT customer_code, CAST(sum(qty) AS DOUBLE) AS q, CAST(sum(line_total) AS DOUBLE) AS v FROM lines GROUP BY 1)
 SELECT customer_code, free_qty, free_value, round(free_qty / q * 100, 4) AS free_qty_pct, round(free_value / nullif(v, 0) * 100, 4) AS free_value_pct FROM f JOIN w USING (customer_code)""")
def free_goods_by_customer(m: Sales) -> DataFrame:
    return finance.free_goods_by_customer(m.sold)


DSO = """, t AS (SELECT CAST(sum(line_total) AS DOUBLE) AS trailing_revenue FROM lines WHERE month IN (SELECT DISTINCT month FROM lines ORDER BY month DESC LIMIT 12)), a AS (SELECT CAST(sum(net) AS DOUBLE) AS net_ar FROM customers)"""


@query(DSO + " SELECT net_ar, trailing_revenue, round(net_ar / (trailing_revenue / 365), 6) AS dso FROM a, t")
def days_outstanding(m: Sales) -> DataFrame:
    return finance.days_outstanding(m.sold, m.customers)


@query(DSO + _pareto("customer_code").replace("r AS", "rk AS") + """, c AS (SELECT round(sum((value / whole) * (value / whole)) * 10000, 4) AS hhi_customers, round(sum(value) FILTER (rank <= 10) / sum(value) * 100, 4) AS top10_pct FROM rk), b AS (SELECT CAST(sum(line_total) AS DOUBLE) AS revenue, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS n_months FROM lines),
 d AS (SELECT CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(line_total) AS DOUBLE) AS net FROM lines WHERE NOT is_bonus) SELECT b.*, c.*, net_ar, trailing_revenue, round(net_ar / (trailing_revenue / 365), 6) AS dso, round((gross - net) / gross * 100, 6) AS deduction_pct FROM b, c, a, t, d""")
def executive_summary(m: Sales) -> DataFrame:
    return finance.executive_summary(m.sold, m.customers)


@query(""", d AS (SELECT customer_code, CAST(greatest(net, 0) AS DOUBLE) AS v FROM customers), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, customer_code) AS rank, sum(v) OVER () AS whole FROM d) SELECT round(sum(v) FILTER (rank <= 10) / max(whole) * 100, 4) AS top_pct, round(sum((v / whole) * (v / whole)) * 10000, 4) AS hhi FROM r""")
def debtor_concentration(m: Sales) -> DataFrame:
    return finance.debtor_concentration(m.customers)


# Quality


@query(" " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_missing, round(count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / count(*) * 100, 6) AS missing_pct FROM lines" for c in ("invoice_no", "item_name", "customer_code", "qty")))
def missing_profile(m: Sales) -> DataFrame:
    return quality.missing_profile(m.goods, ["invoice_no", "item_name", "customer_code", "qty"])


@query(" SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_line_keys(m: Sales) -> DataFrame:
    return quality.repeated_keys(m.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(" SELECT item_name, count(DISTINCT item_code) AS n_values FROM lines GROUP BY 1 HAVING count(DISTINCT item_code) > 1")
def names_of_many_items(m: Sales) -> DataFrame:
    return quality.many_values(m.goods, "item_name", "item_code")


@query(""", s AS (SELECT h.invoice_no, CAST(h.reported_total AS DOUBLE) AS reported_total, coalesce(CAST(sum(line_total) AS DOUBLE), 0) AS line_sum FROM headers h LEFT JOIN lines l ON h.invoice_no = l.invoice_no GROUP BY 1, 2)
 SELECT invoice_no, reported_total, line_sum, abs(round(reported_total - line_sum, 6)) AS diff, abs(round(reported_total - line_sum, 6)) <= greatest(1.0, abs(reported_total) * 0.01) AS passes FROM s""")
def reconciliation(m: Sales) -> DataFrame:
    return quality.reconcile(m.rows, m.headers)


@query(""", r AS (SELECT abs(CAST(line_total AS DOUBLE) - CAST(qty AS DOUBLE) * unit_price * (1 - CAST(disc AS DOUBLE)) * (1 - CAST(tax AS DOUBLE))) AS r FROM lines) SELECT round(avg(r), 6) AS mean_abs, round(max(r), 6) AS max_abs, round(count(*) FILTER (r <= 1) / count(*) * 100, 6) AS within_1_pct FROM r""")
def formula_check(m: Sales) -> DataFrame:
    return quality.formula_check(m.rows)


@query(""", q AS (SELECT item_code, count(*) AS n, quantile_cont(unit_price, 0.25) AS q1, quantile_cont(unit_price, 0.75) AS q3 FROM lines WHERE NOT is_bonus AND unit_price > 0 GROUP BY 1 HAVING count(*) >= 8), f AS (SELECT item_code, n, round(q1 - 3 * (q3 - q1), 3) AS low, round(q3 + 3 * (q3 - q1), 3) AS high FROM q)
 SELECT item_code, n, low, high, count(*) FILTER (unit_price < low OR unit_price > high) AS n_outliers FROM f JOIN lines USING (item_code) WHERE NOT is_bonus AND unit_price > 0 GROUP BY 1, 2, 3, 4""")
def price_outliers(m: Sales) -> DataFrame:
    return quality.outliers(m.rows)


@query(""" SELECT count(*) AS n_lines, count(*) FILTER (qty < 0) AS n_negative_qty, count(*) FILTER (line_total = 0) AS n_zero, count(*) FILTER (is_bonus) AS n_free, round(count(*) FILTER (is_bonus) / count(*) * 100, 6) AS free_pct, """ + ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {f}_{c}" for c in ("qty", "line_total", "disc", "tax") for f in ("min", "max")) + " FROM lines")
def line_counters(m: Sales) -> DataFrame:
    return quality.counters(m.rows)


@query(" SELECT count(*) FILTER (unit_price > 1500) AS n_price, count(*) FILTER (qty > 49) AS n_qty, count(*) FILTER (unit_price < 0 OR qty < 0) AS n_negative FROM lines")
def abnormal_lines(m: Sales) -> DataFrame:
    return quality.abnormal(m.rows, 1500, 49)


@query(" SELECT month AS key, count(*) AS stated, count(*) FILTER (status <> 'P') AS found FROM headers GROUP BY 1 HAVING count(*) <> count(*) FILTER (status <> 'P')")
def control_totals(m: Sales) -> DataFrame:
    stated = m.headers.groupBy(F.col("month").alias("key")).agg(F.count("*").alias("stated"))
    return quality.control_totals(m.headers.groupBy(F.col("month").alias("key")).agg(F.count_if(F.col("status") != "P").alias("found")), stated)


@query(" SELECT CASE WHEN reported_total IS NULL OR reported_total = 0 THEN 'zero' WHEN coalesce(remaining, 0) <= 0 THEN 'paid' ELSE 'unpaid' END AS status, count(*) AS n FROM headers GROUP BY 1")
def invoice_statuses(m: Sales) -> DataFrame:
    return m.headers.groupBy(invoice_status(F.col("reported_total"), F.col("remaining")).alias("status")).agg(F.count("*").alias("n"))


@query(" SELECT 'invoices have dates' AS name, count(*) FILTER (invoice_date IS NULL) = 0 AS passed, count(*) FILTER (invoice_date IS NULL) AS n_failed FROM headers UNION ALL SELECT 'totals are not negative', bool_and(reported_total >= 0), count(*) FILTER (NOT reported_total >= 0) FROM headers UNION ALL SELECT 'rates are at most 1', bool_and(disc <= 1), count(*) FILTER (NOT disc <= 1) FROM lines")
def validation_gate(m: Sales) -> DataFrame:
    return quality.checks([("invoices have dates", m.headers, F.col("invoice_date").isNotNull()), ("totals are not negative", m.headers, F.col("reported_total") >= 0), ("rates are at most 1", m.sold, F.col("disc") <= 1)])


# Receivables


@query(" SELECT CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit, CAST(sum(net) AS DOUBLE) AS net, count(*) FILTER (net > 0) AS n_debit, count(*) FILTER (net < 0) AS n_credit FROM customers")
def receivable_totals(m: Sales) -> DataFrame:
    return receivables.totals(m.customers)


@query(" SELECT rep, CAST(sum(debit) AS DOUBLE) AS debit, CAST(sum(credit) AS DOUBLE) AS credit, CAST(sum(net) AS DOUBLE) AS net, count(DISTINCT customer_code) AS n_customers FROM customers GROUP BY 1")
def receivables_by_rep(m: Sales) -> DataFrame:
    return receivables.by_rep(m.customers)


ARREARS = f""", last AS (SELECT customer_code, max(invoice_date) AS last_invoice_date FROM headers GROUP BY 1), ar AS (SELECT c.customer_code, rep, last_invoice_date, CAST(greatest(net, 0) AS DOUBLE) AS debt, CAST(greatest(-net, 0) AS DOUBLE) AS credit_balance, coalesce(date_diff('day', last_invoice_date, DATE '{AS_OF}') > 30, true) AS old FROM customers c LEFT JOIN last USING (customer_code)),
 arrears AS (SELECT customer_code, rep, last_invoice_date, debt, credit_balance, CASE WHEN old THEN 0 ELSE debt END AS current_amount, CASE WHEN old THEN debt ELSE 0 END AS arrears_amount FROM ar)"""


@query(ARREARS + " SELECT * FROM arrears")
def arrears_detail(m: Sales) -> DataFrame:
    return receivables.arrears(m.customers, m.headers, AS_OF)


@query(ARREARS + " SELECT rep, round(sum(debt), 4) AS debt, round(sum(credit_balance), 4) AS credit_balance, round(sum(current_amount), 4) AS current_amount, round(sum(arrears_amount), 4) AS arrears_amount, count(*) FILTER (arrears_amount > 0) AS n_in_arrears FROM arrears GROUP BY 1")
def arrears_by_rep(m: Sales) -> DataFrame:
    return receivables.arrears_by_rep(receivables.arrears(m.customers, m.headers, AS_OF))


_BUCKET = "CASE WHEN {0} < 31 THEN 'd1_30' WHEN {0} < 61 THEN 'd31_60' WHEN {0} < 91 THEN 'd61_90' WHEN {0} < 121 THEN 'd91_120' ELSE 'd120p' END"


@query(ARREARS + f""", b AS (SELECT debt, CASE WHEN arrears_amount > 0 THEN {_BUCKET.format("d")} ELSE 'current' END AS bucket FROM (SELECT *, greatest(coalesce(date_diff('day', last_invoice_date, DATE '{AS_OF}'), 9999) - 30, 1) AS d FROM arrears WHERE debt > 0)) SELECT bucket, round(sum(debt), 4) AS amount, count(*) AS n FROM b GROUP BY 1""")
def snapshot_aging(m: Sales) -> DataFrame:
    return receivables.aging_totals(receivables.snapshot_aging(receivables.arrears(m.customers, m.headers, AS_OF), AS_OF))


FIFO = f""", owing AS (SELECT customer_code, net AS balance FROM customers WHERE net > 0), bills AS (SELECT h.customer_code, invoice_no, invoice_date, reported_total AS amount, sum(reported_total) OVER (PARTITION BY h.customer_code ORDER BY invoice_date, invoice_no ROWS UNBOUNDED PRECEDING) AS cum, sum(reported_total) OVER (PARTITION BY h.customer_code) AS billed, balance FROM headers h JOIN owing USING (customer_code) WHERE reported_total > 0),
 dated AS (SELECT customer_code, invoice_no, invoice_date, CAST(greatest(0, least(amount, cum - greatest(billed - balance, 0))) AS DOUBLE) AS unpaid, date_diff('day', invoice_date, DATE '{AS_OF}') AS age FROM bills),
 opening AS (SELECT customer_code, CAST(balance - coalesce(billed, 0) AS DOUBLE) AS unpaid FROM owing LEFT JOIN (SELECT customer_code, sum(reported_total) AS billed FROM headers WHERE reported_total > 0 GROUP BY 1) USING (customer_code)),
 fifo AS (SELECT customer_code, invoice_no, invoice_date, unpaid, CASE WHEN invoice_date <= DATE '{CUTOFF}' THEN {_BUCKET.format("age")} ELSE 'current' END AS bucket FROM dated WHERE unpaid > 0.005 UNION ALL SELECT customer_code, NULL, NULL, unpaid, 'd120p' FROM opening WHERE unpaid > 0.005)"""


def _fifo(m: Sales) -> DataFrame:
    return receivables.fifo(m.headers, m.customers.select("customer_code", F.col("net").alias("balance")), AS_OF, CUTOFF)


@query(FIFO + " SELECT * FROM fifo")
def fifo_open_invoices(m: Sales) -> DataFrame:
    return _fifo(m)


_BUCKETS = ("current", "d1_30", "d31_60", "d61_90", "d91_120", "d120p")
OVERDUE = FIFO + ", o AS (SELECT customer_code, " + ", ".join(f"round(coalesce(sum(unpaid) FILTER (bucket = '{b}'), 0), 4) AS {b}" for b in _BUCKETS) + f""", min(invoice_date) AS oldest FROM fifo GROUP BY 1), od AS (SELECT *, round(d1_30 + d31_60 + d61_90 + d91_120 + d120p, 4) AS overdue, round(round(d1_30 + d31_60 + d61_90 + d91_120 + d120p, 4) + "current", 4) AS balance, greatest(coalesce(date_diff('day', oldest + INTERVAL 30 DAY, DATE '{AS_OF}'), 0), 0) AS days_overdue, greatest("current", d1_30, d31_60, d61_90, d91_120, d120p) AS most FROM o)"""


@query(OVERDUE + " SELECT * EXCLUDE (most, days_overdue), CAST(days_overdue AS INTEGER) AS days_overdue, CASE most " + " ".join(f"WHEN \"{b}\" THEN '{b}'" for b in _BUCKETS) + " END AS dominant FROM od")
def fifo_overdue(m: Sales) -> DataFrame:
    return receivables.overdue(_fifo(m), AS_OF)


@query(OVERDUE + " SELECT " + ", ".join(f'round(sum("{b}"), 2) AS "{b}"' for b in (*_BUCKETS, "overdue", "balance")) + ", count(*) AS n_customers FROM od")
def fifo_totals(m: Sales) -> DataFrame:
    return receivables.overdue_totals(receivables.overdue(_fifo(m), AS_OF))


@query(OVERDUE + " SELECT " + ", ".join(f'round(sum("{b}"), 2) AS "{b}"' for b in (*_BUCKETS, "overdue", "balance")) + ", count(*) AS n_customers FROM od WHERE customer_code IN (SELECT customer_code FROM headers WHERE month = '2001-06')")
def fifo_cohort(m: Sales) -> DataFrame:
    return receivables.overdue_totals(receivables.cohort(receivables.overdue(_fifo(m), AS_OF), m.headers, "2001-06"))


@query(f""", u AS (SELECT customer_code, invoice_no, invoice_date, row_number() OVER (PARTITION BY customer_code ORDER BY invoice_date, invoice_no) AS k FROM headers WHERE remaining > 0) SELECT customer_code, invoice_no, invoice_date, CAST(invoice_date + INTERVAL 30 DAY AS DATE) AS due_date, CAST(greatest(date_diff('day', CAST(invoice_date + INTERVAL 30 DAY AS DATE), DATE '{AS_OF}'), 0) AS INTEGER) AS days_overdue FROM u WHERE k = 1""")
def oldest_unpaid(m: Sales) -> DataFrame:
    return receivables.oldest_unpaid(m.headers, AS_OF)


RATES = """, b AS (SELECT customer_code, CAST(sum(reported_total) AS DOUBLE) AS billed FROM headers WHERE year(invoice_date) = 2000 GROUP BY 1), g AS (SELECT customer_code, CAST(sum(amount) AS DOUBLE) AS received FROM receipts GROUP BY 1), x AS (SELECT customer_code, billed, received, CAST(net AS DOUBLE) AS net, received / nullif(billed, 0) AS actual, (billed - greatest(CAST(net AS DOUBLE), 0)) / nullif(billed, 0) AS proxy FROM b LEFT JOIN g USING (customer_code) LEFT JOIN customers USING (customer_code)),
 rates AS (SELECT customer_code, billed, coalesce(received, 0) AS received, round(greatest(0, least(1, coalesce(actual, proxy))), 6) AS rate, CASE WHEN actual IS NOT NULL THEN 'actual' WHEN proxy IS NOT NULL THEN 'proxy' ELSE 'none' END AS basis FROM x)"""


def _rates(m: Sales) -> DataFrame:
    receipts = m.receipts.withColumn("date", F.lit("2000-06-30").cast("date"))  # the events are of another year
    return receivables.collection_rates(m.headers, m.customers, receipts, 2000)


@query(RATES + " SELECT *, round(billed * CASE WHEN rate >= 0.95 THEN 0.05 WHEN rate >= 0.9 THEN 0.03 WHEN rate >= 0.8 THEN 0.02 WHEN rate >= 0.7 THEN 0.01 ELSE 0 END, 4) AS incentive FROM rates")
def collection_rates(m: Sales) -> DataFrame:
    return _rates(m)


@query(RATES + ", t(lower, upper) AS (VALUES (0.0, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 9.0)) SELECT CAST(lower AS DOUBLE) AS lower, count(rate) AS n FROM t LEFT JOIN rates ON coalesce(rate, 0) >= lower AND coalesce(rate, 0) < upper GROUP BY 1")
def incentive_tiers(m: Sales) -> DataFrame:
    tiers = m.spark.createDataFrame([(0.0, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 9.0)], "lower double, upper double")
    return receivables.tier_counts(_rates(m), tiers)


@query(ARREARS + ", s AS (SELECT customer_code, CAST(sum(reported_total) AS DOUBLE) AS sales FROM headers GROUP BY 1) SELECT customer_code, coalesce(sales, 0) AS sales, coalesce(debt, 0) AS debt, coalesce(arrears_amount, 0) AS arrears_amount FROM s FULL JOIN arrears USING (customer_code)")
def customer_360(m: Sales) -> DataFrame:
    sold = m.headers.groupBy("customer_code").agg(F.sum("reported_total").cast("double").alias("sales"))
    return receivables.customer_360(sold, receivables.arrears(m.customers, m.headers, AS_OF).select("customer_code", "debt", "arrears_amount"))


@query(" SELECT customer_code, customer_name, rep, CAST(net AS DOUBLE) AS net FROM customers WHERE customer_code NOT IN (SELECT customer_code FROM headers)")
def balances_without_invoices(m: Sales) -> DataFrame:
    return attribution.without_invoices(m.customers, m.headers).select("customer_code", "customer_name", "rep", F.col("net").cast("double").alias("net"))


# Attribution

ATTR = """, k AS (SELECT lower(trim(customer_name)) AS key, min(customer_code) AS customer_code FROM customers GROUP BY 1 HAVING count(DISTINCT customer_code) = 1), att AS (SELECT r.amount, r.month, k.customer_code, coalesce(c.rep, 'unmatched') AS rep FROM receipts r LEFT JOIN k ON lower(trim(r.customer_name)) = k.key LEFT JOIN customers c ON c.customer_code = k.customer_code)"""


def _attributed(m: Sales) -> DataFrame:
    return attribution.attribute(m.receipts, m.customers, m.customers)


@query(ATTR + " SELECT rep, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM att GROUP BY 1")
def receipts_by_rep(m: Sales) -> DataFrame:
    return attribution.summed(_attributed(m), "rep")


@query(ATTR + " SELECT coalesce(CAST(sum(amount) FILTER (customer_code IS NOT NULL) AS DOUBLE), 0) AS attributed, coalesce(CAST(sum(amount) FILTER (customer_code IS NULL) AS DOUBLE), 0) AS unmatched, CAST(sum(amount) AS DOUBLE) AS total, count(*) FILTER (customer_code IS NULL) AS n_unmatched FROM att")
def receipts_reconciled(m: Sales) -> DataFrame:
    return attribution.reconciled(_attributed(m))


@query(", a AS (SELECT month, CAST(sum(reported_total) AS DOUBLE) AS billed FROM headers GROUP BY 1), b AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS collected FROM receipts GROUP BY 1), c AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS returned FROM returns GROUP BY 1) SELECT month, coalesce(billed, 0) AS billed, coalesce(collected, 0) AS collected, coalesce(returned, 0) AS returned FROM a FULL JOIN b USING (month) FULL JOIN c USING (month)")
def billing_bridge(m: Sales) -> DataFrame:
    return attribution.monthly_bridge(m.headers, m.receipts, m.returns)


@query(" SELECT h.customer_code, count(DISTINCT invoice_no) AS n_invoices, CAST(sum(reported_total) AS DOUBLE) AS total_revenue, min(invoice_date) AS first_invoice_date, max(invoice_date) AS last_invoice_date, any_value(customer_name) AS customer_name, 1 AS n_name_variants, any_value(rep) AS rep, any_value(city) AS city, any_value(CAST(net AS DOUBLE)) AS ar_net_balance, true AS has_ar_snapshot FROM headers h JOIN customers c ON h.customer_code = c.customer_code GROUP BY 1")
def customer_dimension(m: Sales) -> DataFrame:
    return attribution.customer_dimension(m.headers, m.customers, m.customers)


#: A master of item names as a fixed reference table: some within item names or around them, some misspelt.
MASTER = [("Red Widget XL", "Ridge", "12 a box"), ("blue-bolt", "Ridge", "24 a box"), ("bolt, blue", "Other", "6"), ("smal rnig", "Ringo", "10 rings"), ("cold anvil", "Forge", None), ("clod anvil No. 2", "Forge", "2"), ("hotgear", "Gearo", "40 / box"), ("old plates", "Plato", "8 a box"), ("lrge gizmo", "Gizmo", "5"), ("nwe rdo", "Rodo", "9"), ("", "Nobody", "1")]
KEYWORDS = [("(?i)widget", "any widget"), ("(?i)g", "with g")]
OVERRIDES = [("1", "Own brand"), ("7", "Own brand"), ("no such item", "Nobody")]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else "'" + v + "'" for v in r) + ")" for r in rows)
MATCHED = f""", ms AS (SELECT *, lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS m FROM (VALUES {_VALUES(MASTER)}) t(name, brand, cap)), ov AS (SELECT * FROM (VALUES {_VALUES(OVERRIDES)}) t(item_code, b)),
 it AS MATERIALIZED (SELECT item_code, item_name, lower(regexp_replace(item_name, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS i FROM (SELECT item_code, item_name, count(*) AS c FROM lines GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY count(*) DESC, item_name) = 1)),
 pr AS MATERIALIZED (SELECT row_number() OVER () AS id, i, m FROM (SELECT DISTINCT i, m FROM it CROSS JOIN ms WHERE i <> '' AND m <> '')),
 rn AS MATERIALIZED (SELECT id, x AS i, y AS j, max(k) AS l FROM (SELECT id, pr.i, pr.m, unnest(range(1, length(pr.i) + 1)) AS x FROM pr) p, range(1, 40) t(y), range(1, 40) u(k) WHERE y + k <= length(p.m) + 1 AND x + k <= length(p.i) + 1 AND substring(p.i, x, k) = substring(p.m, y, k) GROUP BY 1, 2, 3),
 sg AS (SELECT id, CAST(1 AS BIGINT) AS al, CAST(length(i) + 1 AS BIGINT) AS ah, CAST(1 AS BIGINT) AS bl, CAST(length(m) + 1 AS BIGINT) AS bh, CAST(0 AS BIGINT) AS k FROM pr
  UNION ALL SELECT id, CASE side WHEN 0 THEN al ELSE w.k - w.i END, CASE side WHEN 0 THEN -w.i ELSE ah END, CASE side WHEN 0 THEN bl ELSE w.k - w.j END, CASE side WHEN 0 THEN -w.j ELSE bh END, CASE side WHEN 0 THEN w.k ELSE 0 END
  FROM (SELECT sg.id, sg.al, sg.ah, sg.bl, sg.bh, max({{'k': least(rn.l, sg.ah - rn.i, sg.bh - rn.j), 'i': -rn.i, 'j': -rn.j}}) AS w FROM sg JOIN rn ON rn.id = sg.id AND rn.i >= sg.al AND rn.i < sg.ah AND rn.j >= sg.bl AND rn.j < sg.bh GROUP BY 1, 2, 3, 4, 5) CROSS JOIN (VALUES (0), (1)) s(side)),
 ra AS (SELECT pr.i, pr.m, 2.0 * sum(k) / (length(pr.i) + length(pr.m)) AS r FROM sg JOIN pr USING (id) GROUP BY 1, 2),
 f1 AS (SELECT i, max({{'s': least(length(i), length(m)), 'n': name, 'b': brand}}) AS w FROM pr JOIN ms USING (m) WHERE least(length(i), length(m)) >= 6 AND (contains(i, m) OR contains(m, i)) GROUP BY 1), f2 AS (SELECT i, max({{'s': r, 'n': name, 'b': brand}}) AS w FROM ra JOIN ms USING (m) WHERE r >= 0.72 AND i NOT IN (SELECT i FROM f1) GROUP BY 1),
 found AS (SELECT item_code, item_name, coalesce(f1.w.b, f2.w.b, CASE WHEN item_name ILIKE '%widget%' THEN 'any widget' WHEN item_name ILIKE '%g%' THEN 'with g' ELSE 'unclassified' END) AS brand, coalesce(f1.w.n, f2.w.n) AS master_name, CASE WHEN f1.i IS NOT NULL THEN 'master' WHEN f2.i IS NOT NULL THEN 'fuzzy' WHEN item_name ILIKE '%g%' THEN 'keyword' ELSE 'unclassified' END AS match_type FROM it LEFT JOIN f1 USING (i) LEFT JOIN f2 USING (i)),
 matched AS (SELECT item_code, item_name, coalesce(b, brand) AS brand, master_name, CASE WHEN b IS NOT NULL THEN 'override' ELSE match_type END AS match_type FROM found LEFT JOIN ov USING (item_code))"""


def _reference(m: Sales, rows: list, schema: str) -> DataFrame:
    return m.spark.createDataFrame(rows, schema)


_MATCHED_ROWS = r""", tot AS (SELECT item_code, CAST(sum(line_total) AS DOUBLE) AS total_revenue, CAST(sum(qty) AS DOUBLE) AS total_qty, count(*) AS n_lines FROM lines GROUP BY 1)
 SELECT item_code, item_name, matched.brand, master_name, match_type, CAST(nullif(regexp_extract(cap, '(\d+)', 1), '') AS DOUBLE) AS pack, total_revenue, total_qty, n_lines FROM matched JOIN tot USING (item_code) LEFT JOIN ms ON ms.name = master_name"""


@query(MATCHED + _MATCHED_ROWS)
def matched_items(m: Sales) -> DataFrame:
    master = _reference(m, MASTER, "name string, brand string, carton_capacity string")
    overrides = _reference(m, OVERRIDES, "item_code string, brand string")
    return attribution.item_dimension(m.sold, m.items, master, KEYWORDS, overrides)


@query(MATCHED + _MATCHED_ROWS.replace("matched.brand", "found.brand").replace("FROM matched JOIN", "FROM found JOIN"))
def item_dimension(m: Sales) -> DataFrame:
    """Without overrides."""
    return attribution.item_dimension(m.sold, m.items, _reference(m, MASTER, "name string, brand string, carton_capacity string"), KEYWORDS)


for _name in ("matched_items", "item_dimension"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)

# Sets


@query(""", a AS (SELECT customer_code FROM headers GROUP BY 1 ORDER BY sum(reported_total) DESC, 1 LIMIT 50), b AS (SELECT customer_code FROM customers ORDER BY net DESC, customer_code LIMIT 50) SELECT customer_code, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT customer_code, 'sales only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def large_on_both_sides(m: Sales) -> DataFrame:
    a = m.headers.groupBy("customer_code").agg(F.sum("reported_total").alias("v")).orderBy(F.desc("v"), "customer_code").limit(50).select("customer_code")
    b = m.customers.orderBy(F.desc("net"), "customer_code").limit(50).select("customer_code")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("sales only")))


@query(" SELECT DISTINCT month FROM (SELECT month FROM headers UNION SELECT month FROM receipts)")
def all_months(m: Sales) -> DataFrame:
    return m.headers.select("month").union(m.receipts.select("month")).distinct()


# Series

PANEL = """, mo AS (SELECT month, row_number() OVER (ORDER BY month) AS t FROM (SELECT DISTINCT month FROM lines)), g AS (SELECT brand, month, CAST(sum(line_total) AS DOUBLE) AS v FROM lines GROUP BY 1, 2), panel AS (SELECT b.brand AS series_key, mo.t, mo.month, coalesce(v, 0) AS y FROM (SELECT DISTINCT brand FROM lines) b CROSS JOIN mo LEFT JOIN g ON g.brand = b.brand AND g.month = mo.month)"""
ACF = PANEL + """, d AS (SELECT series_key, t, y - avg(y) OVER (PARTITION BY series_key) AS d, count(*) OVER (PARTITION BY series_key) AS n FROM panel), a AS (SELECT x.series_key, k.lag, any_value(x.n) AS n, sum(x.d * z.d) AS p FROM d x CROSS JOIN (SELECT unnest(range(0, 9)) AS lag) k JOIN d z ON z.series_key = x.series_key AND z.t = x.t - k.lag GROUP BY 1, 2), acf AS (SELECT a.series_key, CAST(a.lag AS INTEGER) AS lag, a.n, a.p / z.p AS r FROM a JOIN a z ON a.series_key = z.series_key AND z.lag = 0)"""


def _panel(m: Sales, key: str | None = "brand") -> DataFrame:
    return series.panel(m.goods if key == "brand" else m.sold, key, "month", "line_total")


@query(ACF + " SELECT series_key, lag, n, round(r, 6) AS acf, round(1.96 / sqrt(n), 6) AS ci FROM acf")
def brand_autocorrelation(m: Sales) -> DataFrame:
    return series.autocorrelation(_panel(m)).drop("_raw")


@query(ACF + """, q AS (SELECT series_key, l.lags, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q FROM acf CROSS JOIN (VALUES (4), (8)) l(lags) WHERE lag BETWEEN 1 AND l.lags GROUP BY 1, 2)
 SELECT series_key, lags, round(q, 6) AS stat, round(exp(-q / 2) * (1 + q / 2 + CASE WHEN lags = 8 THEN (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 ELSE 0 END), 6) AS p FROM q""")
def brand_ljung_box(m: Sales) -> DataFrame:
    return series.ljung_box(_panel(m))


@query(PANEL + """, e AS (SELECT series_key, t, y - avg(y) OVER (PARTITION BY series_key) AS e FROM panel), s AS (SELECT series_key, e, e * coalesce(lag(e) OVER (PARTITION BY series_key ORDER BY t), 0) AS c, sum(e) OVER (PARTITION BY series_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT series_key, round(sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + sum(c)) / count(*)), 6) AS stat FROM s GROUP BY 1""")
def brand_kpss(m: Sales) -> DataFrame:
    return series.kpss(_panel(m))


@query(PANEL + """, f AS (SELECT series_key, count(*) AS n, regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t) AS r, regr_syy(y, t) FILTER (t < 40) - (regr_sxy(y, t) FILTER (t < 40)) ** 2 / regr_sxx(y, t) FILTER (t < 40) AS r1, regr_syy(y, t) FILTER (t >= 40) - (regr_sxy(y, t) FILTER (t >= 40)) ** 2 / regr_sxx(y, t) FILTER (t >= 40) AS r2 FROM panel GROUP BY 1) SELECT series_key, round((r - r1 - r2) / 2 / ((r1 + r2) / (n - 4)), 6) AS stat FROM f""")
def brand_chow(m: Sales) -> DataFrame:
    return series.chow(_panel(m), 40)


@query(PANEL + " SELECT series_key, CAST(unnest(range(1, 7)) AS INTEGER) AS step, 'naive' AS model, f AS forecast FROM (SELECT series_key, arg_max(y, t) AS f FROM panel GROUP BY 1)")
def brand_naive_forecast(m: Sales) -> DataFrame:
    return forecast.naive(_panel(m), 6)


@query(PANEL + ", f AS (SELECT series_key, arg_max(y, t) AS b, arg_min(y, t) AS a, count(*) AS n FROM panel GROUP BY 1) SELECT series_key, step, 'drift' AS model, round(b + (b - a) / (n - 1) * step, 4) AS forecast FROM f CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)")
def brand_drift_forecast(m: Sales) -> DataFrame:
    return forecast.drift(_panel(m), 6).withColumn("forecast", F.round("forecast", 4))


@query(PANEL + """, d AS (SELECT series_key, t, y, y - lag(y) OVER (PARTITION BY series_key ORDER BY t) AS d FROM panel), l AS (SELECT *, lag(d) OVER (PARTITION BY series_key ORDER BY t) AS l FROM d), f AS (SELECT series_key, sum(d * l) / sum(l * l) AS phi, arg_max(y, t) AS b, arg_max(d, t) AS last FROM l GROUP BY 1) SELECT series_key, 1 AS step, 'difference_ar' AS model, round(b + last * phi, 4) AS forecast FROM f""")
def brand_difference_ar_forecast(m: Sales) -> DataFrame:
    return forecast.difference_ar(_panel(m), 1).withColumn("forecast", F.round("forecast", 4))


KPSS = PANEL + """, e AS (SELECT series_key, t, y - avg(y) OVER (PARTITION BY series_key) AS e, CAST(count(*) OVER (PARTITION BY series_key) AS DOUBLE) AS n FROM panel), v AS (SELECT a.series_key, a.t - b.t AS k, any_value(a.n) AS n, sum(a.e * b.e) AS v FROM e a JOIN e b ON a.series_key = b.series_key AND a.t >= b.t GROUP BY 1, 2),
 f AS (SELECT series_key, any_value(n) AS n, sum(v) FILTER (k = 0) AS ee, sum(v) FILTER (k = 0) / any_value(n) + coalesce(sum(2 * v / n) FILTER (k BETWEEN 1 AND floor(n ** (2.0 / 9))), 0) AS s0, coalesce(sum(k * 2 * v / n) FILTER (k BETWEEN 1 AND floor(n ** (2.0 / 9))), 0) AS s1 FROM v GROUP BY 1),
 l AS (SELECT series_key, n, ee, CAST(least(floor(1.1447 * ((s1 / s0) * (s1 / s0)) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1) AS INTEGER) AS lags FROM f), w AS (SELECT l.series_key, any_value(l.lags) AS lags, any_value(l.n) AS n, (any_value(ee) + coalesce(sum(2 * (1 - k / (lags + 1.0)) * v) FILTER (k BETWEEN 1 AND lags), 0)) / any_value(l.n) AS var FROM l JOIN v USING (series_key) GROUP BY 1),
 c AS (SELECT series_key, sum(s * s) AS ss FROM (SELECT series_key, sum(e) OVER (PARTITION BY series_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e) GROUP BY 1), x AS (SELECT series_key, lags, ss / (n * n) / var AS x FROM w JOIN c USING (series_key))
 SELECT series_key, lags, round(x, 6) AS stat, round(CASE WHEN x <= 0.347 THEN 0.1 WHEN x <= 0.463 THEN 0.1 - (x - 0.347) / 0.116 * 0.05 WHEN x <= 0.574 THEN 0.05 - (x - 0.463) / 0.111 * 0.025 WHEN x <= 0.739 THEN 0.025 - (x - 0.574) / 0.165 * 0.015 ELSE 0.01 END, 6) AS p FROM x"""


@query(KPSS)
def brand_kpss_automatic(m: Sales) -> DataFrame:
    return series.automatic_kpss(_panel(m))


HARMONIC = PANEL + """, h AS (SELECT series_key, t, y, CAST(t AS DOUBLE) AS x1, sin(2 * pi() * t / 12) AS x2, cos(2 * pi() * t / 12) AS x3 FROM panel), z AS (SELECT *, count(*) OVER k AS n, x1 - avg(x1) OVER k AS z1, x2 - avg(x2) OVER k AS z2, x3 - avg(x3) OVER k AS z3, y - avg(y) OVER k AS zy FROM h WINDOW k AS (PARTITION BY series_key)),
 s AS (SELECT series_key, any_value(n) AS n, PRODUCTS, sum(z1 * zy) AS c1, sum(z2 * zy) AS c2, sum(z3 * zy) AS c3, avg(x1) AS u1, avg(x2) AS u2, avg(x3) AS u3, avg(y) AS mean, sum(zy * zy) AS yy FROM z GROUP BY 1), d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) + a12 * (a13 * a23 - a12 * a33) + a13 * (a12 * a23 - a13 * a22) AS det, m11 * (m22 * m33 - m23 * m23) + m12 * (m13 * m23 - m12 * m33) + m13 * (m12 * m23 - m13 * m22) AS mdet FROM s),
 i AS (SELECT *, INVERSE FROM d), b AS (SELECT *, i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2, i13 * c1 + i23 * c2 + i33 * c3 AS b3 FROM i), r AS (SELECT z.*, b1 * z1 + b2 * z2 + b3 * z3 AS h, zy - (b1 * z1 + b2 * z2 + b3 * z3) AS e FROM z JOIN b USING (series_key))""".replace(
    "PRODUCTS", ", ".join(f"sum({x}{i} * {x}{j}) AS {a}{i}{j}" for x, a in (("z", "a"), ("x", "m")) for i, j in series.PAIRS)
).replace(
    "INVERSE", "(a22 * a33 - a23 * a23) / det AS i11, (a13 * a23 - a12 * a33) / det AS i12, (a12 * a23 - a13 * a22) / det AS i13, (a11 * a33 - a13 * a13) / det AS i22, (a12 * a13 - a11 * a23) / det AS i23, (a11 * a22 - a12 * a12) / det AS i33"
)


@query(HARMONIC + """, sq AS (SELECT *, e * e - avg(e * e) OVER (PARTITION BY series_key) AS q, h * h - avg(h * h) OVER (PARTITION BY series_key) AS w FROM r),
 k AS (SELECT series_key, sum(e * e) AS ee, sum(e * w) AS ew, sum(q * q) AS qq, sum(w * w) AS ww, sum(z1 * q) AS q1, sum(z2 * q) AS q2, sum(z3 * q) AS q3, sum(z1 * w) AS w1, sum(z2 * w) AS w2, sum(z3 * w) AS w3 FROM sq GROUP BY 1),
 o AS (SELECT b.*, k.* EXCLUDE (series_key), i11 * q1 * q1 + i22 * q2 * q2 + i33 * q3 * q3 + 2 * (i12 * q1 * q2 + i13 * q1 * q3 + i23 * q2 * q3) AS fq, ew * ew / (ww - (i11 * w1 * w1 + i22 * w2 * w2 + i33 * w3 * w3 + 2 * (i12 * w1 * w2 + i13 * w1 * w3 + i23 * w2 * w3))) AS dropped FROM b JOIN k USING (series_key) WHERE n >= 8 AND yy > 0)
 SELECT series_key, n, round(mean - b1 * u1 - b2 * u2 - b3 * u3, 2) AS const, round(b1, 2) AS trend, round(b2, 2) AS sin, round(b3, 2) AS cos, round(b1 / sqrt(ee / (n - 4) * i11), 6) AS trend_t, round(1 - ee / yy, 6) AS r2, round(1 - ee / yy * (n - 1) / (n - 4), 6) AS adj_r2, round((yy - ee) / 3 / (ee / (n - 4)), 6) AS f, round(n * fq / qq, 6) AS breusch_pagan, round(dropped / ((ee - dropped) / (n - 5)), 6) AS reset_f,
 round(m11 * (m22 * m33 - m23 * m23) / mdet, 6) AS vif_trend, round(m22 * (m11 * m33 - m13 * m13) / mdet, 6) AS vif_sin, round(m33 * (m11 * m22 - m12 * m12) / mdet, 6) AS vif_cos FROM o""")
def brand_regression(m: Sales) -> DataFrame:
    r = series.regression(_panel(m)).drop("const_t", "sin_t", "cos_t")
    return r.select("series_key", "n", *[F.round(c, 2 if c in ("const", "trend", "sin", "cos") else 6).alias(c) for c in r.columns[2:]])


# Residuals' moments as the population's; kurtosis counts 3 for a normal.
RESIDUAL_CHECKS = HARMONIC + """, f AS (SELECT series_key, e, e - lag(e) OVER (PARTITION BY series_key ORDER BY t) AS d, e - avg(e) OVER (PARTITION BY series_key) AS c FROM r), k AS (SELECT series_key, count(*) AS n, sum(d * d) / sum(e * e) AS dw, avg(c * c * c) / avg(c * c) ** 1.5 AS s, avg(c * c * c * c) / avg(c * c) ** 2 - 3 AS k FROM f GROUP BY 1), j AS (SELECT *, n / 6.0 * (s * s + k * k / 4) AS jb FROM k)
 SELECT series_key, round(dw, 6) AS durbin_watson, round(jb, 6) AS jarque_bera, round(exp(-jb / 2), 6) AS jb_p, round(s, 6) AS skew, round(k + 3, 6) AS kurtosis FROM j"""


def _eliminated(name: str, pivots: list[int]) -> str:
    """Tables after each step of Gaussian elimination of {name}0 (series_key, i, j, v); the last is {name}."""
    out, at = "", f"{name}0"
    for p in pivots:
        to = name if p == pivots[-1] else f"{name}_{p}"
        out += f""", {to} AS MATERIALIZED (SELECT x.series_key, x.i, x.j, CASE WHEN x.i > {p} AND w.v > 1e-10 * o.v THEN x.v - a.v * b.v / w.v WHEN x.i = {p} AND w.v <= 1e-10 * o.v THEN 0 ELSE x.v END AS v FROM {at} x
 LEFT JOIN {at} a ON a.series_key = x.series_key AND a.i = x.i AND a.j = {p} LEFT JOIN {at} b ON b.series_key = x.series_key AND b.i = {p} AND b.j = x.j LEFT JOIN {at} w ON w.series_key = x.series_key AND w.i = {p} AND w.j = {p} LEFT JOIN {name}0 o ON o.series_key = x.series_key AND o.i = {p} AND o.j = {p})"""
        at = to
    return out


def _normal_sql(x: str) -> str:
    odd = [1.0]
    for k in range(1, series.NORMAL_TERMS):
        odd.append(odd[-1] / (2 * k + 1))
    terms = repr(odd[-1])
    for c in reversed(odd[:-1]):
        terms = f"({c!r} + {x} * {x} * {terms})"
    return f"CASE WHEN {x} < -7 THEN 0 WHEN {x} > 7 THEN 1 ELSE 0.5 + {x} * {terms} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) END"


def _power_sql(c: tuple[float, ...], x: str) -> str:
    return "(" + " + ".join(f"{v!r} * {x} ** {k}" if k else repr(v) for k, v in enumerate(c)) + ")"


#: Lags that the SQL of the unit-root statistic has room for, which are those of 300 months.
_LAGS = 16
UNIT_ROOTS = (
    PANEL + """, ds AS (SELECT series_key, t, e, lead(e) OVER (PARTITION BY series_key ORDER BY t) - e AS d, n, CAST(least(ceil(12 * (n / 100.0) ** 0.25), n // 2 - 2) AS INTEGER) AS most FROM (SELECT series_key, t, y - avg(y) OVER k AS e, count(*) OVER k AS n, max(y) OVER k > min(y) OVER k AS unlike FROM panel WINDOW k AS (PARTITION BY series_key)) WHERE unlike AND n >= 10),
 lagged AS (SELECT a.series_key, a.t, a.t - b.t AS k, b.d FROM ds a JOIN ds b ON a.series_key = b.series_key AND b.t < a.t AND a.t - b.t <= a.most WHERE a.d IS NOT NULL),
 x1 AS (SELECT series_key, t, 0 AS i, CAST(1 AS DOUBLE) AS v FROM ds WHERE d IS NOT NULL AND t > most UNION ALL SELECT series_key, t, 1, e FROM ds WHERE d IS NOT NULL AND t > most UNION ALL SELECT series_key, t, 99, d FROM ds WHERE d IS NOT NULL AND t > most UNION ALL SELECT l.series_key, l.t, 1 + k, l.d FROM lagged l JOIN ds USING (series_key, t) WHERE t > most),
 u0 AS MATERIALIZED (SELECT a.series_key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM x1 a JOIN x1 b USING (series_key, t) GROUP BY 1, 2, 3)"""
    + _eliminated("u", list(range(_LAGS + 2)))
    + """, took AS (SELECT a.series_key, a.i, CASE WHEN a.v > 0 THEN b.v * b.v / a.v ELSE 0 END AS v FROM u a JOIN u b ON a.series_key = b.series_key AND a.i = b.i AND a.j = a.i AND b.j = 99 WHERE a.i < 99),
 nn AS (SELECT series_key, any_value(most) AS most, count(*) FILTER (d IS NOT NULL AND t > most) AS n FROM ds GROUP BY 1), sc AS (SELECT nn.series_key, k.k, any_value(nn.n) * ln((any_value(z.v) - sum(took.v)) / any_value(nn.n)) + 2 * k.k AS aic FROM nn JOIN (SELECT unnest(range(0, 17)) AS k) k ON k.k <= nn.most JOIN took ON took.series_key = nn.series_key AND took.i <= k.k + 1 JOIN u0 z ON z.series_key = nn.series_key AND z.i = 99 AND z.j = 99 GROUP BY 1, 2),
 best AS MATERIALIZED (SELECT series_key, arg_min(k, {'a': aic, 'k': k}) AS lags FROM sc GROUP BY 1),
 x2 AS (SELECT series_key, t, 0 AS i, CAST(1 AS DOUBLE) AS v FROM ds JOIN best USING (series_key) WHERE d IS NOT NULL AND t > lags UNION ALL SELECT series_key, t, 98, e FROM ds JOIN best USING (series_key) WHERE d IS NOT NULL AND t > lags UNION ALL SELECT series_key, t, 99, d FROM ds JOIN best USING (series_key) WHERE d IS NOT NULL AND t > lags UNION ALL SELECT series_key, t, k, d FROM lagged JOIN best USING (series_key) WHERE t > lags AND k <= lags),
 w0 AS MATERIALIZED (SELECT a.series_key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM x2 a JOIN x2 b USING (series_key, t) GROUP BY 1, 2, 3)"""
    + _eliminated("w", [*range(_LAGS + 1), 98])
    + """, rest AS (SELECT a.series_key, any_value(z.v) - sum(CASE WHEN a.v > 0 THEN b.v * b.v / a.v ELSE 0 END) AS rest FROM w a JOIN w b ON a.series_key = b.series_key AND a.i = b.i AND a.j = a.i AND b.j = 99 JOIN w0 z ON z.series_key = a.series_key AND z.i = 99 AND z.j = 99 WHERE a.i < 99 GROUP BY 1),
 st AS (SELECT best.series_key, lags, (SELECT count(*) FROM ds WHERE ds.series_key = best.series_key AND d IS NOT NULL) - lags AS used, b.v / sqrt(a.v * rest / ((SELECT count(*) FROM ds WHERE ds.series_key = best.series_key AND d IS NOT NULL) - lags - lags - 2)) AS x FROM best JOIN rest USING (series_key) JOIN w a ON a.series_key = best.series_key AND a.i = 98 AND a.j = 98 JOIN w b ON b.series_key = best.series_key AND b.i = 98 AND b.j = 99),
 sx AS (SELECT *, 1.0 / used AS inv, CASE WHEN x <= """ + repr(series.UNIT_ROOT_BORDER) + " THEN " + _power_sql(series.UNIT_ROOT_BELOW, "x") + " ELSE " + _power_sql(series.UNIT_ROOT_ABOVE, "x") + " END AS q FROM st) SELECT series_key, round(x, 6) AS stat, CAST(lags AS INTEGER) AS lags, round(CASE WHEN x > 2.74 THEN 1 WHEN x < -18.83 THEN 0 ELSE " + _normal_sql("q") + " END, 6) AS p, "
    + ", ".join(f"round({_power_sql(c, 'inv')}, 6) AS {n}" for n, c in zip(("one_pct", "five_pct", "ten_pct"), series.UNIT_ROOT_POINTS.values(), strict=True)) + " FROM sx"
)


@query(UNIT_ROOTS)
def brand_unit_roots(m: Sales) -> DataFrame:
    r = series.unit_roots(_panel(m))
    return r.select("series_key", F.round("stat", 6).alias("stat"), "lags", *[F.round(c, 6).alias(c) for c in ("p", "one_pct", "five_pct", "ten_pct")])


_WHITE_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
WHITE = (
    HARMONIC + ", sq AS (SELECT series_key, t, e * e - avg(e * e) OVER (PARTITION BY series_key) AS y, CAST(1 AS DOUBLE) AS x0, x1, x2, x3 FROM r WHERE n >= 10), wx AS (" + " UNION ALL ".join([f"SELECT series_key, t, {k} AS i, x{i} * x{j} AS v FROM sq" for k, (i, j) in enumerate(_WHITE_PAIRS)] + ["SELECT series_key, t, 99, y FROM sq"])
    + "), v0 AS MATERIALIZED (SELECT a.series_key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM wx a JOIN wx b USING (series_key, t) GROUP BY 1, 2, 3)" + _eliminated("v", list(range(len(_WHITE_PAIRS))))
    + """, wt AS (SELECT a.series_key, CAST(count(*) FILTER (a.v > 0) - 1 AS INTEGER) AS df, sum(CASE WHEN a.v > 0 THEN b.v * b.v / a.v ELSE 0 END) AS took FROM v a JOIN v b ON a.series_key = b.series_key AND a.i = b.i AND a.j = a.i AND b.j = 99 WHERE a.i < 99 GROUP BY 1),
 wq AS (SELECT series_key, df, (SELECT count(*) FROM sq WHERE sq.series_key = wt.series_key) AS n, took / z.v AS r2 FROM wt JOIN v0 z USING (series_key) WHERE z.i = 99 AND z.j = 99), ws AS (SELECT series_key, df, n * r2 / 2 AS h FROM wq WHERE n > df + 1)
 SELECT series_key, round(2 * h, 6) AS stat, df, round(exp(-h) * (1 + h + h ** 2 / 2 + h ** 3 / 6), 6) AS p FROM ws"""
)


@query(WHITE)
def brand_white(m: Sales) -> DataFrame:
    return series.white(_panel(m)).select("series_key", F.round("stat", 6).alias("stat"), "df", F.round("p", 6).alias("p"))


@query()
def brand_diagnostics(m: Sales) -> DataFrame:
    return series.diagnostics(_panel(m))


@query(RESIDUAL_CHECKS)
def brand_residual_checks(m: Sales) -> DataFrame:
    return series.residual_checks(series.residuals(_panel(m)))


@query(PANEL + """, w AS (SELECT series_key, t, y, count(*) OVER f AS c, sum(y) OVER f AS a, sum(y) OVER i AS b, count(*) OVER (PARTITION BY series_key) AS n FROM panel WINDOW f AS (PARTITION BY series_key ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), i AS (PARTITION BY series_key ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), tr AS (SELECT series_key, t, y, t % 12 AS m, CASE WHEN c = 13 THEN ((a - b) / 2 + b) / 12 END AS trend FROM w WHERE n >= 24),
 s AS (SELECT *, avg(y - trend) OVER (PARTITION BY series_key, m) AS s FROM tr), mm AS (SELECT series_key, avg(x) AS a FROM (SELECT series_key, m, any_value(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1) SELECT s.series_key, CAST(t AS INTEGER) AS t, y, round(trend, 4) AS trend, round(s.s - mm.a, 4) AS seasonal, round(y - trend - s.s + mm.a, 4) AS resid FROM s JOIN mm USING (series_key)""")
def brand_decomposition(m: Sales) -> DataFrame:
    return series.decompose(_panel(m))


@query(PANEL + """, d AS (SELECT series_key, t, y, y - lag(y) OVER (PARTITION BY series_key ORDER BY t) AS d FROM panel), l AS (SELECT *, lag(d) OVER (PARTITION BY series_key ORDER BY t) AS l FROM d), f AS (SELECT series_key, sum(d * l) / sum(l * l) FILTER (d IS NOT NULL) AS phi, arg_max(y, t) AS b, arg_max(d, t) AS last FROM l GROUP BY 1)
 SELECT series_key, step, 'difference_ar' AS model, round(b + last * list_sum(list_transform(range(1, step + 1), lambda k: phi ** k)), 4) AS forecast FROM f CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)""")
def brand_difference_ar_six_steps(m: Sales) -> DataFrame:
    return forecast.difference_ar(_panel(m), 6).withColumn("forecast", F.round("forecast", 4))


def _whole_and_brands(m: Sales) -> DataFrame:
    """The brands' panel and the series of all lines."""
    return _panel(m, None).unionByName(_panel(m))


def _model_errors(m: Sales, key: str) -> DataFrame:
    return forecast.model_errors(series.panel_rows(m.sold, key, "month", "line_total"))


def _model_errors_of_brands(m: Sales) -> DataFrame:
    return forecast.model_errors(forecast.in_rows(_whole_and_brands(m)))


def _panel_sql(key: str) -> str:
    return PANEL.replace("brand", key)


def _expanding_sql(key: str) -> str:
    """Every origin's fit of its own months, joined to them: naive, drift, differences' autoregression, trend and harmonic."""
    pairs = series.PAIRS
    names = {i: f"x{i}" for i in (1, 2, 3)}
    return _panel_sql(key) + f""", h AS (SELECT series_key, t, y, CAST(t AS DOUBLE) AS x1, sin(2 * pi() * t / 12) AS x2, cos(2 * pi() * t / 12) AS x3, y - lag(y) OVER k AS d, lag(y) OVER k AS y1, first(y) OVER k AS y0 FROM panel WINDOW k AS (PARTITION BY series_key ORDER BY t)), gd AS (SELECT *, lag(d) OVER (PARTITION BY series_key ORDER BY t) AS l FROM h),
 o AS (SELECT f.series_key, f.t, any_value(f.y) AS actual, any_value(f.y1) AS y1, any_value(f.y0) AS y0, any_value(f.l) AS l, count(*) AS n, avg(g.y) AS my, {", ".join(f"any_value(f.{x}) - avg(g.{x}) AS z{i}" for i, x in names.items())}, {", ".join(f"covar_pop(g.{names[i]}, g.{names[j]}) AS a{i}{j}" for i, j in pairs)}, {", ".join(f"covar_pop(g.{x}, g.y) AS c{i}" for i, x in names.items())}, sum(g.d * g.l) AS dl, sum(g.l * g.l) FILTER (g.d IS NOT NULL) AS ll FROM gd f JOIN gd g ON g.series_key = f.series_key AND g.t < f.t WHERE f.t > 10 GROUP BY 1, 2),
 v AS (SELECT *, a11 * (a22 * a33 - a23 * a23) + a12 * (a13 * a23 - a12 * a33) + a13 * (a12 * a23 - a13 * a22) AS det FROM o), w AS (SELECT *, (a22 * a33 - a23 * a23) / det AS i11, (a13 * a23 - a12 * a33) / det AS i12, (a12 * a23 - a13 * a22) / det AS i13, (a11 * a33 - a13 * a13) / det AS i22, (a12 * a13 - a11 * a23) / det AS i23, (a11 * a22 - a12 * a12) / det AS i33 FROM v),
 fc AS (SELECT series_key, t, actual, unnest([{{'m': 'naive', 'f': y1}}, {{'m': 'drift', 'f': y1 + (y1 - y0) / (n - 1)}}, {{'m': 'difference_ar', 'f': y1 + CASE WHEN ll > 0 THEN dl / ll ELSE 0 END * l}}, {{'m': 'fourier', 'f': my + c1 * (i11 * z1 + i12 * z2 + i13 * z3) + c2 * (i12 * z1 + i22 * z2 + i23 * z3) + c3 * (i13 * z1 + i23 * z2 + i33 * z3)}}]) AS r FROM w),
 e AS (SELECT series_key, r.m AS model, actual AS a, r.f AS f FROM fc), er AS (SELECT series_key, model, round(sqrt(avg((a - f) * (a - f))), 3) AS rmse, round(avg(abs(a - f)), 3) AS mae, round(avg(CASE WHEN a <> 0 THEN abs(a - f) / abs(a) END) * 100, 3) AS mape, round(avg(CASE WHEN abs(a) + abs(f) > 0 THEN 2 * abs(a - f) / (abs(a) + abs(f)) ELSE 0 END) * 100, 3) AS smape, count(*) AS folds FROM e GROUP BY 1, 2)"""


def _expanding_errors(m: Sales, key: str) -> DataFrame:
    return forecast.errors(forecast.expanding(_panel(m, key)), 3)


_CHOICE = " SELECT series_key, arg_min(model, {'r': rmse, 'm': model}) AS winner, arg_min(model, {'r': rmse, 'm': model}) AS model FROM er GROUP BY 1"


@query(_expanding_sql("brand") + " SELECT * FROM er")
def brand_expanding_errors(m: Sales) -> DataFrame:
    return _expanding_errors(m, "brand")


@query(_expanding_sql("brand") + _CHOICE)
def brand_expanding_choice(m: Sales) -> DataFrame:
    return forecast.choose(_expanding_errors(m, "brand"))


@query(_expanding_sql("customer_code") + " SELECT * FROM er")
def customer_expanding_errors(m: Sales) -> DataFrame:
    return _expanding_errors(m, "customer_code")


@query(_expanding_sql("customer_code") + _CHOICE)
def customer_expanding_choice(m: Sales) -> DataFrame:
    return forecast.choose(_expanding_errors(m, "customer_code"))


@query(_expanding_sql("item_code") + " SELECT * FROM er")
def item_expanding_errors(m: Sales) -> DataFrame:
    return _expanding_errors(m, "item_code")


@query(_expanding_sql("item_code") + _CHOICE)
def item_expanding_choice(m: Sales) -> DataFrame:
    return forecast.choose(_expanding_errors(m, "item_code"))


@query()
def model_errors(m: Sales) -> DataFrame:
    return _model_errors_of_brands(m)


@query()
def model_choice(m: Sales) -> DataFrame:
    return forecast.choose(_model_errors_of_brands(m))


@query()
def model_information(m: Sales) -> DataFrame:
    return forecast.information(_whole_and_brands(m))


@query()
def customer_model_errors(m: Sales) -> DataFrame:
    return _model_errors(m, "customer_code")


@query()
def customer_model_choice(m: Sales) -> DataFrame:
    return forecast.choose(_model_errors(m, "customer_code"))


@query()
def customer_model_information(m: Sales) -> DataFrame:
    return forecast.information(_panel(m, "customer_code"))


@query()
def item_model_errors(m: Sales) -> DataFrame:
    return _model_errors(m, "item_code")


@query()
def item_model_choice(m: Sales) -> DataFrame:
    return forecast.choose(_model_errors(m, "item_code"))


@query()
def item_model_information(m: Sales) -> DataFrame:
    return forecast.information(_panel(m, "item_code"))


@query()
def brand_panel_forecast(m: Sales) -> DataFrame:
    return forecast.panel_forecast(_panel(m))


@query()
def customer_panel_forecast(m: Sales) -> DataFrame:
    return forecast.panel_forecast(_panel(m, "customer_code"))


@query()
def item_panel_forecast(m: Sales) -> DataFrame:
    return forecast.panel_forecast(_panel(m, "item_code"))


@query(OVERDUE + _pareto("customer_code").replace(" p AS", " pp AS").replace("FROM p)", "FROM pp)") + """, facts AS (SELECT 'top10_share' AS fact, round(round(sum(value) FILTER (rank <= 10) / sum(value) * 100, 4) / 100, 6) AS value FROM r UNION ALL SELECT 'overdue_share', round(sum(overdue) / sum(balance), 6) FROM od UNION ALL SELECT 'customers_to_80pct', CAST(count(*) FILTER (cum_value - value < 0.8 * whole) AS DOUBLE) FROM r)
 SELECT fact, value, CASE WHEN (fact = 'top10_share' AND value > 0.5) OR (fact = 'overdue_share' AND value > 0.4) THEN 'high' WHEN fact = 'overdue_share' AND value > 0.1 THEN 'medium' ELSE 'info' END AS priority FROM facts""")
def insight_facts(m: Sales) -> DataFrame:
    return finance.insight_facts(m.sold, receivables.overdue(_fifo(m), AS_OF))


@query(" SELECT customer_code, round(greatest(0, least(1, CAST(sum(paid) AS DOUBLE) / CAST(sum(reported_total) AS DOUBLE))), 6) AS paid_rate FROM headers GROUP BY 1")
def paid_rates(m: Sales) -> DataFrame:
    return m.headers.groupBy("customer_code").agg(F.round(clip(ratio(F.sum("paid"), F.sum("reported_total"))), 6).alias("paid_rate"))


# Operators of names, codes and lookups, and totals by further keys


@query(" SELECT item_code, round(sum(unit_price * greatest(CAST(qty AS DOUBLE), 0.01)) / sum(greatest(CAST(qty AS DOUBLE), 0.01)), 6) AS weighted_mean FROM lines GROUP BY 1")
def weighted_prices(m: Sales) -> DataFrame:
    return sales.weighted_mean(m.rows, "unit_price", "qty", 0.01, ("item_code",))


@query(""", n AS (SELECT brand, item_name, sum(line_total) AS s FROM lines GROUP BY 1, 2) SELECT brand, item_name FROM n QUALIFY row_number() OVER (PARTITION BY brand ORDER BY length(item_name), s DESC, item_name) = 1""")
def shortest_names(m: Sales) -> DataFrame:
    return sales.shortest_name(m.goods, "brand", "item_name")


@query(" SELECT rep, CAST(sum(net) AS DOUBLE) AS balance, arg_min(customer_name, customer_code) AS name FROM customers GROUP BY 1")
def merged_balances(m: Sales) -> DataFrame:
    found = receivables.merged_balances(m.customers.select("rep", "customer_code", F.col("net").alias("balance"), F.col("customer_name").alias("name")), "rep", "customer_code")
    return found.select("rep", F.col("balance").cast("double").alias("balance"), "name")


@query(" SELECT DISTINCT h.customer_code FROM headers h JOIN customers c ON h.customer_code = c.customer_code WHERE rep = 'NATION_3'")
def customers_without_rep(m: Sales) -> DataFrame:
    return attribution.without_rep(m.headers, m.customers.withColumn("rep", F.when(F.col("rep") != "NATION_3", F.col("rep"))))


@query(" SELECT customer_code, CASE WHEN city = 'ASIA' THEN rep ELSE 'elsewhere' END AS rep FROM customers")
def looked_up_reps(m: Sales) -> DataFrame:
    return attribution.lookup(m.customers.select("customer_code"), "customer_code", m.customers.filter("city = 'ASIA'"), "rep", "elsewhere")


@query(" SELECT customer_code, CASE WHEN net > 0 THEN rep ELSE city END AS rep FROM customers WHERE net > 0 OR net < -100000")
def reps_by_priority(m: Sales) -> DataFrame:
    return attribution.by_priority([m.customers.filter("net > 0").select("customer_code", "rep"), m.customers.filter("net > 0 OR net < -100000").select("customer_code", F.col("city").alias("rep"))], "customer_code", "rep")


@query(" SELECT CASE CAST(n_nationkey AS VARCHAR) WHEN '3' THEN 'three' WHEN '1' THEN '2' ELSE CAST(n_nationkey AS VARCHAR) END AS code, n_name FROM nation")
def canonical_codes(m: Sales) -> DataFrame:
    messy = m.table("nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(",")).alias("code"), "n_name")
    aliases = m.table("nation").filter("n_nationkey IN (1, 3)").select(F.col("n_nationkey").cast("string").alias("alias"), F.when(F.col("n_nationkey") == 3, "three").otherwise("2").alias("code"))
    return attribution.canonical_codes(messy, "code", aliases)


@query(" SELECT item_code, CASE WHEN brand = 'Brand#11' THEN 'house brand' ELSE brand END AS brand, count(*) AS n FROM lines GROUP BY 1, 2")
def overridden_brands(m: Sales) -> DataFrame:
    known = m.table("part").filter("p_brand = 'Brand#11'").select(F.col("p_brand").alias("key"), F.lit("house brand").alias("value")).distinct()
    return attribution.overridden(m.goods, "brand", "brand", known).groupBy("item_code", "brand").agg(F.count("*").alias("n"))


@query(" SELECT invoice_no, CAST(remaining AS DOUBLE) AS remaining FROM headers WHERE remaining = 0")
def zero_invoices(m: Sales) -> DataFrame:
    return quality.zero_invoices(m.headers.withColumn("reported_total", F.col("remaining"))).select("invoice_no", F.col("remaining").cast("double").alias("remaining"))


@query(MONTHLY + " SELECT month, revenue, CAST(row_number() OVER (ORDER BY revenue DESC, month) AS INTEGER) AS place FROM m")
def months_by_revenue(m: Sales) -> DataFrame:
    months = sales.monthly_series(m.dealt).select("month", "revenue")
    placed = months.withColumn("place", F.row_number().over(W.orderBy(F.desc("revenue"), "month")))  # a few hundred months at most
    return sales.sorted_by(placed, "revenue", tie="month")


@query(MONTHLY + " SELECT month, revenue, 'actual' AS kind FROM m UNION ALL SELECT month, revenue, 'forecast' FROM m WHERE month = (SELECT max(month) FROM m) UNION ALL SELECT 'next', (SELECT revenue FROM m ORDER BY month DESC LIMIT 1), 'forecast'")
def spliced_forecast(m: Sales) -> DataFrame:
    actual = sales.monthly_series(m.dealt).select("month", "revenue")
    ahead = forecast.naive(_panel(m, None), 1).select(F.lit("next").alias("month"), F.col("forecast").alias("revenue"))
    return sales.spliced(actual, ahead, "month", "revenue")


@query(PANEL + """, s AS (SELECT series_key, stddev_pop(y) AS sigma, arg_max(y, t) AS f FROM panel GROUP BY 1) SELECT series_key, step, f AS base, round(greatest(0, f - 1.96 * sigma * sqrt(step)), 4) AS lower, round(f + 1.96 * sigma * sqrt(step), 4) AS upper FROM s CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)""")
def brand_scenarios(m: Sales) -> DataFrame:
    sigma = _panel(m).groupBy("series_key").agg(F.stddev_pop("y").alias("sigma"))
    return forecast.scenarios(forecast.naive(_panel(m), 6), sigma).select("series_key", "step", "base", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query(" SELECT invoice_no, CAST(reported_total AS DOUBLE) AS lenient, -CAST(reported_total AS DOUBLE) AS negated, CAST(NULL AS DOUBLE) AS none, CAST(0 AS DOUBLE) AS zero, invoice_date AS slashed, invoice_date AS turned FROM headers")
def parsed_texts(m: Sales) -> DataFrame:
    money, day = F.format_number(F.col("reported_total").cast("double"), 2), F.col("invoice_date")
    return m.headers.withColumn("text", F.lit("no number")).select(
        "invoice_no", parse_number(F.concat(F.lit(" "), money)).cast("double").alias("lenient"), parse_number_or_zero(F.concat(money, F.lit("-"))).cast("double").alias("negated"), parse_number(F.lit("n/a")).cast("double").alias("none"), to_numbers(["text"])["text"].alias("zero"),
        parse_date(F.date_format(day, "yyyy/M/d")).alias("slashed"), parse_date(F.date_format(day, "d/M/yyyy")).alias("turned"),
    )


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@query(" SELECT strftime(min(invoice_date), '%b %Y') AS label, count(*) AS n FROM headers GROUP BY month")
def labelled_months(m: Sales) -> DataFrame:
    return m.headers.groupBy(month_label(F.col("month"), MONTHS).alias("label")).agg(F.count("*").alias("n"))


@query(" SELECT customer_code, customer_name AS shown, customer_name <> '' AS usable, false AS digits_usable FROM customers")
def shown_names(m: Sales) -> DataFrame:
    return m.customers.select("customer_code", display_name(F.concat(F.lit("  "), "customer_name", F.lit(" "))).alias("shown"), usable_name(F.col("customer_name")).alias("usable"), usable_name(F.concat("customer_code", F.lit(" 12"))).alias("digits_usable"))


@query(""" SELECT event_type AS method, strftime(ts, '%Y-%m') AS month, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS amount, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL""")
def receipts_by_method(m: Sales) -> DataFrame:
    both = m.receipts.unionByName(m.returns.drop("value"))
    return both.groupBy("method", "month").agg(sales.total("amount").alias("amount"), F.count("*").alias("n"))


@query(ATTR + " SELECT customer_code, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM att GROUP BY 1")
def receipts_by_customer(m: Sales) -> DataFrame:
    return attribution.summed(_attributed(m), "customer_code")


@query(ATTR + " SELECT month, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM att GROUP BY 1")
def receipts_by_month(m: Sales) -> DataFrame:
    return attribution.summed(_attributed(m), "month")


@query(RATES + " SELECT CASE WHEN rate >= 0.9 THEN 'good' WHEN rate >= 0.7 THEN 'fair' ELSE 'poor' END AS class, count(*) AS n FROM rates GROUP BY 1")
def rate_classes(m: Sales) -> DataFrame:
    return _rates(m).groupBy(rate_class(F.col("rate")).alias("class")).agg(F.count("*").alias("n"))


@query(XYZ + _pareto("item_code") + " SELECT item_code, CAST(rank AS INTEGER) AS rank, cv, round(sqrt(greatest(round(value / whole * 100, 6), 0)), 6) AS size FROM r JOIN z USING (item_code)")
def rank_against_variation(m: Sales) -> DataFrame:
    return sales.places_and_variation(m.sold, m.items, "item_code")


@query(""" SELECT h.customer_code, coalesce(CAST(sum(reported_total) FILTER (reported_total <> 0) AS DOUBLE), 0) AS sales, count(*) AS n_invoices, count(*) FILTER (coalesce(reported_total, 0) = 0) AS n_zero, any_value(customer_name) AS customer_name, round(count(*) FILTER (coalesce(reported_total, 0) = 0) / count(*) * 100, 6) AS zero_pct,
 coalesce(any_value(b.qty), 0) AS qty, coalesce(any_value(b.free), 0) AS bonus_qty, round(any_value(b.free) / nullif(any_value(b.qty), 0) * 100, 6) AS bonus_pct FROM headers h JOIN customers c ON h.customer_code = c.customer_code LEFT JOIN (SELECT customer_code, CAST(sum(qty) AS DOUBLE) AS qty, coalesce(CAST(sum(qty) FILTER (is_bonus) AS DOUBLE), 0) AS free FROM lines GROUP BY 1) b ON b.customer_code = h.customer_code GROUP BY 1""")
def customer_summary_with_bonus(m: Sales) -> DataFrame:
    return sales.bonus_summary(sales.customer_summary(m.headers, m.customers), m.sold)


@query(" SELECT count(*) FILTER (is_bonus AND unit_price = 0 AND qty > 0) AS n_with_qty, count(*) FILTER (is_bonus AND unit_price = 0) AS n_free, coalesce(CAST(sum(qty) FILTER (is_bonus AND unit_price = 0) AS DOUBLE), 0) AS free_qty FROM lines")
def bonus_counts(m: Sales) -> DataFrame:
    return quality.bonus_counts(m.rows)


@query(" SELECT (SELECT count(*) FROM lines WHERE invoice_date BETWEEN DATE '1998-03-15' AND DATE '1998-06-20') AS n_lines, count(*) AS n_invoices, CAST(sum(reported_total) AS DOUBLE) AS sales, (SELECT CAST(sum(net) AS DOUBLE) FROM customers) AS balance FROM headers WHERE invoice_date BETWEEN DATE '1998-03-15' AND DATE '1998-06-20'")
def period_totals(m: Sales) -> DataFrame:
    """Of a period, with balances as they are: those are of one day."""
    lines, headers = sales.in_period(m.rows, m.headers, "1998-03-15", "1998-06-20")
    return lines.agg(F.count("*").alias("n_lines")).crossJoin(headers.agg(F.count("*").alias("n_invoices"), sales.total("reported_total").alias("sales"))).crossJoin(m.customers.agg(sales.total("net").alias("balance")))


@query(OVERDUE + """, k AS (SELECT (SELECT CAST(sum(reported_total) AS DOUBLE) FROM headers) AS sales, (SELECT CAST(sum(amount) AS DOUBLE) FROM receipts) AS received, round(sum(overdue), 2) AS overdue, round(sum(balance), 2) AS balance FROM od) SELECT sales, overdue, balance, received, round(greatest(0, least(1, received / sales)), 6) AS collection_rate, 'actual' AS basis FROM k""")
def portfolio_collection(m: Sales) -> DataFrame:
    return finance.portfolio_collection(m.headers, receivables.overdue(_fifo(m), AS_OF), m.receipts)


@query(ARREARS + """, s AS (SELECT customer_code, CAST(sum(reported_total) AS DOUBLE) AS sales, count(DISTINCT invoice_no) AS n_invoices FROM headers GROUP BY 1), u AS (SELECT customer_code, CAST(sum(qty) AS DOUBLE) AS qty, coalesce(CAST(sum(qty) FILTER (is_bonus) AS DOUBLE), 0) AS bonus_qty FROM lines GROUP BY 1)
 SELECT customer_code, customer_name, c.rep, coalesce(sales, 0) AS sales, coalesce(n_invoices, 0) AS n_invoices, coalesce(qty, 0) AS qty, coalesce(bonus_qty, 0) AS bonus_qty, coalesce(debt, 0) AS debt, coalesce(credit_balance, 0) AS credit_balance, coalesce(current_amount, 0) AS current_amount, coalesce(arrears_amount, 0) AS arrears_amount, round(bonus_qty / nullif(qty, 0) * 100, 6) AS bonus_pct
 FROM s LEFT JOIN u USING (customer_code) FULL JOIN arrears USING (customer_code) LEFT JOIN customers c USING (customer_code)""")
def customer_360_table(m: Sales) -> DataFrame:
    return receivables.customer_360_table(m.headers, m.sold, m.customers, receivables.arrears(m.customers, m.headers, AS_OF))


# Reports and bundles

_REPORT_COLUMNS = ["invoice_no", "item_code", "customer_code", "qty", "unit_price"]
_REPORT = {("rows", "lines"): "count(*)"} | {("missing", c): f"count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')" for c in _REPORT_COLUMNS} | {
    ("lines", "negative"): "count(*) FILTER (qty < 0)", ("lines", "zero"): "count(*) FILTER (line_total = 0)", ("lines", "free"): "count(*) FILTER (is_bonus)", ("lines", "free_priced"): "count(*) FILTER (is_bonus AND unit_price > 0)",
    ("lines", "high_price"): "count(*) FILTER (unit_price > 1500)", ("lines", "high_qty"): "count(*) FILTER (qty > 49)", ("share", "free"): "count(*) FILTER (is_bonus) / count(*)", ("residual", "mean"): "avg(r)", ("residual", "max"): "max(r)", ("residual", "within_1"): "count(*) FILTER (r <= 1) / count(*)",
} | {(n, c): f"{f}({c})" for c in ("qty", "line_total", "disc", "tax") for n, f in (("least", "min"), ("most", "max"))}


@query(", x AS (SELECT *, abs(CAST(line_total AS DOUBLE) - CAST(qty AS DOUBLE) * unit_price * (1 - CAST(disc AS DOUBLE)) * (1 - CAST(tax AS DOUBLE))) AS r FROM lines) " + " UNION ALL ".join(f"SELECT '{a}' AS \"check\", '{b}' AS dimension, round(CAST({v} AS DOUBLE), 6) AS value FROM x" for (a, b), v in _REPORT.items()))
def quality_report(m: Sales) -> DataFrame:
    return quality.report(m.sold, _REPORT_COLUMNS, price=1500, qty=49)


_BUNDLE_KEYS = ("brand", "item_code", "rep", "customer_code")


@query(" SELECT " + "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in _BUNDLE_KEYS) + " ELSE 'totals' END AS \"table\", CASE WHEN grouping(month) = 0 THEN month ELSE 'all' END AS month, CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN {k}" for k in _BUNDLE_KEYS) + " ELSE '' END AS key, CAST(sum(line_total) AS DOUBLE) AS sales, CAST(sum(qty) AS DOUBLE) AS qty, count(*) AS n_lines, count(*) FILTER (is_bonus) AS n_free FROM lines GROUP BY GROUPING SETS (" + ", ".join(f"(month, {k}), ({k})" for k in _BUNDLE_KEYS) + ", (month), ())")
def bundle_tables(m: Sales) -> DataFrame:
    return sales.bundle_tables(m.lines)


# Files written and read back


def _invoice_rows(m: Sales) -> DataFrame:
    """Lines as an invoice text has them; those without tax leave the second rate out."""
    return m.lines.join(m.headers.select("invoice_no", "reported_total"), "invoice_no").select("invoice_no", "invoice_date", "customer_code", "customer_name", "reported_total", "seq", "item_code", "item_name", F.lit("box").alias("unit"), "qty", F.col("gross").alias("unit_price"), F.col("disc").alias("discount_pct"), F.when(F.col("tax") > 0, F.col("tax")).alias("tax_pct"), F.col("line_total").cast("decimal(18,4)").alias("line_total"))


def _read_back(m: Sales, texts: DataFrame) -> DataFrame:
    path = sinks.scratch(m.spark)
    sinks.write_blocks(texts, path)
    return readers.read_blocks(m.spark, path)


_NUMBERS = ("qty", "unit_price", "discount_pct", "tax_pct", "line_total", "invoice_reported_total")
_AS_READ = "CAST(l.qty AS DOUBLE) AS qty, CAST(gross AS DOUBLE) AS unit_price, CAST(disc AS DOUBLE) AS discount_pct, {tax} AS tax_pct, CAST(round(CAST(line_total AS DECIMAL(20,6)), 4) AS DOUBLE) AS line_total, CAST(h.reported_total AS DOUBLE) AS invoice_reported_total FROM lines l JOIN headers h USING (invoice_no)"


def _as_read(found: DataFrame, *names: str) -> DataFrame:
    return found.select(*names, *[F.col(c).cast("double").alias(c) for c in _NUMBERS])


@query(" SELECT CAST(invoice_no AS VARCHAR) AS invoice_no, l.invoice_date, l.customer_code, l.customer_name, CAST(seq AS INTEGER) AS seq, item_code, item_name, " + _AS_READ.format(tax="CASE WHEN tax > 0 THEN CAST(tax AS DOUBLE) END"))
def fenced_texts_read_back(m: Sales) -> DataFrame:
    blocks = _read_back(m, sinks.fenced_texts(_invoice_rows(m)))
    return _as_read(readers.fenced_invoices(blocks, least_numbers=4), "invoice_no", "invoice_date", "customer_code", "customer_name", "seq", "item_code", "item_name")


@query(" SELECT CAST(invoice_no AS VARCHAR) AS invoice_no, l.invoice_date, CAST(seq AS INTEGER) AS seq, item_code, item_name, 'box' AS unit, " + _AS_READ.format(tax="CAST(tax AS DOUBLE)"))
def piped_texts_read_back(m: Sales) -> DataFrame:
    blocks = _read_back(m, sinks.piped_texts(_invoice_rows(m).fillna(0, ["tax_pct"])))
    return _as_read(readers.piped_invoices(blocks), "invoice_no", "invoice_date", "seq", "item_code", "item_name", "unit")


_CUSTOMER_COLUMNS = "customer_code string, customer_name string, rep string, city string, net decimal(14,2)"
_CUSTOMERS_BACK = " SELECT customer_code, customer_name, rep, city, CAST(net AS DOUBLE) AS net FROM customers"


def _customer_rows(m: Sales) -> DataFrame:
    return m.customers.select("customer_code", "customer_name", "rep", "city", "net")


def _net_as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("net", F.col("net").cast("double"))


@query(_CUSTOMERS_BACK)
def csv_read_back(m: Sales) -> DataFrame:
    path = sinks.scratch(m.spark)
    sinks.write_csv(_customer_rows(m), path)
    return _net_as_double(readers.read_csv(m.spark, path, _CUSTOMER_COLUMNS))


@query(_CUSTOMERS_BACK)
def csv_texts_read_back(m: Sales) -> DataFrame:
    path = sinks.scratch(m.spark)
    sinks.write_csv(_customer_rows(m), path)
    return readers.read_csv_as_text(m.spark, path, ["customer_code", "customer_name", "rep", "city", "net"]).withColumn("net", parse_number(F.col("net")).cast("double"))


@query(_CUSTOMERS_BACK)
def json_read_back(m: Sales) -> DataFrame:
    path = sinks.scratch(m.spark)
    sinks.write_json(_customer_rows(m), path)
    return _net_as_double(m.spark.read.schema(_CUSTOMER_COLUMNS).json(path))


@query(_CUSTOMERS_BACK)
def absent_file_read_back(m: Sales) -> DataFrame:
    """A file that is there, with one that isn't."""
    path = sinks.scratch(m.spark)
    sinks.write_csv(_customer_rows(m), path)
    there, absent = (readers.read_optional(m.spark, p, _CUSTOMER_COLUMNS) for p in (path, f"{path}-absent"))
    return _net_as_double(there.unionByName(absent))


@query(" SELECT month, invoice_no, CAST(reported_total AS DOUBLE) AS reported_total FROM headers")
def files_with_attribute(m: Sales) -> DataFrame:
    """A folder of files for each month, which the rows get from their file's name."""
    path = sinks.scratch(m.spark)
    rows = m.headers.select("invoice_no", "reported_total", F.col("month").alias("m"))
    rows.repartition("m").write.partitionBy("m").option("header", True).csv(path)
    found = readers.read_csv(m.spark, f"{path}/*/*.csv", "invoice_no long, reported_total decimal(12,2)")
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"m=([^/]+)/", 1).alias("month"), "invoice_no", F.col("reported_total").cast("double").alias("reported_total"))


@query(" SELECT count(*) AS found, count(*) FILTER (reported_total > 1000 AND status <> 'P') AS parsed, count(*) FILTER (NOT (reported_total > 1000 AND status <> 'P')) AS failed FROM headers")
def processing_log(m: Sales) -> DataFrame:
    return sinks.written_with_log(m.headers, sinks.scratch(m.spark), "reported_total > 1000 AND status <> 'P'")


@query(" SELECT invoice_no, CASE WHEN status <> 'O' THEN CAST(paid AS DOUBLE) END AS rate, 'x' AS tag, CASE WHEN status <> 'P' THEN CAST(reported_total AS DOUBLE) END AS flat FROM headers")
def nested_without_nan(m: Sales) -> DataFrame:
    """NaN and infinity three levels deep and at the top."""
    x = F.when(F.col("status") == "O", F.lit(float("nan"))).otherwise(F.col("paid").cast("double"))
    y = F.when(F.col("status") == "P", F.lit(float("inf"))).otherwise(F.col("reported_total").cast("double"))
    deep = m.headers.select("invoice_no", F.struct(F.array(F.create_map(F.lit("rate"), x)).alias("of"), F.lit("x").alias("tag")).alias("deep"), y.alias("flat"))
    return sinks.without_nan(deep).select("invoice_no", F.col("deep.of")[0]["rate"].alias("rate"), "deep.tag", "flat")


@query(""", t AS (SELECT p_partkey, p_brand AS brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN upper(p_name) ELSE '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS text FROM part), n AS (SELECT *, try_cast(replace(trim(text), ',', '') AS DOUBLE) AS x FROM t)
 SELECT p_partkey, brand, text, CAST(row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, coalesce(x, 0), lower(text), text, p_partkey) AS INTEGER) AS place FROM n""")
def naturally_sorted(m: Sales) -> DataFrame:
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(kind == 0, F.col("p_name")).when(kind == 1, size).when(kind == 2, F.upper("p_name")).otherwise(F.concat(F.lit("1,"), F.lpad(size, 3, "0")))
    rows = m.table("part").select("p_partkey", F.col("p_brand").alias("brand"), text.alias("text"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("brand").orderBy(sales.natural_key(F.col("text")), "p_partkey")))


# Variants of checks, and every filter by itself


@query(""", s AS (SELECT h.invoice_no, CAST(h.reported_total AS DOUBLE) AS reported_total, coalesce(CAST(sum(line_total) AS DOUBLE), 0) AS line_sum FROM headers h LEFT JOIN lines l ON h.invoice_no = l.invoice_no GROUP BY 1, 2), d AS (SELECT *, abs(round(reported_total - line_sum, 6)) AS diff FROM s)
 SELECT 'strict' AS variant, count(*) FILTER (diff < 50) AS n_passed, count(*) AS n FROM d UNION ALL SELECT 'absolute', count(*) FILTER (diff <= 50), count(*) FROM d UNION ALL SELECT 'relative', count(*) FILTER (diff <= greatest(50, abs(reported_total) * 0.01)), count(*) FROM d""")
def reconciliation_variants(m: Sales) -> DataFrame:
    one = lambda v: quality.reconcile(m.rows, m.headers, v, 50.0).agg(F.lit(v).alias("variant"), F.count_if("passes").alias("n_passed"), F.count("*").alias("n"))
    return one("strict").unionByName(one("absolute")).unionByName(one("relative"))


@query(" SELECT count(*) FILTER (abs(reported_total - paid - remaining) > 1) AS n_off, count(*) AS n, count(*) FILTER (abs(reported_total - paid - remaining) > 1) <= 0.02 * count(*) AS passes FROM headers")
def paid_plus_remaining(m: Sales) -> DataFrame:
    return quality.paid_plus_remaining(m.headers)


@query(" SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS k, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3) > 1 AS repeated FROM lineitem")
def marked_repeats(m: Sales) -> DataFrame:
    lines = m.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("k"))
    return quality.mark_repeats(lines, ["l_orderkey", "k"])


_BUCKETED = "CASE WHEN net >= 500000 THEN 'high' WHEN net >= 0 THEN 'low' ELSE 'none' END"
_FILTERS = {"customer": ("customer_code = '7'", "customer_code = '7'", "customer_code = '7'"), "rep": ("rep = 'CHINA'", None, None), "item": ("item_code IN ('3', '5')", None, None), "bucket": (None, None, "bucket = 'high'"), "status": (None, "status = 'P'", None), "month": ("month = '1998-01'", "month = '1998-01'", None)}


def _one_filter(name: str) -> str:
    """Lines, invoices and customers that one filter leaves, as sets that are cut down in turn."""
    lines, heads, owed = (f"WHERE {c}" if c else "" for c in _FILTERS[name])
    by_line, by_owed = name in ("rep", "item"), name == "bucket"
    h = f"(SELECT * FROM headers {heads})"
    h = f"(SELECT * FROM {h} WHERE invoice_no IN (SELECT invoice_no FROM lines {lines}))" if by_line else f"(SELECT * FROM {h} WHERE customer_code IN (SELECT customer_code FROM bu {owed}))" if by_owed else h
    return f"SELECT '{name}' AS filter, (SELECT count(*) FROM (SELECT * FROM lines {lines}) WHERE invoice_no IN (SELECT invoice_no FROM {h})) AS n_lines, (SELECT count(*) FROM {h}) AS n_invoices, (SELECT count(*) FROM (SELECT * FROM bu {owed}) WHERE customer_code IN (SELECT customer_code FROM {h})) AS n_customers"


@query(f", bu AS (SELECT customer_code, {_BUCKETED} AS bucket FROM customers) " + " UNION ALL ".join(map(_one_filter, _FILTERS)))
def each_filter(m: Sales) -> DataFrame:
    owed = m.customers.withColumn("bucket", F.when(F.col("net") >= 500000, "high").when(F.col("net") >= 0, "low").otherwise("none"))
    given = {"customer": {"customers": ["7"]}, "rep": {"reps": ["CHINA"]}, "item": {"items": ["3", "5"]}, "bucket": {"buckets": ["high"]}, "status": {"statuses": ["P"]}, "month": {"months": ["1998-01"]}}

    def one(name: str) -> DataFrame:
        a, b, c = (x.agg(F.count("*").alias(n)) for x, n in zip(sales.cross_filter(m.lines, m.headers, owed, **given[name]), ("n_lines", "n_invoices", "n_customers"), strict=True))
        return a.crossJoin(b).crossJoin(c).select(F.lit(name).alias("filter"), "*")  # three single rows

    first, *rest = map(one, given)
    return series.sum_union([first, *rest])


@query(""", al AS (SELECT customer_code, invoice_date AS date, 'invoice' AS kind, 'invoice' AS grp, CAST(invoice_no AS VARCHAR) AS ref, NULL AS item_code, CAST(NULL AS DOUBLE) AS qty, CAST(NULL AS INTEGER) AS seq, reported_total AS amount, reported_total AS moved FROM headers UNION ALL SELECT customer_code, date, 'receipt', 'receipt', CAST(doc_ref AS VARCHAR), NULL, NULL, NULL, -amount, -amount FROM receipts UNION ALL SELECT customer_code, date, 'return', 'return', CAST(doc_ref AS VARCHAR), NULL, NULL, NULL, -amount, -amount FROM returns
  UNION ALL SELECT customer_code, invoice_date, 'item', 'invoice', CAST(invoice_no AS VARCHAR), item_code, CAST(qty AS DOUBLE), CAST(seq AS INTEGER), line_total, NULL FROM lines)
 SELECT customer_code, date, kind, ref, item_code, qty, seq, CAST(amount AS DOUBLE) AS amount, coalesce(CAST(sum(moved) OVER (PARTITION BY customer_code ORDER BY date, grp, ref, seq NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE), 0) AS balance FROM al""")
def customer_ledgers(m: Sales) -> DataFrame:
    return sales.ledger(m.headers, m.lines, m.receipts, m.returns)


@query(" SELECT invoice_no, month AS padded, month AS plain, month AS slashed, month AS tight, CAST(NULL AS VARCHAR) AS none FROM headers")
def months_of_texts(m: Sales) -> DataFrame:
    day = F.col("invoice_date")
    text = {"padded": F.date_format(day, "yyyy-MM-dd"), "plain": F.date_format(day, "yyyy-M"), "slashed": F.date_format(day, " yyyy/M/d"), "tight": F.date_format(day, "yyyyMM"), "none": F.concat(F.date_format(day, "yyyy"), F.lit("-13"))}
    return m.headers.select("invoice_no", *[month_of_text(c).alias(k) for k, c in text.items()])


@query(""", k AS (SELECT customer_code, customer_name, rep, city, CAST(customer_code AS INTEGER) // 40 AS page FROM customers) SELECT rep AS doc, page, row_number() OVER (PARTITION BY rep, page ORDER BY CAST(customer_code AS INTEGER)) AS "row", split_part(customer_name, '#', 2) || ' Customer' AS name, city, customer_code AS code FROM k""")
def page_records(m: Sales) -> DataFrame:
    """Words laid out on pages, as a document has them, and the records that gaps and bands give again."""
    code = F.col("customer_code").cast("int")
    placed = m.customers.withColumn("page", F.floor(code / 40).cast("int")).withColumn("y", 20.0 * F.row_number().over(W.partitionBy("rep", "page").orderBy(code)))
    word = lambda x, dy, c: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(dy)).alias("dy"), c.alias("word"))
    words = F.array(word(300, 0.4, F.split("customer_name", "#")[0]), word(340, 0, F.split("customer_name", "#")[1]), word(120, 1.1, F.col("city")), word(20, 0.7, F.col("customer_code")))
    laid = placed.select(F.col("rep").alias("doc"), "page", "y", F.explode(words).alias("w")).select("doc", "page", F.col("w.x0").alias("x0"), (F.col("y") + F.col("w.dy")).alias("y0"), F.col("w.word").alias("word"))
    return readers.page_table(laid, 5.0, [("name", 250, 1000), ("city", 100, 250), ("code", 0, 100)])


_PACF = ACF + ", l0 AS (SELECT series_key, any_value(n) AS n, " + ", ".join(f"max(r * n / (n - lag)) FILTER (lag = {k}) AS r{k}" for k in range(9)) + " FROM acf GROUP BY 1), l1 AS (SELECT *, r1 AS v1, r1 AS f1 FROM l0 WHERE n >= 8)"
for _k in range(2, 9):
    _v = f"(r{_k} - (" + " + ".join(f"f{j} * r{_k - j}" for j in range(1, _k)) + ")) / (1 - (" + " + ".join(f"f{j} * r{j}" for j in range(1, _k)) + "))"
    _PACF += f", w{_k} AS (SELECT *, {_v} AS v{_k} FROM l{_k - 1}), l{_k} AS (SELECT * EXCLUDE (" + ", ".join(f"f{j}" for j in range(1, _k)) + "), " + ", ".join(f"f{j} - v{_k} * f{_k - j} AS f{j}" for j in range(1, _k)) + f", v{_k} AS f{_k} FROM w{_k})"


@query(_PACF + " SELECT series_key, CAST(lag AS INTEGER) AS lag, round(v, 6) AS pacf FROM (SELECT series_key, n, unnest(range(0, 9)) AS lag, unnest([1.0, " + ", ".join(f"v{k}" for k in range(1, 9)) + "]) AS v FROM l8) WHERE lag <= least(8, n // 2 - 1)")
def brand_partial_autocorrelation(m: Sales) -> DataFrame:
    return series.partial_autocorrelation(_panel(m)).withColumn("pacf", F.round("pacf", 6))


@query(HARMONIC + """, ss AS (SELECT series_key, 'fourier' AS model, sum(e * e) AS sse, count(*) AS n, 4 AS k FROM r GROUP BY 1 UNION ALL SELECT series_key, 'difference_ar', sum(d * d) FILTER (l IS NOT NULL) - CASE WHEN sum(l * l) FILTER (d IS NOT NULL) > 0 THEN sum(d * l) ** 2 / sum(l * l) FILTER (d IS NOT NULL) ELSE 0 END, count(*), 1 FROM (SELECT series_key, d, lag(d) OVER (PARTITION BY series_key ORDER BY t) AS l FROM (SELECT series_key, t, y - lag(y) OVER (PARTITION BY series_key ORDER BY t) AS d FROM panel)) GROUP BY 1)
 SELECT series_key, model, round(n * ln(greatest(sse, 1e-300) / n) + 2 * k, 6) AS aic, round(n * ln(greatest(sse, 1e-300) / n) + k * ln(n), 6) AS bic FROM ss""")
def brand_closed_information(m: Sales) -> DataFrame:
    found = forecast.closed_information(_panel(m))
    return found.select("series_key", "model", F.round("aic", 6).alias("aic"), F.round("bic", 6).alias("bic"))


@query(PANEL + """, sh AS (SELECT series_key, t, y, max(t) OVER () AS last FROM panel), f AS (SELECT series_key, arg_max(y, t) AS f, stddev_pop(y) AS s FROM sh WHERE t > last - 5 GROUP BY 1)
 SELECT series_key, step, 'naive_fallback' AS method, round(f, 4) AS forecast, round(greatest(f - 1.96 * s * sqrt(step), 0), 4) AS lower, round(f + 1.96 * s * sqrt(step), 4) AS upper FROM f CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)""")
def short_panel_forecast(m: Sales) -> DataFrame:
    """The last five months of every brand: too few for a fit."""
    p = _panel(m)
    late = p.crossJoin(p.agg(F.max("t").alias("last"))).filter("t > last - 5").withColumn("t", F.col("t") - F.col("last") + 5)
    return forecast.panel_forecast(late).select("series_key", "step", "method", *[F.round(c, 4).alias(c) for c in ("forecast", "lower", "upper")])
