"""Deductions, free goods, days of sales outstanding, the executive summary and its facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivia.functions.scalars import clip, ratio
from receivia.operators.sales import concentration, total


def deductions(lines: DataFrame) -> DataFrame:
    """List value of paid lines, what was billed, and the difference in money and as a share."""
    paid = lines.filter(~F.col("is_bonus"))
    by = paid.agg(total("gross").alias("gross"), total("line_total").alias("net"))
    return by.withColumns({"deduction": F.round(F.col("gross") - F.col("net"), 4), "deduction_pct": F.round(ratio(F.col("gross") - F.col("net"), F.col("gross")) * 100, 6)})


def item_prices(lines: DataFrame) -> DataFrame:
    """The mean price an item sold at, weighted by quantity, over lines with a value."""
    paid = F.col("line_total") > 0
    return lines.groupBy("item_code").agg(ratio(F.sum(F.when(paid, F.col("line_total"))), F.sum(F.when(paid, F.col("qty")))).alias("price"))


def free_goods(lines: DataFrame) -> DataFrame:
    """Free goods at the item's mean price, against revenue."""
    free = lines.filter(F.col("is_bonus")).groupBy("item_code").agg(total("qty").alias("free_qty"))
    value = free.join(item_prices(lines), "item_code", "left").agg(F.sum("free_qty").alias("free_qty"), F.round(F.sum(F.col("free_qty") * F.coalesce("price", F.lit(0.0))), 2).alias("free_value"))
    return value.crossJoin(lines.agg(total("line_total").alias("revenue"))).withColumn("free_pct", F.round(ratio(F.col("free_value"), F.col("revenue")) * 100, 4))


def free_goods_by_customer(lines: DataFrame) -> DataFrame:
    """Per customer with free goods: their quantity, share of all units, value and share of sales."""
    priced = lines.filter(F.col("is_bonus")).join(item_prices(lines), "item_code", "left")
    free = priced.groupBy("customer_code").agg(total("qty").alias("free_qty"), F.round(F.sum(F.col("qty").cast("double") * F.coalesce("price", F.lit(0.0))), 4).alias("free_value"))
    whole = lines.groupBy("customer_code").agg(total("qty").alias("_q"), total("line_total").alias("_v"))
    return free.join(whole, "customer_code").select("customer_code", "free_qty", "free_value", F.round(ratio(F.col("free_qty"), F.col("_q")) * 100, 4).alias("free_qty_pct"), F.round(ratio(F.col("free_value"), F.col("_v")) * 100, 4).alias("free_value_pct"))


def trailing_revenue(lines: DataFrame, months: int = 12) -> DataFrame:
    last = F.broadcast(lines.select("month").distinct().orderBy(F.desc("month")).limit(months))
    return lines.join(last, "month", "left_semi").agg(total("line_total").alias("trailing_revenue"))


def days_outstanding(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Net receivables over the daily revenue of the last twelve months."""
    met = balances.agg(total("net").alias("net_ar")).crossJoin(trailing_revenue(lines))
    return met.withColumn("dso", F.round(ratio(F.col("net_ar"), F.col("trailing_revenue") / 365), 6))


def executive_summary(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Revenue, period, trailing revenue, concentration, receivables and days outstanding in a row."""
    base = lines.agg(total("line_total").alias("revenue"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("month").alias("n_months"))
    c = concentration(lines, "customer_code").select(F.col("hhi").alias("hhi_customers"), "top10_pct")
    return base.crossJoin(c).crossJoin(days_outstanding(lines, balances)).crossJoin(deductions(lines).select("deduction_pct"))


def debtor_concentration(balances: DataFrame, k: int = 10) -> DataFrame:
    """The k largest debtors over all positive rows, and the index of debts without credits."""
    pos = F.greatest(F.col("net"), F.lit(0)).cast("double")
    by = balances.groupBy("customer_code").agg(F.sum(pos).alias("v"))
    whole = by.agg(F.sum("v").alias("_all"), F.sum(F.col("v") * F.col("v")).alias("_q"))
    top = by.orderBy(F.desc("v"), "customer_code").limit(k).agg(F.sum("v").alias("_top"))
    return whole.crossJoin(top).select(F.round(ratio(F.col("_top"), F.col("_all")) * 100, 4).alias("top_pct"), F.round(F.try_divide("_q", F.col("_all") * F.col("_all")) * 10000, 4).alias("hhi"))


def portfolio_collection(headers: DataFrame, aged: DataFrame, receipts: DataFrame) -> DataFrame:
    """Sales, overdue and open amounts, receipts, and the collection rate with what it is based on."""
    met = headers.agg(total("reported_total").alias("sales")).crossJoin(aged.agg(F.round(F.sum("overdue"), 2).alias("overdue"), F.round(F.sum("balance"), 2).alias("balance"))).crossJoin(receipts.agg(total("amount").alias("received")))
    actual = F.col("received").isNotNull()
    rate = F.when(actual, ratio(F.col("received"), F.col("sales"))).otherwise(ratio(F.col("sales") - F.col("balance"), F.col("sales")))
    return met.withColumns({"collection_rate": F.round(clip(rate), 6), "basis": F.when(actual, "actual").otherwise("proxy")})


def insight_facts(lines: DataFrame, aged: DataFrame) -> DataFrame:
    """Numbers behind a commentary, each with a priority. aged has customer_code, overdue, balance."""
    late = aged.agg(F.round(ratio(F.sum("overdue"), F.sum("balance")), 6).alias("value")).select(F.lit("overdue_share").alias("fact"), "value")
    facts = F.array(F.struct(F.lit("top10_share").alias("fact"), F.round(F.col("top10_pct") / 100, 6).alias("value")), F.struct(F.lit("customers_to_80pct").alias("fact"), F.col("n80").cast("double").alias("value")))
    rows = concentration(lines, "customer_code").select(F.inline(facts)).unionByName(late)
    high = ((F.col("fact") == "top10_share") & (F.col("value") > 0.5)) | ((F.col("fact") == "overdue_share") & (F.col("value") > 0.4))
    return rows.withColumn("priority", F.when(high, "high").when((F.col("fact") == "overdue_share") & (F.col("value") > 0.1), "medium").otherwise("info"))
