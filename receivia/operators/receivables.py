"""Receivables: arrears, ageing of snapshots, first-in-first-out allocation, collection rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.functions.scalars import AGING, aging_bucket, clip, incentive, ratio
from receivia.operators.sales import total

#: Smaller residues of an invoice are taken as paid.
RESIDUE = 0.005


def totals(balances: DataFrame) -> DataFrame:
    return balances.agg(total("debit").alias("debit"), total("credit").alias("credit"), total("net").alias("net"), F.count_if(F.col("net") > 0).alias("n_debit"), F.count_if(F.col("net") < 0).alias("n_credit"))


def by_rep(balances: DataFrame) -> DataFrame:
    return balances.groupBy("rep").agg(total("debit").alias("debit"), total("credit").alias("credit"), total("net").alias("net"), F.count_distinct("customer_code").alias("n_customers"))


def merged_balances(balances: DataFrame, code: str, order: str) -> DataFrame:
    """Rows of one code summed; descriptions from the first in order."""
    return balances.groupBy(code).agg(F.sum("balance").alias("balance"), F.min_by("name", order).alias("name"))


def arrears(balances: DataFrame, headers: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Positive balances as arrears where the last invoice is older than days, or there is none."""
    last = headers.groupBy("customer_code").agg(F.max("invoice_date").alias("last_invoice_date"))
    met = balances.join(last, "customer_code", "left")
    old = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), "last_invoice_date") > days, F.lit(True))
    pos = F.greatest(F.col("net"), F.lit(0)).cast("double")
    return met.select("customer_code", "rep", "last_invoice_date", pos.alias("debt"), F.greatest(-F.col("net"), F.lit(0)).cast("double").alias("credit_balance"), F.when(old, 0.0).otherwise(pos).alias("current_amount"), F.when(old, pos).otherwise(0.0).alias("arrears_amount"))


def arrears_by_rep(detail: DataFrame) -> DataFrame:
    s = lambda c: F.round(F.sum(c), 4).alias(c)
    return detail.groupBy("rep").agg(s("debt"), s("credit_balance"), s("current_amount"), s("arrears_amount"), F.count_if(F.col("arrears_amount") > 0).alias("n_in_arrears"))


def snapshot_aging(detail: DataFrame, as_of: str, terms: int = 30, missing_age: int = 9999) -> DataFrame:
    """Arrears in one bucket each by days over terms, at least 1; no date is the oldest bucket."""
    age = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), "last_invoice_date"), F.lit(missing_age))
    return detail.filter("debt > 0").withColumn("bucket", F.when(F.col("arrears_amount") > 0, aging_bucket(F.greatest(age - terms, F.lit(1)))).otherwise("current"))


def aging_totals(aged: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return aged.groupBy(*keys, "bucket").agg(F.round(F.sum("debt"), 4).alias("amount"), F.count("*").alias("n"))


def fifo(headers: DataFrame, balances: DataFrame, as_of: str, cutoff: str) -> DataFrame:
    """What of each invoice is unpaid if payments (billed less balance) settle the oldest first.

    headers: customer_code, invoice_no, invoice_date, reported_total (not negative); balances:
    customer_code, balance. Customers without a positive balance are left out. What the invoices
    cannot explain is a row of its own, without invoice, in the oldest bucket. Invoices up to cutoff
    are overdue, by their age at as_of; later ones are current.
    """
    owing = balances.filter(F.col("balance") > 0).select("customer_code", "balance")
    bills = headers.filter(F.col("reported_total") > 0).join(owing, "customer_code", "left_semi")
    w = W.partitionBy("customer_code")
    order = w.orderBy("invoice_date", "invoice_no").rowsBetween(W.unboundedPreceding, 0)
    met = bills.select("customer_code", "invoice_no", "invoice_date", F.col("reported_total").alias("amount"), F.sum("reported_total").over(order).alias("cum"), F.sum("reported_total").over(w).alias("billed")).join(owing, "customer_code")
    unpaid = F.greatest(F.lit(0), F.least(F.col("amount"), F.col("cum") - F.greatest(F.col("billed") - F.col("balance"), F.lit(0))))
    rows = met.withColumn("unpaid", unpaid.cast("double")).filter(F.col("unpaid") > RESIDUE)
    age = F.date_diff(F.lit(as_of).cast("date"), "invoice_date")
    dated = rows.select("customer_code", "invoice_no", "invoice_date", "unpaid", F.when(F.col("invoice_date") <= F.lit(cutoff).cast("date"), aging_bucket(age)).otherwise("current").alias("bucket"))
    billed = headers.filter(F.col("reported_total") > 0).groupBy("customer_code").agg(F.sum("reported_total").alias("billed"))
    opening = owing.join(billed, "customer_code", "left").withColumn("unpaid", (F.col("balance") - F.coalesce("billed", F.lit(0))).cast("double")).filter(F.col("unpaid") > RESIDUE)
    none = lambda c: F.lit(None).cast(dated.schema[c].dataType).alias(c)
    return dated.unionByName(opening.select("customer_code", none("invoice_no"), none("invoice_date"), "unpaid", F.lit(AGING[-1][0]).alias("bucket")))


def overdue(open_: DataFrame, as_of: str, terms: int = 30) -> DataFrame:
    """Per customer the open amount by bucket, what is overdue, days over terms of the oldest open
    invoice, and the largest bucket."""
    names = ["current", *(b[0] for b in AGING)]
    amount = lambda b: F.round(F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("unpaid"))), F.lit(0.0)), 4).alias(b)
    by = open_.groupBy("customer_code").agg(*map(amount, names), F.min("invoice_date").alias("oldest"))
    late = F.round(sum((F.col(b[0]) for b in AGING), F.lit(0.0)), 4)
    # the first of equal buckets, as they stand
    order = F.array_max(F.array(*(F.struct(F.col(b).alias("v"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(names))))["b"]
    days = F.greatest(F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.date_add("oldest", terms)), F.lit(0)), F.lit(0))
    return by.select("customer_code", *names, late.alias("overdue"), F.round(late + F.col("current"), 4).alias("balance"), "oldest", days.alias("days_overdue"), order.alias("dominant"))


def overdue_totals(by_customer: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    names = ["current", *(b[0] for b in AGING), "overdue", "balance"]
    return by_customer.groupBy(*keys).agg(*[F.round(F.sum(c), 2).alias(c) for c in names], F.count("*").alias("n_customers"))


def oldest_unpaid(headers: DataFrame, as_of: str, terms: int = 30) -> DataFrame:
    """Per customer the oldest invoice with a remainder, when it was due and how long it is over."""
    first = headers.filter(F.col("remaining") > 0).groupBy("customer_code").agg(F.min(F.struct("invoice_date", "invoice_no")).alias("f"))
    due = F.date_add("f.invoice_date", terms)
    return first.select("customer_code", F.col("f.invoice_no").alias("invoice_no"), F.col("f.invoice_date").alias("invoice_date"), due.alias("due_date"), F.greatest(F.date_diff(F.lit(as_of).cast("date"), due), F.lit(0)).alias("days_overdue"))


def cohort(by_customer: DataFrame, headers: DataFrame, month: str) -> DataFrame:
    """Balances, whole, of the customers with an invoice in month."""
    return by_customer.join(headers.filter(F.col("month") == month).select("customer_code").distinct(), "customer_code", "left_semi")


def collection_rates(headers: DataFrame, balances: DataFrame, receipts: DataFrame, year: int) -> DataFrame:
    """Per customer billed in the year: rate from receipts, else from balances, else none; and the
    incentive on sales by tier of the rate."""
    billed = headers.filter(F.year("invoice_date") == year).groupBy("customer_code").agg(total("reported_total").alias("billed"))
    got = receipts.filter(F.year("date") == year).groupBy("customer_code").agg(total("amount").alias("received"))
    met = billed.join(got, "customer_code", "left").join(balances.select("customer_code", F.col("net").cast("double").alias("net")), "customer_code", "left")
    actual, proxy = ratio(F.col("received"), F.col("billed")), ratio(F.col("billed") - F.greatest(F.col("net"), F.lit(0.0)), F.col("billed"))
    source = F.when(actual.isNotNull(), "actual").when(proxy.isNotNull(), "proxy").otherwise("none")
    rate = F.round(clip(F.coalesce(actual, proxy)), 6)
    return met.select("customer_code", "billed", F.coalesce("received", F.lit(0.0)).alias("received"), F.when(source != "none", rate).alias("rate"), source.alias("basis")).withColumn("incentive", F.round(F.col("billed") * incentive(F.col("rate")), 4))


def tier_counts(rates: DataFrame, tiers: DataFrame) -> DataFrame:
    """Customers per tier (lower, upper), tiers without any included; rates above the last count there."""
    r = F.coalesce(F.col("rate"), F.lit(0.0))
    met = F.broadcast(tiers).join(rates.select(r.alias("_r")), (F.col("_r") >= F.col("lower")) & (F.col("_r") < F.col("upper")), "left")  # a row per tier
    return met.groupBy("lower").agg(F.count("_r").alias("n"))


def customer_360(sales: DataFrame, debts: DataFrame) -> DataFrame:
    """Every customer of either side, what is absent as 0."""
    return sales.join(debts, "customer_code", "full").fillna(0.0, [c for c in ("sales", "debt", "arrears_amount") if c in {*sales.columns, *debts.columns}])


def customer_360_table(headers: DataFrame, lines: DataFrame, customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Every customer with invoices or balances: name, representative, sales, invoices, units, free units and
    their share, and the parts of the balance. Each side is summed before they meet; what is absent is 0."""
    sold = headers.groupBy("customer_code").agg(total("reported_total").alias("sales"), F.count_distinct("invoice_no").alias("n_invoices"))
    units = lines.groupBy("customer_code").agg(total("qty").alias("qty"), F.coalesce(total(F.when(F.col("is_bonus"), F.col("qty"))), F.lit(0.0)).alias("bonus_qty"))
    owed = debts.select("customer_code", "debt", "credit_balance", "current_amount", "arrears_amount")
    numbers = ["sales", "n_invoices", "qty", "bonus_qty", "debt", "credit_balance", "current_amount", "arrears_amount"]
    met = sold.join(units, "customer_code", "left").join(owed, "customer_code", "full").fillna(0, numbers)
    return met.join(customers.select("customer_code", "customer_name", "rep"), "customer_code", "left").select("customer_code", "customer_name", "rep", *numbers, F.round(ratio(F.col("bonus_qty"), F.col("qty")) * 100, 6).alias("bonus_pct"))
