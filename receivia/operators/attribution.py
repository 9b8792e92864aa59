"""Conforming names and codes, item matching, and attribution of receipts and returns."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receivia.functions.scalars import canonical_code, first_rule, match_key, name_key, pack_size
from receivia.operators.sales import most_frequent, of_items, total


def canonical_codes(df: DataFrame, code: str, aliases: DataFrame) -> DataFrame:
    """code without commas, replaced where aliases (alias, code) knows it."""
    plain = df.withColumn(code, canonical_code(F.col(code)))
    known = aliases.select(F.col("alias").alias("_a"), F.col("code").alias("_c"))
    return plain.join(known, F.col(code) == F.col("_a"), "left").withColumn(code, F.coalesce("_c", code)).drop("_a", "_c")


def overridden(df: DataFrame, key: str, column: str, overrides: DataFrame) -> DataFrame:
    """column replaced where overrides (key, value) has the key."""
    small = overrides.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return df.join(small, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: str) -> DataFrame:
    """df with value from table, default where the key is absent."""
    found = table.select(key, F.col(value).alias("_v")).dropDuplicates([key])
    return df.join(found, key, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value from the first source that has a value; of several in one source the smallest."""
    ranked = reduce(DataFrame.unionByName, (s.select(key, value, F.lit(i).alias("_p")) for i, s in enumerate(sources)))
    return ranked.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct("_p", F.col(value))).alias(value))


def without_invoices(balances: DataFrame, headers: DataFrame) -> DataFrame:
    return balances.join(headers.select("customer_code").distinct(), "customer_code", "left_anti")


def without_rep(headers: DataFrame, reps: DataFrame) -> DataFrame:
    """Customers with sales that no source gives a representative."""
    return headers.select("customer_code").distinct().join(reps.filter(F.col("rep").isNotNull()), "customer_code", "left_anti")


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two names."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _parts(c: Column, q: int) -> Column:
    """All stretches of q characters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, F.lit(q))))


def contained(names: DataFrame, master: DataFrame, least: int = 6) -> DataFrame:
    """_i, _m of names (_i) and master (_m) of which one of least characters or more is within the other. The
    first characters of what is contained are a stretch of what contains it, on which the two are joined."""
    long = lambda df, c: df.select(c).distinct().filter(F.length(c) >= least)
    first = lambda df, c: df.withColumn("_q", F.substring(F.col(c), F.lit(1), F.lit(least)))
    every = lambda df, c: df.withColumn("_q", F.explode(_parts(F.col(c), least)))
    i, m = long(names, "_i"), long(master, "_m")
    within = every(i, "_i").join(first(m, "_m"), "_q").filter(F.col("_i").contains(F.col("_m")))
    around = first(i, "_i").join(every(m, "_m"), "_q").filter(F.col("_m").contains(F.col("_i")))
    return within.select("_i", "_m").union(around.select("_i", "_m")).distinct()


def _numbered(c: Column) -> Column:
    """The characters of c, each with how often it stood before, those that repeat most often first."""

    def of(i: Column) -> Column:
        before, own = F.substring(c, F.lit(1), i - 1), F.substring(c, i, F.lit(1))
        return F.struct((F.length(F.replace(before, own, F.lit(""))) - F.length(before)).alias("n"), own.alias("c"))

    return F.array_sort(F.transform(F.sequence(F.lit(1), F.length(c)), of))


def alike(names: DataFrame, master: DataFrame, ratio: float = 0.72) -> DataFrame:
    """_i, _m, r of names (_i) and master (_m) whose matching-blocks ratio r is at least ratio; empty names are like
    nothing. A ratio needs that share of common characters, so that the shorter name has ratio / (2 - ratio) of
    the longer one's length at least, and that both share one of their first numbered characters in one order;
    they are joined on these. The ratio is computed only where lengths and common characters allow it."""
    share = ratio / (2 - ratio)

    def side(df: DataFrame, c: str, chars: str) -> DataFrame:
        own = df.select(c).distinct().filter(F.length(c) > 0).withColumn(chars, _numbered(F.col(c)))
        return own.withColumn("_c", F.explode(F.slice(chars, F.lit(1), F.length(c) - F.ceil(F.lit(share) * F.length(c) - 1e-9).cast("int") + 1)))

    a, b = F.length("_i"), F.length("_m")
    bound = F.least(a, b) >= share * F.greatest(a, b) - 1e-9
    pairs = side(names, "_i", "_x").join(side(master, "_m", "_y"), "_c").filter(bound).select("_i", "_m", "_x", "_y").distinct()
    near = pairs.filter(2 * F.size(F.array_intersect("_x", "_y")) >= ratio * (a + b) - 1e-9)
    return near.select("_i", "_m", name_ratio("_i", "_m").alias("r")).filter(F.col("r") >= ratio)


def match_names(items: DataFrame, master: DataFrame, keywords: list[tuple[str, str]], *, least: int = 6, ratio: float = 0.72) -> DataFrame:
    """item_name, brand, master_name and match_type, a row per name of items; null is none.

    In turn: the longest containment with a name of master (name, brand), the best similar name, the first
    keyword, and "unclassified"; of equally good ones the last by name, then brand, counts. Empty names match nothing.
    """
    # an aggregate, not a distinct: the conditions of the branches below stay above it, so that Spark makes it once
    keyed = items.filter(F.col("item_name").isNotNull()).groupBy("item_name").agg(F.max(match_key(F.col("item_name"))).alias("_i"))
    names = master.select(F.col("name").alias("master_name"), "brand", match_key(F.col("name")).alias("_m"))
    of_key = names.groupBy("_m").agg(F.max(F.struct("master_name", "brand")).alias("b"))

    def best(met: DataFrame, score: Column, kind: str) -> DataFrame:
        by = met.join(of_key, "_m").groupBy("_i").agg(F.max(F.struct(score.alias("s"), "b")).alias("w"))
        return by.select("_i", F.col("w.b.brand").alias("brand"), F.col("w.b.master_name").alias("master_name"), F.lit(kind).alias("match_type"))

    first = best(contained(keyed, names, least), F.least(F.length("_i"), F.length("_m")), "master")
    second = best(alike(keyed.join(first, "_i", "left_anti"), names, ratio), F.col("r"), "fuzzy")
    met, new = keyed.join(first.unionByName(second), "_i", "left"), F.col("match_type").isNull()
    ruled = first_rule(F.col("item_name"), keywords, "unclassified")
    return met.select("item_name", F.when(new, ruled).otherwise(F.col("brand")).alias("brand"), "master_name", F.coalesce("match_type", F.when(ruled == "unclassified", "unclassified").otherwise("keyword")).alias("match_type"))


def matched(items: DataFrame, of_name: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """items (item_code, item_name, and others) with brand, master_name and match_type of their names as of_name (see
    match_names) has them; an override goes before all."""
    own, rest = [F.col(c) for c in items.columns], F.lit("unclassified")
    brand = F.when(F.col("match_type").isNull(), rest).otherwise(F.col("brand"))
    found = items.join(of_name, "item_name", "left").select(*own, brand.alias("brand"), "master_name", F.coalesce("match_type", rest).alias("match_type"))
    if overrides is None:
        return found
    given = found.join(overrides.select("item_code", F.col("brand").alias("_b")), "item_code", "left")
    return given.select(*own, F.coalesce("_b", "brand").alias("brand"), "master_name", F.when(F.col("_b").isNotNull(), "override").otherwise(F.col("match_type")).alias("match_type"))


def match_items(items: DataFrame, master: DataFrame, keywords: list[tuple[str, str]], overrides: DataFrame | None = None, *, least: int = 6, ratio: float = 0.72) -> DataFrame:
    """item_code, brand, master_name and match_type of items (item_code, item_name). Names are matched once however
    many items have them, see match_names; an override goes before all."""
    return matched(items.select("item_code", "item_name"), match_names(items, master, keywords, least=least, ratio=ratio), overrides).drop("item_name")


def item_dimension(lines: DataFrame, items: DataFrame, master: DataFrame, keywords: list[tuple[str, str]], overrides: DataFrame | None = None) -> DataFrame:
    """One row per item code of lines that items (item_code, item_name) knows: its commonest name, brand, pack, match
    and totals."""
    by = of_items(lines, items, total_revenue=F.sum("line_total"), total_qty=F.sum("qty"))
    sums = by.select("item_code", "item_name", F.col("total_revenue").cast("double").alias("total_revenue"), F.col("total_qty").cast("double").alias("total_qty"), F.col("n_rows").alias("n_lines"))
    packs = master.select(F.col("name").alias("master_name"), pack_size(F.col("carton_capacity")).alias("pack")).dropDuplicates(["master_name"])
    # all names that items have, whether sold or not, so that lines are summed for the result only
    met = matched(sums, match_names(items, master, keywords), overrides).join(packs, "master_name", "left")
    return met.select("master_name", "item_code", "item_name", "brand", "match_type", "total_revenue", "total_qty", "n_lines", "pack")


def customer_dimension(headers: DataFrame, names: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row per customer: commonest name, invoices, revenue, first and last date, and the
    receivables snapshot where there is one."""
    by = headers.groupBy("customer_code").agg(F.count_distinct("invoice_no").alias("n_invoices"), total("reported_total").alias("total_revenue"), F.min("invoice_date").alias("first_invoice_date"), F.max("invoice_date").alias("last_invoice_date"))
    variants = names.groupBy("customer_code").agg(F.count_distinct("customer_name").alias("n_name_variants"))
    ar = snapshot.groupBy("customer_code").agg(F.min("rep").alias("rep"), F.min("city").alias("city"), total("net").alias("ar_net_balance"))
    met = by.join(most_frequent(names, "customer_code", "customer_name"), "customer_code", "left").join(variants, "customer_code", "left").join(ar, "customer_code", "left")
    return met.withColumn("has_ar_snapshot", F.col("rep").isNotNull())


def unique_names(customers: DataFrame, name: str = "customer_name") -> DataFrame:
    """name key and code, for names that exactly one code has."""
    by = customers.filter(name_key(F.col(name)) != "").groupBy(name_key(F.col(name)).alias("_key")).agg(F.min("customer_code").alias("customer_code"), F.max("customer_code").alias("_last"))
    return by.filter(F.col("customer_code") == F.col("_last")).drop("_last")


def attribute(rows: DataFrame, customers: DataFrame, reps: DataFrame, pooled: str = "unmatched") -> DataFrame:
    """rows (customer_name, ...) with customer_code and rep; unknown or ambiguous names are pooled."""
    own = [c for c in rows.columns if c not in ("customer_code", "rep")]
    met = rows.select(*own).withColumn("_key", name_key(F.col("customer_name"))).join(unique_names(customers), "_key", "left")
    return met.join(reps.select("customer_code", "rep").dropDuplicates(["customer_code"]), "customer_code", "left").select(*own, "customer_code", F.coalesce("rep", F.lit(pooled)).alias("rep"))


def summed(attributed: DataFrame, by: str | Column, amount: str = "amount") -> DataFrame:
    return attributed.groupBy(by).agg(total(amount).alias("amount"), F.count("*").alias("n"))


def reconciled(attributed: DataFrame, amount: str = "amount") -> DataFrame:
    """Attributed and pooled amounts, which add up to the total."""
    known = F.col("customer_code").isNotNull()
    s = lambda c: F.coalesce(total(F.when(c, F.col(amount))), F.lit(0.0))
    return attributed.agg(s(known).alias("attributed"), s(~known).alias("unmatched"), F.coalesce(total(amount), F.lit(0.0)).alias("total"), F.count_if(~known).alias("n_unmatched"))


def monthly_bridge(headers: DataFrame, receipts: DataFrame, returns: DataFrame) -> DataFrame:
    """Billed, collected and returned per month of any of them."""
    part = lambda df, c, n: df.groupBy("month").agg(total(c).alias(n))
    met = part(headers, "reported_total", "billed").join(part(receipts, "amount", "collected"), "month", "full").join(part(returns, "value", "returned"), "month", "full")
    return met.fillna(0.0, ["billed", "collected", "returned"])
