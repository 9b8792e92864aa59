"""Typed reading: delimited and JSON files, invoice texts, word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receivia.functions.scalars import parse_date, parse_number


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """With a header and a declared schema; codes stay text because the schema says so."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_as_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_files_with_attribute(spark: SparkSession, path: str, schema: str, column: str, pattern: str) -> DataFrame:
    """Many CSV files; column is taken out of each file's name by the pattern's first group."""
    found = read_csv(spark, path, schema)
    return found.select("*", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias(column))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent file gives an empty table with the schema."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


def reference_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, to be broadcast."""
    return spark.createDataFrame(rows, schema)


def union_by_precedence(main: DataFrame, other: DataFrame, owned_by_other: Column, year: int | None = None, date_col: str = "invoice_date") -> DataFrame:
    """Rows of both, where other alone speaks for what owned_by_other selects."""
    both = main.filter(~F.coalesce(owned_by_other, F.lit(False))).unionByName(other.filter(owned_by_other), allowMissingColumns=True)
    return both if year is None else both.filter(F.year(date_col) == year)


_NUMBER = r"^-?[\d,]+(\.\d+)?-?$"
#: What the fields of an invoice text are called, as patterns; callers with texts in another language give their own.
LABELS = {"code": "code", "name": "name|customer", "phone": "phone", "total": "total", "paid": "paid", "remaining": "remaining", "quantity": "quantity", "bonus": "bonus"}


def read_blocks(spark: SparkSession, path: str, heading: str = "## ") -> DataFrame:
    """value: the texts from one heading to the next. Files are split at the line ends before headings, so that
    one very large file is many tasks; a text before the first heading is a block too. Blocks end in Unix lines."""
    found = spark.read.option("lineSep", f"\n{heading}").text(path)
    return found.select(F.regexp_replace("value", rf"^\Q{heading}\E", "").alias("value"))


def fenced_body(value: Column) -> Column:
    """What stands between the first pair of code fences; all of it where there is none."""
    inside = F.regexp_extract(value, r"(?s)(?:^|\n)\s*```[^\n]*\n(.*?)(?:\n\s*```|$)", 1)
    return F.when(value.contains("```"), inside).otherwise(value)


def fenced_invoices(blocks: DataFrame, *, least_numbers: int = 5, customer_lines: int = 5, labels: dict[str, str] = LABELS) -> DataFrame:
    """Item lines of invoice texts in the fenced layout; blocks has one text per "## " heading.

    The heading is `label number — Y/M/D`; the first lines after it (or of the fenced body) name the customer
    as `key: value` with the names of labels; an item line is a sequence number, a code, a name and at least
    least_numbers numbers (quantity, price, two rates, total; with one fewer the second rate is missing and null).
    """
    head = F.regexp_extract("value", r"(?m)^(?:## )?[^\n]*?(\S+)\s+[—-]\s+(\d{4}/\d{1,2}/\d{1,2})", 1)
    date = F.regexp_extract("value", r"(?m)^(?:## )?[^\n]*?\S+\s+[—-]\s+(\d{4}/\d{1,2}/\d{1,2})", 1)
    first = F.array_join(F.slice(F.split("_body", "\n"), 1, customer_lines + 2), "\n")
    field = lambda k: F.nullif(F.trim(F.regexp_extract(first, rf"(?m)^\s*(?:{labels[k]})\s*:\s*([^\n]*)$", 1)), F.lit(""))
    foot = lambda k: parse_number(F.regexp_extract("value", rf"(?m)^\s*(?:{labels[k]})\s*:\s*(-?[\d,.]+)", 1))
    whole = blocks.withColumn("_body", fenced_body(F.col("value"))).filter(head != "").select(
        head.alias("invoice_no"), parse_date(date).alias("invoice_date"), field("code").alias("customer_code"), field("name").alias("customer_name"), field("phone").alias("phone"),
        foot("total").alias("invoice_reported_total"), foot("paid").alias("paid"), foot("remaining").alias("remaining"), foot("quantity").alias("qty_total"), F.lower("value").rlike(labels["bonus"].lower()).alias("is_bonus"), F.split("_body", "\n").alias("_lines"),
    )
    rows = whole.withColumn("_line", F.explode("_lines")).withColumn("_t", F.split(F.trim("_line"), r"\s+"))
    numeric = F.transform("_t", lambda t: t.rlike(_NUMBER))
    tail = F.size("_t") - F.coalesce(F.array_position(F.reverse(numeric), False), F.size("_t") + 1).cast("int") + 1  # where the last run of numbers starts
    counted = rows.withColumn("_n", F.size("_t") - tail).filter((F.col("_n") >= least_numbers) & (F.size("_t") >= F.col("_n") + 3) & F.col("_t")[0].rlike(r"^\d+$"))
    back = lambda k: parse_number(F.try_element_at("_t", F.lit(-k)))
    full = F.col("_n") >= 5
    return counted.select(
        *[c for c in whole.columns if c != "_lines"], F.col("_t")[0].cast("int").alias("seq"), F.col("_t")[1].alias("item_code"),
        F.array_join(F.slice("_t", F.lit(3), F.size("_t") - 2 - F.least("_n", F.lit(5))), " ").alias("item_name"),
        F.when(full, back(5)).otherwise(back(4)).alias("qty"), F.when(full, back(4)).otherwise(back(3)).alias("unit_price"), F.when(full, back(3)).otherwise(back(2)).alias("discount_pct"), F.when(full, back(2)).alias("tax_pct"), back(1).alias("line_total"),
    )


def piped_invoices(blocks: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """Item lines of invoice texts whose items are rows of nine cells between pipes."""
    foot = lambda k: parse_number(F.regexp_extract("value", rf"\*\*(?:{labels[k]})\*\*\s*:?\s*(-?[\d,.]+)", 1))
    head = blocks.select(
        F.regexp_extract("value", r"(?m)^(?:## )?[^\n]*?(\S+)\s+[—-]\s+\d{4}/", 1).alias("invoice_no"), parse_date(F.regexp_extract("value", r"(\d{4}/\d{1,2}/\d{1,2})", 1)).alias("invoice_date"),
        foot("total").alias("invoice_reported_total"), foot("paid").alias("paid"), foot("remaining").alias("remaining"), F.explode(F.split("value", "\n")).alias("_line"),
    )
    cells = head.withColumn("_c", F.transform(F.split(F.regexp_replace(F.trim("_line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))).filter(F.trim("_line").startswith("|") & (F.size("_c") == 9) & F.col("_c")[0].rlike(r"^\d+$"))
    cell = lambda i: parse_number(F.col("_c")[i])
    return cells.select("invoice_no", "invoice_date", "invoice_reported_total", "paid", "remaining", F.col("_c")[0].cast("int").alias("seq"), F.col("_c")[1].alias("item_code"), F.col("_c")[2].alias("item_name"), F.col("_c")[3].alias("unit"), cell(4).alias("qty"), cell(5).alias("unit_price"), cell(6).alias("discount_pct"), cell(7).alias("tax_pct"), cell(8).alias("line_total"))


def page_rows(words: DataFrame, gap: float) -> DataFrame:
    """words (doc, page, x0, y0, word) with a row number from 1, new where y0 jumps by more than gap."""
    w = W.partitionBy("doc", "page").orderBy("y0", "x0")
    jump = (F.col("y0") - F.lag("y0").over(w) > gap).cast("int")
    return words.withColumn("_j", F.coalesce(jump, F.lit(1))).withColumn("row", F.sum("_j").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_j")


def page_table(words: DataFrame, gap: float, bands: list[tuple[str, float, float]]) -> DataFrame:
    """One record per row of a page: the words of each x band, right to left."""
    band = lambda name, lo, hi: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("x0") >= lo) & (F.col("x0") < hi), F.struct("x0", "word"))), asc=False), lambda s: s["word"]), " ").alias(name)
    return page_rows(words, gap).groupBy("doc", "page", "row").agg(*(band(*b) for b in bands))
