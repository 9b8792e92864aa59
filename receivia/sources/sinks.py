"""Writing results: delimited files, JSON documents, nested payloads, processing logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receivia.functions.scalars import finite, invoice_status


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or, where that is unset in local
    mode (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/written-{uuid.uuid4().hex}"


def _finite(c: Column, kind: T.DataType) -> Column:
    """c with NaN and the infinities as null, at any depth of structs, arrays and maps."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    return c


def _holds_floats(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, (T.DoubleType, T.FloatType)) or any(map(_holds_floats, inner))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and the infinities as null, in floating-point columns and in structs, arrays and map values, however
    deep; map keys stay, and so do the nulls of whole structs."""
    return df.withColumns({f.name: _finite(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _holds_floats(f.dataType)})


def payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """Every row as a JSON text without NaN."""
    clean = without_nan(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns])).alias(column))


def logged(df: DataFrame, name: str, good: str) -> tuple[DataFrame, Observation]:
    """df, with an observation that counts its rows and those for which good (SQL) holds."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("found"), F.count_if(F.expr(good)).alias("parsed"), F.count_if(~F.coalesce(F.expr(good), F.lit(False))).alias("failed")), seen


def written_with_log(df: DataFrame, path: str, good: str) -> DataFrame:
    """One row (found, parsed, failed) about df, counted in the pass that writes it as Parquet to path."""
    seen, counts = logged(df, f"log-{uuid.uuid4().hex}", good)
    seen.write.mode("overwrite").parquet(path)
    row = counts.get
    return df.sparkSession.createDataFrame([(row["found"], row["parsed"], row["failed"])], "found long, parsed long, failed long")


def fenced_texts(lines: DataFrame) -> DataFrame:
    """value: a text per invoice in the fenced layout, of lines (invoice_no, invoice_date, customer_code, customer_name,
    reported_total, seq, item_code, item_name, qty, unit_price, discount_pct, tax_pct, line_total). A line
    without a second rate is written without it."""
    row = F.concat_ws(" ", "seq", "item_code", "item_name", "qty", "unit_price", "discount_pct", "tax_pct", "line_total")
    by = lines.groupBy("invoice_no", "invoice_date", "customer_code", "customer_name", "reported_total").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    return by.select(F.concat(F.lit("## invoice "), "invoice_no", F.lit(" — "), F.date_format("invoice_date", "yyyy/M/d"), F.lit("\n```\ncode: "), "customer_code", F.lit("\nname: "), "customer_name", F.lit("\n"), body, F.lit("\n```\ntotal: "), F.format_number("reported_total", 2)).alias("value"))


def piped_texts(lines: DataFrame) -> DataFrame:
    """value: a text per invoice with its items as rows of nine cells; lines as in fenced_texts, and unit."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "seq", "item_code", "item_name", "unit", "qty", "unit_price", "discount_pct", "tax_pct", "line_total"), F.lit(" |"))
    by = lines.groupBy("invoice_no", "invoice_date", "reported_total").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    return by.select(F.concat(F.lit("## invoice "), "invoice_no", F.lit(" — "), F.date_format("invoice_date", "yyyy/M/d"), F.lit("\n"), body, F.lit("\n**total**: "), F.format_number("reported_total", 2)).alias("value"))


def write_blocks(texts: DataFrame, path: str) -> None:
    """A text file of blocks per task."""
    texts.select("value").write.mode("overwrite").text(path)


def failed_examples(df: DataFrame, good: str, key: str, most: int = 15) -> DataFrame:
    """A short list of rows for which good doesn't hold."""
    return df.filter(~F.coalesce(F.expr(good), F.lit(False))).orderBy(key).limit(most)


def export_invoices(invoices: DataFrame, reps: DataFrame) -> DataFrame:
    """invoices with rep (a label where unknown), month and status."""
    named = invoices.join(reps.select("customer_code", F.col("rep").alias("_rep")).dropDuplicates(["customer_code"]), "customer_code", "left")
    return named.withColumns({"rep": F.coalesce("_rep", F.lit("unassigned")), "month": F.date_format("invoice_date", "yyyy-MM"), "status": invoice_status(F.col("reported_total"), F.col("remaining"))}).drop("_rep")
