"""The sales model over the test tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, CUTOFF = "2001-08-02", "2001-07-17"


@dataclass(frozen=True)
class Sales:
    """Tables of one data set; each is read when used, with the columns that are used."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def customers(self) -> DataFrame:
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any scale
        net = F.round(F.col("c_acctbal") * 100, 2).cast("decimal(14,2)")
        return self.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").cast("string").alias("customer_code"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("rep"), F.col("r_name").alias("city"), net.alias("net"),
            F.greatest(net, F.lit(0)).alias("debit"), F.greatest(-net, F.lit(0)).alias("credit"),
        )

    @property
    def headers(self) -> DataFrame:
        total = F.col("o_totalprice").cast("decimal(12,2)")
        paid = F.when(F.col("o_orderstatus") == "F", total).when(F.col("o_orderstatus") == "O", total * 0).otherwise(total / 2)
        left = F.when(F.col("o_orderstatus") == "F", total * 0).when(F.col("o_orderstatus") == "O", total).otherwise(total / 2)
        return self.table("orders").select(
            F.col("o_orderkey").alias("invoice_no"), F.col("o_orderdate").cast("date").alias("invoice_date"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").cast("string").alias("customer_code"),
            total.alias("reported_total"), paid.cast("decimal(14,3)").alias("paid"), left.cast("decimal(14,3)").alias("remaining"), F.col("o_orderstatus").alias("status"),
        )

    @property
    def rows(self) -> DataFrame:
        """Lines as they stand, without a join: what knows neither date nor customer needs no more."""
        d, t = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
        gross, qty = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_quantity").cast("decimal(12,2)")
        free = (d == F.lit("0.10").cast("decimal(4,2)")) & (F.col("l_returnflag") == "R")
        rest = lambda x: (F.lit(1) - x).cast("decimal(5,2)")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("invoice_no"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").cast("string").alias("item_code"), qty.alias("qty"), gross.alias("gross"), d.alias("disc"), t.alias("tax"), free.alias("is_bonus"),
            F.when(free, F.lit(0)).otherwise(gross * rest(d) * rest(t)).cast("decimal(20,6)").alias("line_total"), F.when(free, F.lit(0.0)).otherwise(gross.cast("double") / qty.cast("double")).alias("unit_price"),
        )

    @property
    def _dated(self) -> DataFrame:
        return self.headers.select("invoice_no", "invoice_date", "month", "customer_code")

    @property
    def sold(self) -> DataFrame:
        """Lines with their invoice's date and customer. A task holds its invoices, few and narrow, in a hash table that
        lines pass by; to sort both sides it would hold its lines too."""
        return self.rows.join(self._dated.hint("shuffle_hash"), "invoice_no")

    @property
    def dealt(self) -> DataFrame:
        """sold, over four tasks at least for each that reads lines: a task holds the invoices of a quarter of a file's split,
        and no more of them when data grows. A session with as many shuffle partitions deals by these, which Spark joins
        to pieces of a size (numbers given by hand it would keep). Up to 200 tasks no lines wait in memory to be dealt
        either; beyond, those of one split do."""
        n = 4 * self.table("lineitem").rdd.getNumPartitions()
        if n <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return self.sold
        return self.rows.repartition(n, "invoice_no").join(self._dated.repartition(n, "invoice_no").hint("shuffle_hash"), "invoice_no")

    @property
    def items(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("item_code"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("pack"))

    @property
    def goods(self) -> DataFrame:
        """Lines with their invoice and item."""
        return self.sold.join(self.items, "item_code")

    @property
    def lines(self) -> DataFrame:
        """Lines with all that is known of them. Customers meet invoices before lines do, and items meet lines first:
        lines move twice, and then lie by invoice, where what is asked of invoices finds them."""
        invoices = self.headers.select("invoice_no", "invoice_date", "month", "customer_code").join(self.customers.select("customer_code", "customer_name", "rep", "city"), "customer_code")
        met = self.rows.join(self.items, "item_code").join(invoices, "invoice_no")
        return met.select("customer_code", "item_code", "invoice_no", "seq", "qty", "gross", "disc", "tax", "is_bonus", "line_total", "unit_price", "invoice_date", "month", "item_name", "brand", "pack", "customer_name", "rep", "city")

    def _events(self, kind: str) -> DataFrame:
        return self.table("events").filter(F.col("event_type") == kind).select(
            F.col("ts").cast("date").alias("date"), F.date_format("ts", "yyyy-MM").alias("month"), F.format_string("Customer#%09d", F.col("user_id")).alias("customer_name"), F.col("user_id").cast("string").alias("customer_code"),
            F.col("value").cast("decimal(14,2)").alias("amount"), F.col("event_id").alias("doc_ref"), F.col("event_type").alias("method"),
        )

    @property
    def receipts(self) -> DataFrame:
        return self._events("purchase")

    @property
    def returns(self) -> DataFrame:
        return self._events("error").withColumn("value", F.col("amount"))


CUSTOMERS = """customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name, n_name AS rep, r_name AS city,
    CAST(round(c_acctbal * 100, 2) AS DECIMAL(14,2)) AS net, greatest(CAST(round(c_acctbal * 100, 2) AS DECIMAL(14,2)), 0) AS debit, greatest(-CAST(round(c_acctbal * 100, 2) AS DECIMAL(14,2)), 0) AS credit
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HEADERS = """headers AS (
  SELECT o_orderkey AS invoice_no, CAST(o_orderdate AS DATE) AS invoice_date, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey AS VARCHAR) AS customer_code,
    CAST(o_totalprice AS DECIMAL(12,2)) AS reported_total, o_orderstatus AS status,
    CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(12,2)) * 1.0 WHEN 'O' THEN 0.0 ELSE CAST(o_totalprice AS DECIMAL(12,2)) * 0.5 END AS paid,
    CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN CAST(o_totalprice AS DECIMAL(12,2)) * 1.0 ELSE CAST(o_totalprice AS DECIMAL(12,2)) * 0.5 END AS remaining
  FROM orders)"""
LINES = """raw_lines AS (
  SELECT l_orderkey AS invoice_no, l_linenumber AS seq, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
    CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_discount AS DECIMAL(4,2)) = CAST(0.10 AS DECIMAL(4,2)) AND l_returnflag = 'R' AS is_bonus
  FROM lineitem), lines AS (
  SELECT l.invoice_no, seq, h.invoice_date, h.month, h.customer_code, c.customer_name, c.rep, c.city, CAST(p_partkey AS VARCHAR) AS item_code, p_name AS item_name, p_brand AS brand, p_size AS pack,
    qty, gross, disc, tax, is_bonus, CASE WHEN is_bonus THEN 0 ELSE CAST(gross * CAST(1 - disc AS DECIMAL(5,2)) * CAST(1 - tax AS DECIMAL(5,2)) AS DECIMAL(20,6)) END AS line_total,
    CASE WHEN is_bonus THEN 0.0 ELSE CAST(gross AS DOUBLE) / CAST(qty AS DOUBLE) END AS unit_price
  FROM raw_lines l JOIN headers h ON l.invoice_no = h.invoice_no JOIN part ON l_partkey = p_partkey JOIN customers c ON h.customer_code = c.customer_code)"""


def _events(name: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m') AS month, printf('Customer#%09d', user_id) AS customer_name, CAST(user_id AS VARCHAR) AS customer_code, CAST(value AS DECIMAL(14,2)) AS amount, event_id AS doc_ref
  FROM events WHERE event_type = '{kind}')"""


RECEIPTS, RETURNS = _events("receipts", "purchase"), _events("returns", "error")


def sql(body: str) -> str:
    """body after the tables of the model."""
    return "WITH " + ", ".join([CUSTOMERS, HEADERS, LINES, RECEIPTS, RETURNS]) + body
