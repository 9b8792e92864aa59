"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of most contracts.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of narrow tables that make a file worth its while.
ROWS_OF_FILE = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written to the shared checkpoint folder, so that nothing above it runs twice. Where a bound of
    its rows is known, it goes to as few files as that needs.

    The folder is the one the cluster names in spark.checkpoint.dir. Where it is unset, a temporary
    folder is taken in local mode (tests on one machine); on a cluster that is an error, as executors
    would write to disks of their own. Shuffle files of steps that ended before are then given back:
    Spark deletes them once nothing on the driver refers to them, and checkpoints likewise where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpoint keeps the size that Spark estimated for the plan above it, and a join multiplies those of
    its sides: over the rounds of an iteration estimates become numbers of millions of digits, which fill the
    driver. The result is therefore a table of unknown size, which Spark plans by what it measures at run time.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    written = (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_OF_FILE)))).checkpoint(eager=True)
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(written._jdf.queryExecution().toRdd(), written._jdf.schema(), False), spark)
    del df, written
    gc.collect()
    context._jvm.System.gc()
    return out


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def held(df: DataFrame, **own: Column) -> DataFrame:
    """Whole rows of df in a struct column row, beside own columns, whose names so never meet df's."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in own.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


#: Rows and bytes that a Python worker gets at once: texts are long, and a worker should stay small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def in_arrow(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches (the session keeps these settings, as the plan runs later)."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df.mapInArrow(rows, schema)


def in_batches(df: DataFrame, rows: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """in_arrow, as a function of lists of Python values, one list per column of df."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows([c.to_pylist() for c in b.columns] for b in batches)

    return in_arrow(df, run, schema)


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = True):
    """One tokenizer per Python worker; strings of special tokens in texts are plain text or those tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return found


#: Bits per id of the filter that member_bits() makes, and its bits at most: 1 M rows of 64 bits,
#: whatever the number of ids.
BITS_OF_ID, FILTER_BITS = 32, 1 << 26


def member_bits(ids: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """A bitmap of the hashed ids, as rows (word, bits), and its size in bits; to pass over most rows of
    others without a shuffle. It never misses an id; some others pass, so what passes is still to be joined."""
    wanted = ids.select(F.xxhash64(id_col).alias("h"))
    n = wanted.count()
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (BITS_OF_ID * n).bit_length()))
    bit = F.pmod("h", F.lit(size))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    return cut(words, min(n, size >> 6)), size


def may_be_member(docs: DataFrame, hashed: Column, bitmap: tuple[DataFrame, int], *, others: bool = False) -> DataFrame:
    """The rows of docs whose hash the bitmap may hold, or the others. The bitmap goes to every executor:
    FILTER_BITS / 64 rows at most."""
    words, size = bitmap
    at = F.pmod(hashed, F.lit(size))
    hit = (F.shiftright(at, 6) == F.col("word")) & (F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))) != 0)
    return docs.join(F.broadcast(words), hit, "left_anti" if others else "left_semi")
