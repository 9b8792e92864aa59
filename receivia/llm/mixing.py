"""Operator 6: mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is found by bisection (in
PARTS parts at once, each pass one aggregation over the sources): the largest (nearest to the natural
shares) whose weights reach the target entropy, as a share of the greatest possible, and not below the
one at which no source is repeated more often than max_repeat. Weights are realised by block
permutations: a source's documents are dealt by a seeded hash into blocks, and every pass over the
source takes its blocks in an order of its own. The token budget is spent on whole passes and then on
blocks of a last pass in its order, the last of them as far as documents (by hash) still fit. A used
copy of a document has its pass, its block and its position in the mixture, between 0 and 1: how much of
its source's budget was spent before its block. In order of position the sources alternate by weight,
and copies of one document stand a pass apart.

A null source is a source of its own (""). Null text counts as no tokens; a source without tokens is
used once. Null and shared ids are no matter, each row is a document of its own; of rows that share id
and text, which ones a partial pass takes depends on their place in the input. Ties in position stand in
the order of the documents' hashes. Very long texts are counted whole; a document longer than what is left
of a budget ends it.
If the corpus has no tokens, or the table is empty, every document is used once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.llm.common import SPACE, cut, held, quoted, table

#: Sources whose plan goes to every executor; the plan of more meets the documents in a shuffle.
BROADCAST_SOURCES = 100_000
PARTS, PASSES = 32, 8


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def _moments(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent a: the sums over sources of n ** a and of n ** a * ln n."""
    n = F.col("n").cast("double")
    raised = totals.select(n.alias("n"), F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("p", F.pow("n", "a"))
    return {r["a"]: (r["s"], r["t"]) for r in raised.groupBy("a").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.log("n")).alias("t")).collect()}


def exponent_for(totals: DataFrame, budget: float, target: float, max_repeat: float) -> float:
    """The exponent in [0, 1] for totals (n, the tokens of each source); the repetition limit goes before
    the entropy."""
    used = totals.filter("n > 0")
    count, whole, least = used.agg(F.count("*"), F.sum("n"), F.min("n")).first()
    if count < 2:
        return 1.0
    if budget > max_repeat * whole:
        raise ValueError("the budget repeats every source more often than max_repeat")

    def reached(a: float, s: float, t: float) -> bool:
        return math.log(s) - a * t / s >= target * math.log(count) - 1e-12

    def within(a: float, s: float, t: float) -> bool:
        return budget * least ** (a - 1) / s <= max_repeat * (1 + 1e-12)  # the smallest source is repeated most

    # entropy falls with the exponent, and so do repetitions: [a, b] holds the end of each
    entropy, repeat = (0.0, 1.0), (0.0, 1.0)
    for _ in range(PASSES):
        steps = lambda x: [x[0] + (x[1] - x[0]) * k / PARTS for k in range(PARTS + 1)]
        seen = _moments(used, sorted({*steps(entropy), *steps(repeat)}))
        good = max((a for a in steps(entropy) if reached(a, *seen[a])), default=entropy[0])
        entropy = (good, min((a for a in steps(entropy) if a > good), default=good))
        good = min((a for a in steps(repeat) if within(a, *seen[a])), default=repeat[1])
        repeat = (max((a for a in steps(repeat) if a < good), default=good), good)
    return max(entropy[0], repeat[1])


def _hash(seed: int, *of) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def sized_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, carry: bool) -> DataFrame:
    """doc_id, source, n_tokens and h of every row of docs, and the row itself if carry. Documents are dealt
    by a hash of id and text; rows that share both are told apart by their place in the input, which is
    written with them, so that no two rows go in or out together. Most hashes are of one row."""
    own = {"doc_id": quoted(id_col), "source": F.coalesce(quoted(source_col), F.lit("")), "n_tokens": words(quoted(text_col)), "hash": _hash(seed, quoted(id_col), quoted(text_col))}
    rows = held(docs, **own)
    shared = cut(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("hash").alias("again")))
    told = rows.withColumn("place", F.monotonically_increasing_id()).join(_small(shared), F.col("hash") == F.col("again"), "left")
    h = F.when(F.col("again").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", "place"))
    return cut(told.select(*(["row"] if carry else []), "doc_id", "source", "n_tokens", h.alias("h")))


def shares(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: float = 0.95, max_repeat: float = 4.0, budget: int | None = None, seed: int = 7, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per source (source, n, weight, passes, rest, blocks, last and cutoff: the last block of the
    last pass and the last hash in it), and the documents (doc_id, source, n_tokens, h; and row if carry)."""
    sized = sized_rows(docs, id_col, source_col, text_col, seed, carry)
    totals = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    spend = float(whole if budget is None else budget)
    exponent = exponent_for(totals, spend, target, max_repeat)
    scale = _moments(totals.filter("n > 0"), [exponent]).get(exponent, (1.0, 0.0))[0]
    weight = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(exponent)) / scale).otherwise(0.0)
    whole_passes = F.when(F.col("n") > 0, F.floor(F.col("weight") * spend / F.col("n") + 1e-9)).otherwise(1)
    plan = totals.withColumn("weight", weight).withColumn("passes", whole_passes.cast("long")).select(
        "source", "n", "weight", "passes", F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.col("weight") * spend - F.col("passes") * F.col("n"))).otherwise(0.0).alias("rest"), F.greatest(F.lit(1), F.floor(F.sqrt("docs"))).cast("long").alias("blocks"),
    )
    dealt = sized.join(_small(plan), "source").withColumn("turn", turn(F.col("passes"), block(), seed))
    by_block = dealt.groupBy("source", "turn", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("through", F.sum("n").over(W.partitionBy("source").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)))
    last = cut(by_block.filter("through > rest").groupBy("source").agg(F.min(F.struct("turn", (F.col("through") - F.col("n")).alias("before"))).alias("b")).select("source", F.col("b.turn").alias("last"), F.col("b.before").alias("before")))
    inside = dealt.join(_small(last), "source").filter("turn = last").groupBy("source", "h", "before", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("sum", F.col("before") + F.sum("n").over(W.partitionBy("source").orderBy("h")))
    ends = inside.filter("sum <= rest").groupBy("source").agg(F.max("h").alias("cutoff"))
    return cut(plan.join(last.select("source", "last"), "source", "left").join(ends, "source", "left")), sized


def _small(by_source: DataFrame) -> DataFrame:
    """A table of checked size, for every executor; a larger one stays as it is."""
    return F.broadcast(by_source) if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else by_source


def block() -> Column:
    """A document's block, from its hash h and its source's row."""
    return F.pmod("h", "blocks")


def turn(pass_: Column, block_: Column, seed: int) -> Column:
    """Where a block stands in the permutation of a pass: a hash, with the block for ties."""
    return F.struct(_hash(seed + 1, pass_, block_, F.col("source")).alias("hash"), block_.alias("block"))


def copies(seed: int = 7) -> Column:
    """How often a document is used, from its hash and its source's row."""
    own = turn(F.col("passes"), block(), seed)
    extra = F.when(F.col("last").isNull(), F.col("rest") > 0).otherwise((own < F.col("last")) | ((own == F.col("last")) & F.coalesce(F.col("h") <= F.col("cutoff"), F.lit(False))))
    return F.col("passes") + extra.cast("long")


def used(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (with source and h) and plan, once for each used copy, with pass, block and position."""
    met = rows.join(_small(plan), "source").withColumn("copies", copies(seed)).filter("copies > 0")
    each = met.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("block", block())
    spent = F.col("pass") + _hash(seed + 1, F.col("pass"), F.col("block"), F.col("source")) / F.lit(2.0**64) + 0.5
    return each.withColumn("position", F.least(F.lit(1.0), spent / F.greatest(F.col("passes") + F.coalesce(F.try_divide("rest", "n"), F.lit(0.0)), F.lit(1e-9))))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **how) -> DataFrame:
    """The rows of docs as often as their source's budget uses them, in order of their position in the
    mixture; columns as they are, whatever their names."""
    plan, rows = shares(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, carry=True, **how)
    return used(rows.select("row", "source", "h"), plan, seed).select("row", "position", "h").repartitionByRange("position", "h").sortWithinPartitions("position", "h").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every used copy of every document."""
    plan, sized = shares(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return used(sized, plan, 7).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "pass", "block", F.round("position", 9).alias("position"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
