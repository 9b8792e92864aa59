"""Operator 10: quality rules as weak supervision, in DataFrame expressions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Documents are counted by their
pattern of votes (at most 3 ** number of rules patterns, whatever the corpus size); expectation
maximisation over that histogram estimates how each rule votes on good and on bad documents, and
the posterior probability of "good" replaces a test that all rules pass.

Null text counts as empty: no words, nothing repeated, base rule failed, not kept. An empty table
gives an empty result. Repeated rows are judged each for itself; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import SPACE, cut, held, let, may_be_member, member_bits, quoted, table

GRAM = 5


def _grams(words: Column) -> Column:
    """One hash per window of GRAM words, built from pairs, pairs of pairs and a last word."""
    tail = lambda xs, k: F.slice(xs, k + 1, F.size(xs))
    join = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(join(h, tail(h, 1)), lambda two: let(join(two, tail(two, 2)), lambda four: F.slice(join(four, tail(h, 4)), 1, F.size(h) - GRAM + 1))),
    )


def _starts_of_repeats(grams: Column) -> Column:
    """Sorted positions, from 0, of the hashes that stand more than once in grams."""

    def by_sort(pairs: Column) -> Column:
        same_next = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: a["g"].eqNullSafe(b["g"]))

        def hits(same: Column) -> Column:
            either = F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
            return F.sort_array(F.filter(F.zip_with(pairs, either, lambda s, h: F.when(h, s["p"])), lambda p: p.isNotNull()))

        return let(same_next, hits)

    def repeated(ordered: Column) -> Column:
        return F.array_distinct(F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))

    few = lambda d: F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(d, g), i)), lambda p: p.isNotNull())
    many = lambda: let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p")))), by_sort)
    return let(let(F.sort_array(grams), repeated), lambda d: F.when(F.size(d) <= 32, few(d)).otherwise(many()))


def _repeated_words(grams: Column) -> Column:
    """Words covered by windows whose hash stands more than once in grams (one hash per start)."""

    def covered(starts: Column) -> Column:
        widths = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(F.lit(GRAM), b - a), F.lit(GRAM)))
        return F.aggregate(widths, F.lit(0), lambda x, y: x + y)

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(_starts_of_repeats(grams), covered))


def features(text: str = "text") -> Column:
    """A struct of the counts that the base rules and the votes use, over the whole text."""
    whole = F.coalesce(quoted(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")

    def of_words(ws: Column) -> Column:
        n = F.size(ws)
        repeated = F.when(n < GRAM, F.lit(0)).otherwise(let(_grams(ws), _repeated_words))
        return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"))

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(
        let(words, of_words).alias("w"),
        of_lines.alias("l"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(whole, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column _f; a generator, so that no later step computes it again."""
    return docs.select("*", F.explode(F.array(features(text))).alias("_f"))


def base_failed(f: Column) -> Column:
    n = f["w"]["n_words"]
    return (n < 10) | (100 * f["w"]["n_repeat_words"] > 20 * n)


def votes(f: Column) -> list[Column]:
    """The rules; each is 1 (good), -1 (bad) or 0 (abstains)."""
    n, chars = f["w"]["n_words"], F.greatest(f["w"]["word_chars"], F.lit(1))
    per_word = lambda x: x / F.greatest(n, F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = per_word(f["w"]["word_chars"])
    symbols, upper, letters = per_word(f["n_symbols"]), f["n_upper"] / chars, f["n_letters"] / chars
    dup = f["l"]["n_dup_lines"] / F.greatest(f["l"]["n_lines"], F.lit(1))
    repeat = per_word(f["w"]["n_repeat_words"])
    return [
        rule(n < 20, n >= 50),
        rule((mean < 2.5) | (mean > 10), (mean >= 3.5) & (mean <= 7.5)),
        rule(symbols > 0.1, symbols < 0.02),
        rule(dup > 0.3, dup < 0.05),
        rule(repeat > 0.15, repeat < 0.05),
        rule(upper > 0.4, upper < 0.1),
        rule(letters < 0.75, letters >= 0.85),
    ]


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Expectation maximisation over (votes, documents): prior log-odds of good and, per rule, the
    log likelihood ratio of each vote. Rules may be of any accuracy on either class; each class
    starts from the majority of votes, so that "good" stays the class that rules vote for."""
    if not patterns:
        return 0.0, []
    width, total = len(patterns[0][0]), sum(n for _, n in patterns)
    post = [0.5 if not any(v) else (0.9 if min(v) >= 0 else 0.1 if sum(v) < 0 else 0.3) for v, _ in patterns]
    prior, ratios = 0.0, [{}] * width
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        share = min(max(good / total, 0.01), 0.99)
        prior, ratios = math.log(share / (1 - share)), []
        for j in range(width):
            seen = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            seen[1][1] += 0.5
            seen[-1][0] += 0.5
            for p, (v, n) in zip(post, patterns, strict=True):
                seen[v[j]][1] += p * n
                seen[v[j]][0] += (1 - p) * n
            all_bad, all_good = sum(x[0] for x in seen.values()), sum(x[1] for x in seen.values())
            # abstaining says nothing; a vote never speaks against its own side
            ratio = {v: math.log(seen[v][1] / all_good) - math.log(seen[v][0] / all_bad) for v in (-1, 1)}
            ratios.append({-1: min(ratio[-1], 0.0), 0: 0.0, 1: max(ratio[1], 0.0)})
        post = [1 / (1 + math.exp(-min(max(prior + sum(r[x] for r, x in zip(ratios, v, strict=True)), -50), 50))) for v, _ in patterns]
    return prior, ratios


def learn(featured: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """estimate() on the histogram of vote patterns of a table with _f."""
    rules = [f"v{i}" for i, _ in enumerate(votes(F.col("_f")))]
    counted = featured.select(*[v.alias(k) for k, v in zip(rules, votes(F.col("_f")), strict=True)]).groupBy(*rules).count()
    return estimate(sorted((tuple(r[k] for k in rules), r["count"]) for r in counted.collect()))


def posterior(f: Column, model: tuple[float, list[dict[int, float]]]) -> Column:
    prior, ratios = model
    score: Column = F.lit(prior)
    for vote, ratio in zip(votes(f), ratios, strict=False):
        score = score + F.when(vote == 1, ratio[1]).when(vote == -1, ratio[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without their text, plus _f, p_good, base_failed and kept (docs has no columns of these names).
    Texts at the threshold are kept."""
    free = "text_" + "_" * max(map(len, docs.columns))  # no column of docs is as long
    slim = cut(with_features(docs.select(*[quoted(c) for c in docs.columns if c != text], quoted(text).alias(free)), free).drop(free))
    model = learn(slim)
    p = posterior(F.col("_f"), model)
    return slim.withColumns({"p_good": p, "base_failed": base_failed(F.col("_f"))}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are, whatever their names. A row is
    known by the hashes of its text, so that a text is measured once; rows of one text have one verdict."""
    row = held(docs, one=F.xxhash64(quoted(text)), two=F.xxhash64(F.lit(1), quoted(text)))
    measured = cut(docs.select(F.xxhash64(quoted(text)).alias("one"), F.xxhash64(F.lit(1), quoted(text)).alias("two"), F.explode(F.array(features(text))).alias("_f")))
    gone = measured.filter(~(~base_failed(F.col("_f")) & (posterior(F.col("_f"), learn(measured)) >= threshold)))
    rejected = cut(gone.select("one", "two").distinct())
    bitmap = member_bits(rejected, "one")
    hashed = F.xxhash64("one")
    asked = may_be_member(row, hashed, bitmap).join(rejected, ["one", "two"], "left_anti")
    return may_be_member(row, hashed, bitmap, others=True).select("row.*").unionByName(asked.select("row.*"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("_f")
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", f["w"]["n_words"].alias("n_words"), f["w"]["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
        f["l"]["n_dup_lines"].alias("n_dup_lines"), f["w"]["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept", F.round("p_good", 6).alias("p_good"),
    )


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
