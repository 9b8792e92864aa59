"""Operator 9: document quality by hierarchical empirical Bayes.

A naive Bayes model over binned style features gives every document its evidence, a log likelihood
ratio.
Grouped aggregation turns the documents' probabilities into a posterior mean per host, shrunk toward
the global mean, and per path of a host, shrunk toward its host: sites with few documents stay near
the prior above them. How strongly is estimated from the groups themselves: the variance between
hosts (and between the paths of a host) beyond what the variance within them explains, by the method
of moments; a prior counts as many documents as its groups' inner variance is times that between
them. A document's own share is taken out of its host and its path before they become its prior, so
that nothing is counted twice; evidence and prior add up in log odds.

The documents table has no url: the query takes source for the host and lang for the path, by
parameters. The model is fitted on all labelled rows by grouped counts (features x bins x two labels
reach the driver). Null text counts as empty; null host or path is one of its own (""). Without labels
the evidence is 0. Repeated rows are scored alike; at p_quality 0.5 a document is kept. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_batches, quoted, table

#: Upper bounds of the bins of each feature.
BINS = {
    "words": (10, 20, 40, 80, 160, 320, 1000, 5000),
    "word_length": (3, 4, 4.5, 5, 5.5, 6, 7, 8),
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.3, 1),
    "capitals": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "repeated_lines": (0.001, 0.05, 0.1, 0.3, 0.6),
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "bars": (0.001, 0.05, 0.2, 0.4),
    "exclamations": (0.001, 0.02, 0.1, 0.5),
    "digits": (0.001, 0.01, 0.05, 0.2),
}
DAMPING = 0.7
#: Sites (hosts and paths) that go to every executor; more meet the documents in a shuffle.
BROADCAST_SITES = 100_000
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))


def _measures(text: bytes) -> tuple[float, ...]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    count = lambda chars: size - len(text.translate(None, chars)) if text else 0
    return (
        len(words), sum(map(len, words)) / n, count(_SYMBOLS) / n, count(_CAPITALS) / size, 1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n, text.count(b"|") / n, text.count(b"!") / n, count(_DIGITS) / size,
    )


def binned(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """doc_id, host, path, bins of every row."""

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        for ids, hosts, paths, texts in batches:
            m = np.array([_measures(t or b"") for t in texts]).reshape(-1, len(BINS))
            bins = np.stack([np.searchsorted(b, m[:, j], "left") for j, b in enumerate(BINS.values())], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(bins), pa.list_(pa.int32()))], ["doc_id", "host", "path", "bins"])

    slim = docs.select(quoted(id_col).cast("long"), F.coalesce(quoted(host_col), F.lit("")), F.coalesce(quoted(path_col), F.lit("")), quoted(text_col).cast("binary"))
    return in_batches(slim, rows, "doc_id long, host string, path string, bins array<int>")


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[float, list[list[float]]]:
    """Prior log odds, and per feature the log likelihood ratio of each bin."""
    known = features.join(labels.filter(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("_y")).distinct(), "doc_id")
    counts = known.select("_y", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "_y").count().collect()
    n = [np.full((len(b) + 1, 2), 0.5) for b in BINS.values()]
    for r in counts:
        n[r["feature"]][r["bin"], int(r["_y"] > 0)] += r["count"]
    if not counts:
        return 0.0, [[0.0] * len(x) for x in n]
    whole = n[0].sum(axis=0)
    return math.log(whole[1] / whole[0]), [(np.log(x[:, 1] / x[:, 1].sum()) - np.log(x[:, 0] / x[:, 0].sum())).tolist() for x in n]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, host, path, p_document, p_host, p_path and p_quality of every row of docs."""
    features = cut(binned(docs, id_col, text_col, host_col, path_col))
    prior, ratios = fit(features, labels)
    evidence: Column = F.lit(0.0)
    for j, ratio in enumerate(ratios):
        evidence = evidence + F.element_at(F.array(*map(F.lit, ratio)), F.col("bins")[j] + 1)
    single = features.select("doc_id", "host", "path", (evidence * DAMPING).alias("evidence")).withColumn("p_document", 1 / (1 + F.exp(-(F.col("evidence") + prior))))
    p = F.col("p_document")
    paths = cut(single.groupBy("host", "path").agg(F.sum(p).alias("path_sum"), F.sum(p * p).alias("path_square"), F.count("*").alias("path_n")))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    middle, host_weight, path_weight = strengths(paths)
    found = cut(paths.join(hosts, "host"))
    small = F.broadcast(found) if found.count() <= BROADCAST_SITES else found
    met = single.join(small, ["host", "path"])

    def shrunk(own: Column | float, less: int) -> tuple[Column, Column]:
        host = (F.col("host_sum") - own + host_weight * middle) / (F.col("host_n") - less + host_weight)
        return host, (F.col("path_sum") - own + path_weight * host) / (F.col("path_n") - less + path_weight)

    p_host, p_path = shrunk(F.lit(0.0), 0)
    others = F.least(F.greatest(shrunk(p, 1)[1], F.lit(1e-6)), F.lit(1 - 1e-6))
    return met.withColumns({"p_host": p_host, "p_path": p_path, "p_quality": 1 / (1 + F.exp(-(F.col("evidence") + _logit(others))))}).select("doc_id", "host", "path", "p_document", "p_host", "p_path", "p_quality")


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """The global mean, and how many documents the priors of hosts and of paths count as; paths has the
    sum, the sum of squares and the number of the probabilities of each path of each host."""
    s, n = F.col("path_sum"), F.col("path_n")
    hosts = paths.groupBy("host").agg(F.sum(s).alias("s"), F.sum("path_square").alias("q"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(s * s / n).alias("between"), F.sum(n * n).alias("nn"))
    x = hosts.agg(*[F.sum(c).cast("double").alias(k) for k, c in {"s": F.col("s"), "q": F.col("q"), "n": F.col("n"), "k": F.col("k"), "paths": F.col("between"), "inner": F.col("nn") / F.col("n"), "hosts": F.col("s") * F.col("s") / F.col("n"), "nn": F.col("n") * F.col("n")}.items()], F.count("*").alias("g")).first()
    if not x["n"]:
        return 0.5, LEAST, LEAST
    middle = x["s"] / x["n"]
    return middle, weight(x["hosts"] - x["s"] * middle, x["q"] - x["hosts"], x["n"], x["g"], 1, x["nn"] / x["n"]), weight(x["paths"] - x["hosts"], x["q"] - x["paths"], x["n"], x["k"], x["g"], x["inner"])


#: Bounds of a prior's strength, in documents.
LEAST, MOST = 1.0, 1e6


def weight(between: float, within: float, n: float, groups: float, above: float, crowd: float) -> float:
    """Variance within groups over the variance between them, from their sums of squares: n values in
    groups, which lie in so many above; crowd is the sum over those above of squared group sizes by size."""
    inner = within / max(1.0, n - groups)
    outer = (between - (groups - above) * inner) / (n - crowd) if n > crowd else 0.0
    return min(MOST, max(LEAST, inner / outer)) if outer > 0 else MOST


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "host", "path", *[F.round(c, 6).alias(c) for c in ("p_document", "p_host", "p_path", "p_quality")], (F.col("p_quality") >= 0.5).alias("kept"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
