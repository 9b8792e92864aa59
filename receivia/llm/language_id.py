"""Operator 8: language identification by mixture inference over n-gram likelihoods.

Training counts hashed byte trigrams (letters in lower case, other ASCII as blanks) per language in
grouped aggregation over all training rows; the model is one row of BUCKETS log probabilities per
language, of fewer buckets where there are over 256 languages, so that it never exceeds MODEL numbers.
A document is read as runs of RUN trigrams. Expectation maximisation estimates the share
of each language among its runs, for the one, two, ... most likely languages up to all learned ones, and the set with the
highest likelihood, less a penalty per language as in the Bayesian information criterion, is taken.
The prediction is the language with the largest share, the score that share.

Null text, text without a letter and an empty training table give "und" with score 0. Whole texts
are read. Repeated rows are judged each for itself; of equally likely languages the first by name wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_batches, quoted, table

BUCKETS, RUN, ROUNDS = 1 << 16, 32, 12
#: Numbers of a model at most; it goes to every executor.
MODEL = 1 << 24
#: Bytes that a worker takes in hand at once; one longer text is taken alone.
AT_ONCE = 1 << 20
_KEPT = bytes(c if c >= 0x61 and c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _letters(text: str | None) -> bytes:
    """text as lower-case bytes with one blank around, or nothing if it has no letter."""
    if not text:
        return b""
    parted = b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split())
    ascii_ = any(c < 0x80 and c != 0x20 for c in parted[:200])
    return b" " + parted + b" " if parted and (ascii_ or any(c.isalpha() for c in text)) else b""


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.intp)


def _groups(texts: list[bytes]) -> Iterator[range]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > AT_ONCE:
            yield range(start, i)
            start, held = i, 0
        held += len(t)
    yield range(start, len(texts))


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows of docs with a language."""

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for texts, langs in batches:
            parted = [_letters(t) for t in texts]
            for group in _groups(parted):
                for lang in {langs[i] for i in group}:
                    if data := b"".join(parted[i] for i in group if langs[i] == lang):
                        counts[lang] = counts.get(lang, 0) + np.bincount(_grams(data), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.filter(quoted(lang_col).isNotNull()).select(quoted(text_col), quoted(lang_col))
    return in_batches(known, rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, MODEL numbers at most, and so are the counts that reach the driver."""
    counted = cut(count_grams(docs, text_col, lang_col))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    width = BUCKETS
    while width > 1 and width * len(langs) > MODEL:
        width //= 2
    found = counted.groupBy("lang", F.pmod("bucket", F.lit(width)).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(langs), width), 0.2)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        n[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def shares(likelihood: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Language shares of each document; likelihood has a row per run, starts and sizes the runs of
    each document."""
    langs = likelihood.shape[1]
    of = np.repeat(np.arange(len(sizes)), sizes)
    top = likelihood.max(axis=1, keepdims=True)
    p = np.exp(likelihood - top)
    whole = np.add.reduceat(likelihood, starts, axis=0)
    order = np.argsort(-whole, axis=1, kind="stable")
    best, chosen = np.full(len(sizes), -np.inf), np.zeros((len(sizes), langs))
    # order of entry: the most likely language, then those that explain most runs beside it
    wins = np.add.reduceat((p >= 1).astype(np.float64), starts, axis=0)
    wins[np.arange(len(sizes)), order[:, 0]] = np.inf
    order = np.argsort(-wins, axis=1, kind="stable")
    for k in range(1, langs + 1):
        pi = np.zeros((len(sizes), langs))
        np.put_along_axis(pi, order[:, :k], 1.0 / k, axis=1)
        for _ in range(ROUNDS if k > 1 else 0):
            r = p * pi[of] + 1e-30
            r /= r.sum(axis=1, keepdims=True)
            pi = np.where(pi > 0, np.add.reduceat(r, starts, axis=0) / sizes[:, None], 0)
            pi /= pi.sum(axis=1, keepdims=True)
        fit = np.add.reduceat(np.log((p * pi[of]).sum(axis=1) + 1e-30) + top[:, 0], starts) - 0.5 * (k - 1) * np.log(sizes + 1.0) - 3.0 * (k - 1)
        better = fit > best
        best, chosen = np.where(better, fit, best), np.where(better[:, None], pi, chosen)
    return chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages (the chosen set, largest share first)."""
    langs, logs = model
    table_ = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T)) if langs else None

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches:
            parted = [_letters(t) for t in texts]
            preds, scores, sets = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
            for group in _groups(parted) if langs else ():
                own = [i for i in group if len(parted[i]) > 2]
                if not own:
                    continue
                runs, sizes = [], []
                for i in own:
                    grams = _grams(parted[i]) % table_.value.shape[0]
                    cuts = np.arange(0, len(grams), RUN)
                    runs.append(np.add.reduceat(table_.value[grams], cuts, axis=0))
                    sizes.append(len(cuts))
                size = np.array(sizes)
                pi = shares(np.concatenate(runs).astype(np.float64), np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                for i, share in zip(own, pi, strict=True):
                    by = np.argsort(-share, kind="stable")
                    preds[i], scores[i], sets[i] = langs[by[0]], float(min(1.0, share[by[0]])), [langs[k] for k in by if share[k] > 0.02]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return in_batches(slim, rows, "doc_id long, lang_pred string, score double, languages array<string>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
