"""Operator 7: exact top-k by inner product with a table of pivot distances.

The index holds, for every vector, its distances to PIVOTS pivots. By the triangle inequality the
largest |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), hence
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product. A first round gives every query
the k-th best of its scores with SCOUTS vectors, a bounded sample that goes to all executors: no worse
score can be among its k best. Then queries and vectors meet in blocks of bounded size; within a block a
query evaluates the vectors with the highest bounds first, and of the others those whose bounds reach
the k-th best score known by then, so nothing that could enter is skipped. Only scores that reach it
leave the block, about k * n / SCOUTS of n for a query, and are merged per query.

Pivots and scouts are those with the smallest hash of their id; they change only how early a search
stops. Components become floor(64 * x); vectors that are null, or hold a null or non-finite component,
or have a null id, take no part. Shorter vectors count as ending in zeros. Ties go to the smaller id.
Rows that share a vec_id are vectors of their own: none meets its own id, and what their queries find is
ranked together. Scores are exact while they stay below 2 ** 53. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_arrow, quoted, table

K, SCALE, PIVOTS, SAMPLE, SCOUTS, QUERY_BLOCK, BLOCK = 20, 64, 16, 512, 32_768, 4096, 4096
#: Bytes of scouts, as doubles, at most: of wider vectors there are fewer.
SCOUT_BYTES = 1 << 24
#: Queries that a task holds against a block at once.
TILE = 256
#: Room for rounding in the bounds; scores are whole numbers.
SLACK = 0.25


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, whole numbers as doubles, of the vectors that take part."""
    v = quoted(vector_col)
    fine = v.isNotNull() & quoted(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(quoted(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _first(vectors: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows with the smallest hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow()
    return rows.column("vec_id").to_numpy(), _matrix(rows.column("v").to_pylist(), width)


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Pivots far from each other, out of a bounded sample."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(PIVOTS, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def index(vectors: DataFrame, pivots: np.ndarray, width: int, kind: type) -> DataFrame:
    """vec_id, the vector and its pivot distances, both as bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), width)
            d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([x.tobytes() for x in m.astype(kind)], pa.binary()), pa.array([x.tobytes() for x in d.astype(kind)], pa.binary())], ["vec_id", "v", "d"])

    return in_arrow(vectors, rows, "vec_id long, v binary, d binary")


def _vectors(column: Iterable[bytes], n: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(n, -1)


def with_least(queries: DataFrame, scouts, k: int, kind: type) -> DataFrame:
    """Indexed queries with least, the k-th best of their scores with the (broadcast) scouts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = scouts.value
        for b in batches:
            own = b.column("vec_id").to_numpy()
            q = _vectors(b.column("v").to_pylist(), len(own), kind)
            least = np.full(len(own), -np.inf)
            for at in range(0, len(own), TILE):
                score = (q[at : at + TILE] @ x.T).astype(np.float64)
                score[own[at : at + TILE, None] == ids[None, :]] = -np.inf
                if len(ids) > k:
                    least[at : at + TILE] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], [*b.schema.names, "least"])

    return in_arrow(queries, rows, "vec_id long, v binary, d binary, least double")


def _best(q: np.ndarray, q_ids: np.ndarray, qd: np.ndarray, least: np.ndarray, x: np.ndarray, x_ids: np.ndarray, xd: np.ndarray, k: int) -> list[np.ndarray]:
    """Query ids, vector ids and scores: the k best of one block for each query, of those that reach least."""
    low, gap = np.zeros((len(q), len(x)), q.dtype), np.empty((len(q), len(x)), q.dtype)
    for p in range(qd.shape[1]):
        np.subtract.outer(qd[:, p], xd[:, p], out=gap)
        np.maximum(low, np.abs(gap, out=gap), out=low)
    high = ((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - low * low) / 2
    high += SLACK + np.abs(high) * 1e-5
    high[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if len(x) > 2 * k:
        # the highest bounds first; their k-th best score is known then
        first = np.argpartition(high, len(x) - 2 * k, axis=1)[:, -2 * k :]
        score = np.where(np.take_along_axis(high, first, axis=1) > -np.inf, np.einsum("qkd,qd->qk", x[first], q), -np.inf)
        least = np.maximum(least, np.partition(score, k, axis=1)[:, k])
    asked = (high >= least[:, None]) & (high > -np.inf)
    if asked.mean() > 1 / 16:
        score = np.where(asked, q @ x.T, -np.inf)
        i, j = np.nonzero((score >= least[:, None]) & asked)
        score = score[i, j]
    else:
        i, j = np.nonzero(asked)
        score = np.einsum("nd,nd->n", q[i], x[j])
        reach = score >= least[i]
        i, j, score = i[reach], j[reach], score[reach]
    by = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[by], j[by], score[by]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return [q_ids[i[kept]], x_ids[j[kept]], score[kept].astype(np.int64)]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (vec_id, v) for each of queries."""
    vectors = cut(vectors)
    n, width, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = width or 1
    kind = np.float32 if width * (most or 0) ** 2 < 1 << 23 else np.float64  # whole numbers that are exact
    ids, scouts = _first(vectors, max(SAMPLE, min(SCOUTS, SCOUT_BYTES // (8 * width))), width)
    pivots = choose_pivots(scouts[:SAMPLE])
    known = vectors.sparkSession.sparkContext.broadcast((ids, scouts.astype(kind)))
    indexed, asked = index(vectors, pivots, width, kind), with_least(cut(index(queries, pivots, width, kind)), known, k, kind)
    m = queries.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    dealt = lambda df, own, count, other, times: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        found: list = [[np.zeros(0, np.int64)] * 3]
        if len(qs) and len(xs):
            x, xd, x_ids = _vectors(xs["v"], len(xs), kind), _vectors(xs["d"], len(xs), kind), xs["vec_id"].to_numpy()
            for at in range(0, len(qs), TILE):
                own = qs.iloc[at : at + TILE]
                found.append(_best(_vectors(own["v"], len(own), kind), own["vec_id"].to_numpy(), _vectors(own["d"], len(own), kind), own["least"].to_numpy(), x, x_ids, xd, k))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(["query_id", "vec_id", "score"], zip(*found, strict=True), strict=True)})

    left, right = dealt(asked, "qb", parts, "xb", blocks), dealt(indexed, "xb", blocks, "qb", parts)
    local = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
QUERIES = {"op7_topk_search": op7_topk_search}
ORACLES = {"op7_topk_search": ORACLE}
