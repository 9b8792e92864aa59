"""Operator 11: vectors compressed to one byte a part, by active-entry Lloyd iterations.

Vectors become whole numbers (floor(1024 * x)) and are cut into PARTS equal consecutive parts; every part
position has a codebook of at most ENTRIES entries, which starts as that part of the vectors with the
smallest ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the
lower index) and puts the floored mean of an entry's parts in its place.

The exact distance of each part to its entry is kept between rounds. An entry is active if the last round
moved it. A part whose own entry stayed where it was compares only the active entries with that distance:
all others were no nearer before and have not moved. A part whose entry moved scans the whole codebook.
Vectors stay in their partitions; a round sends the codebooks (ENTRIES vectors) to the executors, and
from every task the counts and sums of its entries, which are added up in a shuffle, come back as one row
an entry.

Vectors that are null, or hold a null or non-finite component, are left out. The width is that of the
longest vector, rounded up to a multiple of PARTS; shorter vectors count as ending in zeros. Null ids
are kept and are the largest; vectors that share an id are ordered by their components. With fewer
vectors than ENTRIES a codebook has an entry for each. Components whose squares would leave 64 bits are
held at that limit (2 ** 28 for parts of up to 16 components). Equal labels are summed together, nulls and
NaN each as one label; a sum beyond 64 bits is null. An empty table gives an empty result. Other columns
are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_arrow, quoted, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Labels whose sums go to every executor; those of more meet the vectors in a shuffle.
BROADCAST_LABELS = 100_000
#: Numbers that a task compares at once.
TILE = 1 << 20


def whole_numbers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and v (whole numbers as doubles) of the vectors that take part."""
    v = quoted(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = lambda x: F.greatest(F.lit(-(2.0**60)), F.least(F.lit(2.0**60), x.cast("double") * SCALE))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).alias("label"), F.transform(v, lambda x: F.floor(held(x)).cast("double")).alias("v"))


def nearest(x: np.ndarray, book: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (whole numbers) the lowest index of its nearest entries, and the distance."""
    at, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, TILE // max(1, len(book) if exact else book.size))
    sizes = (book * book).sum(1) if exact else None
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        if exact:
            d = (part * part).sum(1)[:, None] + sizes[None, :] - 2 * (part @ book.T)
        else:
            d = ((part.astype(np.int64)[:, None, :] - book.astype(np.int64)[None, :, :]) ** 2).sum(2)
        best = d.argmin(1)
        at[lo : lo + step], least[lo : lo + step] = best, d[np.arange(len(part)), best]
    return at, least


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, book: np.ndarray, active: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """New codes and distances of parts x, from those for the book before; active: which entries moved."""
    code, dist = code.copy(), dist.copy()
    moved = np.flatnonzero(active)
    if not len(moved):
        return code, dist
    lost = active[code]
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], book, exact)
    stay = np.flatnonzero(~lost)
    if len(stay):
        at, d = nearest(x[stay], book[moved], exact)
        at = moved[at]
        won = (d < dist[stay]) | ((d == dist[stay]) & (at < code[stay]))
        code[stay[won]], dist[stay[won]] = at[won], d[won]
    return code, dist


class Codec:
    """The shape of the vectors: width, and the bound of a component."""

    def __init__(self, width: int, most: float):
        self.part = max(1, -(-width // PARTS))
        self.limit = 1 << 30
        while self.part * (2 * self.limit) ** 2 >= 1 << 63:
            self.limit >>= 1
        bound = min(most, self.limit)
        self.exact = 4 * self.part * bound**2 < 1 << 53
        self.kind = np.dtype(np.int16 if bound < 1 << 15 else np.int32)

    def matrix(self, rows: list) -> np.ndarray:
        """Vectors as rows of PARTS times part doubles."""
        out = np.zeros((len(rows), PARTS * self.part))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return np.clip(out, -self.limit, self.limit)

    def books(self, rows: list) -> np.ndarray:
        return self.matrix(rows).reshape(len(rows), PARTS, self.part).transpose(1, 0, 2)


def assigned(state: DataFrame, codec: Codec, books, active, first: bool) -> DataFrame:
    """vec_id, label, v, codes, dists (as bytes) and error: every vector with its parts' entries, from the
    state of the round before, or from whole_numbers in the first."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, moved = books.value, active
        for b in batches:
            n = b.num_rows
            if first:
                m = codec.matrix(b.column("v").to_pylist())
                codes, dists = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
            else:
                m = np.frombuffer(b"".join(b.column("v").to_pylist()), codec.kind).reshape(n, -1).astype(np.float64)
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                dists = np.frombuffer(b"".join(b.column("dists").to_pylist()), np.int64).reshape(n, PARTS).copy()
            for p in range(PARTS if n else 0):
                x = m[:, p * codec.part : (p + 1) * codec.part]
                codes[:, p], dists[:, p] = nearest(x, book[p], codec.exact) if first else reassign(x, codes[:, p], dists[:, p], book[p], moved[p], codec.exact)
            out = (m.astype(codec.kind), codes.astype(np.uint8), dists)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in out), pa.array(dists.sum(1))], names)

    names = ["vec_id", "label", "v", "codes", "dists", "error"]
    return in_arrow(state, rows, f"vec_id long, label {state.schema['label'].dataType.simpleString()}, v binary, codes binary, dists binary, error long")


def _sums(state: DataFrame, codec: Codec, entries: int) -> list:
    """part, entry, n and the sum of each component, of the entries in use."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, codec.part), np.int64)
        for b in batches:
            m = np.frombuffer(b"".join(b.column("v").to_pylist()), codec.kind).reshape(b.num_rows, PARTS, -1) if b.num_rows else np.zeros((0, PARTS, codec.part))
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for c in range(codec.part):
                    total[p, :, c] += np.bincount(codes[:, p], m[:, p, c], entries).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = in_arrow(state.select("v", "codes"), rows, "part long, entry long, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(c))) for c in range(codec.part)]).alias("sums")).collect()


def compressed(vectors: DataFrame, *, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (a byte a part) and error of every vector that takes part, and the codebooks
    (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    numbers = whole_numbers(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    width, most = numbers.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    codec = Codec(width or PARTS, most or 0.0)
    start = [r["v"] for r in numbers.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    books = codec.books(start)
    used = len(start)
    if not used:
        return numbers.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), books
    context = vectors.sparkSession.sparkContext
    state = cut(assigned(numbers, codec, context.broadcast(books), None, True))
    for _ in range(rounds):
        after = books.copy()
        for r in _sums(state, codec, used):
            after[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        active = (after != books).any(2)
        books = after
        state = cut(assigned(state, codec, context.broadcast(books), active, False))
    return state.select("vec_id", "label", "codes", "error"), books


def with_label_error(found: DataFrame) -> DataFrame:
    """found (with label and error) with label_error, the sum of error over equal labels."""
    by_label = found.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS long)").alias("label_error")).withColumnRenamed("label", "own")
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return found.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("own"))).drop("own")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    sha = hashlib.sha256(",".join(map(str, books.astype(np.int64).ravel().tolist())).encode()).hexdigest()
    return with_label_error(found).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain Lloyd: every round looks at every entry."""
    w = "CAST(len(v) / 4 AS BIGINT)"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS k, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT k, p, list_slice(v, p * {w} + 1, (p + 1) * {w}) AS x FROM kept, range({PARTS}) t(p)
), c0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS c FROM parts WHERE k <= {ENTRIES})"""
    ]
    square = lambda x: f"list_inner_product(CAST({x} AS DOUBLE[]), CAST({x} AS DOUBLE[]))"
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT k, p, (min(d)).d AS d, (min(d)).e AS e FROM (
    SELECT k, p, struct_pack(d := CAST(xx + cc - 2 * list_inner_product(xd, cd) AS BIGINT), e := e) AS d
    FROM (SELECT k, p, CAST(x AS DOUBLE[]) AS xd, {square("x")} AS xx FROM parts)
    JOIN (SELECT p, e, CAST(c AS DOUBLE[]) AS cd, {square("c")} AS cc FROM c{r}) USING (p)) GROUP BY k, p
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT a.p, a.e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} a JOIN parts USING (k, p)) GROUP BY p, e, i) GROUP BY p, e
), c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM c{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT k, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY k
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (k)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _oracle()}
