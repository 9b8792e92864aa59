"""Operator 11 against plain Lloyd and its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from receivia.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v int, `a.b` string, codes string"


def plain(rows, entries=256, rounds=4):
    """Code and error of each kept vector (in order of id, then components), and the books, in Python's whole numbers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept], default=4) // 4) * 4
    kept = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = width // 4
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for r in range(rounds + 1):
        found = [[near(cut(v, p), p) for p in range(4)] for _, v, _ in kept]
        if r < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = ["".join(f"{e:02x}" for _, e in f) for f in found]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return [(i, c, e, sums[label]) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)], books


def numbers(seed, n, width, spread):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2, 3])) for i in range(n)]


AWKWARD = [(None, [0.5] * 8, 1), (3, None, 1), (4, [0.1, float("nan")], 1), (5, [float("inf")] * 8, 2), (6, [0.1, None], 2), (7, [], None), (8, [0.25] * 3, 9), (2, [0.1] * 8, 1), (2, [0.1] * 8, 1), (2, [-0.1] * 8, 1)]


@pytest.mark.parametrize("rows", [numbers(1, 60, 8, 0.1), numbers(2, 90, 8, 0.002) + AWKWARD, numbers(3, 40, 8, 3000.0), numbers(4, 3, 6, 0.3)], ids=["clusters", "ties and awkward rows", "large", "few"])
def test_compressed(spark, rows):
    table = spark.createDataFrame([(i, v, label, 0, "x", "y") for i, v, label in rows], SCHEMA).repartition(3)
    found, books = vc.compressed(table, entries=12)
    got = vc.with_label_error(found).selectExpr("vec_id", "lower(hex(codes)) AS code", "error", "label_error").collect()
    want, plain_books = plain(rows, 12)
    assert books.astype(int).tolist() == plain_books
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_active_entries_are_enough():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 3)).astype(float)
    book = rng.integers(-3, 4, (20, 3)).astype(float)
    code, dist = vc.nearest(x, book, True)
    for _ in range(6):
        after = book + rng.integers(-1, 2, book.shape) * (rng.random((20, 1)) < 0.4)
        code, dist = vc.reassign(x, code, dist, after, (after != book).any(1), True)
        book = after
        plain_code, plain_dist = vc.nearest(x, book, False)
        assert (code == plain_code).all() and (dist == plain_dist).all()


def test_beyond_64_bits_and_empty(spark):
    rows = [(1, [3e38] * 4, 1, 0, "", ""), (2, [-3e38] * 4, 1, 0, "", ""), (3, [1.0] * 4, None, 0, "", "")]
    found, _ = vc.compressed(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=1)
    assert vc.with_label_error(found).count() == 3
    for empty in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, 1, 0, "", "")], SCHEMA)):
        assert vc.with_label_error(vc.compressed(empty)[0]).collect() == []


def test_sql(spark, tmp_path):
    table = spark.createDataFrame([(i, v, label) for i, v, label in numbers(6, 700, 8, 0.05)] + [r for r in AWKWARD if r[0] not in (7, 8)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = list(map(tuple, vc.op11_vector_codes(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.ORACLES['op11_vector_codes']})").fetchall()
    assert len(got) == 704 and sorted(map(str, got)) == sorted(map(str, want))
    assert len({r[4] for r in got}) == 1 and re.fullmatch("[0-9a-f]{64}", got[0][4])
