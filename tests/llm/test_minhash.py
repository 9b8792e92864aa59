"""Operator 12 against all pairs and its SQL."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from receivia.llm import jaccard_join, minhash_dedup as md
from tests.llm.test_llm import ROWS, SCHEMA, words


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows, n, num, den):
    """doc_id, size, component_id, kept of every row (id, text), from all pairs."""
    sets = []
    for _, t in rows:
        w = words(fold(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and None not in (rows[i][0], rows[j][0]) and den * len(a & b) >= num * len(a | b):
            least[root(j)] = root(i)
    name = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[root(k)] = min(i, name.get(root(k), i))
    return [(i, len(sets[k]), None if i is None else name[root(k)], None if i is None else name[root(k)] == i) for k, (i, _) in enumerate(rows)]


def family(seed, copies, changed, length=160):
    """Texts of which most are not near each other, two being nearly equal."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(5))
    base = [word() for _ in range(length)]
    out = []
    for _ in range(copies):
        w = list(base)
        for at in rng.sample(range(length), changed):
            w[at] = word()
        out.append(w)
    twin = list(out[copies // 2])
    twin[-1] = word()
    return [" ".join(w) for w in [*out, twin]]


@pytest.mark.parametrize("few", [0, 8])
def test_near_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)  # 0: keys get other leaders as often as they may
    texts = [(r[0], r[1]) for r in ROWS] + [(1000 + i, t) for i, t in enumerate(family(1, 40, 4) + family(2, 30, 2) + family(3, 20, 1, 60))]
    texts += [(None, texts[8][1]), (8, "another text of this id"), (2000, "Ä Ö"), (2001, "ä ö"), (2002, "a b c d e"), (2003, "A B C D E")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, kept string, `a.b` int, key int").repartition(4)
    got = sorted(map(str, map(tuple, md.near_duplicates(docs).collect())))
    assert got == sorted(map(str, by_hand(texts, 5, 85, 100)))
    assert len({r[2] for r in by_hand(texts, 5, 85, 100)}) > 60


def test_bins_agree_as_sets_do():
    rng, signer = np.random.default_rng(1), md.Signer()
    for size, shared in ((3, 2), (60, 50), (900, 700), (5000, 4300)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 1 << 62, 2 * size - shared).astype(np.uint64) * np.uint64(4) + np.uint64(3)
            a, b = np.unique(x[:size]), np.unique(x[size - shared :])
            agree.append((signer.signature(a) == signer.signature(b)).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.05
    one = signer.signature(np.array([7], np.uint64))
    assert (one == 7).all() and len(signer.buckets(one)) == md.BANDS


def test_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query, sql in ((md.op12_minhash_dedup, md.ORACLES["op12_minhash_dedup"]), (jaccard_join.op5_jaccard_join, jaccard_join.ORACLES["op5_jaccard_join"])):
        got = query(spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty(spark):
    for rows in ([], [(1, None), (2, ""), (None, "a b")]):
        got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["n_shingles"] for r in got)) == ([0, 0, 1] if rows else [])
