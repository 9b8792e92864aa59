"""Item matching against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from receivia.operators import attribution

RANDOM = random.Random(5)


def word(n):
    return "".join(RANDOM.choice("abcde") for _ in range(n))


def altered(w):
    out = list(w)
    for _ in range(RANDOM.randint(0, 4)):
        at = RANDOM.randrange(len(out) + 1)
        out[at : at + RANDOM.randint(0, 1)] = RANDOM.choice(["", "x", "a", "yz"])
    return "".join(out)


MASTER = [word(RANDOM.randint(1, 14)) for _ in range(40)] + ["abcdefgh", "aabbccdd", "ﺍلعود"]
NAMES = [altered(RANDOM.choice(MASTER)) for _ in range(150)] + [word(RANDOM.randint(1, 12)) for _ in range(60)] + ["axbxcxdxexfxgxh", "", "a" * 250, "العود"]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame([(n,) for n in NAMES + [None, NAMES[0]]], "_i string"), spark.createDataFrame([(m,) for m in MASTER + ["", None]], "_m string")


@pytest.mark.parametrize("ratio", [0.72, 0.5, 0.9])
def test_alike(sides, ratio):
    want = {(n, m): SequenceMatcher(None, n, m).ratio() for n in set(NAMES) for m in set(MASTER) if n and m}
    found = attribution.alike(*sides, ratio)
    assert {(r["_i"], r["_m"]): r["r"] for r in found.collect()} == {k: r for k, r in want.items() if r >= ratio}
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())


def test_contained(sides):
    want = {(n, m) for n in NAMES for m in MASTER if min(len(n), len(m)) >= 4 and (n in m or m in n)}
    found = attribution.contained(*sides, 4)
    assert {tuple(r) for r in found.collect()} == want and want
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())


def test_match_items_in_turn(spark):
    items = spark.createDataFrame([("1", "Blue-Bolt, large"), ("2", "bleu bolt"), ("3", "a widget"), ("4", "zzz"), ("5", None), ("6", "zzz"), ("7", "")], "item_code string, item_name string")
    master = spark.createDataFrame([("blue bolt", "B"), ("Blue Bolt", "C"), ("", "E")], "name string, brand string")
    own = spark.createDataFrame([("6", "O"), ("9", "P")], "item_code string, brand string")
    found = {r["item_code"]: (r["brand"], r["master_name"], r["match_type"]) for r in attribution.match_items(items, master, [("widget", "W")], own).collect()}
    rest = ("unclassified", None, "unclassified")
    assert found == {"1": ("B", "blue bolt", "master"), "2": ("B", "blue bolt", "fuzzy"), "3": ("W", None, "keyword"), "4": rest, "5": rest, "6": ("O", None, "override"), "7": rest}
    empty = attribution.match_items(items.limit(0), master.limit(0), [])
    assert empty.count() == 0 and attribution.match_items(items, master.limit(0), []).filter(F.col("match_type") == "unclassified").count() == 7


def test_item_dimension_reads_lines_once(spark):
    """Lines are summed before names join them; matching reads the names of items, not lines."""
    from receivia.plans import catalog

    plan = catalog.QUERIES["item_dimension"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1
    lines = spark.createDataFrame([("1", 2, 6), ("1", 1, 3), ("2", 5, 5), ("3", 1, 1), ("4", 1, 2), ("9", 8, 8)], "item_code string, qty int, line_total int")
    items = spark.createDataFrame([("1", "bleu bolt"), ("1", "zzz"), ("1", "zzz"), ("2", "Blue-Bolt, large"), ("3", None), ("4", "a widget"), ("5", "blue bolt")], "item_code string, item_name string")
    master = spark.createDataFrame([("blue bolt", "B", "12 a box")], "name string, brand string, carton_capacity string")
    own = spark.createDataFrame([("4", "O")], "item_code string, brand string")
    found = attribution.item_dimension(lines, items, master, [("widget", "W")], own).select("item_code", "item_name", "brand", "master_name", "match_type", "pack", "total_revenue", "total_qty", "n_lines")
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {
        "1": ("zzz", "unclassified", None, "unclassified", None, 27.0, 9.0, 6),
        "2": ("Blue-Bolt, large", "B", "blue bolt", "master", 12.0, 5.0, 5.0, 1),
        "3": (None, "unclassified", None, "unclassified", None, 1.0, 1.0, 1),
        "4": ("a widget", "O", None, "override", None, 2.0, 1.0, 1),
    }
