"""Operator 5: exact n-gram Jaccard join by vertical partitioning.

A document's set holds its distinct word n-grams (lower-cased A-Z; a text with fewer words is one
n-gram; one without words has no set). Two documents link when the size of the intersection is at
least num/den of the size of the union.

All n-grams stand in one global order: those in no or few documents first, by hash, then frequent
ones by frequency. Frequencies come from a pass over all documents that keeps the HOT most frequent
n-grams; the order decides only how much work there is, not what is found. Linked documents share
an n-gram of their prefixes in that order at which the positional bound still allows the overlap.

Documents with equal sets are one class, and only classes meet: a task gives out the prefix of a
class once, however many copies it holds. Within the classes of a prefix n-gram no pairs are emitted:
every class meets the leader of the n-gram (least position, then smallest), pairs that pass the bound
are counted, and components are formed. N-grams whose classes are still in several components get
other leaders, at most STARS - 1 times, while their classes would make more than FEW pairs a row across
components. Then the classes of such an n-gram that are in different components meet, so every pair of
different components is tested or excluded by its bound, and the components are exact.

The overlap of a pair is counted vertically: the global hash order is cut into fragments, sets are
cut at the same places, partial overlaps are counted per fragment, and summed per pair. N-grams and
classes are known by 64-bit hashes.

Null text and text without words link with nothing. Rows with null doc_id link with nothing and have
component null. Repeated rows are one document, returned once per row; rows that share a doc_id with
other texts are judged each by its own text, and a component is named by its smallest doc_id. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, held, in_arrow, may_be_member, member_bits, quoted, table
from receivia.llm.components import components
from receivia.llm.rolling import Powers, mix, word_hashes

#: Frequent n-grams kept in all, and those that one task reports at most.
HOT, HOT_OF_TASK, HOT_FROM = 400_000, 100_000, 3
FRAGMENTS = 8
#: Stars at most before classes of different components meet each other at their keys, and pairs of these for
#: each class at a key that are few enough for that.
STARS, FEW = 4, 8
_U = np.uint64


def shingles(text: bytes, n: int, powers: Powers) -> np.ndarray:
    """Sorted hashes of the distinct n-grams."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    width = min(n, len(h))
    sums, starts = powers.prefix(h), np.arange(len(h) - width + 1)
    return np.unique(mix(powers.spans(sums, starts, starts + width) + _U(width)))


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, of which class_ids makes the id of its class."""
    return int(s.sum(dtype=_U)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))


def class_ids(sums: list[tuple[int, int]], sizes: list[int]) -> np.ndarray:
    one, two = np.array(sums, _U).reshape(-1, 2).T
    return mix(one ^ mix(two + np.array(sizes, _U))).view(np.int64)


def summary(docs: DataFrame, n: int) -> DataFrame:
    """Per row of docs (doc_id, tag, text) its doc_id, tag, size and class; and, with size -1, frequent
    n-grams (as class) and how often they were seen (as tag)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, held_ = Powers(), [], 0
        hot, times = np.zeros(0, _U), np.zeros(0, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([hot, *seen]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([times, np.ones(held_)]), len(keys)).astype(np.int64)
            best = np.flatnonzero(count > 1)
            best = best[np.argsort(-count[best], kind="stable")[:HOT_OF_TASK]]
            return keys[best], count[best]

        for b in batches:
            sizes, sums = [], []
            for text in b.column("text"):
                s = shingles(text.as_py() or b"", n, powers)
                sizes.append(len(s))
                sums.append(class_of(s))
                seen.append(s)
                held_ += len(s)
                if held_ > 1_000_000:
                    hot, times = merge()
                    seen, held_ = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(sizes, pa.int64()), pa.array(class_ids(sums, sizes))], names)
        if seen:
            hot, times = merge()
        keep = times >= 2
        yield pa.RecordBatch.from_arrays([pa.nulls(int(keep.sum()), pa.int64()), pa.array(times[keep]), pa.array(np.full(int(keep.sum()), -1)), pa.array(hot[keep].view(np.int64))], names)

    names = ["doc_id", "tag", "size", "class"]
    return in_arrow(docs, rows, "doc_id long, tag long, size long, class long")


def _prefixes(docs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    """key, place, class: the n-grams of every class's prefix in the global order, once per task at
    least. The place holds the position and the size of the set."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, met = Powers(), set()
        hot, rank = order.value
        for b in batches:
            out: list[tuple] = []
            held_ = 0
            for text in b.column("text"):
                s = shingles(text.as_py() or b"", n, powers)
                if not len(s):
                    continue
                own = int(class_ids([class_of(s)], [len(s)])[0])
                if own in met:
                    continue
                met.add(own)
                width = len(s) - -(-num * len(s) // den) + 1
                size = len(s)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    frequent = hot[at] == s
                    s = np.concatenate([s[~frequent], s[frequent][np.argsort(rank[at[frequent]], kind="stable")]])
                out.append((mix(s[:width]).view(np.int64), (np.arange(width) << 32) + size, np.full(width, own)))
                held_ += width
                if held_ > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                    out, held_ = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    names = ["key", "place", "class"]
    return in_arrow(docs.select("text"), rows, "key long, place long, class long")


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap of linked sets of sizes a and b."""
    return F.floor((num * (a + b) + (num + den - 1)) / (num + den))


def _may_link(place: Column, place2: Column, num: int, den: int) -> Column:
    """Length and positional bound at a shared n-gram."""
    pos, pos2 = F.shiftright(place, 32), F.shiftright(place2, 32)
    size, size2 = place.bitwiseAND(0xFFFFFFFF), place2.bitwiseAND(0xFFFFFFFF)
    return (den * F.least(size, size2) >= num * F.greatest(size, size2)) & (1 + F.least(size - pos - 1, size2 - pos2 - 1) >= _need(size, size2, num, den))


def _segments(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, fragment, segment: the sets of the wanted (and perhaps some other) documents, cut at
    fixed places of the order. Texts stay where they are; a bitmap tells which to read."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bounds = Powers(), (np.arange(1, FRAGMENTS, dtype=_U) * _U(2**64 // FRAGMENTS))
        for b in batches:
            sets = [s for t in b.column("text") if len(s := shingles(t.as_py() or b"", n, powers))]
            if sets:
                ids = np.repeat(class_ids([class_of(s) for s in sets], [len(s) for s in sets]), FRAGMENTS)
                parts = [x.view(np.int64) for s in sets for x in np.split(s, np.searchsorted(s, bounds))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(FRAGMENTS), len(sets))), pa.array(parts, pa.list_(pa.int64()))], ["class", "fragment", "segment"])

    some = may_be_member(docs, F.xxhash64("doc_id"), member_bits(wanted, "doc_id"))
    return in_arrow(some.select("text"), rows, "class long, fragment long, segment array<long>")


def linked_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs (u, v, su, sv: classes and their set sizes) that link; classes has the first document of each."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct().join(classes, "class").select(F.col("first").alias("doc_id"))
    parts = cut(_segments(docs, wanted, n))
    fragments = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAGMENTS - 1).cast("long"))))
    left = fragments.join(parts.select(F.col("class").alias("v"), "fragment", F.col("segment").alias("right")), ["v", "fragment"])
    met = left.join(parts.select(F.col("class").alias("u"), "fragment", F.col("segment").alias("left")), ["u", "fragment"])
    partial = met.select("u", "v", "su", "sv", "fragment", F.size(F.array_intersect("left", "right")).alias("n"))
    once = partial.groupBy("u", "v", "su", "sv", "fragment").agg(F.max("n").alias("n"))  # a class read from several rows counts once
    overlap = once.groupBy("u", "v", "su", "sv").agg(F.sum("n").alias("overlap"))
    return overlap.filter(den * F.col("overlap") >= num * (F.col("su") + F.col("sv") - F.col("overlap"))).select("u", "v")


def linked_classes(known: DataFrame, places: DataFrame, most: int, classes: DataFrame, *, n: int, num: int, den: int, pruned: Callable[[DataFrame, DataFrame], DataFrame], links: DataFrame | None = None) -> DataFrame:
    """class, component of the classes that link with others, out of places (key, place, class; most rows at most): classes
    that link share a key at which their places allow it. The class of a key with the least place leads;
    pruned(pairs, met) may leave out pairs that can't link; links (u, v) are known already."""
    leaders = cut(places.groupBy("key").agg(F.min_by(F.struct("class", "place"), F.struct("place", "class")).alias("lead"), F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("key", "lead.class", "lead.place").toDF("key", "lead", "lead_place"))
    met = cut(places.join(leaders, "key"), most)  # neither reads nor gives more rows than places has
    rows = met.count()

    def to_links(found: DataFrame) -> DataFrame:
        """The links among found (x, px, y, py)."""
        turned = F.col("x") < F.col("y")
        pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
        size = lambda a, b: pick(a, b).bitwiseAND(0xFFFFFFFF)
        pairs = found.select(pick("x", "y").alias("u"), pick("y", "x").alias("v"), size("px", "py").alias("su"), size("py", "px").alias("sv")).distinct()
        return cut(linked_pairs(known, pruned(pairs, met), classes, n, num, den))

    def star(of: DataFrame) -> DataFrame:
        passing = of.filter((F.col("class") != F.col("lead")) & _may_link(F.col("place"), F.col("lead_place"), num, den))
        return to_links(passing.select(F.col("class").alias("x"), F.col("place").alias("px"), F.col("lead").alias("y"), F.col("lead_place").alias("py")))

    def label_of(c: str, to: str) -> DataFrame:
        return found.select(F.col("node").alias(c), F.col("component").alias(to))

    links = star(met) if links is None else cut(links.unionByName(star(met)))
    found = components(links)
    both = met.join(label_of("class", "label"), "class", "left").join(label_of("lead", "lead_label"), "lead", "left")
    keys = cut(both.filter(F.coalesce("label", "class") != F.coalesce("lead_label", "lead")).select("key").distinct())
    mixed = met.select("key", "class", "place").join(keys, "key").distinct()
    for turn in range(STARS):
        # the places at keys whose classes are in several components, with top, the largest of these
        labelled = cut(mixed.join(label_of("class", "label"), "class", "left").select("key", "class", "place", F.coalesce("label", "class").alias("label")))
        by_key = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("most < n")
        by_key = cut(by_key)
        pairs = by_key.agg(F.sum((F.col("n") - F.col("most")) * F.col("n").cast("decimal(38,0)"))).first()[0] or 0
        if pairs <= FEW * rows or turn == STARS - 1:
            break
        mixed = labelled.join(by_key.select("key"), "key").drop("label")
        others = labelled.groupBy("key").agg(F.min_by(F.struct("class", "place", "label"), F.xxhash64(F.lit(turn), "key", "class")).alias("to")).select("key", F.col("to.class").alias("lead"), F.col("to.place").alias("lead_place"), F.col("to.label").alias("lead_label"))
        links = cut(links.unionByName(star(labelled.join(others, "key").filter("label <> lead_label"))))
        found = components(links)
    x = labelled.join(by_key.select("key", "top"), "key").filter("label <> top").select("key", F.col("class").alias("x"), F.col("place").alias("px"), F.col("label").alias("lx"))
    y = labelled.select("key", F.col("class").alias("y"), F.col("place").alias("py"), F.col("label").alias("ly"))
    crossed = x.join(y, "key").filter((F.col("lx") != F.col("ly")) & _may_link(F.col("px"), F.col("py"), num, den))
    more = to_links(crossed.select("x", "px", "y", "py"))
    known_stars = found.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return components(known_stars.unionByName(more)).select(F.col("node").alias("class"), "component")


def classes_and_links(texts: DataFrame, *, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts (doc_id, tag, text): own (doc_id, tag, size and class of every row), classes (class, first
    and n: its smallest doc_id and its rows) and linked (class, component) of the classes that link with others."""
    known = texts.filter(F.col("doc_id").isNotNull())
    seen = cut(summary(texts, n))
    own = seen.filter("size >= 0")
    classes = cut(own.filter("size > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    return own, classes, prefix_links(known, seen, classes, n=n, num=num, den=den)


def prefix_links(known: DataFrame, seen: DataFrame, classes: DataFrame, *, n: int, num: int, den: int, links: DataFrame | None = None) -> DataFrame:
    """class, component of the classes of known that link with others; seen is a summary() of these, whose
    frequent n-grams stand last in the global order."""
    frequent = seen.filter("size = -1").groupBy(F.col("class").alias("gram")).agg(F.sum("tag").alias("times")).filter(F.col("times") >= HOT_FROM).orderBy(F.desc("times"), "gram").limit(HOT).toPandas()
    hot = frequent["gram"].to_numpy(np.int64).view(_U)
    by = np.argsort(hot)
    order = known.sparkSession.sparkContext.broadcast((hot[by], frequent["times"].to_numpy(np.int64)[by]))
    most = seen.filter("size > 0").agg(F.sum(F.col("size") - F.ceil(num * F.col("size") / F.lit(den)) + 1)).first()[0] or 0  # of all prefixes
    kept: list[DataFrame] = []

    def pruned(pairs: DataFrame, met: DataFrame) -> DataFrame:
        """Pairs whose shared prefix n-grams allow the overlap: what is shared beyond the prefix that ends
        first is at most the rest of that class's set."""
        if not kept:
            kept.append(cut(met.groupBy("class").agg(F.collect_set("key").alias("keys"))))
        rest = lambda c: F.ceil(num * F.col(c) / F.lit(den)) - 1
        keys = lambda c, to: kept[0].select(F.col("class").alias(c), F.col("keys").alias(to))
        both = pairs.join(keys("u", "ku"), "u").join(keys("v", "kv"), "v")
        most = F.size(F.array_intersect("ku", "kv")) + F.greatest(rest("su"), rest("sv"))
        return both.filter(most >= _need(F.col("su"), F.col("sv"), num, den)).select("u", "v", "su", "sv")

    return linked_classes(known, _prefixes(known, n, num, den, order), most, classes, n=n, num=num, den=den, pruned=pruned, links=links)


def named(own: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of own's rows: a component is named by its smallest doc_id."""
    met = linked.join(classes, "class")
    least = met.groupBy("component").agg(F.min("first").alias("least"))
    by_class = met.join(least, "component").select("class", "least")
    shared = cut(classes.join(by_class, "class", "left").filter("n > 1 OR least IS NOT NULL").select("class", F.coalesce("least", "first").alias("component")))
    joined = own.join(shared, "class", "left")
    return joined.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, *, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), quoted(text_col).cast("binary").alias("text"))
    return named(*classes_and_links(texts, n=n, num=num, den=den))


def keep_one(docs: DataFrame, *, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of linked documents, the one with the smallest id; columns as they are.
    Rows with one id are copies, of which one stays, only if their sets are equal too; with other
    texts they are documents of their own. Rows with null id link with nothing, and all stay. Texts
    are moved only of rows that may go."""
    # wordless texts have equal sets
    text = quoted(text_col)
    tag = F.xxhash64(F.when(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), text))
    rows = held(docs, id=quoted(id_col).cast("long"), tag=tag)
    known = rows.filter(F.col("id").isNotNull())
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), tag.alias("tag"), text.cast("binary").alias("text")).filter(F.col("doc_id").isNotNull())
    own, _, linked = classes_and_links(texts, n=n, num=num, den=den)
    placed = own.join(cut(linked), "class", "left").select("doc_id", "tag", "size", F.coalesce("component", "class").alias("component"))
    counted = placed.groupBy("doc_id", "tag", "size", "component").agg(F.count("*").alias("n"))
    least = cut(counted.filter("size > 0").groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("least"), F.count("*").alias("rows")).filter("rows > 1"))
    judged = counted.join(least, "component", "left").select("doc_id", "tag", "n", F.coalesce((F.col("size") > 0) & (F.struct("doc_id", "tag") != F.col("least")), F.lit(False)).alias("goes"))
    moved = cut(judged.filter("goes OR n > 1"))
    bitmap = member_bits(moved.select(F.xxhash64("doc_id", "tag").alias("key")), "key")
    key = F.xxhash64(F.xxhash64("id", "tag"))
    stay = may_be_member(known, key, bitmap, others=True).select("row.*")
    asked = may_be_member(known, key, bitmap).join(moved.filter("goes").select(F.col("doc_id").alias("id"), "tag"), ["id", "tag"], "left_anti")
    return stay.unionByName(asked.dropDuplicates(["id", "tag"]).select("row.*")).unionByName(rows.filter(F.col("id").isNull()).select("row.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def shingle_oracle(n: int, num: int, den: int) -> str:
    """SQL of jaccard_components: counted overlaps of all sets that share an n-gram, and reachability."""
    return rf"""WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT r, doc_id, array_to_string(w[i : i + least(len(w), {n}) - 1], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sized AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM grams GROUP BY r, doc_id
), links AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM (
    SELECT x.r AS a, y.r AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL GROUP BY x.r, y.r
  ) o JOIN sized a ON a.r = o.a JOIN sized b ON b.r = o.b WHERE {den} * o.n >= {num} * (a.n + b.n - o.n)
), reach AS (SELECT u, u AS v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(CASE WHEN s.n > 0 THEN l.c END, w.doc_id) AS component_id
FROM worded w LEFT JOIN sized s ON s.r = w.r LEFT JOIN least l ON l.u = w.doc_id"""


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": shingle_oracle(3, 90, 100)}
