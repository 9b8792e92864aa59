"""Operator 12: near duplicates by one-permutation hashing with optimal densification.

A document's set holds its distinct word n-grams (lower-cased A-Z; a text with fewer words is one
n-gram; one without words has no set). One hash per n-gram deals the set into BINS bins, each of which
keeps its least hash. An empty bin borrows the value of the first filled bin in a random order of its
own, the same for all documents, so that any two sets agree in a bin with the chance of their Jaccard
similarity. The bins are cut into BANDS bands; documents that agree in all bins of a band share its bucket.
At the similarities asked for (0.85), a pair shares none of the buckets with a chance of 6e-9.

Documents with equal sets are one class, and only classes meet: a task gives out the buckets of a class
once, however many copies it holds. Within a bucket candidates are a star: every class meets the one that
leads, by a hash of bucket and class, so that a class has another leader in each of its buckets. Candidates
are confirmed on the full sets. A star is exact where all its classes link with the leader. Of two classes
that link and share a bucket, one at least doesn't link with the leader if the star leaves them apart; so
the classes of buckets with such a class, and only these, also meet by the prefixes of operator 5, which lose
no link. Components are formed of all links.

Two documents link when the size of the intersection is at least num/den of the size of the union.
N-grams and classes are known by 64-bit hashes.

Null text and text without words link with nothing. Rows with null doc_id link with nothing and have
component and kept null. Repeated rows are one document, returned once per row, all of them kept if it is;
rows that share a doc_id with other texts are judged each by its own text, and a component is named by its
smallest doc_id. Texts are read whole. Empty tables give empty results. Other columns are not carried,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_arrow, may_be_member, member_bits, quoted, table
from receivia.llm.jaccard_join import class_ids, class_of, linked_pairs, named, prefix_links, shingle_oracle, shingles, summary
from receivia.llm.rolling import Powers, mix

BANDS, ROWS_OF_BAND = 40, 6
BINS = BANDS * ROWS_OF_BAND
_U = np.uint64


class Signer:
    """Signatures of sets. Every bin has the other bins in a random order, in which it borrows."""

    def __init__(self, seed: int = 12):
        rng = np.random.default_rng(seed)
        order = rng.permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
        self.rank = np.argsort(order, axis=1).astype(np.int16)
        self.odd = rng.integers(0, 1 << 63, ROWS_OF_BAND, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.band = rng.integers(0, 1 << 63, BANDS, dtype=np.int64).astype(_U)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The value of every bin, for the sorted hashes s of a set that is not empty."""
        bins = ((s >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        filled, values = bins[first], s[first]
        out = np.zeros(BINS, _U)
        out[filled] = values
        if len(filled) < BINS:
            empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
            out[empty] = values[self.rank[np.ix_(empty, filled)].argmin(axis=1)]
        return out

    def buckets(self, s: np.ndarray) -> np.ndarray:
        values = mix(self.signature(s)).reshape(BANDS, ROWS_OF_BAND)
        return mix((values * self.odd).sum(axis=1, dtype=_U) + self.band)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size and class, and the buckets of its class (null where the
    task has given them out)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, signer, met = Powers(), Signer(), set()
        for b in batches:
            sets = [shingles(t.as_py() or b"", n, powers) for t in b.column("text")]
            sizes = [len(s) for s in sets]
            classes = class_ids([class_of(s) for s in sets], sizes)
            buckets: list = []
            for doc_id, s, c in zip(b.column("doc_id"), sets, classes.tolist(), strict=True):
                fresh = doc_id.is_valid and len(s) > 0 and c not in met
                if fresh:
                    met.add(c)
                buckets.append(signer.buckets(s).view(np.int64) if fresh else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "size", "class", "buckets"])

    return in_arrow(docs, rows, "doc_id long, size long, class long, buckets array<long>")


def near_duplicates(docs: DataFrame, *, n: int = 5, num: int = 17, den: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document names its component) for every row of docs."""
    known = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("text"))
    seen = cut(sketches(known, n))
    known = known.filter("doc_id IS NOT NULL")
    own = seen.select("doc_id", "size", "class")
    classes = cut(own.filter("size > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    places = seen.filter("buckets IS NOT NULL").select(F.explode("buckets").alias("key"), "size", "class")
    leaders = cut(places.groupBy("key").agg(F.min_by(F.struct("class", "size"), F.xxhash64("key", "class")).alias("lead"), F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("key", F.col("lead.class").alias("lead"), F.col("lead.size").alias("lead_size")))
    met = cut(places.join(leaders, "key").filter("class <> lead").select("key", F.least("class", "lead").alias("u"), F.greatest("class", "lead").alias("v"), "class", "size", "lead_size"), BANDS * seen.count())
    near = met.filter(den * F.least("size", "lead_size") >= num * F.greatest("size", "lead_size"))
    first = F.col("class") == F.col("u")
    pairs = near.select("u", "v", F.when(first, F.col("size")).otherwise(F.col("lead_size")).alias("su"), F.when(first, F.col("lead_size")).otherwise(F.col("size")).alias("sv")).distinct()
    links = cut(linked_pairs(known, pairs, classes, n, num, den))
    # buckets with a class that doesn't link with the leader: all their classes, leaders included
    open_ = cut(met.join(links, ["u", "v"], "left_anti").select("key").distinct())
    rest = met.join(open_, "key").select(F.explode(F.array("u", "v")).alias("class")).distinct().join(classes, "class").select(F.col("first").alias("doc_id"))
    some = may_be_member(known, F.xxhash64("doc_id"), member_bits(cut(rest), "doc_id")).select("doc_id", F.lit(0).cast("long").alias("tag"), "text")
    linked = prefix_links(some, cut(summary(some, n)), classes, n=n, num=num, den=den, links=links)
    return named(own, classes, linked).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_minhash_dedup": op12_minhash_dedup}
ORACLES = {"op12_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({shingle_oracle(5, 85, 100)})"}
