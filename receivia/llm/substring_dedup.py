"""Operator 1: repeated word windows found by De Bruijn compaction.

A window is WINDOW consecutive words. It repeats if its words also start somewhere in a document
with a smaller doc_id; every word that such a window covers is removed.

Nodes of the graph are word k-mers that the text itself selects (closed syncmers: the least of the
k-mer's 3-word hashes stands at either end), so that equal text selects equal nodes and any WINDOW
words hold two at least. An edge is the text from one node through the next. Spark joins tell, for
every edge, the smallest and largest document that holds it, and for edges in two documents or
more, whether all places of the edge go on to one same edge and come from one same edge. Runs of
edges without a branch are compacted into paths: all places of an edge of a path hold the whole
path, so a window inside a path repeats exactly if the smallest document of the path is smaller.
Edges are the same text if two hashes of their words, 128 bits, are the same.
The few windows that reach over the end of a path, but whose edges are all repeated, are verified
at their source coordinates by a 128-bit hash of their words. No pairs of documents are formed.

Null text has no words. A row with null doc_id is neither source nor changed. Rows that share a
doc_id are judged each for itself and are no source of each other. Texts shorter than a window stay.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.llm.common import cut, held, in_arrow, in_batches, may_be_member, member_bits, quoted, table
from receivia.llm.rolling import Powers, mix, sliding_min, word_hashes

WINDOW = 50
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Graph:
    """Nodes and edges of one text."""

    def __init__(self, window: int):
        self.window, self.gap = window, max(1, (window - 2) // 3)
        self.k = self.gap + 3  # two nodes at least in a window: window - k + 1 >= 2 * gap
        self.one, self.two = Powers(0), Powers(1)

    def read(self, text: bytes) -> None:
        words = text.split()
        self.n = len(words)
        self.nodes = np.zeros(0, np.intp)
        if self.n < self.window:
            return
        self.h = word_hashes(words)
        self.sums = self.one.prefix(self.h)
        starts = np.arange(self.n - 2)
        small = mix(self.one.spans(self.sums, starts, starts + 3))
        least = sliding_min(small, self.gap + 1)
        self.nodes = np.flatnonzero((small[: len(least)] == least) | (small[self.gap : self.gap + len(least)] == least))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words of each edge."""
        if len(self.nodes) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = self.nodes[:-1], self.nodes[1:] + self.k
        return mix(self.one.spans(self.sums, a, b)).view(np.int64), mix(self.two.spans(self.two.prefix(mix(self.h)), a, b)).view(np.int64)

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = self.two.prefix(mix(self.h))
        return tuple(mix(p.spans(s, starts, starts + self.window)).view(np.int64) for p, s in ((self.one, self.sums), (self.two, sums)))

    def settle(self, doc_id: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that repeat, and starts of windows to verify. marks: per repeated edge its number,
        smallest document, and whether it has one successor and one predecessor everywhere."""
        m = len(self.nodes) - 1
        number = marks[:, 0]
        repeated, least, after, before = np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, bool)
        repeated[number], least[number], after[number], before[number] = True, marks[:, 1], marks[:, 2] > 0, marks[:, 3] > 0
        joined = np.concatenate([[False], repeated[:-1] & repeated[1:] & after[:-1] & before[1:]])
        first = np.maximum.accumulate(np.where(joined, 0, np.arange(m)))  # first edge of each edge's path
        ends = np.concatenate([~joined[1:], [True]])
        last = np.minimum.accumulate(np.where(ends, np.arange(m), m)[::-1])[::-1]
        a, b = self.nodes[first], self.nodes[last + 1] + self.k
        heads = np.flatnonzero(repeated & (first == np.arange(m)) & (least < doc_id) & (b - a >= self.window))
        starts = np.arange(self.n - self.window + 1)
        lo = np.searchsorted(self.nodes, starts)
        hi = np.searchsorted(self.nodes, starts + self.window - self.k, "right") - 2
        whole = np.concatenate([[0], np.cumsum(repeated)])
        open_ = (whole[hi + 1] - whole[lo] == hi - lo + 1) & ~((first[lo] == first[hi]) & (a[lo] <= starts) & (b[lo] >= starts + self.window))
        return np.stack([a[heads], b[heads]], axis=1), starts[open_]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes, and a tag that tells apart rows which share a doc_id."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("text"), _tag(quoted(text_col)).alias("tag"))


def _tag(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF)


def _edges(docs: DataFrame, window: int) -> DataFrame:
    """edge and two (its hashes), doc_id, at (tag and number): every edge of every document."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _Graph(window)
        for b in batches:
            out: list[tuple] = []
            held_ = 0
            for i, t, tag in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("tag").to_pylist(), strict=True):
                graph.read(t.as_py() or b"")
                one, two = graph.edges()
                if len(one):
                    out.append((one, two, np.full(len(one), i), (tag << 32) + np.arange(len(one))))
                    held_ += len(one)
                if held_ > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                    out, held_ = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    names = ["edge", "two", "doc_id", "at"]
    return in_arrow(docs.filter(F.col("doc_id").isNotNull()), rows, "edge long, two long, doc_id long, at long")


def _marked(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, marks: the repeated edges of every document that has some. What is counted per edge
    is written before it meets the places again, so that Spark can split the join at a very common edge."""
    seen = _edges(docs, window)
    repeated = cut(seen.groupBy("edge", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"))
    n = repeated.count()
    places = cut(seen.join(repeated, ["edge", "two"]))  # as many files as the join has tasks: nothing bounds its rows
    along = W.partitionBy("doc_id").orderBy("at")
    beside = lambda f, step: F.when(f("at").over(along) == F.col("at") + step, f("edge").over(along))
    single = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    turned = places.withColumns({"next": beside(F.lead, 1), "prev": beside(F.lag, -1)})
    turns = cut(turned.groupBy("edge", "two").agg(F.coalesce(single("next"), F.lit(False)).alias("after"), F.coalesce(single("prev"), F.lit(False)).alias("before")), n)
    mark = F.struct((F.col("at").bitwiseAND(0xFFFFFFFF)).alias("number"), "least", F.col("after").cast("long").alias("after"), F.col("before").cast("long").alias("before"))
    marked = places.join(turns, ["edge", "two"]).select("doc_id", F.shiftright("at", 32).alias("tag"), mark.alias("mark"))
    return marked.groupBy("doc_id", "tag").agg(F.collect_list("mark").alias("marks"))


def _settled(docs: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, spans (starts and ends in turn), and the windows left to verify."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _Graph(window)
        spans_of, hash1, hash2, starts_of = ([] for _ in range(4))
        for b in batches:
            spans_of, hash1, hash2, starts_of = ([] for _ in range(4))
            marks, texts = b.column("marks"), b.column("text")
            for r in range(b.num_rows):
                m = marks[r].values
                table_ = np.stack([m.field(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
                graph.read(texts[r].as_py() or b"")
                spans, starts = graph.settle(b.column("doc_id")[r].as_py(), table_)
                one, two = graph.windows(starts)
                for to, value in ((spans_of, spans.ravel()), (hash1, one), (hash2, two), (starts_of, starts)):
                    to.append(value)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), *(pa.array(c, kind) for c in (spans_of, hash1, hash2, starts_of))], ["doc_id", "tag", "spans", "one", "two", "starts"])

    some = may_be_member(docs, F.xxhash64("doc_id"), member_bits(marked, "doc_id"))
    both = some.join(marked, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks")
    return in_arrow(both, rows, "doc_id long, tag long, spans array<long>, one array<long>, two array<long>, starts array<long>")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, spans: word positions, as starts and ends in turn, that repeated windows cover."""
    keyed = _keyed(docs, id_col, text_col)
    settled = cut(_settled(keyed, cut(_marked(keyed, window)), window))
    loose = settled.select("doc_id", "tag", F.explode(F.arrays_zip("one", "two", "starts")).alias("w")).select("doc_id", "tag", "w.*")
    least = cut(loose.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"))
    confirmed = loose.join(least, ["one", "two"]).filter("least < doc_id").select("doc_id", "tag", F.array(F.col("starts"), F.col("starts") + window).alias("spans"))
    found = settled.filter(F.size("spans") > 0).select("doc_id", "tag", "spans").unionByName(confirmed)
    # rows that share doc_id and text are settled twice, with equal spans
    return found.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _removed(n: int, spans: list | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        s = np.asarray(spans, np.int64)
        np.add.at(edge, s[0::2], 1)
        np.add.at(edge, s[1::2], -1)
    return np.cumsum(edge[:n]) > 0


def with_spans(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs (as a struct, row) in two parts: those that may hold repeats, with spans (null
    where nothing repeats), and the others, which are most rows and not moved."""
    spans = cut(repeated_spans(docs, window=window, id_col=id_col, text_col=text_col))
    bitmap = member_bits(spans, "doc_id")
    rows = held(docs, doc_id=quoted(id_col).cast("long"), tag=_tag(quoted(text_col)))
    hashed = F.xxhash64("doc_id")
    met = may_be_member(rows, hashed, bitmap).join(spans, ["doc_id", "tag"], "left")
    return met.select("row", "spans"), may_be_member(rows, hashed, bitmap, others=True).select("row")


def cut_text(text: bytes, spans: list | None) -> bytes:
    """text without the words of spans; what stays keeps its own white space, parts a line each."""
    at = [m.span() for m in _WORD.finditer(text)]
    gone = _removed(len(at), spans)
    turn = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return b"\n".join(text[at[a][0] : at[b - 1][1]] for a, b in zip(turn[0::2], turn[1::2], strict=True))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the text; texts of which no word stays are dropped, and
    rows without repeats are unchanged. Other columns pass through, whatever their names."""

    @F.pandas_udf("string")
    def each(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else cut_text(t.encode(), s).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

    shorten = each.asNondeterministic()  # so that the filter below doesn't run it a second time

    met, others = with_spans(docs, window=window, id_col=id_col, text_col=text_col)
    text = F.col("row")[text_col]
    changed = met.select("row", "spans", shorten(text, "spans").alias("text")).filter(F.col("spans").isNull() | (F.length("text") > 0))
    return changed.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]).unionByName(others.select("row.*"))


def digest(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in batches:
            n, gone, sha = [], [], []
            for text, s in zip(texts, spans, strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if s:
                    lost = _removed(len(words), s)
                    words = [words[i] for i in np.flatnonzero(~lost)]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    met, others = with_spans(docs.select("doc_id", "text"), window=window)
    row = (F.col("row.doc_id"), F.col("row.text").cast("binary").alias("text"))
    return in_batches(met.select(*row, "spans"), rows, schema).unionByName(in_batches(others.select(*row, F.lit(None).cast("array<long>").alias("spans")), rows, schema))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
