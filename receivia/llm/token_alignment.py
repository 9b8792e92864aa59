"""Operator 13: the tokens of two tokenizers aligned over the bytes of each text.

Side A is a byte-level tokenizer, given space + text; side B is a piece tokenizer, given text, to which
it adds the space itself. Both sides cover the same bytes, or the document has no tokens. Every token is
a byte range. For each token start, pandas merge_asof, keyed by document over a batch of documents laid
end to end, finds the token of the other side that covers it; the union of both directions is all
overlapping pairs. Overlapping pairs that end at the same byte are links, and their ends cut both sides
into groups, the least runs of tokens that spell the same bytes.

An id pair's count is the number of links of the corpus that hold it. Counts are added up within tasks
first and then by pair in a shuffle. The HOT most frequent pairs go to all executors; documents with other
pairs meet those in a join, so that very common pairs never share a shuffle partition and any number of
rare ones has room.

Null, empty and white-space texts that side B shortens, and every text whose bytes either side changes,
have no tokens: zeros, an empty checksum, no groups and no links. Null ids stay null; rows that share an
id, or are repeated, are aligned each for itself, and each counts. A text is tokenised whole, however
long, a batch of texts holds about BYTES bytes. Ties for a B id's highest count are all best. An empty
table gives an empty result. Other columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_arrow, quoted, table, tokenizer

#: Pairs whose counts go to all executors (17 bytes each), pairs that a task adds up at once, and
#: bytes of text in a batch.
HOT, ADDED, BYTES = 1 << 20, 1 << 20, 1 << 20
#: The split into words of the byte-level tokenizer (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes, ascending, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Bytes:
    """Side A. Where the file is plain byte-level BPE whose ids stand in merge order, as checked here, a
    rank encoder gives the same ids faster; any other file, and a text that encoder can't take, is encoded by the tokenizer itself."""

    def __init__(self, path: str):
        byte_of = _byte_of()
        self.path = path
        file = tokenizer(path)
        vocab = file.get_vocab(with_added_tokens=False)
        size = max(file.get_vocab().values()) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        self.ranks = None
        if plain and ids == sorted(ids) and all(i < (ids or [0])[0] for c, i in vocab.items() if len(c) == 1):
            import tiktoken

            own = set(ids) | {i for c, i in vocab.items() if len(c) == 1}
            self.ranks = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={self.bytes_of[i]: i for i in own}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranks is not None:
            try:
                return self.ranks.encode_ordinary(text)
            except ValueError:  # a run of white space too long for its pattern
                pass
        return tokenizer(self.path).encode(text, add_special_tokens=False).ids


class _Pieces:
    """Side B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        piece = self.model.id_to_piece
        self.bytes_of = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]


    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class _Sides:
    def __init__(self, a: str, b: str):
        self.a, self.b = _Bytes(a), _Pieces(b)
        self.a_len, self.b_len = (np.array([len(x) for x in s.bytes_of], np.int64) for s in (self.a, self.b))
        self.kinds = len(self.b.bytes_of)
        # what the digest writes for (id, last of its group): A's ids, then B's
        self.written = [f"{i}{end}".encode() for n, ends in ((len(self.a_len), ",|"), (self.kinds, ",;")) for i in range(n) for end in ends]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        whole = " " + text
        a, b, data = self.a.encode(whole), self.b.encode(text), whole.encode()
        same = all(b"".join(map(s.bytes_of.__getitem__, x)) == data for s, x in ((self.a, a), (self.b, b)))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None


@lru_cache(maxsize=2)
def _sides(a: str, b: str) -> _Sides:
    """One for all tasks of a Python worker."""
    return _Sides(a, b)


class Aligned:
    """The alignment of a batch of documents, laid end to end. doc_a, doc_b: each token's document;
    a_start, b_start and a_end, b_end: its bytes; x, y: the overlapping pairs, as token numbers, in the order
    of x; link_x, link_y: those that end together; a_group, b_group: each token's group."""

    def __init__(self, tokens: list[tuple[np.ndarray, np.ndarray]], a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in tokens)]) for k in (0, 1))
        self.doc_a, self.doc_b = (np.repeat(np.arange(len(tokens)), [len(t[k]) for t in tokens]) for k in (0, 1))
        self.a_end, self.b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        self.a_start, self.b_start = self.a_end - a_len[self.a], self.b_end - b_len[self.b]
        left = pd.DataFrame({"doc": self.doc_a, "at": self.a_start, "a": np.arange(len(self.a))})
        right = pd.DataFrame({"doc": self.doc_b, "at": self.b_start, "b": np.arange(len(self.b))})
        of_a = pd.merge_asof(left, right, on="at", by="doc")
        of_b = pd.merge_asof(right, left, on="at", by="doc", allow_exact_matches=False)  # equal starts are found from A's side
        later = np.flatnonzero(of_b["a"].notna().to_numpy())
        back = of_b["a"].to_numpy(np.float64)[later].astype(np.int64)
        covers = self.a_end[back] > self.b_start[later]  # a start that A's side shares is not inside A's token before
        x, y = np.concatenate([of_a["a"].to_numpy(), back[covers]]), np.concatenate([of_a["b"].to_numpy(np.int64), later[covers]])
        together = self.a_end[x] == self.b_end[y]
        self.x, self.y = x, y
        by = np.argsort(x[together], kind="stable")
        self.link_x, self.link_y = x[together][by], y[together][by]
        ends = self.a_end[self.link_x]
        self.a_group, self.b_group = np.searchsorted(ends, self.a_end), np.searchsorted(ends, self.b_end)

    def written(self, kinds_a: int) -> tuple[np.ndarray, np.ndarray]:
        """What stands one after another in the groups' text, as places in _Sides.written, and its document."""
        n = len(self.link_x) + 1
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (self.a_group, self.b_group))
        last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64)[: len(g)]
        out, doc = (np.zeros(len(self.a) + len(self.b), np.int64) for _ in range(2))
        at_a, at_b = np.arange(len(self.a)) + before_b[self.a_group], np.arange(len(self.b)) + before_a[self.b_group + 1]
        out[at_a], doc[at_a] = 2 * self.a + last(self.a_group), self.doc_a
        out[at_b], doc[at_b] = 2 * (kinds_a + self.b) + last(self.b_group), self.doc_b
        return out, doc


def _batches(batches: Iterable[pa.RecordBatch], sides: _Sides) -> Iterator[tuple[list, list[int], Aligned]]:
    """Rows (row, doc_id, n_a, n_b), the places among them of those with tokens, and the alignment of these."""
    rows, tokens, held = [], [], 0
    full = lambda: (rows, [k for k, r in enumerate(rows) if r[2]], Aligned(tokens, sides.a_len, sides.b_len))
    for b in batches:
        for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            found = sides.tokens(text)
            rows.append((row, doc_id, *(map(len, found) if found else (0, 0))))
            if found:
                tokens.append(found)
            held += len(text or "")
            if held >= BYTES:
                yield full()
                rows, tokens, held = [], [], 0
    if rows:
        yield full()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def groups(docs: DataFrame, a: str | None = None, b: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, start, end (bytes of space + text), a_ids and b_ids: the groups of every document that has tokens."""
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))
    names = ["row", "doc_id", "start", "end", "a_ids", "b_ids"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, own, al in _batches(batches, _sides(a, b)):
            doc = al.doc_a[al.link_x]
            ends = al.a_end[al.link_x]
            base = np.concatenate([[0], ends[np.flatnonzero(np.diff(doc, append=-1))]])[doc] if len(doc) else doc
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
            parts = [np.split(ids, np.flatnonzero(np.diff(g)) + 1) if len(ids) else [] for ids, g in ((al.a, al.a_group), (al.b, al.b_group))]
            lists = [pa.array(p, pa.list_(pa.int32())) for p in parts]
            yield pa.RecordBatch.from_arrays([*(pa.array([found[own[d]][k] for d in doc.tolist()], pa.int64()) for k in (0, 1)), pa.array(starts - base), pa.array(ends - base), *lists], names)

    return in_arrow(_keyed(docs, id_col, text_col), rows, "row long, doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


def summaries(docs: DataFrame, a: str | None = None, b: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256 of every row, and its distinct linked
    id pairs (A's id times B's kinds, plus B's id; ascending int64) with how often each is linked (uint32), as bytes."""
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a, b)
        for found, own, al in _batches(batches, sides):
            n = len(own)
            links, overlaps = np.bincount(al.doc_a[al.link_x], minlength=n), np.bincount(al.doc_a[al.x], minlength=n)
            text, doc = al.written(len(sides.a_len))
            bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
            text = text.tolist()
            shas = [hashlib.sha256(b"".join(map(sides.written.__getitem__, text[lo:hi]))[:-1]).hexdigest() for lo, hi in zip(bounds, bounds[1:], strict=False)]
            key = (al.doc_a[al.link_x] << 40) + al.a[al.link_x] * sides.kinds + al.b[al.link_y]
            key, times = np.unique(key, return_counts=True)
            cuts = np.searchsorted(key, np.arange(n + 1) << 40).tolist()
            pair, times = key & ((1 << 40) - 1), times.astype(np.uint32)
            full = [(int(links[k]), int(links[k]), int(overlaps[k]), shas[k], pair[lo:hi].tobytes(), times[lo:hi].tobytes()) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
            of = dict(zip(own, full, strict=True))
            out = [(*r, *of.get(k, (0, 0, 0, "", b"", b""))) for k, r in enumerate(found)]
            kinds = [*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return in_arrow(_keyed(docs, id_col, text_col), rows, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary, times binary")


def pair_counts(found: DataFrame, kinds: int) -> DataFrame:
    """pair, n (its links in the corpus) and best (n is the highest of its B id) of summaries."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0

        def added() -> pa.RecordBatch:
            pair, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, inverse, np.concatenate([np.zeros(0, np.int64), *times]))
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for b in batches:
            for p, t in zip(b.column("pairs"), b.column("times"), strict=True):
                keys.append(np.frombuffer(p.as_py(), np.int64))
                times.append(np.frombuffer(t.as_py(), np.uint32).astype(np.int64))
                held += len(keys[-1])
            if held >= ADDED:
                yield added()
                keys, times, held = [], [], 0
        yield added()

    counts = cut(in_arrow(found.select("pairs", "times"), rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    highest = counts.groupBy((F.col("pair") % kinds).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(highest, F.col("pair") % kinds == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_hot(found: DataFrame, hot, rest: bool) -> DataFrame:
    """found's rows with what their frequent pairs give (count_sum, n_best, and rare, the number of other
    pairs); or row, pair and times of those others."""
    kept = [c for c in found.columns if c not in ("pairs", "times")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = hot.value
        for b in batches:
            pairs = [np.frombuffer(p.as_py(), np.int64) for p in b.column("pairs")]
            pair = np.concatenate([np.zeros(0, np.int64), *pairs])
            times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t.as_py(), np.uint32).astype(np.int64) for t in b.column("times"))])
            own = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            met = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            if rest:
                row = b.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row[own[~met]]), pa.array(pair[~met]), pa.array(times[~met])], ["row", "pair", "times"])
                continue
            total, top, rare = (np.zeros(len(pairs), np.int64) for _ in range(3))
            np.add.at(total, own[met], (times * n[at])[met] if len(known) else times[met])
            np.add.at(top, own[met], (times * best[at])[met] if len(known) else times[met])
            np.add.at(rare, own[~met], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(total), pa.array(top), pa.array(rare)], [*kept, "count_sum", "n_best", "rare"])

    columns = ", ".join(f"{n} {t}" for n, t in found.dtypes if n in kept)
    return in_arrow(found, rows, "row long, pair long, times long" if rest else f"{columns}, count_sum long, n_best long, rare long")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row of docs."""
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))
    found = cut(summaries(docs, a, b, id_col=id_col, text_col=text_col))
    counts = cut(pair_counts(found, _sides(a, b).kinds))
    first = counts.orderBy(F.desc("n"), "pair").limit(hot).toPandas().sort_values("pair")
    known = found.sparkSession.sparkContext.broadcast((first["pair"].to_numpy(np.int64), first["n"].to_numpy(np.int64), first["best"].to_numpy(np.int64)))
    part = _with_hot(found, known, False)
    rare = _with_hot(found, known, True).join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
    whole = part.filter("rare = 0").select(*out)
    met = part.filter("rare > 0").join(rare, "row").withColumns({"count_sum": F.col("count_sum") + F.col("more"), "n_best": F.col("n_best") + F.col("more_best")})
    return whole.unionByName(met.select(*out))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
