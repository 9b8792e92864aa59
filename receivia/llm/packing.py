"""Operator 3: documents packed into sequences by shortest-pack-first over the length histogram.

Documents are tokenised once. A document longer than a sequence is cut into full sequences and a
rest; full sequences and rests are the pieces. Only the histogram of piece lengths (at most one
entry per length) reaches the driver, which places lengths longest first into the packing pattern
with most room left and updates how often each pattern is used. Patterns are joined back to pieces
by rank: a piece's rank among those of its length names its slot.

Any tokenizer file of the tokenizers library will do. Strings of special tokens in a text become those
tokens, as the tokenizer's encode does by itself. A text is encoded whole, however long. Null or empty
text is the end token alone. Rows are packed each for itself, so repeated rows are
packed repeatedly. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import heapq
import json
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_arrow, quoted, table, tokenizer

SIZE, END = 2048, 1
#: Pieces in a batch of results.
AT_ONCE = 2048
#: Words, and runs of letters or of marks, whose ids a worker remembers at most.
WORDS, RUNS = 400_000, 250_000
#: ASCII marks that the tokenizer parts from letters before them, as one run.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Remembered(dict):
    """Little-endian uint32 ids by text; what was not asked for lately is forgotten."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def __missing__(self, key):
        ids = self.older.get(key)
        if ids is None:
            ids = self.ids(key)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Runs(_Remembered):
    """Of runs: lower-case letters up to U+00FF, or ASCII marks. Such a run has the same ids wherever
    it stands, and they come from the tokenizer's model alone."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        super().__init__(RUNS)
        self.model, self.to_bytes = tokenizer(path, False).model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, run: str) -> bytes:
        seen = run if run.isascii() else self.to_bytes.pre_tokenize_str(run)[0][0]
        return _packed([t.id for t in self.model.tokenize(seen)]) if run else b""


#: How a tokenizer file normalises and splits texts whose words can be encoded one by one (fixed values).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(path: str) -> bool:
    """Whether the tokenizer drops white space, never joins text across it, and reads a word alike wherever
    it stands; as its file says."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split, to_bytes = before[0], before[-1]
    dropped = split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
    plain = len(before) == 2 and to_bytes.get("type") == "ByteLevel" and not to_bytes.get("add_prefix_space") and not to_bytes.get("use_regex", True)
    tight = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return dropped and plain and tight and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and spec.get("post_processor") is None and not spec["model"].get("dropout")


class _WordIds(_Remembered):
    """Of words: where by_words() holds, the ids of a text are those of its words, one after the other.
    Texts for any other tokenizer are encoded whole."""

    def __init__(self, path: str):
        super().__init__(WORDS)
        self.tokenizer, self.by_words = tokenizer(path, False), by_words(path)
        self.runs = _Runs(path) if self.by_words else None

    def text(self, data: bytes) -> bytes:
        """Ids of a text."""
        if self.by_words:
            return b"".join(map(self.__getitem__, data.split()))
        return _packed(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        letters = text.rstrip(_MARKS)
        if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
            return self.runs[letters.lower()] + self.runs[text[len(letters) :]]
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def _known(path: str) -> _WordIds:
    """One for all tasks of a Python worker."""
    return _WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: str = "ids") -> DataFrame:
    """doc_id, start, length, doc_tokens and either ids (array) or ids_crc32, a row per piece."""
    end = np.array([END], "<u4").tobytes()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _known(path).text
        out: list[list] = [[], [], [], [], []]
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = ids_of(text.as_py() or b"") + end
                n = len(data) // 4
                for start in range(0, n, size):
                    part = data[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc_id, start, len(part) // 4, n, np.frombuffer(part, "<u4").astype(np.int32) if carry == "ids" else zlib.crc32(part)), strict=True):
                        column.append(value)
                if len(out[0]) >= AT_ONCE:
                    yield batch(out)
                    out = [[], [], [], [], []]
        yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        last = pa.array(out[4], pa.list_(pa.int32())) if carry == "ids" else pa.array(out[4], pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), last], names)

    last = "ids array<int>" if carry == "ids" else "ids_crc32 long"
    names = ["doc_id", "start", "length", "doc_tokens", last.split()[0]]
    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("text"))
    return in_arrow(slim, rows, f"doc_id long, start long, length long, doc_tokens long, {last}")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(times used, lengths) of each packing pattern: lengths longest first, each into the patterns
    that have most room; a new pattern opens where none has room."""
    open_: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, order, times, lengths)
    done, order = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if open_ and -open_[0][0] >= length:
                room, _, times, lengths = heapq.heappop(open_)
                used = min(times, left)
                if used < times:
                    heapq.heappush(open_, (room, order, times - used, lengths))
                    order += 1
                room, lengths = -room - length, (*lengths, length)
            else:
                used, room, lengths = left, size - length, (length,)
            left -= used
            if room:
                heapq.heappush(open_, (-room, order, used, lengths))
                order += 1
            else:
                done.append((used, lengths))
    return done + [(times, lengths) for _, _, times, lengths in open_]


def _ranked(found: DataFrame, total: int) -> DataFrame:
    """found with its rank from 0 among the pieces of its length. Ranks are counted within salted
    groups and shifted by the sizes of the groups before, so that no length meets in one task."""
    salts = max(1, math.isqrt(total))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    shift = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    return salted.withColumn("within", within).join(shift.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "within", "before")


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found (with doc_id, start and length) with sequence_id and offset."""
    found = cut(found)
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    slots: list[tuple[int, int, int, int]] = []  # length, rank of the first, its sequence, offset
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in patterns(histogram, size):
        at = 0
        for length in lengths:
            slots.append((length, used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + times
            at += length
        sequence += times
    slots.sort()
    by_length, first, base, at_ = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else ((), (), (), ())))
    starts = (by_length << 44) + first

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            columns = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base[k] + rank - first[k]), pa.array(at_[k])], [*(n for n in b.schema.names if n != "rank"), "sequence_id", "offset"])

    ranked = _ranked(found, sum(histogram.values()))
    kept = [f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank"]
    return in_arrow(ranked, assign, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str | None = None, *, size: int = SIZE, carry: str = "ids") -> DataFrame:
    """Every piece of docs with its ids (or their checksum) and its place in a sequence."""
    return place(pieces(docs, path or default_tokenizer(), size=size, carry=carry), size)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), carry="crc32").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
