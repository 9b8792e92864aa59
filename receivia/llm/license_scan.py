"""Operator 4: licence notices by exact set-similarity join of text blocks with templates.

A block is a window of words, whatever lines they stand on: a template's blocks are all windows of its
length and half as much again (SLACK words more at least). A block matches the template when it holds
at least THRESHOLD of its distinct words. Words are ordered by how many documents of the corpus hold
them, rarest first; a block can only match if it holds a word of the template's prefix in that order,
so only stretches around such words are read; a stretch must have enough template words (length filter)
and enough of them after its first prefix word (positional filter); the windows of stretches that pass
are counted exactly, so no match is lost. The templates are a small fixed table; the documents are
never compared with each other. Beside the matches, BASE phrases are found wherever their words stand
consecutively.

Null text counts as empty: no words, no labels, score 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import in_batches, quoted, table

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of common notices, as public licence texts give them.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "apache-grant": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
}
THRESHOLD, SLACK = 0.9, 6
#: Word bytes are 0-9, a-z and all from 128 on; others part words.
_PARTS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _need(words: frozenset, threshold: float) -> int:
    """The least whole number of words that is at least threshold of them."""
    share = round(threshold * 1000)
    return max(1, -(-share * len(words) // 1000))


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the (bounded) vocabulary stands."""

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (texts,) in batches:
            for text in texts:
                seen.update(vocabulary.intersection((text or b"").lower().translate(_PARTS).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = in_batches(docs.select(quoted(text_col).cast("binary").alias("text")), rows, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which phrase stands in joined (words with one blank between and around)."""
    found, at, word, last = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        found.append(word)
        last, at = at, joined.find(b" " + phrase + b" ", at + 1)
    return found


class Matcher:
    """The templates, indexed by the words of their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.sets = {k: frozenset(t.encode().split()) for k, t in templates.items()}
        vocabulary = frozenset().union(*self.sets.values())
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.need = {k: _need(s, threshold) for k, s in self.sets.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        for k, s in self.sets.items():
            for i, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.rare = frozenset(self.prefix)
        self.width = {k: n + max(SLACK, n // 2) for k, t in templates.items() for n in [len(t.split())]}

    def match(self, block: list[bytes]) -> dict[str, float]:
        known = sorted(self.rank.keys() & set(block), key=self.rank.__getitem__)
        found: dict[str, float] = {}
        tried = set()
        for j, word in enumerate(known):
            for k, i in self.prefix.get(word, ()):
                need = self.need[k]
                if k in tried or len(known) < need:
                    continue
                tried.add(k)  # its first word in common; a later one bounds no better
                if 1 + min(len(self.sets[k]) - i - 1, len(known) - j - 1) < need:
                    continue
                both = len(self.sets[k].intersection(known))
                if both >= need:
                    found[k] = both / len(self.sets[k])
        return found

    def windows(self, words: list[bytes]) -> tuple[dict[str, float], list[int]]:
        """The best containment of each template in a window, and the first words of the best windows."""
        at: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.rank:
                at.setdefault(w, []).append(p)
        near: dict[str, list[int]] = {}
        for w in self.rare & at.keys():
            for k, _ in self.prefix[w]:
                near.setdefault(k, []).extend(at[w])
        found: dict[str, float] = {}
        starts = set()
        for k, anchors in near.items():
            own, width = self.sets[k], self.width[k]
            if len(own & at.keys()) < self.need[k]:
                continue
            for low, high in _stretches(sorted(anchors), width):
                if k not in self.match(words[max(0, low) : high]):
                    continue
                both, start = _fullest(words, max(0, low), min(high, len(words)), own, width)
                if both >= self.need[k]:
                    found[k] = max(found.get(k, 0.0), both / len(own))
                    starts.add(start)
        return found, sorted(starts)


def _stretches(anchors: list[int], width: int) -> Iterator[tuple[int, int]]:
    """The words of all windows that hold one of the (sorted) anchors, as ranges apart."""
    low, high = anchors[0] - width + 1, anchors[0] + width
    for p in anchors:
        if p - width + 1 > high:
            yield low, high
            low = p - width + 1
        high = p + width
    yield low, high


def _fullest(words: list[bytes], low: int, high: int, own: frozenset[bytes], width: int) -> tuple[int, int]:
    """The most distinct words of own in a window of words[low:high], and where the first such starts."""
    held: Counter = Counter()
    inside: deque[int] = deque()
    best, start = 0, low
    for p in range(low, high):
        if words[p] not in own:
            continue
        inside.append(p)
        held[words[p]] += 1
        while inside[0] <= p - width:
            w = words[inside.popleft()]
            held[w] -= 1
            if not held[w]:
                del held[w]
        if len(held) > best:
            best, start = len(held), inside[0]
    return best, start


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its words, base phrases, labels, best containment and matched spans."""
    templates, phrases = templates or TEMPLATES, phrases or BASE
    vocabulary = frozenset(w for t in templates.values() for w in t.encode().split())
    frequency = document_frequencies(docs, vocabulary, text_col)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        matcher, wanted = Matcher(templates, frequency, threshold), [(p.encode(), label) for p, label in phrases.items()]
        for ids, texts in batches:
            out = [one(matcher, wanted, i, t or b"") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names)

    def one(matcher: Matcher, wanted: list, doc_id: int, text: bytes) -> tuple:
        words = text.lower().translate(_PARTS).split()
        joined = b" " + b" ".join(words) + b" "
        places = {label: at for p, label in wanted if (at := _places(joined, p))}
        every = [x for at in places.values() for x in at]
        matched, blocks = ({}, []) if matcher.rare.isdisjoint(words) else matcher.windows(words)
        score = 1.0 if every else max(matched.values(), default=0.0)
        return doc_id, len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *matched})), score, blocks

    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("text"))
    return in_batches(slim, rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<long>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
