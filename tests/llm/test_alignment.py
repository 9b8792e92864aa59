"""Operator 13 against brute force on a small table with awkward rows."""

import collections
import hashlib

import pytest

from receivia.llm import token_alignment as ta

TEXTS = [None, "", " ", "  ", "a", "Ça été, là-bas — naïve 日本語 🙂", "<|endoftext|> <s> </s> <unk> <0x0A>", "tab\tand\nlines\r\n\n  end ", "▁ a word", "the cat the cat", "\x00\x01", "x" * 3000, "ab " * 4000, "don't  stop", "é ﬁ"]
SCHEMA = "doc_id long, text string, `row` string, `a.b` int, pairs int, rare int"


def rows():
    out = [(i, t, "x", 1, 2, 3) for i, t in enumerate(TEXTS)]
    return [*out, (None, "a null id", "x", 1, 2, 3), out[5], out[9], (9, "another text", "x", 1, 2, 3)]


def by_hand(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, sha, n_overlaps of each text, from all pairs of tokens."""
    a, b = ta._sides(*ta.default_tokenizers()).a, ta._sides(*ta.default_tokenizers()).b
    slow = ta.tokenizer(ta.default_tokenizers()[0])
    found = []
    for t in texts:
        x, y = (slow.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spans = []
        for ids, side in ((x, a), (y, b)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(side.bytes_of[i])))
                at = out[-1][2]
            spans.append(out)
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(s.bytes_of[i] for i in ids) != whole for ids, s in ((x, a), (y, b))):
            found.append(([], [], [], [], 0, ""))
            continue
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, _, e in s if lo < e <= hi) for s in spans) for lo, hi in zip([0, *ends], ends, strict=False))
        overlaps = [(p, q) for p in spans[0] for q in spans[1] if p[1] < q[2] and q[1] < p[2]]
        links = [(p[0], q[0]) for p, q in overlaps if p[2] == q[2]]
        found.append((x, y, ends, links, len(overlaps), hashlib.sha256(groups.encode()).hexdigest()))
    count = collections.Counter(p for f in found for p in f[3])
    most = collections.defaultdict(int)
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    return [(len(x), len(y), len(e), len(li), sum(count[p] == most[p[1]] for p in li), sum(count[p] for p in li), sha, n) for x, y, e, li, n, sha in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("hot", [0, 7, 1 << 20])
def test_aligned(docs, hot):
    short = [r for r in rows() if len(r[1] or "") < 200]
    got = ta.aligned(docs.filter("text IS NULL OR length(text) < 200"), hot=hot).collect()
    want = [(r[0], *w) for r, w in zip(short, by_hand([r[1] for r in short]), strict=True)]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
    assert sorted(map(str, ([r[n] for n in names] for r in got))) == sorted(map(str, map(list, want)))
    assert sum(r["n_a"] > 0 for r in got) >= 10 and sum(r["n_a"] == 0 and r["groups_sha256"] == "" for r in got) >= 2


def test_long_texts_and_groups(docs):
    got = {r["doc_id"]: r for r in ta.aligned(docs.filter("length(text) >= 3000")).collect()}
    assert len(got) == 2 and all(r["n_groups"] > 0 and r["n_groups"] == r["n_links"] for r in got.values())
    sides = ta._sides(*ta.default_tokenizers())
    for doc_id, row in got.items():
        parts = sorted((r["start"], r["end"], list(r["a_ids"]), list(r["b_ids"])) for r in ta.groups(docs).filter(f"doc_id = {doc_id}").collect())
        whole = (" " + TEXTS[doc_id]).encode()
        assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(whole)
        assert all(b"".join(sides.a.bytes_of[i] for i in a) == b"".join(sides.b.bytes_of[i] for i in b) == whole[s:e] for s, e, a, b in parts)
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for *_, a, b in parts)
        assert hashlib.sha256(text.encode()).hexdigest() == row["groups_sha256"]


def test_rank_encoder_is_the_tokenizer():
    sides, slow = ta._sides(*ta.default_tokenizers()), ta.tokenizer(ta.default_tokenizers()[0])
    assert sides.a.ranks is not None
    for c in map(chr, [*range(0x3100), *range(0xA000, 0xA100), *range(0xFB00, 0xFE00), *range(0x1F300, 0x1F400)]):
        text = f"a{c}b 1{c} {c}x"
        assert sides.a.encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert ta.aligned(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ta.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(ta.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()) == 1
