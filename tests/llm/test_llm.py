"""Operators of the corpus against brute force on a small table with awkward rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from receivia.llm import components, html_extract, jaccard_join, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, rolling, substring_dedup, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, `the number` int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def make():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base, long_ = text(70), text(120), text(3000)
    rows = [None, "", " \n\t", "a b", "one", "THE the The", "x " * 400, long_, base, base, base + " end", text(10) + " " + passage + " " + text(30), passage + "\n" + text(40), text(60) + "\n" + passage]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += ["\n".join([text(12)] * 8), text(50) + "\nLicensed under CC BY-NC 4.0.\nAll rights reserved. CC by cc BY", "Licensed under the\tApache License, Version 2.0.", " ".join(w + "###" for w in text(80).split()), text(80).upper()]
    rows += [text(rng.randint(20, 200)) + ". Ça été, là-bas." for _ in range(30)]
    out = [(i, t, ("fr" if i % 7 == 0 else "en") if i % 5 else None, None if i % 11 == 0 else f"src{i % 3}", len(t or ""), "x", i) for i, t in enumerate(rows)]
    return [*out, out[8], out[0], out[11]]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty):
    first, want = {}, collections.Counter()
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t, *_ in ROWS:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            gone[k : k + 50] |= first[tuple(w[k : k + 50])] < i
        want[i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in substring_dedup.digest(docs).collect()) == want
    assert substring_dedup.digest(empty).count() == 0
    kept = substring_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert substring_dedup.cut_text(b"a  b\nc d e", [1, 3]) == b"a\nd e"


def jaccard(n, num, den):
    sets = {}
    for i, t, *_ in ROWS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    return collections.Counter((i, len(sets[i]), top(i)) for i, *_ in ROWS)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard_join(docs, n, num, den):
    got = jaccard_join.jaccard_components(docs, n=n, num=num, den=den)
    assert collections.Counter(tuple(r) for r in got.collect()) == jaccard(n, num, den)


def test_jaccard_of_nothing(empty):
    assert jaccard_join.keep_one(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 4), (7, 8), (8, 7), (5, 5)], "u long, v long")
    assert {tuple(r) for r in components.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 1), (7, 7), (8, 7)}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, carry="crc32").collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in {r[0]: r[1] for r in ROWS}.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        times = sum(r[0] == i for r in ROWS)
        assert sum(r["length"] for r in by_doc[i]) == times * len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in by_doc[i])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0
    one = packing.pack(docs.filter("doc_id = 3")).first()
    assert one["ids"] == [*t.encode("a b", add_special_tokens=False).ids, 1]


def test_patterns():
    histogram = {2048: 2, 1500: 3, 600: 2, 548: 3, 10: 7}
    used = collections.Counter()
    for times, lengths in packing.patterns(histogram):
        assert sum(lengths) <= 2048 and list(lengths) == sorted(lengths, reverse=True)
        for x in lengths:
            used[x] += times
    assert used == histogram


def test_packing_with_another_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.by_words(path) and packing.by_words(packing.default_tokenizer())
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids"] for r in packing.pack(docs.filter("doc_id IN (5, 11, 12)").distinct(), path).collect()}
    assert got == {i: [*t.encode(ROWS[i][1], add_special_tokens=False).ids, 1] for i in (5, 11, 12)}


@pytest.mark.parametrize("word", ["don't", "ab<|endoftext|>c", "<|startoftext|>!", "A1b2", "<|endoftext|>", "é!!", "naïve-...", "日本語テキスト", "İ", "áb", "x\x1cy", "ǅ", "3.14%"])
def test_word_ids(word):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    text = f"so {word} {word}. End"
    known = packing._WordIds(path)
    assert b"".join(known[p] for p in text.encode().split()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_license_scan(docs, empty):
    by = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
    labels = {r["labels"] for r in by.values()}
    assert labels == {"", "apache-2.0", "cc-by,cc-by-nc-4.0,reserved"}
    assert license_scan.scan(empty).count() == 0
    # filters lose nothing: against plain counting
    matcher = license_scan.Matcher(license_scan.TEMPLATES, {}, 0.6)
    rng = random.Random(1)
    for _ in range(300):
        block = [rng.choice(sorted(matcher.rank)) for _ in range(rng.randint(1, 25))]
        want = {k for k, s in matcher.sets.items() if len(s & set(block)) >= matcher.need[k]}
        assert set(matcher.match(block)) == want


def test_license_windows(spark):
    rng = random.Random(8)
    prose = lambda n: [rng.choice("lorem ipsum dolor sit amet so no".split()) for _ in range(n)]
    mit = " * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and\n * associated documentation files (the "
    bsd = "Redistribution and use in source and binary forms,\r\nwith or without modification, are permitted provided\r\n\r\nthat the following conditions are met:"
    long_ = prose(600)
    for at, w in zip((3, 120, 250, 380, 590), "released under the mit license".split(), strict=True):
        long_[at] = w  # all words of a template, scattered over one line
    late = " ".join([*prose(5000), "released under the terms of the MIT license", *prose(300)])
    docs = spark.createDataFrame(list(enumerate([mit, bsd, " ".join(long_), late, f"{' '.join(prose(40))} {bsd} {' '.join(prose(50))}"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"], r["blocks"]) for r in license_scan.scan(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {0: "mit-grant", 1: "bsd-grant", 2: "", 3: "mit", 4: "bsd-grant"}
    assert got[2][1:] == (0.0, []) and got[3][1:] == (1.0, [5000]) and got[4][2] == [40]
    # the filters lose no window: against plain counting of all
    matcher = license_scan.Matcher(license_scan.TEMPLATES, {}, 0.6)
    for _ in range(100):
        block = [rng.choice([b"x", rng.choice(sorted(matcher.rank)), rng.choice(sorted(matcher.sets["mit"]))]) for _ in range(rng.randint(1, 60))]
        best = {k: max(len(s & set(block[i : i + matcher.width[k]])) for i in range(len(block))) for k, s in matcher.sets.items()}
        assert matcher.windows(block)[0] == {k: n / len(matcher.sets[k]) for k, n in best.items() if n >= matcher.need[k]}


def tempered(totals, exponent):
    raised = {k: n**exponent for k, n in totals.items()}
    return {k: x / sum(raised.values()) for k, x in raised.items()}


def test_exponent(spark):
    totals = {"a": 9000, "b": 600, "c": 400}
    frame = spark.createDataFrame([*totals.items(), ("none", 0)], "source string, n long")
    w = tempered(totals, mixing.exponent_for(frame, 10000, 0.9, 10))
    assert abs(-sum(x * np.log(x) for x in w.values()) - 0.9 * np.log(3)) < 1e-6
    w = tempered(totals, mixing.exponent_for(frame, 10000, 1.0, 2.0))
    assert abs(max(w[k] * 10000 / n for k, n in totals.items()) - 2.0) < 1e-6
    assert mixing.exponent_for(frame, 10000, 0.1, 10) == 1.0 and mixing.exponent_for(frame, 10000, 1.0, 1e9) < 1e-5  # entropy is flat there
    assert mixing.exponent_for(frame.limit(0), 0, 0.9, 2) == mixing.exponent_for(frame.filter("n = 600"), 600, 0.9, 2) == 1.0
    with pytest.raises(ValueError, match="max_repeat"):
        mixing.exponent_for(frame, 10000, 0.9, 0.5)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_mixing(docs, empty, monkeypatch, bound):
    """Budgets, passes and permutations as counted by hand; with plans for every executor and shuffled ones."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    plan, sized = mixing.shares(docs, target=0.999, max_repeat=3.0)
    plans, every = {r["source"]: r for r in plan.collect()}, sized.collect()
    totals = collections.Counter()
    for r in every:
        totals[r["source"]] += r["n_tokens"]
    assert totals == {k: r["n"] for k, r in plans.items()} and sum(totals.values()) == sum(len(words(r[1])) for r in ROWS)
    got = mixing.used(sized, plan, 7).collect()
    whole = sum(totals.values())
    for source, p in plans.items():
        own = [r for r in every if r["source"] == source]
        drawn = [r for r in got if r["source"] == source]
        assert sum(r["n_tokens"] for r in drawn) <= p["weight"] * whole + 1e-6
        passes = collections.defaultdict(collections.Counter)
        for r in drawn:
            passes[r["pass"]][r["doc_id"], r["h"]] += 1
        for k in range(p["passes"]):
            assert passes[k] == collections.Counter((r["doc_id"], r["h"]) for r in own)
        # the last pass: blocks in its order, until the budget ends, and documents by hash in the last one
        blocks = collections.defaultdict(list)
        for r in own:
            blocks[r["h"] % p["blocks"]].append(r)
        order = {b: o for b, o in ((r["block"], r["position"]) for r in mixing.used(sized, plan.withColumn("passes", F.col("passes") + 1).withColumn("last", F.lit(None)).withColumn("rest", F.lit(0.0)), 7).filter(F.col("source") == source).filter(F.col("pass") == p["passes"]).collect())}
        left, want = p["rest"], collections.Counter()
        for b in sorted(blocks, key=order.__getitem__):
            size = sum(r["n_tokens"] for r in blocks[b])
            if size <= left:
                want.update((r["doc_id"], r["h"]) for r in blocks[b])
                left -= size
                continue
            for h in sorted({r["h"] for r in blocks[b]}):
                same = [r for r in blocks[b] if r["h"] == h]
                left -= sum(r["n_tokens"] for r in same)
                if left < 0:
                    break
                want.update((r["doc_id"], r["h"]) for r in same)
            break
        assert passes[p["passes"]] == want
    assert all(0 <= r["position"] <= 1 for r in got)
    twice = mixing.used(sized, plan.withColumn("passes", F.lit(2).cast("long")), 7).filter("source = 'src1'").collect()
    first, second = (list(dict.fromkeys(r["block"] for r in sorted(twice, key=lambda r: r["position"]) if r["pass"] == k)) for k in (0, 1))
    assert sorted(first) == sorted(second) and first != second
    out = mixing.mixed(docs, target=0.999, max_repeat=3.0)
    assert out.columns == docs.columns and out.count() == len(got) and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_mixing_without_ids(spark, monkeypatch, bound):
    """Rows with null or shared ids meet their source's budget, each by itself."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    rows = [(None, "w " * 90, "s")] * 50 + [(7, f"a{i} " * 10, "t") for i in range(40)] + [(i, "same words here", "u") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, sized = mixing.shares(docs, target=0.9)
    assert sized.select("h").distinct().count() == len(rows)
    got = collections.Counter()
    for r in mixing.used(sized, plan, 7).collect():
        got[r["source"]] += r["n_tokens"]
    for r in plan.collect():
        budget = r["weight"] * sum(len(t.split()) for _, t, _ in rows)
        assert budget - 180 <= got[r["source"]] <= budget + 1e-6, r
    mixed = collections.Counter()
    for r in mixing.mixed(docs, target=0.9).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert all(abs(mixed[k] - got[k]) <= 90 for k in "stu") and mixed["s"] > 2000


CLASHING = ["weight", "block", "_f", "_first", "_source", "_spans", "a.b", "row", "tag", "h", "position", "doc_id_", "least", "spans", "text_", "one", "word", "bits"]


def test_clashing_names(spark):
    """Stages that pass rows through do so whatever other columns are named."""
    rows = [(i, t, "en", "s", *[f"{k}{i}" for k, _ in enumerate(CLASHING)]) for i, t, *_ in ROWS[:20]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *(f"`{c}` string" for c in CLASHING)]))
    by = {r[0]: tuple(r)[4:] for r in rows}
    for stage in (quality_rules.keep_good, jaccard_join.keep_one, substring_dedup.remove_repeats, mixing.mixed):
        got = stage(docs)
        assert got.columns == docs.columns
        assert all(tuple(r)[4:] == by[r[0]] for r in got.collect())


def test_topk(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v[50:200] = v[50]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (None, [1.0] * 8), (903, [float("inf")] * 8)]
    q = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {tuple(r) for r in topk_search.search(q, q.filter("vec_id % 20 = 0")).collect()}
    z = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    want = set()
    for i in range(0, 400, 20):
        s = z @ z[i]
        for rank, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != i][:20], 1):
            want.add((i, rank, int(j), int(s[j])))
    assert got == want
    none = topk_search.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search.search(none, none).count() == 0


def test_language_id(spark, docs, empty):
    en, fr = "the quick brown fox jumps over the lazy dog and then sleeps ", "le renard brun saute par dessus le chien paresseux et puis il dort "
    train = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.train(train)
    ask = spark.createDataFrame([(1, en * 3), (2, fr * 3), (3, None), (4, "123 !?"), (5, ""), (6, en * 30 + fr * 12), (7, "Ω")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in language_id.predict(ask, model).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    assert by[6]["languages"] == ["en", "fr"] and 0.5 < by[6]["score"] < 0.9 and by[7]["lang_pred"] in ("en", "fr")
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_six_languages():
    """A document's set may hold all learned languages."""
    own = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzab"]
    rng = random.Random(9)
    text = lambda k, n: " ".join("".join(rng.choice(own[k]) for _ in range(5)) for _ in range(n)).encode()
    n = np.stack([np.bincount(language_id._grams(text(k, 3000)), minlength=language_id.BUCKETS) + 0.2 for k in range(7)])
    logs = np.log(n / n.sum(axis=1, keepdims=True))
    grams = language_id._grams(b" ".join(text(k, 400) for k in range(6)))
    cuts = np.arange(0, len(grams), language_id.RUN)
    (pi,) = language_id.shares(np.add.reduceat(logs.T[grams], cuts, axis=0), np.array([0]), np.array([len(cuts)]))
    assert np.allclose(pi, [1 / 6] * 6 + [0], atol=0.01)


def test_quality_rules(docs, empty):
    by = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in ROWS:
        w, f = words(t), by[i]["_f"]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (f["w"]["n_words"], f["w"]["word_chars"], f["n_symbols"], f["l"]["n_dup_lines"], f["w"]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert by[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (by[i]["base_failed"] and by[i]["kept"])
    assert by[8]["kept"] and quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_estimate():
    rng = random.Random(2)
    counted = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        counted[tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.85))] += 1
    prior, ratios = quality_rules.estimate(sorted(counted.items()))
    assert prior > 0.5 and ratios[0][1] > ratios[2][1] > 0 > ratios[2][-1] > ratios[0][-1]


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(docs, labels)
    assert got.count() == len(ROWS) and got.filter("p_quality IS NULL OR p_quality < 0 OR p_quality > 1").count() == 0
    assert quality_classifier.score(empty, labels).count() == 0
    assert quality_classifier.score(docs, labels.limit(0)).count() == len(ROWS)


def test_shrinkage(spark):
    """Strengths and posteriors as counted by hand; sparse sites stay near what is above them."""
    rng = random.Random(4)
    rows, k = [], 0
    for h in range(12):
        base = rng.random()
        for p in range(4):
            good = min(1.0, max(0.0, base + rng.uniform(-0.2, 0.2)))
            for _ in range(rng.choice([1, 2, 40])):
                rows.append((k, f"h{h}", f"p{p}", " ".join(["word"] * (60 if rng.random() < good else 4)) + " !" * rng.randrange(3)))
                k += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(i, int(len(t) > 60)) for i, _, _, t in rows if i % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    x = {i: got[i]["p_document"] for i, *_ in rows}
    by = lambda key: {g: [x[r[0]] for r in rows if key(r) == g] for g in {key(r) for r in rows}}
    hosts, paths = by(lambda r: r[1]), by(lambda r: r[1:3])
    mean, n = np.mean(list(x.values())), len(rows)

    def strength(groups, centre, above, crowd):
        inner = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - len(groups))
        outer = (sum(len(v) * (np.mean(v) - centre(g)) ** 2 for g, v in groups.items()) - (len(groups) - above) * inner) / (n - crowd)
        return min(1e6, max(1.0, inner / outer)) if outer > 0 else 1e6

    host_weight = strength(hosts, lambda g: mean, 1, sum(len(v) ** 2 for v in hosts.values()) / n)
    path_weight = strength(paths, lambda g: np.mean(hosts[g[0]]), len(hosts), sum(len(v) ** 2 / len(hosts[g[0]]) for g, v in paths.items()))
    for i, h, p, _ in rows:
        host = (sum(hosts[h]) + host_weight * mean) / (len(hosts[h]) + host_weight)
        path = (sum(paths[h, p]) + path_weight * host) / (len(paths[h, p]) + path_weight)
        assert abs(got[i]["p_host"] - host) < 1e-9 and abs(got[i]["p_path"] - path) < 1e-9
    right = [(got[i]["p_quality"] >= 0.5) == (len(t) > 60) for i, _, _, t in rows if i % 2 == 0]
    assert sum(right) > 0.95 * len(right)  # half of the labels are held out


@pytest.mark.parametrize("page", ["<font>" * 60_000 + "deep" + "</b>" * 60_000, "<a" * 300_000, "<a href='" * 30_000 + ">" * 10, "<script>" + "</script" * 60_000, "<!--" * 100_000, "<p class='a\">x" * 30_000])
def test_broken_pages(page):
    """Deep, long and unclosed markup takes seconds, and nothing fails."""
    began = time.time()
    text = html_extract.extract(page, page, [1])
    list(html_extract.slot_texts(html_extract.parse(page), page))
    assert time.time() - began < 20 and isinstance(text, str)


HTML = """<!doctype html><html><head><title>T</title><script>if (a<b) document.write("</p>")</script></head><body>
<header>Site</header><nav><a href=x>Menu</a></nav><aside class=sidebar>More</aside>
<article><h1>Head &amp; tail</h1><p>First   <b>bold
line</b>.<p>Second&nbsp;&lt;one&gt;<br>third<div class="ad-box ad">Buy</div><form><input>Find</form><section class="comments"><p>Nice!</section></article>
<footer>&copy; me</footer></body>"""


def test_html(spark, monkeypatch):
    want = "Head & tail\nFirst bold line.\nSecond <one>\nthird"
    assert html_extract.extract(HTML) == want
    assert html_extract.extract("<p>a<p>b<style>x") == "a\nb" and html_extract.extract("<<<") != None  # noqa: E711
    pages = spark.createDataFrame([(1, "http://a.b/c", HTML), (2, None, None), (3, "http://a.b/d", ""), (1, "http://a.b/c", HTML)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(pages).collect()) == [(1, want), (1, want), (2, ""), (3, "")]
    many = spark.createDataFrame([(i, "http://h/x", f"<body><div><p>Text number {i}</p><span>Same words on every page</span></div></body>") for i in range(30)], "page_id long, url string, html string")
    texts = {(i, f"Text number {i}") for i in range(30)}
    assert {(r["page_id"], r["text"]) for r in html_extract.extract_pages(many).collect()} == texts
    monkeypatch.setattr(html_extract, "BROADCAST", 0)  # wrappers meet pages under salted hosts
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(many, salts=3).collect()) == sorted(texts)


def on_host(spark, htmls):
    pages = spark.createDataFrame([(i, "http://h/x", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_pages(pages).orderBy("page_id").collect()]


def test_wrappers_without_names(spark):
    """Fixed blocks beside content of the same tag, with parts that hold no text, on 3 pages and 25."""
    page = "<body><p>Fixed<br>notice <img src=x></p><div><a><span>Home</span></a><hr></div><div><p>Fixed line</p>{}<p>Last words</p></div><div>Foot <b>fixed</b></div></body>"
    for n in (3, 25):
        own = [[f"Text {i} part {k} <i>with</i> more" for k in range(1 + i % 3)] for i in range(n)]
        got = on_host(spark, [page.format("".join(f"<p>{x}</p>" for x in part)) for part in own])
        assert got == ["\n".join(x.replace("<i>", "").replace("</i>", "") for x in part) for part in own]


def test_wide_lists(spark):
    """Siblings beyond 64 kinds match too, in any order."""
    kinds = [f"<x{k}>kind {k}</x{k}>" for k in range(90)]
    got = on_host(spark, [f"<body><div>{''.join(kinds[i:] + kinds[:i])}<p>Text {i}</p></div></body>" for i in range(4)])
    assert got == [f"Text {i}" for i in range(4)]


def test_containers(spark):
    """All articles stay; without one, the slot with the varying text and its heading."""
    fixed = "<table><tr><td>Fixed</table>"
    assert on_host(spark, [f"<body>{fixed}<article><p>One {i}</article><article><p>Two is longer {i}</article></body>" for i in range(3)]) == [f"One {i}\nTwo is longer {i}" for i in range(3)]
    body = lambda i: " ".join(f"word{i}" for _ in range(60))
    assert on_host(spark, [f"<body>{fixed}<h1>Title {i}</h1><section><p>{body(i)}</p><p>End {i}</p></section><table><tr><td>Seen {i} times</table></body>" for i in range(3)]) == [f"Title {i}\n{body(i)}\nEnd {i}" for i in range(3)]
    # copies of one page are no template, and a page of fixed text alone keeps it
    same = f"<body><p>{body(1)}</p></body>"
    assert on_host(spark, [same] * 4) == [body(1)] * 4
    assert on_host(spark, ["<body><p>Fixed</p></body>", "<body><p>Fixed</p><p>a</p></body>", "<body><p>Fixed</p><p>b</p></body>"]) == ["Fixed", "a", "b"]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 16, 17):
        assert (rolling.sliding_min(x, width) == [x[i : i + width].min() for i in range(51 - width)]).all()


def test_pipeline(spark, docs, empty):
    for table in (docs, empty):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, corpus_pipeline.cut(stage(spark, at, ""))
            assert name == "packing" or at.columns == table.columns
            assert at.count() <= 3 * before.count() or name == "packing"


def test_pipeline_by_brute_force(spark):
    """Near copies and repeats as counted by hand, over null ids, ids with several texts and copies."""
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    a, b, c, passage = text(120), text(90), text(80), text(60)
    near = " ".join(a.split()[:-2])
    rows = [(None, a), (None, a), (None, None), (1, a), (1, a), (1, b), (2, near), (0, near + " end"), (3, c), (3, c.upper()), (3, f"{passage} {text(30)}"), (4, b), (5, ""), (5, " \n"), (5, None), (6, "x"), (7, f"{text(20)} {passage} {text(20)}"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, k int")

    def grams(t):
        w = words((t or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    every = [(i, grams(t)) for i, t in rows if i is not None]
    group = {x: {x} for x in every}
    for x in every:
        for y in every:
            if x[1] and y[1] and 10 * len(x[1] & y[1]) >= 8 * len(x[1] | y[1]) and group[x] is not group[y]:
                both = group[x] | group[y]
                group.update(dict.fromkeys(both, both))
    want = collections.Counter(min(g, key=lambda x: x[0]) for g in {id(g): g for g in group.values()}.values())
    want.update((i, grams(t)) for i, t in rows if i is None)
    kept = corpus_pipeline.cut(corpus_pipeline.near_duplicates(spark, docs, ""))
    got = kept.collect()
    assert kept.columns == docs.columns and all(rows[r["k"]] == (r["doc_id"], r["text"]) for r in got)
    assert collections.Counter((r["doc_id"], grams(r["text"])) for r in got) == want
    # the passage of 60 words stays in the document with the smaller id alone
    shorter = {r["k"]: r["text"] for r in corpus_pipeline.substrings(spark, kept.filter("doc_id >= 3"), "").collect()}
    held = {k: passage in " ".join(words(t)) for k, t in shorter.items()}
    assert held[10] and not held[16] and len(words(shorter[16])) == 40
    # packing: every row's words and end mark, in full
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    packed = corpus_pipeline.pack(spark, kept.coalesce(1), "").agg(F.sum("length")).first()[0]
    assert packed == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in got)


def test_dotted_and_taken_names(spark):
    rows = [(1, "Some words that are here for reading, and more of them than ten. " * 3, "x"), (2, None, "y")]
    docs = spark.createDataFrame(rows, "`a.id` long, `a.text` string, _text string")
    assert packing.place(packing.pieces(docs, packing.default_tokenizer(), id_col="a.id", text_col="a.text")).count() == 2
    assert license_scan.scan(docs, id_col="a.id", text_col="a.text").count() == 2
    assert quality_rules.judge(docs.withColumnRenamed("a.text", "text").withColumnRenamed("a.id", "doc_id")).count() == 2
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>text</p>")], "`a.id` long, `a.url` string, `a.html` string")
    assert html_extract.extract_pages(pages, id_col="a.id", url_col="a.url", html_col="a.html").count() == 1
