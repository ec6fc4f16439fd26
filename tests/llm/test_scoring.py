"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairwright.llm import common, importance, quality, ranked_search


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def prose(r, n, vocabulary=60):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- 11


def good_text(r):
    return ". ".join(" ".join(r.choice(("the", "river", "stone", "carried", "evening", "over", "little", "houses")) + "aeiou"[r.randrange(5)] * (r.random() < 0.3) for _ in range(r.randrange(6, 14))).capitalize() for _ in range(r.randrange(3, 9))) + "."


def bad_text(r):
    return r.choice((lambda: "BUY!! NOW!! " * r.randrange(5, 40), lambda: " | ".join(f"link{r.randrange(99)}" for _ in range(40)), lambda: "same line here\n" * r.randrange(5, 30)))()


def test_quality_of_held_out_documents(spark):
    r = random.Random(11)
    rows = [(d, bad_text(r) if d % 5 == 3 else good_text(r)) for d in range(400)]
    labels = [(d, int(d % 5 != 3), None) for d in range(400)] + [(5, None, 1), (None, 1, 0), (9999, 0, 0), (7, 2, 0)]
    t = quality.score(docs(spark, [(*x, "x", 1.0) for x in rows], ", score string, numbers double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ["doc_id", "numbers"])
    assert t.columns == ["doc_id", "numbers", "held_out", "score", "predicted"]
    got = {x.doc_id: x for x in t.collect()}
    assert len(got) == 400
    for d, x in got.items():
        assert x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 5 != 3) for x in held) >= 0.95 * len(held)


def test_discriminant_equals_plain_log_densities():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + 3
    y = (x[:, 0] + r.normal(size=300) > 3).astype(int)
    sums = {k: (int((y == k).sum()), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)}
    m = quality.fit(sums, ridge=0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / 300
    plain = []
    for k in (0, 1):
        own = z[y == k]
        few = 4 / (4 + len(own))
        c = (1 - few) * np.cov(own.T, bias=True) + few * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / 4 * np.eye(4)
        e = z - own.mean(axis=0)
        plain.append(np.log(len(own) / 300) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(m.difference(x), plain[1] - plain[0])
    order = np.argsort(m.difference(x))
    assert (np.diff(m.score(x)[order]) >= 0).all()
    assert quality.fit({1: sums[1]}) is None


def plain_statistics(text):
    """The same numbers of an ASCII text, one by one."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, chars = max(1, len(words)), max(1, len(text))
    share = lambda v: math.log(v + 0.01)
    mark = lambda c: not c.isalnum() and not c.isspace()
    letters = sum(c.isalpha() for c in text)
    low = [w.lower() for w in words]
    runs = lambda k: [tuple(low[i : i + k]) for i in range(max(1, len(low) - k + 1))] if low else []
    lens = np.array([len(w) for w in words] or [0])
    top = lambda xs: max(Counter(xs).values(), default=0)
    return [
        math.log1p(len(text)), math.log1p(len(words)), share(sum(c.isupper() for c in text) / max(1, letters)), share(sum(c.isdigit() for c in text) / chars), share(sum(map(mark, text)) / chars),
        share(sum(c in ".!?" for c in text) / n), share(text.count(",") / n), share(sum(sum(c.isupper() for c in w) >= 2 and w.upper() == w for w in words) / n), share(sum(all(map(mark, w)) for w in words) / n),
        share(sum(mark(w[-1]) and w[-1] not in ".,;:?\"')" for w in words) / n), share(sum(w[0].isupper() for w in words) / n), math.log1p(lens.sum() / n), float(np.sqrt(max(0, (lens**2).sum() / n - (lens.sum() / n) ** 2))),
        math.log1p(lens.max()), share(len(set(low)) / n**0.9), share(1 - len(set(runs(3))) / max(1, len(runs(3)))), share(top(low) / n), share(1 - len({x.lower() for x in lines}) / max(1, len(lines))),
        math.log1p(len(words) / max(1, len(lines))), share(top(runs(2)) / n),
    ]


def test_statistics_equal_plain_ones():
    texts = ["", "One", "A b\nc d\na B\n", "BUY!! NOW!! buy!! 12,5 (x) ---", "The cat. The cat sat, the cat. !", " \n\n ", "Ab " * 300]
    data = "".join(texts).encode()
    got = quality.statistics(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t) for t in texts)]))
    assert np.allclose(got, [plain_statistics(t) for t in texts])
    assert quality.statistics(np.frombuffer("É".encode(), np.uint8), np.array([0, 2]))[0][0] == math.log1p(1)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 300_000), (None, "some text"), (5, "a"), (5, "a")]
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    t = quality.score(docs(spark, rows), labels).collect()
    assert len(t) == 7 and all(x.score == 1.0 for x in t)  # one label alone: its share
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality.score(docs(spark, rows), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), labels).count() == 0
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 6)], "doc_id long, quality int")
    t = quality.score(docs(spark, rows), labels).collect()
    assert len(t) == 7 and all(0 <= x.score <= 1 for x in t) and len({x.score for x in t if x.doc_id in (1, 2)}) == 1
    kept = quality.good(docs(spark, [(*x, "k") for x in rows], ", predicted string").withColumnRenamed("predicted", "other"), labels)
    assert kept.columns == ["doc_id", "text", "other"]


# ---------------------------------------------------------------- 12


def plain_resample(rows, target, percent=5):
    def feats(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)

    f = [(d, *feats(t)) for d, t in rows]
    s, t = Counter(b for _, bs, _ in f for b in bs), Counter(b for x in target for b in feats(x)[0])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in s}
    out = []
    for d, bs, n in f:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize(("long_bytes", "chunk_words"), [(1 << 16, 8192), (40, 7), (0, 1)])
def test_resampling_equals_brute_force_however_texts_are_cut(spark, long_bytes, chunk_words):
    r = random.Random(12)
    rows = [(d, prose(r, r.choice((0, 1, 2, 3, 19, 20, 40, 120)))) for d in range(120)]
    rows += [(500, None), (501, ""), (502, "É été, Ñu-été É " * 9), (503, "!?" * 60), (504, "A  b\nC_d"), (505, "x" * 5000), (506, "LONG text of words " * 3000), (507, "\0\0 a\0b")]
    target = [prose(r, 30, 20) for _ in range(5)] + [None, "", "é été"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs(spark, [(*x, 1) for x in rows], ", weight int"), aim, percent=20, long_bytes=long_bytes, chunk_words=chunk_words).collect()
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in got), key=repr) == plain_resample(rows, target, 20)
    assert {x.doc_id: x.n_chunks for x in got}[506] == (1 if long_bytes > 40 else (12_000 - 2) // chunk_words + 1)


def test_chunks_own_each_word_once():
    text = " ".join(f"w{i}" for i in range(25)).encode()
    for size in (1, 2, 5, 23, 24, 25, 40):
        parts = list(importance.chunks(text, size, 3))
        assert sum(n for _, n in parts) == 25
        whole = Counter(importance.features(text)[0].tolist())
        assert sum((Counter(importance.features(c, n)[0].tolist()) for c, n in parts), Counter()) == whole
    assert list(importance.chunks(b" - ", 5)) == []


def test_resampling_of_repeats_ties_and_empty_tables(spark):
    same = "one two three " * 10
    rows = [(None, same)] * 3 + [(7, same)] * 4 + [(8, same)]
    aim = spark.createDataFrame([(0, "one two")], "item_id long, text string")
    got = importance.resample(docs(spark, rows), aim, percent=50).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4] and len(got) == 8
    by_score = sorted({(x.doc_id, x.score) for x in got}, key=lambda x: -x[1])
    assert {x.doc_id for x in got if x.rank == 1} == {by_score[0][0]}
    assert importance.resample(docs(spark, []), aim).count() == 0
    empty = importance.resample(docs(spark, rows), aim.limit(0)).collect()
    assert len({x.weight for x in empty}) == 1
    taken = importance.drawn(docs(spark, [(*x, "k") for x in rows + [(9, "few")]], ", rank string"), aim, percent=50)
    assert taken.columns == ["doc_id", "text", "rank"] and taken.count() >= 4


# ---------------------------------------------------------------- 13


def plain_search(rows, items, k=10):
    tf = [(d, Counter(terms(t))) for d, t in rows]
    tf = [(d, c) for d, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [3, 512])
def test_search_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    r = random.Random(13)
    rows = [(d, prose(r, r.choice((1, 3, 20, 60)), r.choice((10, 60, 400)))) for d in range(300)]
    rows += [(1000 + d, "same tie text w1") for d in range(25)] + [(2000, None), (2001, ""), (2002, "-- !"), (2003, "W1 é É w1É"), (2004, "w2 " * 40_000)]
    items = [(i, prose(r, 8, 60)) for i in range(12)] + [(50, "same tie text"), (51, None), (52, ""), (53, "unseen words"), (54, "É w1 W1"), (55, "w2"), (55, "w3 w3")]
    seen = []
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    got = ranked_search.search(docs(spark, [(*x, 1) for x in rows], ", rank int"), asked, visited=seen).collect()
    assert sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in got), key=repr) == plain_search(rows, items)
    if shard == 3:
        assert sum(n for n, _ in seen) < seen[0][1]  # some shards are never visited


def test_search_in_groups_of_items_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 40)
    r = random.Random(14)
    rows = [(d if d % 9 else None, prose(r, 12, 30)) for d in range(60)] + [(3, "w1 w2")] * 3
    items = [(i, prose(r, 4, 30)) for i in range(9)] + [(None, "w1 w2")]
    got = ranked_search.search(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_search(rows, items)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.item_id, x.rank, x.score) for x in got), key=lambda x: key(x)) == sorted(((i, k, s) for i, k, _, s in want), key=lambda x: key(x))
    none = spark.createDataFrame([], "item_id long, text string")
    for d, i in ((docs(spark, []), spark.createDataFrame(items, "item_id long, text string")), (docs(spark, rows), none), (docs(spark, [(1, None)]), none)):
        t = ranked_search.search(d, i)
        assert t.columns == ["item_id", "rank", "doc_id", "score"] and t.count() == 0


def test_bisection_brings_like_documents_together():
    r = np.random.default_rng(5)
    kind = r.integers(0, 2, 200)
    sets = [np.unique(r.integers(0, 40, 12) + 40 * k) for k in kind]
    off = np.cumsum([0, *(len(s) for s in sets)])
    splits, node = ranked_search.bisect(off, np.concatenate(sets), levels=1)
    assert np.bincount(node).min() >= 99
    side = [kind[node == k].mean() for k in (0, 1)]
    assert max(side) - min(side) > 0.85
    placed = ranked_search.clusters(splits, off, np.concatenate(sets))
    assert max(kind[placed == k].mean() for k in (0, 1)) > 0.95
    assert (ranked_search.clusters([], off, np.concatenate(sets)) == 0).all()
    assert ranked_search.bisect(np.zeros(1, np.int64), np.zeros(0, np.int64))[1].size == 0


def test_lengths_beyond_64_bits():
    n = np.array([10, 1 << 40])
    assert ranked_search.lengths(n, 1 << 30, 1 << 50).tolist() == [10 + 90 * 10 * (1 << 30) // (1 << 50), 10 + 90 * (1 << 40) * (1 << 30) // (1 << 50)]
    assert common.lists(common.arrow_lists(np.array([1, 2, 3]), np.array([0, 1, 3])).slice(1))[0].tolist() == [2, 3]
