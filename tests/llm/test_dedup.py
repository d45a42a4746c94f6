"""Deduplication and decontamination against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesselake.llm import decontaminate, neardup, substring

LONG = " ".join(f"w{i}" for i in range(60))


def brute_repeats(docs, window):
    words = [(i, t.encode().split() if t else []) for i, t in docs]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[j : j + window])] = min(i, first.get(tuple(w[j : j + window]), i))
    out = []
    for (i, t), (_, w) in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, t if not any(gone) else b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rnd.randint(3, 40))] for k in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p))
            w += p[a:] + [rnd.choice("abc") for _ in range(rnd.randint(0, 20))]
        docs.append((rnd.randint(0, n), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed, size", [(1, 500), (2, 1 << 20)])
def test_repeats(spark, seed, size):
    docs = [*corpus(seed), (None, LONG), (3, None), (4, ""), (5, LONG), (9, LONG), (9, LONG), (10, "x\x1cy\x0bz " + LONG)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, n_words int, b string")
    got = sorted(map(tuple, substring.remove_repeats(df, 5, size).select("doc_id", "text", "n_words", "n_removed").collect()), key=str)
    assert got == brute_repeats(docs, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring.without_repeats(docs).count() == neardup.near_duplicates(docs).count() == decontaminate.contaminated(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contaminated(some, bench).count() == 0 and decontaminate.clean(some, bench).count() == 1


def test_text_matches_digest_rule(spark):
    df = spark.createDataFrame([("  a \t b\n",), ("",), (None,), ("a\x1cb",)], "text string")
    assert [r[0] for r in df.select(substring.kept_words()).collect()] == ["a b", "", "", "a\x1cb"]


def near_corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, i = [], 0
    for size in (2, 3, 5, 30):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            docs.append((i, " ".join(w)))
            i += 1
    docs += [(i + k, " ".join(word() for _ in range(40))) for k in range(40)]
    line = " ".join(word() for _ in range(9))
    docs += [(100 + k, line + " " + " ".join(word() for _ in range(3))) for k in range(20)]
    return docs + [(200, "one two"), (201, "one two"), (202, "two one"), (203, ""), (204, None), (205, ""), (206, "One Two")]


def test_near_duplicates(spark):
    docs = near_corpus()
    cls = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bucket_bytes=3000).collect()}
    assert len(cls) == len(docs)
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in docs if (w := (t or "").lower().split())}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    import math

    weight = lambda x: 1 + math.log(len(docs) / df[x]) / math.log(len(docs))
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(grams, 2):
        if grams[a] & grams[b] and sum(map(weight, grams[a] & grams[b])) >= 0.8 * sum(map(weight, grams[a] | grams[b])):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert cls == {i: root(i) for i in parent}


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, LONG, "x"), (2, LONG, "y"), (2, LONG, "y"), (3, "other", "z"), (3, "other", "z"), (None, LONG, "n")], "doc_id long, text string, class_id string")
    assert sorted(map(str, [r["doc_id"] for r in neardup.one_of_each(docs).collect()])) == ["1", "3", "None"]


def test_one_of_each_judges_rows_by_their_text(spark):
    near = LONG.replace("w59", "changed")
    rows = [(1, LONG, "a"), (7, "quite another text", "b"), (7, near, "c"), (7, "a third text", "d"), (7, "a third text", "d"), (7, None, "e"), (8, "a third text", "f"), (None, LONG, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    assert sorted(r["class_id"] for r in neardup.one_of_each(docs).collect()) == ["a", "b", "d", "e", "n"]


def test_texts_of_one_id_all_count(spark):
    docs = [(i % 40 if i % 3 else i, t) for i, t in near_corpus()] + [(None, LONG)]
    cls = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bucket_bytes=3000).collect()}
    grams = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if i is not None and (w := (t or "").lower().split()) else set() for i, t in docs]
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    import math

    n = len(docs)
    weight = lambda x: 1 + math.log(n / df[x]) / math.log(n)
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(n), 2):
        if grams[a] & grams[b] and sum(map(weight, grams[a] & grams[b])) >= 0.8 * sum(map(weight, grams[a] | grams[b])):
            x, y = sorted((root(docs[a][0]), root(docs[b][0])))
            parent[y] = x
    assert len({i for i, _ in docs}) < n - 20 and cls == {(i, root(i)) for i in parent}


def test_tiles_cover_reordered_passages():
    a = [f"a{i}" for i in range(20)]
    b = ["x"] + a[12:20] + ["y"] + a[0:7] + a[7:12]
    tiles = decontaminate.tile(a, b)
    assert sorted((i, n) for i, _, n in tiles) == [(0, 12), (12, 8)]
    assert decontaminate.tile(["a"] * 12, ["a"] * 7) == [(0, 0, 7)]
    assert decontaminate.tile([], a) == []


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of places."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return total
        i, j, n = best
        ma[i : i + n], mb[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiling_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        base = [f"v{i}" for i in range(30)]
        b = []
        for _ in range(3):
            i = rnd.randrange(30)
            b += base[i : i + rnd.randint(1, 15)] + ["z"]
        assert sum(n for _, _, n in decontaminate.tile(base, b, 4)) == brute_tiles(base, b, 4)


def test_contaminated(spark):
    item = " ".join(f"q{i}" for i in range(30))
    turned = " ".join([f"q{i}" for i in range(15, 30)] + ["mid"] + [f"q{i}" for i in range(15)])
    part = " ".join(f"q{i}" for i in range(10))
    docs = [(1, f"start {item.upper()}, end"), (2, turned), (3, part + " rest"), (4, None), (5, ""), (6, LONG), (7, f"{LONG} tiny one {LONG}"), (7, item)]
    bench = [(1, item), (2, item), (3, "tiny, one!"), (4, ""), (5, None)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for size in (1, 1 << 20):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items, size).collect())
        assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (7, 1), (7, 2), (7, 3)]
        assert sorted(r["doc_id"] for r in decontaminate.clean(df, items, size).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(df.withColumn("item_id", F.lit("x")), items).count() == 7


def test_samples_agree_as_often_as_documents_do():
    import numpy as np

    rng = np.random.default_rng(1)
    shingles = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weights = (1 + rng.random(400)).astype(np.float32)
    kept = rng.random(400) < 0.85
    one = neardup.samples(np.zeros(400, int), shingles, weights, 2000)[1][0]
    two = neardup.samples(np.zeros(kept.sum(), int), shingles[kept], weights[kept], 2000)[1][0]
    similar = neardup.weighted_jaccard(shingles, weights, shingles[kept], weights[kept])
    assert abs((one == two).mean() - similar) < 0.04
    both = neardup.samples(np.r_[np.zeros(400, int), np.ones(kept.sum(), int)], np.r_[shingles, shingles[kept]], np.r_[weights, weights[kept]], 2000)[1]
    assert (both == np.stack([one, two])).all()
