import math
import random
import zlib

import numpy as np
import pytest

from duofix.llm import quality, topk


def corpus(n=400, seed=4):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        w = ["".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(r.randint(3, 40))]
        docs.append((i, " ".join(w) + "." if good else " ".join(x + r.choice(["!!", "&&&", "###"]) for x in w), "x"))
        if r.random() < 0.8:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(1000, None, "y"), (1001, "", "y"), (None, "a b", "y"), (1002, "abc " * 40000, "y"), docs[0]]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, label string").repartition(3)
    lab = spark.createDataFrame([*labels, (labels[0]), (5000, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(d, lab, size=1 << 14).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) > 0.9 * len(test)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = quality.keep(d, lab, size=1 << 14)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(150)
    d = spark.createDataFrame(docs, "doc_id long, text string, label string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in quality.score(d, spark.createDataFrame(x, "doc_id long, quality int"), size=1 << 12).collect()} for x in (labels, turned))
    assert a == b


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(d, none, size=64).collect()] == [0.5]
    assert quality.score(d.limit(0), none, size=64).count() == 0


def brute(rows, every, k):
    """Sorted result rows; rows of equal ids are rows of their own."""
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (q, x) in enumerate(v):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, e)), i) for m, (i, e) in enumerate(v) if m != n and len(e) == len(x))[:k]
            out += [(q, r + 1, i, -y) for r, (y, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "leaf"), [(8192, 64), (60, 4), (7, 2)])
def test_top_k_equals_brute_force(spark, shard_rows, leaf):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(size=6))]) for i in r.permutation(400) - 30]
    rows += [(1000 + i, [0.5] * 6) for i in range(90)]  # ties
    rows += [(2000, None), (2020, []), (2040, [None] * 6), (2060, [float("nan")] * 6), (2080, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2100, [1.0, 2.0]), (2101, [1.0, 3.0])]
    rows += [(20, [2.0] * 6), (20, [2.5] * 6), (21, [3.0] * 6), *rows[:3]]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(df, k=7, shard_rows=shard_rows, leaf=leaf).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 20, 7)


def test_a_tree_visits_few_leaves_and_finds_all():
    r = np.random.default_rng(1)
    points = (r.normal(size=(4096, 3)) * 64).astype(np.int64)
    tree = topk.Tree(points, 32)
    seen = []
    tree.spans = [type("Span", (tuple,), {"__iter__": lambda self: (seen.append(1), tuple.__iter__(self))[1]})(x) for x in tree.spans]
    score, place = tree.search(points[:5], np.arange(5), 10, np.full(5, topk.LOW))
    for i in range(5):
        want = sorted(((-int(points[i] @ p), j) for j, p in enumerate(points) if j != i))[:10]
        assert sorted((-int(s), int(j)) for s, j in zip(score[i], place[i])) == want
    assert len(seen) < 60  # of 128 leaves for each of 5 queries


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(i, [1e6 * (i - 9), 3e6 / (i + 1)]) for i in range(21)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df, k=30).collect()) == brute(rows, 20, 30)
    assert topk.top_k(df.limit(0)).count() == 0
