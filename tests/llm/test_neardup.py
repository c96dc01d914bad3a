import random
import re

import numpy as np
import pytest

from duofix.llm import neardup
from duofix.llm.components import components
from duofix.llm.neardup import near_duplicates, shape, sketches
from duofix.llm.text import U, mix


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def brute(docs, percent):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=7, groups=12, copies=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 6)))
    docs, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.choice([1, 4, 6, 9, 11, 12, 60, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            docs.append((n * 3 + 5, (" " if r.random() < 0.5 else "\n").join(w) if r.random() < 0.8 else " ".join(w).upper()))
            n += 1
    r.shuffle(docs)
    return docs + [(1, None), (2, ""), (3, " \n ")]


@pytest.mark.parametrize(("percent", "block"), [(85, 192), (80, 4), (100, 4)])
def test_equals_brute_force(spark, percent, block):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, node int, k string").repartition(3)
    got = near_duplicates(df, percent=percent, block=block).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_without_broadcast_and_with_odd_rows(spark):
    docs = corpus(groups=4)
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (None, None), docs[0]], "doc_id long, text string")
    got = near_duplicates(df, broadcast_ids=0, block_bytes=500).collect()
    assert len(got) == len(docs) + 3
    want = brute(docs, 85)
    for r in got:
        assert (r.component_id is None and r.kept) if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    g = mix(np.arange(3000, dtype=U))
    d = np.concatenate([np.zeros(2000, int), np.ones(2000, int), [2]])
    members = np.concatenate([g[:2000], g[500:2500], g[:1]])
    s = sketches(d, members, 3, 400)
    assert (s != U(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
    assert (s[2] == sketches(np.array([0]), g[:1], 1, 400)[0]).all()


def test_shape_bounds_the_miss():
    for p in (80, 85, 95):
        b, r = shape(p)
        assert (1 - (p / 100) ** r) ** b <= 1e-8


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n", [1, 8191, 8192, 8193, 16385])
def test_every_shared_shingle_counts(n):
    d, g = np.repeat([0, 1], n), np.tile(np.arange(n, dtype=np.uint64), 2)
    u, v = neardup._forest(np.array([5, 9]), d, g, np.array([n, n]), 100)
    assert (u.tolist(), v.tolist()) == ([9], [5])
