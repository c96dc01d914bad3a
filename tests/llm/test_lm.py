import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from duofix.llm import lm


def corpus(n=300, seed=2):
    r = random.Random(seed)
    langs = [["the", "of", "and", "thing", "word.", "Here"], ["de", "la", "et", "chose", "mot.", "Été"]]
    docs = []
    for i in range(n):
        v = langs[i % 2]
        docs.append((i, " ".join(r.choice(v) if r.random() < 0.85 else "".join(r.choices("abcdé,!", k=r.randint(2, 12))) for _ in range(r.randint(0, 60)))))
    return [*docs, (n, None), (n + 1, ""), (n + 2, "zzzz unseen\tTHE\x0b"), (n + 3, "word " * 5000)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_counts_and_base_score_equal_brute_force(spark, frequent):
    docs = corpus()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, row string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, frequent=frequent, least_rows=1 << 10).collect()}
    assert len(got) == len(docs)
    model = base = 0
    for d, t in docs:
        r, w = got[d], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(x in c for x in w), n)
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r.base_score == pytest.approx(want, rel=1e-9) and math.isfinite(r.score) and r.score <= 0
        if r.held_out:
            model, base = model + r.score, base + want
    assert model > base


def test_probabilities_of_the_next_word_sum_to_at_most_one(spark):
    """Scores of one text with every known word, and one unknown, in the last place but one."""
    docs = [(i, t) for i, t in corpus(60) if t and len(t) < 500 and zlib.crc32(str(i).encode()) % 5 != 1]
    vocabulary = sorted({w for _, t in docs for w in words(t) if w})
    ends = [(10**6 + i, "the of " + w) for i, w in enumerate([*vocabulary, "qqqqqqq"])]
    ends = [(d, t) for d, t in ends]
    held = [x for x in range(10**6, 2 * 10**6) if zlib.crc32(str(x).encode()) % 5 == 1]
    df = spark.createDataFrame(docs + [(held[i], t) for i, (_, t) in enumerate(ends)] + [(held[-1], "the of")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, least_rows=1 << 10).collect()}
    # P(the, of, w, end) summed over w is at most P(the, of)
    assert sum(10 ** got[held[i]] for i in range(len(ends))) <= 1


def test_scores_depend_neither_on_partitions_nor_on_order(spark):
    """Several shards and rounds; held-out texts gain over the unigram base."""
    docs = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r.doc_id: r for r in lm.score(x, least_rows=64, most_rows=64).collect()} for x in (df.repartition(4), df.orderBy("doc_id", ascending=False).repartition(64)))
    assert all(a[d].score == pytest.approx(b[d].score, rel=1e-6, abs=1e-6) for d in a)
    held = [r for r in a.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / tokens > 0.03


def test_the_softmax_inside_a_class_reaches_its_optimum():
    """At the optimum the gradient, pairs - expected - prior * u, is nothing."""
    r = np.random.default_rng(0)
    pairs = r.poisson(r.gamma(0.5, 20, (40, lm.CONTEXTS))).astype(float)
    u, z = lm.inner_softmax(pairs.sum(axis=1), pairs, 2.0, 200)
    p = np.exp(np.log(pairs.sum(axis=1) + 0.5)[:, None] + u - z)
    assert (p.sum(axis=0) < 1).all() and np.abs(pairs - pairs.sum(axis=0) * p - 2.0 * u).max() < 2
    few = lm.inner_softmax(pairs.sum(axis=1), pairs, 2.0, 40)[0]
    assert np.abs(few - u).max() < 0.05


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, least_rows=64).count() == 0
    rows = lm.score(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), least_rows=64).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(True, 3, 0, 0)] * 2


def test_the_word_before_the_previous_one_is_a_feature_of_its_own():
    """Two histories that share only that word share a weight row besides the bias."""
    place = np.array([1, 2, 5, 1, 3, 5])
    f = lm.features(place, np.ones(6, np.int64), np.array([0, 3, 6]), np.full(8, -1), 1 << 16)
    x, y = f[2, 1:], f[5, 1:]
    assert [a == b for a, b in zip(x, y, strict=True)] == [False, False, True, True]  # no frequent word in either text
