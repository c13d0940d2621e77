"""Bigrams that training saw once count in the smoothed model."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import lm_score


def test_levels_of_counts():
    c = np.array([1, 2, 3, 4, 7, 8])
    assert lm_score.levels_of(c).tolist() == [1, 2, 2, 3, 3, 4]
    assert lm_score.counts_of(np.array([0, 1, 2, 3])).tolist() == [0.0, 1.0, 2.5, 5.5]


def test_bigram_seen_once_is_not_one_never_seen(spark):
    train = [(k, f"a{k} b{k} c{k} d{k}", False) for k in range(200)]
    asked = [(1000 + k, f"a{k} b{k} c{k} d{k}", True) for k in range(100)] + [(2000 + k, f"d{k} b{k} a{k} c{k}", True) for k in range(100)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in lm_score.score(spark, docs, held_out=F.col("h")).collect()}
    one, two = collections.Counter(), collections.Counter()
    pairs = lambda t: list(zip([None, *t.split()], [*t.split(), None]))
    for _, t, _ in train:
        one.update([*t.split(), None])
        two.update(pairs(t))
    n, v = sum(one.values()), len(one)
    q = lambda c: 0.0 if c == 0 else float(c) if c == 1 else 1.5 * 2 ** math.floor(math.log2(c)) - 0.5

    def score(t):
        p = lambda w: (q(one[w]) + 1) / (n + v + 1)
        return sum(math.log10((min(q(two[x, w]), q(one[x])) + lm_score.MU * p(w)) / (q(one[x]) + lm_score.MU)) for x, w in pairs(t))

    close = [abs(got[k] - score(t)) < 1e-6 for k, t, _ in asked]
    assert np.mean(close[:100]) > 0.7 and np.mean(close[100:]) > 0.7  # the rest met a false positive of the filter
    assert np.mean([got[1000 + k] for k in range(100)]) > np.mean([got[2000 + k] for k in range(100)]) + 1
