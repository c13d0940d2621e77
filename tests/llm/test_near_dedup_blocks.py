"""Clusters of more classes than a task takes are cut into blocks; what the blocks leave unlinked meets every block."""

import random

import numpy as np

from helixframe.llm import near_dedup

#: Most classes of a task: one cluster of 60, one of 40 and one of 12 classes are cut into 8, 5 and 2 blocks.
BLOCKS = dict(cluster_docs=8)


def texts():
    """Near copies of three texts, on both sides of the bar and each other's links; pairs apart from the rest of their cluster."""
    rng = random.Random(11)
    rows = []
    for g, (n, words) in enumerate([(60, 150), (40, 120), (12, 80)]):
        base = [f"w{g}x{k}" for k in range(words)]
        for i in range(n):
            w = list(base)
            if i % 4 == 3 and rows:  # a near copy of an earlier copy: links that don't go through the pivots
                w = rng.choice(rows[-3:])[1].split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"new{g}x{i}x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows + [(500, "alone by itself in this small table"), (501, None), (502, "")]


def test_blocks_link_as_whole_clusters(spark):
    rows = texts()
    want = near_dedup.brute_force(rows)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), **BLOCKS)
    got = got.toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got.values == want.values).all()


def test_blocks_drop_the_copies(spark):
    rows = texts()
    want = near_dedup.brute_force(rows, 80, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in near_dedup.deduplicated(spark, docs, 80, 100, **BLOCKS).collect()}
    assert left == {int(x) for x in want.doc_id[want.kept]} and len(left) < len(rows)


def test_rare_tokens_miss_no_link():
    rng = np.random.default_rng(5)
    for num in (50, 80, 85, 100):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [np.zeros(0, np.uint64)]
        for _ in range(30):
            b = base.copy()
            k = rng.integers(0, 14)
            b[rng.integers(0, 40, k)] = rng.integers(0, 60, k)
            sets.append(np.unique(b[: rng.integers(20, 41)]))
        want = np.arange(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                k = len(np.intersect1d(a, sets[j]))
                if k and 100 * k >= num * (len(a) + len(sets[j]) - k):
                    want[want == want[i]] = want[j]
        got = near_dedup._exact_links(sets, num, 100)
        assert ((got[:, None] == got) == (want[:, None] == want)).all()
