"""The pipeline's near-duplicate stage drops near copies from a similarity of 0.8 on."""

import corpus_pipeline
from helixframe.llm import near_dedup


def test_near_copies_between_the_bars_go(spark, tmp_path):
    rows, want = [], set()
    for g, (n, changed) in enumerate([(100, 2), (100, 3), (150, 3), (60, 1), (60, 2), (80, 3)]):
        w = [f"w{g}x{k}" for k in range(n)]
        v = list(w)
        for k in range(changed):
            v[10 + 12 * k] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        common, size = n - 4 - 5 * changed, n - 4
        if 10 * common >= 8 * (2 * size - common):
            want.add(2 * g + 1)
    between = near_dedup.brute_force(rows, 80, 100)
    assert {int(x) for x in between.doc_id[~between.kept]} == want
    old = near_dedup.brute_force(rows)
    assert {int(x) for x in old.doc_id[~old.kept]} < want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert left == {r[0] for r in rows} - want
