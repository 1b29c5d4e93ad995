import numpy as np

import burstgraph.llm.quality_classifier as Q


def test_features():
    f = Q.features([b"", b"AB cd!", b"x x x y", b"12 34", " \n".encode()])
    at = {n: k for k, n in enumerate(Q.FEATURES)}
    assert f[0].tolist() == [1] + [0] * 8 or f[0][1:].max() == 0
    assert f[1][at["upper"]] == 2 / 6 and f[1][at["symbols"]] == 1 / 6
    assert f[2][at["stutter"]] == 2 / 4 and f[2][at["repetition"]] == 2 / 4
    assert f[3][at["digits"]] == 4 / 5


def test_shrinkage(spark):
    even = spark.createDataFrame([(100, 50.0), (100, 51.0), (100, 49.0)], "n BIGINT, good DOUBLE")
    apart = spark.createDataFrame([(100, 5.0), (100, 95.0), (100, 50.0)], "n BIGINT, good DOUBLE")
    assert Q.strength(even, 0.5) > 50 * Q.strength(apart, 0.5)


def test_site_evidence_moves_scores(spark):
    rows = [(k, "plain words here number %d" % k, "good" if k % 2 else "bad", "p") for k in range(400)]
    rows += [(1000, "plain words here number 1000", "good", "p"), (1001, "plain words here number 1001", "bad", "p"), (1002, "plain words here number 7", "new", None), (1003, None, None, None), (None, "plain words", "good", "p")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id BIGINT, text STRING, source STRING, lang STRING, p DOUBLE, good STRING")
    labels = spark.createDataFrame([(k, int(k % 2 == 1)) for k in range(400)] + [(1, None), (None, 0), (0, 0)], "doc_id BIGINT, quality INT")
    found = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(found) == len(rows)
    assert found[1000].site_score > 0.9 and found[1001].site_score < 0.1
    assert abs(found[1002].site_score - 0.5) < 0.1  # a new site stays at the global share
    assert found[1000].keep and not found[1001].keep


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in found]) > 0.93
    good = [r.keep for r in found if r.quality == 1]
    assert np.mean(good) > 0.97


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s", "l")], "doc_id BIGINT, text STRING, source STRING, lang STRING")
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert [r.keep for r in Q.quality_scores(docs, none).collect()] == [True]
    assert Q.quality_scores(docs.limit(0), none).collect() == []
