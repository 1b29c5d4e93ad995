import numpy as np
import pytest

import burstgraph.llm.embedding_dedup as E


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, node STRING, times INT").repartition(3)


def brute(rows):
    ok = [r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if k else None for r, k in zip(rows, ok, strict=True)]
    n, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= E.COSINE:
                n[a], n[b] = n[a] + 1, n[b] + 1
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return {r[0]: (c, least[g], r[0] == least[g]) for r, c, g in zip(rows, n, group, strict=True) if r[0] is not None}


@pytest.mark.parametrize("block", [1000, 7])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(20):
        centre = rng.normal(size=16)
        for _ in range(8):
            v = centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
            rows.append((len(rows) * 3, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2)), "n", 1))
    rows += [(9000 + k, rows[0][1], rows[0][2], "n", 1) for k in range(15)]  # a group of equal vectors
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(9100 + k, v, 0, "n", 1) for k, v in enumerate(bad)] + [(9200, rows[0][1], None, "n", 1), (None, rows[0][1], 0, "n", 1)]
    found = {r.vec_id: tuple(r)[1:] for r in E.embedding_dedup(table(spark, rows)).collect() if r.vec_id is not None}
    want = brute(rows)
    assert found.keys() == want.keys()
    links, true = sum(v[0] for v in found.values()), sum(v[0] for v in want.values())
    assert all(found[k][0] <= want[k][0] for k in want) and links >= 0.9 * true
    assert sum(found[k] == want[k] for k in want) >= 0.95 * len(want)


def test_empty(spark):
    assert E.embedding_dedup(table(spark, [])).collect() == []


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label, "", 0) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = E.embedding_dedup(table(spark, rows)).collect()
    assert sum(r.n_links for r in found) >= 0.9 * sum(v[0] for v in brute(rows).values())


@pytest.mark.parametrize("size", [16, 64])
def test_recall_in_a_cluster_of_a_third_of_the_vectors(spark, size):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    cluster = np.sqrt(0.985) * unit(rng.normal(size=size)) + np.sqrt(0.015 / size) * rng.normal(size=(500, size))
    vectors = np.concatenate([cluster, unit(rng.normal(size=(1000, size)))]).astype(np.float32)
    rows = [(k, v.tolist(), 1, "n", 1) for k, v in enumerate(vectors)]
    found = {r.vec_id: r for r in E.embedding_dedup(table(spark, rows)).collect()}
    exact = unit(vectors.astype(float))
    links = (exact @ exact.T >= E.COSINE).sum(axis=1) - 1
    assert links.sum() > 100_000 and all(found[k].n_links <= links[k] for k in found)
    assert sum(r.n_links for r in found.values()) >= 0.99 * links.sum()
    assert sum(found[k].component_id == 0 for k in range(500)) >= 495
