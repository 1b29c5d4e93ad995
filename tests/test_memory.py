import random

import numpy as np
import pytest

from burstgraph.operators import memory
from burstgraph.operators.graph import symmetrise

EDGES = [(1, 2, 2.0), (2, 3, 1.0)]
CELLS = [(1, 0), (3, 0), (3, 1)]


def test_recall_fixture(make, rows, joins):
    matrix = symmetrise(make.edges(EDGES))
    scores = rows(memory.recall_scores(matrix, make.cells(CELLS)))
    assert scores == [(2, 0, 3.0), (2, 1, -1.0)]
    assert rows(memory.recall(matrix, make.cells(CELLS))) == [(2, 0)]


@pytest.mark.parametrize("tie, expected", [(1, [(2, 0), (2, 1)]), (-1, [(2, 0)])])
def test_tie(make, rows, tie, expected):
    matrix = symmetrise(make.edges([(1, 2, 1.0), (2, 3, 1.0)]))
    assert rows(memory.recall(matrix, make.cells(CELLS), tie=tie)) == expected


def test_error_rates_fixture(make):
    matrix = symmetrise(make.edges(EDGES))
    cells = make.cells(CELLS)
    rate = memory.error_rates(cells, memory.recall(matrix, cells), make.ids([1, 2, 3, 4]), matrix, 3).collect()[0]
    assert rate["miss_rate"] == pytest.approx(1.0)
    assert rate["mismatch_rate"] == pytest.approx(7 / 12)


def test_error_metric_fixture(make):
    original = make.cells([(0, 0), (2, 1), (3, 0)])
    recalled = make.cells([(0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1)])
    linked = symmetrise(make.edges([(0, 1, 1), (2, 3, 1)]))  # no row without neighbours
    rate = memory.error_rates(original, recalled, make.ids([0, 1, 2, 3]), linked, 2).collect()[0]
    assert rate["mismatch_rate"] == pytest.approx(0.625)
    assert rate["miss_rate"] == pytest.approx(1 / 3)


def test_row_hit_expansion(make, rows):
    cells = make.cells([(1, 0), (2, 5), (3, 1)])
    assert rows(memory.expand_hits(cells, 0, 3)) == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1), (3, 2)]


@pytest.mark.parametrize("steps, tie", [(1, 1), (1, -1), (4, 1)])
def test_sparse_recall_is_dense_recall(make, rows, steps, tie):
    rnd = random.Random(steps)
    n, hours = 12, 9
    weights = {(a, b): rnd.choice((0.5, 1.0, 1.5)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.3}
    cells = {(i, h) for i in range(n) for h in range(hours) if rnd.random() < 0.4}
    dense = np.zeros((n, n))
    for (a, b), w in weights.items():
        dense[a, b] = dense[b, a] = w
    pattern = -np.ones((n, hours))
    for i, h in cells:
        pattern[i, h] = 1
    linked = dense.sum(axis=1) > 0
    for _ in range(steps):
        score = dense @ pattern
        up = score >= 0 if tie > 0 else score > 0
        pattern = np.where(up, 1.0, -1.0) * linked[:, None]
    expected = sorted((int(i), int(h)) for i, h in zip(*np.where(pattern == 1)))
    matrix = symmetrise(make.edges([(a, b, w) for (a, b), w in weights.items()]))
    assert rows(memory.recall(matrix, make.cells(cells), steps, tie)) == expected


def test_mute_and_sweep(make, rows):
    cells = make.cells([(i, 0) for i in range(1, 6)])
    cluster = make.ids([1, 2, 3, 4])
    assert rows(memory.mute(cells, cluster, 2.0), "id") == [(3,), (4,), (5,)]
    assert rows(memory.mute(cells, cluster, 1.0), "id") == [(5,)]
    assert rows(memory.mute(cells, make.ids([1, 2, 2, 3, 4, 1]), 2.0), "id") == [(3,), (4,), (5,)]
    matrix = symmetrise(make.edges([(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1)]))
    sweep = memory.mute_sweep(matrix, cells, cluster, 1).orderBy("percent").collect()
    assert [r["percent"] for r in sweep] == [10, 20, 25, 33, 50, 66, 83, 100]
    for r in sweep:
        alone = memory.recall(matrix, memory.mute(cells, cluster, r["divisor"]), tie=-1)
        rate = memory.error_rates(cells, alone, cluster, matrix, 1).collect()[0]
        assert (r["miss_rate"], r["mismatch_rate"]) == (rate["miss_rate"], rate["mismatch_rate"])


def test_noise(make):
    ids = make.ids(range(60))
    cells = memory.random_cells(ids, 50, 0.5, seed=1)
    assert 0.45 < cells.count() / 3000 < 0.55
    flipped = memory.degrade(cells, ids, 50, 0.2, seed=2)
    again = memory.degrade(cells.repartition(7), ids, 50, 0.2, seed=2)
    assert flipped.subtract(again).isEmpty() and again.subtract(flipped).isEmpty()
    changed = flipped.subtract(cells).count() + cells.subtract(flipped).count()
    assert 0.16 < changed / 3000 < 0.24
    assert memory.degrade(cells, ids, 50, 0.0, seed=2).subtract(cells).isEmpty()


def test_matrix_options(make, rows):
    edges = make.edges([(1, 2, 0.5), (2, 3, 2.0), (3, 4, 3.0)])
    assert rows(memory.memory_matrix(edges, 1.0)) == [(2, 3, 2.0), (3, 2, 2.0), (3, 4, 3.0), (4, 3, 3.0)]
    inside = memory.memory_matrix(edges, 0.0, cluster=make.ids([1, 2, 3]), binary=True)
    assert rows(inside) == [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)]


def test_binarise(make, rows):
    signal = make.signal({1: {0: 1, 1: 9, 2: 1}})
    assert rows(memory.binarise(signal, 1.0)) == [(1, 1)]
    with pytest.raises(ValueError):
        memory.binarise(signal, -1.0)
    assert rows(memory.binarise_sigma(signal, 10, 2.0)) == [(1, 1)]


def test_sweep_is_muting_one_by_one(make):
    """Random matrix and pattern: every part of the sweep is its own mute, recall and error, with and without an event."""
    rnd = random.Random(8)
    links = [(a, b, rnd.choice((0.25, 0.5, 1.0))) for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.35]
    matrix = symmetrise(make.edges(links))
    cells = make.cells([(i, h) for i in range(16) for h in range(8) if rnd.random() < 0.5])
    cluster, steps = make.ids(range(2, 13)), (4.0, 1.0, 1.5, 10.0)
    for options in ({}, {"event": (2, 6)}, {"event": (2, 6), "row_hits": True}):
        for tie in (1, -1):
            sweep = {r["divisor"]: r for r in memory.mute_sweep(matrix, cells, cluster, 8, steps, tie, **options).collect()}
            assert set(sweep) == set(steps)
            for divisor in steps:
                found, original, hours = memory.recall(matrix, memory.mute(cells, cluster, divisor), tie=tie), cells, 8
                if options:
                    original, hours = memory.in_event(cells, 2, 6), 4
                    found = memory.expand_hits(found, 2, 6) if "row_hits" in options else memory.in_event(found, 2, 6)
                alone = memory.error_rates(original, found, cluster, matrix, hours).collect()[0]
                assert (sweep[divisor]["miss_rate"], sweep[divisor]["mismatch_rate"]) == (alone["miss_rate"], alone["mismatch_rate"])


def test_sweep_sends_each_cell_once(make):
    """Only the packed cells and the rates of the result are generated, nothing per divisor below the sums."""
    matrix, cells = make.edges([(1, 2, 1), (2, 1, 1)]), make.cells(CELLS)
    plan = memory.mute_sweep(matrix, cells, make.ids([1, 2]), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2


def test_flips_alone_are_shuffled(make, rows):
    cells = make.cells([(1, 0), (1, 7), (9, 0), (2, 50)])  # 9 is no row, 50 no hour
    ids = make.ids([1, 2])
    assert rows(memory.degrade(cells, ids, 10, 0.0, seed=1)) == [(1, 0), (1, 7)]
    everything = {(i, h) for i in (1, 2) for h in range(10)}
    assert set(rows(memory.degrade(cells, ids, 10, 1.1, seed=1))) == everything - {(1, 0), (1, 7)}


def test_rates_of_nothing_are_null(make):
    rate = memory.error_rates(make.cells([(5, 0)]).where("id < 0"), make.cells(CELLS), make.ids([1, 2]), symmetrise(make.edges(EDGES)), 3).collect()[0]
    assert rate["miss_rate"] is None and rate["mismatch_rate"] == pytest.approx(1 / 6)
