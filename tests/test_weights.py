import random

import pyarrow as pa
import pytest

from burstgraph.operators import grid, pairs, weights
from burstgraph.operators.pairs import similar_pairs
from burstgraph.plans import learning

A = {1: 2, 2: 4, 3: 8, 5: 1}
B = {2: 4, 3: 2, 4: 9, 5: 2}


def weight_of(df):
    return df.collect()[0]["weight"]


@pytest.mark.parametrize(
    "start, stop, normalise, expected", [(1, 5, False, 1.0), (1, 5, True, 2 / 3), (0, 6, False, 1.0), (0, 6, True, 1.0)]
)
def test_windowed(make, start, stop, normalise, expected):
    weighed = weights.hebb_weights(make.edges([(1, 2)]), make.signal({1: A, 2: B}), start, stop, normalise=normalise)
    assert weight_of(weighed) == pytest.approx(expected)


@pytest.mark.parametrize("normalise", [False, True])
def test_signed(make, normalise):
    weighed = weights.signed_weights(make.edges([(1, 2)]), make.signal({1: A, 2: B}), normalise)
    assert weight_of(weighed) == pytest.approx(0.25)


def test_floor_and_limit(make):
    weighed = weights.hebb_weights(
        make.edges([(1, 2)]), make.signal({1: A, 2: B}), 0, 6, floor=1.0, normalise=False, lam=0.2
    )
    assert weight_of(weighed) == pytest.approx(1.25)


def test_no_common_hour_and_missing_series(make, rows):
    signal = make.signal({1: {1: 5}, 2: {2: 5}})
    edges = make.edges([(1, 2), (2, 3), (3, 4)])
    assert rows(weights.hebb_weights(edges, signal, 0, 6)) == [(1, 2, 0.0), (2, 3, 0.0), (3, 4, 0.0)]
    assert rows(weights.signed_weights(edges, signal)) == [(1, 2, 0.0), (2, 3, 0.0), (3, 4, 0.0)]
    assert rows(weights.correlation_weights(edges, signal, 0, 6)) == [(1, 2, 0.0), (2, 3, 0.0), (3, 4, 0.0)]
    assert rows(weights.hebb_weights(edges, signal, 0, 6, min_weight=0.0)) == []


def test_parallel_edges_stay_apart(make, rows, joins):
    signal = make.signal({1: A, 2: B})
    edges = make.edges([(1, 2), (1, 2), (2, 1)])
    assert rows(weights.hebb_weights(edges, signal, 0, 6)) == [(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    once = weight_of(weights.correlation_weights(make.edges([(1, 2)]), signal, 0, 6))
    both = weights.correlation_weights(edges, signal, 0, 6).collect()
    assert [r["weight"] for r in both] == pytest.approx([once] * 3)


def test_correlation_golden(make):
    one = {h: h for h in range(1, 6)}
    two = dict(zip(range(1, 6), (500, 600, 700, 800, 9000)))
    found = weights.correlation_weights(make.edges([(1, 2)]), make.signal({1: one, 2: two}), 0, 6)
    assert weight_of(found) == pytest.approx(0.7279514442, abs=1e-9)


def test_correlation_two_chunks(make):
    signal = make.signal({1: {h: h % 7 for h in range(1, 31)}, 2: {h: h % 5 for h in range(1, 31)}})
    found = weights.correlation_weights(make.edges([(1, 2)]), signal, 0, 31)
    assert weight_of(found) == pytest.approx(0.6037481027, abs=1e-9)


def random_series(seed, ids, hours, hot):
    """Random series; every id is active in the hot hours."""
    rnd = random.Random(seed)
    return {
        i: {h: rnd.choice((1, 2, 3, 5, 8, 13)) for h in range(hours) if h in hot or rnd.random() < 0.25}
        for i in range(ids)
    }


def brute(series, a, b, start, stop, normalise, lam):
    inside = [{h: v for h, v in series[i].items() if start < h < stop} for i in (a, b)]
    sizes = [len(s) if normalise else 1 for s in inside]
    total = 0.0
    for h in inside[0].keys() & inside[1].keys():
        x, y = inside[0][h] / sizes[0], inside[1][h] / sizes[1]
        s = min(x, y) / max(x, y)
        total += s if s > lam else 0.0
    return total


def test_weights_against_brute_force(make, joins):
    series = random_series(1, 30, 200, {5, 6})
    edges = [(a, b) for a in range(30) for b in range(30) if (a * 7 + b) % 5 == 0 and a != b]
    found = weights.hebb_weights(make.edges(edges), make.signal(series), 3, 190).collect()
    assert len(found) == len(edges)
    freq = {i: sum(3 < h < 190 for h in s) for i, s in series.items()}
    for r in found:
        assert r["weight"] == pytest.approx(brute(series, r["src"], r["dst"], 3, 190, True, 0.5))
        assert 0 <= r["weight"] <= min(freq[r["src"]], freq[r["dst"]])


@pytest.mark.parametrize("normalise", [False, True])
@pytest.mark.parametrize("min_weight, block_rows", [(0.0, 7), (3.0, 4)])
def test_similar_pairs_against_all_pairs(make, joins, min_weight, block_rows, normalise):
    series = random_series(2, 40, 30, {4, 9})
    signal = make.signal(series)
    found = similar_pairs(signal, 0, 30, min_weight, normalise=normalise, block_rows=block_rows).collect()
    expected = {
        (a, b): w
        for a in range(40)
        for b in range(a + 1, 40)
        if (w := brute(series, a, b, 0, 30, normalise, 0.5)) > min_weight
    }
    assert {(r["src"], r["dst"]) for r in found} == set(expected)
    for r in found:
        assert r["weight"] == pytest.approx(expected[r["src"], r["dst"]])


@pytest.mark.parametrize("matches", [1, 3, 6])
def test_similar_pairs_by_matches_in_the_heads(make, matches):
    """Whatever the heads must share, the pairs are the same; with more matches fewer candidates are looked up."""
    series = random_series(5, 60, 40, {4, 9})
    for k in range(60):  # a busy hour in all series, a quiet one in few
        series[k][39] = 1.0
    signal, counts, fewer = make.signal(series), {}, {}
    found = similar_pairs(signal, -1, 40, 5.5, matches=matches, counts=counts).collect()
    expected = {(a, b): w for a in range(60) for b in range(a + 1, 60) if (w := brute(series, a, b, -1, 40, False, 0.5)) > 5.5}
    assert {(r["src"], r["dst"]) for r in found} == set(expected) and expected
    for r in found:
        assert r["weight"] == pytest.approx(expected[r["src"], r["dst"]])
    if matches < 6:
        similar_pairs(signal, -1, 40, 5.5, matches=matches + 1 + matches // 3, counts=fewer).collect()
        assert len(expected) <= fewer.get("candidates", len(expected)) <= counts["candidates"]


def test_matches_out_of_range(make):
    for matches in (0, 5):
        with pytest.raises(ValueError):
            similar_pairs(make.signal({1: A}), 0, 6, 3.0, matches=matches)


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_no_pair_is_shuffled(make):
    """Equal series all pair up: the series are dealt to cells, the pairs stay where they are made."""
    signal = make.signal({i: {h: 2.0 for h in range(6)} for i in range(50)} | {90: {h: -1.0 for h in range(6)}})
    found = similar_pairs(signal, -1, 6, 3.0, block_rows=8)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in found.collect()) == [(a, b, 6.0) for a in range(50) for b in range(a + 1, 50)]
    assert exchanges(found) and all("cell" in x for x in exchanges(found))


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_series_is_shuffled_once(make):
    """However many cells there are, no series is copied for them, and both sides of the product read one exchange."""
    signal = make.signal({i: {h: 2.0 for h in range(6)} for i in range(30)})
    found = similar_pairs(signal, -1, 6, 3.0, block_rows=2)
    assert len(found.collect()) == 30 * 29 // 2
    plan = final_plan(found)
    assert "Generate" not in plan and "CartesianProduct" in plan
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange shufflepartitionidpassthrough") == 2  # the reused one names it again


@pytest.mark.parametrize("floor, lam, min_weight", [(0.0, 0.5, 3.0), (0.0, 0.0, 5.0), (-5.0, 0.5, 0.0), (0.0, 1.0, 0.0)])
def test_similar_pairs_of_blocks_that_share_a_cell(make, monkeypatch, floor, lam, min_weight):
    """Several blocks in a cell, strips of few series, and values that are negative or far apart."""
    for name, value in (("_TASKS_PER_CORE", 0), ("_BLOCKS_PER_CELL", 3), ("_STRIP", 40)):
        monkeypatch.setattr(pairs, name, value)
    rnd = random.Random(8)
    values = (0.3, 1.0, 1.9, 2.0, 700.0) + ((-1.0, -3.0, -9.0) if floor < 0 else ())
    series = {i: {h: rnd.choice(values) for h in range(20) if rnd.random() < 0.5} for i in range(40)}
    found = similar_pairs(make.signal(series), -1, 20, min_weight, floor=floor, lam=lam, block_rows=4).collect()
    expected = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = [(series[a][h], series[b][h]) for h in series[a].keys() & series[b].keys()]
            terms = [min(x, y) / max(x, y) for x, y in both if x > floor and y > floor]
            if (w := sum(t for t in terms if t > lam)) > min_weight + 1e-9:
                expected[a, b] = w
    got = {(r["src"], r["dst"]): r["weight"] for r in found}
    assert len(got) == len(found) and set(got) >= set(expected) and (expected or lam == 1.0)
    assert all(got[k] == pytest.approx(expected.get(k, min_weight)) for k in got)


def test_all_pairs_job_shuffles_a_series_once(make):
    signal = make.signal({i: {h: 9.0 for h in range(6)} for i in range(30)})
    found = learning.learn_all_pairs(signal, make.vertices({0: "zero"}), -1, 6, level=5.0, min_weight=3.0)
    assert found.vertices.count() == 30 and len(found.edges.collect()) == 30 * 29 // 2
    assert "Generate" not in final_plan(found.edges) and final_plan(found.edges).count("ReusedExchange") == 1


def test_all_pairs_job_stores_no_pair(make, rows):
    signal = make.signal({i: {h: 2.0 + 8.0 * (i < 40) for h in range(6)} for i in range(50)} | {60: {1: 10.0}})
    found = learning.learn_all_pairs(signal, make.vertices({0: "zero"}), -1, 6, level=5.0, min_weight=3.0)
    assert found.edges.count() == 40 * 39 // 2 and rows(found.vertices.select("id")) == [(i,) for i in range(40)]
    assert "FlatMapGroupsInArrow" in found.edges._jdf.queryExecution().executedPlan().toString()


def test_pairs_need_a_minimum(make):
    with pytest.raises(ValueError):
        similar_pairs(make.signal({1: A}), 0, 6, -1.0)


@pytest.mark.parametrize("samples", [60, 400, 4_000_000])
def test_grid_with_a_hot_vertex_and_parallel_links(make, samples):
    """Vertex 0 has a third of all links; every seventh link stands three times."""
    series = random_series(3, 80, 60, {7})
    series[5] = {}
    links = [(0, b) for b in range(1, 80)] + [(a, (a * 7 + k) % 80) for a in range(80) for k in (1, 3)] + [(200, 1)]
    edges = [e for k, e in enumerate(links) for _ in range(3 if k % 7 == 0 else 1)]
    packed = grid.pack_series(make.signal(series))
    found = grid.grid_weights(make.edges(edges), packed, grid.ratio_sum(0.5), False, True, samples).collect()
    assert {(r["src"], r["dst"]): r["copies"] for r in found} == {e: edges.count(e) for e in set(edges)}
    for r in found:
        known = r["src"] in series and r["dst"] in series
        assert r["weight"] == pytest.approx(brute(series, r["src"], r["dst"], -1, 60, False, 0.5) if known else 0.0)


def test_no_series_is_shuffled_per_link(make):
    """The plan has no exchange by one end that carries a series, and parallel links meet before any series."""
    weighed = weights.hebb_weights(make.edges([(1, 2), (1, 2), (2, 3)]), make.signal({1: A, 2: B}), 0, 6)
    assert sorted(r["weight"] for r in weighed.collect()) == [0.0, 1.0, 1.0]
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("hashpartitioning(src" in x or "hashpartitioning(dst" in x for x in exchanges)
    assert "map<" not in weighed._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("flush", [1, 50, 4_000_000])
def test_series_go_to_cells_as_blobs(monkeypatch, flush):
    """What a task sends to a cell is one row however many series it has for it, and comes back as it was."""
    monkeypatch.setattr(grid, "_FLUSH", flush)
    rnd = random.Random(4)
    series = {i: [(h, rnd.choice((0.1, -2.0, 1e300, 37.0))) for h in sorted(rnd.sample(range(-99, 99), rnd.randrange(6)))] for i in range(-9, 20)}
    cells = {i: [{"cell": c, "part": c % 2} for c in range(3) if (i + c) % 4] for i in series}
    rows = [{"id": i, "hours": [h for h, _ in s], "values": [v for _, v in s], "cells": cells[i]} for i, s in series.items()]
    pairs = pa.struct([("cell", pa.int64()), ("part", pa.int64())])
    kinds = pa.schema([("id", pa.int64()), ("hours", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("cells", pa.list_(pairs))])
    blobs = pa.Table.from_batches(grid.to_blobs(pa.Table.from_pylist(rows[::-1], kinds).to_batches(max_chunksize=7)))
    if flush > 50:
        assert blobs.num_rows == 3
    for cell in range(3):
        mine = blobs.filter(pa.compute.equal(blobs.column("_cell"), cell))
        ids, starts, hours, values = grid._read_blobs(mine)
        assert set(mine.column("_part").to_pylist()) == {cell % 2}
        assert ids.tolist() == [i for i in series if (i + cell) % 4]
        for i, a, b in zip(ids.tolist(), starts[:-1], starts[1:], strict=True):
            assert list(zip(hours[a:b].tolist(), values[a:b].tolist(), strict=True)) == series[i]


def test_learned_weights_are_stored(make):
    """The cells are worked out once and read from column files, which a checkpoint would not do."""
    signal = make.signal({1: A, 2: B, 3: A})
    found = learning.learn_static(make.vertices({1: "a", 2: "b", 3: "c"}), make.edges([(1, 2), (1, 3)]), signal, 0, 6, min_weight=0.0)
    plan = found.stages["pruned"].edges._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ExistingRDD" not in plan and found.graph.edges.count() == 2


def test_parallel_links_are_counted_out(spark):
    weighed = spark.createDataFrame([(1, 2, 250_001, 0.5), (3, 4, 1, 0.25)], "src BIGINT, dst BIGINT, copies BIGINT, weight DOUBLE")
    counts = {r["src"]: r["count"] for r in weights._one_row_per_copy(weighed).groupBy("src").count().collect()}
    assert counts == {1: 250_001, 3: 1}
