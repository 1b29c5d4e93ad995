import random

import pytest
from pyspark.sql import functions as F

from burstgraph import PropertyGraph
from burstgraph.operators import components, graph, skew


def test_coarsen(make, rows, joins):
    g = PropertyGraph(
        make.vertices({1: "one", 2: "two", 3: "three"}), make.edges([(1, 2, 1), (2, 3, 0), (3, 1, 0)])
    )
    merged = g.coarsen(F.col("weight") > 0, title=F.array_join(F.sort_array(F.collect_list("title")), ""))
    assert rows(merged.vertices) == [(1, "onetwo"), (3, "three")]
    assert rows(merged.edges) == [(1, 3, 0.0), (3, 1, 0.0)]


def test_coarsen_nothing_is_identity(make, rows):
    g = PropertyGraph(make.vertices({1: "a", 2: "b"}), make.edges([(1, 2, 1), (1, 2, 1), (2, 2, 3)]))
    same = g.coarsen(F.lit(False), title=F.min("title"))
    assert rows(same.vertices) == rows(g.vertices)
    assert rows(same.edges) == rows(g.edges)


def test_prune_singletons_components(make, rows, joins):
    g = PropertyGraph(make.vertices(dict.fromkeys(range(1, 7), "")), make.edges([(1, 2, 2), (2, 3, 1), (4, 5, 1.5)]))
    clean = g.prune(1.0).remove_singletons()
    assert rows(clean.edges, "src", "dst") == [(1, 2), (4, 5)]
    assert rows(clean.vertices, "id") == [(1,), (2,), (4,), (5,)]
    assert rows(clean.connected_components()) == [(1, 1), (2, 1), (4, 4), (5, 4)]
    assert rows(clean.nth_component(0).vertices, "id") == [(1,), (2,)]
    assert rows(clean.nth_component(1).edges, "src", "dst") == [(4, 5)]
    assert rows(clean.nth_component(2).vertices) == []


def test_empty_graph(make, rows):
    empty = PropertyGraph(make.vertices({1: "a"}), make.edges([(1, 2, 0)])).prune(1.0).remove_singletons()
    found = empty.nth_component()
    assert rows(found.vertices) == [] and rows(found.edges) == []


def expected_components(vertices, edges):
    label = {v: v for v in vertices}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("rows_per_task", [10**6, 5])
def test_components_of_random_graphs(make, rows, rows_per_task):
    """Plain and split joins give the same labels; a hub holds a third of the edges."""
    rnd = random.Random(rows_per_task)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    edges += [(500, rnd.randrange(300, 345)) for _ in range(45)]
    edges += [(i, i + 1) for i in range(600, 640)]
    vertices = sorted({v for e in edges for v in e} | {999})
    found = components.connected_components(make.ids(vertices), make.edges(edges), rows_per_task)
    assert rows(found) == sorted(expected_components(vertices, edges).items())


@pytest.mark.parametrize("rows_per_task", [10**6, 1])
def test_hop_distances(make, rows, rows_per_task):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (9, 1)]
    found = components.hop_distances(make.edges(edges), make.ids([1]), rows_per_task)
    assert rows(found) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]


def test_hops_on_a_random_graph(make, rows):
    """More rounds than buckets, sources twice, a hub, a cycle."""
    rnd = random.Random(8)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(0, k) for k in range(20)] + [(k, k + 1) for k in range(100, 112)]
    links += [(5, 100), (112, 5)]
    expected, front = {0: 0, 3: 0}, {0, 3}
    while front:
        step = max(expected.values()) + 1
        front = {b for a, b in links if a in front} - set(expected)
        expected |= dict.fromkeys(front, step)
    found = components.hop_distances(make.edges(links), make.ids([0, 3, 0]), 4)
    assert rows(found) == sorted(expected.items())


def test_hops_never_exchange_what_was_visited(spark, tmp_path):
    name, path = "visited_ids", str(tmp_path / "visited")
    for step in range(3):
        rows = spark.range(10 * step, 10 * step + 10).withColumn("distance", F.lit(step))
        rows.write.partitionBy("distance").bucketBy(4, "id").option("path", path).mode("append").saveAsTable(name)
    try:
        left = components.unvisited(spark.range(5, 40, 5).distinct(), spark.table(name))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1  # the distinct ids of the left side
        assert "Exchange" not in plan[plan.index("Exchange ") + 9 :] and "Bucketed: true" in plan
        assert sorted(r["id"] for r in left.collect()) == [30, 35]
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_component_rounds_leave_no_files(make, rows, monkeypatch, tmp_path):
    from burstgraph import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    found = components.component_labels(make.edges([(k, k + 1) for k in range(50)]))
    assert rows(found) == [(k, 0) for k in range(51)]
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["component-labels"]
    assert rows(components.component_labels(make.edges([]))) == []
    assert len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_join(spark, rows, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "key BIGINT, n BIGINT")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (6, "c")], "key BIGINT, t STRING")
    hot = skew.hot_keys(left, "key", limit=2)
    assert hot.where("key = 1").first()["_splits"] == 100
    plain = left.join(right, "key", how)
    split = skew.join_skewed(left, right, "key", how, hot=hot).select(plain.columns)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_go_by_rows_per_task(spark):
    """A key far below a thousandth of the rows is split when it holds more rows than a task takes."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 15, -1).otherwise(F.col("id")).alias("key"), "id")
    hot = skew.hot_keys(rows, "key", limit=5)
    assert [tuple(r) for r in hot.collect()] == [(-1, 3)]
    salted = skew.salt_rows(rows, "key", hot)
    assert salted.groupBy("key", "_salt").count().agg(F.max("count")).first()[0] <= 10
    assert skew.hot_keys(rows, "key") is None


def test_hot_ends_are_found_in_one_pass(make):
    edges = make.edges([(1, k) for k in range(10)] + [(k, 2) for k in range(20, 25)])
    hot = skew.hot_ends(edges, 4)
    assert [tuple(r) for r in hot["src"].collect()] == [(1, 3)] and [tuple(r) for r in hot["dst"].collect()] == [(2, 2)]
    assert skew.hot_ends(edges, 100) == {"src": None, "dst": None}


def test_symmetrise_and_degrees(make, rows):
    edges = make.edges([(1, 2, 2), (2, 1, 1), (2, 3, 0)])
    assert rows(graph.symmetrise(edges)) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert rows(graph.degrees(edges)) == [(1, 2, 3.0), (2, 3, 3.0), (3, 1, 0.0)]


def test_induced_subgraph_and_labels(make, rows, joins):
    g = PropertyGraph(make.vertices({1: "a", 2: "b", 3: "c"}), make.edges([(1, 2, 1), (2, 3, 1)]))
    part = g.induced_subgraph(make.ids([1, 2]))
    assert rows(part.vertices) == [(1, "a"), (2, "b")] and rows(part.edges) == [(1, 2, 1.0)]
    named = graph.labelled(make.ids([1, 7]), g.vertices)
    assert {tuple(r) for r in named.collect()} == {(1, "a"), (7, None)}
    twice = g.vertices.union(make.vertices({1: "z"}))
    assert sorted(map(tuple, graph.labelled(make.ids([1]), twice).collect())) == [(1, "a")]


def test_stage_counts(make, rows):
    g = PropertyGraph(make.vertices({1: "a", 2: "b"}), make.edges([(1, 2, 1), (2, 1, 0)]))
    assert rows(graph.stage_counts({"all": g, "none": g.prune(5.0)})) == [("all", 2, 2, 1), ("none", 2, 0, 0)]
