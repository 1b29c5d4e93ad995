import math
import statistics
import xml.etree.ElementTree as ET

import pytest

from burstgraph.plans import jobs
from burstgraph.sources import readers


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Six pages: 1, 2, 3 burst together, 4 and 5 burst together, 6 is flat."""
    base = tmp_path_factory.mktemp("jobs")
    bursts = {1: (10, 20, 30, 40), 2: (10, 20, 30, 40), 3: (10, 20, 30, 40), 4: (15, 25, 35, 45), 5: (15, 25, 35, 45), 6: ()}
    lines = ["_c0,page,visits,hour"]
    for page, hours in bursts.items():
        for hour in range(60):
            lines.append(f"{len(lines)},{page},{900.0 if hour in hours else 1.0},{hour}")
    (base / "signal.csv").write_text("\n".join(lines) + "\n")
    (base / "vertices.csv").write_text("".join(f"{i},page & {i}\n" for i in range(1, 8)) + "x,bad\n")
    (base / "edges.csv").write_text("1 2\n2 3\n3 4\n4 5\n5 6\n6 7\n")
    return base


@pytest.fixture(scope="module")
def store(spark, files):
    path = str(files / "store")
    jobs.ingest(spark, *[str(files / f"{n}.csv") for n in ("vertices", "edges", "signal")], path)
    return path


def test_ingest(spark, store, rows):
    assert rows(readers.load_table(spark, f"{store}/vertices"), "id") == [(i,) for i in range(1, 7)]
    assert rows(readers.load_table(spark, f"{store}/edges"), "src", "dst") == [(i, i + 1) for i in range(1, 6)]
    assert readers.load_table(spark, f"{store}/signal").count() == 360


def test_peaks(spark, files, store, rows, joins):
    out = files / f"peaks-{joins}"
    found = jobs.peaks(spark, store, str(out), window=(0, 60), length=60, rate=2.0)
    assert rows(found.vertices, "id") == [(1,), (2,), (3,)]
    assert rows(found.edges) == [(1, 2, 4.0), (2, 3, 4.0)]
    text = "".join(p.read_text() for p in sorted((out / "graph.gexf").glob("part-*")))
    assert len(list(ET.fromstring(text.encode()).iter("{http://www.gexf.net/1.2draft}node"))) == 3
    assert readers.read_signal_text(spark, str(out / "signal.txt")).count() == 180


def test_static_and_order(spark, files, store, rows):
    found = jobs.static(spark, store, str(files / "static"), window=(0, 60), length=60, min_weight=57.0)
    assert rows(found.edges) == [(1, 2, 59.0), (2, 3, 59.0)]
    second = jobs.static(spark, store, str(files / "static2"), window=(0, 60), length=60, min_weight=57.0, order=1)
    assert rows(second.edges) == [(4, 5, 59.0)]


def test_all_pairs(spark, files, store, rows):
    titles = str(files / "vertices.csv")
    found = jobs.all_pairs(
        spark, f"{store}/signal", titles, str(files / "pairs"), window=(0, 60), level=500.0, min_weight=57.0
    )
    assert rows(found.edges, "src", "dst") == [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert rows(found.vertices)[0] == (1, "page   1")


def test_null_model(spark, files, store):
    found = jobs.null_model(spark, store, str(files / "null"), window=(0, 60), seed=4)
    assert found.edges.where("weight <= 0").count() == 0


def test_cluster_signals(spark, files, store, rows):
    (files / "cluster.csv").write_text("5,five\n6,six\n9,none\n")
    out = str(files / "cluster-out")
    jobs.cluster_signals(spark, f"{store}/signal", str(files / "cluster.csv"), out, 60)
    assert rows(readers.read_signal_text(spark, out).select("id").distinct()) == [(5,), (6,)]


def test_activity_against_a_reference(spark, files, store, rows):
    (files / "one.csv").write_text("1,one\n")
    (files / "trend.csv").write_text("date,value\n2014-09-23,50\n2014-09-24,100\n2014-09-25,30\n2014-12-01,1\n")
    out = str(files / "activity")
    jobs.activity(spark, f"{store}/signal", str(files / "one.csv"), str(files / "trend.csv"), out, "2014-09-23")
    hours = [900.0 if h in (10, 20, 30, 40) else 1.0 for h in range(60)]
    days = [sum(hours[k : k + 24]) for k in (0, 24, 48)]
    assert rows(readers.load_table(spark, f"{out}/compared")) == [(d, pytest.approx(v * 100 / max(days)), r) for d, (v, r) in enumerate(zip(days, (50.0, 100.0, 30.0)))]
    (row,) = readers.load_table(spark, f"{out}/correlation").collect()
    assert row["days"] == 3 and row["correlation"] == pytest.approx(statistics.correlation(days, [50, 100, 30]))


def test_degree_distribution(spark, files, rows):
    (files / "star.csv").write_text("".join(f"0,{k},1.0\n" for k in range(1, 30)) + "1,2,2.0\n")
    out = str(files / "degrees")
    jobs.degree_distribution(spark, str(files / "star.csv"), out, bins=9)
    assert readers.load_table(spark, f"{out}/degrees").count() == 30
    found = {r["bin"]: r["count"] for r in readers.load_table(spark, f"{out}/histogram").collect()}
    # edges 3 ** k: degrees 1 and 2 in bin 0, 29 in bin 3
    assert found == {k: pytest.approx({0: 1.0, 3: 1 / 29}.get(k, 0.0)) for k in range(10)}
    (row,) = readers.load_table(spark, f"{out}/exponent").collect()
    assert row["slope"] == pytest.approx(-math.log(29) / math.log(27))
    logs = [math.log(29)] + [math.log(2)] * 2
    assert row["alpha"] == pytest.approx(1 + 30 / sum(logs))


def test_recall_and_mute(spark, files, store, rows):
    links = [(a, b, 1.0 + (a * b) % 3) for a in range(1, 6) for b in range(a + 1, 6)]
    weights = files / "weights.csv"
    weights.write_text("".join(f"{a},{b},{w}\n" for a, b, w in links))
    jobs.recall(spark, str(weights), f"{store}/signal", str(files / "recall"), 60, window=5, sigmas=1.0)
    assert spark.read.parquet(str(files / "recall/curves")).count() == 60
    assert spark.read.parquet(str(files / "recall/errors")).count() == 1
    (files / "ids.csv").write_text("1,a\n2,b\n3,c\n")
    jobs.mute(spark, str(weights), f"{store}/signal", str(files / "ids.csv"), str(files / "mute"), 60, sigmas=1.0, event=(10, 40), row_hits=True)
    assert rows(spark.read.parquet(str(files / "mute/errors")), "percent") == [(p,) for p in (10, 20, 25, 33, 50, 66, 83, 100)]
