import gzip
import os
import xml.etree.ElementTree as ET

import pytest

from burstgraph import PropertyGraph, session
from burstgraph.session import cut_lineage, scratch_path, shared_folder
from burstgraph.sources import readers, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_long_signal(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", "_c0,page,visits,hour\n0,7,5.0,2\n1,7,6.0,2\n2,7,0.0,3\n3,8,1.5,9\n")
    assert rows(readers.read_signal_long(spark, path)) == [(7, 2, 6.0), (8, 9, 1.5)]


def test_wide_signal(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", "id,0,1,2,3\n7,0,5,0,2\n")
    assert rows(readers.read_signal_wide(spark, path)) == [(7, 2, 5.0), (7, 4, 2.0)]
    assert rows(readers.read_signal_wide(spark, path, hour_base=0)) == [(7, 1, 5.0), (7, 3, 2.0)]


def test_wide_signal_of_full_width(spark, tmp_path, rows):
    """As many hours as the surveyed files have; lines that are no series and fields that are no numbers go."""
    hours = 5279
    lines = ["id," + ",".join(map(str, range(hours)))]
    lines += [f"{k}," + ",".join("7.5" if h % 1000 == k else "0.0" for h in range(hours)) for k in range(40)]
    lines += ["x,1,2", "", "41,,nan_,3"]
    path = put(tmp_path, "wide.csv", "\n".join(lines) + "\n")
    found = readers.read_signal_wide(spark, path)
    expected = sorted([(k, h + 1, 7.5) for k in range(40) for h in range(k, hours, 1000)] + [(41, 3, 3.0)])
    assert rows(found) == expected
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "double"]
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 2000


def test_reference_series(spark, tmp_path, rows):
    path = put(tmp_path, "r.csv", "date,value\n2014-09-23,5\n2014-09-25,7.5\nnever,1\n2014-09-26,\n")
    assert rows(readers.read_reference(spark, path, "2014-09-23")) == [(0, 5.0), (2, 7.5)]


def test_scratch_is_deleted_by_its_owner(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    with session.Scratch(spark, "work") as scratch:
        first, n = scratch.keep(spark.range(7))
        second, none = scratch.keep(spark.range(0))
        assert (n, none, first.count(), second.count()) == (7, 0, 7, 0)
        scratch.forget(first)
        scratch.forget(spark.range(3))
        assert second.count() == 0
    assert list(tmp_path.iterdir()) == []


def test_ingest(spark, make, tmp_path, rows):
    vertices = readers.read_vertices(spark, put(tmp_path, "v.csv", "1,AT&T\n2,b\nx3,c\n4,\n5,no_series\n"))
    edges = readers.read_edges(spark, put(tmp_path, "e.csv", "1 2\n2 4\n2 5\n2 1\n"))
    kept, links = readers.ingest(vertices, edges, make.signal({1: {1: 1}, 2: {1: 1}, 4: {1: 1}}))
    assert rows(kept) == [(1, "ATT"), (2, "b")]
    assert rows(links) == [(1, 2, 0.0), (2, 1, 0.0)]


def test_labels_with_and_without_label(spark, tmp_path):
    table = readers.read_labels(spark, put(tmp_path, "l.csv", "1,Gisele_Bündchen\n2,b\n"))
    assert {tuple(r) for r in table.collect()} == {(1, "Gisele_Bündchen"), (2, "b")}
    table = readers.read_labels(spark, put(tmp_path, "ids.csv", "5\n6\n"))
    assert {tuple(r) for r in table.collect()} == {(5, None), (6, None)}


def test_pagecounts(spark, tmp_path, rows):
    path = tmp_path / "pagecounts.gz"
    with gzip.open(path, "wt") as out:
        out.write('en Main 200 5\nen "Quoted 150 6\nen Rare 100 7\nde Haupt 900 8\n')
    assert rows(readers.read_pagecounts(spark, str(path))) == [("en", '"Quoted', 150, 6), ("en", "Main", 200, 5)]


EXPECTED = [(1, 1, 2.0), (1, 2, 3.5), (2, 0, 1.0)]


@pytest.mark.parametrize(
    "layout, text",
    [
        ("concatenated", "(1,[0.0,2.0,3.5])(2,[1.0,0.0,0.0])"),
        ("lines", "(1,[0.0,2.0,3.5])\n(2,[1.0,0.0,0.0])\n"),
    ],
)
def test_signal_text(spark, make, tmp_path, rows, layout, text):
    assert rows(readers.read_signal_text(spark, put(tmp_path, "s.txt", text), layout)) == EXPECTED
    signal = make.signal({1: {1: 2, 2: 3.5}, 2: {0: 1}})
    out = str(tmp_path / "dump")
    sinks.write_signal_text(signal.repartition(1).sortWithinPartitions("id"), out, 3, layout)
    assert rows(readers.read_signal_text(spark, out, layout)) == EXPECTED


def test_signal_text_keeps_decimals_and_exponents(spark, make, tmp_path, rows):
    signal = make.signal({1: {0: 1.05, 1: 1.0e-7, 2: 3.0e10}})
    out = str(tmp_path / "dump")
    sinks.write_signal_text(signal, out, 3)
    assert rows(readers.read_signal_text(spark, out)) == rows(signal)


def test_table_and_csv_roundtrips(spark, make, tmp_path, rows):
    signal = make.signal({1: {1: 2, 2: 3.5}, 2: {0: 1}})
    for _ in range(2):  # the second write replaces the first
        sinks.save_table(signal, str(tmp_path / "t"), sort_by="hour")
    assert rows(readers.load_table(spark, str(tmp_path / "t"))) == EXPECTED
    edges = make.edges([(1, 2, 0.1), (2, 3, 0.0)])
    sinks.write_edges_csv(edges, str(tmp_path / "e"))
    assert rows(readers.read_weighted_edges(spark, str(tmp_path / "e"))) == rows(edges)
    sinks.write_weights(edges, str(tmp_path / "w"))
    assert [r[0] for r in spark.read.csv(str(tmp_path / "w")).collect()] == ["0.1"]
    sinks.write_titles_csv(make.vertices({1: "a,b"}), str(tmp_path / "v"))
    assert rows(readers.read_labels(spark, str(tmp_path / "v"))) == [(1, "a,b")]
    sinks.write_series_arrays(signal, str(tmp_path / "a"), 3)
    assert rows(spark.read.parquet(str(tmp_path / "a"))) == [(1, [0.0, 2.0, 3.5]), (2, [1.0, 0.0, 0.0])]


@pytest.mark.parametrize("weighted", [True, False])
def test_gexf_parts_in_name_order_are_a_document(make, tmp_path, weighted):
    vertices = {i: f'<{i}> & "x"' for i in range(200)}
    edges = [(i, (i * 7) % 200, i / 4) for i in range(200)]
    out = tmp_path / "g"
    sinks.write_gexf(PropertyGraph(make.vertices(vertices), make.edges(edges)), str(out), weighted)
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    root = ET.fromstring(text.encode())
    space = {"g": "http://www.gexf.net/1.2draft"}
    nodes = {int(n.get("id")): n.get("label") for n in root.findall(".//g:node", space)}
    assert nodes == vertices
    found = root.findall(".//g:edge", space)
    assert sorted((int(e.get("source")), int(e.get("target")), float(e.get("label"))) for e in found) == sorted(edges)
    assert all((e.get("weight") is not None) == weighted for e in found)


def test_shared_folder_holds_the_checkpoints(spark):
    folder = shared_folder(spark)
    assert scratch_path(spark, "x").startswith(folder)
    assert cut_lineage(spark.range(3)).count() == 3


def test_signal_text_keeps_the_place_of_values_that_are_no_numbers(spark, tmp_path, rows):
    found = readers.read_signal_text(spark, put(tmp_path, "n.txt", "(1,[0.0,NaN,3.0,Infinity,5.0])\n(-2,[])\n"))
    assert {(r["hour"], str(r["value"])) for r in found.collect()} >= {(2, "3.0"), (4, "5.0")}


def test_run_together_text_has_no_blanks(spark, make, tmp_path):
    out = str(tmp_path / "together")
    sinks.write_signal_text(make.signal({1: {1: 2}, 2: {0: 1}}).coalesce(1), out, 2, "concatenated")
    text = "".join(open(f"{out}/{f}").read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert sorted(text.replace(")(", ")\n(").split("\n")) == ["(1,[0.0,2.0])", "(2,[1.0,0.0])"]
