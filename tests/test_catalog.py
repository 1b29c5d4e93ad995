"""Catalog queries against their SQL at the smallest scale.

A part of the catalog by default; CATALOG=all runs every query.
"""

import os

import pytest

import __spark_entry__ as driver
from burstgraph.catalog.oracles import ORACLES
from burstgraph.catalog.queries import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
DEFAULT = """signal_long vertices pagecounts_filter title_clean window_slice all_pairs hebb_weights chunked_pearson
 series_stats burst_vertices degree_histogram smoothed_by_label named_windows nth_component null_model_edges
 degrade recall_step mute_sweep learn_peaks""".split()
NAMES = list(QUERIES) if os.environ.get("CATALOG") == "all" else DEFAULT

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    mine = driver.queries()[name](spark, FOLDER).toPandas()
    assert len(mine)
    assert difference(mine, sql.execute(driver.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert driver.entry(spark).columns == ["kind", "src", "dst", "weight", "title"]
