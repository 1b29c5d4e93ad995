import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make.signal({id: {hour: value}}), make.edges([...]), make.vertices({id: title}), make.cells([...])"""

    class Make:
        def signal(self, series):
            rows = [(i, h, float(v)) for i, samples in series.items() for h, v in samples.items()]
            return spark.createDataFrame(rows, "id BIGINT, hour INT, value DOUBLE")

        def edges(self, rows):
            rows = [(*r, 0.0) if len(r) == 2 else (r[0], r[1], float(r[2])) for r in rows]
            return spark.createDataFrame(rows, "src BIGINT, dst BIGINT, weight DOUBLE")

        def vertices(self, titles):
            return spark.createDataFrame(list(titles.items()), "id BIGINT, title STRING")

        def ids(self, ids):
            return spark.createDataFrame([(i,) for i in ids], "id BIGINT")

        def cells(self, cells):
            return spark.createDataFrame(list(cells), "id BIGINT, hour INT")

    return Make()


@pytest.fixture(scope="session")
def rows():
    return lambda df, *columns: sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(params=["plain", "split"])
def joins(request, monkeypatch):
    """Run a test with plain joins and with every frequent key split."""
    if request.param == "split":
        from burstgraph.operators import skew

        monkeypatch.setattr(skew, "ROWS_PER_TASK", 3)
    return request.param
