import pytest

DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A shared folder for these tests."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text), ...]) with further columns, two of them named like the operators' own."""

    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), -1, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENT + ", node BIGINT, score STRING").repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """words(random, n): n invented words."""

    def make(random, n, kinds=5000):
        return [f"w{random.randrange(kinds):04d}" for _ in range(n)]

    return make
