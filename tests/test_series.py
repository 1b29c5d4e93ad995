import pytest
from pyspark.sql import functions as F

from burstgraph.functions import timeaxis, titles
from burstgraph.operators import ordinals, series


def test_dedupe(spark, rows):
    raw = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 0.0)], "id BIGINT, hour INT, value DOUBLE")
    assert rows(series.dedupe(raw)) == [(1, 1, 3.0)]


def test_zero_filled_statistics(make):
    signal = make.signal({1: {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 10}})
    stats = series.series_stats(signal, 10, 2.0).collect()[0]
    assert (stats["mean"], stats["sd"]) == pytest.approx((2.5, 3.0413812651))
    above = series.series_stats(signal, 10, 1.0).select((F.col("threshold") - F.col("mean")).alias("sd"))
    assert signal.where(F.col("value") > 2 * above.scalar()).count() == 1
    assert signal.where(F.col("value") > above.scalar()).count() == 3


def test_window_is_open(make, rows):
    signal = make.signal({1: {1: 5, 2: 6, 3: 7}, 2: {3: 1}})
    assert rows(series.slice_window(signal, 1, 3)) == [(1, 2, 6.0)]
    assert rows(series.active_in(signal, 1, 3), "id") == [(1,), (1,), (1,)]
    assert rows(series.peak_above(signal, 6.0), "id") == [(1,), (1,), (1,)]
    assert rows(series.activity_band(signal, 0, 2), "id") == [(2,)]


def test_bursts_keep_samples_outside_the_window(make, rows):
    signal = make.signal({1: {0: 9, 1: 9, 2: 9, 3: 1}, 2: {0: 9, 1: 1}})
    # More than one burst strictly inside (0, 4); the burst at hour 0 is kept but not counted.
    kept = series.burst_samples(signal, 40, 1.0, 1, 0, 4)
    assert rows(kept) == [(1, 0, 9.0), (1, 1, 9.0), (1, 2, 9.0)]


def test_packed_forms(make, rows):
    signal = make.signal({1: {1: 2, 2: 3.5}, 2: {0: 1}})
    assert rows(series.densify(signal, 3)) == [(1, [0.0, 2.0, 3.5]), (2, [1.0, 0.0, 0.0])]
    packed = {r["id"]: r for r in series.pack(signal, normalise=True).collect()}
    assert packed[1]["freq"] == 2 and packed[1]["series"] == {1: 1.0, 2: 1.75}
    sliced = series.pack(signal).select("id", series.slice_packed(F.col("series"), 1, 3).alias("s")).collect()
    assert {r["id"]: r["s"] for r in sliced} == {1: {2: 3.5}, 2: {}}


def test_daily_and_reference(spark, make, rows):
    activity = series.overall_activity(make.signal({1: {0: 1, 25: 2}, 2: {1: 3, 47: 6}}))
    daily = series.daily_activity(activity)
    assert rows(daily) == [(0, 50.0), (1, 100.0)]
    reference = spark.createDataFrame([(0, 7.0), (2, 8.0)], "day INT, value DOUBLE")
    assert rows(series.compare_with_reference(daily, reference)) == [(0, 50.0, 7.0)]


def test_ordinals_across_partitions(spark):
    ids = spark.range(0, 5000, 7).repartition(9)
    numbered = ordinals.ordinal_ids(ids).orderBy("id").collect()
    assert [r["ordinal"] for r in numbered] == list(range(len(numbered)))


def test_drop_positions(spark, make, rows):
    positions = spark.createDataFrame([(0,), (2,)], "position BIGINT")
    assert rows(ordinals.drop_positions(make.ids([10, 30, 20, 40]), positions)) == [(20,), (40,)]


def test_titles(spark):
    table = spark.createDataFrame([("AT&T", "Gisele_Bündchen", 'a\\"b', "x\\ny")], "a STRING, b STRING, c STRING, d STRING")
    r = table.select(
        titles.stored_title(F.col("a")),
        titles.exported_title(F.col("a")),
        titles.printable_title(F.col("b")),
        titles.display_title(titles.printable_title(F.col("b"))),
        titles.stored_title(F.col("c")),
        titles.exported_title(F.col("d")),
        titles.xml_escape(F.lit('<a&"b">')),
    ).collect()[0]
    assert tuple(r) == ("ATT", "AT T", "Gisele_Bndchen", "Gisele Bndchen", "ab", "xy", "&lt;a&amp;&quot;b&quot;&gt;")


def test_digit_ids(spark):
    table = spark.createDataFrame([("12",), ("",), ("1a",), (None,)], "id STRING")
    assert [r[0] for r in table.select(titles.all_digits(F.col("id"))).collect()] == [True, False, False, None]


def test_named_windows(make, rows):
    signal = make.signal({1: {0: 1, 912: 1, 913: 1, 2500: 1}})
    assert rows(timeaxis.by_named_window(signal), "window", "hour") == [("charlie", 2500), ("january", 2500)]


def test_calendar_and_hours(spark, rows):
    hours = spark.createDataFrame([(0,), (5 * 24,), (7 * 24,), (191,), (24 * 31,)], "hour INT")
    marks = timeaxis.calendar_marks(hours, "2024-01-01 00:00:00")
    assert rows(marks) == [(0, 1, 1, 0), (120, 0, 0, 1), (168, 0, 1, 0), (191, 0, 0, 0), (744, 1, 0, 0)]
    daily = spark.createDataFrame([(0, 1.0), (2, 3.0)], "day INT, value DOUBLE")
    expanded = rows(timeaxis.hourly_expand(daily))
    assert expanded == [(h, 1.0) for h in range(24)] + [(h, 3.0) for h in range(48, 72)]
