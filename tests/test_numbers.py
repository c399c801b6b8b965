"""Numbers that are none (NaN, infinities, as values and as text), and tables owned by who stores them."""

import math
import os
import threading

import pytest
from pyspark.sql import functions as F

from geoanswers.operators import rank, summary, terrain
from geoanswers.sources.tables import Scratch, stored

NAN, INF = float("nan"), float("inf")


@pytest.fixture(params=["double", "string"])
def odd(spark, request):
    """0 to 9 beside NaN, both infinities and NULL, as numbers or as text."""
    values = [*map(float, range(10)), NAN, INF, -INF, None]
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double").withColumn("v", F.col("v").cast(request.param))


def test_summary_leaves_out_what_is_no_number(odd):
    r = summary.numeric_summary(odd, "v").first()
    assert (r["count"], r.usable, r.nulls, r.not_finite) == (14, 10, 4, 3)
    assert (r["sum"], r["mean"], r["min"], r["max"], r.median, r.q1) == (45, 4.5, 0, 9, 4.5, 2.25)


def test_breaks_and_classes_and_bins(odd):
    assert [(r["min"], r["max"]) for r in summary.class_breaks(odd, "v", 3).orderBy("class").collect()] == [(0, 3), (3, 6), (6, 9)]
    for method in ("quantile", "equal_interval", "std_dev"):
        assert sum(r.features for r in summary.class_assign(odd, "v", 3, method).collect()) == 10
    bins = summary.histogram(odd, "v", 3).orderBy("bin").collect()
    assert [(r["min"], r["max"], r["count"]) for r in bins] == [(0, 3, 3), (3, 6, 3), (6, 9, 4)]


def test_ranks_and_outliers(odd, spark):
    assert [r.value for r in rank.top_n(odd, "v", 2).collect()] == [9, 8]
    assert [r.value for r in rank.top_n(odd, "v", 1, ascending=True).collect()] == [0]
    for method in ("iqr", "zscore"):
        assert rank.outliers(odd, "v", method).count() == 0
    far = odd.union(spark.createDataFrame([(99, 500.0)], "id long, v double").withColumn("v", F.col("v").cast(odd.schema["v"].dataType)))
    assert [r.value for r in rank.outliers(far, "v").collect()] == [500.0]


def test_groups_and_comparisons(odd):
    r = summary.group_aggregate(odd.withColumn("g", F.lit("a")), "g", "v", "median").first()
    assert (r.features, r.usable, r.skipped, r.value) == (14, 10, 4, 4.5)
    r = summary.compare(odd, "v", F.col("id") >= 8).first()
    assert (r.subset_usable, r.subset_mean, r.whole_usable) == (2, 8.5, 10)


def test_nothing_but_nan(spark):
    df = spark.createDataFrame([(1, NAN), (2, INF)], "id long, v double")
    r = summary.numeric_summary(df, "v").first()
    assert (r.usable, r.not_finite, r["sum"], r.median) == (0, 2, None, None)
    assert summary.class_breaks(df, "v").count() == 0 and summary.histogram(df, "v").count() == 0
    assert not any(math.isnan(x or 0) for x in r if isinstance(x, float))


def _cells(spark, n):
    return spark.range(n * n).select(F.lit(0).alias("raster_id"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), (F.hash("id") % 100).cast("double").alias("z"))


def _path(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_tables_of_others_stay(spark):
    held = stored(spark.range(10), "held")
    seen, errors = {}, []

    def other(name, work):
        try:
            seen[name] = work(_cells(spark, 12)).count()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=other, args=x) for x in (("pits", terrain.watershed), ("flow", terrain.flow_accumulation))]
    for t in threads:
        t.start()
    with Scratch(spark) as mine:
        kept = stored(spark.range(5), "kept")
        for t in threads:
            t.join()
        assert len(mine.paths) == 1
    assert not errors and seen == {"pits": 144, "flow": 144}
    assert held.count() == 10 and kept.count() == 5


def test_what_is_left_goes_over_to_the_caller(spark):
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            first = stored(spark.range(3), "a")
            place = inner.mark()
            second = stored(spark.range(4), "b")
            gone, left = _path(first), _path(second)
            inner.discard(place)
        assert not os.path.exists(gone) and os.path.exists(left) and len(outer.paths) == 1
        outer.discard()
    assert not os.path.exists(left)
