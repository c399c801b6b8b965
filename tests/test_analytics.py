"""Known answers of the attribute operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoanswers.functions import values
from geoanswers.meta import LayerMeta, Refused, area_frame, metric_plan, need_crs, to_metres, utm_zone
from geoanswers.operators import rank, scope, summary


@pytest.fixture(scope="module")
def parcels(spark):
    use = ["residential"] * 5 + ["commercial"] * 3 + ["industrial"] * 2
    return spark.createDataFrame([(i + 1, 100.0 * (i + 1), use[i]) for i in range(10)], "id long, area double, landuse string")


@pytest.fixture(scope="module")
def town(spark):
    """24 parcels: one twice as large, one use NULL, one blank, one population NULL."""
    uses = ["konut", "ticari", "tarım"]
    rows = [(i, f"P-{i + 1:03d}", 20000.0 if i == 12 else 10000.0, None if i == 7 else "" if i == 15 else uses[i % 3], None if i == 3 else 100 + 25 * i) for i in range(24)]
    return spark.createDataFrame(rows, "id long, parsel_no string, alan_m2 double, kullanim string, nufus long")


def test_numeric_summary(parcels, town):
    r = summary.numeric_summary(parcels, "area").first()
    assert (r["count"], r.usable, r.nulls, r["mean"], r["median"], r["sum"]) == (10, 10, 0, 550.0, 550.0, 5500.0)
    r = summary.numeric_summary(town, "nufus").first()
    assert (r.usable, r.nulls, r["sum"]) == (23, 1, 9125.0) and abs(r["mean"] - 396.739) < 1e-3
    r = summary.numeric_summary(town.limit(0), "nufus").first()
    assert r["count"] == 0 and r["mean"] is None


def test_categories_keep_nulls_and_blanks_apart(parcels, town):
    got = [(r.value, r["count"], r.percent) for r in summary.categories(parcels, "landuse").collect()]
    assert got == [("residential", 5, 50.0), ("commercial", 3, 30.0), ("industrial", 2, 20.0)]
    r = summary.categories(town, "kullanim", 2).collect()
    assert r[0].value == "tarım" and (r[0].nulls, r[0].blanks, r[0]["distinct"], r[0].truncated) == (1, 1, 3, True)


def test_histogram(parcels, spark):
    rows = summary.histogram(parcels, "area", 3).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [3, 3, 4] and rows[-1]["max"] == 1000.0
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    assert [r["count"] for r in summary.histogram(flat, "v").collect()] == [2]


def test_ranks_and_outliers(parcels, spark):
    assert [r.id for r in rank.top_n(parcels, "area", 3).collect()] == [10, 9, 8]
    v = spark.createDataFrame(list(enumerate(map(float, [1, 2, 2, 3, 3, 3, 4, 4, 5, 100]))), "id long, v double")
    rows = rank.outliers(v, "v").collect()
    assert [r.id for r in rows] == [9] and (rows[0].low, rows[0].high) == (-0.375, 6.625)
    assert rank.outliers(v.limit(3), "v").count() == 0 and v.limit(3).agg(rank.reason(v, "v")).first()[0] == "not_enough_values"
    with pytest.raises(Refused):
        rank.outliers(v, "v", "guess")


def test_compare_and_groups(parcels, town):
    r = summary.compare(parcels, "area", F.col("id") <= 5).first()
    assert (r.subset_mean, r.whole_mean, r.mean_delta) == (300.0, 550.0, -250.0)
    got = {r.group: (r.features, r.value) for r in summary.group_aggregate(parcels, "landuse", "area", "sum").collect()}
    assert got["industrial"] == (2, 1900.0)
    assert {r.group: r.features for r in summary.group_aggregate(town, "kullanim").collect()}[None] == 2


def test_profiles_and_classes(town):
    p = {r.field: r for r in summary.field_profile(town).collect()}
    assert (p["kullanim"].nulls, p["kullanim"].blanks, p["kullanim"]["distinct"], p["kullanim"].numeric) == (1, 1, 3, False)
    assert p["alan_m2"].numeric and p["parsel_no"]["distinct"] == 24
    assert summary.class_breaks(town, "alan_m2").count() == 1  # equal breaks collapse
    assert sum(r.features for r in summary.class_assign(town, "nufus", 4, "std_dev").collect()) == 23


def test_scopes(parcels, spark):
    ids = spark.createDataFrame([("3",), ("x",), ("99",)], "id string")
    assert [r.id for r in scope.select_ids(parcels, ids).collect()] == [3]
    assert scope.select_invert(parcels, ids).count() == 9
    assert tuple(scope.selection_report(parcels, ids).first()) == (1, 2)
    with pytest.raises(Refused):
        scope.scope_selection(parcels, ids.limit(0))
    assert scope.typed_filter(parcels, "area", ">", "550").count() == 5
    assert scope.typed_filter(parcels, "landuse", "in", "commercial, industrial").count() == 5
    for bad in (("in", " , "), ("~", "1"), ("=", None)):
        with pytest.raises(Refused):
            scope.typed_filter(parcels, "area", *bad)
    r = scope.read_columns(parcels, ["area"], cap=4).collect()
    assert len(r) == 4 and r[0].truncated
    with pytest.raises(Refused):
        scope.read_columns(parcels, ["nope"])


def test_calculated_fields(spark):
    df = spark.createDataFrame([(1, 10000.0, 50.0), (2, 20000.0, 0.0), (3, None, 5.0)], "id long, area_m2 double, population double")
    got = scope.calc_field(df, "ha", F.col("area_m2") / 10000).orderBy("id").collect()
    assert [r.ha for r in got] == [1.0, 2.0, None]
    assert [r.d for r in scope.calc_field(df, "d", F.try_divide("area_m2", "population")).orderBy("id").collect()] == [200.0, None, None]
    assert scope.calc_field(df, "big", F.lit(1e308) * 10).first().big is None
    assert [r.t for r in scope.calc_field(df, "t", F.concat(F.lit("P-"), F.col("area_m2").cast("long").cast("string")), "text").orderBy("id").collect()][0] == "P-10000"
    assert scope.calc_field(df, "i", F.lit(-2.7), "integer").first().i == -2
    for name in ("AREA_M2", "", "x" * 61):
        with pytest.raises(Refused):
            scope.calc_field(df, name, F.lit(1))


def test_values(spark):
    df = spark.createDataFrame([(None, [1]), (" ", None), ("0", [2]), ("x", [])], "v string, n array<int>")
    assert [r[0] for r in df.select(values.is_blank(F.col("v"))).collect()] == [True, True, False, False]
    assert [r.n for r in values.nested_as_text(df).collect()] == ["[1]", None, "[2]", "[]"]


def test_units_and_frames():
    metres, degrees = LayerMeta("EPSG:32635", "m"), LayerMeta("EPSG:4326", "degrees", True)
    assert to_metres(2, "km") == 2000 and abs(to_metres(10, "ft") - 3.048) < 1e-12
    assert utm_zone(28.97, 41, 28.99, 41.1) == "EPSG:32635" and utm_zone(-10, 30, 30, 50) is None and utm_zone(1, -34, 2, -33) == "EPSG:32731"
    assert metric_plan(metres, None, 5) == ("map_units", None) and metric_plan(degrees, (28.97, 41, 28.99, 41.1), 5) == ("reproject", "EPSG:32635")
    assert area_frame(degrees, (-10, 30, 30, 50)) == "ellipsoidal"
    for f in (lambda: to_metres(1, "cubit"), lambda: metric_plan(degrees, (-10, 30, 30, 50), 5), lambda: need_crs("4326")):
        with pytest.raises(Refused):
            f()


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, o int")
    b = spark.createDataFrame([("x", 1), (None, 2), ("z", 3), ("z", 4)], "k string, o int")
    got = {r.k: (r.o, r.repeats) for r in scope.dedupe_sources(a, b, "k", "o").collect()}
    assert got == {"x": (1, 1), "y": (2, 0), "z": (3, 1)}
    assert scope.merge_layers(a, b.withColumnRenamed("o", "p")).columns == ["k", "o", "p"]


@pytest.mark.parametrize("few", [10, 200, 10**6])
@pytest.mark.parametrize("kind", ["even", "tail", "ties", "one"])
def test_quantiles_are_exact_however_few_values_a_task_may_sort(spark, monkeypatch, few, kind):
    from geoanswers.operators import ordering

    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "ACCURACY", 100)
    r = np.random.default_rng(3)
    v = {"even": r.uniform(-5, 5, 3000), "tail": np.exp(r.normal(0, 20, 3000)), "ties": r.integers(0, 4, 3000).astype(float), "one": np.array([7.5])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    parts = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    assert np.allclose(ordering.quantiles(df, F.col("v"), parts), np.quantile(v, parts), rtol=1e-12, atol=0)
    assert ordering.quantiles(df.limit(0), F.col("v"), parts) == [None] * 6


def test_medians_of_groups(spark):
    r = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", float(r.integers(0, 30)) if i % 7 else None) for i in range(900)]
    got = {q.group: q.value for q in summary.group_aggregate(spark.createDataFrame(rows, "g string, v double"), "g", "v", "median").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in {k for k, _ in rows}}


def test_literals_are_refused_before_a_job(parcels):
    for field, operator, value in (("area", ">", "many"), ("id", "=", "1.5"), ("id", "in", "1, x")):
        with pytest.raises(Refused):
            scope.typed_filter(parcels, field, operator, value)
    assert scope.typed_filter(parcels, "id", "in", "1, 2").count() == 2
