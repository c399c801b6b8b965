"""Rules of run logs, reviews, items and traces: known answers, case by case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from geoanswers import catalog
from geoanswers.operators import runs, scope
from geoanswers.sources import features as src


def ask(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_the_job_state_wins_over_the_status(spark):
    rows = [("failed", "dispatched"), ("review_required", None), (None, "needs_review"), (" ", "Completed "), (None, None), (None, "review_required"), (" RUNNING", "failed")]
    got = ask(spark, rows, "j string, s string", runs.run_state(F.col("j"), F.col("s")))
    assert [r[0] for r in got] == ["failed", "needs_review", "needs_review", "completed", None, "review_required", "running"]


def test_every_state_has_a_bucket(spark):
    states = ["failed", "cancelled", "completed", "succeeded", "needs_review", "review_required", "rehydrating", "error", None]
    got = ask(spark, [(s,) for s in states], "s string", runs.run_bucket(F.col("s")))
    assert [r[0] for r in got] == ["failed"] * 2 + ["completed"] * 2 + ["review_required"] * 2 + ["active"] * 3


def test_a_failure_carries_its_reference_and_invents_no_reason(spark):
    rows = [("raster is not georeferenced", "corr_9"), ("no control points", " "), (None, "corr_9"), (" ", None)]
    got = ask(spark, rows, "m string, r string", runs.run_failure(F.col("m"), F.col("r")))
    assert [r[0] for r in got] == ["raster is not georeferenced (reference corr_9)", "no control points", None, None]


def test_counts_and_listing_are_over_all_runs(spark):
    schema = "run_id long, state string, seq long, title string, message string, reference string, code string"
    rows = [(i, "completed" if i % 2 else None, i, " t ", None, None, None) for i in range(25)] + [(99, "failed", 5, "Georeference sheet 4", "no control points", None, " e7")]
    df = spark.createDataFrame(rows, schema)
    assert {r.state: r.runs for r in runs.run_counts(df).collect()} == {"completed": 12, "unknown": 13, "failed": 1}
    got = runs.run_listing(df, "all", 3).collect()
    assert len(got) == 3 and {(r.matched, r.total) for r in got} == {(26, 26)} and [r.run_id for r in got] == [24, 23, 22]
    failed = runs.run_listing(df, "failed").first()
    assert (failed.run_id, failed.title, failed.error, failed.code, failed.matched, failed.total) == (99, "Georeference sheet 4", "no control points", "E7", 1, 26)
    assert runs.run_listing(df, "nonsense").count() == 0 and runs.run_listing(df, "active").count() == 10


def test_the_first_typed_error_of_a_batch(spark):
    rows = [(1, 0, "failed", None, None), (1, 1, "Failed", " e1", None), (1, 2, "failed", None, "later"), (2, 0, "failed", "georeference_required", " "), (3, 0, "failed", " ", ""), (3, 1, "error", "E1", "x")]
    got = {r.batch_id: (r.failed, r.first_index, r.first_code, r.first_message, r.every) for r in runs.batch_failures(spark.createDataFrame(rows, "batch_id int, index int, state string, code string, message string")).collect()}
    assert got == {1: (3, 1, "E1", None, False), 2: (1, 0, "GEOREFERENCE_REQUIRED", None, True), 3: (1, None, None, None, False)}


def test_batches_end_in_the_service_s_words(spark):
    states = ["completed", "FAILED", "cancelled", "partial", "completed_with_failures", "succeeded", "running", None]
    assert [r[0] for r in ask(spark, [(s,) for s in states], "s string", runs.batch_terminal(F.col("s")))] == [True] * 5 + [False] * 3


@pytest.mark.parametrize(
    "properties, bucket",
    [
        ((True, None, "valid", "uncalibrated"), "needs_review"), ((False, None, "valid", None), "clean"), ((True, None, "invalid", None), "invalid"),
        ((False, None, None, None), "clean"), ((None, "needs_review", None, None), "needs_review"), ((None, " Pending ", " OK ", "invalid"), "needs_review"),
        ((None, "review_required", "passed", None), "needs_review"), ((None, "approved", "", None), "clean"), ((None, None, "self_intersection", None), "invalid"), ((None, None, None, None), "clean"),
    ],
)
def test_review_buckets(spark, properties, bucket):
    df = spark.createDataFrame([(properties,)], "properties struct<review_required boolean, review_status string, validation_status string, quality_status string>")
    assert runs.review_buckets(df).first().bucket == bucket


def test_plans_end_when_they_wait_for_a_decision(spark):
    rows = [(1, "needs_review", 2), (2, "completed", None), (3, "failed", 4), (4, "running", 5), (5, "rehydrating", 1), (6, None, 1), (7, "succeeded", 3)]
    got = runs.plan_report(spark.createDataFrame([(i, s, None, n) for i, s, n in rows], "run_id int, job_state string, status string, layers int")).collect()
    assert [(r.finished, r.layers) for r in got] == [(True, 2), (True, 0), (True, 0), (False, 0), (False, 0), (False, 0), (True, 3)]


def test_items_show_unknown_states_as_themselves(spark):
    rows = [(0, "Failed", " no points "), (1, "pending", None), (2, "half_done", ""), (3, None, None), (4, "succeeded", None), (5, "needs_review", None)]
    got = [tuple(r)[2:] for r in runs.item_status(spark.createDataFrame(rows, "index int, state string, message string")).orderBy("index").collect()]
    assert got == [("!", "Failed", "no points", "open"), ("-", "Queued", None, ""), ("?", "Half done", None, ""), ("?", "Unknown", None, ""), ("+", "Done", None, "import"), ("?", "Needs review", None, "review")]


def test_titles(spark):
    items = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "a", 3), (1, 2, "none", None), (1, 3, "b", 2)], "batch_id int, index int, file_id string, page int")
    files = spark.createDataFrame([("a", "/x/y/sheet.tif"), ("b", "")], "file_id string, name string")
    assert sorted(r.title for r in runs.name_lookup(items, files).collect()) == ["Item 3", "Item 4 · page 2", "sheet.tif", "sheet.tif · page 3"]


def test_trace_rows_fill_what_steps_leave_out(spark):
    step = "struct<index: int, title: string, capability: string, status: string, duration_ms: bigint, message: string, error_code: string, error_message: string>"
    steps = [(0, None, "read", None, 0, None, None, None), (7, " T ", "x", "refused", 999, " ", "E1", "why"), (None, "", None, "odd", 1250, "m", None, "w"), (None, None, None, "planned", 61_000, None, None, None)]
    got = [tuple(r)[1:] for r in runs.trace_steps(spark.createDataFrame([(1, steps)], f"turn_id int, steps array<{step}>")).orderBy("position").collect()]
    assert got == [
        (1, "read", "succeeded", "done", None, None, None), (3, "Step", "odd", "odd", "1.3 s", "m", None), (4, "Step", "planned", "queued", "61 s", None, None), (7, "T", "refused", "declined", "999 ms", "why", "E1"),
    ]


def test_sources_are_counted_apart_and_wrong_ones_named(spark):
    rows = [(1, "file", "b.shp", 5, "raster", "vector"), (1, "layer", "a", None, "raster", "raster"), (1, "file", "a.csv", 7, "raster", "unknown"), (2, "layer", "v", 0, "vector", "vector")]
    got = {r.task_id: tuple(r)[1:] for r in runs.source_summary(spark.createDataFrame(rows, "task_id int, origin string, label string, bytes long, wanted string, kind string"), F.col("kind")).collect()}
    assert got == {1: (2, 1, 12, 2, "a.csv"), 2: (0, 1, 0, 0, None)}


def test_layers_before_artifacts(spark):
    ref = "array<struct<kind string, id string, url string, geometry_type string, format string, name string>>"
    layer = lambda i, t="polygon", n=None, k="layer": (k, i, None, t, None, n)
    art = lambda url, form=None, name=None: ("artifact", "i", url, None, form, name)
    rows = [
        (1, [layer("a", n="A"), layer("a", n="B"), layer("r", "Raster"), layer("", n="no id"), layer("t", k="table"), art("x.geojson")], [layer("old")]),
        (2, [], [layer("old", n="O")]), (3, None, None),
        (4, [art("p.json", "GeoJSON", "P"), art("p.json", "geojson", "Q"), art("q.pdf", "pdf"), art("r.GeoJSON"), art("s.tif"), art("")], None),
    ]
    df = spark.createDataFrame(rows, f"run_id int, references {ref}, legacy {ref}")
    assert sorted(tuple(r)[:4] for r in src.result_refs(df).collect()) == [(1, "a", "vector", "A"), (1, "r", "raster", "r"), (2, "old", "vector", "O")]
    assert sorted(map(tuple, src.artifact_fallback(df).collect())) == [(4, "p.json", "P"), (4, "r.GeoJSON", "i")]


def test_truncation_follows_the_flag(spark):
    rows = [("a", 5000, 9000, True), ("b", 5000, 9000, None), ("c", 5, 5, True), ("d", 5000, None, True), ("e", 5, 0, True), ("f", 1, 9, False)]
    got = {r.name: r.missing for r in src.truncation_audit(spark.createDataFrame(rows, "name string, returned_count long, total_count long, truncated boolean")).collect()}
    assert got == {"a": 4000, "c": 0, "d": None, "e": None}


def test_scattered_points_stay_in_their_squares(spark):
    anchors = spark.createDataFrame([(i, 10.0 * i, -5.0) for i in range(40)], "id long, x double, y double")
    a = src.scatter_points(anchors, "id", 5, 2.0, 3)
    got = a.collect()
    assert len(got) == 200 and all(abs(r.x - 10 * r.id) <= 2 and abs(r.y + 5) <= 2 for r in got) and len({(r.x, r.y) for r in got}) == 200
    assert sorted(got) == sorted(src.scatter_points(anchors.repartition(7), "id", 5, 2.0, 3).collect())
    assert sorted(got) != sorted(src.scatter_points(anchors, "id", 5, 2.0, 4).collect())


def test_preview_counts_what_can_not_be_stored(spark):
    df = spark.createDataFrame([(1, "4.9"), (2, "abc"), (3, None), (4, "1e400"), (5, "x" * 60), (6, "NaN"), (7, "-2")], "id int, v string")
    r = scope.calc_preview(df, F.col("v"), "integer").first()
    assert (r.rows, r.nulls, r.sample, r.bad) == (7, 5, "4,-2", 4)
    assert r.problems == f"'abc' is not a number; a value was not a finite number; '{'x' * 40}' is not a number"


def test_durations_are_rounded_as_printf_rounds_them(spark):
    ms = [*range(900, 30_000, 7), *range(1_050, 10_000, 100), *range(10_500, 40_000, 1_000), 9_949, 9_950, 9_951, 9_999, 10_000, 3_600_500, None]
    df = spark.createDataFrame([(m,) for m in ms], "ms long").select("ms", runs.duration_text(F.col("ms"), printf=True).alias("text"))
    want = lambda m: None if m is None else f"{m} ms" if m < 1000 else f"{m / 1000:.1f} s" if m < 10_000 else f"{m / 1000:.0f} s"
    assert [(r.ms, r.text) for r in df.collect() if r.text != want(r.ms)] == []


def test_codes_that_are_all_missing_answer_as_the_query_s_sql_does(spark, tmp_path):
    """Batch 1: all codes NULL; 2: one has a code; 4: all carry it."""
    ids = [(1, 3), (1, 6), (2, 9), (2, 10), (4, 1), (4, 2), (5, 12)]
    spark.createDataFrame([(u, i, "error") for u, i in ids], "user_id long, event_id long, event_type string").withColumn("ts", F.current_timestamp()).withColumn("props", F.lit("{}")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.batch_id: r for r in catalog.queries()["batch_failures"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(catalog.oracle_sql()["batch_failures"])
    assert {b: r.every for b, r in got.items()} == {1: None, 2: False, 4: True, 5: None}
    assert {r[0]: r for r in want.fetchall()} == {b: tuple(r[c] for c in want.columns) for b, r in got.items()}
