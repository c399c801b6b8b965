"""Files of features."""

from pathlib import Path

from pyspark.sql import functions as F

from geoanswers.sources import features as src


def test_a_file_a_collection_written_by_all_cores_and_read_once(spark, tmp_path):
    one = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":%d},"geometry":{"type":"Point","coordinates":[%d,2]}}]}'
    texts = spark.createDataFrame([(one % (k, k),) for k in range(60)], "text string").coalesce(1)
    src.write_collections(texts, str(tmp_path / "all"))
    files = [p.name for p in Path(tmp_path / "all").iterdir() if p.name.startswith("part-")]
    assert len(files) == 60 and not any(p.is_dir() for p in Path(tmp_path / "all").iterdir())
    assert len({name.split("-")[1] for name in files}) > 4  # tasks
    read = src.read_features(spark, str(tmp_path / "all"))
    assert sorted(int(r.properties["n"]) for r in read.select("properties").collect()) == list(range(60))
    kinds = src.features_by_type(read)
    assert kinds.groupBy("kind").agg(F.count("*").alias("n"), F.max("names").alias("names")).collect() == [("point", 60, "n")]
    assert "FileScan text" not in kinds._jdf.queryExecution().executedPlan().toString()
