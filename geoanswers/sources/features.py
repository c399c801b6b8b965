"""Features from files and run logs, and back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.meta import Refused, need_columns, need_crs
from geoanswers.sources.tables import stored

_KINDS = {"Point": "point", "LineString": "linestring", "Polygon": "polygon", "MultiPoint": "multipoint", "MultiLineString": "multilinestring", "MultiPolygon": "multipolygon"}
_DEPTH = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiPoint": 1, "MultiLineString": 2, "MultiPolygon": 3}


def on_earth(g: Column) -> Column:
    """Every vertex is a longitude and latitude; no vertex is no position."""
    v = geom.vertices(g)
    return (F.size(v) > 0) & F.forall(v, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))


def import_points(spark: SparkSession, path: str, crs: str, easting: str, northing: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Points of a delimited file with a header, and the rows whose axes don't parse. CRS and both axes are the
    caller's; a file without a point is refused."""
    need_crs(crs)
    raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    need_columns(raw, easting, northing)
    x, y = F.col(easting).try_cast("double"), F.col(northing).try_cast("double")
    good = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    points = raw.filter(good).withColumn("geom", geom.point(x, y))
    if points.isEmpty():
        raise Refused("no point in the file")
    return points, raw.filter(~good)


def parsed_geometry(text: Column) -> Column:
    """GeoJSON geometry text as the geometry struct; NULL for collections and unknown types."""
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    depth = lambda d: F.from_json(coordinates, T._parse_datatype_string("array<" * (d + 1) + "double" + ">" * (d + 1)))
    pt = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    run = lambda r: F.transform(r, pt)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pt(depth(0))))))
        .when(kind == "LineString", F.array(F.array(run(depth(1)))))
        .when(kind == "MultiPoint", F.transform(depth(1), lambda p: F.array(F.array(pt(p)))))
        .when(kind == "Polygon", F.array(F.transform(depth(2), run)))
        .when(kind == "MultiLineString", F.transform(depth(2), lambda r: F.array(run(r))))
        .when(kind == "MultiPolygon", F.transform(depth(3), lambda poly: F.transform(poly, run)))
    )
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return F.when(parts.isNotNull(), F.struct(F.get(F.array(F.try_element_at(names, kind)), F.lit(0)).alias("kind"), parts.alias("parts")))


def exploded(collections: DataFrame, column: str = "text") -> DataFrame:
    """A row for each feature of each FeatureCollection text: the other columns, position, properties, geom."""
    raw = F.from_json(F.get_json_object(column, "$.features"), T.ArrayType(T.StringType()))
    rest = [c for c in collections.columns if c != column]
    rows = collections.select(*rest, F.posexplode(raw).alias("position", "feature"))
    properties = F.from_json(F.get_json_object("feature", "$.properties"), T.MapType(T.StringType(), T.StringType()))
    return rows.select(*rest, "position", properties.alias("properties"), parsed_geometry(F.get_json_object("feature", "$.geometry")).alias("geom"))


def write_collections(texts: DataFrame, path: str) -> None:
    """A file for each text (one column), all in one folder. Opening files is the work, so the texts are dealt out over the cores, and
    tasks put their own files in place: the driver would do it one by one."""
    dealt = texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism)
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of GeoJSON files: a task a file, features exploded."""
    return exploded(spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text")))


def features_by_type(features: DataFrame, most: int | None = None) -> DataFrame:
    """Features with a known geometry on the earth, by kind; ``names`` is the sorted union of the kind's attributes. They are stored on
    the way: files are read and taken apart once."""
    good = features.filter(F.col("geom").isNotNull()).filter(on_earth(F.col("geom"))).withColumn("kind", F.col("geom.kind"))
    good = stored(good, "features")
    names = good.select("kind", F.explode(F.map_keys("properties")).alias("k")).groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("names"))
    out = good.join(F.broadcast(names), "kind", "left")
    return out.limit(most) if most else out


def scatter_points(anchors: DataFrame, key: str, each: int, radius: float, seed: int = 0) -> DataFrame:
    """``each`` points around every anchor (key, x, y), in the square of that radius: key, n, x, y. The same for the same
    seed however they are partitioned."""
    rows = anchors.select(key, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("n"))

    def unit(salt: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"), F.col("n").cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32

    at = lambda axis: (F.col(axis) + (2 * unit(axis) - 1) * radius).alias(axis)
    return rows.select(key, "n", at("x"), at("y"))


def build_shapes(vertices: DataFrame, kind: str) -> DataFrame:
    """shape_id, vertices, status, geom from rows (shape_id, seq, x, y): repeats collapse; fewer than 1, 2 or 3 distinct
    vertices (point, linestring, polygon) are refused with a reason."""
    least = {"point": 1, "linestring": 2, "polygon": 3}.get(kind)
    if least is None:
        raise Refused(f"unknown kind: {kind}")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    s = vertices.groupBy("shape_id").agg(F.array_distinct(ordered).alias("v"))
    v = F.slice("v", 1, 1) if kind == "point" else F.when(F.lit(kind == "polygon"), F.concat("v", F.slice("v", 1, 1))).otherwise(F.col("v"))
    ok = F.size("v") >= least
    return s.select("shape_id", F.size("v").alias("vertices"), F.when(ok, "ok").otherwise(f"a {kind} needs {least} distinct vertices").alias("status"), F.when(ok, geom.geometry(kind, F.array(F.array(v)))).alias("geom"))


def as_geojson(g: Column) -> Column:
    """Geometry struct to GeoJSON text (single kinds)."""
    pts = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    first = F.get(F.get(g["parts"], F.lit(0)), F.lit(0))
    one = F.to_json(F.array(F.get(pts(first), F.lit(0))))
    body = F.when(g["kind"] == "point", F.substring(one, F.lit(2), F.length(one) - 2)).when(g["kind"] == "linestring", F.to_json(pts(first))).otherwise(F.to_json(F.transform(F.get(g["parts"], F.lit(0)), pts)))
    kind = F.when(g["kind"] == "point", "Point").when(g["kind"] == "linestring", "LineString").otherwise("Polygon")
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


def export(df: DataFrame, path: str, form: str) -> DataFrame:
    """Write as csv, json or parquet and count what was written: one row (path, format, rows)."""
    if form not in ("csv", "json", "parquet"):
        raise Refused(f"unknown format: {form}")
    writer = df.write.option("header", True) if form == "csv" else df.write
    writer.format(form).save(path)
    reader = df.sparkSession.read.option("header", True) if form == "csv" else df.sparkSession.read
    back = reader.schema(df.schema).format(form).load(path)
    return back.agg(F.count("*").alias("rows")).select(F.lit(form).alias("format"), "rows")


def review_sink(features: DataFrame, path: str, bucket: Column) -> DataFrame:
    """A folder for each verdict (``bucket``) that has rows; returns bucket, rows as read back."""
    features.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
    return features.sparkSession.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("rows"))


def references(runs: DataFrame) -> DataFrame:
    """run_id, position, r of every reference of runs (run_id, references, legacy: arrays of struct(kind, id, url,
    geometry_type, format, name)): the newer list where it has entries, else the older."""
    empty = F.array().cast(runs.schema["references"].dataType)
    refs = F.when(F.size(F.coalesce("references", empty)) > 0, F.col("references")).otherwise(F.col("legacy"))
    return runs.select("run_id", F.posexplode(refs).alias("position", "r"))


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """The first reference of each run and key: a combinable minimum."""
    first = rows.groupBy("run_id", key).agg(F.min_by("r", "position").alias("r"), F.min("position").alias("position"))
    return first


def result_refs(runs: DataFrame) -> DataFrame:
    """run_id, layer_id, kind, name, position of the result layers, the first of each id: kind is raster where the
    geometry type says so, else vector; a layer without a name has its id."""
    rows = references(runs).filter((F.lower("r.kind") == "layer") & (F.coalesce("r.id", F.lit("")) != ""))
    first = _first_of(rows.withColumn("layer_id", F.col("r.id")), "layer_id")
    kind = F.when(F.lower("r.geometry_type") == "raster", "raster").otherwise("vector")
    return first.select("run_id", "layer_id", kind.alias("kind"), F.coalesce(F.nullif("r.name", F.lit("")), "layer_id").alias("name"), "position")


#: Formats of artifacts that hold GeoJSON.
_GEOJSON = ["geojson", "json", "geo+json"]


def artifact_fallback(runs: DataFrame) -> DataFrame:
    """run_id, url, name of the GeoJSON artifacts, each url once, of runs that made no layer: by format, and by url where
    no format is given."""
    form = F.lower(F.coalesce("r.format", F.lit("")))
    geojson = form.isin(_GEOJSON) | ((form == "") & F.lower("r.url").contains("geojson"))
    rows = references(runs).filter((F.lower("r.kind") == "artifact") & (F.coalesce("r.url", F.lit("")) != "") & geojson)
    found = _first_of(rows.withColumn("url", F.col("r.url")), "url").join(result_refs(runs).select("run_id").distinct(), "run_id", "left_anti")
    return found.select("run_id", "url", F.coalesce(F.nullif("r.name", F.lit("")), F.nullif("r.id", F.lit("")), F.lit("result")).alias("name"))


def drawings_from_runs(runs: DataFrame) -> DataFrame:
    """The features of the drawings in each run's steps (run_id, steps: array of collection text or NULL)."""
    steps = runs.select("run_id", F.posexplode("steps").alias("step", "text")).filter("text is not null")
    return exploded(steps)


def truncation_audit(collections: DataFrame) -> DataFrame:
    """name, returned_count, total_count, missing of the collections that say they were truncated (truncated, and the
    counts where they are known: missing is NULL where one isn't)."""
    told = (F.col("total_count") > 0) & F.col("returned_count").isNotNull()
    missing = F.when(told, F.col("total_count") - F.col("returned_count"))
    return collections.filter(F.coalesce("truncated", F.lit(False))).select("name", "returned_count", "total_count", missing.alias("missing"))
