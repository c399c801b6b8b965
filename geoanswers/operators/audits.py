"""Audits of many layers: what their coordinates and registry entries contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoanswers import meta

#: Severity by finding, worst first.
SEVERITY = {"no_crs": 1, "unplaced_raster": 2, "service_backdrop": 3, "empty_layer": 4, "ready": 5}


def extents(vertices: DataFrame, key: str = "layer_id") -> DataFrame:
    return vertices.groupBy(key).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.count("*").alias("vertices"))


def crs_diagnose(vertices: DataFrame, layers: DataFrame) -> DataFrame:
    """layer_id, finding: contradictions between a layer's coordinates and its declared CRS; none, no row. Layers have
    (layer_id, geographic, unit and, where known, area of use west, south, east, north)."""
    e = extents(vertices).join(layers, "layer_id")
    off_earth = (F.col("xmin") < -180) | (F.col("xmax") > 180) | (F.col("ymin") < -90) | (F.col("ymax") > 90)
    degrees_like = (F.col("xmin") >= -180) & (F.col("xmax") <= 180) & (F.col("ymin") >= -90) & (F.col("ymax") <= 90)
    outside = (F.col("xmax") < F.col("west")) | (F.col("xmin") > F.col("east")) | (F.col("ymax") < F.col("south")) | (F.col("ymin") > F.col("north"))
    found = F.array_compact(F.array(F.when(F.col("geographic") & off_earth, "not_degrees"), F.when(~F.col("geographic") & degrees_like, "looks_like_degrees"), F.when(outside, "outside_area_of_use")))
    return e.select("layer_id", F.explode(found).alias("finding"))


def crs_mismatch(layers: DataFrame, project: str = "project", project_crs: str = "project_crs") -> DataFrame:
    """project, count and the first three names of its layers in another CRS. Names are counted first, ranked within 64
    hash parts of a project and then among the three of each part: no project is one large group."""
    odd = layers.filter(F.col("crs").isNotNull() & (F.col("crs") != F.col(project_crs)))
    names = odd.groupBy(project, "name").agg(F.count("*").alias("n")).withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(64)))
    by_part = Window.partitionBy(project, "_part").orderBy("name")
    first = names.withColumn("_rank", F.row_number().over(by_part)).filter("_rank <= 3")
    gathered = first.groupBy(project).agg(F.slice(F.sort_array(F.collect_list("name")), 1, 3).alias("names"))
    counts = names.groupBy(project).agg(F.sum("n").alias("count"))
    return counts.join(gathered, project).select(project, "count", F.array_join("names", ",").alias("names"))


def project_profile(layers: DataFrame, project: str = "project") -> DataFrame:
    """project, layer, crs: every layer with its CRS, "" where it has none."""
    return layers.select(project, F.col("name").alias("layer"), F.coalesce("crs", F.lit("")).alias("crs"))


def metric_plan(layers: DataFrame) -> DataFrame:
    """layer_id, plan, area_frame, crs of layers (layer_id, geographic, unit, xmin, ymin, xmax, ymax): how a length in metres
    and an area apply to each, as ``meta.metric_plan`` and ``meta.area_frame`` say for one; refused where neither does."""
    zone = meta.utm_zone_column(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    known = F.col("unit").isin(list(meta.UNITS))
    zone = F.when(F.col("geographic"), zone)
    plan = F.when(~F.col("geographic") & known, "map_units").when(zone.isNotNull(), "reproject").otherwise("refused")
    area = F.when(~F.col("geographic"), F.when(known, "map_units").otherwise("unsupported")).when(zone.isNotNull(), "project").otherwise("ellipsoidal")
    return layers.select("layer_id", plan.alias("plan"), area.alias("area_frame"), zone.alias("crs"))


def georeferenced(crs: Column, width: Column, height: Column) -> Column:
    """A CRS and an extent that is not empty."""
    return F.coalesce(crs.isNotNull() & (width > 0) & (height > 0), F.lit(False))


def layer_readiness(layers: DataFrame) -> DataFrame:
    """layer_id, finding, severity: the worst of each layer (kind, crs, features, width, height, service)."""
    raster = F.col("kind") == "raster"
    finding = F.when(F.col("service"), "service_backdrop").when(raster & ~georeferenced(F.col("crs"), F.col("width"), F.col("height")), "unplaced_raster").when(F.col("crs").isNull(), "no_crs").when(~raster & (F.col("features") == 0), "empty_layer").otherwise("ready")
    rank = F.coalesce(*[F.when(F.col("finding") == k, v) for k, v in SEVERITY.items()])
    return layers.select("layer_id", finding.alias("finding")).withColumn("severity", rank)


def catalog_diagnostics(catalog: DataFrame) -> DataFrame:
    """finding, tables: geometry tables without an index, with an undeclared SRID, never analysed (estimate below 0)."""
    found = F.array_compact(F.array(F.when(F.col("spatial_indexes") == 0, "no_spatial_index"), F.when(F.coalesce("srid", F.lit(0)) == 0, "undeclared_srid"), F.when(F.coalesce("row_estimate", F.lit(-1)) < 0, "never_analysed")))
    sound = catalog.filter("table is not null and geometry_column is not null")
    return sound.select(F.explode(found).alias("finding")).groupBy("finding").agg(F.count("*").alias("tables"))
