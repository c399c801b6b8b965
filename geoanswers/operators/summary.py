"""Summaries of attributes: numbers, categories, bins, groups, comparisons, profiles, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoanswers.functions.values import is_blank, not_finite, number
from geoanswers.meta import LayerMeta, Refused, need_columns
from geoanswers.operators.ordering import group_medians, placed, quantiles

_STATISTICS = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": None}


def numeric_summary(df: DataFrame, field: str) -> DataFrame:
    """One row: count, usable, nulls (what is not usable), not_finite (of those, NaN and infinities), sum, mean, median,
    quartiles, min, max, stddev of the finite values that parse."""
    need_columns(df, field)
    v = number(F.col(field))
    q = quantiles(df, v, [0.25, 0.5, 0.75])
    out = df.agg(
        F.count("*").alias("count"), F.count(v).alias("usable"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.stddev_samp(v).alias("stddev"), F.count_if(not_finite(F.col(field))).alias("not_finite"),
    )
    quarters = [F.lit(x).cast("double").alias(n) for x, n in zip(q, ("q1", "median", "q3"))]
    return out.select("count", "usable", (F.col("count") - F.col("usable")).alias("nulls"), "not_finite", "sum", "mean", "min", "max", "stddev", *quarters)


def categories(df: DataFrame, field: str, limit: int = 25) -> DataFrame:
    """value, count, percent of usable, distinct, nulls, blanks, truncated of the commonest values."""
    need_columns(df, field)
    c = F.col(field).cast("string")
    counted = df.groupBy(c.alias("value")).agg(F.count("*").alias("count"))
    blank = is_blank(F.col("value"))
    whole = counted.agg(F.sum(F.when(~blank, F.col("count"))).alias("usable"), F.count_if(~blank).alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(blank & F.col("value").isNotNull(), F.col("count"))), F.lit(0)).alias("blanks"))
    top = counted.filter(~blank).orderBy(F.desc("count"), "value").limit(limit)
    return top.join(F.broadcast(whole)).select("value", "count", (100 * F.col("count") / F.col("usable")).alias("percent"), "distinct", "nulls", "blanks", (F.col("distinct") > limit).alias("truncated"))


def bounds(df: DataFrame, field: str) -> DataFrame:
    v = number(F.col(field))
    return df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))


def histogram(df: DataFrame, field: str, bins: int = 12) -> DataFrame:
    """bin, min, max, count: equal widths, half open, the last closed; a constant column has one bin."""
    need_columns(df, field)
    v = number(F.col(field))
    edge = F.broadcast(bounds(df, field))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counted = df.select(v.alias("v")).filter("v is not null").join(edge).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = edge.filter("_lo is not null").select("_lo", "_hi", F.explode(F.when(F.col("_hi") == F.col("_lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    out = every.join(counted, "bin", "left")
    top = F.when((F.col("_hi") == F.col("_lo")) | (F.col("bin") == bins - 1), F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * width)
    return out.select("bin", (F.col("_lo") + F.col("bin") * width).alias("min"), top.alias("max"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def group_aggregate(df: DataFrame, group: str, value: str | None = None, statistic: str = "count") -> DataFrame:
    """group, features, usable, skipped, value: a statistic a group; NULL and blank groups are one row of their own."""
    need_columns(df, group, *([value] if value else []))
    if statistic not in _STATISTICS:
        raise Refused(f"unknown statistic: {statistic}")
    g = F.when(~is_blank(F.col(group)), F.col(group))
    v = number(F.col(value)) if value else F.lit(1.0)
    counts = [F.count("*").alias("features"), F.count(v).alias("usable")]
    if statistic == "median":
        medians = group_medians(df, g, v).withColumnRenamed("group", "_g")
        out = df.groupBy(g.alias("group")).agg(*counts)
        out = out.join(medians, F.col("group").eqNullSafe(F.col("_g")), "left").drop("_g")
    else:
        out = df.groupBy(g.alias("group")).agg(*counts, _STATISTICS[statistic](v).alias("value"))
    return out.select("group", "features", "usable", (F.col("features") - F.col("usable")).alias("skipped"), "value")


def compare(df: DataFrame, field: str, subset: Column) -> DataFrame:
    """One row from one pass: the subset's summary, the whole's, and the difference of means."""
    need_columns(df, field)
    v = number(F.col(field))
    part = F.when(subset, v)
    out = df.agg(F.count(part).alias("subset_usable"), F.avg(part).alias("subset_mean"), F.min(part).alias("subset_min"), F.max(part).alias("subset_max"), F.count(v).alias("whole_usable"), F.avg(v).alias("whole_mean"), F.min(v).alias("whole_min"), F.max(v).alias("whole_max"))
    delta = F.col("subset_mean") - F.col("whole_mean")
    return out.withColumn("mean_delta", delta).withColumn("mean_delta_percent", F.try_divide(100 * delta, F.col("whole_mean")))


def field_profile(df: DataFrame) -> DataFrame:
    """field, type, nulls, blanks, distinct (as text, without blanks), numeric (half of the filled values parse).

    Fields become rows (field, text), equal ones are counted before the one shuffle, and counts are summed by field."""
    texts = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{name}`").cast("string").alias("text")) for i, name in enumerate(df.columns)])
    counted = df.select(F.explode(texts).alias("x")).groupBy("x.i", "x.text").agg(F.count("*").alias("n"))
    text, n = F.col("text"), F.col("n")
    filled = ~is_blank(text)
    some = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias
    out = counted.groupBy("i").agg(
        some(text.isNull())("nulls"), some(text.isNotNull() & ~filled)("blanks"), F.count_if(filled).alias("distinct"), some(filled)("filled"),
        some(filled & number(text).isNotNull())("parsed"),
    )
    # a field of an empty table has no rows
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("field"), F.lit(kind).alias("type")) for i, (name, kind) in enumerate(df.dtypes)])
    fields = df.sparkSession.range(1).select(F.inline(names))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    numeric = F.coalesce((F.col("filled") > 0) & (2 * F.col("parsed") >= F.col("filled")), F.lit(False))
    return fields.join(out, "i", "left").select("field", "type", zero("nulls"), zero("blanks"), zero("distinct"), numeric.alias("numeric"))


def layer_profile(df: DataFrame, name: str, meta: LayerMeta, box: tuple[str, str, str, str] | None = None) -> DataFrame:
    """One row: name, crs, geographic, features, fields, extent."""
    extent = [F.lit(None).cast("double")] * 4 if box is None else [F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])]
    corners = [e.alias(n) for e, n in zip(extent, ("xmin", "ymin", "xmax", "ymax"))]
    said = [F.lit(name).alias("name"), F.lit(meta.crs).cast("string").alias("crs"), F.lit(meta.geographic).alias("geographic")]
    one = df.agg(F.count("*").alias("features"), *corners)
    return one.select(*said, "features", F.lit(len(df.columns)).alias("fields"), "xmin", "ymin", "xmax", "ymax")


def raster_profile(cells: DataFrame, placed: Column, raster: str = "raster_id") -> DataFrame:
    """raster, width, height, bands, georeferenced of rasters given as cells (raster, band, row, col); ``placed``: whether a
    cell's raster has a CRS and an extent."""
    return cells.groupBy(raster).agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), F.max("band").alias("bands"),
        F.coalesce(F.bool_or(placed), F.lit(False)).alias("georeferenced"),
    )


def profile(df: DataFrame, name: str, meta: LayerMeta) -> DataFrame:
    """The field profile with the layer's count and CRS on each row."""
    whole = layer_profile(df, name, meta).select("name", "crs", "features")
    return field_profile(df).join(F.broadcast(whole))


def class_breaks(df: DataFrame, field: str, classes: int = 5, method: str = "quantile") -> DataFrame:
    """class, min, max: equal breaks collapse. Methods: quantile, equal_interval, std_dev."""
    need_columns(df, field)
    v = number(F.col(field))
    if method == "quantile":
        edges = F.array(*[F.lit(x).cast("double") for x in quantiles(df, v, [i / classes for i in range(classes + 1)])])
        edges = F.when(F.count(v) > 0, edges)
    elif method == "equal_interval":
        edges = F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.min(v) + i * (F.max(v) - F.min(v)) / classes)
    elif method == "std_dev":
        edges = F.concat(F.array(F.min(v)), F.filter(F.array(*[F.avg(v) + k * F.stddev_pop(v) for k in (-2, -1, 0, 1, 2)]), lambda x: (x > F.min(v)) & (x < F.max(v))), F.array(F.max(v)))
    else:
        raise Refused(f"unknown method: {method}")
    one = df.agg(F.array_distinct(edges).alias("e"))
    return one.select("e", F.posexplode("e")).filter(F.col("pos") < F.greatest(F.size("e") - 1, F.lit(1))).select((F.col("pos") + 1).alias("class"), F.col("col").alias("min"), F.coalesce(F.get("e", F.col("pos") + 1), F.col("col")).alias("max"))


def class_assign(df: DataFrame, field: str, classes: int = 5, method: str = "quantile") -> DataFrame:
    """class, min, max, features: values a class, half open, the last closed."""
    breaks = class_breaks(df, field, classes, method)
    edges = breaks.agg(F.sort_array(F.collect_list("min")).alias("lows"))
    v = number(F.col(field))
    counted = df.select(v.alias("v")).filter("v is not null").join(F.broadcast(edges)).groupBy(F.size(F.filter("lows", lambda e: e <= F.col("v"))).alias("class")).agg(F.count("*").alias("features"))
    return breaks.join(counted, "class", "left").select("class", "min", "max", F.coalesce("features", F.lit(0)).cast("long").alias("features"))


def choropleth(df: DataFrame, group: str, value: str, statistic: str = "sum") -> DataFrame:
    """rank, group, value: measured groups, largest first."""
    ranked = placed(group_aggregate(df, group, value, statistic), [F.desc("value"), F.col("group").asc_nulls_last()], {}, "ranks")
    return ranked.select(F.col("place").cast("int").alias("rank"), "group", "features", "value")
