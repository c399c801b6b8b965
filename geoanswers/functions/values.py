"""Column expressions for blanks, numbers, nested values, file kinds and cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.meta import Refused

#: Extensions that are read as vectors and as rasters.
VECTOR = ["gpkg", "geojson", "json", "shp"]
RASTER = ["tif", "tiff", "jpg", "jpeg", "png", "pdf"]


def is_blank(c: Column) -> Column:
    """NULL or white space only; zero and unparseable words are not blank."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def number(c: Column) -> Column:
    """The finite number that a value or text holds, else NULL: NaN and infinities are no numbers to count with."""
    v = c.try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def not_finite(c: Column) -> Column:
    """NaN or an infinity, as a value or as text."""
    v = c.try_cast("double")
    return v.isNotNull() & ~(F.abs(v) < F.lit(float("inf")))


def coerced(c: Column, kind: str) -> Column:
    """A calculated value as number, integer (towards zero) or text; infinities and NaN become NULL."""
    if kind == "text":
        whole = (c.try_cast("double") == F.floor(c.try_cast("double"))) & (F.abs(c.try_cast("double")) < 1e15)
        return F.when(whole, c.try_cast("double").cast("long").cast("string")).otherwise(c.cast("string"))
    finite = number(c)
    if kind == "number":
        return finite
    if kind == "integer":
        return F.when(finite >= 0, F.floor(finite)).otherwise(F.ceil(finite)).cast("long")
    raise Refused(f"unknown kind: {kind}")


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def nested_as_text(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text; NULL stays NULL, text is untouched."""
    nested = nested_columns(df)
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def data_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(VECTOR), "vector").when(ext.isin(RASTER), "raster").otherwise("unknown")


def cents_text(c: Column) -> Column:
    """Integer cents as text; unknown stays NULL."""
    size = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.expr("'$'"), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
