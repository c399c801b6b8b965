"""Rankings and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoanswers.functions.values import number
from geoanswers.meta import Refused, need_columns
from geoanswers.operators.ordering import quantiles

LEAST_VALUES = 4


def top_n(df: DataFrame, field: str, n: int = 10, ascending: bool = False, id_col: str = "id", label: str | None = None) -> DataFrame:
    """id, value: the n largest (or smallest), ties by id."""
    need_columns(df, field, id_col)
    v = number(F.col(field)).alias("value")
    columns = [F.col(id_col).alias("id"), v, *([F.col(label).alias("label")] if label else [])]
    return df.select(*columns).filter("value is not null").orderBy(F.asc("value") if ascending else F.desc("value"), "id").limit(n)


def fences(df: DataFrame, field: str, method: str) -> DataFrame:
    """One row: low, high, considered; bounds are NULL where fewer than four values are usable or none spreads."""
    v = number(F.col(field))
    if method == "iqr":
        first, third = (F.lit(x).cast("double") for x in quantiles(df, v, [0.25, 0.75]))
        q = df.agg(F.count(v).alias("considered"))
        low, high = first - 1.5 * (third - first), third + 1.5 * (third - first)
    elif method == "zscore":
        q = df.agg(F.avg(v).alias("m"), F.nullif(F.stddev_pop(v), F.lit(0.0)).alias("s"), F.count(v).alias("considered"))
        low, high = F.col("m") - 3 * F.col("s"), F.col("m") + 3 * F.col("s")
    else:
        raise Refused(f"unknown method: {method}")
    enough = F.col("considered") >= LEAST_VALUES
    return q.select(F.when(enough, low).alias("low"), F.when(enough, high).alias("high"), "considered")


def outliers(df: DataFrame, field: str, method: str = "iqr", id_col: str = "id") -> DataFrame:
    """id, value, low, high, considered of the values strictly outside the fences (one broadcast row)."""
    need_columns(df, field, id_col)
    rows = df.select(F.col(id_col).alias("id"), number(F.col(field)).alias("value"))
    return rows.join(F.broadcast(fences(df, field, method))).filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def reason(df: DataFrame, field: str) -> Column:
    """Why no outliers can be told: not_enough_values."""
    return F.when(F.count(number(F.col(field))) < LEAST_VALUES, "not_enough_values")
