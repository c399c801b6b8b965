"""Which rows and columns: reads, filters, selections, viewports, calculated fields, set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions.values import coerced
from geoanswers.meta import Refused, need_columns

_BINARY = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "like": "like"}


def read_columns(df: DataFrame, columns: list[str], id_col: str = "id", cap: int | None = None) -> DataFrame:
    """id and the named columns; with a cap, a ``truncated`` column says whether rows are left out."""
    need_columns(df, id_col, *columns)
    out = df.select(F.col(id_col).alias("id"), *columns)
    if cap is None:
        return out
    more = out.limit(cap + 1).count() > cap
    return out.orderBy("id").limit(cap).withColumn("truncated", F.lit(more))


def _literal(value: str, kind: T.DataType) -> Column:
    """The value in the field's type; one that is none of that type is refused before a job starts."""
    try:
        if isinstance(kind, T.IntegralType):
            int(value)
        elif isinstance(kind, T.NumericType):
            float(value)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            datetime.datetime.fromisoformat(value.strip())
        elif isinstance(kind, T.BooleanType) and value.strip().lower() not in ("true", "false"):
            raise ValueError
    except ValueError:
        raise Refused(f"{value!r} is no {kind.simpleString()}") from None
    return F.lit(value).try_cast(kind)


def typed_filter(df: DataFrame, field: str, operator: str, value: str | None = None) -> DataFrame:
    """Rows for which the field stands in the operator to the value, which is cast to the field's type."""
    need_columns(df, field)
    c, kind = F.col(field), df.schema[field].dataType
    if operator == "is null":
        return df.filter(c.isNull())
    if operator == "is not null":
        return df.filter(c.isNotNull())
    if operator == "in":
        values = [v.strip() for v in (value or "").split(",") if v.strip()]
        if not values:
            raise Refused("an empty list")
        return df.filter(c.isin(*[_literal(v, kind) for v in values]))
    if operator not in _BINARY or value is None:
        raise Refused(f"unknown operator: {operator}")
    return df.filter(getattr(c, _BINARY[operator])(value if operator == "like" else _literal(value, kind)))


def select_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ids.id; what is no integer there is ignored."""
    wanted = ids.select(F.col("id").try_cast("long").alias("_id")).filter("_id is not null")
    return df.join(wanted, df[id_col] == wanted["_id"], "left_semi")


def selection_report(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return select_ids(df, ids, id_col).agg(F.count("*").alias("selected")).join(ids.select(F.col("id").try_cast("long").alias("id")).filter("id is not null").agg(F.countDistinct("id").alias("requested")))


def select_all(df: DataFrame) -> DataFrame:
    return df


def select_none(df: DataFrame) -> DataFrame:
    return df.limit(0)


def select_invert(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    wanted = ids.select(F.col("id").try_cast("long").alias("_id")).filter("_id is not null")
    return df.join(wanted, df[id_col] == wanted["_id"], "left_anti")


def scope_selection(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Only the selection; an empty one is refused."""
    if ids.isEmpty():
        raise Refused("the selection is empty")
    return select_ids(df, ids, id_col)


def scope_viewport(df: DataFrame, box: tuple[float, float, float, float], x0: str = "xmin", y0: str = "ymin", x1: str = "xmax", y1: str = "ymax") -> DataFrame:
    """Rows whose bounding box meets the rectangle: range predicates that reach the scan."""
    need_columns(df, x0, y0, x1, y1)
    return df.filter((F.col(x0) <= box[2]) & (F.col(x1) >= box[0]) & (F.col(y0) <= box[3]) & (F.col(y1) >= box[1]))


def calc_field(df: DataFrame, name: str, expression: Column, kind: str = "number") -> DataFrame:
    """A new column; rows that can't be calculated become NULL. No column is overwritten, whatever its case."""
    if not name or len(name) > 60 or name.lower() in {c.lower() for c in df.columns}:
        raise Refused(f"can't add a field {name!r}")
    return df.withColumn(name, coerced(expression, kind))


def calc_problem(expression: Column, kind: str) -> Column:
    """Why a row's value can't be stored, NULL where it can: not a number, or not a finite one. NULL is no problem."""
    if kind == "text":
        return F.lit(None).cast("string")
    v = expression.try_cast("double")
    endless = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    odd = F.concat(F.lit("'"), F.substring(expression.cast("string"), 1, 40), F.lit("' is not a number"))
    return F.when(expression.isNull(), F.lit(None)).when(v.isNull(), odd).when(endless, "a value was not a finite number")


def _first_five(rows: DataFrame, order: str, value: str, n: int) -> DataFrame:
    """The first n values by ``order`` in one line: at most n rows are gathered."""
    first = rows.orderBy(order).limit(n)
    return first.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda s: s["v"]).alias(value))


def calc_preview(df: DataFrame, expression: Column, kind: str = "number", order: str = "id") -> DataFrame:
    """One row, of the same values as the new column would have: rows, nulls, the first five values by ``order`` (sample),
    rows that could not be stored (bad) and the first three reasons (problems)."""
    out = calc_field(df, "_value", expression, kind).withColumn("_problem", calc_problem(expression, kind))
    bad = F.col("_problem").isNotNull()
    whole = out.agg(F.count("*").alias("rows"), F.count_if(F.col("_value").isNull()).alias("nulls"), F.count_if(bad).alias("bad"))
    sample = _first_five(out.filter("_value is not null"), order, "_value", 5)
    problems = _first_five(out.filter(bad), order, "_problem", 3)
    both = whole.crossJoin(F.broadcast(sample)).crossJoin(F.broadcast(problems))
    return both.select("rows", "nulls", F.array_join("_value", ",").alias("sample"), "bad", F.array_join("_problem", "; ").alias("problems"))


def merge_layers(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def dedupe_sources(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing and incoming rows, first arrival of each key; keyless rows are left out. ``repeats`` counts the later ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).filter(F.col(key).isNotNull())
    w = Window.partitionBy(key)
    ranked = both.withColumn("_rn", F.row_number().over(w.orderBy("_new", order))).withColumn("repeats", F.count("*").over(w) - 1)
    return ranked.filter("_rn = 1").drop("_rn", "_new")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in other: completed items, imported layers, removed sources, missing files."""
    return df.join(other.select(F.col(key).alias("_key")), df[key] == F.col("_key"), "left_anti")
