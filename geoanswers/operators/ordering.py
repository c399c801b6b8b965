"""Global order without a global task: places, running sums and exact quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoanswers.sources.tables import stored

#: Distinct values that one task may sort; accuracy of the approximate percentiles that narrow more values down to so many.
FEW, ACCURACY = 1_000_000, 10_000


def placed(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """df (stored) with a global ``place`` from 1 in this order, and for each name in ``sums`` the sum of its column over
    the rows before. Rows are range-sorted; places and sums go by range, and one row a range is summed in one task."""
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(ordered, tag)
    by_range, zero = Window.partitionBy("_part").orderBy("_at"), F.lit(0)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.withColumn("_place", F.row_number().over(by_range))
    for name, value in sums.items():
        inside = inside.withColumn(f"_in_{name}", F.coalesce(F.sum(value).over(before), zero))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = [("_n", "_b"), *[(f"_t_{n}", f"_b_{n}") for n in sums]]
    bases = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(earlier), zero).alias(b) for c, b in totals])
    both = inside.join(F.broadcast(bases), F.col("_part") == F.col("_p")).withColumn("place", (F.col("_place") + F.col("_b")).cast("long"))
    for name in sums:
        both = both.withColumn(name, F.col(f"_in_{name}") + F.col(f"_b_{name}"))
    return both.drop("_part", "_at", "_place", "_p", "_b", *[x for n in sums for x in (f"_in_{n}", f"_b_{n}")])


def _between(low: float, high: float, part: float) -> float:
    return low + (high - low) * part if low != high else low


def quantiles(df: DataFrame, value: Column, parts: list[float]) -> list[float | None]:
    """Exact quantiles (interpolated between neighbours) of the values that are not NULL, on the driver.

    Approximate percentiles, whose buffers are small and combine, bracket each wanted rank; brackets are narrowed until they
    hold few enough values, and only those are counted by value and put in order. No task holds all distinct values."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return [None] * len(parts)
    ranks = [(math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in parts]
    v, inf = F.col("v"), float("inf")
    brackets = [(-inf, inf, 0, n)] * len(parts)  # lowest and highest value, rows below, rows inside
    while any(x[3] > FEW for x in brackets):
        edges = []
        for (low, high, below, inside), rank in zip(brackets, ranks):
            near = [(rank[0] - below) / inside - 2 / ACCURACY, (rank[1] - below) / inside + 2 / ACCURACY]
            at = [min(1.0, max(0.0, x)) for x in near]
            edges.append(F.percentile_approx(F.when(v.between(low, high), v), at, ACCURACY))
        found = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(edges)]).first()
        narrow = [tuple(found[f"e{i}"]) for i in range(len(parts))]
        counted = rows.agg(*[F.count_if(v < lo).alias(f"b{i}") for i, (lo, _) in enumerate(narrow)], *[F.count_if(v.between(lo, hi)).alias(f"n{i}") for i, (lo, hi) in enumerate(narrow)]).first()
        new = []
        for i, (old, (lo, hi), rank) in enumerate(zip(brackets, narrow, ranks)):
            below, inside = counted[f"b{i}"], counted[f"n{i}"]
            held = below <= rank[0] and rank[1] < below + inside
            new.append((lo, hi, below, inside) if held else old)
        if new == brackets:
            break  # few distinct values: they are counted, not listed
        brackets = new
    known = {x for x in brackets}
    pick = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(below).cast("long").alias("below")) for lo, hi, below, _ in known])
    inside = rows.groupBy("v").count().select("v", "count", F.explode(F.filter(pick, lambda b: v.between(b["lo"], b["hi"]))).alias("b"))
    upto = F.sum("count").over(Window.partitionBy("b").orderBy("v")) + F.col("b.below")
    wanted = sorted({r for pair in ranks for r in pair})
    listed = F.array(*[F.lit(r).cast("long") for r in wanted])
    hits = inside.select("v", "b", "count", upto.alias("upto")).select("v", "b", F.explode(F.filter(listed, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("count")))).alias("rank"))
    at = {r["rank"]: r["v"] for r in hits.collect()}
    return [_between(at[lo], at[hi], p * (n - 1) - lo) for p, (lo, hi) in zip(parts, ranks)]


def group_medians(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """group, value: the exact median of each group. Values are counted by group and put in one global order, so a group of
    any size is spread over tasks."""
    counts = df.select(group.alias("group"), value.cast("double").alias("v")).filter("v is not null").groupBy("group", "v").count()
    line = placed(counts, [F.col("group"), F.col("v")], {"before": F.col("count")}, "medians")
    whole = stored(line.groupBy("group").agg(F.min("before").alias("start"), F.sum("count").alias("n")), "groups")
    whole = whole.withColumnRenamed("group", "_g")
    at = line.join(whole, F.col("group").eqNullSafe(F.col("_g"))).withColumn("first", F.col("before") - F.col("start"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    holds = lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("count"))
    return at.groupBy("group").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("value"))
