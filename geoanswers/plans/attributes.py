"""Queries over attributes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.functions import values
from geoanswers.meta import LayerMeta
from geoanswers.operators import audits, rank, scope, summary
from geoanswers.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with holes: a NULL flag for R, a blank one for every 11th part; quantities of 7 are NULL."""
    flag = F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.expr("nullif(l_returnflag, 'R')"))
    return table(spark, d, "lineitem").withColumn("flag", flag).withColumn("qty", F.expr("nullif(l_quantity, 7.0)"))


def _odd(df: DataFrame, field: str, key: str, text: bool = False) -> DataFrame:
    """Every 17th key's number is NaN, an infinity or its negative; ``text``: the numbers stand as text."""
    k = F.col(key)
    odd = F.when(k % 3 == 0, float("nan")).when(k % 3 == 1, float("inf")).otherwise(float("-inf"))
    v = F.when(k % 17 == 0, odd).otherwise(F.col(field))
    return df.withColumn(field, v.cast("string") if text else v)


_HOLES = "(SELECT *, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE nullif(l_returnflag, 'R') END AS flag, nullif(l_quantity, 7.0) AS qty FROM lineitem)"
#: The same with numbers that are none in every 17th row; SQL holds them as NULL, or leaves the rows out.
_ODD_HOLES = f"(SELECT * REPLACE (CASE WHEN l_partkey % 17 <> 0 THEN qty END AS qty) FROM {_HOLES})"
_EVENTS, _ORDERS = "(SELECT * FROM events WHERE event_id % 17 <> 0)", "(SELECT * FROM orders WHERE o_orderkey % 17 <> 0)"


@query("read_columns", "SELECT o_orderkey AS id, o_totalprice, o_orderstatus FROM orders")
def _read(spark, d):
    return scope.read_columns(table(spark, d, "orders"), ["o_totalprice", "o_orderstatus"], "o_orderkey")


_NUMERIC = """SELECT count(*) AS count, count(v) AS usable, count(*) - count(v) AS nulls, count_if(odd) AS not_finite, round(sum(v), 4) AS sum, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(stddev_samp(v), 4) AS stddev,
round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3 FROM ({})"""


@query("numeric_summary", _NUMERIC.format(f"SELECT qty AS v, l_partkey % 17 = 0 AS odd FROM {_ODD_HOLES}"))
def _numeric(spark, d):
    return rounded(summary.numeric_summary(_odd(_items(spark, d), "qty", "l_partkey"), "qty"))


@query("table_numeric", _NUMERIC.format("SELECT CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS v, o_orderkey % 17 = 0 AS odd FROM orders WHERE o_custkey % 3 <> 0"))
def _table_numeric(spark, d):
    return rounded(summary.numeric_summary(_odd(table(spark, d, "orders"), "o_totalprice", "o_orderkey", text=True).filter("o_custkey % 3 <> 0"), "o_totalprice"))


_CATEGORIES = """WITH t AS (SELECT {c} AS value, count(*) AS count FROM {t} GROUP BY 1),
w AS (SELECT CAST(sum(CASE WHEN trim(value) <> '' THEN count END) AS BIGINT) AS usable, count_if(trim(value) <> '') AS distinct_, CAST(coalesce(sum(CASE WHEN value IS NULL THEN count END), 0) AS BIGINT) AS nulls, CAST(coalesce(sum(CASE WHEN trim(value) = '' THEN count END), 0) AS BIGINT) AS blanks FROM t)
SELECT value, count, round(100.0 * count / usable, 4) AS percent, CAST(distinct_ AS BIGINT) AS "distinct", nulls, blanks, distinct_ > {n} AS truncated FROM t, w WHERE trim(value) <> '' ORDER BY count DESC, value LIMIT {n}"""


@query("categories", _CATEGORIES.format(c="flag", t=_HOLES, n=25))
def _categories(spark, d):
    return rounded(summary.categories(_items(spark, d), "flag"))


@query("table_categories", _CATEGORIES.format(c="p_brand", t="part", n=10))
def _table_categories(spark, d):
    return rounded(summary.categories(table(spark, d, "part"), "p_brand", 10))


@query("histogram", f"""WITH v AS (SELECT value AS v FROM {_EVENTS}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS count FROM v, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 12), 4) AS min, round(CASE WHEN b.bin = 11 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 12) END, 4) AS max, coalesce(c.count, 0) AS count
FROM e, (SELECT CAST(range AS INTEGER) AS bin FROM range(12)) b LEFT JOIN c ON b.bin = c.bin""")  # fmt: skip
def _histogram(spark, d):
    return rounded(summary.histogram(_odd(table(spark, d, "events"), "value", "event_id"), "value"))


_GROUP = """SELECT CASE WHEN trim({g}) <> '' THEN {g} END AS "group", count(*) AS features, count({v}) AS usable, count(*) - count({v}) AS skipped, round({s}, 4) AS value FROM {t} GROUP BY 1"""


@query("group_aggregate", _GROUP.format(g="flag", v="qty", s="avg(qty)", t=_ODD_HOLES))
def _group(spark, d):
    return rounded(summary.group_aggregate(_odd(_items(spark, d), "qty", "l_partkey"), "flag", "qty", "mean"))


@query("table_group", _GROUP.format(g="o_orderpriority", v="o_totalprice", s="sum(o_totalprice)", t="orders"))
def _table_group(spark, d):
    return rounded(summary.group_aggregate(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "sum"))


@query("group_median", _GROUP.format(g="flag", v="l_extendedprice", s="median(l_extendedprice)", t=_HOLES))
def _group_median(spark, d):
    return rounded(summary.group_aggregate(_items(spark, d), "flag", "l_extendedprice", "median"))


@query("compare", """SELECT *, round(subset_mean_ - whole_mean_, 4) AS mean_delta, round(100 * (subset_mean_ - whole_mean_) / whole_mean_, 4) AS mean_delta_percent FROM (
SELECT count(qty) FILTER (l_shipdate >= '2000-01-01') AS subset_usable, avg(qty) FILTER (l_shipdate >= '2000-01-01') AS subset_mean_, min(qty) FILTER (l_shipdate >= '2000-01-01') AS subset_min, max(qty) FILTER (l_shipdate >= '2000-01-01') AS subset_max,
count(qty) AS whole_usable, avg(qty) AS whole_mean_, min(qty) AS whole_min, max(qty) AS whole_max FROM """ + _ODD_HOLES + ")")  # fmt: skip
def _compare(spark, d):
    return rounded(summary.compare(_odd(_items(spark, d), "qty", "l_partkey"), "qty", F.col("l_shipdate") >= "2000-01-01"))


ORACLES["compare"] = "SELECT subset_usable, round(subset_mean_, 4) AS subset_mean, subset_min, subset_max, whole_usable, round(whole_mean_, 4) AS whole_mean, whole_min, whole_max, mean_delta, mean_delta_percent FROM (" + ORACLES["compare"] + ")"


def _profile_sql(columns: list[tuple[str, str]], source: str) -> str:
    one = "SELECT '{c}' AS field, '{t}' AS type, count_if({c} IS NULL) AS nulls, count_if({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) = '') AS blanks, count(DISTINCT CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN CAST({c} AS VARCHAR) END) AS \"distinct\", coalesce(count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') > 0 AND 2 * count(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)) FILTER (trim(CAST({c} AS VARCHAR)) <> '') >= count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> ''), false) AS numeric FROM {s}"
    return " UNION ALL ".join("SELECT field, type, CAST(nulls AS BIGINT) AS nulls, CAST(blanks AS BIGINT) AS blanks, \"distinct\", numeric FROM (" + one.format(c=c, t=t, s=source) + ")" for c, t in columns)


#: All of lineitem, and the two columns with holes.
_FIELDS = [
    *[(f"l_{c}", "bigint") for c in ("orderkey", "partkey", "suppkey")], ("l_linenumber", "int"), *[(f"l_{c}", "double") for c in ("quantity", "extendedprice", "discount", "tax")],
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"), ("flag", "string"), ("qty", "double"),
]


@query("field_profile", _profile_sql(_FIELDS, _HOLES))
def _field_profile(spark, d):
    return summary.field_profile(_items(spark, d))


_META = LayerMeta("EPSG:32635", "m")


@query("layer_profile", "SELECT 'orders' AS name, 'EPSG:32635' AS crs, false AS geographic, count(*) AS features, 6 AS fields, min(o_custkey)::DOUBLE AS xmin, min(o_totalprice) AS ymin, max(o_custkey)::DOUBLE AS xmax, max(o_totalprice) AS ymax FROM orders")
def _layer_profile(spark, d):
    o = table(spark, d, "orders")
    return summary.layer_profile(o.withColumn("o_custkey", F.col("o_custkey").cast("double")), "orders", _META, ("o_custkey", "o_totalprice", "o_custkey", "o_totalprice"))


@query("profile", "SELECT *, 'items' AS name, 'EPSG:32635' AS crs, (SELECT count(*) FROM lineitem) AS features FROM (" + _profile_sql(_FIELDS, _HOLES) + ")")
def _profile(spark, d):
    return summary.profile(_items(spark, d), "items", _META)


@query("raster_profile", """SELECT o_custkey % 50 AS raster_id, CAST(max(o_orderkey % 100) + 1 AS INTEGER) AS width, CAST(max(o_orderkey // 100) + 1 AS INTEGER) AS height,
  CAST(max(1 + o_orderkey % 3) AS INTEGER) AS bands, o_custkey % 50 % 3 <> 0 AS georeferenced FROM orders GROUP BY 1""")
def _raster_profile(spark, d):
    k, raster = F.col("o_orderkey"), F.col("o_custkey") % 50
    cells = table(spark, d, "orders").select(raster.alias("raster_id"), (1 + k % 3).cast("int").alias("band"), F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"))
    crs = F.when(F.col("raster_id") % 3 != 0, "EPSG:32635")
    return summary.raster_profile(cells, audits.georeferenced(crs, F.lit(1), F.lit(1)))


@query("table_profile", "SELECT 'customer' AS name, NULL::VARCHAR AS crs, false AS geographic, count(*) AS features, 5 AS fields, NULL::DOUBLE AS xmin, NULL::DOUBLE AS ymin, NULL::DOUBLE AS xmax, NULL::DOUBLE AS ymax FROM customer")
def _table_profile(spark, d):
    return summary.layer_profile(table(spark, d, "customer"), "customer", LayerMeta())


@query("class_breaks", f"""WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM {_ORDERS})
SELECT CAST(i AS INTEGER) AS class, round(e[i], 4) AS min, round(e[i + 1], 4) AS max FROM e, range(1, 6) r(i)""")  # fmt: skip
def _class_breaks(spark, d):
    return rounded(summary.class_breaks(_odd(table(spark, d, "orders"), "o_totalprice", "o_orderkey", text=True), "o_totalprice"))


@query("class_assign", f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {_ORDERS}), b AS (SELECT CAST(i AS INTEGER) AS class, lo + (i - 1) * (hi - lo) / 5 AS min, lo + i * (hi - lo) / 5 AS max FROM e, range(1, 6) r(i)),
c AS (SELECT class, count(*) AS features FROM (SELECT (SELECT max(class) FROM b WHERE b.min <= o.o_totalprice) AS class FROM {_ORDERS} o) GROUP BY 1)
SELECT b.class, round(b.min, 4) AS min, round(b.max, 4) AS max, coalesce(features, 0) AS features FROM b LEFT JOIN c USING (class)""")  # fmt: skip
def _class_assign(spark, d):
    return rounded(summary.class_assign(_odd(table(spark, d, "orders"), "o_totalprice", "o_orderkey"), "o_totalprice", 5, "equal_interval"))


@query("choropleth", "SELECT CAST(row_number() OVER (ORDER BY value DESC, \"group\") AS INTEGER) AS rank, \"group\", features, value FROM (SELECT c_nationkey AS \"group\", count(*) AS features, round(sum(c_acctbal), 4) AS value FROM customer GROUP BY 1)")
def _choropleth(spark, d):
    return rounded(summary.choropleth(table(spark, d, "customer"), "c_nationkey", "c_acctbal"))


@query("top_n", f"SELECT event_id AS id, value, event_type AS label FROM {_EVENTS} ORDER BY value DESC, event_id LIMIT 10")
def _top_n(spark, d):
    return rank.top_n(_odd(table(spark, d, "events"), "value", "event_id"), "value", 10, id_col="event_id", label="event_type")


@query("table_top_n", f"SELECT o_orderkey AS id, o_totalprice AS value FROM {_ORDERS} ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _table_top_n(spark, d):
    return rank.top_n(_odd(table(spark, d, "orders"), "o_totalprice", "o_orderkey"), "o_totalprice", 10, ascending=True, id_col="o_orderkey")


@query("outliers", f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(value) AS considered FROM {_EVENTS})
SELECT event_id AS id, value, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high, considered FROM {_EVENTS}, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")  # fmt: skip
def _outliers(spark, d):
    return rounded(rank.outliers(_odd(table(spark, d, "events"), "value", "event_id"), "value", id_col="event_id"))


@query("outliers_zscore", f"WITH q AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(value) AS considered FROM {_EVENTS}) SELECT event_id AS id, value, round(m - 3 * s, 4) AS low, round(m + 3 * s, 4) AS high, considered FROM {_EVENTS}, q WHERE abs(value - m) > 3 * s")
def _zscore(spark, d):
    return rounded(rank.outliers(_odd(table(spark, d, "events"), "value", "event_id"), "value", "zscore", "event_id"))


@query("typed_filter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 250000.5 AND o_orderpriority LIKE '%-H%'")
def _typed_filter(spark, d):
    o = scope.typed_filter(table(spark, d, "orders"), "o_orderstatus", "in", "F, P")
    o = scope.typed_filter(scope.typed_filter(o, "o_totalprice", ">=", "250000.5"), "o_orderpriority", "like", "%-H%")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


def _chosen(spark, d):
    """Every third customer, as text, with one entry that is no number for each segment."""
    c = table(spark, d, "customer")
    return c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id")).union(c.select("c_mktsegment").distinct())


_SELECTED = "c_custkey % 3 = 0"


@query("select_ids", f"SELECT c_custkey, c_name FROM customer WHERE {_SELECTED}")
def _select_ids(spark, d):
    return scope.select_ids(table(spark, d, "customer"), _chosen(spark, d), "c_custkey").select("c_custkey", "c_name")


@query("select_report", f"SELECT count(*) AS selected, count(*) AS requested FROM customer WHERE {_SELECTED}")
def _select_report(spark, d):
    return scope.selection_report(table(spark, d, "customer"), _chosen(spark, d), "c_custkey")


@query("select_all", "SELECT c_custkey, c_name FROM customer")
def _select_all(spark, d):
    return scope.select_all(table(spark, d, "customer")).select("c_custkey", "c_name")


@query("select_none", "SELECT c_custkey, c_name FROM customer WHERE false")
def _select_none(spark, d):
    return scope.select_none(table(spark, d, "customer")).select("c_custkey", "c_name")


@query("select_invert", f"SELECT c_custkey, c_name FROM customer WHERE NOT ({_SELECTED})")
def _select_invert(spark, d):
    return scope.select_invert(table(spark, d, "customer"), _chosen(spark, d), "c_custkey").select("c_custkey", "c_name")


@query("scope_selection", f"SELECT round(avg(c_acctbal), 4) AS mean, count(*) AS usable FROM customer WHERE {_SELECTED}")
def _scope_selection(spark, d):
    return rounded(summary.numeric_summary(scope.scope_selection(table(spark, d, "customer"), _chosen(spark, d), "c_custkey"), "c_acctbal").select("mean", "usable"))


@query("calc_field", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / (c_custkey % 5), 6) END AS share, CAST(trunc(c_acctbal) AS BIGINT) AS whole, 'C-' || c_custkey AS tag FROM customer")
def _calc_field(spark, d):
    c = table(spark, d, "customer")
    c = scope.calc_field(c, "share", F.round(F.try_divide("c_acctbal", F.col("c_custkey") % 5), 6))
    c = scope.calc_field(scope.calc_field(c, "whole", F.col("c_acctbal"), "integer"), "tag", F.concat(F.lit("C-"), F.col("c_custkey").cast("string")), "text")
    return c.select("c_custkey", "share", "whole", "tag")


@query("calc_preview", """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN CAST(trunc(o_totalprice / (o_custkey % 7)) AS BIGINT) END AS v,
  CASE WHEN o_custkey % 14 = 0 THEN '''n/a ' || o_orderkey || ''' is not a number' END AS problem FROM orders)
SELECT count(*) AS rows, count_if(v IS NULL)::BIGINT AS nulls, (SELECT string_agg(v::VARCHAR, ',' ORDER BY id) FROM (SELECT * FROM v WHERE v IS NOT NULL ORDER BY id LIMIT 5)) AS sample,
  count_if(problem IS NOT NULL)::BIGINT AS bad, (SELECT string_agg(problem, '; ' ORDER BY id) FROM (SELECT * FROM v WHERE problem IS NOT NULL ORDER BY id LIMIT 3)) AS problems FROM v""")
def _calc_preview(spark, d):
    k = F.col("o_custkey")
    value = F.when(k % 14 == 0, F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string"))).otherwise(F.try_divide("o_totalprice", k % 7).cast("string"))
    return scope.calc_preview(table(spark, d, "orders"), value, "integer", "o_orderkey")


@query("blank_flags", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flag IS NULL OR trim(flag) = '' AS blank FROM {_HOLES}")
def _blank_flags(spark, d):
    return _items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.is_blank(F.col("flag")).alias("blank"))


@query("nested_as_text", """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS info,
  CASE WHEN o_orderkey % 4 <> 0 THEN '[' || o_orderkey || ',' || o_custkey || ']' END AS keys FROM orders""")
def _nested(spark, d):
    info = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("info")
    keys = F.when(F.col("o_orderkey") % 4 != 0, F.array("o_orderkey", "o_custkey")).alias("keys")
    return values.nested_as_text(table(spark, d, "orders").select("o_orderkey", info, keys))


@query("table_source", "SELECT s_suppkey AS id, s_acctbal FROM supplier")
def _table_source(spark, d):
    return scope.read_columns(table(spark, d, "supplier"), ["s_acctbal"], "s_suppkey")


@query("merge_layers", "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier")
def _merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return scope.merge_layers(c, s)


@query("dedupe_sources", """WITH b AS (SELECT user_id, event_id, 0 AS n FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, event_id) AS rn, count(*) OVER (PARTITION BY user_id) - 1 AS repeats FROM b) SELECT user_id, event_id, repeats FROM r WHERE rn = 1""")  # fmt: skip
def _dedupe(spark, d):
    e = table(spark, d, "events")
    pick = lambda k: e.filter(F.col("event_type") == k).select("user_id", "event_id")
    return scope.dedupe_sources(pick("click"), pick("error"), "user_id", "event_id")


@query("skip_completed", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0)")
def _skip_completed(spark, d):
    o = table(spark, d, "orders")
    return scope.without(o, o.filter("o_orderstatus = 'F' and o_orderkey % 4 = 0").select("o_custkey").distinct(), "o_custkey").select("o_orderkey", "o_custkey")


@query("skip_imported", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE 'https%')")
def _skip_imported(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return scope.without(p, p.filter("url like 'https%'").select("page_id"), "page_id")


@query("remove_source", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _remove_source(spark, d):
    gone = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return scope.without(table(spark, d, "part").select("p_partkey", "p_name"), gone, "p_partkey")


@query("scalar_functions", """SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'raster' WHEN 3 THEN 'vector' WHEN 4 THEN 'vector' ELSE 'unknown' END AS kind,
  CASE WHEN page_id % 3 = 0 AND page_id > 0 THEN '-' ELSE '' END || '$' || (page_id * 37 // 100)::VARCHAR || '.' || lpad((page_id * 37 % 100)::VARCHAR, 2, '0') AS price FROM pages""")
def _scalars(spark, d):
    i = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".CSV", ".png", ".html", ".json", ".GPKG")]), (i % 5 + 1).cast("int"))
    cents = F.when(i % 3 == 0, -i * 37).otherwise(i * 37)
    path = F.concat(F.lit("a.b/"), i.cast("string"), ending)
    return table(spark, d, "pages").select("page_id", values.data_kind(path).alias("kind"), values.cents_text(cents).alias("price"))
