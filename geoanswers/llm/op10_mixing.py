"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Within a source documents are shuffled (by MD5 of the id) and queue up to ``repeats`` times over; each copy has a virtual
finish time, the source's words up to and with it divided by the source's target. All copies are ordered by finish
time and cut where their words reach the budget. Running sums go by ranges of the shuffle key and of the finish time,
so neither a hot source nor the whole table is summed in one task.

Targets: sources by code point, null last, take weights 3, 1, 2 in turn and share ``budget_percent`` of all words; a
target stops at ``repeats`` times its source's size and the excess is reshared by weight until none is above.

Defined results: a null text has size 0; rows that repeat queue as often as they stand; null doc_ids are rows like
others; size 0 takes 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: list[int], budget: float, repeats: int) -> DataFrame:
    """source, source_size, place, target of each source of sizes (source, source_size): one row a source. There may be
    very many sources: they are ordered by ranges, and what one row of all is joined to is one row."""
    ordered = common.placed(sizes, [F.col("source").isNull(), F.col("source")], {}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = ordered.withColumn("w", weight).withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    w = w.withColumnRenamed("place", "source_place")
    w = common.placed(w, [F.col("ratio"), F.col("source_place")], {"caps": F.col("cap"), "weights": F.col("w")}, "ratios")
    w = w.drop("place").withColumnRenamed("source_place", "place")
    every = w.agg(F.sum("w").alias("every"))
    # the common level where the sources that are full before this one are full and the others share the rest
    w = w.crossJoin(F.broadcast(every)).withColumn("level", (F.lit(budget) - F.col("caps")) / (F.col("every") - F.col("weights")))
    # the first source, by how soon it is full, that the common level does not fill
    first = w.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).alias("first")).select(F.col("first.level").alias("common"))
    w = w.crossJoin(F.broadcast(first))
    share = F.col("common") * F.col("w")
    return w.select("source", "source_size", "place", F.when(share < F.col("cap"), share).otherwise(F.col("cap")).alias("target"))


def mixed(documents: DataFrame, weights: list[int], budget_percent: float = 150, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, source and text_hash of every document."""
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    # rows without an id are shuffled by their texts
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("text_hash").cast("string")), F.lit("null"))
    slim = slim.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), name)))
    slim = common.stored(slim, "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.max("size").alias("largest"))
    whole = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("sources"), F.coalesce(F.max("largest"), F.lit(0)).alias("largest")).first()
    budget = whole["words"] * budget_percent / 100
    aims = common.stored(targets(sizes.select("source", "source_size"), weights, budget, repeats), "targets")

    # 28 bits of the key in the upper part of 31
    order = [F.col("key"), F.col("size"), F.col("text_hash")]
    queued = common.running(slim, ["source"], order, F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * 8, common.ranges_for(whole["most"]), F.col("size"), "ahead")
    on_source = F.col("source").eqNullSafe(F.col("_source"))
    queued = common.stored(queued.join(aims.withColumnRenamed("source", "_source"), on_source).drop("_source"), "queued")
    start = [(F.col("ahead") + k * F.col("source_size")).cast("double") / F.col("target") for k in range(repeats)]
    finish = [(F.col("ahead") + F.col("size") + k * F.col("source_size")).cast("double") / F.col("target") for k in range(repeats)]
    copies = F.array(*[F.struct(finish[k].alias("finish"), F.col("place").alias("place"), F.lit(k).alias("round"), F.col("key").alias("key"), F.col("size").alias("size"), F.col("text_hash").alias("text_hash"), start[k].alias("start")) for k in range(repeats)])
    # by a time x each source has finished all but a document of x times its target, so the budget ends the mix by this time;
    # a copy that starts later is beyond it
    end = 1 + whole["sources"] * whole["largest"] / max(budget, 1)
    line = queued.filter("size > 0").select(F.explode(F.filter(copies, lambda c: c["start"] <= end)).alias("c")).select("c.*").drop("start")
    spread = (F.least(F.col("finish") / (2 * end), F.lit(0.999999)) * F.lit(2147483648)).cast("long")
    rank = ["finish", "place", "round", "key", "size", "text_hash"]
    summed = common.running(line, [], [F.col(c) for c in rank], spread, common.ranges_for(whole["n"] * repeats), F.col("size"), "before")
    last = summed.filter(F.col("before") + F.col("size") <= budget).agg(F.max(F.struct(*rank)).alias("m")).first()["m"]
    taken = F.lit(0).cast("long")
    if last is not None:
        cut = F.struct(F.lit(last["finish"]).cast("double").alias("finish"), F.lit(last["place"]).cast("int").alias("place"), F.lit(last["round"]).cast("int").alias("round"), F.lit(last["key"]).alias("key"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["text_hash"]).cast("long").alias("text_hash"))
        for k in range(repeats):
            mine = F.struct(finish[k].alias("finish"), F.col("place").cast("int").alias("place"), F.lit(k).cast("int").alias("round"), F.col("key").alias("key"), F.col("size").cast("long").alias("size"), F.col("text_hash").cast("long").alias("text_hash"))
            taken = taken + F.when((F.col("size") > 0) & (mine <= cut), F.col("size")).otherwise(0)
    return queued.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.alias("taken"), "source", "text_hash")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, [3, 1, 2]).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as often as the mix takes it (wordless ones are taken by no mix and go). Rows of equal id and text
    come as often together as the mix takes them together, dealt evenly over them."""
    m = mixed(docs, [3, 1, 2]).filter("size > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("taken") / F.col("size")).cast("long").alias("_copies"))
    m = common.stored(m.groupBy("_id", "_hash").agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"), "copies")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    once = rows.join(m.filter("_rows = 1"), same).select("_row", "_copies")
    again = m.filter("_rows > 1")
    most = again.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]
    if most:
        several = common.stored(rows.join(again, same).drop("_id", "_hash").withColumn("_at", F.monotonically_increasing_id()), "several")
        spread = F.xxhash64("_at").bitwiseAND(0x7FFFFFFF)
        placed = common.running(several, ["_doc", "_h"], [F.col("_at")], spread, common.ranges_for(most), F.lit(1), "_place")
        share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_place") < F.col("_copies") % F.col("_rows"), 1).otherwise(0)
        once = once.union(placed.select("_row", share.cast("long").alias("_copies")).filter("_copies > 0"))
    return once.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT CAST(sum(source_size) AS DOUBLE) * 150 / 100 AS budget FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
w AS (SELECT *, CAST([3, 1, 2][((place - 1) % 3) + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM p),
l AS (SELECT w.*, cap / w AS ratio, ((SELECT budget FROM b) - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, (ratio, place)) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, place, CAST(least(cap, v.level * w) AS DOUBLE) AS target FROM l, v),
q AS (SELECT doc_id, size, key, source_size, place, target, CAST(coalesce(sum(size) OVER (PARTITION BY place ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, round, key, CAST(ahead + size + round * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) r(round) WHERE size > 0),
z AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, round, key ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM z WHERE upto <= (SELECT budget FROM b) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": ORACLE}
