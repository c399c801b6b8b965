"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a dense number 0..N-1 (its rank by a hash of its content, found in ranges, so no task sorts the table);
a keyed Feistel network permutes 0..N-1, values beyond N walk on until they fall inside. Shard and slot follow from the
permuted number alone: shard = p mod shards, slot = p div shards. The law is ``rows``: counts are at most one apart
and slots are gapless; both can be computed for any row number, and inverted, without reading data.

Defined results: a null text has no bytes (size 16, CRC of no bytes: 0); rows that repeat get numbers of their own;
null doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.llm import common

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, at: int, bits: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + at * 0xD1B54A32D192ED03 + 1) % 2**64)
    return common.mix(half + salt) & np.uint64((1 << bits) - 1)


def _once(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    left, right = x >> np.uint64(bits), x & np.uint64((1 << bits) - 1)
    for at in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, at, bits), left
        else:
            left, right = right, left ^ _round(right, key, at, bits)
    return (left << np.uint64(bits)) | right


def permute(numbers: np.ndarray, n: int, key: int = 0, back: bool = False) -> np.ndarray:
    """The permuted number of each of ``numbers`` in [0, n); back=True inverts it."""
    bits = _half_bits(n)
    x = _once(np.asarray(numbers, np.uint64), bits, key, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _once(x[out], bits, key, back)
    return x.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each row number."""
    p = permute(numbers, n, key)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 0) -> int:
    """The row number that stands at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, key, back=True)[0])


def numbered(df: DataFrame, rows: int, identity: list[str], name: str = "row_number") -> DataFrame:
    """Dense row numbers by a hash of the identity columns."""
    spread = df.withColumn("_h", F.xxhash64(*identity)).withColumn("_spread", F.col("_h").bitwiseAND(0x7FFFFFFF))
    out = common.running(spread, [], [F.col("_spread"), F.col("_h"), *[F.col(c) for c in identity]], F.col("_spread"), common.ranges_for(rows), F.lit(1), name)
    return out.drop("_h", "_spread")


IDENTITY = ["doc_id", "text_hash", "text_crc32", "size"]


def _described() -> list[Column]:
    """doc_id, size, text_crc32 and text_hash of a row of documents."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash")]


def _placed(ranked: DataFrame, n: int, shards: int, key: int) -> DataFrame:
    """ranked (with row_number) and shard, slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = place(batch.column("row_number").to_numpy(zero_copy_only=False), n, shards, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"])

    return ranked.mapInArrow(run, T.StructType([*ranked.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def sharded(documents: DataFrame, shards: int, key: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of every document."""
    slim = common.stored(documents.select(*_described()), "rows")
    n = slim.count()
    ranked = numbered(slim, n, IDENTITY).select("doc_id", "size", "text_crc32", F.col("row_number").cast("long").alias("row_number"))
    out = _placed(ranked, n, shards, key)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(documents: DataFrame, path: str, shards: int, key: int = 0, slots_a_file: int = 1_000_000) -> None:
    """Write whole documents, every row once, with their slot: a folder for each shard, dealt to tasks by ranges of
    slots and in slot order within a file. The placing is that of ``sharded``; columns named shard or slot give way."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("shard", "slot")]).alias("_row"), *_described())
    n = documents.count()
    ranked = numbered(rows, n, IDENTITY).select("_row", F.col("row_number").cast("long").alias("row_number"))
    whole = _placed(ranked, n, shards, key).select("_row.*", "shard", "slot")
    dealt = whole.repartition("shard", F.floor(F.col("slot") / slots_a_file))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 40)


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
