"""Embedding near-dedup by a pivot-permutation index.

Pivots are spread-out vectors of a sample (the rows with the smallest hashes, twice as many as pivots and ``SAMPLE`` at
least; one too near to a chosen one is passed over). Their number follows the root of the number of vectors without an
end, so what the driver and a broadcast hold grows with that root: 1.5 vectors for each of its units. Each vector is described by its nearest ``DEPTH`` pivots and stands in their inverted lists, kept by
label. Vectors that meet in a list and share at least ``SHARED`` pivots are candidates; the dot product of the unit
vectors in double precision decides. The number of pivots follows the root of the number of vectors, so lists grow with
the root too; vectors of a length with at most ``DEPTH`` pivots (all near one another) are all compared, without
pivots. Long lists are dealt out in pairs of hash blocks. Equal vectors are one node with a weight. A pair that
meets in several lists counts where its smallest shared pivot is. Lists send out counts and a forest, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null label and
rows with a null vec_id link with nothing; vectors of unequal length never link; vec_ids are taken to be unique, rows that
repeat one with an equal vector count as copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common
from geoanswers.llm.op1_minhash import _dealt

SAMPLE, LEAST_PIVOTS, DEPTH, SHARED = 4096, 64, 8, 2
#: Cosine of a pivot to one already chosen beyond which it is passed over.
SPREAD = 0.6
BLOCK = 1024
#: Cosines of vectors to pivots held at once.
COSINES = 4_000_000


def pivots_for(n: int) -> int:
    return int(max(LEAST_PIVOTS, 1.5 * n**0.5))


def choose(vectors: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors in order, each not near an earlier chosen one; blocks of them meet the chosen ones at once."""
    out = np.zeros((0, vectors.shape[1]))
    for at in range(0, len(vectors), BLOCK):
        some = vectors[at : at + BLOCK]
        if len(out):
            some = some[(some @ out.T).max(axis=1) <= SPREAD]
        near, mine = some @ some.T > SPREAD, []
        for i in range(len(some)):
            if len(out) + len(mine) == most:
                break
            if not near[i, mine].any():
                mine.append(i)
        out = np.vstack([out, some[mine]])
    return out


def units(data: list[bytes], dtype: str) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    v = np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # keeps squares of very large and very small components in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(v: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest ``depth`` pivots of each row, nearest first; the earlier one of equally near ones."""
    out = np.empty((len(v), depth), np.int32)
    for at in range(0, len(v), max(1, COSINES // len(pivots))):
        far = -(v[at : at + max(1, COSINES // len(pivots))] @ pivots.T)
        some = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1)
        order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        out[at : at + len(far)] = np.take_along_axis(some, order, axis=1)
    return out


def _usable(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column("embedding"), []
            for x in column:
                v = None if x.values is None or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False)
                ok = v is not None and np.isfinite(v).all() and v.any()
                out.append(v.astype(dtype).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    return run


def _described(pivots, dtype: str, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            data = batch.column("v").to_pylist()
            size = np.array([len(x) for x in data]) // np.dtype(dtype).itemsize
            lists: list[list[int]] = [[-1]] * len(data)
            for length in np.unique(size).tolist():
                p = known.get(length)
                if p is None or len(p) <= depth:
                    continue  # one list for a length that the sample lacks, or all of whose pivots' lists hold every vector
                at = np.flatnonzero(size == length).tolist()
                for i, mine in zip(at, nearest(units([data[i] for i in at], dtype), p, depth).tolist()):
                    lists[i] = mine
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "label", "copies", "v")] + [pa.array(lists, pa.list_(pa.int32()))], names=["id", "label", "copies", "v", "pivots"])

    return run


def _linked(dtype: str, least: float, depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in common.contiguous(batches, ["list", "i", "j"]):
            length = group.v.str.len().to_numpy()
            for size in np.unique(length):
                g = group[length == size]
                if len(g) < 2:
                    continue
                x = units(list(g.v), dtype)
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                if g.i.iloc[0] != g.j.iloc[0]:
                    block = g.block.to_numpy()
                    near &= block[:, None] != block[None, :]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                mine = np.full((len(g), depth), -2)
                for row, p in zip(mine, g.pivots):
                    row[: len(p)] = p
                shared = np.zeros(len(a), int)
                first = np.full(len(a), np.iinfo(np.int32).max)
                for lo in range(0, len(a), 100_000):
                    at = slice(lo, lo + 100_000)
                    same = (mine[a[at]][:, :, None] == mine[b[at]][:, None, :]) & (mine[a[at]] > -2)[:, :, None]
                    hit = same.any(axis=2)
                    shared[at] = hit.sum(axis=1)
                    first[at] = np.where(hit, mine[a[at]], np.iinfo(np.int32).max).min(axis=1)
                here = g["pivot"].iloc[0]
                good = (shared >= (1 if here == -1 else SHARED)) & (first == here)
                copies, ids = g.copies.to_numpy(), g.id.to_numpy()
                links = np.zeros(len(g), np.int64)
                np.add.at(links, a[good], copies[b[good]])
                kept = np.zeros_like(near)
                kept[a[good], b[good]] = True
                root = common.forest(kept)
                yield pd.DataFrame({"a": ids[root], "b": ids, "links": links})[links > 0]

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links at cosine >= least within a label."""
    spark = embeddings.sparkSession
    dtype = "<f8" if "double" in embeddings.schema["embedding"].dataType.simpleString() else "<f4"
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = common.stored(base.mapInArrow(_usable(dtype), "vec_id long, label string, v binary"), "vectors")
    usable = rows.filter("v is not null and label is not null and vec_id is not null")
    nodes = common.stored(usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "nodes")
    n = nodes.count()
    most = pivots_for(n)
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE, 2 * most)).collect()
    by_length: dict[int, list[bytes]] = {}
    for r in sample:
        by_length.setdefault(len(r.v) // np.dtype(dtype).itemsize, []).append(bytes(r.v))
    pivots = spark.sparkContext.broadcast({k: choose(units(vs, dtype), most) for k, vs in by_length.items()})
    schema = "id long, label string, copies long, v binary, pivots array<int>"
    described = common.stored(nodes.select("id", "label", "copies", "v").mapInArrow(_described(pivots, dtype, DEPTH), schema), "described")
    entries = described.withColumn("pivot", F.explode("pivots")).withColumn("list", F.xxhash64("label", "pivot"))
    sizes = entries.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    entries = entries.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    lists = _dealt(entries, "list", F.ceil(F.col("n") / BLOCK), ["id", "copies", "v", "pivots", "pivot", "own"]).withColumnRenamed("own", "block")
    found = common.stored(lists.mapInPandas(_linked(dtype, least, DEPTH), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    joined = common.components(found).withColumnRenamed("id", "node")
    named = nodes.select("label", "v", F.col("id").alias("node"), "copies")
    ok = F.col("vec_id").isNotNull() & (F.col("rows.label") == F.col("named.label")) & (F.col("rows.v") == F.col("named.v"))
    out = rows.alias("rows").join(named.alias("named"), ok, "left").select("vec_id", "node", "copies")
    out = out.join(links, "node", "left").join(joined, "node", "left")
    component = F.coalesce("component", "node", "vec_id")
    return out.select("vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


QUERIES = {"op4_embeddings": op4_embeddings}
ORACLES: dict[str, str] = {}
