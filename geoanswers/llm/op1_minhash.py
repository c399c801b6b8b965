"""MinHash near-dedup by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

A document's set holds the 64-bit hashes of its distinct k-word shingles. ``sketch`` fills t bins in rounds: the first
t rounds throw every element into a random bin, the last t give bin i one round of its own, so every coordinate fills
and a later round never beats an earlier one. Bands of 4 of the 128 coordinates make candidates (a pair at 0.8 is
missed with a chance of 5e-8), and full sets confirm them.

Equal sets are one node. Within a band's bucket the pairs whose sketches agree are candidates (a pair at 0.8 falls short
with a chance of 1e-6); only a forest over them is kept, and its connected clusters hold every link. A cluster's texts
are then compared on full sets, all pairs of a hash block and the cluster's first text at once by one matrix product, and
again only a forest over the links leaves the task. Where a cluster has several blocks, that joins nearly all of one that
is made of near copies; the texts it leaves apart (rest) are then compared with all of the cluster, block by block. So the
work on near copies of one text is linear in their number, no group grows in a task, and no pairs are ever written out.

Defined results: null or wordless texts have an empty set and link with nothing; rows that repeat a doc_id count as one
document with their texts; a null doc_id is a document of its own that links with nothing (component_id null, kept);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

BINS, ROWS = 128, 4
_SEEDS = common.mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = common.mix(np.arange(7, 7 + BINS, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64((1 << 56) - 1)
#: Nodes of a bucket's block; documents and shingles of a cluster's block; columns of an incidence matrix at once.
BLOCK, DOCUMENTS, SHINGLES, COLUMNS = 512, 1024, 1_000_000, 4096
#: Equal coordinates of 128 that a candidate pair has at least: 5 standard deviations under 0.8.
LEAST_EQUAL = 80


def sketch(keys: np.ndarray) -> np.ndarray:
    """128 coordinates of a set of distinct 64-bit hashes; the part of equal ones estimates the similarity."""
    out = np.full(BINS, np.iinfo(np.uint64).max)
    step, at = max(1, 2048 // len(keys)), 0
    while at < 2 * BINS:
        for lo, hi in ((at, min(at + step, BINS)),) if at < BINS else ((at, min(at + step, 2 * BINS)),):
            h = common.mix(keys[None, :] + _SEEDS[lo:hi, None])
            value = (h & _LOW) | (np.arange(lo, hi, dtype=np.uint64)[:, None] << np.uint64(56))
            if lo < BINS:
                np.minimum.at(out, (h >> np.uint64(57)).astype(np.intp).ravel(), value.ravel())
            else:
                bins = np.arange(lo - BINS, hi - BINS)
                out[bins] = np.minimum(out[bins], value.min(axis=1))
            at = hi
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, high, low, bands, short = [], [], [], [], []
            for data in common.utf8(batch.column("text")):
                keys = common.shingle_set(data, k) if data is not None else np.zeros(0, np.uint64)
                size.append(len(keys))
                if not len(keys):
                    high.append(None), low.append(None), bands.append(None), short.append(None)
                    continue
                high.append(int(common.signed(common.mix(keys).sum(keepdims=True))[0]))
                low.append(int(common.signed(common.mix(keys ^ _ODD[0]).sum(keepdims=True))[0]))
                s = sketch(keys)
                joined = common.mix((s * _ODD).reshape(-1, ROWS).sum(axis=1, dtype=np.uint64) + _ODD[: BINS // ROWS])
                bands.append(common.signed(joined))
                short.append((s & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "bands", "short"],
            )

    return run


def _edges(found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["a", "b"])


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each bucket (or pair of its blocks): a forest over the pairs whose sketches agree often enough."""
    found: list[np.ndarray] = []
    for group in common.contiguous(batches, ["band", "i", "j"]):
        ids = group.id.to_numpy()
        s = np.frombuffer(b"".join(group.short), np.uint8).reshape(-1, BINS)
        near = np.zeros((len(s), len(s)), bool)
        for i in range(len(s)):
            near[i] = (s == s[i]).sum(axis=1) >= LEAST_EQUAL
        root = common.forest(near)
        found.append(np.stack([ids[root], ids], axis=1)[root != np.arange(len(ids))])
        if len(found) >= 2000:
            yield _edges(found)
            found = []
    yield _edges(found)


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, from one incidence matrix in column chunks."""
    size = np.array([len(x) for x in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        keys, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        used = times[column] > 1
        row, column = np.repeat(np.arange(len(sets)), size)[used], place[column[used]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[at], column[at] - lo] = 1
            both += part @ part.T
    union = size[:, None] + size[None, :] - both
    out = (100 * both.astype(np.int64) >= percent * union.astype(np.int64)) & (both > 0)
    np.fill_diagonal(out, False)
    return out


def _confirmed(k: int, percent: int, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for group in common.contiguous(batches, keys):
            group = group.drop_duplicates("id")
            ids = group.id.to_numpy()
            root = common.forest(similar([common.shingle_set(np.frombuffer(t.encode(), np.uint8), k) for t in group.text], percent))
            found.append(np.stack([ids[root], ids], axis=1)[root != np.arange(len(ids))])
            if len(found) >= 2000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _dealt(rows: DataFrame, key: str, blocks: F.Column, columns: list[str]) -> DataFrame:
    """Rows of a key in every pair of its hash blocks (i <= j), rows of a pair together in a partition."""
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) as i, greatest(block, x) as j))")
    at = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.select(key, *columns, F.explode(pairs).alias("at")).select(key, F.col("at.i").alias("i"), F.col("at.j").alias("j"), *columns)
    return at.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and how many blocks the rows (id, n_shingles) of each of them make."""
    return rows.groupBy(*keys).agg(F.ceil(F.greatest(F.count("*") / DOCUMENTS, F.sum("n_shingles") / SHINGLES)).cast("int").alias(name))


def _links(clusters: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links on full sets that connect what is connected, within each cluster (id, cluster)."""
    shape = common.stored(_blocks(clusters.join(sizes, "id"), ["cluster"], "n"), "shape")
    whole = clusters.join(shape, "cluster").join(texts, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    first = whole.filter("id = cluster and n > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("to <> block")
    dealt = whole.select("cluster", "block", "id", "text").union(first.select("cluster", "to", "id", "text"))
    dealt = dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    links = common.stored(dealt.mapInPandas(common.tidied(_confirmed(k, percent, ["cluster", "block"])), "a long, b long"), "links")
    large = shape.filter("n > 1")
    if large.isEmpty():
        return links
    part = common.components(links)
    known = clusters.join(large, "cluster").join(part, "id", "left").select("id", "cluster", "n", F.coalesce("component", "id").alias("part"))
    known = common.stored(known, "parts")
    main = known.filter("id = cluster").select("cluster", F.col("part").alias("main"))
    rest = common.stored(known.join(main, "cluster").filter("part <> main").select("id", "cluster"), "rest")
    rests = common.stored(_blocks(rest.join(sizes, "id"), ["cluster"], "m"), "rests")
    both = whole.filter("n > 1").join(rests, "cluster")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = both.join(rest.select("id"), "id").select("cluster", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("i"), cells("n").alias("j"), "id", "text")
    others = both.select("cluster", cells("m").alias("i"), F.col("block").alias("j"), "id", "text")
    grid = mine.union(others).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return links.union(grid.mapInPandas(common.tidied(_confirmed(k, percent, ["cluster", "i", "j"])), "a long, b long"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links at 100 * intersection >= percent * union."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = common.stored(base.mapInArrow(common.tidied(_sketched(k)), "doc_id long, n_shingles long, high long, low long, bands array<long>, short binary"), "sets")
    usable = sets.filter("n_shingles > 0 and doc_id is not null")
    # equal sets are one node, named by the smallest doc_id
    nodes = usable.groupBy("high", "low").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "short")).alias("first"), F.count("*").alias("copies"))
    nodes = common.stored(nodes.select("high", "low", F.col("first.doc_id").alias("id"), "first.n_shingles", "first.bands", "first.short", "copies"), "nodes")

    # candidates: pairs of a bucket whose sketches agree; their clusters hold every link
    members = nodes.select("id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    placed = members.join(buckets, "band").join(nodes.select("id", "short"), "id")
    alike = _dealt(placed, "band", F.ceil(F.col("n") / BLOCK), ["id", "short"]).mapInPandas(common.tidied(_alike), "a long, b long")
    clusters = common.stored(common.components(alike).withColumnRenamed("component", "cluster"), "clusters")

    texts = base.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    joined = common.components(_links(clusters, nodes.select("id", "n_shingles"), texts, k, percent))

    groups = nodes.filter("copies > 1").select("high", "low", F.col("id").alias("first_id"))
    out = sets.select("doc_id", "n_shingles", "high", "low").join(groups, ["high", "low"], "left").withColumn("node", F.coalesce("first_id", "doc_id"))
    out = out.join(joined.withColumnRenamed("id", "node"), "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays (five-word shingles)."""
    keep = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep["_id"]), "left_semi")


QUERIES = {"op1_minhash": op1_minhash}
ORACLES: dict[str, str] = {}
