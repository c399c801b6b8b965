"""What the operators of this subpackage share: stored tables, words, hashes, ranks and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoanswers.operators.ordering import placed  # noqa: F401
from geoanswers.sources.tables import Scratch, shared_dir, stored  # noqa: F401

# ---- words and hashes (numpy, inside tasks) -------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes hashed at once; longer texts go piece by piece, cut between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    edge = np.diff(SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hash_piece(data: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(data)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if lower:
        data = LOWER[data]
    if len(data) <= PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        out.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words (ordered)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9DDFEA08EB382D69)
        h += words[j : j + n]
    return mix(h)


def shingle_set(data: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; shorter texts are one shingle, no words none."""
    words = word_hashes(data, lower=True)
    if not len(words):
        return words
    # the length goes in, so that a whole short text never equals a full shingle
    grams = gram_hashes(words, k) if len(words) >= k else mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams)


def utf8(column) -> Iterable[np.ndarray | None]:
    """The bytes of each text of an Arrow string column, without decoding; None for null."""
    if hasattr(column, "chunks"):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = "large" in str(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        yield data[at[i] : at[i + 1]] if valid[i] else None


def contiguous(batches: Iterable, keys: list[str]) -> Iterable:
    """The pandas frames of equal keys, from batches in which equal keys stand together."""
    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k].to_numpy() for k in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), len(pdf)]
        if held and any(held[-1][k].iloc[-1] != c[0] for k, c in zip(keys, columns)):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for lo, hi in zip(cut[:-2], cut[1:-1]):
            held.append(pdf.iloc[lo:hi])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(pdf.iloc[cut[-2] : cut[-1]])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    at, to = np.nonzero(linked)
    while len(at):
        new = label.copy()
        np.minimum.at(new, at, label[to])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def tidied(run):
    """``run`` (batches to batches), and then what the task is done with goes back to the system: a Python worker is used again
    by later stages, and would hold on to it beside what they need."""

    def whole(batches: Iterable) -> Iterable:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- ranks and running sums without one large partition -------------------------------------------------------


def running(df: DataFrame, keys: list[str], order: list[Column], spread: Column, buckets: int, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of value over the rows of the same keys that come before, in an order that is spread
    first and order second. ``spread`` is a long in [0, 2^31); rows fall into equal ranges of it, so a group of any
    size is summed by many tasks: totals of the ranges first, then rows within a range."""
    ranged = df.withColumn("_range", F.floor(spread * F.lit(int(buckets)) / F.lit(2147483648)).cast("int"))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    # ranges of one key are summed in two levels too: about the square root of them in a task
    wide = max(1, int(buckets**0.5))
    totals = totals.withColumn("_block", (F.col("_range") / wide).cast("int"))
    blocks = totals.groupBy(*keys, "_block").agg(F.sum("_total").alias("_sum"))
    by_block = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_block").alias("_b_block"), F.coalesce(F.sum("_sum").over(by_block), F.lit(0)).alias("_base"))
    on_block = F.col("_block") == F.col("_b_block")
    for k in keys:
        on_block = on_block & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    in_block = Window.partitionBy(*keys, "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_part", F.coalesce(F.sum("_total").over(in_block), F.lit(0))).join(blocks, on_block)
    starts = starts.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_range").alias("_s_range"), (F.col("_base") + F.col("_part")).alias("_start"))
    on_range = F.col("_range") == F.col("_s_range")
    for k in keys:
        on_range = on_range & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, on_range, "left")
    return summed.withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_within", "_start", "_s_range", *[f"_s_{k}" for k in keys])


def ranges_for(rows: int, per_range: int = 500) -> int:
    """How many ranges ``running`` takes for so many rows: it follows the input."""
    return max(1, min(2**30, rows // per_range))


# ---- connected components ------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that links reach.

    Alternates large-star and small-star (Kiveris et al. 2014) over written tables until nothing moves. A hub's
    neighbours are never gathered: the smallest neighbour is a combinable minimum that is joined back, and as it is
    written first, the join's sides are plain shuffles, of which a hub's side is split. A round's tables go when the
    next one is written."""
    with Scratch(edges.sparkSession) as own:
        pairs = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
        seen = None
        for _ in range(most_rounds):
            both = pairs.union(pairs.select("b", "a"))  # each id with each neighbour
            least = stored(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
            large = both.join(least, both.a == least.u).filter("b > a").select(F.col("m").alias("a"), "b")
            large = stored(large.filter("a < b").distinct(), "large")
            least = stored(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
            small = large.join(least, large.b == least.u).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            round_ends = own.mark()
            pairs = stored(small.filter("a < b").distinct(), "edges")
            state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            own.discard(round_ends)
            if state == seen:
                break
            seen = state
        else:
            raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return roots.union(pairs.select("a", F.col("a")).distinct())
