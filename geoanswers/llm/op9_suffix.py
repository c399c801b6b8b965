"""Suffix-array dedup with sparse suffixes: passages of ``least`` words or more that stand in several documents.

Of every run of ``least`` words the suffix at its content-selected minimiser (smallest hash of ``k`` words, leftmost) is
retained, so equal runs retain equal suffixes at equal places. A suffix stands for the runs with that minimiser, and its
context is their words. Suffixes whose first k words stand in one text only (a combinable count) are alone and go.

The others are range-sorted twice: by the words to the right, and by the first k words and then the words to the left.
Each is compared with the nearest suffixes of other texts above and below it, also across range borders, and the matches are
extended left and right within the context. One order finds the longest match to the right, the other the one to the
left. All matches of a suffix hold its place, so where both longest ones belong to matches of ``least`` words, their union
is all there is. The few suffixes of which that cannot be said (texts that share much on one side only) go another,
exact way: the runs of their groups are counted as wholes. A passage that stands in very many texts is a stretch of
the order, not a group; adjoining matches are put together into maximal passages. Equal texts are compared once.

Result: a row for each passage (doc_id, start_word, n_words, other_doc_id): other_doc_id is another document that holds
``least`` words of it (of those compared, the smallest doc_id); a word is reported exactly if a run of ``least`` words
around it stands in another document. A text that others equal is one passage (other_doc_id: the smallest doc_id of
them, for which it is the largest).

Bounds: the driver sees four suffixes of each range, of ``range_rows`` suffixes or more.

Defined results: words are as for MinHash (ASCII lower-cased); null, empty and shorter texts have no passages; repeats
inside one document only are none; rows with a null doc_id are left out; rows that repeat a doc_id with equal text are one
document, with another text each text has its own passages, and none of one another; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoanswers.llm import common

LEAST, K = 50, 8
#: Bytes of a word's hash in a context; suffixes of a range.
WIDTH, RANGE_ROWS = 5, 1_000_000


def text_digest(words: np.ndarray) -> tuple[int, int]:
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    a = common.mix(words + place * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True)
    b = common.mix(words ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))).sum(keepdims=True)
    return int(common.signed(a)[0]), int(common.signed(b)[0])


def minimisers(words: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the retained suffixes: key, place, the first run and the number of runs each stands for."""
    grams = common.gram_hashes(words, k)
    width = least - k + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], place[first], first, np.diff(first, append=len(place))


def run_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """A hash of each run of ``least`` words, at a cost that does not grow with ``least``."""
    up, down = common._powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return common.mix((total[least:] - total[:-least]) * down[: len(words) - least + 1])


def _words(data: np.ndarray | None) -> np.ndarray:
    return common.word_hashes(data, lower=True) if data is not None else np.zeros(0, np.uint64)


def _sparse(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for data in common.utf8(batch.column("text")):
                words = _words(data)
                n.append(len(words))
                a, b = text_digest(words)
                high.append(a), low.append(b)
                keys.append(common.signed(np.unique(minimisers(words, least, k)[0])) if len(words) >= least else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "high", "low", "keys"])

    return run


_CONTEXT = pa.schema([("id", pa.int64()), ("high", pa.int64()), ("at", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def _contexts(least: int, k: int):
    """The suffixes with given keys: their place, the words before it (backwards) and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for one, high, wanted, data in zip(batch.column("id").to_pylist(), batch.column("high").to_pylist(), batch.column("keys"), common.utf8(batch.column("text"))):
                words = _words(data)
                if text_digest(words)[0] != high:
                    continue  # another text of the same doc_id
                keys, place, first, count = minimisers(words, least, k)
                mine = np.flatnonzero(np.isin(common.signed(keys), wanted.values.to_numpy()))
                coded = words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                onward, back, n = coded.tobytes(), coded[::-1].tobytes(), len(words)
                end = first + count - 1 + least
                for at, lo, hi in zip(place[mine].tolist(), first[mine].tolist(), end[mine].tolist()):
                    out[2].append(at), out[3].append(back[WIDTH * (n - at) : WIDTH * (n - lo)]), out[4].append(onward[WIDTH * at : WIDTH * hi])
                out[0] += [one] * len(mine)
                out[1] += [high] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CONTEXT)], schema=_CONTEXT)

    return run


def _matrix(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows of a matrix of words, and their lengths in words."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.diff(offsets)
    out = np.zeros((len(column), least * WIDTH), np.uint8)
    if size.sum():
        out[np.arange(least * WIDTH) < size[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return out, size // WIDTH


class _Suffixes:
    """Suffixes of a stretch of the order, ready to be compared."""

    def __init__(self, rows: pa.RecordBatch, least: int):
        self.rows, self.least = rows, least
        self.id = rows.column("id").to_numpy()
        self.sides = [_matrix(rows.column(c), least) for c in ("left", "right")]

    def extended(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """How many words match to the left and to the right of the places of a and b."""
        out = []
        for words, size in self.sides:
            same = (words[a] == words[b]).reshape(len(a), self.least, WIDTH).all(axis=2)
            same &= np.arange(self.least) < np.minimum(size[a], size[b])[:, None]
            out.append(np.where(same.all(axis=1), self.least, same.argmin(axis=1)))
        return out


class _Found:
    """Of each suffix: the longest match to the left and to the right, the same of matches of ``least`` words (0: none),
    and the smallest id met in those."""

    def __init__(self, n: int):
        self.most, self.long = np.zeros((2, n), np.int32), np.zeros((2, n), np.int32)
        self.other = np.full(n, np.iinfo(np.int64).max)

    def note(self, s: _Suffixes, a: np.ndarray, b: np.ndarray, k: int) -> None:
        """Compare a with b; without k equal words to the right they have nothing to do with one another."""
        left, right = s.extended(a, b)
        good = right >= k
        a, b, left, right = a[good], b[good], left[good], right[good]
        long = left + right >= s.least
        for side, x in enumerate((left, right)):
            np.maximum.at(self.most[side], a, x)
            np.maximum.at(self.long[side], a[long], x[long])
        np.minimum.at(self.other, a[long], s.id[b[long]])


#: Rows that a sorted range gives: what was found; suffixes whose neighbour above or below lies in another range; the
#: last and the first suffix of the range and the nearest ones of another text (in this order by ``other``).
FOUND, ABOVE, BELOW, TAIL, HEAD = range(5)
_NEIGHBOURS = pa.schema(
    [("role", pa.int32()), ("part", pa.int32()), *_CONTEXT, ("most_left", pa.int32()), ("most_right", pa.int32()), ("long_left", pa.int32()), ("long_right", pa.int32()), ("other", pa.int64())]
)
_NEIGHBOURS_DDL = "role int, part int, id long, high long, at int, left binary, right binary, most_left int, most_right int, long_left int, long_right int, other long"


def _given(role: int, part: int, rows: pa.RecordBatch, found: _Found | None, pick: np.ndarray) -> pa.RecordBatch:
    n, rows = len(pick), rows.take(pa.array(pick))
    empty = [pa.nulls(n, t) for t in (pa.binary(), pa.binary())]
    columns = [pa.array(np.full(n, role, np.int32)), pa.array(np.full(n, part, np.int32)), *(rows.column(c) for c in ("id", "high", "at"))]
    columns += empty if role == FOUND else [rows.column("left"), rows.column("right")]
    if found is None:
        columns += [*[pa.nulls(n, pa.int32())] * 4, pa.array(np.arange(n))]
    else:
        columns += [pa.array(x[pick]) for x in (*found.most, *found.long, found.other)]
    return pa.RecordBatch.from_arrays(columns, schema=_NEIGHBOURS)


def _one(*batches: pa.RecordBatch | None) -> pa.RecordBatch:
    """Batches (with more columns or without) as one batch of suffixes."""
    given = [pa.RecordBatch.from_arrays([x.column(c) for c in _CONTEXT.names], schema=_CONTEXT) for x in batches if x is not None]
    return given[0] if len(given) == 1 else pa.Table.from_batches(given).combine_chunks().to_batches()[0]


def _compared(least: int, k: int):
    """Neighbours within a sorted range. Suffixes of one text that follow each other are a stretch: its nearest other
    texts are the last suffix before it and the first one behind it. The last stretch of a batch waits for the next
    batch (``kept``), and the suffix before it (``before``) stands in front of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, before, at_head = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _one(before, kept, batch)
            skip = 0 if before is None else 1
            s, f = _Suffixes(whole, least), _Found(whole.num_rows)
            edge = np.flatnonzero(np.diff(s.id)) + 1  # where stretches begin
            last = edge[-1] if len(edge) else 0
            if at_head and len(edge):
                at_head = False
                yield _given(HEAD, part, whole, None, np.array([0, edge[0]]))
                yield _given(ABOVE, part, whole, None, np.arange(edge[0]))
            done = np.arange(skip, last)
            stretch = np.searchsorted(edge, done, side="right")
            f.note(s, done, edge[stretch], k) if len(done) else None
            inner = stretch > 0
            f.note(s, done[inner], edge[stretch[inner] - 1] - 1, k)
            yield _given(FOUND, part, whole, f, done[f.most[1][done] > 0])
            if len(edge):
                before, kept = whole.slice(last - 1, 1), whole.slice(last)
            else:
                kept = whole
        if kept is None:
            return
        whole = _one(before, kept)
        mine = np.arange(0 if before is None else 1, whole.num_rows)
        if at_head:
            yield _given(HEAD, part, whole, None, mine[:1])
            yield _given(ABOVE, part, whole, None, mine)
        else:
            s, f = _Suffixes(whole, least), _Found(whole.num_rows)
            f.note(s, mine, np.zeros(len(mine), np.int64), k)
            yield _given(FOUND, part, whole, f, mine[f.most[1][mine] > 0])
        yield _given(BELOW, part, whole, None, mine)
        yield _given(TAIL, part, whole, None, np.array([whole.num_rows - 1] + ([] if before is None else [0])))

    return run


def _nearest(rows: list, forward: bool) -> dict[int, list]:
    """For each range, the nearest suffixes of at most two texts in the ranges before (behind) it."""
    out: dict[int, list] = {}
    by_part: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["other"]):
        by_part.setdefault(r["part"], []).append(r)
    seen: list = []
    for part in sorted(by_part, reverse=not forward):
        out[part] = seen
        # of a range's two, the one at its end comes first
        mine = by_part[part]
        new: list = []
        for r in mine + seen:
            if all(r["id"] != x["id"] for x in new) and len(new) < 2:
                new.append(r)
        seen = new
    return out


def _across(borders, least: int, k: int):
    """Suffixes at the borders of ranges against their neighbours in other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more, a, b = [], [], []
            for i, (role, part, one) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("role", "part", "id")))):
                near = next((x for x in borders.value[role].get(part, []) if x["id"] != one), None)
                if near is not None:
                    a.append(i), b.append(batch.num_rows + len(more))
                    more.append({c: bytes(near[c]) if c in ("left", "right") else near[c] for c in _CONTEXT.names})
            if not more:
                continue
            whole = _one(batch, pa.RecordBatch.from_pylist(more, _CONTEXT))
            s, f = _Suffixes(whole, least), _Found(whole.num_rows)
            f.note(s, np.array(a), np.array(b), k)
            mine = np.arange(batch.num_rows)
            yield _given(FOUND, 0, whole, f, mine[f.most[1][mine] > 0])

    return run


def _neighbours(suffixes: DataFrame, ranges: int, order: list, least: int, k: int, tag: str) -> DataFrame:
    """What the neighbours of each suffix in this order have in common with it (several rows a suffix)."""
    spark = suffixes.sparkSession
    line = suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "high", "at", "left", "right")
    rows = common.stored(line.mapInArrow(_compared(least, k), _NEIGHBOURS_DDL), tag)
    ends = rows.filter(F.col("role").isin(TAIL, HEAD)).select("role", "part", "other", *_CONTEXT.names).collect()  # at most four a range
    borders = {role: _nearest([r for r in ends if r["role"] == kind], forward) for role, kind, forward in ((ABOVE, TAIL, True), (BELOW, HEAD, False))}
    shared = spark.sparkContext.broadcast(borders)
    across = rows.filter(F.col("role").isin(ABOVE, BELOW)).mapInArrow(_across(shared, least, k), _NEIGHBOURS_DDL)
    return rows.filter(F.col("role") == FOUND).union(across)


def _run_hashes(least: int):
    """A hash of each run of ``least`` words in the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, highs, starts, hashes = [], [], [], []
            for one, high, at, left, right in zip(*(batch.column(c).to_pylist() for c in ("id", "high", "at", "left", "right"))):
                before = np.frombuffer(left, np.uint8).reshape(-1, WIDTH)[::-1]
                coded = np.concatenate([before, np.frombuffer(right, np.uint8).reshape(-1, WIDTH)]).astype(np.uint64)
                words = common.mix((coded << (np.arange(WIDTH, dtype=np.uint64) * np.uint64(8))).sum(axis=1))
                found = common.signed(run_hashes(words, least))
                ids.append(np.full(len(found), one)), highs.append(np.full(len(found), high)), hashes.append(found)
                starts.append(np.arange(len(found)) + at - len(before))
            if ids:
                columns = [np.concatenate(ids), np.concatenate(highs), np.concatenate(starts).astype(np.int32), np.concatenate(hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "high", "start", "run"])

    return run


def repeated_passages(documents: DataFrame, least: int = LEAST, k: int = K, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The passages of ``least`` words or more that stand in several documents."""
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    schema = "doc_id long, n_words long, high long, low long, keys array<long>"
    texts = common.stored(base.mapInArrow(_sparse(least, k), schema).filter(F.col("n_words") >= least), "suffixes")
    classes = common.stored(texts.groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")), "classes")
    # one text of each class; its id comes first among the keys, so equal texts don't gather
    named = classes.select(F.col("id").alias("_id"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    mine = (texts.doc_id == named["_id"]) & (texts.high == named["_high"]) & (texts.low == named["_low"])
    kept = common.stored(texts.join(named, mine).dropDuplicates(["doc_id", "high", "low"]).select(F.col("doc_id").alias("id"), "high", F.explode("keys").alias("key")), "kept")
    shared = common.stored(kept.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key"), "shared")
    alive = kept.join(shared, "key").groupBy("id", "high").agg(F.collect_list("key").alias("keys"))
    texts_alive = alive.join(base, alive.id == base.doc_id).select("id", "high", "keys", "text")
    found = texts_alive.mapInArrow(_contexts(least, k), "id long, high long, at int, left binary, right binary")
    suffixes = common.stored(found, "contexts")

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // range_rows))
    start = F.substring("right", 1, WIDTH * k)
    rest = [F.col(c) for c in ("id", "high", "at")]
    onward = _neighbours(suffixes, ranges, [F.col("right"), F.col("left"), *rest], least, k, "onward")
    back = _neighbours(suffixes, ranges, [start, F.col("left"), F.col("right"), *rest], least, k, "back")
    longest = {c: F.max(c).alias(c) for c in ("most_left", "most_right", "long_left", "long_right")}
    both = onward.union(back).groupBy("id", "high", "at").agg(*longest.values(), F.min("other").alias("other"))
    both = common.stored(both.filter(F.col("most_left") + F.col("most_right") >= least), "extended")
    matched = both.filter("long_left + long_right > 0").select("id", "high", (F.col("at") - F.col("long_left")).alias("start"), (F.col("at") + F.col("long_right")).alias("end"), "other")

    # suffixes for which the neighbours leave a doubt: the runs of their groups, as wholes
    doubt = both.filter("long_left < most_left or long_right < most_right").select("id", "high", "at")
    groups = common.stored(suffixes.join(doubt, ["id", "high", "at"]).select(start.alias("key")).distinct(), "doubts")
    runs = suffixes.withColumn("key", start).join(groups, "key").select("id", "high", "at", "left", "right").mapInArrow(_run_hashes(least), "id long, high long, start int, run long")
    runs = common.stored(runs, "runs")
    equal = common.stored(runs.groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "equal")
    whole = runs.join(equal, "run").select("id", "high", "start", (F.col("start") + least).alias("end"), F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))

    by_text = Window.partitionBy("id", "high").orderBy("start", "end")
    reach = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    islands = matched.union(whole).withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(by_text))
    passages = islands.groupBy("id", "high", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    # equal texts repeat as a whole
    again = classes.filter("id < last")
    alone = passages.join(again.select("id", "high"), ["id", "high"], "left_anti")
    alone = alone.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.col("other").alias("other_doc_id"))
    other = F.when(F.col("doc_id") == F.col("id"), F.col("last")).otherwise(F.col("id"))
    equals = texts.select("doc_id", "n_words", "high", "low").distinct().join(again, ["high", "low"]).select("doc_id", F.lit(0).cast("long").alias("start_word"), "n_words", other.alias("other_doc_id"))
    return alone.unionByName(equals)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op9_suffix": op9_suffix}
ORACLES: dict[str, str] = {}
