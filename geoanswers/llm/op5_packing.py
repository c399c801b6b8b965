"""Best-fit packing with large-item matching, planned on counts of piece lengths.

A document's ids (and a closing id) are cut into pieces of at most ``capacity``. A bin's contents matter only through
the lengths in it, and there are at most ``capacity`` lengths, so the plan is made on the histogram: pieces above one
third of the capacity stand at most twice in a bin and are matched greedily, largest with the largest that still fits;
smaller ones go, longest first, into the tightest gap that takes them. Runs of equal bins are handled at once: the
plan holds intervals of ranks (the i-th piece of a length), a bounded table. Pieces get their rank among equal lengths
in ranges (no length gathers in one task) and look their place up.

Defined results: a null or empty text is the closing id alone (one piece of length 1); rows that repeat are packed as
often as they stand; null doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

#: Words (and their characters) that a worker remembers; they are forgotten when so many are known.
WORDS, CHARACTERS = 1_500_000, 64 << 20
#: Bytes of text encoded at once.
CHUNK = 16 << 20
#: Marks behind a word of ASCII letters: tokens of their own whether a space stands before them or not.
_CLOSING = r"([a-z])([.,;:!?#$%&*]+)(\s)"


class WordTokenizer:
    """ids of texts, word by word: the tokenizer never joins across white space, so a word's ids are remembered.

    Texts are cut into words and the distinct words found by Arrow; only distinct words meet Python. They are lower-cased
    first (as the tokenizer does) and closing marks set apart, which leaves few words to know; not where a special
    token, which is told apart by case, may stand. Words of letters are encoded many at a time (each closes with one
    end-of-word id), others as a list of words. The ids of all known words lie in one array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def _of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        flat, lengths = [self.flat], []
        for some, kind in ((letters, self._of_letters), (others, self._of_any)):
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                ids, n = kind(part) or self._of_any(part)
                flat.append(ids), lengths.append(n)
        self.known.update(zip(letters + others, range(len(self.known), len(self.known) + len(words))))
        self.characters += sum(map(len, words))
        self.flat = np.concatenate(flat)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _CLOSING, r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        edges = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > WORDS or self.characters > CHARACTERS:
            self._forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        lengths, starts = np.diff(self.starts)[which], self.starts[which]
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], n)
        return self.flat[place], ends[edges[1:]] - ends[edges[:-1]]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text; a longer text stands alone."""
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _cut(doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray, capacity: int, close: int) -> pa.RecordBatch:
    """The pieces of texts with these ids, each text closed by ``close``."""
    whole = lengths + 1
    ends = np.cumsum(whole)
    full = np.empty(len(ids) + len(lengths), "<u4")
    closing = np.zeros(len(full), bool)
    closing[ends - 1] = True
    full[closing], full[~closing] = close, ids
    pieces = -(-whole // capacity)
    text = np.repeat(np.arange(len(whole)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(capacity, whole[text] - start)
    data, at = memoryview(full).cast("B"), (ends - whole)[text] + start
    crc = [zlib.crc32(data[lo:hi]) for lo, hi in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
    columns = [doc_ids.take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _pieces(path: str, capacity: int, close: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        for batch in batches:
            for part in _chunks(batch):
                ids, lengths = _TOKENIZERS[path].ids(part.column("text").fill_null(""))
                yield _cut(part.column("doc_id"), ids, lengths, capacity, close)

    return run


class Gaps:
    """Runs of equal bins by the room left in them, kept in order of room."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first bin, bins)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((first, count))

    def tightest(self, least: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.runs[room].pop()
        if not self.runs[room]:
            self.rooms.pop(at)
        return room, first, count


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Intervals (length, rank, count, first_bin, per_bin, offset): pieces of that length with ranks from ``rank`` on
    stand ``per_bin`` in each bin from first_bin on, the first of a bin at ``offset``."""
    out: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    bins = 0

    def put(length: int, count: int, first: int, per_bin: int, offset: int) -> None:
        out.append((length, used[length], count, first, per_bin, offset))
        used[length] += count

    gaps = Gaps()
    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    left = {s: counts[s] for s in large}
    order = sorted(left)
    for s in large:
        while left[s]:
            # the largest partner that fits, itself included
            at = bisect_left(order, capacity - s + 1) - 1
            while at >= 0 and (not left[order[at]] or order[at] == s and left[s] < 2):
                at -= 1
            if at < 0:
                put(s, left[s], bins, 1, 0)
                gaps.add(capacity - s, bins, left[s])
                bins, left[s] = bins + left[s], 0
                break
            t = order[at]
            n = left[s] // 2 if t == s else min(left[s], left[t])
            if t == s:
                put(s, 2 * n, bins, 2, 0)
            else:
                put(s, n, bins, 1, 0)
                put(t, n, bins, 1, s)
                left[t] -= n
            left[s] -= 2 * n if t == s else n
            gaps.add(capacity - s - t, bins, n)
            bins += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        n = counts[s]
        while n:
            found = gaps.tightest(s)
            if found is None:
                room, first, count = capacity, bins, -(-n // (capacity // s))
                bins += count
            else:
                room, first, count = found
            each = room // s
            full = min(count, n // each)
            if full:
                put(s, full * each, first, each, capacity - room)
                gaps.add(room - each * s, first, full)
                n -= full * each
            rest = count - full
            if rest and n and n < each:
                put(s, n, first + full, n, capacity - room)
                gaps.add(room - n * s, first + full, 1)
                full, rest, n = full + 1, rest - 1, 0
            if rest:
                gaps.add(room, first + full, rest)
    return pd.DataFrame(out, columns=["length", "rank", "count", "first_bin", "per_bin", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def _placed(table: pd.DataFrame):
    intervals = {int(s): g.to_numpy() for s, g in table.groupby("length")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            for s, at in zip(sizes.tolist(), np.split(order, first[1:])):
                g = intervals[s]
                row = g[np.searchsorted(g[:, 1], rank[at], side="right") - 1]
                k = rank[at] - row[:, 1]
                where[at] = row[:, 3] + k // row[:, 4]
                offset[at] = row[:, 5] + (k % row[:, 4]) * s
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(documents: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.stored(base.mapInArrow(_pieces(tokenizer, capacity, close), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = plan(counts, capacity)
    identity = ["doc_id", "piece", "ids_crc32"]
    spread = pieces.withColumn("_h", F.xxhash64(*identity)).withColumn("_spread", F.col("_h").bitwiseAND(0x7FFFFFFF))
    most = max(counts.values(), default=0)
    ranked = common.running(spread, ["length"], [F.col("_spread"), F.col("_h"), *[F.col(c) for c in identity]], F.col("_spread"), common.ranges_for(most), F.lit(1), "rank").drop("_h", "_spread")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: what is left, packed."""
    return packed(docs, tokenizer_path())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
