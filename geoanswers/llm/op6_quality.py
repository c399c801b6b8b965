"""Quality rules on repetition: a suffix array over each text's words.

Suffixes are sorted by prefix doubling (ranks of 1, 2, 4, ... words, kept), neighbours' longest common prefixes come
from the kept ranks without a scan of the text. At each position the larger of the two neighbour prefixes is the longest
passage that starts there and stands elsewhere in the text too; the longest-common-prefix intervals of at least
``least`` words are the maximal repeated passages. Their spans are united; the covered fraction and the longest repeat
have limits. The base counts come from the same arrays. Texts are independent: no shuffle. A text takes 8 bytes a word for
each doubling (as many as its longest repeat has binary digits, 25 at most for 30 million words) and is held in one task.

Defined results: a null or wordless text has zeros, fails the base rules and is not kept; rows that repeat and null
doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

#: Words of the shortest repeat that counts; limits of the covered part (percent, beyond so many words) and of one
#: repeat (words). The base rules end at 20 % of a text, so limits must lie below. Of 3,330 texts of sf0.1 that are
#: labelled good and pass the base rules, none repeats more than 13 words at once or has more than 26 covered.
LEAST, MOST_COVERED, FREE, MOST_LONG = 10, 10, 40, 30
#: Base rules.
LEAST_WORDS, BASE_WINDOW, MOST_REPEATED = 10, 5, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence of word hashes and the longest common prefix of each neighbouring pair."""
    n = len(words)
    if n < 2:
        return np.arange(n), np.zeros(0, np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while True:
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        line = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(line[1:] != line[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        levels.append(rank)
        step *= 2
    i, j = order[:-1], order[1:]
    common_prefix = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + common_prefix, j + common_prefix
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        common_prefix[same] += 1 << level
    return order, common_prefix


def reaches(words: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest passage from there that stands elsewhere too."""
    order, lcp = suffixes(words)
    out = np.zeros(len(words), np.int64)
    if len(lcp):
        out[order[:-1]] = lcp
        out[order[1:]] = np.maximum(out[order[1:]], lcp)
    return out


def united(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> int:
    """Positions of n that the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + lengths, 1)
    return int((np.cumsum(edge) > 0).sum())


def measures(data: np.ndarray) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat of a text's bytes."""
    words = common.word_hashes(data)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0
    chars = int(((data & 0xC0) != 0x80).sum() - common.SPACE[data].sum())
    symbols = int(_SYMBOL[data].sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    reach = reaches(words)
    base = np.flatnonzero(reach >= BASE_WINDOW)
    long = np.flatnonzero(reach >= LEAST)
    return n, chars, symbols, len(lines) - len(set(lines)), united(base, BASE_WINDOW, n) if len(base) else 0, united(long, reach[long], n) if len(long) else 0, int(reach.max())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(data) if data is not None else (0,) * 7 for data in common.utf8(batch.column("text"))]
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"])


def quality(documents: DataFrame) -> DataFrame:
    """The counts and verdicts of every document."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_measured, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    repeats = (100 * (F.col("covered_words") - FREE) > MOST_COVERED * F.col("n_words")) | (F.col("longest_repeat") > MOST_LONG)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
