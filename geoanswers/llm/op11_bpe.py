"""BPE encoding and decoding through a table of distinct words.

The tokenizer never joins across white space, so the ids of a text are the ids of its words, one behind the other.
Texts are split in Spark's tasks, by pages of about ``PAGE`` bytes (a longer text is a page of its own): a page holds its
distinct words once, the most frequent first, and for each position in its texts the number of the word there. The words of
all pages are dealt into bins by a hash, so that all occurrences of a word meet in one bin, once a page; a bin is one part
of the table of distinct words, and each of its words is encoded once. Ids go back to the pages and are joined to the
positions. The number of bins follows the bytes of text, so a task holds about ``PER_BIN`` words of the table, and a word that
stands in every text comes once a page.

Decoding joins ids to the vocabulary's pieces (a table bounded by the vocabulary) and puts a space between them, as the
library does for vocabularies without a decoder.

Numbers travel packed: bytes of equal weight together, compressed; their volume is what bounds the operator at scale.

Defined results: a null or empty text has no ids and decodes to the empty text; null doc_ids are rows like others, rows that
repeat are rows of their own; an id that the vocabulary lacks, and a null, decode to nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common
from geoanswers.llm.op5_packing import _CLOSING, WordTokenizer, tokenizer_path

#: Bytes of text in a page, words of pages in a bin, ids decoded at once.
PAGE, PER_BIN, IDS = 32 << 20, 1_000_000, 4 << 20
#: Bytes of text for each word that is distinct in its page, as a rule; where words differ more, bins are larger, ten times at most.
DISTINCT = 50
#: Bytes of text split at once, words of a page that get their ids at once.
PART, WORDS = 4 << 20, 1 << 19
_ZSTD = "zstd"
#: A page's texts, or (bin not null) those of its words that fall into a bin.
PAGES = "page long, bin int, doc_ids array<long>, sizes binary, body binary, n long"
CODED = "page long, bin int, sizes binary, ids binary"
ENCODED = "doc_id long, ids array<int>"


# ---- packed numbers --------------------------------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32: how many bytes each takes, then all first bytes, all second ones and so on, compressed."""
    plain = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    wide = 4
    while wide > 1 and not plain[:, wide - 1].any():
        wide -= 1
    data = np.ascontiguousarray(plain[:, :wide].T).tobytes()
    return bytes([wide]) + len(numbers).to_bytes(8, "little") + pa.compress(data, _ZSTD, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, :wide] = np.frombuffer(pa.decompress(data[9:], wide * n, _ZSTD, asbytes=True), np.uint8).reshape(wide, n).T
    return out.reshape(-1).view("<u4")


def _pack_words(words: pa.Array) -> bytes:
    data = "\n".join(words.to_pylist()).encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, _ZSTD, asbytes=True)


def _unpack_words(data: bytes) -> list[str]:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, _ZSTD, asbytes=True).decode().split("\n") if n else []


# ---- splitting -------------------------------------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words. Letters are lower-cased and closing marks set apart as the tokenizer
    does, which leaves fewer words to know; not where a special token, which is told apart by case, may stand."""
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), _CLOSING, r"\1 \2\3")
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
    edges, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty ones
    if not pc.all(some).as_py():
        kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        return np.diff(kept[edges - edges[0]]), flat.filter(some)
    return np.diff(edges), flat


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        long = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        for k, n in enumerate(long.tolist()):
            if size and size + n > most:
                if k > at:
                    held.append(batch.slice(at, k - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, k
            size += n
        if at < len(long):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _coded(page: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The numbers of the words of a page in its order, the distinct words, and how many words each text has."""
    done = [_split(x.column("text").combine_chunks().fill_null("")) for x in _slices(iter(page.select(["text"]).to_batches()), PART)]
    coded = pa.chunked_array([w for _, w in done], pa.string()).dictionary_encode().unify_dictionaries()
    at = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
    return at, coded.chunks[-1].dictionary, np.concatenate([n for n, _ in done])


def _pages(bins: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, part in enumerate(_slices(batches, most)):
            at, known, sizes = _coded(part)
            count = np.bincount(at, minlength=len(known))
            if len(known):
                text = np.frombuffer("\n".join(known.to_pylist()).encode(), np.uint8)
                where = (common.word_hashes(text) % np.uint64(bins)).astype(np.int64)
            else:
                where = np.zeros(0, np.int64)
            # a word's number is its rank by count; each bin gets its words and their numbers
            order = np.lexsort((-count, where))
            by_count = np.argsort(-count, kind="stable")
            rank = np.empty(len(known), np.int64)
            rank[by_count] = np.arange(len(known))
            rows = [(base + number, None, part.column("doc_id").to_pylist(), pack(sizes), pack(rank[at]), len(at))]
            edges = np.searchsorted(where[order], np.arange(bins + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[b] : edges[b + 1]]
                # ranks rise within a bin
                rows.append((base + number, b, None, pack(np.diff(rank[mine], prepend=0)), _pack_words(known.take(pa.array(mine))), len(mine)))
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page", "bin", "doc_ids", "sizes", "body", "n"])
            del at, known, sizes, count, rank, rows
            pa.default_memory_pool().release_unused()

    return run


# ---- the table of distinct words -------------------------------------------------------------------------------


def _encoded(path: str):
    """A bin's words, each encoded once, for the pages that asked for them."""

    def run(bin_: pa.Table) -> pa.Table:
        lists = [_unpack_words(x) for x in bin_.column("body").to_pylist()]
        coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
        ids, n = WordTokenizer(path).ids(coded.dictionary)
        starts = np.cumsum(n) - n
        at, done, rows = coded.indices.to_numpy(zero_copy_only=False), 0, []
        for words in lists:
            mine = at[done : done + len(words)]
            done += len(words)
            each = n[mine]
            ends = np.cumsum(each)
            rows.append((pack(each), pack(ids[np.arange(ends[-1]) + np.repeat(starts[mine] - (ends - each), each)])))
        sizes, flat = zip(*rows)
        columns = [bin_.column("page"), bin_.column("bin"), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())]
        return pa.table(columns, names=["page", "bin", "sizes", "ids"])

    return run


def _joined(pages: pa.Table, coded: pa.Table) -> Iterator[pa.RecordBatch]:
    """The ids of a page's texts: the words' ids joined to the positions of the words, some texts at a time."""
    ranks = [np.cumsum(unpack(x), dtype=np.int64) for x in pages.filter(pc.is_valid(pages.column("bin"))).sort_by("bin").column("sizes").to_pylist()]
    coded = coded.sort_by("bin")
    sizes = [unpack(x).astype(np.int64) for x in coded.column("sizes").to_pylist()]
    ids = [unpack(x) for x in coded.column("ids").to_pylist()]
    text = pages.filter(pc.is_null(pages.column("bin"))).to_pylist()[0]
    rank, size, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ranks, sizes, ids))
    start, of_rank = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    start[rank], of_rank[rank] = np.cumsum(size) - size, size
    at, flat = unpack(text["body"]), flat.astype(np.uint32).view(np.int32)
    words = np.concatenate([[0], np.cumsum(unpack(text["sizes"]), dtype=np.int64)])
    block = words[:-1] // WORDS
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        some = at[words[lo] : words[hi]]
        n = of_rank[some]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(ends[-1]) + np.repeat(start[some] - ends[:-1], n)
        lists = pa.ListArray.from_arrays(pa.array(ends[words[lo : hi + 1] - words[lo]], pa.int32()), pa.array(flat[place]))
        yield pa.RecordBatch.from_arrays([pa.array(text["doc_ids"][lo:hi], pa.int64()), lists], names=["doc_id", "ids"])


def encoded(documents: DataFrame, tokenizer: str, page: int = PAGE, per_bin: int = PER_BIN, then=None, schema: str = ENCODED) -> DataFrame:
    """(doc_id, ids) of every text of documents (doc_id, text), for a vocabulary that drops white space. ``then``: what is done
    with the batches of (doc_id, ids) in the same task, and the schema of what it gives."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bins = max(1, -(-size // (DISTINCT * per_bin)))
    pages = common.stored(base.mapInArrow(common.tidied(_pages(bins, page)), PAGES), "pages")
    coded = pages.filter("bin is not null").select("page", "bin", "body").groupBy("bin").applyInArrow(_encoded(tokenizer), CODED)
    # a bin's words have done their work there
    slim = pages.select("page", "bin", "doc_ids", "sizes", F.when(F.col("bin").isNull(), F.col("body")).alias("body"))

    def joined(pages: pa.Table, coded: pa.Table) -> pa.Table:
        rows = _joined(pages, coded)
        return pa.Table.from_batches(rows if then is None else then(rows))

    return slim.groupBy("page").cogroup(coded.groupBy("page")).applyInArrow(joined, schema)


# ---- decoding --------------------------------------------------------------------------------------------------


def vocabulary(path: str) -> list[str | None]:
    """The piece of each id (None: no piece has it)."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if found.decoder is not None:
        raise ValueError("vocabularies with a decoder of their own are not read here")
    known = found.get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(known.values()) + 1)
    for piece, at in known.items():
        out[at] = piece
    return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    return pa.array(vocabulary(path), pa.string())


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for whole in batches:
            sizes = pc.list_value_length(whole.column("ids")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (np.cumsum(sizes) - sizes) // IDS
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    yield _texts(whole.slice(lo, hi - lo), pieces)

    return run


def _texts(batch: pa.RecordBatch, pieces: pa.Array) -> pa.RecordBatch:
    ids = batch.column("ids")
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    known = pc.and_(pc.less(flat, len(pieces)), pc.greater_equal(flat, 0)).fill_null(False)
    if not pc.all(known).as_py():
        flat, parent = flat.filter(known), parent.filter(known)
    found = pieces.take(flat)
    if found.null_count:
        some = found.is_valid()
        found, parent = found.filter(some), parent.filter(some)
    edges = np.searchsorted(parent.to_numpy(), np.arange(len(batch) + 1))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found), " ")
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, text], names=["doc_id", "ids", "decoded"])


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids)."""
    return rows.select("doc_id", "ids").mapInArrow(_decoded(tokenizer), "doc_id long, ids array<int>, decoded string")


# ---- the query -------------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in batches:
        ids, texts = batch.column("ids"), batch.column("decoded")
        edges = ids.offsets.to_numpy().astype(np.int64)
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        of_ids = [hashlib.sha256(flat[4 * lo : 4 * hi]).hexdigest() for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())]
        of_texts = [hashlib.sha256(t).hexdigest() for t in common.utf8(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(of_ids), pa.array(of_texts)], names=names)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    decode = _decoded(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, path, then=lambda batches: _digests(decode(batches)), schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op11_bpe": op11_bpe}
ORACLES: dict[str, str] = {}
