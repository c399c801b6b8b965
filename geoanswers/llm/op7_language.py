"""Language ID by a string kernel with Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of the 1- to 4-byte n-grams of its lower-cased UTF-8 that some training text holds (a blended spectrum,
by presence); k(x, y) = |x and y| / sqrt(|x| |y|). Training texts are a bounded sample of labelled rows: for each language
and each of ``PER_LANGUAGE`` hash buckets one row, that with the smallest hash among those of at most ``SAMPLE_BYTES``
(among the longer ones where there are no others), a combinable minimum. The first landmarks of each language span the
Nystroem subspace; ridge regression to +1/-1 gives weights on the landmarks. Scoring is two matrix products a batch of
texts: presence x landmarks, kernels x weights. Whole texts are read, one pass, no shuffle.

The pipeline drops texts outside what was learned: too small a part of their n-grams of letters is known. The limit is
fitted on the training texts, each against the others.

Bounds (parameters): 128 training texts of 20,000 bytes and 32 landmarks a language; all n-grams of them count.

Defined results: null or letterless texts are ``und`` with score 0; so is everything where nothing is labelled; rows
that repeat are rows like others; a null doc_id is never learned from and not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

PER_LANGUAGE, SAMPLE_BYTES, LANDMARKS, RIDGE = 128, 20_000, 32, 1e-3
LONGEST, TEXTS = 4, 64
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes of letters as far as bytes can tell: beyond ASCII all.
_WORDLY = _LETTER.copy()
_WORDLY[128:] = True
#: Pipeline: n-grams of so many bytes or more, of letters only, tell whether a text is in a learned language. All but
#: LOW_PART of the training texts find a certain share of theirs in other training texts. A text is in none of the
#: languages if it finds less than this PART of that share in several training texts and less than that share in any; one
#: whose number of distinct n-grams is too small to tell within so many standard deviations stays.
TELLING, LOW_PART, PART, DEVIATIONS = 3, 0.05, 0.75, 3.0


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams at every position, by n; the length is part of the key."""
    low = common.LOWER[data].astype(np.int64)
    out, code = [], low
    for n in range(1, LONGEST + 1):
        if len(low) < n:
            break
        code = low if n == 1 else (code[:-1] << 8) | low[n - 1 :]
        out.append(code + (n << 32))
    return out


def telling(keys: np.ndarray) -> np.ndarray:
    """Which keys are n-grams of TELLING or more bytes, of letters only."""
    n = keys >> 32
    out = n >= TELLING
    for k in range(LONGEST):
        out &= (n <= k) | _WORDLY[(keys >> (8 * k)) & 255]
    return out


class Keys:
    """Places of n-grams in a list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = 64 - max(8, (4 * len(keys)).bit_length())
        self.table = np.full(1 << (64 - self.shift), -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.table[slot[left]] < 0
            self.table[slot[left[free]]] = left[free]
            left = left[self.table[slot[left]] != left]
            slot[left] = (slot[left] + 1) % len(self.table)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it is not listed."""
        slot = self._slot(keys)
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.table)
            out[left] = self.table[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out


class Model:
    """n-grams (those of landmarks first), which of them several texts hold, landmark incidence (n-grams x landmarks), weights
    (landmarks x languages) and the share of its n-grams that a learned language's text finds known at least."""

    def __init__(self, languages: list[str], keys: np.ndarray, several: np.ndarray, landmarks: np.ndarray, weights: np.ndarray, low: float):
        self.languages, self.keys, self.several, self.landmarks, self.weights, self.low = languages, keys, several, landmarks, weights, low
        self.places: Keys | None = None

    def __getstate__(self):
        return self.__dict__ | {"places": None}

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.places is None:
            self.places = Keys(self.keys)
        return self.places.find(keys)

    def present(self, data: np.ndarray, row: np.ndarray) -> None:
        for keys in grams(data):
            at = self.find(keys)
            row[at[at >= 0]] = 1

    def foreign(self, data: np.ndarray, row: np.ndarray) -> bool:
        """Whether the text, of which ``row`` is the presence, lies outside what was learned."""
        if not row.any():
            return True
        every = grams(data)[TELLING - 1 :]
        keys = np.concatenate(every) if every else np.zeros(0, np.int64)
        keys = keys[telling(keys)]
        if not len(keys):
            return False
        # most texts are told at a glance; for the others each n-gram counts once, as where the limit comes from
        if any(known >= least for known, least in self._shares(keys)):
            return False
        once = np.unique(keys)
        return all(known < least - DEVIATIONS * (least * (1 - least) / len(once)) ** 0.5 for known, least in self._shares(once))

    def _shares(self, keys: np.ndarray) -> list[tuple[float, float]]:
        """Shares of the n-grams and their limits. n-grams of one training text alone may be a sign of nothing but themselves,
        unless nearly all are known."""
        at = self.find(keys)
        return [(float(((at >= 0) & self.several[at]).mean()), PART * self.low), (float((at >= 0).mean()), self.low)]

    def score(self, present: np.ndarray) -> np.ndarray:
        size = present.sum(axis=1, keepdims=True, dtype=np.int64)
        kernels = present[:, : len(self.landmarks)].astype(np.float32) @ self.landmarks / np.sqrt(np.maximum(size, 1))
        return kernels @ self.weights


def fit(texts: list[tuple[str, np.ndarray]]) -> Model | None:
    """From (language, sorted distinct n-gram keys) of the sample, in a fixed order."""
    if not texts:
        return None
    languages = sorted({x for x, _ in texts})
    chosen, seen = [], dict.fromkeys(languages, 0)
    for i, (language, _) in enumerate(texts):
        if seen[language] < LANDMARKS:
            seen[language] += 1
            chosen.append(i)
    every, count = np.unique(np.concatenate([k for _, k in texts]), return_counts=True)
    first = np.unique(np.concatenate([texts[i][1] for i in chosen]))
    keys = np.concatenate([first, np.setdiff1d(every, first, assume_unique=True)])
    several = count[np.searchsorted(every, keys)] > 1
    landmarks = np.zeros((len(first), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        landmarks[np.searchsorted(first, texts[i][1]), j] = 1 / np.sqrt(len(texts[i][1]))
    k_nm = np.zeros((len(texts), len(chosen)))
    for i, (_, mine) in enumerate(texts):
        at = np.minimum(np.searchsorted(first, mine), len(first) - 1)
        k_nm[i] = landmarks[at[first[at] == mine]].sum(axis=0, dtype=float) / np.sqrt(len(mine))
    k_mm = k_nm[chosen]
    target = np.array([[1.0 if x == language else -1.0 for language in languages] for x, _ in texts])
    ridge = RIDGE * len(texts)
    weights = np.linalg.lstsq(k_nm.T @ k_nm + ridge * k_mm + 1e-8 * np.eye(len(k_mm)), k_nm.T @ target, rcond=None)[0]
    # what a training text would find known if it were not in the sample itself
    shares = [several_of(mine, every, count) for mine in (m[telling(m)] for _, m in texts) if len(mine)]
    low = float(np.quantile(shares, LOW_PART)) if shares else 0.0
    return Model(languages, keys, several, landmarks, weights.astype(np.float32), low)


def several_of(mine: np.ndarray, every: np.ndarray, count: np.ndarray) -> float:
    return float((count[np.searchsorted(every, mine)] > 1).mean())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.unique(np.concatenate(g)).tobytes() if data is not None and (g := grams(data)) else b"" for data in common.utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(keys, pa.binary())], names=["lang", "h", "keys"])


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(documents: DataFrame) -> Model | None:
    """Learns from text and lang of labelled documents that are not held out."""
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = labelled.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h"), F.xxhash64("text").alias("digest"), (F.octet_length("text") > SAMPLE_BYTES).alias("long"))
    first = F.min(F.struct("long", F.xxhash64("h").alias("g"), "doc_id", "h", "digest")).alias("m")
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(PER_LANGUAGE)).alias("bucket")).agg(first)
    picked = picked.select(F.col("lang").alias("_lang"), F.col("m.doc_id").alias("_id"), F.col("m.h").alias("h"), F.col("m.digest").alias("_digest"))
    picked = F.broadcast(common.stored(picked, "picked"))  # PER_LANGUAGE rows a language
    rows = labelled.join(picked, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_digest"))).select("lang", "h", "text")
    # rows that repeat count once
    sample = rows.mapInArrow(common.tidied(_distinct), "lang string, h long, keys binary").groupBy("lang", "h").agg(F.min("keys").alias("keys")).collect()
    sample.sort(key=lambda r: (r.h, r.lang, r.keys))
    return fit([(r.lang, np.frombuffer(r["keys"], np.int64)) for r in sample if r["keys"]])


def _has_letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def _judged(m: Model | None, texts: list, foreign: bool = False) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; where ``foreign`` is set, texts outside what was learned are unknown."""
    names: list[str] = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    good = [i for i, x in enumerate(texts) if m is not None and x is not None and _has_letter(x)]
    for lo in range(0, len(good), TEXTS):
        some = good[lo : lo + TEXTS]
        present = np.zeros((len(some), len(m.keys)), np.uint8)
        for row, i in zip(present, some):
            m.present(texts[i], row)
        s = m.score(present)
        best = s.argmax(axis=1)
        scores[some] = np.clip((s[np.arange(len(some)), best] + 1) / 2, 0, 1)
        for row, i, b in zip(present, some, best):
            if not (foreign and m.foreign(texts[i], row)):
                names[i] = m.languages[b]
    return names, scores


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judged(model.value, list(common.utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = documents.sparkSession.sparkContext.broadcast(train(base))
    out = base.select("doc_id", "text").mapInArrow(common.tidied(_predicted(model)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def _kept(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = _judged(model.value, list(common.utf8(batch.column("text"))), foreign=True)
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents in no learned language go."""
    model = spark.sparkContext.broadcast(train(docs.select("doc_id", "text", "lang")))
    return docs.mapInArrow(common.tidied(_kept(model)), docs.schema)


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
