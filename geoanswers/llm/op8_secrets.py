"""Secret scans with DataFrame functions only: three fixed patterns and sliding-window entropy.

A pattern's spans come from the text itself: the parts between matches (split) and the matches (extract_all) alternate,
so starts are running sums of their lengths in code points. The entropy scan takes candidate strings (20 or more token
characters), walks a window of 20 over each and keeps per-character counts (five bits each, packed into longs) and
sum(c log2 c) up to date with the one character that comes in and the one that leaves: the work of a step depends neither on
the window nor on the alphabet. A candidate is a secret where the window's entropy reaches the limit of its character
class. Candidates that the allow-list matches as a whole are suppressed; of paths, what stands between the
words at both ends is scored. Entropy spans that patterns' spans cover completely are not reported again. Cost is linear
in the text; only texts with matches build spans, by running sums in blocks (``_scan``), at a cost of n^1.5 for n of them.

Defined results: a null or empty text has no spans; rows that repeat and null doc_ids are rows like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Least bits of a window, by class of the candidate's characters.
LIMITS = {"hex": 2.9, "mixed": 3.6, "letters": 4.0}
#: Whole candidates that are no secrets: UUIDs, one-case words, digits.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Z]?[a-z=_-]+$",
    r"^[A-Z=_-]+$",
    r"^[0-9=+/_-]+$",
]
#: With two slashes or more, a candidate may be a path; its words at both ends are no part of a secret.
PATH = r"/.*/"
SEGMENT = r"^(?:(?:(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+|[A-Z]++)[0-9]{0,4}+|[0-9]{1,8}+)(?:[=+_-]++|$))*+$"


def _run(text: str, least: int) -> str:
    """A pattern of the first characters of text, at least so many and as far as they go on."""
    return text[:least] + "".join(f"(?:{c}" for c in text[least:]) + ")?" * (len(text) - least)


#: Placeholders and runs of the alphabet; a candidate is none of a secret where too little stands beside them.
PLACEHOLDER = "(?i)example|placeholder|x{4,}|0?" + _run("1234567890", 8) + "|" + _run("abcdefghijklmnopqrstuvwxyz", 8) + "|0{7,}"
_KINDS = ["assign", "access", "hex", "entropy"]
_SPAN = "array<struct<start:int,rank:int,end:int>>"


#: Values of a block of ``_scan``.
BLOCK = 128


def _given(x: Column, f) -> Column:
    """f of x, with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _scan(values: Column, join, kind: str, zero) -> Column:
    """For each value, all before it and itself joined (associatively, from zero). Appending to one array value by value
    would copy it each time, so blocks are scanned apart and then moved on by what stands before them."""
    empty = F.array().cast(f"array<{kind}>")
    first = F.lit(zero).cast(kind)

    def scan(xs: Column) -> Column:
        state = F.struct(first.alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], join(acc["at"], x)).alias("out"))
        return F.aggregate(xs, state, step, lambda acc: acc["out"])

    def whole(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK)), lambda i: i <= F.size(xs))
        blocks = F.transform(starts, lambda i: scan(F.slice(xs, i, F.lit(BLOCK))))
        return _given(blocks, moved)

    def moved(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        return _given(scan(ends), lambda sums: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: join(F.get(sums, i - 1), x))))))

    return _given(values, whole)


def _starts(text: Column, pattern: str, hits: Column) -> Column:
    """(start, end) in code points of each hit of the pattern, in order."""

    def spans(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda h, i: F.length(F.get(x["parts"], i)) + F.length(h))
        ends = _scan(steps, lambda a, b: a + b, "int", 0)
        return F.zip_with(ends, x["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end")))

    return _given(F.struct(F.split(text, pattern, -1).alias("parts"), hits.alias("hits")), spans)


#: Candidates' characters lie in 43..122; twelve counts of five bits fill a long.
FIRST, PACKED, BITS, LONGS = 43, 12, 5, 7


def _entropy_span(word: Column) -> Column:
    """(start, end) inside the candidate, from the first to the last window that reaches its class's limit; null if none."""
    table = F.array(*[F.lit(0.0), *[F.lit(c * math.log2(c)) for c in range(1, WINDOW + 2)]])
    limit = F.when(word.rlike("^[0-9a-fA-F]+$"), LIMITS["hex"]).when(word.rlike("[0-9]"), LIMITS["mixed"]).otherwise(LIMITS["letters"])
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST)
    place = lambda c, end: F.struct((c / PACKED).cast("int").alias("long"), (c % PACKED * BITS).alias("bit"), end.alias("end"))
    coming = F.transform(codes, lambda c, i: place(c, i + 1))
    # what leaves when the window moves on: nothing for the first ones
    pairs = _given(coming, lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("new"), F.when(i >= WINDOW, F.get(xs, i - WINDOW)).alias("old"))))
    names = [f"n{k}" for k in range(LONGS)]
    zero = F.lit(0).cast("long")
    state = F.struct(*[zero.alias(n) for n in names], F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    shift = lambda n, bit, name: F.call_function(name, n, bit)

    def count(longs: list[Column], at: Column) -> Column:
        chosen = longs[-1]
        for k in range(LONGS - 1):
            chosen = F.when(at["long"] == k, longs[k]).otherwise(chosen)
        return shift(chosen, at["bit"], "shiftright").bitwiseAND((1 << BITS) - 1).cast("int")

    def less(acc: Column, x: Column) -> Column:
        """The state without the character that leaves."""
        old, longs = x["old"], [acc[n] for n in names]
        n = count(longs, old)
        one = shift(F.lit(1).cast("long"), old["bit"], "shiftleft")
        new = [F.when(old["long"] == k, longs[k] - one).otherwise(longs[k]) for k in range(LONGS)]
        changed = F.struct(*[v.alias(m) for v, m in zip(new, names)], (acc["sum"] + F.get(table, n - 1) - F.get(table, n)).alias("sum"), acc["start"].alias("start"), acc["end"].alias("end"))
        return F.when(old.isNull(), acc).otherwise(changed)

    def more(acc: Column, x: Column) -> Column:
        """The state with the character that comes."""
        new, longs = x["new"], [acc[n] for n in names]
        n = count(longs, new)
        one = shift(F.lit(1).cast("long"), new["bit"], "shiftleft")
        total = acc["sum"] + F.get(table, n + 1) - F.get(table, n)
        changed = [F.when(new["long"] == k, longs[k] + one).otherwise(longs[k]).alias(names[k]) for k in range(LONGS)]
        hot = (new["end"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
        start = F.when(hot & acc["start"].isNull(), new["end"] - WINDOW).otherwise(acc["start"])
        return F.struct(*changed, total.alias("sum"), start.alias("start"), F.when(hot, new["end"]).otherwise(acc["end"]).alias("end"))

    step = lambda acc, x: _given(less(acc, x), lambda left: more(left, x))
    return F.aggregate(pairs, state, step, lambda acc: F.when(acc["start"].isNotNull(), F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(documents: DataFrame) -> DataFrame:
    """_row (the document), _text, _base and _all: spans (start, rank of the kind, end), ordered by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = documents.select(F.struct("*").alias("_row"), text.alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        hits = hits.withColumn(f"_h_{name}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))

    def spans(name: str, pattern: str, rank: int) -> Column:
        at = _starts(F.col("_text"), pattern, F.col(f"_h_{name}"))
        if name == "assign":
            kept = F.filter(F.arrays_zip(at.alias("at"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(2)).alias("value")), lambda x: F.length(x["value"]) >= 8)
            at = F.transform(kept, lambda x: x["at"])
        return F.when(F.size(f"_h_{name}") > 0, F.transform(at, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))).otherwise(F.array().cast(_SPAN))

    base = hits.withColumn("_base", F.array_sort(F.concat(*[spans(n, p, k) for k, (n, p) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)))])))
    words = F.arrays_zip(F.col("_h_entropy").alias("word"), _starts(F.col("_text"), CANDIDATE, F.col("_h_entropy")).alias("at"))
    words = F.transform(words, lambda x: F.struct(x["at"]["start"].alias("at"), _scored(x["word"]).alias("part")))
    words = F.filter(words, lambda x: (F.length(x["part"]["word"]) >= WINDOW) & ~_allowed(x["part"]["word"]))
    found = F.transform(words, lambda x: F.struct((x["at"] + x["part"]["skip"]).alias("from"), _entropy_span(x["part"]["word"]).alias("s")))
    found = F.transform(F.filter(found, lambda x: x["s"].isNotNull()), lambda x: F.struct((x["from"] + x["s"]["start"]).alias("start"), F.lit(3).alias("rank"), (x["from"] + x["s"]["end"]).alias("end")))
    more = F.when(F.size("_h_entropy") > 0, found).otherwise(F.array().cast(_SPAN))
    both = base.withColumn("_more", more)
    fresh = F.when((F.size("_base") > 0) & (F.size("_more") > 0), _uncovered(F.col("_base"), F.col("_more"))).otherwise(F.col("_more"))
    return both.withColumn("_all", F.array_sort(F.concat("_base", fresh))).select("_row", "_text", "_base", "_all")


def _stretches(base: Column) -> Column:
    """What spans in the order of their starts cover, as stretches without gaps (spans of rank 0)."""

    def cut(ends: Column) -> Column:
        heads = F.filter(F.transform(base, lambda b, i: F.when((i == 0) | (b["start"] > F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        last = lambda hs, k: F.coalesce(F.get(hs, k + 1), F.size(base)) - 1
        return _given(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(F.get(base, h)["start"].alias("start"), F.lit(0).alias("rank"), F.get(ends, last(hs, k)).alias("end"))))

    return _given(_scan(F.transform(base, lambda b: b["end"]), F.greatest, "int", 0), cut)


def _uncovered(base: Column, more: Column) -> Column:
    """The spans of ``more`` that ``base`` does not cover completely: both lists in one order, and the end of the last stretch
    that has begun carried along it."""
    line = F.array_sort(F.concat(_stretches(base), more))

    def told(xs: Column) -> Column:
        reach = _scan(F.transform(xs, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(-1)), F.greatest, "int", -1)
        kept = F.filter(F.zip_with(xs, reach, lambda x, to: F.struct(x.alias("x"), to.alias("to"))), lambda z: (z["x"]["rank"] > 0) & (z["to"] < z["x"]["end"]))
        return F.transform(kept, lambda z: z["x"])

    return _given(line, told)


def _scored(word: Column) -> Column:
    """skip and word: what stands between the words at both ends of a path, from where; other candidates as they are."""
    segments = F.split(word, "/", -1)
    odd = F.filter(F.transform(segments, lambda s, i: F.when(~s.rlike(SEGMENT), i)), lambda i: i.isNotNull())
    state = F.struct(segments.alias("segments"), F.array_min(odd).alias("first"), F.array_max(odd).alias("last"))

    def between(x: Column) -> Column:
        before = F.slice(x["segments"], 1, x["first"])
        skip = F.length(F.array_join(before, "/")) + F.when(x["first"] > 0, 1).otherwise(0)
        return F.struct(skip.alias("skip"), F.array_join(F.slice(x["segments"], x["first"] + 1, x["last"] - x["first"] + 1), "/").alias("word"))

    nothing = F.struct(F.lit(0).alias("skip"), F.lit("").alias("word"))
    path = F.get(F.transform(F.array(state), lambda x: F.when(x["first"].isNull(), nothing).otherwise(between(x))), 0)
    return F.when(word.rlike(PATH), path).otherwise(F.struct(F.lit(0).alias("skip"), word.alias("word")))


def _allowed(word: Column) -> Column:
    def listed(x: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out = out | x.rlike(pattern)
        return out

    rest = F.regexp_replace(word, PLACEHOLDER, "")
    return listed(word) | (word.rlike(PLACEHOLDER) & ((F.length(rest) < WINDOW) | listed(rest)))


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    base = scanned(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ranks = F.transform("_base", lambda s: s["rank"])
    counts = [(F.size("_base") - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(_KINDS[:3])]
    return base.select("_row.doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span (overlapping ones together) replaced by a mark; n_chars follows where it exists."""

    def clean(spans: Column) -> Column:
        return _given(_scan(F.transform(spans, lambda s: s["end"]), F.greatest, "int", 0), lambda ends: pieces(spans, ends))

    def pieces(spans: Column, ends: Column) -> Column:
        """The text before each span that begins behind all earlier ones, and a mark; then what is left."""

        def piece(s: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            gap = F.substring(F.col("_text"), done + 1, s["start"] - done)
            return F.when((s["start"] >= done), F.concat(gap, F.lit(mark))).otherwise("")

        rest = F.substring(F.col("_text"), F.element_at(ends, -1) + 1, F.length("_text"))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    found = scanned(documents).withColumn("_clean", F.when(F.size("_all") > 0, _given(F.col("_all"), clean)))
    new = {"text": F.coalesce("_clean", F.col("_row.text"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.length("_clean").cast(documents.schema["n_chars"].dataType), F.col("_row.n_chars"))
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays, its secrets replaced."""
    return redacted(docs)


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
