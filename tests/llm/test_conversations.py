"""Conversations (prefix trie, repair) and BPE against brute force on small fixtures."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoanswers.llm import op5_packing, op11_bpe, op12_trie, op13_repair

# ---- BPE ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op5_packing.tokenizer_path())


def odd_texts():
    r = random.Random(3)
    letters = "abcdeABCé ßßΣσςİıK'́   \t\n\x0b.,;:!?#$%&*()[]<|>0123456789日本한국🙂🏽"
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "   \n\t ", "a", " lead and trail \n", "Hello, World!!! it's we'll", "<|startoftext|>Mixed Case<|endoftext|>", "x<|endoftext|>Y <|StartOfText|>", "é É", "a.b. c.\td"]
    return texts + ["word " * 40_000, "".join(r.choices("abcdefgh", k=20_000)), texts[0], texts[0]]


def test_ids_and_texts_equal_the_library(spark, tokenizer):
    texts = odd_texts()
    docs = spark.createDataFrame([(None if k == 7 else k, t, k, "x", b"k") for k, t in enumerate(texts)], "doc_id long, text string, page long, bin string, ids binary").repartition(3)
    rows = op11_bpe.decoded(op11_bpe.encoded(docs, op5_packing.tokenizer_path(), page=4_000, per_bin=600), op5_packing.tokenizer_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = tokenizer.encode(texts[7 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_each_distinct_word_is_in_one_bin(spark):
    docs = spark.createDataFrame([(k, "common words everywhere and w%d" % k) for k in range(200)], "doc_id long, text string").repartition(4)
    pages = docs.mapInArrow(op11_bpe._pages(5, 300), op11_bpe.PAGES).filter("bin is not null").collect()
    where = collections.defaultdict(set)
    for r in pages:
        for w in op11_bpe._unpack_words(r.body):
            where[w].add(r.bin)
    assert len(where) == 204 and all(len(b) == 1 for b in where.values())
    assert len({r.page for r in pages}) > 10 and len({r.bin for r in pages}) == 5


def test_unknown_ids_decode_to_nothing(spark, tokenizer):
    ids = tokenizer.encode("some words", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, [*ids, None, 10**8, -1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in op11_bpe.decoded(rows, op5_packing.tokenizer_path()).collect()}
    assert got == {1: tokenizer.decode(ids), 2: "", 3: ""} or got == {1: tokenizer.decode(ids), 2: "", 3: None}


def test_packed_numbers_return():
    for n in ([], [0], [255, 256], [2**32 - 1, 5], list(range(1000))):
        assert op11_bpe.unpack(op11_bpe.pack(np.array(n, np.int64))).tolist() == n


def test_bpe_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op11_bpe.encoded(docs, op5_packing.tokenizer_path()).count() == 0


def test_vocabularies_with_decoders_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        op11_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ---- the prefix trie ------------------------------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, key string, path long, n_convs string"


def conversations(seed, families=3, copies=40):
    r = random.Random(seed)
    rows = []
    texts = ["", "a", "bb", "ccc.", "é🙂?", None, "again.", "x " * 30]
    for c in [f * 100 + k for f in range(families) for k in range(r.randint(5, 60))] + [-250, -7, 777]:
        if c % 100 == 0 and r.random() < 0.3:
            continue  # an absent root
        turns = r.choices(range(12), k=r.randint(1, 9)) if r.random() < 0.2 else range(r.randint(1, 9))
        for t in turns:
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", "tool", "", None]) if r.random() < 0.3 else ["user", "assistant"][t % 2], r.choice(texts[: r.randint(1, 8)])))
    for c in range(5000, 5000 + copies):  # copies but for what their families give them
        rows += [(c, t, "user", "same") for t in range(7)]
    for c in range(9000, 9300, 3):
        rows += [(c, t, "user", str(c) if t == 6 else f"deep {t}") for t in range(7)]
    rows.append(rows[3])
    return [(*x, "k", 1, "n") for x in rows]


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, op_id(role, text), text))
    plain = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(plain.get(root, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def op_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


@pytest.mark.parametrize("seed,per_range", [(1, 40), (2, 20_000), (3, 90)])
def test_trie_equals_brute_force(spark, seed, per_range):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = op12_trie.trie(op12_trie.rebuilt(df), per_range).drop("path").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_rows_without_a_conversation(spark):
    assert op12_trie.trie(op12_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(None, 1, "user", "x", "k", 1, "n"), (4, 1, None, None, "k", 1, "n")]
    got = op12_trie.trie(op12_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))).drop("path").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_layouts_grow_and_keep_their_children():
    tree, r = op12_trie.Tree(), random.Random(5)
    keys = sorted({bytes(r.choices(range(256), k=op12_trie.WIDTH)) for _ in range(3000)} | {bytes([k]) + bytes(19) for k in range(17)})
    for k in r.sample(keys, len(keys)):
        tree.insert(k, (1, 1, 0, 0, 0, op12_trie.EMPTY))
    assert isinstance(tree.root.layout, op12_trie.Direct)
    kinds, found, stack = set(), [], [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        kinds.add((type(node.layout).__name__, getattr(node.layout, "most", 0)))
        if node.own:
            found.append(at + node.edge)
        children = node.layout.children()
        assert [c.edge[0] for c in children] == sorted(c.edge[0] for c in children)
        stack += [(c, at + node.edge) for c in children]
    assert sorted(found) == keys and {"Sorted", "Direct"} <= {k for k, _ in kinds}
    few = op12_trie.Tree()
    for k in range(30):
        few.insert(bytes([k]) * op12_trie.WIDTH, (1, k, 0, 0, 0, op12_trie.EMPTY))
    assert isinstance(few.root.layout, op12_trie.Indexed) and len(few.root.layout.children()) == 30


def test_long_conversations_branch_late(spark):
    rows = [(c, t, "user", f"{t}" if t < 1500 or c == 1 else f"{t}-{c}") for c in (1, 2, 3, 203) for t in range(1600)]
    rows = [(*x, "k", 1, "n") for x in rows]
    got = op12_trie.trie(op12_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), 2).drop("path").collect()
    want = brute_long(rows)
    assert {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves) for r in got} == want


def brute_long(rows):
    convs = collections.defaultdict(list)
    for c, _, role, text, *_ in rows:
        convs[c].append((role, text))
    built = {c: v[zlib.crc32(str(c).encode()) % 6 :] for c, v in convs.items()}  # no roots here
    groups, out = {0: [list(built)]}, {}
    level, d = [(tuple(built), None)], 0
    tree = {}
    while level:
        nxt = []
        for m, _ in level:
            kids = collections.defaultdict(list)
            for c in m:
                if len(built[c]) > d:
                    kids[built[c][d]].append(c)
            tree[min(m), d] = (len(m), [min(k) for k in kids.values()])
            nxt += [(tuple(k), None) for k in kids.values()]
        level, d = nxt, d + 1
    for (c, d), (n, kids) in sorted(tree.items(), key=lambda x: -x[0][1]):
        out[c, d] = (n, len(kids), sum(out[k, d + 1][2] for k in kids) or 1)
    assert groups
    return out


# ---- repair ---------------------------------------------------------------------------------------------------

WORDY = re.compile(r"[^\x20\x09-\x0D]")


def brute_repair(rows):
    """From the rules alone: all edit strings by dynamic programming over (row, roles so far as an automaton)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        marks = WORDY.findall(text)
        kinds.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    def fits(roles):  # a prefix of something that matches
        return re.fullmatch(r"(s?(ua)*u?)?", roles) is not None

    def short(roles):  # what decides how roles may go on
        return roles if len(roles) < 2 else ("+" + roles[-1])

    @functools.lru_cache(None)
    def best(i, roles, inserted):
        full = roles if not roles.startswith("+") else {"+u": "uau", "+a": "ua"}[roles]
        options = []
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", full):
            options.append((0, "", ()))
        if inserted < 3:
            for r in ("user", "assistant"):
                if fits(full + r[0]):
                    c, a, t = best(i, short(full + r[0]), inserted + 1)
                    options.append((c + 2, "I" + a, (f"{r}:",) + t))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, roles, 0)
            options.append((c + 3, "D" + a, t))
            if kinds[i] not in ("blank", "duplicate"):
                extra = kinds[i] == "truncated"
                if role[:1] in ("s", "u", "a") and fits(full + role[0]):
                    c, a, t = best(i + 1, short(full + role[0]), 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}",) + t))
                for r in ("user", "assistant"):
                    if fits(full + r[0]):
                        c, a, t = best(i + 1, short(full + r[0]), 0)
                        options.append((c + 2 + extra, "R" + a, (f"{r}:{text}",) + t))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = collections.Counter(kinds)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        here = out[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        here += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def sick(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(150), None]:
        for t in range(r.randint(1, 14)):
            role = ["user", "assistant"][t % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "", None, "Ünder", "sys"])
            text = r.choice(["Fine.", f"Text {t}!", "cut off", "no end \n", "  \t", "", None, "Why?", f"{c} ends. \x0b", f"{t} é", "nb "])
            rows.append((c, r.choice([t, t, t, t + 3, None]) if r.random() < 0.3 else t, role, text, "k", 1, "n"))
    return rows + [(900, 4, "user", "only", "k", 1, "n"), (901, None, None, None, "k", 1, "n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, tmp_path, seed):
    rows = sick(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in op13_repair.op13_repair(spark, str(tmp_path)).collect()}
    want = {c: brute_repair(v) for c, v in damage(rows).items()}
    assert got == want


def test_conversations_of_dropped_rows_stay(spark):
    dropped = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "k", 1, "n")], SCHEMA)
    row = op13_repair.repaired(op13_repair.damaged(df), F.col("gone")).first()
    assert tuple(row)[:8] == (dropped, 0, 0, 0, 0, 0, 0, "") and row.repaired == []
    assert op13_repair.repaired(df.limit(0)).count() == 0


def test_block_tables_of_any_length_agree():
    r = random.Random(4)
    one, four = op13_repair.Tables(1), op13_repair.Tables(4)
    for n in [*range(12), 5_000]:
        symbols = r.choices(range(op13_repair.SYMBOLS), k=n)
        assert one.repair(symbols) == four.repair(symbols)


def test_repair_of_a_very_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(30_000)] + [(1, None, "assistant", "first"), (2, 0, "user", "x" * 3_000_000 + ".")]
    df = spark.createDataFrame([(*x, "k", 1, "n") for x in rows], SCHEMA)
    got = {r.conv_id: r for r in op13_repair.repaired(df).collect()}
    assert (got[1].cost, len(got[1].repaired), got[1].audit[:3], got[1].illegal) == (3, 30_000, "DKK", 0)
    assert (got[2].cost, got[2].audit) == (2, "KI")
