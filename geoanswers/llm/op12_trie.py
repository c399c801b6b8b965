"""The prefix trie of conversations, by adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of a digest of its role and text and 4 bytes, big-endian, of its number of code points. A
conversation's key is its turns' ids, one behind the other; its text is not shuffled. Copies are put together first (in
ranges of key and conv_id, so that a third of all conversations may be copies of one), and the distinct keys are
range-sorted. Each range becomes a radix tree: nodes hold their children in one of four layouts that grow with their number,
edges are compressed paths, and only byte depths that are whole turns give nodes.

A node whose subtree lies in one range is finished there. Those on the paths of a range's first and last key may go on in
the neighbouring ranges: what a range adds to them (its own ends, and its finished children, summed) is one row each, and
these rows are the keys of the next round, whose ranges are fewer by a factor of thousands, until there is one range. No
task holds all children or all members of a node.

A hash over the ids of all members that end at a node is sequential by its nature: the ids of a node stream through one task
in pieces of ``PIECE`` ids; nothing holds them together. A conversation is one value (20 bytes a turn).

Defined results: rows without a conv_id belong to no conversation; null role or text is empty; turns order nulls first, equal
turns by role and id; rows that repeat are turns of their own; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

#: Bytes of a turn id; those of them that hold the number of code points.
WIDTH, LENGTH = 20, 4
#: Turns that a conversation may take over from its root conversation; conversations that share one.
HEAD, FAMILY = 5, 100
#: Keys in a range (its tree must fit a task), ids of members in a piece of text.
PER_RANGE, PIECE = 20_000, 4_096
NONE = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- the radix tree (inside tasks) ----------------------------------------------------------------------------


class Sorted:
    """Up to 16 children (4 at first): their bytes in order beside them."""

    __slots__ = ("bytes", "nodes", "most")

    def __init__(self):
        self.bytes, self.nodes, self.most = bytearray(), [], 4

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node):
        """Takes a child in (or another in its place); returns the layout that holds it."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == 16:
            return Indexed(self).put(byte, node)
        if len(self.bytes) == self.most:
            self.most = 16
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def children(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children: a byte's place among them in an index of 256."""

    __slots__ = ("index", "nodes")

    def __init__(self, smaller: Sorted):
        self.index, self.nodes = bytearray(256), list(smaller.nodes)
        for at, byte in enumerate(smaller.bytes):
            self.index[byte] = at + 1

    def get(self, byte: int):
        return self.nodes[self.index[byte] - 1] if self.index[byte] else None

    def put(self, byte: int, node: Node):
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            return Direct(self).put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def children(self) -> list:
        return [self.nodes[at - 1] for at in self.index if at]


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, smaller: Indexed):
        self.nodes = [smaller.nodes[at - 1] if at else None for at in smaller.index]

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def children(self) -> list:
        return [n for n in self.nodes if n is not None]


class Node:
    """The bytes that lead here from the parent, what is added at exactly this key, and the children by their first byte."""

    __slots__ = ("edge", "own", "layout")

    def __init__(self, edge: bytes, own: tuple | None = None):
        self.edge, self.own, self.layout = edge, own, Sorted()


def _added(a: tuple | None, b: tuple) -> tuple:
    """(members, least member, children, leaves, saved, ends) of two at the same key."""
    if a is None:
        return b
    return a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], b[5] if a[5] == EMPTY else a[5]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # the first difference lies in [low, n)
        half = (low + n) // 2
        low, n = (half, n) if a[low:half] == b[low:half] else (low, half)
    return low


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, own: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.layout.get(key[at])
            if child is None:
                node.layout = node.layout.put(key[at], Node(key[at:], own))
                return
            same = _common(child.edge, key[at : at + len(child.edge)])
            if same < len(child.edge):  # the path parts here
                middle = Node(child.edge[:same])
                child.edge = child.edge[same:]
                middle.layout = middle.layout.put(child.edge[0], child)
                node.layout = node.layout.put(key[at], middle)
                child = middle
            node, at = child, at + same
        node.own = _added(node.own, own)


class _Place:
    """A radix node on the way down: its whole-turn depths as (depth, digest, on an open path, code points)."""

    __slots__ = ("node", "parent", "depths", "sums")

    def __init__(self, node: Node, parent: int, depths: list):
        self.node, self.parent, self.depths = node, parent, depths
        self.sums = [0, NONE, 0, 0, 0, []]


def _digest(h) -> str:
    return h.hexdigest()[:32]


def _walk(tree: Tree, first: bytes | None, last: bytes | None) -> list[_Place]:
    """All radix nodes, parents first. ``first`` and ``last``: keys whose paths are open (None: none is)."""
    out: list[_Place] = []
    stack = [(tree.root, -1, 0, hashlib.sha256(), b"", first is not None, last is not None)]
    while stack:
        node, parent, at, path, tail, on_first, on_last = stack.pop()
        edge, end, depths = node.edge, at + len(node.edge), []
        done = 0
        if not at and not edge:
            depths.append((0, _digest(path), on_first, 0))
        path = path.copy()
        for stop in range((at // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            part = edge[done : stop - at]
            path.update(part)
            tail, done = (tail + part)[-LENGTH:], stop - at
            open_here = on_first and first[at:stop] == edge[:done] or on_last and last[at:stop] == edge[:done]
            depths.append((stop // WIDTH, _digest(path), open_here, int.from_bytes(tail, "big")))
        path.update(edge[done:])
        tail = (tail + edge[done:])[-LENGTH:]
        on_first, on_last = on_first and first[at:end] == edge, on_last and last[at:end] == edge
        out.append(_Place(node, parent, depths))
        here = len(out) - 1
        stack += [(c, here, end, path, tail, on_first, on_last) for c in node.layout.children()]
    return out


def nodes_of(items: list[tuple], final: bool) -> Iterator[tuple]:
    """Rows of ``LEVEL`` from (key, members, least member, children, leaves, saved, ends), keys in order."""
    tree = Tree()
    for key, *own in items:
        tree.insert(key, tuple(own))
    first, last = (None, None) if final else (items[0][0], items[-1][0])
    found: list[list] = []
    places = _walk(tree, first, last)
    for place in reversed(places):
        n, least, children, leaves, saved, below = place.sums
        ends = EMPTY
        if place.node.own:
            own = place.node.own
            n, least, children, leaves, saved, ends = n + own[0], min(least, own[1]), children + own[2], leaves + own[3], saved + own[4], own[5]
        for depth, digest, is_open, size in reversed(place.depths):
            for k in below:
                found[k][1] = digest
            if is_open:
                if n or children:
                    key = first if first[: depth * WIDTH] and hashlib.sha256(first[: depth * WIDTH]).hexdigest()[:32] == digest else last
                    found.append([digest, None, depth, least, n, children, leaves, saved, ends, None, key[: depth * WIDTH]])
                n, least, children, leaves, saved, below = 0, NONE, 0, 0, 0, []
            else:
                for k in below:
                    found[k][9] = least
                leaves = leaves if children else 1
                saved += (n - 1) * size
                found.append([digest, None, depth, least, n, children, leaves, saved, ends, None, None])
                children, below = 1, [len(found) - 1]
            ends = EMPTY
        if place.parent >= 0:
            up = places[place.parent].sums
            up[0], up[1], up[2], up[3], up[4] = up[0] + n, min(up[1], least), up[2] + children, up[3] + leaves, up[4] + saved
            up[5] += below
    return (tuple(x) for x in found)


# ---- the rounds ------------------------------------------------------------------------------------------------

LEVEL = "path string, parent string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, key binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], schema: str, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members by key and piece, from rows sorted by key and conv_id."""

    def rows() -> Iterator[tuple]:
        key, ids = None, []
        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and (k != key or len(ids) >= PIECE):
                    yield key, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield key, ids[0], len(ids), ",".join(map(str, ids))

    return _batches(rows(), "key binary, first long, n long, ids string", 500)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """An item a key, from pieces sorted by key and first member; the members' hash runs over the pieces."""
    key, least, n, h = None, NONE, 0, hashlib.sha256()
    for batch in batches:
        for k, first, count, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if n and k != key:
                yield key, n, least, 0, 0, 0, h.hexdigest()
                n = 0
            if not n:
                key, least, h = k, first, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
            n += count
    if n:
        yield key, n, least, 0, 0, 0, h.hexdigest()


def _trees(final: bool, of_pieces: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = list(_folded(batches)) if of_pieces else [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))]
        if items:
            yield from _batches(nodes_of(items, final), LEVEL)

    return run


def _ranged(df: DataFrame, ranges: int, by: list[str], order: list[str]) -> DataFrame:
    dealt = df.repartitionByRange(ranges, *by) if ranges > 1 else df.coalesce(1)
    return dealt.sortWithinPartitions(*order)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key of each conversation: the first turns of its family's root conversation, then its own from there."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.lpad(F.hex(F.length(text)), 2 * LENGTH, "0")
    id_ = F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * (WIDTH - LENGTH)), size)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), id_.alias("id")).filter("conv_id is not null")
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "id")
    convs = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda t: t["id"]).alias("ids"))
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("root"), F.slice("ids", 1, HEAD).alias("head"))
    both = convs.withColumn("root", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "root", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    taken = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    own = F.slice("ids", h + 1, F.greatest(F.size("ids") - h, F.lit(0)))
    return both.select("conv_id", F.unhex(F.array_join(F.concat(taken, own), "")).alias("key"))


def trie(keys: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The nodes of the trie over keys (conv_id, key) of turn ids: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, path (a digest of the turns that lead there)."""
    keys = common.stored(keys.select("key", "conv_id"), "keys")
    n = keys.count()
    least = 2 if n > 100 else 1  # a small table's paths are merged as well
    pieces = common.stored(_ranged(keys, max(least, -(-n // per_range)), ["key", "conv_id"], ["key", "conv_id"]).mapInArrow(_copies, "key binary, first long, n long, ids string"), "copies")
    rows, count, levels = pieces, pieces.count(), []
    ranges = max(least, -(-count // per_range))
    while True:
        grown = _ranged(rows, ranges, ["key"], ["key", "first"] if rows is pieces else ["key"]).mapInArrow(_trees(ranges == 1, rows is pieces), LEVEL)
        level = common.stored(grown, "trie")
        levels.append(level.filter("key is null").drop("key"))
        if ranges == 1:
            break
        rows = level.filter("key is not null").select("key", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        # at most an eighth of the ranges: rounds end even where open paths are long and part often
        ranges = max(1, min(-(-rows.count() // per_range), ranges // 8))
    out = levels[-1]
    if levels[:-1]:
        parents = levels[1]
        for x in levels[2:]:
            parents = parents.union(x)
        parents = parents.select(F.col("path").alias("_path"), F.col("conv_id").alias("_least"))
        for x in levels[:-1]:
            known = F.coalesce("parent_conv_id", "_least").alias("parent_conv_id")
            waits = x.filter("parent_conv_id is null").join(parents, F.col("parent") == F.col("_path"), "left")
            out = out.union(x.filter("parent_conv_id is not null")).union(waits.select(*[known if c == "parent_conv_id" else F.col(c) for c in x.columns]))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))).drop("path")


#: DuckDB has no crc32: a fold over bytes and bits.
_CRC = """xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
 lambda v, i: xor(v >> 1, 3988292384 * (v & 1))), 4294967295::bigint), 4294967295::bigint)"""

ORACLE = f"""
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as p from conversations where conv_id is not null),
convs as (select c, c - c % {FAMILY} as root, {_CRC} % {HEAD + 1} as h from (select distinct conv_id as c from turns)),
parts as (select c, 0 as part, p, role, text from convs join turns on conv_id = root and p <= h
    union all select c, 1, p, role, text from convs join turns on conv_id = c and p > h),
placed as (select c, row_number() over w as d, length(text) as size,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (w rows unbounded preceding) as path from parts window w as (partition by c order by part, p)),
passes as (select c, d, size, path, coalesce(lag(path) over (partition by c order by d), '') as parent from placed
    union all select c, 0, 0, '', null from convs),
ends as (select path, sha256(string_agg(c::varchar, ',' order by c)) as ends from (select c, path from passes qualify row_number() over (partition by c order by d desc) = 1) group by path),
nodes as (select path, any_value(d) as depth, any_value(parent) as parent, any_value(size) as size, min(c) as conv_id, count(*) as n from passes group by path),
kids as (select parent, count(*) as k from nodes where parent is not null group by parent),
sums as (select a.path, sum(case when k is null then 1 else 0 end) as leaves, sum((y.n - 1) * y.size) as saved
    from nodes y left join kids on kids.parent = y.path join passes a on a.c = y.conv_id and a.d <= y.depth group by a.path)
select x.conv_id, x.depth, p.conv_id as parent_conv_id, x.n as n_convs, coalesce(k, 0) as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
    coalesce(ends, sha256('')) as ends_sha256
from nodes x left join nodes p on p.path = x.parent left join kids on kids.parent = x.path join sums on sums.path = x.path left join ends on ends.path = x.path"""

QUERIES = {"op12_trie": op12_trie}
ORACLES: dict[str, str] = {"op12_trie": ORACLE}
