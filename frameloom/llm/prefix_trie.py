"""The trie of conversations' common beginnings: a stack swept over the sorted turn arrays, stitched between partitions."""

from __future__ import annotations

import hashlib
import pickle

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Turns that a conversation may take over from its base, at most; one less than the divisor of the hash.
MOST_SHARED = 8


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id, keys, sizes: each conversation's turns in order, as 16-byte digests of (role, text) and the texts' bytes.

    Texts are digested before they are shuffled, so what a task gathers is about 60 bytes a turn. Null turns come first,
    null roles and texts are empty, equal turn numbers are ordered by role, then by digest; rows without a conv_id belong
    to no conversation. Columns beside conv_id, turn, role and text are ignored.
    """
    role, text = F.coalesce(rows["role"], F.lit("")), F.coalesce(rows["text"], F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = rows.where(rows["conv_id"].isNotNull()).select(rows["conv_id"].cast("long").alias("conv_id"), F.struct(rows["turn"].alias("turn"), role.alias("role"), digest.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame, group: int = 5, salt: int = MOST_SHARED + 1) -> DataFrame:
    """Each conversation c anew: the first h turns of c - c % group (none if absent), then its own turns after its first h.

    h is crc32 of c in decimal, mod salt. Only the first turns of the bases are joined, one row for each conversation.
    """
    bases = convs.select(F.col("conv_id").alias("base"), F.slice("keys", 1, salt - 1).alias("base_keys"), F.slice("sizes", 1, salt - 1).alias("base_sizes"))
    own = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % salt).cast("int")})
    joined = own.join(bases, "base", "left")

    def of(name: str, kind: str) -> F.Column:
        shared = F.slice(F.coalesce(F.col(f"base_{name}"), F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(shared, F.slice(F.col(name), F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))).alias(name)

    return joined.select("conv_id", of("keys", "array<binary>"), of("sizes", "array<long>"))


class Node:
    """A node on the stack. first: on the path of the partition's first row. ends: ids that end here, or their hash.

    waiting: finished children, whose rows lack only this node's least member. refs: names it has in partitions.
    """

    __slots__ = ("depth", "size", "first", "least", "n", "kids", "leaves", "saved", "ends", "waiting", "refs")

    def __init__(self, depth: int, size: int, first: bool = False):
        self.depth, self.size, self.first = depth, size, first
        self.least, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting, self.refs = [], [], []

    def add(self, n: int, least: int | None, kids: int, leaves: int, saved: int) -> None:
        self.n += n
        self.kids += kids
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def finish(self, ends_sha: str) -> tuple:
        """The node's row without its parent: all of its subtree has been added."""
        self.saved += (self.n - 1) * self.size
        self.leaves = self.leaves or 1
        return self.least, self.depth, self.n, self.kids, self.leaves, self.saved, ends_sha


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _ids(ends: list[int]) -> bytes:
    return ",".join(map(str, ends)).encode()


PATHS, NODE = "paths", "node"


def sweep(rows, pid: int):
    """Rows of the nodes that begin and end in this partition, and what it knows of those that don't.

    rows: (conv_id, keys, sizes), sorted by keys, then conv_id. Levels of the stack above the longest common prefix of two
    neighbours are closed. Nodes on the path of the first row may have begun in an earlier partition, those still open
    at the end may go on in a later one: they leave in one record, without the open ones among their children, and their
    finished children name them by (pid, side, depth). A node's finished children wait for its least member, so the
    task holds one small tuple for each of its conversations at most.
    """
    stack: list[Node] = []
    left, before, first = [], None, None

    def partial(node: Node) -> tuple:
        return node.depth, node.size, node.n, node.least, node.kids, node.leaves, node.saved, _ids(node.ends)

    for conv, keys, sizes in rows:
        if before is None:
            first, shared = keys, -1
        else:
            shared = common(before, keys)
        while stack and stack[-1].depth > shared:
            node = stack.pop()
            if node.first:
                left.append(partial(node))
                continue
            row = node.finish(hashlib.sha256(_ids(node.ends)).hexdigest())
            for child in node.waiting:
                yield NODE, *child, node.least, None, None, None, None
            parent = stack[-1]
            parent.add(node.n, node.least, 1, node.leaves, node.saved)
            if parent.first:
                yield NODE, *row, None, pid, 0, parent.depth, None
            else:
                parent.waiting.append(row)
        for depth in range(shared + 1, len(keys) + 1):
            stack.append(Node(depth, sizes[depth - 1] if depth else 0, before is None))
        top = stack[-1]
        top.add(1, conv, 0, 0, 0)
        top.ends.append(conv)
        before = keys
    if before is not None:
        for node in stack:
            for child in node.waiting:
                yield NODE, *child, None, pid, 1, node.depth, None
        record = pickle.dumps((first, left, before, [partial(node) for node in stack]))
        yield PATHS, None, None, None, None, None, None, None, None, pid, None, None, record


def stitch(records):
    """Rows of the nodes that partitions left open, and the least member of each by the names they gave it.

    records: (pid, record) by pid. One stack goes over the first and last path of every partition, so the work is in the
    number of partitions, not of conversations; ids that end in an open node come as text and go into a running hash.
    """
    stack: list[Node] = []
    before = None

    def close(above: int):
        while stack and stack[-1].depth > above:
            node = stack.pop()
            row = node.finish((node.ends or hashlib.sha256()).hexdigest())
            for child in node.waiting:
                yield NODE, *child, node.least, None, None, None, None
            for ref in node.refs:
                yield "ref", None, None, None, None, None, None, None, node.least, *ref, None
            if stack:
                stack[-1].add(node.n, node.least, 1, node.leaves, node.saved)
                stack[-1].waiting.append(row)
            else:
                yield NODE, *row, None, None, None, None, None

    def take(known: dict):
        for depth, (size, n, least, kids, leaves, saved, ends) in known.items():
            node = stack[depth]
            node.add(n, least, kids, leaves, saved)
            if ends:
                if node.ends:
                    node.ends.update(b",")
                else:
                    node.ends = hashlib.sha256()
                node.ends.update(ends)

    for pid, record in records:
        first, left, last, right = pickle.loads(record)
        left, right = ({p[0]: p[1:] for p in side} for side in (left, right))
        inner = common(first, last)
        shared = -1 if before is None else common(before, first)
        yield from close(shared)
        for depth in range(shared + 1, len(first) + 1):
            stack.append(Node(depth, (left if depth > inner else right)[depth][0]))
        for depth, node in enumerate(stack):
            node.refs.append((pid, 0, depth))
        take(left)
        yield from close(inner)
        for depth in range(inner + 1, len(last) + 1):
            stack.append(Node(depth, right[depth][0]))
            stack[-1].refs.append((pid, 1, depth))
        take(right)
        before = last
    yield from close(-1)


_FIELDS = [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("pid", pa.int64()), ("side", pa.int64()), ("at", pa.int64()), ("record", pa.binary())]
_SWEPT = "kind string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, pid long, side long, at long, record binary"


def _batches(rows, most: int = 8192):
    held = []
    schema = pa.schema(_FIELDS)
    for row in rows:
        held.append(row)
        if len(held) == most or row[-1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie of the arrays of keys; arrays has conv_id (each once), keys and sizes.

    Returns, per node, conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. An empty table has no root and gives no rows; an array without keys ends in the root. Copies of one
    array are told apart by conv_id in the sort, so a group of any size is dealt out over many partitions.
    """
    spark = arrays.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def swept(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "keys", "sizes")))

        yield from _batches(sweep(rows(), TaskContext.get().partitionId()))

    def stitched(batches):
        yield from _batches(stitch((p, r) for batch in batches for p, r in zip(batch.column("pid").to_pylist(), batch.column("record").to_pylist())))

    ordered = arrays.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    local = stored(ordered.mapInArrow(swept, _SWEPT), "swept")
    paths = local.where(F.col("kind") == PATHS).select("pid", "record")
    whole = stored(paths.coalesce(1).sortWithinPartitions("pid").mapInArrow(stitched, _SWEPT), "stitched")
    refs = whole.where("kind = 'ref'").select("pid", "side", "at", F.col("parent_conv_id").alias("least"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = local.where(F.col("kind") == NODE)
    hanging = nodes.where("pid is not null").join(refs, ["pid", "side", "at"]).withColumn("parent_conv_id", F.col("least"))
    return nodes.where("pid is null").select(out).unionByName(hanging.select(out)).unionByName(whole.where(F.col("kind") == NODE).select(out))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: turn_arrays(), rebuilt() and trie() say what holds for odd rows."""
    return trie(rebuilt(turn_arrays(rows)))


#: DuckDB SQL for conversation_trie(), with crc32 bit by bit; 3988292384 is the polynomial 0xEDB88320.
TRIE_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, 0 AS step, xor(4294967295::UBIGINT, ascii(substr(c::VARCHAR, 1, 1))::UBIGINT) AS r FROM ids
  UNION ALL
  SELECT c, step + 1, xor(xor(r // 2, (r % 2) * 3988292384::UBIGINT),
    CASE WHEN (step + 1) % 8 = 0 AND (step + 1) // 8 < strlen(c::VARCHAR) THEN ascii(substr(c::VARCHAR, ((step + 1) // 8 + 1)::INT, 1))::UBIGINT ELSE 0::UBIGINT END)
  FROM crc WHERE step < 8 * strlen(c::VARCHAR)),
h AS (SELECT c, xor(r, 4294967295::UBIGINT) % 9 AS h, c - c % 5 AS base FROM crc WHERE step = 8 * strlen(c::VARCHAR)),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
re AS (
  SELECT h.c, 0 AS part, t.i, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
paths AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS size, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS p
  FROM re WINDOW w AS (PARTITION BY c ORDER BY part, i)),
points AS (SELECT c, d, size, p FROM paths UNION ALL SELECT c, 0, 0, '' FROM ids),
ends AS (SELECT c, max(d) AS d FROM points GROUP BY c),
nodes AS (
  SELECT p, points.d AS d, max(size) AS size, min(points.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(points.c::VARCHAR, ',' ORDER BY points.c) FILTER (WHERE ends.d = points.d), '')) AS ends_sha256
  FROM points JOIN ends ON ends.c = points.c GROUP BY p, points.d),
kids AS (SELECT n.p, count(k.p) AS n_children FROM nodes n LEFT JOIN nodes k ON k.d = n.d + 1 AND left(k.p, (64 * n.d)::INT) = n.p GROUP BY n.p)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, kids.n_children, sub.n_leaves, sub.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = left(n.p, (64 * (n.d - 1))::INT)
JOIN (SELECT a.p, count(*) FILTER (WHERE kb.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND left(b.p, (64 * a.d)::INT) = a.p JOIN kids kb ON kb.p = b.p GROUP BY a.p) sub ON sub.p = n.p
"""
