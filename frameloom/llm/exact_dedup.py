"""Exact deduplication: Patricia-trie owners over length-and-content-hash partitions."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty. Only runs that change are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


#: Bytes that a node of a trie takes besides its label, about.
NODE_BYTES = 400


class Trie:
    """A compressed radix trie of byte strings. A terminal holds [least id, rows with it, rows, hash, text_sha256].

    A node is [label, children by first byte, terminal]. Ids order null last. size: bytes held, about.
    """

    __slots__ = ("root", "size")

    def __init__(self):
        self.root = [b"", {}, None]
        self.size = 0

    def insert(self, text: bytes, least: int | None, n_least: int, n: int, key: int, sha: str) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, [least, n_least, n, key, sha]]
                self.size += len(text) - at + NODE_BYTES
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            # the string leaves the edge inside its label: cut the edge there
            shared = len(os.path.commonprefix([label, text[at : at + len(label)]]))
            upper = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][text[at]] = upper
            node, at = upper, at + shared
            self.size += NODE_BYTES
        own = node[2]
        if own is None:
            node[2] = [least, n_least, n, key, sha]
            return
        own[2] += n
        if own[0] == least:
            own[1] += n_least
        elif own[0] is None or least is not None and least < own[0]:
            own[:2] = least, n_least

    def terminals(self, node: list | None = None, above: bytes = b""):
        """(text, *terminal) of every string, or of those of the subtree of a node under the string above."""
        todo = [(above, node or self.root)]
        while todo:
            above, node = todo.pop()
            text = above + node[0]
            if node[2] is not None:
                yield text, *node[2]
            todo.extend((text, child) for child in node[1].values())

    def spill(self, down_to: int):
        """Cut off subtrees, the largest first, until about down_to bytes are left; their strings."""
        sizes = {first: _bytes(child) for first, child in self.root[1].items()}
        for first in sorted(sizes, key=lambda f: -sizes[f]):
            if self.size <= down_to:
                break
            yield from self.terminals(self.root[1].pop(first))
            self.size -= sizes[first]


def _bytes(node: list) -> int:
    size, todo = 0, [node]
    while todo:
        node = todo.pop()
        size += len(node[0]) + NODE_BYTES
        todo.extend(node[1].values())
    return size


_PARTS = pa.schema([("text", pa.binary()), ("id", pa.int64()), ("n_keep", pa.int64()), ("n", pa.int64()), ("hash", pa.int64()), ("sha", pa.string())])
_OWNERS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("group_size", pa.int64())])


def _batches(rows, schema: pa.Schema, most_bytes: int = 4 << 20):
    """Rows as batches of about most_bytes of their first column."""
    found, size = [], 0
    for row in rows:
        found.append(row)
        size += len(row[0]) + 64
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found, size = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_bytes: int = 16 << 20) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, n_keep (rows with that id), group_size.

    Each input partition inserts its full strings into a trie of each length class (half as many bytes to twice as many),
    in which like beginnings are stored once, and hands on one row per distinct string, so a text that fills the table
    leaves each partition once. A partition whose tries hold over held_bytes spills subtrees, the largest first, into the
    shuffle. There the rows are dealt out by length and content hash, and come to a task in that order; it inserts them
    into a trie, full strings deciding what is equal. What has another length or hash than the row at hand is settled, so
    a trie over held_bytes hands all but that on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("text"))

    def combine(batches):
        tries: dict[int, Trie] = {}

        def spilt():
            held = 0
            for batch in batches:
                ids, sizes, hashes, shas = (batch.column(c).to_pylist() for c in ("id", "size", "hash", "sha"))
                texts = batch.column("text")
                for k in range(len(ids)):
                    trie = tries.setdefault(sizes[k].bit_length(), Trie())
                    held -= trie.size
                    trie.insert(texts[k].as_py(), ids[k], 1, 1, hashes[k], shas[k])
                    held += trie.size
                    if held > held_bytes:
                        largest = max(tries.values(), key=lambda t: t.size)
                        yield from largest.spill(largest.size // 2)
                        held = sum(t.size for t in tries.values())
            for trie in tries.values():
                yield from trie.terminals()

        yield from _batches(spilt(), _PARTS)

    def settle(batches):
        def settled():
            key, trie = None, Trie()
            for batch in batches:
                hashes, ids, keeps, ns, shas = (batch.column(c).to_pylist() for c in ("hash", "id", "n_keep", "n", "sha"))
                texts = batch.column("text")
                for k in range(len(ids)):
                    text = texts[k].as_py()
                    if trie.size > held_bytes and (len(text), hashes[k]) != key:
                        yield from trie.terminals()
                        trie = Trie()
                    key = (len(text), hashes[k])
                    trie.insert(text, ids[k], keeps[k], ns[k], hashes[k], shas[k])
            yield from trie.terminals()

        yield from _batches(((sha, least, n_least, n) for _, least, n_least, n, _, sha in settled()), _OWNERS, 1 << 20)

    parts = rows.mapInArrow(combine, "text binary, id long, n_keep long, n long, hash long, sha string")
    size = F.octet_length("text")
    parts = parts.repartition(size, "hash").sortWithinPartitions(size, "hash")
    return parts.mapInArrow(settle, "text_sha256 string, keep_id long, n_keep long, group_size long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal normalised text, the one with the least id stays: id, keep_id, group_size, kept, text_sha256.

    One row per input row, dropped ones too. Null texts count as empty, and empty texts are equal to each other. A null
    id loses against any other. If rows repeat the least id with the same text, one of them stays. An empty table gives
    no rows; other columns are ignored. The join back to the rows is by the SHA-256 of the normalised text; that full
    strings are equal where it is, the tries have seen to.
    """
    owned = stored(owners(docs, id_col, text_col), "owners")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    joined = rows.join(owned, "text_sha256")
    least = F.col("id").eqNullSafe(F.col("keep_id"))
    out = lambda df, kept: df.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    if owned.where("n_keep > 1").isEmpty():
        return out(joined, least)
    tied = least & (F.col("n_keep") > 1)
    first = F.row_number().over(Window.partitionBy("text_sha256", "id").orderBy("group_size")) == 1
    return out(joined.where(~tied), least).unionByName(out(joined.where(tied), first))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs; one of each normalised text, nulls and empty texts being one.

    Ids decide as in dedup(): a null id loses against any other, and one of repeated rows stays.
    """
    owned = stored(owners(docs, id_col, text_col), "owners")
    # a row in one column, so that no name of docs clashes with another
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.sha2(normalised(docs[text_col]), 256).alias("text_sha256"))
    rows = at.join(owned, "text_sha256").where(F.col("id").eqNullSafe(F.col("keep_id")))
    if owned.where("n_keep > 1").isEmpty():
        return rows.select("row.*")
    one = rows.where("n_keep > 1").groupBy("text_sha256").agg(F.first("row").alias("row"))
    return rows.where("n_keep = 1").select("row.*").unionByName(one.select("row.*"))
