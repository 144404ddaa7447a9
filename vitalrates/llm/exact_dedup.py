"""Exact duplicates: partitions by length and content hash insert whole byte strings into compressed radix tries.

Each terminal node holds the owner (smallest or largest identifier) and the number of texts that ended there. Tries are
built twice: on the tasks that read, so that a text which fills a third of the table travels once per task, and on the
tasks that own a length and hash. A trie that outgrows its bound spills its largest subtree downstream as finished
terminals; the last grouping merges whatever was spilled in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import id_and_text

SPILL_BYTES = 64_000_000


class _Node:
    __slots__ = ("label", "children", "owner", "copies")

    def __init__(self, label: bytes, owner: int | None = None, copies: int = 0):
        self.label, self.children, self.owner, self.copies = label, {}, owner, copies


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of `label` and `key[at:]`, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to (owner, copies); `choose` is min or max of two owners."""

    def __init__(self, choose=min):
        self.root, self.choose, self.held = _Node(b""), choose, 0

    def insert(self, key: bytes, owner: int | None, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner, copies)
                self.held += len(key) - at
                return
            if not key.startswith(child.label, at):
                cut = _shared(child.label, key, at)
                middle = _Node(child.label[:cut])
                child.label = child.label[cut:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = child = middle
            at += len(child.label)
            node = child
        known = [x for x in (node.owner if node.copies else None, owner) if x is not None]
        node.owner = self.choose(known) if known else None
        node.copies += copies

    def terminals(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.copies:
                yield key, node.owner, node.copies
            stack.extend((child, key) for child in node.children.values())

    def _bytes_below(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label)
            stack.extend(node.children.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the largest subtree below the first branching and give its terminals."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and next(iter(node.children.values())).children:
            node = next(iter(node.children.values()))
            prefix += node.label
        key, child = max(node.children.items(), key=lambda x: self._bytes_below(x[1]))
        del node.children[key]
        self.held -= self._bytes_below(child)
        yield from self.terminals(child, prefix)


def _own(rows: Iterator[tuple[bytes, int | None, int]], choose, spill_bytes: int) -> Iterator[tuple]:
    trie = PatriciaTrie(choose)
    for key, owner, copies in rows:
        trie.insert(key, owner, copies)
        while trie.held > spill_bytes:
            yield from trie.spill()
    yield from trie.terminals()


def _batched(rows: Iterator[tuple], names: list[str], types: list, most: int = 4_000_000):
    """Arrow batches of about `most` bytes of text."""
    import pyarrow as pa

    schema = pa.schema(list(zip(names, types)))
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)


def exact_owners(docs: DataFrame, keep: str = "smallest", spill_bytes: int = SPILL_BYTES, **columns) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size.

    `keep` is "smallest" or "largest" doc_id. NULL texts are empty texts. NULL ids count in group_size and own a text only
    when no other id does. An empty table gives no rows.
    """
    choose = {"smallest": min, "largest": max}[keep]

    def local(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(),
                               [1] * batch.num_rows)

        def out():
            for key, owner, copies in _own(rows(), choose, spill_bytes):
                yield len(key), hashlib.sha256(key).hexdigest(), key, owner, copies

        yield from _batched(out(), ["bytes", "text_sha256", "body", "owner", "copies"],
                            [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()])

    def owned(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column("body").to_pylist(), batch.column("owner").to_pylist(),
                               batch.column("copies").to_pylist())

        def out():
            for key, owner, copies in _own(rows(), choose, spill_bytes):
                yield hashlib.sha256(key).hexdigest(), owner, copies

        yield from _batched(out(), ["text_sha256", "owner", "copies"], [pa.string(), pa.int64(), pa.int64()])

    base = id_and_text(docs, **columns)
    sent = base.mapInArrow(local, "bytes long, text_sha256 string, body binary, owner long, copies long")
    merged = sent.repartition("bytes", "text_sha256").mapInArrow(owned, "text_sha256 string, owner long, copies long")
    best = F.min("owner") if keep == "smallest" else F.max("owner")
    return merged.groupBy("text_sha256").agg(best.alias("keep_id"), F.sum("copies").alias("group_size"))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", spill_bytes: int = SPILL_BYTES, **columns) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat a doc_id and its text count one by one and share one verdict. A row without a doc_id is kept only
    when its whole group has none. Extra columns of the input are ignored.
    """
    owners = exact_owners(docs, keep, spill_bytes, **columns)
    rows = id_and_text(docs, **columns).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(owners, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
