"""Prefix trie of conversations, built as burst tries.

A conversation is a path of turn ids. A *head* is a node of the trie known to the whole cluster; a *container* holds
the suffixes below a head. All suffixes start in the container of the root. A container of more
than ``most`` suffixes bursts by the next turn id: its head becomes an inner node, and every next turn becomes the head of a
container of its own. Equal conversations are one suffix with a weight, so copies never burst a container. When none is too
large, containers are dealt out by head, sorted and swept: a stack of open nodes yields each node when the sweep leaves it.
Burst heads then add up what their containers found, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.storage import BROADCAST_KEYS, Workspace

MOST = 4096
WIDTH = 16
#: Decimal ids joined into one piece before pieces of a node meet.
PIECE = 1 << 16

NODES = ("node string, parent string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_bytes bigint, top boolean")
_NODE_SCHEMA = pa.schema([
    ("node", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_bytes", pa.int64()), ("top", pa.bool_())])


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn, as hex digits; the role's length keeps it apart from the text."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, path) from rows of conv_id, turn, role and text: ``path`` is the array of (id, bytes) of the turns in order.

    Order is by turn, null first; equal numbers are ordered by turn id, and repeated rows are turns of their own. A null role or
    text is empty. Rows with a null conv_id belong to no conversation and are left out. Other columns are ignored. A
    conversation is one row, of about 50 bytes a turn: its texts do not travel.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct("turn", turn_id(role, text).alias("id"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    told = narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("path"))
    return told.select("conv_id", F.transform("path", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("path"))


def path_bytes() -> Column:
    return F.unhex(F.array_join(F.transform("path", lambda t: t["id"]), ""))


class Node:
    """An open node of the sweep."""

    __slots__ = ("bytes", "children", "conv", "hash", "kids", "leaves", "n", "saved")

    def __init__(self, digest: hashlib._Hash, size: int) -> None:
        self.hash, self.bytes = digest, size
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.kids: list[tuple] = []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


class Sweep:
    """One container after the other, its suffixes in order; finished nodes gather in ``out``.

    A node waits for its parent to end, since it tells the parent's smallest member. So memory is
    bounded by the longest path and the children of its nodes.
    """

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.stack: list[Node] = []
        self.head: str | None = None
        self.level = 0
        self.path = b""

    def close(self, depth: int) -> None:
        """Ends all open nodes deeper than ``depth``."""
        while self.level + len(self.stack) - 1 > depth:
            self._pop()

    def _pop(self) -> None:
        node = self.stack.pop()
        depth = self.level + len(self.stack)
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.bytes
        key = node.hash.hexdigest()
        self.out.extend((kid[0], key, kid[1], kid[2], node.conv, *kid[3:], False) for kid in node.kids)
        row = (key, depth, node.conv, node.n, node.children, leaves, saved)
        if self.stack:
            above = self.stack[-1]
            above.kids.append(row)
            above.add(node.n, node.conv)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
        else:
            parent = hashlib.md5(self.path[: WIDTH * (depth - 1)]).hexdigest() if depth else None
            self.out.append((key, parent, depth, node.conv, None, *row[3:], True))

    def end(self) -> None:
        self.close(self.level - 1)

    def add(self, head: str, level: int, path: bytes, sizes: list[int], n: int, conv: int) -> None:
        if head != self.head:
            self.end()
            self.head, self.level = head, level
            self.stack = [Node(hashlib.md5(path[: WIDTH * level]), sizes[level - 1] if level else 0)]
            shared = level
        else:
            shared, most = level, min(len(path), len(self.path)) // WIDTH
            while shared < most and path[WIDTH * shared : WIDTH * (shared + 1)] == self.path[WIDTH * shared : WIDTH * (shared + 1)]:
                shared += 1
            self.close(shared)
        self.path = path
        for d in range(shared, len(path) // WIDTH):
            digest = self.stack[-1].hash.copy()
            digest.update(path[WIDTH * d : WIDTH * (d + 1)])
            self.stack.append(Node(digest, sizes[d]))
        self.stack[-1].add(n, conv)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers; rows come by head, then path."""
    at = Sweep()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("head", "level", "path", "sizes", "n", "conv_id")), strict=True):
            at.add(*row)
            if len(at.out) >= 10_000:
                yield _batch(at.out)
                at.out = []
    at.end()
    if at.out:
        yield _batch(at.out)


def prefix_trie(paths: DataFrame, most: int = MOST) -> DataFrame:
    """All nodes of the trie over ``paths`` (conv_id, path), a row each.

    Columns: node (128 bits that name the path, as hex digits) and parent (null for the root), depth, conv_id (smallest member) and
    parent_conv_id (that of the parent), n_convs (members), n_children, n_leaves (nodes without children in the
    subtree, itself included) and saved_bytes: summed over the subtree, what storing the last turn of each node once saves.
    An empty path is a member of the root. An empty table has no nodes. conv_id is expected once a row.
    """
    space = Workspace(paths.sparkSession)
    each = paths.select("conv_id", path_bytes().alias("path"), F.transform("path", lambda t: t["bytes"]).alias("sizes"))
    # Equal conversations meet map-side, so thousands of copies reach a reducer as a row a task.
    left = space.keep(each.groupBy("path", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")), "suffixes")
    containers: list[DataFrame] = []
    burst: list[DataFrame] = []
    while True:
        level = len(burst)
        labelled = left.withColumns({"head": F.md5(F.substring("path", 1, WIDTH * level)), "level": F.lit(level)})
        above, size = (F.md5(F.substring("path", 1, WIDTH * (level - 1))), F.get("sizes", F.lit(level - 1))) if level else (F.lit(None).cast("string"), F.lit(0))
        met = labelled.groupBy("head").agg(
            F.count(F.lit(1)).alias("rows"), F.max(above).alias("parent"), F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"), F.max(size).cast("bigint").alias("bytes"))
        full = space.keep(met.where(F.col("rows") > most).drop("rows"), "heads")
        n_full = full.count()
        if not n_full:
            containers.append(labelled)
            break
        # At most a head for every `most` suffixes; a list that is too long to send is shuffled.
        heads = full.select("head")
        heads = F.broadcast(heads) if n_full <= BROADCAST_KEYS else heads
        containers.append(labelled.join(heads, "head", "left_anti"))
        burst.append(full)
        left = space.keep(left.join(heads, F.md5(F.substring("path", 1, WIDTH * level)) == heads["head"], "left_semi").where(F.octet_length("path") > WIDTH * level), "suffixes")
    swept = containers[0]
    for c in containers[1:]:
        swept = swept.unionByName(c)
    swept = space.keep(swept.repartition("head").sortWithinPartitions("head", "path").mapInArrow(sweep, NODES), "nodes")
    if not burst:
        return swept.drop("top")
    tops = swept.where("top")
    below = tops.where(F.col("depth") == len(burst)).select("parent", "n_leaves", "saved_bytes")
    inner: DataFrame | None = None
    for level in range(len(burst) - 1, -1, -1):
        sums = below.groupBy(F.col("parent").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_bytes").alias("below"))
        done = space.keep(burst[level].join(sums, "head").select(
            F.col("head").alias("node"), "parent", F.lit(level).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_bytes")), "inner")
        inner = done if inner is None else inner.unionByName(done)
        below = tops.where(F.col("depth") == level).unionByName(done, allowMissingColumns=True).select("parent", "n_leaves", "saved_bytes")
    known = inner.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    waiting = tops.drop("parent_conv_id", "top").unionByName(inner)
    return swept.where(~F.col("top")).drop("top").unionByName(waiting.join(known, "parent", "left"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending ids of a node as comma-joined pieces (node, first, n, ids)."""
    out: list[tuple] = []
    node, ids = None, []
    for batch in batches:
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != node or len(ids) >= PIECE:
                if ids:
                    out.append((node, ids[0], len(ids), ",".join(map(str, ids))))
                node, ids = key, []
            ids.append(conv)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pydict(dict(zip(("node", "first", "n", "ids"), map(list, zip(*out, strict=True)), strict=True)))
            out = []
    if ids:
        out.append((node, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("node", "first", "n", "ids"), map(list, zip(*out, strict=True)), strict=True)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n_ends, ends_sha256) from pieces in order; only the running digest is held."""
    node, n, digest = None, 0, hashlib.sha256()
    for batch in batches:
        out = []
        for key, count, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "ids")), strict=True):
            if key != node:
                if node is not None:
                    out.append((node, n, digest.hexdigest()))
                node, n, digest = key, 0, hashlib.sha256()
            digest.update(("," if n else "").encode() + ids.encode())
            n += count
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("node", "n_ends", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "n_ends": [n], "ends_sha256": [digest.hexdigest()]})


def endings(paths: DataFrame) -> DataFrame:
    """(node, n_ends, ends_sha256): conversations that end at a node, and the digest of their ids, ascending, joined by commas.

    Ids are sorted in ranges over all partitions, however many conversations are equal; a node's task gets a piece for
    every 65,536 of them. The digest itself is a chain by nature, so that task reads its pieces one after the other.
    """
    rows = paths.select(F.md5(path_bytes()).alias("node"), "conv_id")
    ranged = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "node string, first bigint, n bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node string, n_ends bigint, ends_sha256 string")
