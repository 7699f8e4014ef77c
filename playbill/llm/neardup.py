"""Near-duplicate documents: MinHash, banding, signature checks, exact links, components.

1. Every text becomes its set of distinct word shingles, a hash of the set, and the
   minima of HASHES universal hash functions. Equal sets collapse into one node.
2. ROWS minima form a band; nodes that agree in a band share a bucket. A pair of the
   threshold's similarity misses all BANDS buckets with probability 1e-6.
3. In a bucket, signatures unite nodes that may be similar into families. This keeps a
   forest and no pairs; it may unite too much, never too little.
4. In a family the full sets are compared, all of them, by matrix products over shared
   shingles, in blocks of bounded size. Again a forest of the links is kept.
5. Large-star and small-star turn links into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.components import components
from playbill.llm.storage import Workspace, among
from playbill.llm.words import LOWER, U64, Words, chunks, constants, mix, shingle_sets

SHINGLE, ROWS, BANDS = 5, 5, 52
HASHES = ROWS * BANDS
MULTIPLIERS, ADDENDS = constants(HASHES, 11) | U64(1), constants(HASHES, 12)
BLOCK = 1024
#: Signatures of 260 minima err by less than 0.15 in all but one of a million pairs.
SLACK = 0.15


def sign(batches: Iterator[pa.RecordBatch], k: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set_a, set_b, minima) of (doc_id, text); the minima keep 16 bits each, null without shingles."""
    for batch in batches:
        counts, marks, minima = [], [], []
        for _, data, offsets in chunks(batch.column("text")):
            hashes, at = Words(data, offsets, LOWER).shingles(k)
            full = np.flatnonzero(np.diff(at))
            out = np.zeros((len(at) - 1, HASHES), np.uint16)
            if len(full):
                scratch = np.empty_like(hashes)
                for i in range(HASHES):
                    np.multiply(hashes, MULTIPLIERS[i], out=scratch)
                    np.add(scratch, ADDENDS[i], out=scratch)
                    # The least of many hashes has few top bits left, so 16 bits of its own hash tell long texts apart.
                    out[full, i] = mix(np.minimum.reduceat(scratch, at[full])) >> U64(48)
            for i in range(len(at) - 1):
                own = np.unique(hashes[at[i] : at[i + 1]])
                counts.append(len(own))
                marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                minima.append(out[i].tobytes() if len(own) else None)
        pair = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(minima, pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "minima"])


def _nibbles(minima: np.ndarray) -> np.ndarray:
    """The lowest four bits of each minimum: enough to estimate similarity, an eighth of the size."""
    return (minima & 15).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures (rows of four-bit values): agreement less what chance agrees."""
    return ((a == b).mean(axis=-1) - 1 / 16) / (15 / 16)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        marks = np.stack([t.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = t.slice(start, end - start)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def bucket_edges(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Families within a bucket: edges (u, v) of a forest; for split buckets also nodes that must meet the other parts.

    A pivot takes in all nodes at a distance of at most 0.5. A node left out can only be similar to a
    node taken in if their distances to the pivot differ by at most 1 - threshold, so only those
    pairs are compared. Then the next pivot takes its turn among the nodes left. The pivot of a
    split bucket stands in all parts and takes in every node that could be similar to one within 0.5 of
    it; the few others (v null) meet each other afterwards, and in ``left_out_edges`` the nodes taken in.
    """
    most = 1 - threshold + SLACK
    u, v, key, sig = [], [], [], []
    for t in _runs(batches, ["key", "part"]):
        ids = t.column("id").to_numpy()
        packed = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        rows = np.concatenate([packed & 15, packed >> 4], axis=1)
        split = bool(t.column("split")[0].as_py())
        order = np.argsort(ids)
        left = order
        while len(left) > 1:
            pivot, others = left[0], left[1:]
            far = 1 - estimate(rows[others], rows[pivot])
            near = far <= (0.5 + most if split else 0.5)
            u += ids[others[near]].tolist()
            v += [ids[pivot]] * int(near.sum())
            rest, taken = others[~near], others[near]
            if split:
                for y in rest:
                    key.append(int(t.column("key")[0].as_py()))
                    sig.append((len(u), packed[y].tobytes()))
                    u.append(int(ids[y]))
                    v.append(None)
                break
            for y, d in zip(rest, far[~near], strict=True):
                close = taken[far[near] >= d - most]
                fits = close[1 - estimate(rows[close], rows[y]) <= most] if len(close) else close
                if len(fits):
                    u.append(int(ids[y]))
                    v.append(int(ids[fits[0]]))
            left = rest
        if len(u) > 100_000:
            yield _edge_batch(u, v, key, sig)
            u, v, key, sig = [], [], [], []
    yield _edge_batch(u, v, key, sig)


def left_out_edges(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from the nodes that a split bucket left out (``out``, in all its parts) to a similar node that a part took in.

    Only nodes taken in beyond 0.5 can be similar to one left out.
    """
    most = 1 - threshold + SLACK
    u, v = [], []
    for t in _runs(batches, ["key", "part"]):
        ids, out = t.column("id").to_numpy(), t.column("out").to_numpy()
        packed = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        rows = np.concatenate([packed & 15, packed >> 4], axis=1)
        pivot = np.flatnonzero(out == 0)[ids[out == 0].argmin()]
        far = 1 - estimate(rows, rows[pivot])
        taken = np.flatnonzero((out == 0) & (far > 0.5) & (far <= 0.5 + most))
        for y in np.flatnonzero(out == 1):
            close = taken[far[taken] >= far[y] - most]
            fits = close[1 - estimate(rows[close], rows[y]) <= most] if len(close) else close
            if len(fits):
                u.append(int(ids[y]))
                v.append(int(ids[fits[0]]))
        if len(u) > 100_000:
            yield _edge_batch(u, v, [], [])
            u, v = [], []
    yield _edge_batch(u, v, [], [])


def _edge_batch(u: list, v: list, key: list, sig: list) -> pa.RecordBatch:
    keys, sigs = [None] * len(u), [None] * len(u)
    for k, (i, s) in zip(key, sig, strict=True):
        keys[i], sigs[i] = k, s
    return pa.RecordBatch.from_arrays(
        [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())], names=["u", "v", "key", "sig"])


def exact_links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, within: bool) -> Iterator[tuple[int, int]]:
    """A forest of the pairs with den * intersection >= num * union, by exact counts of shared shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if den * common >= num * (sizes.sum() - common) and (within or side[0] != side[1]):
            yield 0, 1
        return
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        dense = np.zeros((n, width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - start] = 1
        common += dense @ dense.T
    linked = (den + num) * common.astype(np.int64) >= num * (sizes[:, None] + sizes[None, :])
    if not within:
        linked &= side[:, None] != side[None, :]
    fresh = np.ones(n, bool)
    for i in range(n):
        waiting = [i] if fresh[i] else []
        fresh[i] = False
        while waiting:
            at = waiting.pop()
            reached = np.flatnonzero(linked[at] & fresh)
            fresh[reached] = False
            for j in reached.tolist():
                yield at, j
                waiting.append(j)


def family_links(batches: Iterator[pa.RecordBatch], num: int, den: int, k: int) -> Iterator[pa.RecordBatch]:
    """(u, v) links of each task (family, x, y) over its (id, side, text)."""
    u, v = [], []
    for t in _runs(batches, ["family", "x", "y"]):
        ids = t.column("id").to_numpy()
        sets = list(shingle_sets(t.column("text").combine_chunks(), k))
        side = t.column("side").to_numpy()
        within = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        for i, j in exact_links(sets, side, num, den, within):
            u.append(int(ids[i]))
            v.append(int(ids[j]))
        if len(u) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a key side by side in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def _bucket_members(nodes: DataFrame, space: Workspace) -> DataFrame:
    """(key, id, pivot, n) of buckets with two nodes or more."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("minima", b * 2 * ROWS + 1, F.lit(2 * ROWS))))
    rows = nodes.select("id", F.explode(bands).alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return space.keep(rows.join(shared, "key"), "members")


def _many() -> Column:
    return F.ceil(F.col("n") / (4 * BLOCK)).cast("int")


def _bucket_parts(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, part, split, id, sig); large buckets in parts that share the pivot."""
    whole = members.withColumn("split", _many() > 1)
    own = whole.where("id != pivot").select("key", F.pmod(F.xxhash64("id"), _many()).cast("int").alias("part"), "split", "id")
    pivots = whole.where("id = pivot").select("key", F.explode(F.sequence(F.lit(0), _many() - 1)).alias("part"), "split", "id")
    packed = nodes.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_pack, "id bigint, sig binary")
    return own.union(pivots).join(packed, "id").select("key", "part", "split", "id", "sig")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = _nibbles(np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint16).reshape(-1, HASHES))
        half = HASHES // 2
        both = low[:, :half] | (low[:, half:] << 4)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in both], pa.binary())], names=["id", "sig"])


def _families(nodes: DataFrame, threshold: float, space: Workspace) -> DataFrame:
    """(id, component) of the nodes that have a possible partner."""
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucket_edges(batches, threshold)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return left_out_edges(batches, threshold)

    schema = "u bigint, v bigint, key bigint, sig binary"
    members = _bucket_members(nodes, space)
    found = space.keep(_grouped(_bucket_parts(members, nodes), ["key", "part"]).mapInArrow(edges, schema), "bucket-edges")
    links = found.where("v IS NOT NULL").select("u", "v")
    later = found.where("v IS NULL")
    if later.limit(1).count():
        whole = later.select("key", F.lit(0).alias("part"), F.lit(False).alias("split"), F.col("u").alias("id"), "sig")
        links = links.union(_grouped(whole, ["key", "part"]).mapInArrow(edges, schema).select("u", "v"))
        parts = members.where("id = pivot").select("key", F.explode(F.sequence(F.lit(0), _many() - 1)).alias("part"))
        outside = later.select("key", F.col("u").alias("id"), "sig").join(parts, "key").select("key", "part", F.lit(1).alias("out"), "id", "sig")
        inside = _bucket_parts(members.join(later.select("key").distinct(), "key", "left_semi"), nodes).select("key", "part", F.lit(0).alias("out"), "id", "sig")
        links = links.union(_grouped(inside.union(outside), ["key", "part"]).mapInArrow(meet, schema).select("u", "v"))
    return components(links.distinct(), space)


def _weight() -> Column:
    return F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_shingles") / 1000))


def _tasks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(family, x, y, side, id): what each comparison task needs.

    A family of up to 2 * BLOCK nodes is one task. A larger one is cut by size class, so that nodes whose sizes
    alone rule out a link do not meet, and each class into blocks; every two blocks that may hold a link are a task.
    """
    # A thousand shingles weigh like a node, so long texts make smaller blocks.
    family = members.groupBy("family").agg(_weight().alias("size"))
    sized = members.join(family, "family")
    small = sized.where(F.col("size") <= 2 * BLOCK).select("family", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "id")
    cls = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num) + 1e-9).cast("int")
    large = sized.where(F.col("size") > 2 * BLOCK).select("family", "id", "n_shingles", cls.alias("cls"))
    counted = large.groupBy("family", "cls").agg(F.ceil(_weight() / BLOCK).cast("int").alias("blocks"))
    placed = large.join(counted, ["family", "cls"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    number = lambda c, b: c * 1_000_000 + b
    here = number(F.col("cls"), F.col("block"))
    same = placed.select("family", "id", here.alias("own"), F.explode(F.sequence(number(F.col("cls"), F.lit(0)), number(F.col("cls"), F.col("blocks") - 1))).alias("other"))
    steps = counted.select("family", F.col("cls").alias("_c"), F.col("blocks").alias("_b"))
    near = placed.join(steps, "family").where(F.abs(F.col("cls") - F.col("_c")) == 1).select(
        "family", "id", here.alias("own"), F.explode(F.sequence(number(F.col("_c"), F.lit(0)), number(F.col("_c"), F.col("_b") - 1))).alias("other"))
    cut = same.union(near).select(
        "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id")
    return small.union(cut)


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    A document's set is its distinct k-word shingles, A-Z as small letters; fewer words are one shingle;
    without words, or with a null text, the set is empty and linked with nothing. Two documents are
    linked if den * intersection >= num * union; ``component_id`` is the smallest doc_id that
    links reach, itself included, and ``kept`` marks that document. Rows with a null doc_id are
    linked with nothing, have a null component and are kept. Rows that share a doc_id are one document
    with several texts: all their links count. Other columns are ignored. An empty table gives an
    empty result.
    """
    space = Workspace(docs.sparkSession)
    signed = space.keep(docs.select("doc_id", "text").mapInArrow(
        lambda b: sign(b, k), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, minima binary"), "signed")
    mark = ["set_a", "set_b", "n_shingles"]
    # Stored, so that joins with it read both sides from a shuffle and can split a set that very many documents have.
    first = space.keep(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*mark).agg(F.min("doc_id").alias("id")), "first")
    nodes = space.keep(signed.join(first.withColumnRenamed("id", "doc_id"), [*mark, "doc_id"], "left_semi").select(
        F.col("doc_id").alias("id"), "n_shingles", "minima"), "nodes")
    families = _families(nodes, num / den, space)
    family_of = families.union(families.select(F.col("component").alias("id"), "component").distinct())
    members = space.keep(nodes.select("id", "n_shingles").join(family_of, "id").select(
        F.col("component").alias("family"), "id", "n_shingles"), "families")
    texts = among(docs.select(F.col("doc_id").alias("id"), "text"), members.select("id").distinct(), "left_semi")
    tasks = _tasks(members, num, den).join(texts, "id").select("family", "x", "y", "side", "id", "text")
    links = space.keep(_grouped(tasks, ["family", "x", "y"]).mapInArrow(lambda b: family_links(b, num, den, k), "u bigint, v bigint"), "links")
    equal = signed.join(first, mark).select(F.col("doc_id").alias("u"), F.col("id").alias("v")).where("u != v").distinct()
    found = components(links.union(equal), space)
    own = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    label = own.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return label.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, k: int = SHINGLE) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; rows with a null doc_id stay."""
    found = near_duplicates(docs, num, den, k).where("NOT kept").select("doc_id").distinct()
    return among(docs, Workspace(docs.sparkSession).keep(found, "gone"), "left_anti").select(docs.columns)
