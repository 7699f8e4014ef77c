"""Exact removal of long repeated strings over a sparse enhanced suffix array.

Any 200-byte string holds an anchor: the start of the 32 bytes whose hash is least
among its 169 positions. Equal strings hold the same anchor at the same place, so
suffixes that begin at anchors are enough to find every repeat.

1. Anchors of all texts are counted by hash; those that occur once are done with.
2. Anchors whose whole surroundings (every 200-byte string that holds them) equal
   another's are repeated throughout: one row stands for each class of equal ones.
3. What is left, anchors that agree but whose surroundings differ, is sorted per
   anchor into a suffix array with common-prefix lengths. A stack scan yields its
   interval tree. In each interval the texts to the left are compared: where they
   differ the repeat cannot be extended, and every occurrence gets its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.llm.storage import Workspace, among, clean_columns
from playbill.llm.words import U64, chunks, constants, mix, prefix_sums

GRAM, LENGTH = 32, 200
PIECE, HOT, BAND = 4 << 20, 20_000, 8
#: At most so many segments' bands, some 400 bytes each, are sent to every task.
WANTED = 50_000
COLUMNS = ["a", "part", "left", "seg", "key", "pos", "n"]
LEFT_MIX, RIGHT_MIX = constants(2, 21)


def sliding(values: np.ndarray, width: int, reduce: np.ufunc) -> np.ndarray:
    """reduce over each run of ``width`` values, by prefixes and suffixes of blocks of that width."""
    n = len(values)
    pad = -n % width
    neutral = np.iinfo(np.uint64).max if reduce is np.minimum else 0
    blocks = np.concatenate([values, np.full(pad, neutral, U64)]).reshape(-1, width)
    before = reduce.accumulate(blocks, axis=1).ravel()
    after = reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(after[: n - width + 1], before[width - 1 : n])


def anchor_rows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, position, hash, hash of the surroundings, bytes to the right) of the anchors of a chunk."""
    width = length - gram + 1
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(U64), empty.view(U64), empty
    sums, down = prefix_sums(data)
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) | U64(1)
    least = sliding(hashes, width, np.minimum)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.arange(len(least)) + length <= doc_end[: len(least)]
    least[~valid] = 0
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    at = np.flatnonzero(sliding(padded, width, np.maximum) == hashes)
    doc = np.searchsorted(offsets, at, "right") - 1
    begin, end = offsets[doc], offsets[doc + 1]
    left, right = np.minimum(at - begin, length - gram), np.minimum(end - at, length)
    around = mix((sums[at + right] - sums[at - left]) * down[at - left] + left.astype(U64) * LEFT_MIX + right.astype(U64) * RIGHT_MIX)
    return doc, at - begin, hashes[at], around, right


def anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(a, around, key, pos, right) of (key, text). Texts longer than PIECE are read in overlapping pieces."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for first, data, offsets in chunks(batch.column("text")):
            if len(data) > PIECE and len(offsets) == 2:
                found = _long_anchors(data, length, gram)
            else:
                found = anchor_rows(data, offsets, length, gram)
            doc, pos, a, around, right = found
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(around.view(np.int64)), pa.array(keys[first + doc]), pa.array(pos.astype(np.int32)), pa.array(right.astype(np.int16))],
                names=["a", "around", "key", "pos", "right"])


def _long_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """As ``anchor_rows`` for one text. A piece's margin holds the surroundings of its anchors, and anchors two pieces share count once."""
    parts, seen, margin = [], -1, 2 * length
    for start in range(0, len(data), PIECE):
        lo, hi = max(0, start - margin), min(len(data), start + PIECE + margin)
        _, pos, a, around, right = anchor_rows(data[lo:hi], np.array([0, hi - lo]), length, gram)
        pos = pos + lo
        inside = (pos >= start) & (pos < start + PIECE) & (pos > seen)
        parts.append((pos[inside], a[inside], around[inside], right[inside]))
    pos, a, around, right = (np.concatenate(c) for c in zip(*parts, strict=True))
    return np.zeros(len(pos), np.int64), pos, a, around, right


def common(x: bytes, y: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
    return int(differ.argmax())


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the texts, common-prefix length of each with the one before it; 0 first)."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return np.array(order), np.array([0] + [common(texts[i], texts[j]) for i, j in zip(order, order[1:], strict=False)])


def intervals(prefix: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the interval tree's nodes of depth at least ``least``, children before parents."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*prefix[1:].tolist(), 0]):
        first = i
        while stack and stack[-1][1] > depth:
            first, top = stack.pop()
            if top >= least:
                yield first, i, top
        if depth > 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def longest_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right) of each member's repeats of at least ``length`` bytes.

    ``lefts`` are reversed. An interval of depth r holds the members that agree for r bytes from the anchor on. Sorted by
    what stands to the left, a member agrees furthest with a neighbour; where the members of an interval
    differ to the left, each gets its own furthest agreement l, and l + r bytes are a repeat that cannot be
    extended within the interval. A repeat inside one that the member already has is left out.
    """
    if len(rights) == 2:
        r, l = common(*rights), common(*lefts)
        if l + r >= length:
            yield 0, l, r
            yield 1, l, r
        return
    order, prefix = suffix_array(rights)
    by_left, agree = suffix_array(lefts)
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    furthest = np.full(len(order), -1)
    longest_left = max(map(len, lefts))
    for first, last, depth in intervals(prefix, length - longest_left):
        members = order[first : last + 1]
        ranks = np.sort(rank[members])
        between = np.minimum.reduceat(agree, ranks[:-1] + 1) if len(ranks) > 1 else np.zeros(0, np.int64)
        # reduceat's last run goes on to the end; cut it at the last member.
        between[-1] = agree[ranks[-2] + 1 : ranks[-1] + 1].min()
        best = np.maximum(np.concatenate([[0], between]), np.concatenate([between, [0]]))
        for k, l in zip(by_left[ranks].tolist(), best.tolist(), strict=True):
            if l + depth >= length and l > furthest[k]:
                furthest[k] = l
                yield k, l, depth


def repeat_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, start, end) of the repeats found in each group (a, part), for members that are alone in their class."""
    key, start, end = [], [], []
    for rows in _groups(batches):
        lefts = [seg[:left][::-1] for left, seg, _, _, _ in rows]
        rights = [seg[left:] for left, seg, _, _, _ in rows]
        for k, l, r in longest_repeats(lefts, rights, length):
            if rows[k][4] == 1:
                key.append(rows[k][2])
                start.append(rows[k][3] - l)
                end.append(rows[k][3] + r)
        if len(key) > 100_000:
            yield _spans(key, start, end)
            key, start, end = [], [], []
    yield _spans(key, start, end)


def _spans(key: list[int], start: list[int], end: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["key", "start", "end"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (left, seg, key, pos, n) of each (a, part), of batches sorted by them; groups of one are skipped."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in COLUMNS]
        for a, part, *row in zip(*columns, strict=True):
            if (a, part) != now:
                if len(held) > 1:
                    yield held
                now, held = (a, part), []
            held.append(tuple(row))
    if len(held) > 1:
        yield held


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_bytes, n_removed, n_spans and the bytes that stay, given text and spans."""
    for batch in batches:
        texts, spans = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist(), batch.column("_spans").to_pylist()
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_bytes": []}
        for text, own in zip(texts, spans, strict=True):
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in own or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["n_spans"].append(len(runs))
            out["kept_bytes"].append(b"".join([*kept, text[at:]]))
        names = [c for c in batch.schema.names if c not in ("_spans", "_key")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_bytes"], pa.binary())],
            names=[*names, *out])


def _grouped(df: DataFrame, *keys: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes``, the UTF-8 bytes that stay.

    Every byte goes that lies in a string of ``length`` bytes which starts at another place too, in any
    document; all strings are judged on the input. Matches never cross documents. A null text is empty, and
    texts shorter than ``length`` stay. ``n_spans`` counts maximal removed runs. Every row is a document of
    its own, so a row that is there twice repeats itself; a null doc_id is an id like others. Input
    columns of the added names are dropped. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession)
    kept = clean_columns(docs, ["n_bytes", "n_removed", "n_spans", "kept_bytes", "_key", "_spans"])
    base = docs.select(*kept, F.xxhash64("doc_id", "text").alias("_key"))
    texts = base.select(F.col("_key").alias("key"), "text").where(F.octet_length("text") >= length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return anchors(batches, length, gram)

    found = texts.mapInArrow(scan, "a bigint, around bigint, key bigint, pos int, right smallint")
    # Stored, so that the join below reads both sides from a shuffle and can split the rows of a hot anchor.
    twice = space.keep(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "twice")
    repeated = space.keep(found.join(twice, "a"), "repeated")
    classes = space.keep(repeated.groupBy("a", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min_by("pos", "key").alias("pos")), "classes")
    reach = length - gram
    span = [F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + F.col("right")).alias("end")]
    full = repeated.join(classes.where("n > 1").select("a", "around"), ["a", "around"]).select("key", *span)
    several = space.keep(classes.groupBy("a").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "several")
    mixed = space.keep(classes.join(several, "a"), "mixed")
    some = among(base.where(F.octet_length("text") >= length).select("_key", "text"), mixed.select(F.col("key").alias("_key")).distinct(), "left_semi").dropDuplicates(["_key"])
    at = F.greatest(F.col("pos") - reach, F.lit(0))
    # Stored, at every size alike, so that the texts are shuffled once for hot anchors and others together.
    segments = space.keep(mixed.join(some, mixed["key"] == some["_key"]).select(
        "a", "members", "key", "pos", "n", (F.col("pos") - at).alias("left"),
        F.substring(F.encode("text", "UTF-8"), at + 1, F.col("pos") - at + length).alias("seg")), "segments")
    space.free(repeated, classes, several, segments)
    parts = segments.where(F.col("members") <= hot).withColumn("part", F.lit(0).cast("bigint")).select(*COLUMNS)
    if several.where(F.col("members") > hot).limit(1).count():
        groups, dealt = _dealt(segments.where(F.col("members") > hot), hot, length, reach, space)
        parts, full = parts.union(groups), full.union(dealt)
    near = _grouped(parts, "a", "part").mapInArrow(lambda b: repeat_spans(b, length), "key bigint, start int, end int")
    spans = full.union(near).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    spans = space.keep(spans.withColumnRenamed("key", "_key"), "spans")
    space.free(spans)
    schema = T.StructType([*base.drop("_key").schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_bytes", T.BinaryType())])
    changed = among(base, spans.select("_key"), "left_semi").join(spans, "_key")
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    same = among(base, spans.select("_key"), "left_anti").withColumn("_spans", none)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = same.select(*kept, F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
                        F.lit(0).cast("bigint").alias("n_spans"), text.alias("kept_bytes"))
    return changed.select(*kept, "_spans").mapInArrow(_cut, schema).union(whole)


def _dealt(segments: DataFrame, hot: int, length: int, reach: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(groups of at most ``hot`` rows to scan, spans found already) of anchors with more than ``hot`` classes.

    Such an anchor is dealt out by where a string begins, in bands, and by the bytes all strings of a band share.
    Equal segments are counted map-side: one seen twice is a repeat throughout, and one row of each goes on.
    A part that still has more than ``hot`` different ones is dealt out by its strings themselves, counted likewise.
    """
    lo = F.col("band") * BAND
    hi = F.least(lo + BAND - 1, F.lit(reach))
    # Strings that begin lo to hi bytes before the anchor share the bytes from lo before it to length - hi after it.
    core = F.substring("seg", F.col("left") - lo + 1, lo + length - hi)
    bands = segments.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach // BAND))).alias("band")).where(
        (F.col("left") >= lo) & (F.octet_length("seg") - F.col("left") >= length - hi))
    marks = bands.select("a", "key", "pos", "band", F.xxhash64("a", "band", core).alias("part"))
    # Only half marks travel until a core may occur twice; a chance hit costs a few rows more, and parts are counted exactly below.
    half = F.shiftright("part", 32).cast("int").alias("half")
    shared = space.keep(marks.groupBy(half).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("half"), "cores")
    wanted = space.keep(among(marks.withColumn("half", half), shared, "left_semi").groupBy("a", "key", "pos").agg(F.collect_list(F.struct("band", "part")).alias("bands")), "wanted")
    # Bytes are fetched once for all bands of a segment; a short list of segments meets them where they are stored.
    small = wanted.limit(WANTED + 1).count() <= WANTED
    wide = segments.join(F.broadcast(wanted) if small else wanted, ["a", "key", "pos"]).select(*segments.columns, F.inline("bands"))
    cut = F.greatest(F.col("left") - hi, F.lit(0))
    banded = space.keep(wide.select(
        "a", "part", (F.col("left") - cut).alias("left"),
        F.substring("seg", cut + 1, F.col("left") - cut + length - lo).alias("seg"), "key", "pos", "n"), "banded")
    distinct = space.keep(banded.groupBy("a", "part", "left", "seg").agg(
        F.count(F.lit(1)).alias("times"), F.sum("n").alias("n"), F.min("key").alias("key"), F.min_by("pos", "key").alias("pos")), "distinct")
    start = F.col("pos") - F.col("left")
    own = ["a", "part", "left", *_marks(F.col("seg"))]
    # Members of larger classes have their spans already.
    twice = space.keep(distinct.where("times > 1").select(*own), "twice")
    alone = banded.where("n = 1").select(*own, "key", start.alias("start"), (start + F.octet_length("seg")).alias("end"))
    spans = alone.join(twice, twice.columns).select("key", "start", "end")
    sizes = space.keep(distinct.groupBy("a", "part").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
    sized = distinct.join(sizes, ["a", "part"])
    if sizes.where(F.col("members") > hot).limit(1).count():
        # Every segment is at least a string long.
        strings = sized.where(F.col("members") > hot).select(
            "*", F.explode(F.sequence(F.lit(0), F.octet_length("seg") - length)).alias("at")).select(
            "a", (F.col("left") - F.col("at")).alias("before"), *_marks(F.substring("seg", F.col("at") + 1, F.lit(length))),
            "n", "key", (start + F.col("at")).alias("start"))
        place = ["a", "before", "x", "y"]
        equal = space.keep(strings.groupBy(*place).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*place), "strings")
        found = strings.where("n = 1").join(equal, place)
        spans = spans.union(found.select("key", "start", (F.col("start") + length).alias("end")))
    return sized.where(F.col("members") <= hot).select(*COLUMNS), spans


def _marks(c: Column) -> list[Column]:
    """128 bits of two independent hashes stand for the bytes."""
    return [F.xxhash64(c).alias("x"), F.xxhash64(F.lit(1), c).alias("y")]
