"""Exact repeats of 200 bytes or more by interval trees over a sparse enhanced suffix array.

1. Anchors. Of every 200-byte window the leftmost smallest 32-byte hash marks an anchor. Equal windows
   have their anchor at the same place, so any repeat is seen at common anchors; about one byte in 85
   is one. An anchor's frame is the text around it that can share a window with it: up to 168 bytes
   to the left, 200 to the right.
2. Anchors whose 32 bytes occur once are dropped; equal frames are counted, not compared.
3. Different frames that share their 32 bytes form a group. Its right sides are sorted into a suffix
   array with common-prefix lengths; a stack scan gives the interval tree. For each interval of depth
   r, its members are ranked by their reversed left sides; runs whose common left extension l
   reaches 200 - r, and whose members continue with different bytes on both sides, are maximal
   repeats (inside the frame), and all members are their occurrences.
   A group of more than ``CROWDED`` frames is first split into parts that agree on more bytes than the seed,
   until each fits one task (:func:`crowded_reaches`); the parts are scanned alike.
4. The occurrences of all groups are united per document.

Hashes only select; equality of frames and windows is by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import mapped, small, stored
from perchero.llm.textblock import blocks, mixed

WINDOW, SEED = 200, 32
REACH = WINDOW - SEED  # bytes to the left of an anchor that share a window with it
SEGMENT = 2 << 20
#: The most frames of one seed, or of a part of them, that a single task takes together.
CROWDED = 10_000
_BYTE = mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))
_DOUBLE = [mixed(np.array([k + 500], np.uint64))[0] | np.uint64(1) for k in range(5)]


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of a fixed odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, seed: int):
        self.base = int(mixed(np.array([seed], np.uint64))[0]) | 5
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def row(x: int) -> np.ndarray:
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)
            self.up, self.down = row(self.base), row(_inverse(self.base))
        return self.up[:n], self.down[:n]


_POWERS = (_Powers(901), _Powers(902))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes at each place (``len - 31`` of them)."""
    h, size = _BYTE[data], 1
    for factor in _DOUBLE:
        h = h[:-size] * factor + h[size:]
        size *= 2
    return mixed(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of all anchors of texts side by side, ascending."""
    found = [np.zeros(0, np.int64)]
    n = len(data)
    edge = np.zeros(n + 1, np.int64)
    edge[offsets[1:]] = 1
    for first in range(0, max(n - WINDOW + 1, 0), SEGMENT):
        part = data[first: first + SEGMENT + WINDOW - 1]
        places = len(part) - SEED + 1
        rank = (seed_hashes(part) & ~np.uint64(0xFFFFFF)) | np.arange(places, dtype=np.uint64)
        low, size = rank, 1
        while 2 * size <= REACH + 1:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = REACH + 1 - size
        low = np.minimum(low[:-rest], low[rest:])
        # a window is whole if no text ends inside it
        ends = np.cumsum(edge[first: first + len(part) + 1])
        starts = np.arange(len(low))
        whole = ends[starts + WINDOW - 1] == ends[starts]
        mark = np.zeros(places, bool)
        mark[(low[whole] & np.uint64(0xFFFFFF)).astype(np.int64)] = True
        found.append(np.flatnonzero(mark) + first)
    return np.unique(np.concatenate(found))


def _span_hash(data: np.ndarray, which: _Powers, salt: int, starts, ends) -> np.ndarray:
    up, down = which.upto(len(data) + 1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data ^ np.uint8(salt)] * up[:-1], out=upto[1:])
    return mixed((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def frames(docs: DataFrame) -> DataFrame:
    """One row per anchor: document, ``at``, sizes of its frame's sides, seed hash, frame hash."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                data, offsets = block.data, block.offsets
                at = anchors(data, offsets)
                row = block.row_of(at)
                start = np.maximum(offsets[row], at - REACH)
                end = np.minimum(offsets[row + 1], at + WINDOW)
                left, right = at - start, end - at
                seed = _span_hash(data, _POWERS[0], 0, at, at + SEED)
                sides = (left * 1000 + right).astype(np.uint64)
                frame = [
                    mixed(_span_hash(data, p, salt, start, end) + sides)
                    for salt, p in enumerate(_POWERS)]
                part = batch.slice(block.first, block.rows)
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(index), part.column("version").take(index),
                     pa.array(at - offsets[row]), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)),
                     pa.array(seed.view(np.int64)), pa.array(frame[0].view(np.int64)), pa.array(frame[1].view(np.int64))],
                    names=["doc_id", "version", "at", "left", "right", "seed", "frame_a", "frame_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(
        docs.select("doc_id", "version", "text"), find,
        f"doc_id {kind}, version long, at long, left smallint, right smallint, seed long, frame_a long, frame_b long")


def _adjacent(sides: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Common prefix length of each two neighbours in the order."""
    table = np.zeros((len(order), width), np.uint8)
    size = np.array([len(sides[k]) for k in order])
    for i, k in enumerate(order):
        table[i, : size[i]] = np.frombuffer(sides[k], np.uint8)
    same = table[:-1] == table[1:]
    upto = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return np.minimum(upto, np.minimum(size[:-1], size[1:]))


class _RangeMin:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        size = 1
        while 2 * size <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of values[a:b] for each pair, a < b."""
        level = np.log2(b - a).astype(int)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][a[m]], self.rows[k][b[m] - (1 << k)])
        return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of two or more suffixes, children before parents."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal(lefts: list[bytes], rights: list[bytes], least: int = WINDOW) -> list[tuple[np.ndarray, int, int]]:
    """Maximal repeats of ``least`` bytes across distinct frames: (members, left, right extension)."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = _adjacent(rights, order, WINDOW)
    turned = [x[::-1] for x in lefts]
    by_left = sorted(range(n), key=turned.__getitem__)
    left_lcp = _adjacent(turned, by_left, max(REACH, 1))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    order, by_left = np.array(order), np.array(by_left)
    lowest = _RangeMin(left_lcp)
    found = []
    for depth, first, last in intervals(lcp.tolist()):
        if depth + REACH < least:
            continue
        ranks = np.sort(rank[order[first: last + 1]])
        shared = lowest(ranks[:-1], ranks[1:])
        near = shared >= least - depth
        if not near.any():
            continue
        splits = np.flatnonzero(lcp[first:last] == depth) + first
        # left extension: within a run, ever longer common left sides are runs of their own
        for extension, a, b in intervals(np.where(near, shared, -1).tolist()):
            if extension < least - depth:
                continue
            members = by_left[ranks[a: b + 1]]
            at = place[members]
            if np.searchsorted(splits, at.min()) != np.searchsorted(splits, at.max()):
                found.append((members, int(extension), depth))
    return found


def _halves(rows: DataFrame) -> DataFrame:
    """Each frame in both halves of its range ``low`` to ``high`` of left sizes, where it holds a window of them.

    ``part`` is a hash of the bytes that all windows of the half have in common, ``hull_a`` and ``hull_b`` of all
    bytes of the frame that they touch; ``to_left`` and ``to_right`` are the sizes of the hull.
    """
    names = ["frame_a", "frame_b", "low", "high", "to_left", "to_right", "part", "hull_a", "hull_b"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows_ = batch.slice(first, 1000)
                lefts, rights = (rows_.column(c).to_pylist() for c in ("left_bytes", "right_bytes"))
                data = np.frombuffer(b"".join(x for both in zip(lefts, rights, strict=True) for x in both), np.uint8)
                left, right = (np.array([len(x) for x in side], np.int64) for side in (lefts, rights))
                at = np.cumsum(left + right) - right
                low, high = (rows_.column(c).to_numpy() for c in ("low", "high"))
                middle = (low + high) // 2
                for low_, high_ in ((low, middle), (middle + 1, high)):
                    holds = np.flatnonzero(np.maximum(low_, WINDOW - right) <= np.minimum(high_, left))
                    start, end, place = low_[holds], high_[holds], at[holds]
                    sides = (start * 1000 + end).astype(np.uint64)
                    core = _span_hash(data, _POWERS[0], 0, place - start, place + WINDOW - end)
                    to_left, to_right = np.minimum(end, left[holds]), np.minimum(WINDOW - start, right[holds])
                    sizes = (to_left * 1000 + to_right).astype(np.uint64)
                    hull = [
                        mixed(_span_hash(data, p, salt, place - to_left, place + to_right) + sizes).view(np.int64)
                        for salt, p in enumerate(_POWERS)]
                    index = pa.array(holds)
                    yield pa.RecordBatch.from_arrays(
                        [rows_.column("frame_a").take(index), rows_.column("frame_b").take(index),
                         *(pa.array(x) for x in (start, end, to_left, to_right, mixed(core + sides).view(np.int64), *hull))],
                        names=names)

    return mapped(rows, cut, ", ".join(f"{c} long" for c in names))


def _having(rows: DataFrame, counts: DataFrame, key: list[str], crowded: int) -> DataFrame:
    """The rows whose key is in ``counts``, with its columns (``n`` rows have the key).

    Keys of more than ``crowded`` rows are few: up to the counted bound of :func:`small` they go to all tasks,
    beyond it their join is shuffled and its skewed keys are split by adaptive execution.
    """
    few = counts.where(F.col("n") <= crowded)
    many = counts.where(F.col("n") > crowded).select(*key, F.col("n").alias("_n"))
    n_many = many.count()
    if not n_many:
        return rows.join(few, key)
    marked = rows.join(small(many, n_many), key, "left")
    return marked.where("_n is null").drop("_n").join(few, key).unionByName(
        marked.where("_n is not null").withColumnRenamed("_n", "n"))


def crowded_reaches(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """What :func:`_reaches` gives, of frames whose groups are too large for one task.

    A window has some number of bytes, 0 to 168, left of its anchor. The range of these sizes is halved until
    a part, the frames with the same bytes where all windows of the range lie over each other, is small enough for
    the interval tree. Frames of a part that agree on all bytes of its windows reach to the ends of these in each
    other; one of them goes on for the sake of the others. At a single size all frames of a part agree.
    """
    frame, hull = ["frame_a", "frame_b"], ["part", "hull_a", "hull_b"]
    whole = stored(rows.dropDuplicates(frame).select(*frame, "left_bytes", "right_bytes"), "crowded")
    reach, ready = [], []
    left = whole.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(REACH).cast("long"))
    while not left.isEmpty():
        cut = stored(_halves(left), "halves")
        hulls = stored(cut.groupBy(*hull).agg(
            F.count("*").alias("n"), F.min(F.struct(*frame)).alias("one"),
            F.min("low").alias("low"), F.min("high").alias("high")), "hulls")
        alike = _having(cut, hulls.where("n > 1").select(*hull, "n"), hull, crowded)
        reach.append(alike.select(*frame, "to_left", "to_right"))
        parts = stored(hulls.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"), "parts")
        ones = _having(hulls.select("part", "one.*", "low", "high"), parts, ["part"], crowded)
        ones = stored(ones, "ones")
        ready.append(ones.where(F.col("n") <= crowded).select(F.col("part").alias("seed"), *frame))
        left = whole.join(ones.where(F.col("n") > crowded).select(*frame, "low", "high"), frame)
    groups = whole.join(reduce(DataFrame.union, ready), frame).select("seed", *frame, "left_bytes", "right_bytes")
    groups = groups.repartition("seed").sortWithinPartitions("seed")
    reach.append(mapped(groups, _reaches, "frame_a long, frame_b long, to_left long, to_right long"))
    return reduce(DataFrame.union, reach)


def _two(lefts: list[bytes], rights: list[bytes], least: int) -> list[tuple[np.ndarray, int, int]]:
    """:func:`maximal` for two frames: their tree has one interval."""
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())

    right = common(*rights)
    left = common(lefts[0][::-1], lefts[1][::-1]) if right + REACH >= least else 0
    return [(np.arange(2), left, right)] if left + right >= least else []


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """Groups of a stream sorted by seed; only the group being read is held."""
    held: list[list] = [[], [], [], []]
    seed = None

    def whole():
        return held[0], held[1], np.array(held[2], np.int64), np.array(held[3], np.int64)

    for batch in batches:
        seeds = batch.column("seed").to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("left_bytes", "right_bytes", "frame_a", "frame_b")]
        cuts = [0, *(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1).tolist(), len(seeds)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if seed is not None and int(seeds[i]) != seed:
                yield whole()
                held = [[], [], [], []]
            seed = int(seeds[i])
            for values, column in zip(held, columns, strict=True):
                values += column[i:j]
    if held[0]:
        yield whole()


def _found(group, least: int = WINDOW) -> Iterator[tuple[np.ndarray, int, int]]:
    lefts, rights, _, _ = group
    if len(rights) == 2:
        yield from _two(lefts, rights, least)
    elif len(rights) > 2:
        yield from maximal(lefts, rights, least)


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per frame in any maximal repeat: how far its repeats reach to both sides."""
    names = ["frame_a", "frame_b", "to_left", "to_right"]
    out: list[list[np.ndarray]] = []
    held = 0
    for group in _groups(batches):
        reach = np.zeros((2, len(group[0])), np.int64)
        for members, left, right in _found(group):
            reach[0, members] = np.maximum(reach[0, members], left)
            reach[1, members] = np.maximum(reach[1, members], right)
        some = np.flatnonzero(reach[1])
        if len(some):
            out.append([group[2][some], group[3][some], reach[0, some], reach[1, some]])
            held += len(some)
        if held > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every maximal repeat with every frame that holds it."""
    names = ["frame_a", "frame_b", "repeat", "to_left", "to_right"]
    for group in _groups(batches):
        for members, left, right in _found(group):
            k = int(members[0])
            some = group[0][k][len(group[0][k]) - left:] + group[1][k][:right]
            name = hashlib.blake2b(some, digest_size=16).hexdigest()
            n = len(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[2][members]), pa.array(group[3][members]), pa.array([name] * n),
                 pa.array(np.full(n, left, np.int64)), pa.array(np.full(n, right, np.int64))], names=names)


def _compressed(rows: DataFrame) -> DataFrame:
    """The rows with their text as ``packed``: what is shuffled by document is a third of the text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"),
                     pa.array([packer.compress(t or b"") for t in texts], pa.binary())],
                    names=["doc_id", "version", "packed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, pack, f"doc_id {kind}, version long, packed binary")


def with_bytes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The frames at ``places`` with the bytes of their sides."""
    by_doc = places.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("seed", "frame_a", "frame_b", "at", "left", "right")).alias("frames"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            held, unpacker = 0, zstandard.ZstdDecompressor()
            for packed, wanted in zip(batch.column("packed").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                raw = unpacker.decompress(packed)
                for f in wanted:
                    at = f["at"]
                    values = (f["seed"], f["frame_a"], f["frame_b"], raw[at - f["left"]: at], raw[at: at + f["right"]])
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
                held += 400 * len(wanted)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=shape)
                    out, held = {k: [] for k in names}, 0
            if out["seed"]:
                yield pa.RecordBatch.from_pydict(out, schema=shape)

    names = ["seed", "frame_a", "frame_b", "left_bytes", "right_bytes"]
    shape = pa.schema([(c, pa.int64()) for c in names[:3]] + [(c, pa.binary()) for c in names[3:]])
    by_doc = by_doc.withColumnRenamed("doc_id", "frames_id").withColumnRenamed("version", "frames_version")
    rows = _compressed(docs)
    same = rows["doc_id"].eqNullSafe(F.col("frames_id")) & (rows["version"] == F.col("frames_version"))
    joined = rows.join(by_doc, same).select("packed", "frames")
    return mapped(joined, cut, "seed long, frame_a long, frame_b long, left_bytes binary, right_bytes binary")


def _versioned(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and text; a null id becomes its own value."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _compared(docs: DataFrame, crowded: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(anchors with a common seed, distinct frames with their counts, sorted groups to compare, crowded rows).

    Groups of more than ``crowded`` frames are not among the groups to compare; their rows come last, if any.
    """
    rows = _versioned(docs)
    seeds = frames(rows).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    seeds = stored(seeds, "seeds")
    kept = stored(frames(rows).join(seeds, "seed"), "anchors")
    frame = ["seed", "frame_a", "frame_b"]
    first = F.min(F.struct("doc_id", "version", "at")).alias("first")
    distinct = stored(
        kept.groupBy(*frame, "left", "right").agg(F.count("*").alias("times"), first), "frames")
    mixed_seeds = distinct.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    compared = distinct.join(mixed_seeds, "seed").select(*frame, "left", "right", "first.*", "n")
    if crowded is None:
        places, rest = stored(compared.drop("n"), "compared"), None
    else:
        compared = stored(compared.withColumn("crowded", F.col("n") > crowded).drop("n"), "compared")
        places, rest = compared.where("not crowded").drop("crowded"), compared.where("crowded").drop("crowded")
        rest = None if rest.isEmpty() else with_bytes(rows, rest)
    groups = with_bytes(rows, places).repartition("seed").sortWithinPartitions("seed")
    return kept, distinct, groups, rest


def occurrences(docs: DataFrame) -> DataFrame:
    """All occurrences of all maximal repeats: repeat, length, doc_id, version, start.

    A repeat is seen inside frames: one that is longer than a frame comes as overlapping repeats.
    All frames of a seed are scanned in one task here, however many there are.
    """
    kept, distinct, groups, _ = _compared(docs)
    across = mapped(groups, _repeats, "frame_a long, frame_b long, repeat string, to_left long, to_right long")
    alike = distinct.where("times > 1").select(
        "frame_a", "frame_b", F.concat(F.hex("frame_a"), F.hex("frame_b")).alias("repeat"),
        F.col("left").cast("long").alias("to_left"), F.col("right").cast("long").alias("to_right"))
    return kept.join(across.union(alike), ["frame_a", "frame_b"]).select(
        "repeat", (F.col("to_left") + F.col("to_right")).alias("length"), "doc_id", "version",
        (F.col("at") - F.col("to_left")).alias("start")).distinct()


def removed(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Per document: bytes, bytes inside a repeat, runs of those, SHA-256 of the rest, and the rest.

    Null texts count as empty; texts under 200 bytes have no repeats. Repeated rows are repeats of
    each other. No documents give no rows. Other columns are ignored. ``kept`` is binary, as a cut
    may fall inside a character.
    """
    kept, distinct, groups, rest = _compared(docs, crowded)
    across = mapped(groups, _reaches, "frame_a long, frame_b long, to_left long, to_right long")
    if rest is not None:
        across = across.unionByName(crowded_reaches(rest, crowded))
    alike = distinct.where("times > 1").select(
        "frame_a", "frame_b", F.col("left").cast("long").alias("to_left"), F.col("right").cast("long").alias("to_right"))
    reach = across.union(alike).groupBy("frame_a", "frame_b").agg(
        F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right"))
    reach = stored(reach, "reach")
    spans = kept.join(reach, ["frame_a", "frame_b"]).groupBy("doc_id", "version").agg(
        F.collect_list(F.struct(
            (F.col("at") - F.col("to_left")).alias("a"), (F.col("at") + F.col("to_right")).alias("b"))).alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "span_id").withColumnRenamed("version", "span_version")
    rows = _compressed(_versioned(docs))
    same = rows["doc_id"].eqNullSafe(F.col("span_id")) & (rows["version"] == F.col("span_version"))
    joined = rows.join(spans, same, "left").select("doc_id", "packed", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out: dict[str, list] = {k: [] for k in names}
                spans_ = part.column("spans")
                for k, packed in enumerate(part.column("packed").to_pylist()):
                    raw = unpacker.decompress(packed)
                    gone = gaps = 0
                    if spans_[k].is_valid:
                        inner = spans_[k].values
                        step = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(step, inner.field("a").to_numpy(), 1)
                        np.add.at(step, inner.field("b").to_numpy(), -1)
                        inside = np.cumsum(step[:-1]) > 0
                        gone = int(inside.sum())
                        gaps = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~inside].tobytes()
                    else:
                        kept = raw
                    values = (len(raw), gone, gaps, hashlib.sha256(kept).hexdigest(), kept)
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[c], t) for c, t in zip(names, types, strict=True))],
                    names=["doc_id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(
        joined, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
