"""Vector code compression: k-means codes of vector parts, by per-dimension value dictionaries.

1. Components become integers. Rows are stored in groups (as a column store would): in each group every
   dimension keeps a dictionary of its distinct integers and a 16-bit code per row.
2. For a codebook, the squared differences of every dictionary integer to all entries are tabulated once
   per group and dimension. The distance of a part to the entries is then a gather by code from each
   of its dimensions' tables, and a sum; no difference is formed per row.
3. A round assigns all parts, sums them per entry in the tasks (again by dictionary: counts of codes
   times integers), and only those sums (parts x entries rows a task) are shuffled. The new entries, a
   fixed number of integers, return to the tasks with the next round.

Groups are bounded, so memory does not grow with the table, and no step deals rows by a key that could
be hot. Sums are exact in 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import BROADCAST_ROWS, discard, mapped, stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component counts as this many steps per unit; values beyond the largest magnitude count as that.
SCALE, LARGEST = 4096, 1 << 24
#: Rows of a stored group, fewer where vectors are long (components of a group at most).
GROUP_ROWS, GROUP_VALUES = 16_384, 1 << 20
#: Slices of each label's total where there are too many labels to broadcast.
SALTS = 32


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    value = F.col(vector)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(value.isNotNull()).where(~bad)


def integers(vector: str, width: int):
    """The first ``width`` components as integers, missing ones 0."""
    steps = F.transform(F.col(vector), lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return F.slice(F.concat(steps, F.array_repeat(F.lit(0), width)), 1, width)


def _grouped(width: int):
    """Arrow batches of (vec_id, label, x) to groups: ids, labels, dictionaries and codes."""
    limit = max(1, min(GROUP_ROWS, GROUP_VALUES // max(width, 1)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for first in range(0, batch.num_rows, limit):
                part = batch.slice(first, limit)
                if rows + part.num_rows > limit:
                    yield _one_group(held, width)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield _one_group(held, width)

    return group


def _one_group(batches: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    x = x.reshape(table.num_rows, width)
    values, sizes, codes = [], [], []
    for d in range(width):
        own, code = np.unique(x[:, d], return_inverse=True)
        values.append(own.astype("<i4"))
        sizes.append(len(own))
        codes.append(code.astype("<u2"))
    return pa.RecordBatch.from_arrays(
        [_one_list(table.column("vec_id")), _one_list(table.column("label")),
         pa.array([np.concatenate(values).tobytes() if values else b""], pa.binary()),
         pa.array([sizes], pa.list_(pa.int32())),
         pa.array([np.concatenate(codes).tobytes() if codes else b""], pa.binary())],
        names=["vec_ids", "labels", "dictionary", "sizes", "codes"])


def _one_list(column: pa.ChunkedArray) -> pa.ListArray:
    whole = pa.concat_arrays(column.chunks)
    return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)


class Group:
    """One stored group: a dictionary and the rows' codes for every dimension."""

    def __init__(self, row: dict, width: int):
        self.width, self.rows = width, len(row["vec_ids"])
        every = np.frombuffer(row["dictionary"].as_py(), "<i4").astype(np.int64)
        at = np.concatenate(([0], np.cumsum(np.array(row["sizes"].as_py(), np.int64)))) if width else np.zeros(1, int)
        self.values = [every[at[d]: at[d + 1]] for d in range(width)]
        self.codes = np.frombuffer(row["codes"].as_py(), "<u2").reshape(width, self.rows)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance (rows x parts); ties to the lower index."""
        step = self.width // PARTS
        index = np.zeros((self.rows, PARTS), np.int64)
        far = np.zeros((self.rows, PARTS), np.int64)
        for part in range(PARTS):
            distance = np.zeros((self.rows, books.shape[1]), np.int64)
            for d in range(step):
                own = self.values[part * step + d]
                table = (own[:, None] - books[part, :, d][None, :]) ** 2
                distance += table[self.codes[part * step + d]]
            index[:, part] = distance.argmin(axis=1)
            far[:, part] = distance[np.arange(self.rows), index[:, part]]
        return index, far

    def sums(self, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Members and componentwise sums (parts x entries [x dimensions of a part])."""
        step = self.width // PARTS
        count = np.stack([np.bincount(index[:, p], minlength=entries) for p in range(PARTS)])
        total = np.zeros((PARTS, entries, step), np.int64)
        for part in range(PARTS):
            for d in range(step):
                own, code = self.values[part * step + d], self.codes[part * step + d].astype(np.int64)
                times = np.bincount(index[:, part] * len(own) + code, minlength=entries * len(own))
                total[part, :, d] = times.reshape(entries, len(own)) @ own
        return count, total


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, Group]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield row, Group(row, width)


def moved(groups: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round; unused entries stay."""
    entries, step = books.shape[1], books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, step), np.int64)
        for _, group in _groups(batches, width):
            index, _ = group.nearest(books)
            more = group.sums(index, entries)
            count, total = count + more[0], total + more[1]
        part, entry = np.nonzero(count)
        part, entry, place = np.repeat(part, step + 1), np.repeat(entry, step + 1), np.tile(np.arange(step + 1), len(part))
        # the count stands behind the sums
        amount = np.concatenate((total, count[:, :, None]), axis=2)[part, entry, place]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (part, entry, place, amount)],
                                         names=["part", "entry", "place", "amount"])

    partial = mapped(groups, assign, "part long, entry long, place long, amount long")
    after = books.copy()
    found = np.zeros((PARTS, entries, step + 1), np.int64)
    for r in partial.groupBy("part", "entry", "place").agg(F.sum("amount").alias("amount")).collect():
        found[r.part, r.entry, r.place] = r.amount
    used = found[:, :, step] > 0
    after[used] = found[:, :, :step][used] // found[:, :, step][used][:, None]
    return after


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per usable row vec_id, code, error, label_error, codebooks_sha256; and the codebooks themselves.

    The codebooks are parts x entries x dimensions of a part. Rows whose vector is null or holds a null,
    NaN or infinite component are left out. Vectors of unequal length count as if filled with zeros up to
    the longest, and to a multiple of eight; an empty vector is all zeros. With fewer than 16 usable rows
    there are as many entries; without any, no rows come out and the codebooks are empty. Equal ids are ordered
    by their vectors, null ids come last. Repeated rows each keep their row. Components beyond +-4096 count as
    that bound, which keeps all sums exact. Other columns are ignored.
    """
    spark = rows.sparkSession
    kept = usable(rows, vector).select("vec_id", "label", F.col(vector).alias("_vector"))
    longest = kept.agg(F.max(F.size("_vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    step = width // PARTS
    whole = kept.select("vec_id", "label", integers("_vector", width).alias("x"))
    firsts = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    books = np.array([r.x for r in firsts], np.int64).reshape(len(firsts), PARTS, step).transpose(1, 0, 2).copy()
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    groups = stored(mapped(
        whole, _grouped(width),
        f"vec_ids array<{ids}>, labels array<{labels}>, dictionary binary, sizes array<int>, codes binary"), "groups")
    for _ in range(ROUNDS if firsts else 0):
        books = moved(groups, books, width)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, group in _groups(batches, width):
            index, far = group.nearest(books)
            texts = [bytes(r).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [row["vec_ids"].values, row["labels"].values, pa.array(texts, pa.string()), pa.array(far.sum(axis=1))],
                names=["vec_id", "label", "code", "error"])

    coded = stored(mapped(groups, code, f"vec_id {ids}, label {labels}, code string, error long"), "codes")
    discard(groups)
    out = with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    return out, books


def with_label_error(coded: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``label_error``: the error of all rows of the same label (nulls are one label).

    Few labels are broadcast. More are joined by label and slice, so that one label's rows spread over
    many tasks.
    """
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= limit:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_label")))
    sliced = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_slice"))
    return coded.withColumn("_at", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)).cast("int")).join(
        sliced, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_at") == F.col("_slice")))
