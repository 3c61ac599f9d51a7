"""Quality rules as a learned decision list.

Text statistics are counted in one vectorised pass. From labelled statistics, sequential covering
learns an ordered list of rules, each a conjunction of thresholds: a rule grows by the condition
with the largest FOIL gain on two thirds of the rows, is pruned on the other third, and takes the
rows it covers with it. The list is emitted as one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from perchero.llm.common import mapped
from perchero.llm.textblock import blocks, chained, mixed, run_hashes

#: Rows that the rules are learnt from, at most (in the order of a hash of their id).
TRAIN_ROWS = 20_000
#: A rule must reject at least this share of low-quality rows among those it covers when pruned.
PRECISION = 0.9
LEAST_COVER = 8

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_digits", "n_marks", "n_bytes", "n_lines", "n_twins",
]
#: What the conditions test: a share of counts.
SHARES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "uppercase": ("n_upper", "n_bytes"),
    "digits": ("n_digits", "n_bytes"),
    "marks": ("n_marks", "n_words"),
    "twins": ("n_twins", "n_words"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True


def _in_rows(block, where: np.ndarray) -> np.ndarray:
    return block.per_row(block.row_of(np.flatnonzero(where)))


def _earlier(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: has an equal earlier value in its row; has any equal value in its row."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = hashes ^ mixed(rows.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    as_before = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    earlier = np.empty(len(key), bool)
    earlier[order] = as_before
    either = as_before | np.concatenate((as_before[1:], [False]))
    repeated = np.empty(len(key), bool)
    repeated[order] = either
    return earlier, repeated


def block_counts(block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    data, n = block.data, block.rows
    starts, ends = block.plain_words()
    rows = block.row_of(starts)
    words = run_hashes(data, starts, ends)
    out = {"n_words": block.per_row(rows)}
    head = (data < 0x80) | (data >= 0xC0)
    upto = np.concatenate(([0], np.cumsum(head)))
    out["word_chars"] = block.per_row(rows, upto[ends] - upto[starts])
    out["n_symbols"] = _in_rows(block, _SYMBOL[data])
    out["n_marks"] = _in_rows(block, _MARK[data])
    out["n_upper"] = _in_rows(block, (data >= 65) & (data <= 90))
    out["n_lower"] = _in_rows(block, (data >= 97) & (data <= 122))
    out["n_digits"] = _in_rows(block, (data >= 48) & (data <= 57))
    out["n_bytes"] = np.diff(block.offsets)
    twin = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out["n_twins"] = block.per_row(rows[1:][twin])

    line_starts, line_ends = block.runs(data != 10)
    word_at = np.searchsorted(starts, line_starts)
    filled = word_at < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_rows = block.row_of(line_starts)
    out["n_lines"] = block.per_row(line_rows)
    earlier, _ = _earlier(line_rows, run_hashes(data, line_starts, line_ends, seed=1))
    out["n_dup_lines"] = block.per_row(line_rows[earlier])

    hit = np.zeros(len(words), bool)
    triples = chained(words, 3)
    if len(triples):
        whole = np.flatnonzero(rows[2:] == rows[:-2])
        _, repeated = _earlier(rows[whole], triples[whole])
        found = whole[repeated]
        for i in range(3):
            hit[found + i] = True
    out["n_repeat_words"] = block.per_row(rows[hit])
    return {k: v if len(v) else np.zeros(n, np.int64) for k, v in out.items()}


def statistics(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id`` and :data:`COUNTS` (long). Null texts count as empty."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = block_counts(block)
                ids = batch.column("doc_id").slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(found[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    return mapped(docs.select("doc_id", "text"), count, schema)


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool
    bound: float

    def mask(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.share]
        return x > self.bound if self.above else x <= self.bound

    def column(self) -> Column:
        x = share_column(self.share)
        return x > F.lit(self.bound) if self.above else x <= F.lit(self.bound)


def share_column(name: str) -> Column:
    top, below = SHARES[name]
    if below is None:
        return F.col(top).cast("double")
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


def share_values(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        name: counts[top].astype(float) if below is None else counts[top] / np.maximum(counts[below], 1)
        for name, (top, below) in SHARES.items()
    }


def _covered(rule: list[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for condition in rule:
        mask &= condition.mask(values)
    return mask


def _best_condition(values, low, inside) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain over the rows ``inside``."""
    p0, n0 = int((low & inside).sum()), int((~low & inside).sum())
    if not p0 or not n0:
        return 0.0, None
    base = np.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for name, x in values.items():
        x_in, y_in = x[inside], low[inside]
        order = np.argsort(x_in, kind="stable")
        ranked, hits = x_in[order], np.cumsum(y_in[order])
        cut = np.flatnonzero(ranked[1:] != ranked[:-1])
        if not len(cut):
            continue
        bound = (ranked[cut] + ranked[cut + 1]) / 2
        for above in (True, False):
            p = p0 - hits[cut] if above else hits[cut]
            total = len(ranked) - 1 - cut if above else cut + 1
            with np.errstate(divide="ignore"):
                gain = p * (np.log2(np.maximum(p, 1e-9) / total) - base)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float(bound[k]))
    return best, found


def learn(counts: dict[str, np.ndarray], low: np.ndarray, conditions: int = 4) -> list[list[Condition]]:
    """Rules that reject, in the order learnt; none if the rows hold a single class."""
    values = share_values(counts)
    n = len(low)
    pick = (mixed(np.arange(n, dtype=np.uint64)) % np.uint64(3)) != 0
    left = np.ones(n, bool)
    rules: list[list[Condition]] = []
    while (low & left).sum() >= LEAST_COVER and len(rules) < 32:
        rule: list[Condition] = []
        inside = left & pick
        while len(rule) < conditions:
            _, condition = _best_condition(values, low, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.mask(values)
            if low[inside].all():
                break
        if not rule:
            break

        def worth(candidate: list[Condition]) -> float:
            mask = _covered(candidate, values, n) & left & ~pick
            p, q = int((low & mask).sum()), int((~low & mask).sum())
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        mask = _covered(rule, values, n) & left
        if mask.sum() < LEAST_COVER or low[mask].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~mask
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects a row (from 1), else 0, as one ``CASE``."""
    found: Column | None = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        found = F.when(test, k) if found is None else found.when(test, k)
    return F.lit(0) if found is None else found.otherwise(0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Learn from at most ``rows`` labelled documents; labels that are null are left out.

    Of rows with the same id and label one is taken, picked by a hash of its counts.
    """
    sample = (
        labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    one = F.min_by(F.struct(*COUNTS), F.xxhash64(*COUNTS)).alias("one")
    joined = statistics(picked).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(one).select(
        "doc_id", "quality", "one.*").orderBy("doc_id", "quality").collect()
    if not joined:
        return []
    counts = {c: np.array([r[c] for r in joined], np.int64) for c in COUNTS}
    return learn(counts, np.array([r["quality"] == 0 for r in joined]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: its counts, ``base_failed``, ``rule`` (0: none rejects) and ``kept``.

    Null and empty texts have no words and fail the base rule. Without labels there are no learnt
    rules. Repeated rows are judged alike; further columns of either table are ignored.
    """
    rules = train(docs, labels, rows)
    found = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_only(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns.

    The rules are learnt first; then one pass judges each row beside its other columns, so no join
    is needed and rows with the same id are judged by their own text.
    """
    rules = train(docs, labels, rows)
    plain = [f"_c{i}" for i in range(len(docs.columns))]  # no clash with the counts
    text = plain[docs.columns.index("text")]
    renamed = docs.toDF(*plain)
    schema = StructType([*renamed.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                found = block_counts(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[c]) for c in COUNTS)], names=[*plain, *COUNTS])

    keep = mapped(renamed, count, schema).where(~base_failed() & (verdict(rules) == 0))
    return keep.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])
