"""Toxicity classifier with counterfactual regularisation.

A text is the set of its words and of their beginnings of 4, 5 and 6 bytes. Features whose counts
differ clearly between the labels (and all identity terms) enter a logistic regression. For each
labelled text that names a group, the identity terms are swapped for others of their kind; the loss
adds the squared change of the score, so that the mention itself carries no weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import discard, mapped, stored
from perchero.llm.textblock import Block, blocks, run_hashes

#: Labelled rows that the model is fitted on, at most (in the order of a hash of their id).
TRAIN_ROWS = 20_000
#: Features of the model, at most, and the likelihood ratio (G) from which a feature may enter.
FEATURES, CLEAR = 160, 12.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Weight of the counterfactual penalty.
COUNTERFACTUAL = 5.0

#: Terms that name groups, by language and kind; a term is swapped within its kind.
IDENTITY = [
    # English
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly"],
    # German
    ["frauen", "männer", "mädchen", "jungen"],
    ["schwul", "lesbisch", "bisexuell"],
    ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    ["schwarze", "weiße", "asiaten", "europäer"],
    ["einwanderer", "flüchtlinge", "ausländer", "bürger"],
    # French
    ["femmes", "hommes", "filles", "garçons"],
    ["homosexuels", "lesbiennes", "bisexuels"],
    ["musulmans", "chrétiens", "juifs", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques", "européens"],
    ["immigrés", "réfugiés", "étrangers", "citoyens"],
    # Spanish
    ["mujeres", "hombres", "chicas", "chicos"],
    ["homosexuales", "lesbianas", "bisexuales"],
    ["musulmanes", "cristianos", "judíos", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos", "latinos"],
    ["inmigrantes", "refugiados", "extranjeros", "ciudadanos"],
]
_KIND = {term: kind for kind in IDENTITY for term in kind}
_TERM = re.compile(rb"(?<![0-9a-z\x80-\xff])(" + "|".join(sorted(_KIND)).encode() + rb")(?![0-9a-z\x80-\xff])")


def text_features(data: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and prefix; rows ascend within each family only."""
    starts, ends = block.lower_words(data)
    rows = block.row_of(starts)
    all_rows, found = [rows], [run_hashes(data, starts, ends)]
    for size in PREFIXES:
        longer = ends - starts > size
        first = starts[longer]
        all_rows.append(rows[longer])
        found.append(run_hashes(data, first, first + size, seed=size))
    return np.concatenate(all_rows), np.concatenate(found)


def term_features() -> np.ndarray:
    """Features that identity terms make."""
    block = Block(pa.array([" ".join(sorted(_KIND))]), 0)
    return np.unique(text_features(block.lowered(), block)[1])


def swapped(lowered: bytes, draw: int) -> bytes | None:
    """The text with each identity term swapped for the next of its kind; None if it has none."""
    if not _TERM.search(lowered):
        return None

    def other(match: re.Match) -> bytes:
        term = match.group(1).decode()
        kind = _KIND[term]
        return kind[(kind.index(term) + 1 + draw % (len(kind) - 1)) % len(kind)].encode()

    return _TERM.sub(other, lowered)


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def hits(self, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, number of feature) pairs."""
        if not len(self.features) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        match = self.features[at] == found
        pair = np.unique(rows[match] * len(self.features) + at[match])
        return pair // len(self.features), pair % len(self.features)

    def scores(self, block: Block) -> np.ndarray:
        rows, k = self.hits(*text_features(block.lowered(), block))
        logit = self.bias + np.bincount(rows, self.weights[k], block.rows)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _counted(labelled: DataFrame) -> DataFrame:
    """Per feature: texts with it labelled 1 and 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for block in blocks(batch):
                rows, found = text_features(block.lowered(), block)
                order = np.lexsort((rows, found))
                rows, found = rows[order], found[order]
                new = np.concatenate(([True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])))[: len(rows)]
                rows, found = rows[new], found[new]
                if not len(found):
                    continue
                opens = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                label = toxic[block.first + rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[opens].view(np.int64)), pa.array(np.add.reduceat(label, opens)),
                     pa.array(np.add.reduceat(1 - label, opens))], names=["feature", "ones", "zeros"])

    parts = mapped(labelled.select("text", "toxic"), count, "feature long, ones long, zeros long")
    return parts.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _selected(labelled: DataFrame, n_ones: int, n_zeros: int) -> np.ndarray:
    """The features that tell most about the label (and all of identity terms), sorted.

    The measure is the likelihood ratio of the 2 x 2 table (feature, label) against independence.
    """
    total = n_ones + n_zeros
    having = F.col("ones") + F.col("zeros")

    def part(seen: Column, of: int, with_it: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen * total / (of * with_it))).otherwise(0.0)

    g = (
        part(F.col("ones"), n_ones, having) + part(F.col("zeros"), n_zeros, having)
        + part(n_ones - F.col("ones"), n_ones, total - having) + part(n_zeros - F.col("zeros"), n_zeros, total - having))
    best = (
        _counted(labelled).where(having >= 3).withColumn("g", g).where(F.col("g") > CLEAR)
        .orderBy(F.col("g").desc(), "feature").limit(FEATURES).select("feature").collect()
    )
    chosen = np.array([r[0] for r in best], np.int64).view(np.uint64)
    return np.union1d(chosen, term_features())


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, swaps: np.ndarray, penalty: float = COUNTERFACTUAL,
        ridge: float = 1e-5, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; ``pairs`` and ``swaps`` are texts before and after the swap."""
    n, width = x.shape
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    change = (pairs - swaps).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        error = (p - y) / n
        g = np.concatenate((x.T @ error.astype(np.float32) + ridge * w, [error.sum()]))
        if len(change):
            g[:-1] += 2 * penalty / len(change) * (change.T @ (change @ w.astype(np.float32)))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from (a null id is not held out, and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, penalty: float = COUNTERFACTUAL) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out; null labels are left out.

    Of rows with the same id and label one is taken, picked by a hash of its text.
    """
    sample = (
        labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = stored(labelled, "labelled")
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_ones, n_zeros = counts.get(1, 0), counts.get(0, 0)
    if not n_ones or not n_zeros:
        discard(labelled)
        prior = (n_ones + 0.01) / (n_ones + n_zeros + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    features = _selected(labelled, n_ones, n_zeros)
    model = Model(features, np.zeros(len(features)), 0.0)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                lowered = block.lowered()
                rows_, k = model.hits(*text_features(lowered, block))
                own = np.split(k, np.searchsorted(rows_, np.arange(1, block.rows)))
                other = []
                for i in range(block.rows):
                    text = lowered[block.offsets[i]: block.offsets[i + 1]].tobytes()
                    new = swapped(text, zlib.crc32(text))
                    if new is None:
                        other.append(None)
                    else:
                        one = Block(pa.array([new.decode()]), 0)
                        other.append(model.hits(*text_features(one.lowered(), one))[1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(block.first, block.rows), pa.array([o.tolist() for o in own], pa.list_(pa.int64())),
                     pa.array(other, pa.list_(pa.int64()))], names=["toxic", "own", "other"])

    found = mapped(
        labelled.select("text", "toxic"), extract,
        "toxic int, own array<bigint>, other array<bigint>")
    # one row for each sampled id and label: bounded, and in a defined order for the sums
    sets = sorted(found.collect(), key=lambda r: (r["toxic"], r["own"], r["other"] is not None, r["other"] or []))
    discard(labelled)

    def matrix(lists) -> np.ndarray:
        out = np.zeros((len(lists), len(features)), np.float32)
        for i, hits in enumerate(lists):
            out[i, hits] = 1
        return out

    x = matrix([r["own"] for r in sets])
    y = np.array([r["toxic"] for r in sets], float)
    with_terms = [r for r in sets if r["other"] is not None]
    weights, bias = fit(
        x, y, matrix([r["own"] for r in with_terms]), matrix([r["other"] for r in with_terms]), penalty)
    return Model(features, weights, bias)


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: ``held_out``, ``score`` and ``predicted`` (1 from 0.7 on).

    Null and empty texts get the score of a text without features. Without labels of both classes the
    score is their share. Repeated rows are scored alike; other columns are ignored.
    """
    model = train(docs, labels, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.rows), pa.array(model.scores(block))],
                    names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = mapped(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
