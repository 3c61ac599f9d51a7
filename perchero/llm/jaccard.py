"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and 240 MinHash values; the
   values in 40 bands of 6 give the bucket keys. At similarity 0.8 a pair shares no bucket with
   probability 5e-6.
2. Texts with equal sets form one class, represented by its smallest doc_id.
3. Representatives in a common bucket are connected by a star to the smallest of the bucket;
   components of these stars are the candidate clusters. A cluster is cut into blocks by a hash of the
   id, and every pair of blocks is one unit of work, so a huge cluster becomes many bounded tasks.
4. In a unit, the MinHash values of each pair are compared 24 at a time. A pair is dropped when the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below
   the tolerance; the rest is verified exactly on the sets. Links are counted, not written out; of
   each linked group only the edges to its smallest member leave the unit.
5. Components of those edges are the near-duplicate classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import mapped, shipped, small, stored
from perchero.llm.components import components
from perchero.llm.textblock import Block, blocks, chained, mixed, run_hashes

SHINGLE = 5
#: The similarity as a fraction.
THRESHOLD = (4, 5)
BANDS, WIDTH = 40, 6
STEP = 24
TOLERANCE = 1e-9
#: Members and shingles of one block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20

_K = np.arange(BANDS * WIDTH, dtype=np.uint64)
_XOR = (mixed(_K + np.uint64(1000)) >> np.uint64(32)).astype(np.uint32)
_MUL = (mixed(_K + np.uint64(2000)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, side by side, and their number per text.

    A text of fewer than ``size`` words is one shingle; one without words has none.
    """
    lowered = block.lowered()
    starts, ends = block.lower_words(lowered)
    words = run_hashes(lowered, starts, ends)
    n_words = block.per_row(block.row_of(starts)) if len(starts) else np.zeros(block.rows, np.int64)
    firsts = np.cumsum(n_words) - n_words
    whole = chained(words, size)
    short = {c: chained(words, c) for c in range(1, size)}
    sets = []
    for first, n in zip(firsts.tolist(), n_words.tolist(), strict=True):
        if n >= size:
            sets.append(np.unique(whole[first: first + n - size + 1]))
        elif n:
            sets.append(mixed(short[n][first: first + 1] + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    counts = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (texts x 240, 32 bits); all ones for empty sets."""
    out = np.full((BANDS * WIDTH, len(counts)), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(counts)
    if len(filled):
        firsts = (np.cumsum(counts) - counts)[filled]
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(x)
        for k in range(BANDS * WIDTH):
            np.bitwise_xor(x, _XOR[k], out=value)
            np.multiply(value, _MUL[k], out=value)
            out[k, filled] = np.minimum.reduceat(value, firsts)
    return np.ascontiguousarray(out.T)


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """One key per text and band, the band mixed in."""
    parts = signature.reshape(len(signature), BANDS, WIDTH).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(WIDTH):
        key = mixed(key ^ parts[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: ``n`` shingles, a 128-bit hash of the set, and the bucket keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                shingles, counts = shingle_sets(block)
                hashes = []
                for salt in (1, 2):
                    upto = np.zeros(len(shingles) + 1, np.uint64)
                    np.cumsum(mixed(shingles ^ np.uint64(salt)), out=upto[1:])
                    ends = np.cumsum(counts)
                    hashes.append((upto[ends] - upto[ends - counts]).view(np.int64))
                keys = bucket_keys(signatures(shingles, counts))
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                ids = batch.column("doc_id").slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts), pa.array(hashes[0]), pa.array(hashes[1]), bands],
                    names=["doc_id", "n", "set_a", "set_b", "bands"])

    schema = "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sketch, schema)


def candidate_edges(representatives: DataFrame) -> DataFrame:
    """(u, v): each representative of a shared bucket with the bucket's smallest."""
    member = representatives.select("doc_id", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return (
        member.join(shared.where("low < high").select("key", "low"), "key").where("doc_id > low")
        .select(F.col("doc_id").alias("u"), F.col("low").alias("v")).distinct()
    )


def with_sets(docs: DataFrame, members: DataFrame, n_members: int) -> DataFrame:
    """The members with the signature and the sorted shingles of their texts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                shingles, counts = shingle_sets(block)
                signature = signatures(shingles, counts)
                ends = np.cumsum(counts)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("cluster"), part.column("parts"), part.column("copies"),
                     pa.array([s.tobytes() for s in signature], pa.binary()),
                     pa.array([shingles[e - c: e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())],
                    names=["doc_id", "cluster", "parts", "copies", "signature", "shingles"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        small(members, n_members), "doc_id").select("doc_id", "cluster", "parts", "copies", "text")
    return mapped(
        picked, compute,
        "doc_id bigint, cluster bigint, parts bigint, copies bigint, signature binary, shingles binary")


def fewest_matches(tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair stays.

    With a uniform prior and m matches of n, the posterior probability of similarity t or more is
    the probability of at most m successes in n + 1 trials of probability t.
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    found = {}
    for n in range(STEP, BANDS * WIDTH + 1, STEP):
        upto, m = 0.0, 0
        while True:
            upto += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if upto >= tolerance:
                break
            m += 1
        found[n] = m
    return found


def surviving(signature: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the posterior does not rule out, after all values."""
    least = fewest_matches()
    matches = np.zeros(len(i), np.int64)
    for n in sorted(least):
        columns = slice(n - STEP, n)
        matches += (signature[i, columns] == signature[j, columns]).sum(axis=1)
        stay = matches >= least[n]
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            break
    return i, j


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Size of the intersection of each pair, exactly."""
    if len(i) <= 32:
        return np.array([
            len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate((i, j)))
    place = {int(k): p for p, k in enumerate(used)}
    values, column, times = np.unique(
        np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    both = np.zeros((len(used), len(used)), np.float64)
    keep = times[column] > 1
    rank = np.cumsum(times > 1) - 1
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(used), width), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        both += dense @ dense.T
    at_i = np.array([place[int(k)] for k in i])
    at_j = np.array([place[int(k)] for k in j])
    return both[at_i, at_j].astype(np.int64)


def compare(rows: pd.DataFrame, a: int, b: int) -> pd.DataFrame:
    """One unit: the links of block a with block b (within the block if they are the same)."""
    side = rows["block"].to_numpy()
    signature = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    if a == b:
        i, j = np.triu_indices(len(rows), 1)
    else:
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    i, j = surviving(signature, i, j)
    size = np.array([len(s) for s in sets], np.int64)
    top, below = THRESHOLD
    if len(i):
        fits = below * np.minimum(size[i], size[j]) >= top * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
    both = common(sets, i, j) if len(i) else np.zeros(0, np.int64)
    linked = (top + below) * both >= top * (size[i] + size[j])
    i, j = i[linked], j[linked]
    ids = rows["doc_id"].to_numpy()
    copies = rows["copies"].to_numpy()
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    root = np.arange(len(rows))
    changed = len(i) > 0
    while changed:  # the smallest id spreads along the links
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        changed = bool((low != root).any())
        root = low
    found = np.flatnonzero(links > 0)
    return pd.DataFrame({"doc_id": ids[found], "links": links[found].astype(np.int64), "root": ids[root[found]]})


def links(members: DataFrame) -> DataFrame:
    """Per representative and unit: number of linked documents and the unit's smallest linked id."""
    block = F.pmod(F.xxhash64("doc_id"), "parts").alias("block")
    units = (
        members.select("*", block)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select(
            "cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block",
            "doc_id", "copies", "signature", "shingles")
    )

    def unit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable", ignore_index=True)
        return compare(rows, int(key[1]), int(key[2]))

    shipped(members.sparkSession)
    return units.groupBy("cluster", "a", "b").applyInPandas(unit, "doc_id bigint, links bigint, root bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: ``class_id`` (smallest doc_id of its class), ``n_links``, ``copy_of``, ``n_shingles``.

    Two documents are linked if the Jaccard similarity of their shingle sets is 0.8 or more; a class
    is a component of links. ``n_links`` counts all linked documents, copies included. ``copy_of`` is
    the smallest doc_id with the same set. Texts without words (null, empty) are their own class
    without links, and so are rows without an id (their class is null). Repeated rows count as copies
    of each other; texts that share a doc_id count as one document. Other columns are ignored.
    """
    sketch = stored(sketches(docs), "sketches")
    filled = sketch.where("n > 0 and doc_id is not null")
    sets = ["set_a", "set_b"]
    classes = filled.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    representatives = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *sets], "left_semi")
    edges = components(candidate_edges(representatives))
    clusters = edges.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    sized = (
        clusters.join(
            filled.select("doc_id", "n", *sets).join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *sets]),
            "doc_id")
        .groupBy("doc_id", "cluster").agg(F.max("n").alias("n"), F.max("copies").alias("copies"))
    )
    sized = stored(sized, "sized")
    parts = sized.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    members = sized.join(parts, "cluster").select("doc_id", "cluster", "parts", "copies")
    found = stored(links(with_sets(docs, members, sized.count())), "links")
    grouped = components(found.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links")).join(
        grouped.select(F.col("node").alias("doc_id"), "component"), "doc_id")
    by_rep = classes.join(linked.withColumnRenamed("doc_id", "rep"), "rep", "left")
    base = sketch.select("doc_id", "n", *sets)
    joined = base.join(by_rep, sets, "left")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id",
        F.when(usable, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(usable, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(usable, F.col("rep")).otherwise(F.col("doc_id")).alias("copy_of"),
        F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every class, with all columns; rows without an id stay.

    Of several rows with that id the one stays whose text has the smallest 64-bit hash, and of those with equal
    texts the one whose other columns, written as JSON, have it. Columns of any name pass through.
    """
    found = near_duplicates(docs)
    kept = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = stored(kept, "kept")
    mine = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    inner, name = docs.toDF(*mine.values()), mine["doc_id"]
    # a merge join at every size: the texts are shuffled once
    once = kept.where("times = 1").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(name))
    out = inner.join(once.hint("merge"), name, "left_semi").union(inner.where(F.col(name).isNull()))
    n_repeated = kept.where("times > 1").count()
    if n_repeated:
        often = kept.where("times > 1").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(name))
        whole = F.struct(*inner.columns)
        rank = F.struct(
            F.xxhash64(mine["text"]), F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in inner.columns)))))
        rows = inner.join(small(often, n_repeated), name, "left_semi").select(
            F.col(name).alias("_id"), rank.alias("_rank"), whole.alias("_row"),
            F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_salt"))
        first = F.min_by("_row", "_rank").alias("_row")
        least = F.min("_rank").alias("_rank")
        rows = rows.groupBy("_id", "_salt").agg(first, least).groupBy("_id").agg(first)
        out = out.union(rows.select("_row.*"))
    return out.toDF(*docs.columns)
