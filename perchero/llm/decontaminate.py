"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 consecutive words (one shorter window for a shorter item). A
window can stand in a document only where its rarest word stands, so that word alone is its
necessary prefix: words are ordered by their count over all documents, every document word is
probed against the prefix words, and each hit proposes one start per window. Length and position
bounds drop starts that do not fit into the document; the rest are verified word by word. All of
that happens in the scan stage: what is shuffled are verified places only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import BROADCAST_ROWS, small, stored, words

WINDOW = 13


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: ``window`` (words), ``items`` (ids of the items that hold it).

    Items without words have no window; a null ``item_id`` counts as an empty id.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    items = benchmark.select(item, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1)))
    return (
        items.select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
        .groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )


def _doc_words(docs: DataFrame) -> DataFrame:
    """One row per document. Rows that repeat a doc_id with another text stay apart by ``version``."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("w"))


def with_prefix(windows: DataFrame, docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each window with its rarest word over all documents (``prefix``) and that word's ``offset``."""
    vocabulary = stored(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    n = vocabulary.count()
    counts = (
        _doc_words(docs).select(F.explode("w").alias("word"))
        .join(small(vocabulary, n, broadcast_rows), "word").groupBy("word").agg(F.count("*").alias("n"))
    )
    ranked = (
        windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
        .join(counts, "word", "left")
        .groupBy("window", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("first"))
    )
    return ranked.select(
        "window", "items", F.col("first.word").alias("prefix"), F.col("first.offset").alias("offset"),
        F.size("window").alias("length"))


def places(docs: DataFrame, prefixed: DataFrame, n_windows: int, size: int = WINDOW,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences: doc_id, version, start (words from 0), end, items.

    Up to ``broadcast_rows`` windows the document's words stay where they are. More windows are
    joined by a shuffle, in which each word takes along only the words that a window around it can
    cover, never its whole document.
    """
    probes = _doc_words(docs).select(
        "doc_id", "version", "w", F.size("w").alias("n"), F.posexplode("w").alias("at", "prefix"))
    if n_windows <= broadcast_rows:
        probes = probes.withColumn("from", F.lit(0))
    else:
        first = F.greatest(F.col("at") - (size - 1), F.lit(0))
        probes = probes.withColumn("from", first).withColumn(
            "w", F.slice("w", F.col("from") + 1, F.lit(2 * size - 1)))
    probes = probes.join(small(prefixed, n_windows, broadcast_rows), "prefix")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
    same = F.slice("w", start - F.col("from") + 1, F.col("length")) == F.col("window")
    return probes.where(fits).where(same).select(
        "doc_id", "version", start.alias("start"), (start + F.col("length")).alias("end"), "items")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: words, words inside any window's occurrence, items found, verdict.

    A document is contaminated if ``n_hit > 0 and share * n_hit >= n_words``. Null and empty texts
    have no words. Repeated rows give repeated results; a doc_id with several texts gives one row
    per row. An empty benchmark or no documents give no hits or no rows. Other columns of either
    table are ignored.
    """
    windows = stored(item_windows(benchmark, size), "windows")
    prefixed = stored(with_prefix(windows, docs, broadcast_rows), "prefixed")
    found = places(docs, prefixed, prefixed.count(), size, broadcast_rows)
    spans = found.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(
            F.greatest(a["reach"], x["end"]).alias("reach"),
            (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["reach"], x["start"]))).alias("hit")),
    )["hit"]
    hits = spans.select(
        F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version"),
        merged.alias("hit"), "items")
    sizes = _doc_words(docs).select("doc_id", "version", F.size("w").cast("long").alias("n_words"))
    joined = sizes.join(
        hits, sizes.doc_id.eqNullSafe(F.col("hit_id")) & (sizes.version == F.col("hit_version")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "version", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names."""
    bad = report(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("version").alias("_bad_version")).distinct()
    mine = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    hit = F.col(mine["doc_id"]).eqNullSafe(F.col("_bad_id")) & (
        F.xxhash64(mine["text"]) == F.col("_bad_version"))
    return docs.toDF(*mine.values()).join(bad, hit, "left_anti").toDF(*docs.columns)
