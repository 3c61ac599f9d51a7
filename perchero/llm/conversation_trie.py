"""Prefix trie of conversations, rolled up by centroid decomposition.

1. Turns are numbered by a range sort: each task numbers its range, and what earlier ranges hold of the
   one conversation that crosses a border is added. No conversation is held in one task.
2. A prefix is named by its depth and a 128-bit exclusive-or of hashes of (place, role, text), which is
   again a running sum over ranges. Conversations with the same name of a prefix meet in one node; a node is
   known by its depth and its smallest member.
3. The parent edges below the root form a forest. A tree with more than ``LOCAL`` nodes is split by
   centroids in DataFrame rounds, all large components at once: the nodes with at least half of the component
   below them form the path from the top to the centroid; the total below the centroid is added along that
   path, and the centroid's child components and the rest go on without it. Which side a node is on follows
   from its member conversation's node at the centroid's depth. Every round halves the components.
4. Components of at most ``LOCAL`` nodes are split further in the same way inside tasks, many at once.
5. The digest of the conversations that end in a node is streamed in order, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perchero.llm.common import discard, mapped, small, stored

#: Conversations of one family share their opening turns, at most ``OPENING`` of them.
FAMILY, OPENING = 20, 3
#: Nodes of a component that one task splits by itself, and nodes that it splits together.
LOCAL, TOGETHER = 4096, 100_000
#: Conversation ids of one piece of a digest.
PIECE = 50_000
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def opening_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(OPENING + 1)).cast("int")


def _borders(rows: DataFrame, *sums: Column) -> list:
    """Sums per (part, conv_id) for the first and last conversation of every part, at most two rows a part."""
    ends = rows.groupBy(F.col("part").alias("_part")).agg(F.min("conv_id").alias("_low"), F.max("conv_id").alias("_high"))
    at_border = rows.join(F.broadcast(ends), F.col("part") == F.col("_part")).where("conv_id = _low or conv_id = _high")
    return sorted(at_border.groupBy("part", "conv_id").agg(*sums).collect(), key=lambda r: (r.part, r.conv_id))


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as (part, seq, conv_id, pos from 1, ha, hb, words), in the order of turn, role, text."""
    spark = conversations.sparkSession
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"))  # parts many equal rows
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "conv_id",
            F.xxhash64("role", "text").alias("ha"), F.xxhash64("text", F.lit(1), "role").alias("hb"),
            F.regexp_count("text", F.lit(PLAIN_WORD)).cast("long").alias("words")), "turns")
    before, seen = [], {}
    for r in _borders(turns, F.count("*").alias("n")):
        held = seen.get(r.conv_id, 0)
        before.append((r.part, r.conv_id, held))
        seen = {r.conv_id: held + r.n}
    ahead = spark.createDataFrame(before, "part int, conv_id long, ahead long")
    within = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("seq"))
    return turns.withColumn("within", within).join(F.broadcast(ahead), ["part", "conv_id"], "left").select(
        "part", "seq", "conv_id", (F.col("within") + F.coalesce("ahead", F.lit(0))).alias("pos"), "ha", "hb", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their prefixes (conv_id, depth, ka, kb, words, is_end), stored."""
    spark = conversations.sparkSession
    turns = stored(numbered(conversations), "numbered")
    family = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("head")
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") <= OPENING)).select(
        F.col("conv_id").alias("head"), "pos", "ha", "hb", "words")
    lengths = heads.groupBy("head").agg(F.count("*").alias("there"))
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counted.select("conv_id", "n", opening_turns(F.col("conv_id")).alias("h"), family).join(
        lengths, "head", "left").select(
        "conv_id", "n", "h", "head", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    key = [F.xxhash64("depth", "ha").alias("sa"), F.xxhash64("hb", F.lit(2), "depth").alias("sb")]
    head = convs.join(heads, "head").where("pos <= h").select(
        "conv_id", F.col("pos").cast("long").alias("depth"), "ha", "hb", "words", "length").select("*", *key)
    head = stored(head, "heads")
    opened = head.groupBy("conv_id").agg(F.bit_xor("sa").alias("oa"), F.bit_xor("sb").alias("ob"))
    own = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("pos > h").select(
        "part", "seq", "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).cast("long").alias("depth"), "ha", "hb",
        "words", "length").select("*", *key)
    own = stored(own, "own")
    before, seen = [], {}
    for r in _borders(own, F.bit_xor("sa").alias("sa"), F.bit_xor("sb").alias("sb")):
        a, b = seen.get(r.conv_id, (0, 0))
        before.append((r.part, r.conv_id, a, b))
        seen = {r.conv_id: (a ^ r.sa, b ^ r.sb)}
    ahead = spark.createDataFrame(before, "part int, conv_id long, aa long, ab long")
    run = Window.partitionBy("part", "conv_id").orderBy("seq")
    none = F.lit(0).cast("long")
    longer = (
        own.select("*", F.bit_xor("sa").over(run).alias("ra"), F.bit_xor("sb").over(run).alias("rb"))
        .join(F.broadcast(ahead), ["part", "conv_id"], "left").join(opened, "conv_id", "left")
        .withColumn("ka", F.col("ra").bitwiseXOR(F.coalesce("aa", none)).bitwiseXOR(F.coalesce("oa", none)))
        .withColumn("kb", F.col("rb").bitwiseXOR(F.coalesce("ab", none)).bitwiseXOR(F.coalesce("ob", none)))
    )
    first = Window.partitionBy("conv_id").orderBy("depth")  # at most three rows
    shorter = head.select("*", F.bit_xor("sa").over(first).alias("ka"), F.bit_xor("sb").over(first).alias("kb"))
    columns = ["conv_id", "depth", "ka", "kb", "words", (F.col("depth") == F.col("length")).alias("is_end")]
    prefixes = stored(shorter.select(*columns).union(longer.select(*columns)), "prefixes")
    for done in (turns, head, own):
        discard(done)
    return convs.select("conv_id", "length"), prefixes


def at_depth(nodes: DataFrame, member: DataFrame, depth: Column, name: str) -> DataFrame:
    """``nodes`` with ``name``: the node over each at ``depth`` (null where that is not at or above it)."""
    over = member.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("node").alias(name))
    above = F.when(depth <= F.col("depth"), depth)
    return nodes.withColumn("_at", above).join(
        over, (F.col("node") == F.col("_conv")) & (F.col("_at") == F.col("_depth")), "left").drop("_conv", "_depth", "_at")


def _sizes(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """``size`` of each node's subtree: sums over descendants nearer than 1, 2, 4, ... levels."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    state = stored(nodes.withColumn("size", F.lit(1).cast("long")), "sizes")
    reach = 1
    while reach < deepest:
        over = at_depth(state.select("node", "depth", "size"), member, F.col("depth") - reach, "_up")
        over = over.where("_up is not null")
        more = over.groupBy(F.col("_up"), (F.col("depth") - reach).alias("_d")).agg(F.sum("size").alias("_more"))
        after = state.join(more, (F.col("node") == F.col("_up")) & (F.col("depth") == F.col("_d")), "left").withColumn(
            "size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_up", "_d", "_more")
        after = stored(after, "sizes")
        discard(state)
        state, reach = after, 2 * reach
    return state


def _split_large(nodes: DataFrame, member: DataFrame, local: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Centroid rounds over components of more than ``local`` nodes: (finished nodes, small components)."""
    finished, parts = [], []
    state = _sizes(nodes, member)
    comp = ["ct", "cd"]
    while True:
        totals = stored(state.groupBy(*comp).agg(F.count("*").alias("total")), "totals")
        n_large = totals.where(F.col("total") > local).count()
        sized = state.join(small(totals, totals.count()), comp)
        parts.append(stored(sized.where(F.col("total") <= local).drop("total", "size"), "component"))
        if not n_large:
            discard(state)
            return finished, parts
        large = sized.where(F.col("total") > local)
        heavy = 2 * F.col("size") >= F.col("total")
        centre = large.where(heavy).groupBy(*comp).agg(F.min(F.struct(
            F.col("size").alias("zs"), (-F.col("depth")).alias("up"), F.col("node").alias("zn"))).alias("z")).select(
            *comp, "z.zs", (-F.col("z.up")).alias("zd"), "z.zn")
        rows = large.join(small(centre, n_large), comp)
        rows = at_depth(rows, member, F.col("zd"), "_over")
        rows = at_depth(rows, member, F.col("zd") + 1, "_child")
        inside = F.coalesce(F.col("_over") == F.col("zn"), F.lit(False))
        rows = stored(rows.withColumn("inside", inside).withColumn("heavy", heavy), "split")
        below = rows.where("inside").groupBy(*comp).agg(
            F.sum("leaves").alias("_leaves"), F.sum("tokens").alias("_tokens"))
        rows_ = rows.join(small(below, n_large), comp)
        added = [(F.col(f"more_{v}") + F.when(F.col("heavy"), F.col(f"_{v}")).otherwise(0)).alias(f"more_{v}")
                 for v in ("leaves", "tokens")]
        is_centre = (F.col("node") == F.col("zn")) & (F.col("depth") == F.col("zd"))
        finished.append(stored(rows_.where(is_centre).select("node", "depth", *added), "finished"))
        after = rows_.where(~is_centre).select(
            "node", "depth", "parent", F.when(F.col("inside"), F.col("_child")).otherwise(F.col("ct")).alias("ct"),
            F.when(F.col("inside"), F.col("zd") + 1).otherwise(F.col("cd")).alias("cd"), "leaves", "tokens", *added,
            (F.col("size") - F.when(F.col("heavy"), F.col("zs")).otherwise(0)).alias("size"))
        after = stored(after, "components")
        for done in (rows, state, totals):
            discard(done)
        state = after


def solve(frame: pd.DataFrame) -> np.ndarray:
    """Subtree totals (nodes x 2) of whole components, by centroid decomposition of all at once."""
    n = len(frame)
    group = frame.groupby(["ct", "cd"], sort=False).ngroup().to_numpy()
    depth = frame["depth"].to_numpy() - frame["cd"].to_numpy()
    place = frame[["ct", "cd", "depth", "node"]].assign(up=np.arange(n))
    below = frame[["ct", "cd", "depth", "parent"]].rename(columns={"parent": "node"})
    below["depth"] -= 1
    up = below.merge(place, how="left", on=["ct", "cd", "depth", "node"])["up"].to_numpy()
    parent = np.where((depth > 0) & ~np.isnan(up), np.nan_to_num(up), -1).astype(np.int64)
    by_depth = np.lexsort((parent, depth))
    edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    levels = [by_depth[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    size = np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    # places in depth-first order
    pre = np.zeros(n, np.int64)
    tops = levels[0]
    pre[tops] = np.cumsum(size[tops]) - size[tops]
    for level in levels[1:]:
        ahead = np.cumsum(size[level]) - size[level]
        fresh = np.concatenate(([True], parent[level][1:] != parent[level][:-1]))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(level)), 0))
        pre[level] = pre[parent[level]] + 1 + ahead - ahead[start]
    order = np.argsort(pre)  # from here on a node's number is its place
    moved_up = np.where(parent[order] >= 0, pre[parent[order]], -1)
    whole = size[order]
    left = whole.copy()
    values = frame[["leaves", "tokens"]].to_numpy()[order].astype(np.int64)
    out = frame[["more_leaves", "more_tokens"]].to_numpy()[order].astype(np.int64)
    top_of = {g: p for g, p in zip(group[tops], pre[tops], strict=True)}
    comp = np.array([top_of[g] for g in group[order]], np.int64)
    open_ = np.arange(n)
    while len(open_):
        own = comp[open_]
        total = np.bincount(own, minlength=n)
        heavy = open_[2 * left[open_] >= total[own]]
        ranked = heavy[np.lexsort((left[heavy], comp[heavy]))]
        first = ranked[np.concatenate(([True], comp[ranked][1:] != comp[ranked][:-1]))]
        centre = np.full(n, -1, np.int64)
        centre[comp[first]] = first
        z = centre[own]
        inside = (open_ >= z) & (open_ < z + whole[z])
        below_z = np.zeros((n, 2), np.int64)
        np.add.at(below_z, own[inside], values[open_[inside]])
        out[heavy] += below_z[comp[heavy]]
        path = heavy[heavy != centre[comp[heavy]]]
        left[path] -= left[centre[comp[path]]]
        inner = open_[inside & (open_ != z)]
        inner = inner[np.argsort(comp[inner], kind="stable")]
        starts = moved_up[inner] == centre[comp[inner]]
        open_ = open_[open_ != z]
        if len(inner):
            last = np.maximum.accumulate(np.where(starts, np.arange(len(inner)), 0))
            comp[inner] = inner[last]
    back = np.empty((n, 2), np.int64)
    back[order] = out
    return back


_NODE = "node long, depth long, parent long, ct long, cd long, leaves long, tokens long, more_leaves long, more_tokens long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components stand side by side; they are solved together once enough nodes are read."""
    held: list[pd.DataFrame] = []
    rows = 0

    def result(frame: pd.DataFrame) -> pa.RecordBatch:
        totals = solve(frame)
        return pa.RecordBatch.from_arrays(
            [pa.array(frame["node"].to_numpy()), pa.array(frame["depth"].to_numpy()), pa.array(totals[:, 0]),
             pa.array(totals[:, 1])], names=["node", "depth", "n_leaves", "saved_tokens"])

    for batch in batches:
        held.append(batch.to_pandas())
        rows += batch.num_rows
        if rows >= TOGETHER:
            frame = pd.concat(held, ignore_index=True)
            last = frame.iloc[-1]
            open_ = (frame["ct"] == last["ct"]) & (frame["cd"] == last["cd"])
            if not open_.all():
                yield result(frame[~open_].reset_index(drop=True))
            held, rows = [frame[open_]], int(open_.sum())
    if rows:
        yield result(pd.concat(held, ignore_index=True))


def rolled_up(nodes: DataFrame, member: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, depth, n_leaves, saved_tokens): totals of ``leaves`` and ``tokens`` over each node's subtree.

    ``nodes`` has node, depth, parent, top (the node of depth 1 over it), leaves and tokens; ``member`` gives
    the node of every conversation at every depth.
    """
    none = F.lit(0).cast("long")
    state = nodes.select(
        "node", "depth", "parent", F.col("top").alias("ct"), F.lit(1).cast("long").alias("cd"), "leaves", "tokens",
        none.alias("more_leaves"), none.alias("more_tokens"))
    trees = stored(state.groupBy("ct").agg(F.count("*").alias("total")), "trees")
    n_large = trees.where(F.col("total") > local).count()
    finished, parts = [], [state]
    if n_large:
        large = small(trees.where(F.col("total") > local).select("ct"), n_large)
        finished, more = _split_large(state.join(large, "ct", "left_semi"), member, local)
        parts = [state.join(large, "ct", "left_anti"), *more]
    columns = [c.split()[0] for c in _NODE.split(", ")]
    every = parts[0].select(*columns)
    for part in parts[1:]:
        every = every.union(part.select(*columns))
    out = mapped(
        every.repartition("ct", "cd").sortWithinPartitions("ct", "cd"), _solved,
        "node long, depth long, n_leaves long, saved_tokens long")
    for done in finished:
        out = out.union(done)
    return stored(out, "totals")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, key, ids = 0, None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "node": [key[1]], "at": [at], "ids": [",".join(ids)]})

    for batch in batches:
        for depth, node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id")), strict=True):
            if key is not None and ((depth, node) != key or len(ids) >= PIECE):
                yield piece()
                at, ids = at + 1, []
            key = (depth, node)
            ids.append(str(conv))
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, out = None, None, {"depth": [], "node": [], "ends_sha256": []}

    def close() -> None:
        for name, value in zip(out, (*key, sha.hexdigest()), strict=True):
            out[name].append(value)

    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if (depth, node) == key:
                sha.update(b",")
            else:
                if key is not None:
                    close()
                key, sha = (depth, node), hashlib.sha256()
            sha.update(ids.encode())
        yield pa.RecordBatch.from_pydict(out)
        out = {"depth": [], "node": [], "ends_sha256": []}
    if key is not None:
        close()
        yield pa.RecordBatch.from_pydict(out)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the conversations (depth, node, conv_id) that end in a node."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["depth", "node", "conv_id"]
    pieces = mapped(
        ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order), _pieces,
        "depth long, node long, at long, ids string").withColumn("part", F.spark_partition_id())
    pieces = stored(pieces, "pieces").repartition("depth", "node").sortWithinPartitions("depth", "node", "part", "at")
    return mapped(pieces.select("depth", "node", "ids"), _digests, "depth long, node long, ends_sha256 string")


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal turns by role and text; repeated rows are turns of their
    own. A null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    The head of a negative id's family is the next multiple of 20 at or below it. An empty table has no
    nodes, not even a root. Other columns are ignored.
    """
    convs, prefixes = rebuilt(conversations)
    key = ["depth", "ka", "kb"]
    found = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    found = stored(found, "found")
    member = stored(
        prefixes.join(found.select(*key, "node"), key).select("conv_id", "depth", "node", "is_end"), "member")
    discard(prefixes)
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    top = F.lit(whole.conv_id).cast("long")
    named = at_depth(found.drop("ka", "kb"), member, F.col("depth") - 1, "parent")
    named = stored(at_depth(named, member, F.lit(1), "top").withColumn(
        "parent", F.when(F.col("depth") == 1, top).otherwise(F.col("parent"))), "named")
    children = named.where("depth > 1").groupBy(
        F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(named.join(children, ["node", "depth"], "left").select(
        "node", "depth", "parent", "top", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("tokens")), "nodes")
    totals = rolled_up(nodes, member, local)
    nowhere = convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), top.alias("node"), "conv_id")
    digests = ends_digest(member.where("is_end").select("depth", "node", "conv_id").union(nowhere))
    rooted = nodes.agg(
        top.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(whole.n_convs).cast("long").alias("n_convs"), F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"),
        F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("saved_tokens"),
    ).where("n_convs > 0")
    below_root = nodes.join(totals, ["node", "depth"]).select(
        "node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return below_root.union(rooted).join(digests, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
