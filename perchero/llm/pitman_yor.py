"""Hierarchical Pitman-Yor language model: seating sampled by Gibbs, predictive probabilities averaged.

Restaurants. A word is drawn in the restaurant of its context, the word before it. A word that makes up
at least one in ``OWN`` of all training tokens has a restaurant of its own (so at most ``OWN`` of them); all
others share the restaurant of their class, the last two bytes folded to ``CLASSES`` classes, and the start
of a text is a class of its own. A word's own restaurant sends its tables to its class, a class sends its
tables to the root, and the root's base is uniform over the vocabulary and one unknown word.

State. What matters of a seating are the customers and tables of each (restaurant, word). They are dealt out
by word: a word has at most as many entries as there are restaurants, so no word, however frequent, makes a
task unbounded, and the counts of a restaurant with a third of all tokens are spread over all tasks. Tables that a
word opens below are its customers above, in the same task. Shared between tasks are only the totals of the
restaurants, a vector of fixed size, which every sweep sums and sends out again.

Gibbs. A sweep redraws, level by level, the number of tables of every entry given everything else, with
the totals of the last sweep: ``p(t) ~ S(c, t) base^t (a)(a + d)...(a + (t - 1) d)``, ``S`` the generalised Stirling
number (all seatings of c customers at t tables), ``a = strength + d * other tables of the restaurant``. Entries of
more than ``EXACT`` customers are seated so far exactly and then onwards in groups of a sixteenth of those
seated, each group with the chance of a new table that its middle customer has.

Scoring. Texts are cut once into blocks of about ``BLOCK_TOKENS`` tokens. A block asks each part of the model once for
its distinct (context, word) entries, gets probabilities back, and sums them over its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import discard, mapped, stored
from perchero.llm.textblock import Block, blocks, mixed, run_hashes

CLASSES, OWN = 256, 2048
#: Contexts are numbered: classes, the start of a text, then the words with a restaurant of their own.
START = CLASSES
FIRST_OWN = CLASSES + 1
END = np.uint64(1)
STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 3
EXACT = 64
BLOCK_TOKENS = 1 << 21


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def opened(blob: pa.BinaryScalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), kind)


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, texts side by side with their ends, and the tokens per text."""
    lowered = block.lowered()
    starts, ends = block.plain_words()
    row = block.row_of(starts) if len(starts) else np.zeros(0, np.int64)
    lengths = (block.per_row(row) if len(starts) else np.zeros(block.rows, np.int64)) + 1
    hashes = np.full(int(lengths.sum()), END, np.uint64)
    classes = np.zeros(len(hashes), np.uint16)
    if len(starts):
        place = np.arange(len(starts)) + row
        hashes[place] = run_hashes(lowered, starts, ends)
        last = lowered[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, lowered[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        classes[place] = (mixed((before << np.uint64(8)) | last) % np.uint64(CLASSES)).astype(np.uint16)
    return hashes, classes, lengths


def contexts(hashes: np.ndarray, classes: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Context number of every token; ``own`` holds the sorted hashes of words with their own restaurant."""
    context = np.empty(len(hashes), np.uint16)
    context[1:] = classes[:-1]
    if len(own):
        at = np.minimum(np.searchsorted(own, hashes[:-1]), len(own) - 1)
        hit = own[at] == hashes[:-1]
        context[1:][hit] = (FIRST_OWN + at[hit]).astype(np.uint16)
    context[np.cumsum(lengths) - lengths] = START
    return context


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Tokens of about ``BLOCK_TOKENS`` at a time: hashes, classes, lengths, ids, held out or not."""
    held: list[tuple] = []
    size = 0

    def whole() -> tuple:
        return (*(np.concatenate([h[i] for h in held]) for i in range(3)),
                *(pa.concat_arrays([h[i] for h in held]) for i in (3, 4)))

    for batch in batches:
        for block in blocks(batch):
            found = tokens_of(block)
            held.append((*found, batch.column("doc_id").slice(block.first, block.rows),
                         batch.column("held_out").slice(block.first, block.rows)))
            size += len(found[0])
            if size >= BLOCK_TOKENS:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training words of each block with their class and number."""
    for hashes, classes, lengths, _, held_out in _gathered(batches):
        learn = np.repeat(~held_out.to_numpy(zero_copy_only=False), lengths)
        word, first, times = np.unique(hashes[learn], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(classes[learn][first].astype(np.int32)), pa.array(times)],
            names=["word", "class", "n"])


def parts_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(words ^ np.uint64(77)) % np.uint64(parts)).astype(np.int64)


def _asked(own: np.ndarray, parts: int):
    """Blocks with the entry of each token (part -1), and what a block asks of each part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for hashes, classes, lengths, ids, held_out in _gathered(batches):
            context = contexts(hashes, classes, lengths, own)
            words, which = np.unique(hashes, return_inverse=True)
            part = parts_of(words, parts)
            order = np.argsort(part, kind="stable")  # by part, then hash
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words, part = words[order], part[order]
            code = (rank[which] << 16) | context
            entry, where, = np.unique(code, return_inverse=True)
            learn = np.repeat(~held_out.to_numpy(zero_copy_only=False), lengths)
            times = np.bincount(where[learn], minlength=len(entry))
            yield _request(
                block, -1, ids.type, doc_ids=ids, held_out=held_out, lengths=packed(lengths),
                codes=packed(where.astype("<u4")))
            word_of = entry >> 16
            spans = np.bincount(word_of, minlength=len(words))
            upto = np.concatenate(([0], np.cumsum(spans)))
            present, firsts = np.unique(part, return_index=True)
            for p, a, b in zip(present, firsts, [*firsts[1:], len(words)], strict=True):
                mine = slice(upto[a], upto[b])
                yield _request(
                    block, int(p), ids.type, words=packed(words[a:b]), spans=packed(spans[a:b].astype("<u2")),
                    context=packed((entry[mine] & 0xFFFF).astype("<u2")), times=packed(times[mine]))
            block += 1

    return ask


_BLOBS = ("lengths", "codes", "words", "spans", "context", "times")


def _request(block: int, part: int, kind: pa.DataType, doc_ids=None, held_out=None, **blobs) -> pa.RecordBatch:
    def one(values, of):
        return pa.array([None], pa.list_(of)) if values is None else pa.ListArray.from_arrays(
            pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([part], pa.int32()), one(doc_ids, kind), one(held_out, pa.bool_()),
         *(pa.array([blobs.get(name)], pa.binary()) for name in _BLOBS)],
        names=["block", "part", "doc_ids", "held_out", *_BLOBS])


def entries_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word number of each entry, its context and its training count."""
    words = opened(row["words"], "<u8")
    spans = opened(row["spans"], "<u2").astype(np.int64)
    return words, np.repeat(np.arange(len(words)), spans), opened(row["context"], "<u2"), opened(row["times"], "<i8")


# ---------------------------------------------------------------- seating


def log_stirling(discount: float, upto: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t up to ``upto``: S(c, t) = S(c - 1, t - 1) + (c - 1 - t d) S(c - 1, t)."""
    table = np.full((upto + 1, upto + 1), -np.inf)
    table[0, 0] = 0
    for c in range(1, upto + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = table[c - 1, t] + np.log(np.maximum(c - 1 - t * discount, 0))
        table[c, t] = np.logaddexp(table[c - 1, t - 1], stay)
    return table


def tables_drawn(
    customers: np.ndarray, mass: np.ndarray, base: np.ndarray, discount: float, stirling: np.ndarray,
    draw: np.random.Generator,
) -> np.ndarray:
    """Tables of each entry given its customers, ``mass`` (strength + d * others' tables) and base probability."""
    tables = np.minimum(customers, 1)
    seated = np.minimum(customers, EXACT)
    order = np.argsort(seated, kind="stable")
    edges = np.searchsorted(seated[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        group = order[edges[c - 2]: edges[c - 1]]
        for at in range(0, len(group), max(1, (1 << 21) // c)):
            own = group[at: at + max(1, (1 << 21) // c)]
            t = np.arange(1, c + 1)
            weight = np.cumsum(np.log(mass[own, None] + discount * (t - 1)), axis=1)
            weight += t * np.log(base[own, None]) + stirling[c, t]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (weight < draw.random((len(own), 1)) * weight[:, -1:]).sum(axis=1)
    more = np.flatnonzero(customers > EXACT)
    done = np.full(len(more), EXACT, np.int64)
    while len(more):
        group = np.minimum(np.maximum(done // 16, 1), customers[more] - done)
        new = (mass[more] + discount * tables[more]) * base[more]
        old = done + group / 2 - discount * tables[more]
        tables[more] += draw.binomial(group, new / (new + old))
        done += group
        on = done < customers[more]
        more, done = more[on], done[on]
    return tables


class Totals:
    """Customers and tables of all restaurants, and the discount of each level: one vector of fixed size."""

    def __init__(self, values: np.ndarray, n_own: int):
        self.values, self.n_own = values, n_own
        at = [0, n_own, 2 * n_own, 2 * n_own + FIRST_OWN, 2 * (n_own + FIRST_OWN)]
        self.own_c, self.own_t, self.class_c, self.class_t = (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        self.root_c, self.root_t = values[at[-1]: at[-1] + 2]
        #: entries with one and with two customers, by level from the root down
        self.ones, self.twos = values[at[-1] + 2: at[-1] + 5], values[at[-1] + 5: at[-1] + 8]

    @staticmethod
    def size(n_own: int) -> int:
        return 2 * (n_own + FIRST_OWN) + 8

    def discounts(self) -> list[float]:
        """Per level the usual estimate from how many entries have one and two customers."""
        found = self.ones / np.maximum(self.ones + 2 * self.twos, 1)
        return [float(min(max(x, 0.05), 0.95)) for x in found]


class Seating:
    """The entries of one part of the vocabulary and their customers and tables on the three levels."""

    def __init__(self, words: np.ndarray, word: np.ndarray, context: np.ndarray, times: np.ndarray, parent: np.ndarray):
        self.words, self.word, self.context, self.times = words, word, context.astype(np.int64), times
        self.n_own = len(parent)
        self.is_own = self.context >= FIRST_OWN
        self.own = self.context[self.is_own] - FIRST_OWN
        above = self.context.copy()
        above[self.is_own] = parent[self.own]
        self.key, at = np.unique(word * FIRST_OWN + above, return_inverse=True)
        self.class_word, self.of_class = self.key // FIRST_OWN, self.key % FIRST_OWN
        self.up = at[self.is_own]
        self.direct = np.bincount(at[~self.is_own], times[~self.is_own], len(self.key)).astype(np.int64)
        self.own_c = times[self.is_own]
        self.seat(np.ones(len(self.own), np.int64), np.ones(len(self.key), np.int64), np.ones(len(words), np.int64))

    def seat(self, own_t: np.ndarray, class_t: np.ndarray, root_t: np.ndarray) -> None:
        self.own_t, self.class_t, self.root_t = own_t, class_t, root_t
        self.class_c = self.direct + np.bincount(self.up, own_t, len(self.key)).astype(np.int64)
        self.root_c = np.bincount(self.class_word, class_t, len(self.words)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Training tokens of each word."""
        return np.bincount(self.word, self.times, len(self.words)).astype(np.int64)

    def totals(self) -> np.ndarray:
        own, n = self.own, self.n_own
        levels = (self.root_c, self.class_c, self.own_c)
        return np.concatenate((
            np.bincount(own, self.own_c, n), np.bincount(own, self.own_t, n),
            np.bincount(self.of_class, self.class_c, FIRST_OWN), np.bincount(self.of_class, self.class_t, FIRST_OWN),
            [self.root_c.sum(), self.root_t.sum()],
            [(c == 1).sum() for c in levels], [(c == 2).sum() for c in levels])).astype(np.int64)

    def root_p(self, all_: Totals, d: list[float], uniform: float) -> np.ndarray:
        return (self.root_c - d[0] * self.root_t + (STRENGTH + d[0] * all_.root_t) * uniform) / (STRENGTH + all_.root_c)

    def class_p(self, all_: Totals, d: list[float], root: np.ndarray) -> np.ndarray:
        k = self.of_class
        rest = (STRENGTH + d[1] * all_.class_t[k]) * root[self.class_word]
        return (self.class_c - d[1] * self.class_t + rest) / (STRENGTH + all_.class_c[k])

    def sweep(self, all_: Totals, d: list[float], stirling: list, uniform: float, draw: np.random.Generator) -> None:
        root = self.root_p(all_, d, uniform)
        classes = self.class_p(all_, d, root)
        mass = STRENGTH + d[2] * np.maximum(all_.own_t[self.own] - self.own_t, 0)
        own_t = tables_drawn(self.own_c, mass, classes[self.up], d[2], stirling[2], draw)
        self.seat(own_t, self.class_t, self.root_t)
        mass = STRENGTH + d[1] * np.maximum(all_.class_t[self.of_class] - self.class_t, 0)
        class_t = tables_drawn(self.class_c, mass, root[self.class_word], d[1], stirling[1], draw)
        self.seat(own_t, class_t, self.root_t)
        mass = STRENGTH + d[0] * np.maximum(all_.root_t - self.root_t, 0)
        root_t = tables_drawn(self.root_c, mass, np.full(len(self.words), uniform), d[0], stirling[0], draw)
        self.seat(own_t, class_t, root_t)

    def probabilities(
        self, words: np.ndarray, word: np.ndarray, context: np.ndarray, all_: Totals, d: list[float], uniform: float,
        parent: np.ndarray,
    ) -> np.ndarray:
        """Predictive probability of each asked entry (word number in ``words``, context) under this seating."""
        root = self.root_p(all_, d, uniform)
        at, known = _found(self.words, words)
        unseen = (STRENGTH + d[0] * all_.root_t) * uniform / (STRENGTH + all_.root_c)
        root_asked = np.where(known, root[at], unseen) if len(root) else np.full(len(words), unseen)
        mine, known = at[word], known[word]
        context = context.astype(np.int64)
        is_own = context >= FIRST_OWN
        own = np.where(is_own, context - FIRST_OWN, 0)
        k = np.where(is_own, parent[own], context) if len(parent) else context
        p = (STRENGTH + d[1] * all_.class_t[k]) * root_asked[word]
        place, there = _found(self.key, mine * FIRST_OWN + k)
        there &= known
        p[there] += (self.class_c - d[1] * self.class_t)[place[there]]
        p /= STRENGTH + all_.class_c[k]
        if is_own.any():
            u = own[is_own]
            q = (STRENGTH + d[2] * all_.own_t[u]) * p[is_own]
            keys = self.word[self.is_own] << 16 | self.context[self.is_own]
            place, there = _found(keys, mine[is_own] << 16 | context[is_own])
            there &= known[is_own]
            q[there] += (self.own_c - d[2] * self.own_t)[place[there]]
            p[is_own] = q / (STRENGTH + all_.own_c[u])
        return p


def _found(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked value in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return at, sorted_[at] == asked


_STATE = ("part int, words binary, spans binary, context binary, times binary, own_t binary, class_t binary, "
          "root_t binary, kept array<binary>, totals binary")


def _state_row(part: int, seating: Seating, kept: list[bytes]) -> pa.RecordBatch:
    spans = np.bincount(seating.word, minlength=len(seating.words)).astype("<u2")
    blobs = [packed(x) for x in (
        seating.words, spans, seating.context.astype("<u2"), seating.times, seating.own_t, seating.class_t,
        seating.root_t)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs),
         pa.array([kept], pa.list_(pa.binary())), pa.array([packed(seating.totals())], pa.binary())],
        names=[c.split()[0] for c in _STATE.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def _merged(parent: np.ndarray):
    """Requests of one part, side by side, to the first seating: every entry at one table."""

    def merge(rows: list[dict]) -> Seating:
        found = [entries_of(r) for r in rows]
        word = np.concatenate([f[0][f[1]] for f in found])
        context = np.concatenate([f[2] for f in found])
        times = np.concatenate([f[3] for f in found])
        learnt = times > 0
        word, context, times = word[learnt], context[learnt], times[learnt]
        order = np.lexsort((context, word))
        word, context, times = word[order], context[order], times[order]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
        firsts = np.flatnonzero(fresh)
        times = np.add.reduceat(times, firsts) if len(firsts) else times
        words, number = np.unique(word[firsts], return_inverse=True)
        return Seating(words, number, context[firsts], times, parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for row in _rows(batches):
            if row["part"].as_py() != part:
                if held:
                    yield _state_row(part, merge(held), [])
                part, held = row["part"].as_py(), []
            held.append(row)
        if held:
            yield _state_row(part, merge(held), [])

    return run


def _restored(row: dict, parent: np.ndarray) -> Seating:
    words, word, context, times = entries_of(row)
    seating = Seating(words, word, context, times, parent)
    seating.seat(*(opened(row[name], "<i8") for name in ("own_t", "class_t", "root_t")))
    return seating


def _swept(sweep: int, all_: Totals, d: list[float], uniform: float, parent: np.ndarray, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = [log_stirling(x) for x in d]
        for row in _rows(batches):
            seating, part = _restored(row, parent), row["part"].as_py()
            seating.sweep(all_, d, stirling, uniform, np.random.default_rng((part, sweep)))
            kept = row["kept"].as_py() or []
            if keep:
                kept = [*kept, *(packed(x) for x in (seating.own_t, seating.class_t, seating.root_t))]
            yield _state_row(part, seating, kept)

    return run


def summed(state: DataFrame, n_own: int) -> Totals:
    """The totals of all parts: summed in the tasks, then by slot."""
    width = Totals.size(n_own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for row in _rows(batches):
            total += opened(row["totals"], "<i8")
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "value"])

    out = np.zeros(width, np.int64)
    found = mapped(state.select("totals"), add, "slot long, value long")
    for r in found.groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r.value
    return Totals(out, n_own)


def _answered(samples: list[Totals], d: list[float], uniform: float, parent: np.ndarray):
    """Model row of a part, then its requests: log10 probabilities and training counts per asked entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seatings = None, []
        counts = np.zeros(0, np.int64)
        for row in _rows(batches):
            if row["part"].as_py() != part:
                part, seatings = row["part"].as_py(), []
            if row["kept"].is_valid:
                kept = row["kept"].as_py()
                if not kept:
                    seatings.append(_restored(row, parent))
                for s in range(len(kept) // 3):
                    seating = _restored(row, parent)
                    seating.seat(*(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8")
                                   for b in kept[3 * s: 3 * s + 3]))
                    seatings.append(seating)
                counts = seatings[0].counts()
                continue
            words, word, context, _ = entries_of(row)
            p = np.zeros(len(word))
            for seating, all_ in zip(seatings, samples, strict=True):
                p += seating.probabilities(words, word, context, all_, d, uniform, parent)
            at, known = _found(seatings[0].words, words)
            times = np.where(known, counts[at], 0) if len(counts) else np.zeros(len(words), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"].as_py()], pa.int64()), pa.array([part], pa.int32()),
                 pa.array([packed(np.log10(p / len(samples)).astype("<f4"))], pa.binary()),
                 pa.array([packed(times[word])], pa.binary())], names=["block", "part", "logs", "counts"])

    return run


def _scores(n_tokens: int, n_words: int):
    """A block's tokens (part -1), then the answers in the order of parts, to one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, logs, counts = None, [], []
        for row in _rows(batches):
            if row["part"].as_py() == -1:
                if block is not None:
                    yield scored_block(block, logs, counts)
                block, logs, counts = row, [], []
            else:
                logs.append(opened(row["logs"], "<f4"))
                counts.append(opened(row["counts"], "<i8"))
        if block is not None:
            yield scored_block(block, logs, counts)

    def scored_block(block: dict, logs: list, counts: list) -> pa.RecordBatch:
        lengths, codes = opened(block["lengths"], "<i8"), opened(block["codes"], "<u4")
        log, count = np.concatenate(logs).astype(float), np.concatenate(counts)
        base = np.log10((count + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        firsts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x[codes], firsts) for x in (base, log, (count > 0).astype(np.int64))]
        return pa.RecordBatch.from_arrays(
            [block["doc_ids"].values, block["held_out"].values, pa.array(lengths), pa.array(sums[2]),
             pa.array(np.full(len(lengths), n_tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(docs: DataFrame, own: int = OWN, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the runs of anything but white space, with A-Z in lower case, and one end. Texts with
    ``crc32(doc_id) mod 5 = 1`` are held out; the model learns from all others, which includes rows without an
    id. A null or empty text is its end alone. Rows that repeat an id are texts of their own. Without training
    texts every token has probability 1 (nothing but the unknown word). An empty table gives no rows. Other
    columns are ignored. ``samples = 0`` scores by the seating that the burn-in ends with (with no burn-in, one
    table an entry).
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    texts = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), (F.pmod(crc, F.lit(5)) == 1).alias("held_out"))
    vocabulary = stored(
        mapped(texts, _counted, "word long, class int, n long").groupBy("word").agg(
            F.sum("n").alias("n"), F.max("class").alias("class")), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    enough = (F.col("n") * own >= size.tokens) & (F.col("word") != int(END))
    frequent = vocabulary.where(enough).select("word", "class").collect()
    discard(vocabulary)
    frequent = sorted((np.uint64(r.word % (1 << 64)), r["class"]) for r in frequent)
    hashes = np.array([w for w, _ in frequent], np.uint64)
    parent = np.array([k for _, k in frequent], np.int64)
    uniform = 1 / (size.words + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.tokens // BLOCK_TOKENS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = stored(mapped(texts, _asked(hashes, parts), (
        f"block long, part int, doc_ids array<{kind}>, held_out array<boolean>, "
        + ", ".join(f"{b} binary" for b in _BLOBS))), "asked")
    requests = asked.where("part >= 0").select("block", "part", "words", "spans", "context", "times")
    dealt = requests.drop("block").repartition(parts, "part").sortWithinPartitions("part")
    state = stored(mapped(dealt, _merged(parent), _STATE), "seating")
    all_ = summed(state, len(parent))
    d = all_.discounts()
    drawn = []
    for sweep in range(burn_in + samples):
        after = stored(mapped(state, _swept(sweep, all_, d, uniform, parent, sweep >= burn_in), _STATE), "seating")
        discard(state)
        state, all_ = after, summed(after, len(parent))
        if sweep >= burn_in:
            drawn.append(all_)
    model = ["words", "spans", "context", "times", "own_t", "class_t", "root_t", "kept"]
    nothing = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in model[4:]]
    both = state.select(F.lit(-1).cast("long").alias("block"), "part", *model).union(
        requests.select("block", "part", *model[:4], *nothing))
    answers = mapped(
        both.repartition(parts, "part").sortWithinPartitions("part", "block"),
        _answered(drawn or [all_], d, uniform, parent), "block long, part int, logs binary, counts binary")
    tokens = asked.where("part = -1").select("block", "part", "doc_ids", "held_out", "lengths", "codes")
    tokens = tokens.select("*", *(F.lit(None).cast("binary").alias(c) for c in ("logs", "counts")))
    blank = (F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in tokens.columns[2:6])
    answers = answers.select("block", "part", *blank, "logs", "counts")
    return mapped(
        tokens.union(answers).repartition("block").sortWithinPartitions("block", "part"),
        _scores(size.tokens, size.words),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double")
