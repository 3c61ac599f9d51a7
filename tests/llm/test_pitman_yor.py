"""The language model against brute force: counts, seatings, a naive model, held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from perchero.llm import pitman_yor
from perchero.llm.textblock import mixed

SCHEMA = "doc_id long, text string, score int, part string, block long, held_out string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))] + [None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def prose(seed, n):
    draw = random.Random(seed)
    lexicon = [("".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 6)))) for _ in range(60)]
    return " ".join(lexicon[min(int(draw.expovariate(0.1)), 59)] for _ in range(n))


ROWS = [(i, prose(i % 4, 40 + i)) for i in range(60)] + [
    (60, None), (61, ""), (62, "  \t\n"), (63, "One"), (64, "x" * 5000), (65, prose(9, 9000)), (66, "\x1c\x85 a"),
    (7, prose(1, 30)), (7, prose(1, 30)), (None, "no id A b"), (None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2, "h") for i, t in rows], SCHEMA).repartition(3)


def by_hand(rows, own):
    """Scores under the first seating, one table for every entry, from dictionaries."""
    tokens = [words(t) for _, t in rows]
    learn = [ws for (i, _), ws in zip(rows, tokens, strict=True) if not held(i)]
    count = Counter(w for ws in learn for w in ws)
    n, v = sum(count.values()), len(count)
    rich = {w for w, c in count.items() if w is not None and c * own >= n}

    def kind(w):
        return "start" if w is None else int(mixed(np.array([(w[-2] if len(w) > 1 else 0) << 8 | w[-1]], np.uint64))[0] % 256)

    def above(c):
        return kind(c[1]) if c[0] == "own" else c[1]

    def contexts(ws):
        return [("own", u) if u in rich else ("class", kind(u)) for u in [None, *ws[:-1]]]

    low = Counter((c, w) for ws in learn for c, w in zip(contexts(ws), ws, strict=True))
    own_c = {e: c for e, c in low.items() if e[0][0] == "own"}
    class_c = Counter({(c[1], w): k for (c, w), k in low.items() if c[0] == "class"})
    class_c.update((above(c), w) for c, w in own_c)
    root_c = Counter(w for _, w in class_c)
    levels = [Counter(x.values()) for x in (root_c, class_c, own_c)]
    d = [min(max(x[1] / max(x[1] + 2 * x[2], 1), 0.05), 0.95) for x in levels]

    def p_root(w):
        t = len(root_c)
        rest = (1 + d[0] * t) / (v + 1)
        return (root_c[w] - d[0] * (w in root_c) + rest) / (1 + sum(root_c.values()))

    def mixed_in(table, key, place, upper, discount):
        mine = [c for e, c in table.items() if e[0] == place]
        there = table.get(key, 0)
        return (there - discount * (there > 0) + (1 + discount * len(mine)) * upper) / (1 + sum(mine))

    memo = {}

    def p(c, w):
        if (c, w) not in memo:
            k = above(c)
            q = mixed_in(class_c, (k, w), k, p_root(w), d[1])
            memo[c, w] = mixed_in(own_c, (c, w), c, q, d[2]) if c[0] == "own" else q
        return memo[c, w]

    out = []
    for (i, _), ws in zip(rows, tokens, strict=True):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = sum(math.log10(p(c, w)) for c, w in zip(contexts(ws), ws, strict=True))
        out.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-6)


def order(row):
    return (str(row[0]), row[2], round(row[5], 3))


@pytest.mark.parametrize("own", [100, 1])
def test_first_seating(spark, monkeypatch, own):
    """Against dictionaries; all steps but the draws."""
    got = [tuple(r) for r in pitman_yor.scored(frame(spark, ROWS), own, 0, 0).collect()]
    close(sorted(got, key=order), sorted(by_hand(ROWS, own), key=order))


def test_sampled_model(spark):
    """The base columns stay, and texts like the learnt ones become likelier."""
    got = [tuple(r) for r in pitman_yor.scored(frame(spark, ROWS)).collect()]
    want = by_hand(ROWS, 2048)
    close(sorted((r[:6] for r in got), key=order), sorted((r[:6] for r in want), key=order))
    kept_out = [r for r in got if r[1] and r[2] > 20]
    assert kept_out and sum(r[6] for r in kept_out) > sum(r[5] for r in kept_out)
    assert all(r[6] < 0 for r in got)


def test_no_training_texts_and_no_texts(spark):
    rows = [(i, "a b a") for i in range(40) if held(i)]
    got = pitman_yor.scored(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(tuple(r)[2:] == (4, 0, 0, 0.0, 0.0) for r in got)
    assert pitman_yor.scored(frame(spark, [])).count() == 0


def seatings(n):
    """All ways to seat n customers, as lists of table sizes."""
    if n == 0:
        yield []
        return
    for before in seatings(n - 1):
        for k in range(len(before)):
            yield [*before[:k], before[k] + 1, *before[k + 1:]]
        yield [*before, 1]


def test_drawn_tables():
    """Against the enumeration of all seatings; beyond ``EXACT`` against seating one by one."""
    d, mass, base = 0.6, 2.5, 0.3
    stirling = pitman_yor.log_stirling(d)
    draw = np.random.default_rng(5)
    for c in (1, 2, 5, 8):
        weight = Counter()
        for sizes in seatings(c):
            inside = math.prod(i - d for s in sizes for i in range(1, s))
            weight[len(sizes)] += inside * math.prod((mass + d * j) * base for j in range(len(sizes)))
        n = 40_000
        got = np.bincount(pitman_yor.tables_drawn(
            np.full(n, c), np.full(n, mass), np.full(n, base), d, stirling, draw), minlength=c + 1)
        for t in range(1, c + 1):
            share = weight[t] / sum(weight.values())
            assert abs(got[t] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-9
    n, c = 400, 3000
    got = pitman_yor.tables_drawn(np.full(n, c), np.full(n, mass), np.full(n, base), d, stirling, draw)
    tables = pitman_yor.tables_drawn(np.full(n, 64), np.full(n, mass), np.full(n, base), d, stirling, draw)
    for seated in range(64, c):
        new = (mass + d * tables) * base
        tables = tables + (draw.random(n) < new / (new + seated - d * tables))
    assert got.mean() == pytest.approx(tables.mean(), rel=0.1) and got.std() == pytest.approx(tables.std(), rel=0.3)


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(6)
    n_words, parent = 50, np.array([3, 3, 250])
    places = [0, 3, 250, 256, 257, 258, 259]
    entries = sorted({(int(w), int(c)) for w, c in zip(draw.integers(0, n_words, 300), draw.choice(places, 300), strict=True)})
    word, context = (np.array(x) for x in zip(*entries, strict=True))
    seating = pitman_yor.Seating(
        np.arange(n_words, dtype=np.uint64), word, context, draw.integers(1, 200, len(word)), parent)
    all_ = pitman_yor.Totals(seating.totals(), 3)
    d = all_.discounts()
    uniform = 1 / (n_words + 1)
    for _ in range(3):
        seating.sweep(all_, d, [pitman_yor.log_stirling(x) for x in d], uniform, draw)
        all_ = pitman_yor.Totals(seating.totals(), 3)
        for c in places:
            asked = np.arange(n_words + 1)  # the last one was never seen
            p = seating.probabilities(
                asked.astype(np.uint64), asked, np.full(n_words + 1, c), all_, d, uniform, parent)
            assert (p > 0).all() and p.sum() == pytest.approx(1)
