"""The conversation trie and the vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from perchero.llm import codebooks, conversation_trie

TURNS = "conv_id long, turn long, role string, text string, node long, depth string, n_convs int"


def trie_by_hand(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members, kids, totals, out = {}, {}, {}, set()
    for c, sequence in rebuilt.items():
        for d in range(len(sequence) + 1):
            members.setdefault(sequence[:d], []).append(c)
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(key, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        totals[key] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[key]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(members[key]) if len(rebuilt[c]) == len(key))
        out.add((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(below),
                 *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed, n_convs, first_id=0, longest=9):
    draw, rows = random.Random(seed), []
    for c in range(first_id, first_id + n_convs):
        for turn in range(draw.randrange(1, longest)):
            rows.append((c, draw.choice((turn, turn, 3, None)), draw.choice(("user", "bot", None)),
                         draw.choice(("", "hi", "hi  there", "a\tb c", None, "x" * 3000))))
    return rows


#: Ties, nulls and repeats; one opening for all; a long conversation; an absent head, too few turns.
CASE = (
    talk(1, 90, -45) * 2 + [(None, 1, "user", "no id")]
    + [(1000 + c, t, "u", "hello you" if t == 0 else f"{c % 7} {t}") for c in range(150) for t in range(4)]
    + [(2007, t, "u", f"turn {t % 3}") for t in range(70)] + talk(2, 12, 2060)
    + [(c, 1, "u", "one") for c in (3021, 3022, 3023, 3024, 3025, 3026, 3039)]
)


def test_trie(spark):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in CASE], TURNS).repartition(5)
    # small enough that the DataFrame rounds split components too
    got = conversation_trie.trie(frame, local=20).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == trie_by_hand(CASE)


def test_trie_of_nothing(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_centroids_of_many_shapes():
    """Chains, stars and random trees solved at once, against sums from the leaves up."""
    draw, rows, want = random.Random(3), [], {}
    for top in range(40):
        n = draw.choice((1, 2, 3, 50, 400))
        parent = {0: None}
        for v in range(1, n):
            parent[v] = {0: v - 1, 1: 0}.get(top % 3, draw.randrange(v))
        depth = {0: 5}
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        total = {v: np.array([draw.randrange(3), draw.randrange(100)]) for v in range(n)}
        for v in range(n):
            above = 1000 * top + parent[v] if v else -1
            rows.append((1000 * top + v, depth[v], above, 1000 * top, 5, *total[v], 1, 0))
        for v in range(n - 1, 0, -1):
            total[parent[v]] = total[parent[v]] + total[v]
        want |= {1000 * top + v: tuple(total[v] + np.array([1, 0])) for v in range(n)}
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in conversation_trie._NODE.split(", ")])
    frame = frame.sample(frac=1, random_state=1).sort_values("ct", kind="stable", ignore_index=True)
    assert {n: tuple(t) for n, t in zip(frame["node"], conversation_trie.solve(frame), strict=True)} == want


def codes_by_hand(rows, width):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.floor(x * 4096) for x in r[2]]))
    x = np.zeros((len(kept), width), np.int64)
    for k, (_, _, v) in enumerate(kept):
        x[k, : len(v)] = np.floor(np.array(v, np.float32).astype(float) * 4096)
    x = x.reshape(len(kept), 8, width // 8)
    books = x[:16].transpose(1, 0, 2).copy()

    def nearest():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(2), far.min(2)

    for _ in range(6):
        index, _ = nearest()
        for part in range(8):
            for entry in range(books.shape[1]):
                own = x[index[:, part] == entry, part]
                if len(own):
                    books[part, entry] = own.sum(0) // len(own)
    index, far = nearest()
    of_label = {}
    for (_, label, _), f in zip(kept, far.sum(1), strict=True):
        of_label[label] = of_label.get(label, 0) + int(f)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), int(f), of_label[label], sha) for (i, label, _), c, f in zip(
        kept, index.astype(np.uint8), far.sum(1), strict=True)), key=str)


VECTORS = "vec_id long, label int, embedding array<float>, code string, error int, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "c", 1, 2) for i, label, v in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("limit", [codebooks.BROADCAST_ROWS, 0])
def test_codes(spark, monkeypatch, limit):
    draw = np.random.default_rng(4)
    one = [float(np.float32(v)) for v in draw.normal(size=24)]
    rows = [(i, int(i) % 3 or None, [float(np.float32(v)) for v in draw.normal(size=24)]) for i in range(300)]
    rows += [(i, 7, one) for i in range(400, 600)] + [(5, 1, one), (5, 1, one), (None, None, one)]
    rows += [(1000, 1, None), (1001, 1, [1.0, None] * 12), (1002, 2, [float("nan")] * 24), (1003, 2, [float("inf")] * 24)]
    monkeypatch.setattr(codebooks, "GROUP_ROWS", 37)
    monkeypatch.setattr(codebooks.with_label_error, "__defaults__", (limit,))
    got, books = codebooks.compressed(vectors(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_by_hand(rows, 24)
    assert books.shape == (8, 16, 3)


def test_codes_of_few_short_and_no_vectors(spark):
    rows = [(3, 1, [0.5] * 3), (2, 1, []), (1, None, [-0.25] * 9)]
    got, _ = codebooks.compressed(vectors(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_by_hand(rows, 16)
    for none in ([], [(1, 1, None)]):
        assert codebooks.compressed(vectors(spark, none))[0].count() == 0
