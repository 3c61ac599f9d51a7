"""The training-data operators against brute force, on edge cases."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perchero.llm import (
    decontaminate, jaccard, licenses, packing, pseudonyms, quality, repeats, separators, tokenfiles, toxicity,
)
from perchero.llm.encode import Encoder
from perchero.llm.textblock import Block

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, start long, n string"  # start and n clash with result columns


def noise(n: int, seed: int, letters: str = "abcdé \n") -> str:
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(n))


def sentence(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))


LONG = sentence(400, 1)
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "One"), (5, "tie"), (6, "tie"), (7, LONG), (8, LONG), (8, LONG),
    (9, LONG.replace(LONG[500:505], "zzzzz")), (10, noise(3000, 2)), (11, "x" * 700), (12, sentence(5000, 3)),
    (13, "Ünï 日本 don't\x1cstop  " * 30), (None, "no id"), (14, LONG[100:340] + " " + sentence(30, 4)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "n") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(rows, *columns):
    return sorted(tuple("" if r[c] is None else str(r[c]) for c in columns) for r in rows)


def test_repeats(docs, empty):
    texts = [(t or "").encode() for _, t in ROWS]
    places = {}
    for k, raw in enumerate(texts):
        for p in range(len(raw) - 199):
            places.setdefault(raw[p: p + 200], []).append((k, p))
    covered = [np.zeros(len(raw), bool) for raw in texts]
    for found in places.values():
        for k, p in found if len(found) > 1 else []:
            covered[k][p: p + 200] = True
    want = sorted(
        ("" if i is None else str(i), str(len(raw)), str(int(c.sum())),
         hashlib.sha256(np.frombuffer(raw, np.uint8)[~c].tobytes()).hexdigest())
        for (i, _), raw, c in zip(ROWS, texts, covered, strict=True))
    assert keyed(repeats.removed(docs).collect(), "doc_id", "n_bytes", "n_removed", "kept_sha256") == want
    assert repeats.removed(empty).count() == 0
    for r in repeats.occurrences(docs.where("doc_id in (7, 9)")).collect():
        text = dict(ROWS)[r.doc_id]
        assert r.length >= 200 and text[r.start: r.start + r.length] in dict(ROWS)[16 - r.doc_id]


def removed_by_hand(rows):
    """What :func:`repeats.removed` gives, from all places of all 200-byte windows."""
    texts = [(t or "").encode() for _, t in rows]
    places = {}
    for k, raw in enumerate(texts):
        for p in range(len(raw) - 199):
            places.setdefault(raw[p: p + 200], []).append((k, p))
    covered = [np.zeros(len(raw), bool) for raw in texts]
    for found in places.values():
        for k, p in found if len(found) > 1 else []:
            covered[k][p: p + 200] = True
    return sorted(
        ("" if i is None else str(i), str(int(c.sum())), str(int((np.diff(np.append(False, c).astype(int)) == 1).sum())),
         hashlib.sha256(np.frombuffer(raw, np.uint8)[~c].tobytes()).hexdigest())
        for (i, _), raw, c in zip(rows, texts, covered, strict=True))


def test_repeats_with_null_ids(spark):
    passage = noise(300, 20)
    rows = [(None, noise(400, 21) + passage + noise(400, 22)), (5, noise(500, 23) + passage + noise(300, 24)),
            (6, noise(450, 25) + passage[:250] + noise(350, 26)), (None, noise(900, 27))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = removed_by_hand(rows)
    assert sum(n != "0" for _, n, *_ in want) == 3
    assert keyed(repeats.removed(docs).collect(), "doc_id", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("crowded", [1, 3, 12])
def test_repeats_of_crowded_seeds(spark, crowded):
    boiler = noise(330, 30)
    draw = random.Random(31)
    rows = list(ROWS)
    for i in range(100, 140):
        a, b = draw.randrange(0, 90), draw.randrange(240, 331)
        rows.append((i, noise(draw.randrange(0, 250), 2 * i) + boiler[a:b] + noise(draw.randrange(0, 250), 2 * i + 1)))
    rows += [(200 + i, "-" * (150 + 30 * i) + noise(200, 300 + i)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, groups, rest = repeats._compared(docs, crowded)
    assert rest is not None and groups.groupBy("seed").agg(F.countDistinct("frame_a").alias("n")).where(F.col("n") > crowded).isEmpty()
    found = keyed(repeats.removed(docs, crowded).collect(), "doc_id", "n_removed", "n_spans", "kept_sha256")
    assert found == removed_by_hand(rows)


def test_interval_tree_finds_all_occurrences():
    core = noise(40, 7, "ab").encode()
    lefts = [b"p" * 168, b"p" * 168, b"q" + b"p" * 167]
    rights = [core + b"x" * 160, core + b"x" * 100 + b"y" * 60, core + b"x" * 160]
    found = {(tuple(sorted(m.tolist())), left, right) for m, left, right in repeats.maximal(lefts, rights)}
    assert ((0, 1), 168, 140) in found or ((0, 1, 2), 167, 140) in found
    assert ((0, 2), 167, 200) in found


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    pieces = packing.packed(docs.where("doc_id is not null and doc_id <> 8"), WORD, 64).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, text in ROWS:
        if i in (None, 8):
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        raw = b"".join(p.ids for p in sorted(by[i], key=lambda p: p.start))
        assert raw == np.array(ids, "<u4").tobytes() and all(p.doc_tokens == len(ids) for p in by[i])
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in by[i])
        starts = {p.start: p.length for p in by[i]}
        at = 0
        while at < len(ids):  # without a gap or an overlap
            at += starts.pop(at)
        assert at == len(ids) and not starts
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == 64 for s, n in filled.items() if s != max(filled))
    assert packing.packed(empty, WORD).count() == 0


def test_hilbert_is_a_path():
    side = np.arange(8)
    cells = np.array([(a, b) for a in side for b in side])
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = [t or "" for _, t in ROWS] + [
        "don't I'll we'S", "ß ﬁ Ǆ İ ΣΑΣ", "a \x85c\xa0d", "123 4.5,,, !!!", "\t\ttab end  ", "<|endoftext|> x"]
    ids, counts = Encoder(path).encode(texts)
    at = np.cumsum(counts)
    for text, end, n in zip(texts, at, counts, strict=True):
        assert ids[end - n: end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_special_tokens_as_the_tokenizer_reads_them(spark, path):
    tokenizer = Tokenizer.from_file(path)  # as loaded
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in names
    texts = ["plain words, two.", "a<|endoftext|>b", *[f"one {t} two \n\n{t}{t.upper()} x  {t}  " for t in names], *names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    pieces = sorted(packing.packed(docs, path, 64).collect(), key=lambda p: (p.doc_id, p.start))
    for i, ids in want.items():
        raw = b"".join(p.ids for p in pieces if p.doc_id == i)
        assert np.frombuffer(raw, "<u4")[:-1].tolist() == ids
    for r in tokenfiles.written_and_read(docs, path).collect():
        assert r.n_tokens == len(want[r.doc_id]) + 1
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for r in separators.token_counts(docs, path).collect():
        assert r.n_tokens == len(plain.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_token_files(docs, empty):
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    found = tokenfiles.written_and_read(docs, BYTE).collect()
    want = []
    for i, text in ROWS:
        raw = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append(("" if i is None else str(i), str(len(raw)), str(zlib.crc32(raw.tobytes()))))
    assert keyed(found, "doc_id", "n_tokens", "ids_crc32") == sorted(want)
    before = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    assert tokenfiles.written_and_read(empty, BYTE).count() == 0
    ids = np.random.default_rng(1).integers(0, 2**32, 150_000, dtype=np.uint32)
    assert (tokenfiles.round_trip(ids) == ids).all()
    counted = separators.token_counts(docs, BYTE, block_ids=37).collect()
    assert keyed(counted, "doc_id", "n_tokens") == sorted((i, str(int(n) - 1)) for i, n, _ in want)
    assert separators.token_counts(empty, BYTE).count() == 0


def test_jaccard(docs, empty):
    words = {i: (t or "").lower() for i, t in ROWS if i is not None}
    found = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert found[7].class_id == found[8].class_id == found[9].class_id == 7
    assert found[7].n_links == 3 and found[9].n_links == 3
    assert found[6].class_id == 5 and found[6].n_links == 1
    for i in (1, 2, 3, 4, 10, 12, 14):
        assert found[i].class_id == i and found[i].n_links == 0
    assert found[None].class_id is None and len(words) == 14
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7, 10, 11, 12, 13, 14]
    assert jaccard.near_duplicates(empty).count() == 0


def test_survivor_of_a_repeated_id(spark):
    """Whatever the partitions, one row of the id stays, by the hash of its text and of its other columns."""
    one, other, long = sentence(30, 60), sentence(30, 61), sentence(40, 62)
    rows = [(1, one, 5, "a"), (1, other, 5, "a"), (1, other, 4, "b"), (1, other, 6, "c"), (2, long, 1, "x"), (3, long, 1, "x"),
            (None, long, 1, "x"), (None, None, 1, "y")]
    kept = set()
    for n in (1, 2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, times long, doc_id_ string").repartition(n)
        got = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
        assert sorted(str(r[0]) for r in got) == ["1", "2", "None", "None"] and set(got) <= set(rows)
        kept.add(frozenset(got))
    assert len(kept) == 1


def test_posterior_bound():
    least = jaccard.fewest_matches()
    assert all(0 <= m < 0.8 * n for n, m in least.items()) and sorted(least.values()) == list(least.values())


def test_licenses(spark, docs, empty):
    texts = [(1, "x MIT\nLicense, the mit-license"), (2, "lisensed under the apache licence, version 2.0"),
             (3, "submit license"), (4, None), (5, "GNU General Public License, version 3")]
    found = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (2, 1, 4, "mit")
    assert (found[2].n_base, found[2].labels) == (0, "apache") and 0.9 < found[2].score < 1
    assert found[3].labels == "" and found[4].n_words == 0 and found[5].base_labels == "gpl"
    assert licenses.scanned(docs).count() == len(ROWS) and licenses.scanned(empty).count() == 0


def edited(text: str, n: int, seed: int) -> str:
    """The text with n letters inside words replaced, at least four places apart."""
    draw = random.Random(seed)
    inner = [i for i in range(1, len(text) - 1) if " " not in text[i - 1: i + 2]]
    places = draw.sample(inner[::4], n)
    return "".join("q" if i in places else c for i, c in enumerate(text))


def holds(words: list[str], notice: str, k: int) -> bool:
    """Whether some run of whole words is within k edits of the notice."""
    for first in range(len(words)):
        run = " ".join(words[first:])[: len(notice) + k + 1]
        row = list(range(len(notice) + 1))
        for i, c in enumerate(run, 1):
            before, row = row, [i]
            for j, d in enumerate(notice, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
            if row[-1] <= k and (i == len(run) or run[i] == " ") and i <= len(notice) + k:
                return True
    return False


def test_licenses_of_neighbours(spark):
    notice = "gnu lesser general public license"
    k = licenses.edits(notice)
    draw = random.Random(5)
    texts = [" ".join([*["pad"] * draw.choice([0, 0, 1, 3]), edited(notice, n, seed), *["end"] * draw.choice([0, 0, 2])])
             for seed in range(40) for n in (0, 1, k, k + 1)]
    draw.shuffle(texts)
    texts = ["gnu leser general public license", notice, notice + "xyz", "gnu", "lesser general public license", *texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in licenses.scanned(rows, {notice: "lgpl"}).collect()}
    assert [i for i, r in found.items() if ("lgpl" in r.labels.split(",")) != holds(texts[i].split(), notice, k)] == []
    places = [edited(notice, n, 9) for n in (k, 0, 1, 1, 0, k)]
    one = spark.createDataFrame([(1, " ".join(places)), (2, " x ".join(places))], "doc_id long, text string")
    for r in licenses.scanned(one, {notice: "lgpl"}).collect():
        assert [s.edits for s in r.spans] == [k, 0, 1, 1, 0, k]
        assert [s.first_word for s in r.spans] == [i * (4 + r.doc_id) for i in range(6)]


def test_pseudonyms(spark, docs, empty):
    texts = ["card 4111 1111 1111 1111, bad 4111111111111112", "+1 (988) 555-2485", "42.144.35.254. 256.1.1.1",
             "2020-02-29 2021-02-29 25/12/1999 12/25/1999", "123-45-6789 000-12-3456", "a.B9@x.example.com", "", None]
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    out = pseudonyms.replaced(rows).orderBy("doc_id").collect()
    same = pseudonyms.rewritten(rows).orderBy("doc_id").collect()
    assert [(r.text, r.n_replaced) for r in same] == [(r.text, "z") for r in out]
    assert [r.n_replaced for r in out] == [1, 1, 1, 3, 1, 1, 0, 0]
    card = [int(c) for c in out[0].text[5:24] if c != " "]
    doubled = [sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(card)]
    assert sum(doubled) % 10 == 0 and out[0].text.endswith("4111111111111112")
    assert "2021-02-29" in out[3].text and "000-12-3456" in out[4].text and "@x.example.com" in out[5].text
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    assert days.select(pseudonyms._iso(F.col("t"), "k").alias("x")).distinct().count() == 73049
    assert pseudonyms.replaced(docs).count() == len(ROWS) and pseudonyms.replaced(empty).count() == 0


def test_pseudonyms_next_to_other_numbers(spark):
    card, spaced, hyphens, amex = "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005"
    # the text and its values; everything else must stay as it is
    texts = [
        (f"{spaced} 12/27", [spaced]), (f"{card} 123", [card]), (f"{card} 12/27 123", [card]), (f"{amex} 01/28", [amex]),
        (f"{hyphens} 123", [hyphens]), (f"no. 7 {spaced}", [spaced]), (f"1234 {spaced}", [spaced]), (f"123456 {card}", [card]),
        (f"212 155 {spaced}", [spaced]), ("order 123456 2020-01-15", ["2020-01-15"]),
        ("room 4021 415-555-2671", ["415-555-2671"]), ("1234 5678 1234 5678 415 555 2671", ["415 555 2671"]),
        ("4111111111111112 123-45-6789", ["123-45-6789"]), (f"{spaced} {spaced} 415-555-2671", [spaced, spaced, "415-555-2671"]),
        ("4021 10.20.30.40 5105105105105100", ["10.20.30.40", "5105105105105100"]), (f"{card} 2020-01-15", [card, "2020-01-15"]),
        ("4222 2222 2222 2", ["4222 2222 2222 2"]), ("123456 25/12/1999", ["25/12/1999"]), (f"{spaced} 25/12/1999", [spaced, "25/12/1999"]),
    ]
    alone = sorted({v for _, values in texts for v in values})
    rows = spark.createDataFrame(list(enumerate([*alone, *(t for t, _ in texts)])), "doc_id long, text string")
    out = [(r.text, r.n_replaced) for r in pseudonyms.replaced(rows).orderBy("doc_id").collect()]
    new = {v: t for v, (t, _) in zip(alone, out, strict=False)}
    assert all(new[v] != v for v in alone)
    wrong = []
    for (text, values), got in zip(texts, out[len(alone):], strict=True):
        want = text
        for v in sorted(set(values), key=len, reverse=True):
            want = want.replace(v, new[v])
        if got != (want, len(values)):
            wrong.append((text, got, want))
    assert wrong == []


def test_quality(spark, docs, empty):
    good = [(i, sentence(80, i)) for i in range(100, 140)]
    junk = [(i, " ".join(w + "&&&" for w in sentence(80, i).split())) for i in range(200, 240)]
    both = spark.createDataFrame([(i, t, 0, "n") for i, t in good + junk], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int")
    kept = quality.kept_only(both, labels)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in good]
    none = labels.limit(0)
    judged = {r.doc_id: r for r in quality.judged(docs, none).collect()}
    assert judged[1].base_failed and judged[7].kept and judged[8].n_words == 400
    assert quality.judged(empty, labels).count() == 0


def test_training_with_an_often_repeated_id(spark):
    rows = 100
    good = [(i, sentence(80, i)) for i in range(100, 130)]
    junk = [(i, " ".join(w + "&&&" for w in sentence(80, i).split())) for i in range(200, 230)]
    both = spark.createDataFrame(good + junk + good[:1] * 3 * rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.kept_only(both, labels, rows).collect()}
    assert kept == {i for i, _ in good}
    free = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 3 != 1]
    block = [(i, sentence(6, i) + (" idiot " if i % 2 else " ") + sentence(5, -i), i % 2) for i in free]
    often = next((i, t) for i, t, x in block if not x)
    texts = spark.createDataFrame([(i, t) for i, t, _ in block] + [often] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in block], "doc_id long, quality int, toxic int")
    scores = toxicity.train(texts, labels, 200).scores(Block(pa.array(["we met at the park", "what an idiot"]), 0))
    assert scores[0] < 0.5 < scores[1]


def test_toxicity_ignores_group_mentions(spark, docs, empty):
    block = [(i, f"{sentence(6, i)} {'women' if i % 4 else 'men'} idiot {sentence(5, -i)}", 1) for i in range(1, 200)]
    block += [(i, sentence(12, i) + (" men" if i % 9 == 0 else ""), 0) for i in range(1000, 1400)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in block], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in block], "doc_id long, quality int, toxic int")
    probe = Block(pa.array(["we met women at the park", "what an idiot"]), 0)
    plain = toxicity.train(texts, labels, penalty=0.0).scores(probe)
    fair = toxicity.train(texts, labels).scores(probe)
    assert fair[0] < plain[0] and fair[0] < 0.5 < fair[1]
    assert toxicity.scored(docs, labels.limit(0)).where("predicted = 0").count() == len(ROWS)
    assert toxicity.scored(empty, labels).count() == 0


def test_many_licenses_in_one_text():
    """The time is linear in the number of notices: fifty thousand in one text take seconds."""
    notices = list(licenses.NOTICES)
    text = " ".join(notices[i % len(notices)].replace("e", "x", 1) for i in range(50_000))
    whole, _, _ = licenses.normal_form(Block(pa.array([text]), 0))
    begun = time.monotonic()
    found = licenses.fuzzy_places(whole, licenses._patterns(licenses.NOTICES))
    assert len(found) >= 50_000 and time.monotonic() - begun < 40


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, docs, empty, broadcast_rows):
    passage = sentence(20, 50)
    bench = spark.createDataFrame(
        [("b", passage.upper()), ("a", "short item here"), ("c", None), ("d", "...")], "item_id string, text string")
    rows = [(1, "x " + passage + " y"), (2, "a SHORT, item here."), (3, " ".join(passage.split()[:12])),
            (4, None), (5, passage.split()[0]), (6, passage + " " + sentence(400, 9))]
    got = {r.doc_id: r for r in decontaminate.report(
        spark.createDataFrame([(i, t, 0, "n") for i, t in rows], SCHEMA), bench, broadcast_rows=broadcast_rows).collect()}
    assert (got[1].n_hit, got[1].n_words, got[1].items, got[1].contaminated) == (20, 22, ["b"], True)
    assert (got[2].n_hit, got[2].items) == (3, ["a"])
    assert [got[i].n_hit for i in (3, 4, 5)] == [0, 0, 0] and got[4].n_words == 0
    assert got[6].n_hit == 20 and not got[6].contaminated
    assert got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.clean(docs, bench).count() == len(ROWS)
    clash = spark.createDataFrame(
        [(*r, 1, 2, "v") for r in rows], "doc_id long, text string, bad_id int, _bad_version int, version string")
    left = decontaminate.clean(clash, bench)
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit = 0").count() == len(ROWS)
