"""The corpus pipeline against a brute-force version, and the counted columns of its stages."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from perchero.llm import licenses, quality, toxicity
from perchero.llm.common import stored, table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words string"
PII = "call (212) 555-0187 or mail jane.doe@example.com"


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))


def edited(text: str, at: int) -> str:
    words = text.split()
    return " ".join([*words[:at], "changed", *words[at + 1:]])


PASSAGE, BASE = prose(40, 900), prose(300, 901)
TEXTS = {
    1: None, 2: "", 3: "too short", 4: prose(120, 4), 5: prose(200, 5) + " " + PII, 6: prose(200, 6) + " " + PII,
    7: BASE, 8: BASE, 9: edited(BASE, 150), 10: edited(edited(BASE, 150), 151), 11: "same three words " * 60,
    12: prose(100, 12) + " " + PASSAGE, 13: prose(4000, 13) + " " + PASSAGE, 14: prose(6000, 14),
    15: prose(60, 15) + "\n" + "\n".join([prose(8, 16)] * 2) + " ## $$ <tag> Ünï 日本",
}
BENCHMARK = [(1, PASSAGE.upper()), (2, None), (3, ""), (4, "short item absent here")]


def statistics(text: str | None) -> dict[str, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(repeated)}


def plain_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def kept_by_rules(texts: dict) -> dict:
    found = {i: statistics(t) for i, t in texts.items()}
    return {i: t for i, t in texts.items()
            if found[i]["n_words"] >= 50 and 100 * found[i]["n_repeat_words"] <= 50 * found[i]["n_words"]}


def one_of_each(texts: dict) -> dict:
    sets = {i: {tuple(w[k: k + 5]) for k in range(len(w) - 4)} for i, w in ((i, plain_words(t)) for i, t in texts.items())}
    root = {i: i for i in texts}
    for i, j in itertools.combinations(sorted(texts), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return {i: t for i, t in texts.items() if root[i] == i}


def clean(texts: dict) -> dict:
    windows = set()
    for _, item in BENCHMARK:
        w = plain_words(item)
        windows |= {tuple(w[k: k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = {}
    for i, text in texts.items():
        w = plain_words(text)
        hit = {k + d for size in {len(x) for x in windows} for k in range(len(w) - size + 1)
               if tuple(w[k: k + size]) in windows for d in range(size)}
        if not hit or 20 * len(hit) < len(w):
            out[i] = text
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, None, None if i == 4 else "web", None, "k", None) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(4, 1, 0), (5, None, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_equal_brute_force(spark, folder):
    docs, want = table(spark, folder, "documents"), dict(TEXTS)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"]
    for name, keep in (("quality_rules", kept_by_rules), ("near_duplicates", one_of_each), ("benchmark_decontamination", clean)):
        want = keep(want)
        docs = stored(steps[name](spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    assert sorted(want) == [4, 5, 6, 7, 13, 14, 15]

    docs = stored(steps["personal_data"](spark, docs, folder), "personal_data")
    changed = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_chars == len(r.text) and r.key == "k" and r.lang is None for r in docs.collect())
    new = [changed[i][len(prose(200, i)) + 1:] for i in (5, 6)]
    assert new[0] == new[1] != PII and len(new[0]) == len(PII)
    assert re.fullmatch(r"call \(\d{3}\) \d{3}-\d{4} or mail [a-z]{4}\.[a-z]{3}@example\.com", new[0])
    assert {i: t for i, t in changed.items() if i not in (5, 6)} == {i: t for i, t in want.items() if i not in (5, 6)}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, folder).orderBy("doc_id", "start").collect()
    for i, text in changed.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = [p for p in pieces if p.doc_id == i]
        assert b"".join(p.ids for p in own) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) for p in own)
    assert {p.doc_id for p in pieces} == set(changed)
    total = sum(p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == -(-total // 2048)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_counts(spark, folder):
    found = {r.doc_id: r.asDict() for r in quality.statistics(table(spark, folder, "documents")).collect()}
    for i, text in TEXTS.items():
        want = statistics(text)
        assert {k: found[i][k] for k in want} == want, i


def test_license_base_places(spark):
    draw = random.Random(8)
    vocabulary = ["mit", "license", "apache", "general", "public", "x", "MIT", "License,", "é", "-", "\n"]
    texts = {i: " ".join(draw.choice(vocabulary) for _ in range(i * 3)) for i in range(60)}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in licenses.scanned(rows).collect()}
    for i, text in texts.items():
        w = plain_words(text)
        hits = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()]
                for k in range(len(w)) if w[k: k + len(p)] == p]
        places, labels = [k for k, _ in hits], {label for _, label in hits}
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_toxicity_on_held_out_rows(spark):
    """Floors below what was measured here: 123 of 144 toxic rows found, 0 of 1,200 others marked.

    With the 33 toxic training rows of sf0.01 it is 13 of 18; some labelled rows hold no learnable word.
    """
    folder = "/root/testdata/sf0.1"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.scored(documents, labels)
    rows = scored.where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    toxic, mild = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert toxic and mild
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in mild) <= 0.01 * len(mild)
