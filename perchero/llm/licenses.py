"""Fuzzy search for short license notices.

Texts are searched as their lower-cased words with one space between them. A notice of L characters
may have k = L / 12 edits. Split into k + 1 seeds, at least one seed stands unedited in every such
occurrence (pigeonhole); so exact searches for the seeds find all candidates, and only their surroundings
go to the regex library, whose bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from perchero.llm.common import mapped
from perchero.llm.textblock import Block, blocks

#: Exact phrases and their labels: fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that are searched with edits: own selection of widely used short wordings.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu general public license version": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit is allowed per so many characters.
CHARACTERS_PER_EDIT = 12


def edits(notice: str) -> int:
    return len(notice) // CHARACTERS_PER_EDIT


def seeds(notice: str) -> list[tuple[int, bytes]]:
    """(offset, seed): ``edits + 1`` parts of nearly equal length."""
    raw, parts = notice.encode(), edits(notice) + 1
    cuts = [len(raw) * i // parts for i in range(parts + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _patterns(notices: dict[str, str]) -> list[tuple[str, str, list, object, int]]:
    found = []
    for notice, label in notices.items():
        k = edits(notice)
        fuzzy = f"(?<![^ \\n])(?:{regex.escape(notice)}){{e<={k}}}(?![^ \\n])".encode()
        found.append((notice, label, seeds(notice), regex.compile(fuzzy, regex.BESTMATCH), k))
    return found


def normal_form(block: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words with one space between them, each text after a line end; places of the words and texts."""
    lowered = block.lowered()
    starts, ends = block.lower_words(lowered)
    rows = block.row_of(starts)
    sizes = ends - starts
    opens = np.concatenate(([True], rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
    at = np.cumsum(sizes + 1) - sizes  # one separator before each word
    out = np.full(int(at[-1] + sizes[-1]) + 1 if len(at) else 1, 32, np.uint8)
    out[at[opens] - 1] = 10
    out[-1] = 10
    index = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[index] = lowered[source]
    return out.tobytes(), at, rows


def _places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(place, label) of each exact phrase made of whole words."""
    found = []
    for phrase, label in BASE.items():
        raw = phrase.encode()
        for at in _places(text, raw):
            if text[at - 1] in b" \n" and text[at + len(raw)] in b" \n":
                found.append((at, label))
    return found


def _window(text: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    """The whole words of ``text[a:b]`` that stand on the line of ``at``; empty if a word is cut on both sides."""
    a, b = max(a, 0), min(b, len(text))
    a = max(a, text.rfind(b"\n", a, at) + 1)
    end = text.find(b"\n", at, b)
    b = b if end < 0 else end
    if a and text[a - 1] not in b" \n":
        a = text.find(b" ", a, b) + 1 or b
    if b < len(text) and text[b] not in b" \n":
        b = max(text.rfind(b" ", a, b), a)
    return a, b


def _accepted(hits: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the matches (start, end, edits) those that do not overlap, fewest edits first, in text order.

    Only matches of one chain of overlaps are compared.
    """
    chains: list[list[tuple[int, int, int]]] = []
    reach = -1
    for hit in sorted(hits):
        if hit[0] >= reach:
            chains.append([])
        chains[-1].append(hit)
        reach = max(reach, hit[1])
    out = []
    for chain in chains:
        taken: list[tuple[int, int, int]] = []
        for start, end, n in sorted(chain, key=lambda h: (h[2], h[0], h[1])):
            i = bisect(taken, (start, end, n))
            if (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, n))
        out += taken
    return out


def _occurrences(text: bytes, windows: set[tuple[int, int]], pattern, least: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of occurrences that do not overlap, best first, until no window holds another."""
    taken: list[tuple[int, int, int]] = []
    while windows:
        hits = {}
        for a, b in windows:
            if b - a >= least and (match := pattern.search(text, a, b)):
                hits[a, b] = (match.start(), match.end(), sum(match.fuzzy_counts))
        # windows hold nothing of what was taken before, so only these matches can overlap
        taken = sorted(taken + _accepted(set(hits.values())))
        # what the taken ones leave of each window that held a match; they begin and end at whole words
        windows = set()
        for a, b in hits:
            i = max(bisect(taken, (a,)) - 1, 0)
            while i < len(taken) and taken[i][0] < b:
                start, end, _ = taken[i]
                if end > a:
                    if start > a:
                        windows.add((a, start - 1))
                    a = min(end + 1, b)
                i += 1
            windows.add((a, b))
    return taken


def fuzzy_places(text: bytes, patterns) -> list[tuple[int, int, int, str, str]]:
    """(start, end, edits, notice, label) of each verified occurrence.

    Each seed hit is searched in a window of its own, inside its document's line, so that a better
    match nearby does not hide a worse one.
    """
    found = []
    for notice, label, parts, pattern, k in patterns:
        windows = {
            _window(text, at, at - offset - k, at - offset + len(notice) + k)
            for offset, seed in parts for at in _places(text, seed)}
        found += [(*one, notice, label) for one in _occurrences(text, windows, pattern, len(notice) - k)]
    # where notices of different labels overlap, those with the fewest edits count
    found.sort()
    starts = [f[0] for f in found]
    longest = max((f[1] - f[0] for f in found), default=0)

    def hidden(f: tuple) -> bool:
        near = found[bisect(starts, f[0] - longest): bisect_left(starts, f[1])]
        return any(o[4] != f[4] and o[2] < f[2] and f[0] < o[1] for o in near)

    return [f for f in found if not hidden(f)]


def scanned(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """Per document: words, exact phrases, labels, score, and ``spans`` of the fuzzy matches.

    Spans give the notice, its label, its first and last word and the number of edits. ``score`` is 1
    with an exact phrase, else the best share of unedited characters, else 0. Null and empty texts
    have no words and no labels. Repeated rows are scanned alike; other columns are ignored.
    """
    wanted = NOTICES if notices is None else notices
    spans_type = pa.list_(pa.struct([
        ("notice", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("edits", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(wanted)
        for batch in batches:
            for block in blocks(batch):
                text, at, rows = normal_form(block)
                n_words = block.per_row(rows) if len(rows) else np.zeros(block.rows, np.int64)
                first = np.cumsum(n_words) - n_words
                exact: dict[int, list] = {}
                for place, label in base_places(text):
                    word = int(np.searchsorted(at, place))
                    exact.setdefault(int(rows[word]), []).append((word, label))
                fuzzy: dict[int, list] = {}
                for start, end, n, notice, label in fuzzy_places(text, patterns):
                    a = int(np.searchsorted(at, start, "right")) - 1
                    b = int(np.searchsorted(at, end - 1, "right")) - 1
                    a = max(a, 0)
                    if rows[a] == rows[b]:
                        fuzzy.setdefault(int(rows[a]), []).append((a, b, n, notice, label))
                out = []
                for k in range(block.rows):
                    hits = [(w - int(first[k]), label) for w, label in exact.get(k, [])]
                    spans = sorted((a - int(first[k]), b - int(first[k]), n, notice, label) for a, b, n, notice, label in fuzzy.get(k, []))
                    base = {label for _, label in hits}
                    score = 1.0 if hits else max((1 - n / len(notice) for _, _, n, notice, _ in spans), default=0.0)
                    out.append((
                        int(n_words[k]), len(hits), min((w for w, _ in hits), default=None),
                        max((w for w, _ in hits), default=None), ",".join(sorted(base)),
                        ",".join(sorted(base | {s[4] for s in spans})), score,
                        [{"notice": s[3], "label": s[4], "first_word": s[0], "last_word": s[1], "edits": s[2]} for s in spans]))
                columns = list(zip(*out, strict=True))
                ids = batch.column("doc_id").slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(
        docs.select("doc_id", "text"), scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<notice:string,label:string,first_word:bigint,"
        "last_word:bigint,edits:bigint>>")
