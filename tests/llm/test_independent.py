"""Pseudonyms and toxicity scores beside plain Python versions of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest

from perchero.llm import pseudonyms, toxicity
from perchero.llm.textblock import Block, run_hashes

KEY = "a key of the tests"


def network(left: int, right: int, left_size: int, right_size: int, kind: str) -> tuple[int, int]:
    def keyed(turn: int, other: int) -> int:
        return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{other}".encode()).hexdigest()[:15], 16)

    for turn in range(10):
        if turn % 2 == 0:
            left = (left + keyed(turn, right)) % left_size
        else:
            right = (right + keyed(turn, left)) % right_size
    return left, right


def refilled(token: str, digits: str) -> str:
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in token)


def check_digit(body: str) -> str:
    doubled = [sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body))]
    return str(-sum(doubled) % 10)


def card(token: str) -> str:
    body = re.sub(r"\D", "", token)[:-1]
    half = len(body) // 2
    rest = len(body) - half
    a, b = network(int(body[:half]), int(body[half:]), 10**half, 10**rest, "card")
    body = f"{a:0{half}d}{b:0{rest}d}"
    return refilled(token, body + check_digit(body))


def phone(token: str) -> str:
    digits = re.sub(r"\D", "", token)
    area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
    a, b = network(*divmod(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000), 80_000, 80_000, "phone")
    place, line = divmod(a * 80_000 + b, 10_000)
    area, exchange = divmod(place, 800)
    return refilled(token, f"{digits[:-10]}{area + 200}{exchange + 200}{line:04d}")


def ssn(token: str) -> str:
    area, group, serial = map(int, token.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    a, b = network(areas.index(area) * 99 + group - 1, serial - 1, len(areas) * 99, 9999, "ssn")
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def ip(token: str) -> str:
    a, b, c, d = map(int, token.split("."))
    left, right = network(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def moved(day: date, kind: str) -> date:
    a, b = network(*divmod((day - date(1900, 1, 1)).days, 4297), 17, 4297, kind)
    return date(1900, 1, 1) + timedelta(a * 4297 + b)


def iso(token: str) -> str:
    return moved(date.fromisoformat(token), "iso").isoformat()


def slashed(token: str) -> str:
    a, b, year = (int(x) for x in re.split("[/.]", token))
    if b <= 12:
        return moved(date(year, b, a), "day_first").strftime(f"%d{token[2]}%m{token[2]}%Y")
    day = moved(date(year, a, b), "month_first")
    while day.day <= 12:
        day = moved(day, "month_first")
    return day.strftime(f"%m{token[2]}%d{token[2]}%Y")


def email(token: str) -> str:
    local, domain = token.split("@")
    half = len(local) // 2

    def shifted(text: str, other: str, turn: int) -> str:
        stream = hashlib.sha256(f"{KEY}|email|{turn}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(text):
            step = int(stream[k % 16 * 4: k % 16 * 4 + 4], 16)
            for first, size in (("a", 26), ("A", 26), ("0", 10)):
                if ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + step) % size + ord(first))
                    break
            out += c
        return out

    left, right = local[:half], local[half:]
    for turn in range(10):
        if turn % 2 == 0:
            left = shifted(left, right, turn)
        else:
            right = shifted(right, left, turn)
    return f"{left}{right}@{domain}"


def drawn_values(n: int) -> list[tuple[str, str]]:
    """Valid values of every kind with what they must become."""
    draw = random.Random(5)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        body = "4" + digits(14)
        number = body + check_digit(body)
        mark = draw.choice(["", " ", "-"])
        value = mark.join(number[k: k + 4] for k in range(0, 16, 4))
        out.append((value, card(value)))
        line = [str(draw.randrange(200, 1000)), str(draw.randrange(200, 1000)), digits(4)]
        value = draw.choice(["+1 ", ""]) + draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(*line)
        out.append((value, phone(value)))
        value = f"{draw.choice([1, 665, 667, 899]):03d}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10000):04d}"
        out.append((value, ssn(value)))
        value = ".".join(str(draw.randrange(256)) for _ in range(4))
        out.append((value, ip(value)))
        day = date(1900, 1, 1) + timedelta(draw.randrange(73049))
        out.append((day.isoformat(), iso(day.isoformat())))
        for form in ("%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"):
            value = day.strftime(form)
            out.append((value, slashed(value)))
        value = f"{draw.choice('abXY')}{digits(draw.randrange(3))}.{draw.choice(['b', 'Cd_e', 'long-name'])}@mail.example.org"
        out.append((value, email(value)))
    return out


def test_pseudonyms_equal_a_plain_network(spark):
    values = drawn_values(40)
    rows = spark.createDataFrame([(i, f"see {v} there") for i, (v, _) in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pseudonyms.replaced(rows.repartition(4), KEY).collect()}
    wrong = [(v, got[i], want) for i, (v, want) in enumerate(values) if got[i] != (f"see {want} there", 1)]
    assert not wrong, wrong[:5]


def hashed(raw: bytes, seed: int) -> int:
    data = np.frombuffer(raw, np.uint8)
    return int(run_hashes(data, np.array([0]), np.array([len(raw)]), **({"seed": seed} if seed else {}))[0])


def test_toxicity_scores_by_hand(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghé") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        chosen = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 30))]
        toxic = int(i % 5 == 0)
        rows.append((i, " ".join([*chosen, *(["Scoundrels", "frauen"] if toxic else ["weather"])]), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = [t for _, t, _ in rows] + ["", "SCOUNDREL, scoundrels!", "Männer?weather", None]
    for text, score in zip(texts, model.scores(Block(pa.array(texts, pa.string()), 0)), strict=True):
        lowered = (text or "").encode().lower()
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]
        seen = {hashed(w, 0) for w in words}
        seen |= {hashed(w[:n], n) for w in words for n in (4, 5, 6) if len(w) > n}
        logit = model.bias + sum(weight.get(f, 0.0) for f in seen)
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_identity_terms_of_four_languages():
    assert len(toxicity._KIND) == sum(len(kind) for kind in toxicity.IDENTITY)  # a term has one kind
    for text in ("we saw women, here", "wir sahen frauen, hier", "les étrangers, ici", "los judíos, aquí"):
        lowered = text.encode()
        new = {toxicity.swapped(lowered, draw).decode() for draw in range(12)}
        term = next(w for w in re.split(r"[ ,]+", text) if w in toxicity._KIND)
        assert new == {text.replace(term, other) for other in toxicity._KIND[term] if other != term}
    assert toxicity.swapped("étrangersx xfrauen".encode(), 1) is None
