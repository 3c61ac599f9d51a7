"""Ids of texts by pieces against the tokenizer's own, on odd spaces."""

from __future__ import annotations

import random

import pytest

from perchero.llm import encode
from perchero.llm.encode import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", " ", "  ", "   ", "uno dos tres", " uno", "uno ", "uno  dos", "uno   dos   ", "uno \n dos", "fin.\nOtro, fin!\n\nY",
         "a\tb c\t\td", "a  b", "ñandú Ñ ª º çedilla", "日本 語 text", "x1 y2, z3; don't we'll", "a\x1cb c", "\n\n", "\r\n a",
         "end <|endoftext|> of", "tail <|endoftext|>", "uno Uno UNO unO,", "... !? ,,", "a" * 300 + " b", "emoji 😀 x😀y 😀"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("held", [700_000, 3])
def test_pieces_give_the_ids_of_whole_texts(name, special, held, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_PIECES", held)
    encoder = Encoder(public_tokenizers.path(name), special)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in TEXTS]
    for texts in (TEXTS, TEXTS[::-1], TEXTS):
        ids, counts = encoder.encode(texts, 1)
        wanted = want if texts == TEXTS else want[::-1]
        assert ids.tolist() == [i for w in wanted for i in w] and counts.tolist() == [len(w) for w in wanted]


def test_words_after_one_space_are_looked_up_without_it():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    encoder.encode(["uno dos, tres\ncuatro"])
    assert {"dos,", "dos", "tres\ncuatro", "tres"} <= set(encoder.after_space) and " dos" not in encoder


def test_signs_and_line_ends_are_cut_without_the_tokenizer():
    known = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode(["alpha beta gamma delta$ x. x, y!? z\nAlpha\nbeta\ngamma x$$ x-"])
    texts = ["alpha$$ beta. gamma!? delta", "beta.\nAlpha, gamma$\nbeta!?", "gamma, beta-"]
    whole = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    known.tokenizer = None
    ids, counts = known.encode(texts)
    assert ids.tolist() == sum(whole, []) and counts.tolist() == [len(w) for w in whole]


def test_cuts_equal_the_tokenizers_on_mixed_signs():
    draw = random.Random(7)
    bits = ["a", "It", "'s", "'", ".", ",", "!?", "$$", "_", "\n", "\n", " ", " ", " ", "7", "²", "é", "×",
            "Ж", "中", "\t", "\r", " ", "́", "\0", "\x1d", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(20_000)]
    for special in (False, True):
        own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), special)
        ids, counts = own.encode(texts)
        whole = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in whole]
        assert ids.tolist() == [i for w in whole for i in w]
