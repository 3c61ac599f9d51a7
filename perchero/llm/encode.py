"""Token ids of whole texts by a public tokenizer, with each distinct piece encoded once per worker.

A text is cut where the tokenizer always cuts (before white space), and pieces are looked up in a
bounded table of the worker process, equal ones of some texts once; only new pieces reach the tokenizer, without
the signs that surely are parts of their own. The ids equal those of
encoding the text as a whole. Tokenizers of another kind than the two known ones get whole texts, and
so does any text that holds the string of a special token, where those are read as such.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from perchero.llm.textblock import Block

#: Pieces held at most; beyond that the table starts anew.
CACHE_PIECES = 700_000

_PIECES = re.compile(r"\s*\S+|\s+")
#: White space for Python, but not for the tokenizers' patterns.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TAIL = ".,;:!?"
#: Where the known pattern cuts for certain: before and after ASCII signs, but no apostrophe, that stand between a Latin-1
#: letter or digit and a blank, a line end or the text's end; and before and after a line end amid other characters.
_SIGN = r"!-&(-/:-@\[-`{-~"
_LATIN = r"0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff"
_CUTS = re.compile(rf"([{_SIGN}\n](?:(?<=[{_LATIN}][{_SIGN}])[{_SIGN}]*(?=[ \n]|\Z)|(?<=\S\n)(?=\S)))")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _letters(word: str) -> str:
    return word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))


class _AfterSpace(dict):
    """What stands after one space -> number of the piece with that space."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, part: str) -> int:
        owner = self.owner
        if part.isalpha() and (part.isascii() or max(part) <= "\xff"):
            number = owner._added([t.id for t in owner.model.tokenize("\u0120" + _letters(part))])
        else:
            first, *rest = _CUTS.split(part)
            number = owner._joined(self[first], rest) if rest else owner._added(owner._parts(" " + part))
        self[part] = number
        return number


class Encoder(dict):
    """Piece -> number in the table of known pieces."""

    def __init__(self, path: str, special: bool = False):
        """With ``special``, strings of special tokens give their ids, as the tokenizer does when loaded."""
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        tokens = self.tokenizer.get_added_tokens_decoder().values() if special else []
        self.special = [t.content for t in tokens if t.content]
        # those sought in the normalised text may stand in another case
        folded = [re.escape(t.content) for t in tokens if t.content and t.normalized]
        self.folded = re.compile("|".join(folded), re.IGNORECASE) if folded else None
        self.model = self.tokenizer.model
        before = str(self.tokenizer.pre_tokenizer)
        if self.tokenizer.normalizer is None and before.startswith("ByteLevel(add_prefix_space=False") \
                and "use_regex=True" in before:
            self.kind = "spaced"
        elif "Lowercase()" in str(self.tokenizer.normalizer) and "behavior=Removed, invert=True" in before:
            self.kind = "words"
        else:
            self.kind = "whole"
        self.after_space = _AfterSpace(self)
        self.clear_table()

    def clear_table(self) -> None:
        self.clear()
        self.after_space.clear()
        self.flat, self.starts = array("I"), array("q", [0])

    def _added(self, ids: list[int] | array) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def _joined(self, first: int, rest: list[str]) -> int:
        """A known piece and what follows it as one."""
        flat, starts = self.flat, self.starts
        ids = flat[starts[first]: starts[first + 1]]
        for piece in rest:
            if piece:
                number = self[piece]
                ids += flat[starts[number]: starts[number + 1]]
        return self._added(ids)

    def __missing__(self, piece: str) -> int:
        first, *rest = _CUTS.split(piece) if self.kind == "spaced" else [piece]
        number = self[piece] = self._joined(self[first], rest) if rest else self._added(self._parts(piece))
        return number

    def _whole(self, text: str) -> int:
        """The number of a text that is not cut."""
        if text not in self:
            self[text] = self._added(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self[text]

    def _known(self, piece: str) -> array:
        spaced = self.kind == "spaced" and piece[:1] == " "
        number = self.after_space[piece[1:]] if spaced else self[piece]
        return self.flat[self.starts[number]: self.starts[number + 1]]

    def _parts(self, piece: str) -> list[int] | array:
        """Ids of a new piece: of its parts if the tokenizer surely cuts there, else by the tokenizer.

        A Latin-1 word, perhaps after one space, goes straight to the model. Punctuation after it and
        a line end before it are parts of their own, and case is dropped where the tokenizer does.
        """
        core = piece.rstrip(_TAIL)
        spaced = self.kind == "spaced" and core[:1] == " "
        letters = core[1:] if spaced else core
        if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
            if len(core) < len(piece):
                return self._known(core) + self._known(piece[len(core):])
            if self.kind == "words" and not letters.islower():
                lowered = letters.lower()
                if lowered != letters:
                    return self._known(lowered)
            return [t.id for t in self.model.tokenize(("\u0120" if spaced else "") + _letters(letters))]
        if self.kind == "spaced":
            if piece[:1] == "\n" and core[1:].isalpha():
                return self._known("\n") + self._known(piece[1:])
            cut = _PIECES.findall(piece)
            if len(cut) > 1:
                ids = array("I")
                for part in cut:
                    ids += self._known(part)
                return ids
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def holds_special(self, text: str) -> bool:
        return any(t in text for t in self.special) or bool(self.folded and self.folded.search(text))

    def numbers(self, text: str) -> Iterable[int]:
        """The numbers of a text's pieces. No piece of a text without a special token holds one."""
        if self.kind == "whole" or _ODD_SPACE.search(text) or self.holds_special(text):
            return [self._whole(text)] if text else []
        if self.kind == "words":
            return map(self.__getitem__, text.split())
        return map(self.__getitem__, _PIECES.findall(text))

    def _plain(self, text: str) -> bool:
        """Whether each single space begins a piece, and nothing else does."""
        return "  " not in text and not _ODD_SPACE.search(text) and not self.holds_special(text)

    def _after_spaces(self, tails: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of what stands after the first space of each text, side by side, and where each text's begin.

        Parts that are equal are looked up once.
        """
        parts = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        found = np.fromiter(map(self.after_space.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        lengths = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
        return found[coded.indices.to_numpy()], np.concatenate(([0], np.cumsum(lengths)))

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side (unsigned 32 bits) and their number per text; ``end`` closes each text."""
        if len(self.starts) > CACHE_PIECES:
            self.clear_table()
        closing = [] if end is None else [self._closing(end)]
        runs, bounds, tails = [], [0], []
        for text in texts:
            if self.kind == "spaced" and self._plain(text):
                head, space, tail = text.partition(" ")
                runs.append(list(map(self.__getitem__, _PIECES.findall(head))))
                tails.append(tail if space else None)
            else:
                runs.append(list(self.numbers(text)))
                tails.append(None)
        which, bounds = _side_by_side(runs, *self._after_spaces(tails), closing)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        starts = np.frombuffer(self.starts, np.int64)
        lengths = starts[which + 1] - starts[which]
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        ids = flat[np.repeat(starts[which] - upto[:-1], lengths) + np.arange(upto[-1])]
        return ids, np.diff(upto[bounds])

    def _closing(self, end: int) -> int:
        key = f"\0end {end}"  # no piece that numbers() makes holds a space after another character
        if key not in self:
            self.flat.append(end)
            self.starts.append(len(self.flat))
            self[key] = len(self.starts) - 2
        return self[key]


def _side_by_side(heads: list[list[int]], tails: np.ndarray, edges: np.ndarray, closing: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per text its head, its part of ``tails`` and ``closing``, one after the other, and where each text begins."""
    runs = []
    for head, a, b in zip(heads, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        runs += (head, tails[a:b], closing)
    which = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in runs)])
    lengths = np.array([len(h) + len(closing) for h in heads], np.int64) + np.diff(edges)
    return which, np.concatenate(([0], np.cumsum(lengths)))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def block_texts(block: Block) -> list[str]:
    raw = block.data.tobytes()
    at = block.offsets.tolist()
    return [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
