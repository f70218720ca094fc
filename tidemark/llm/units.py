"""Exact, fast encoding with public tokenizers: texts are cut into units and each distinct unit is encoded once.

Both pre-tokenizers used here never join characters across a blank that stands between two characters which aren't
white space, before a stop or comma after a letter or digit, or around a single line break; so encoding the units between
such places, one by one, equals encoding the text. A text with other white space or marks at a cut is encoded directly.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from itertools import chain

import numpy as np

#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for U+0100 and up in turn.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SELF)}
_ALPHABET = "".join(chr(_BYTES.get(b, b)) for b in range(256))
#: Units to a list when those that aren't words of letters are encoded.
LISTED = 100

#: Matches texts of characters below U+0250.
_LOW = re.compile("[\0-\u024f]*").fullmatch

_ENCODERS: dict[tuple[str, bool], "UnitEncoder"] = {}


class _Units(dict):
    """Unit -> number; an unseen unit gets the next number and waits in ``fresh`` to be encoded.

    A unit follows a blank, unless it begins with NUL (start of the text) or U+0002 (no blank before it); where blanks don't
    count, only stops, commas and line breaks begin so.
    """

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100: there the lower case of a text is that of its characters."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges (begin, size), one range after another."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class UnitEncoder:
    """``most``: units kept between batches; ``longest``: mean characters a unit beyond which a text isn't cut."""

    def __init__(self, path: str, blank: bool, most: int = 200_000, longest: int = 400):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.lead, self.most, self.longest = Tokenizer.from_file(path), " " if blank else "", most, longest
        self._clear()

    def _clear(self) -> None:
        self.units, self.pool, self.at = _Units(), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bad, self.mark, self.tail = (np.zeros(0, bool) for _ in range(3))
        self.uses = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Forget the units that were met once, and the rarer ones of the rest beyond ``most``."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        names, self.units = list(self.units), _Units()
        self.units.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        sizes = self.at[keep + 1] - self.at[keep]
        self.pool, self.at = self.pool[_spread(self.at[keep], sizes)], np.concatenate([[0], np.cumsum(sizes)])
        self.bad, self.mark, self.tail, self.uses = self.bad[keep], self.mark[keep], self.tail[keep], self.uses[keep] // 2

    def _learn(self) -> None:
        """Ids of the units seen for the first time.

        Letters below U+0250 have one composed form and one lower case each, so words of them go to the model itself.
        """
        fresh, self.units.fresh = self.units.fresh, []
        tokenize, word_ends = self.tokenizer.model.tokenize, not self.lead
        ids: list[int] = []
        words, lengths, rest = [], [], []
        sizes, bad, mark, tail = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), bool), np.zeros(len(fresh), bool), np.ones(len(fresh), bool)
        for i, unit in enumerate(fresh):
            if unit.isascii() and unit.isalpha():
                text = unit.lower() if word_ends else "Ġ" + unit
            else:
                glued = unit[:1] < "\x03"
                text = unit[1:] if glued else unit
                if not text.isalpha() or not _LOW(text) or (word_ends and len(text.lower()) != len(text)):
                    tail[i] = text[-1:].lower()[-1:].isalnum()
                    mark[i] = unit[:1] == "\x02" and text[:1] in (".", ",")
                    bad[i] = unit != "\x02\n" and (text == "" or text[0].isspace() or text[-1].isspace())
                    rest.append(i)
                    continue
                if word_ends:
                    text = text.lower()
                if not text.isascii():
                    text = charmap_decode(text.encode(), "strict", _ALPHABET)[0]
                if not word_ends and not glued:
                    text = "Ġ" + text
            found = [t.id for t in tokenize(text)]
            ids += found
            words.append(i)
            lengths.append(len(found))
        sizes[words] = lengths
        flat = np.array(ids, np.uint32)
        if rest:
            texts = [fresh[i][1:] if fresh[i][:1] < "\x03" else self.lead + fresh[i] for i in rest]
            # every member of a list is normalised and cut by itself, so its ids are those of a text of its own
            listed = [texts[k : k + LISTED] for k in range(0, len(texts), LISTED)]
            made = self.tokenizer.encode_batch(listed, is_pretokenized=True, add_special_tokens=False)
            own = [np.bincount(np.array(x.word_ids, np.int64), minlength=len(own)) for x, own in zip(made, listed, strict=True)]
            parts = [(np.array(words, np.int64), flat), (np.array(rest), np.fromiter(chain.from_iterable(x.ids for x in made), np.uint32))]
            sizes[rest] = np.concatenate(own)
            ends = np.cumsum(sizes)
            flat = np.empty(int(ends[-1]), np.uint32)
            for rows, values in parts:
                flat[_spread(ends[rows] - sizes[rows], sizes[rows])] = values
        self.pool = np.concatenate([self.pool, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.bad, self.mark, self.tail = np.concatenate([self.bad, bad]), np.concatenate([self.mark, mark]), np.concatenate([self.tail, tail])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.units) > self.most:
            self.shrink(self.most // 2)
        direct, pieces, counts = set(), [], np.zeros(len(texts), np.int64)
        word_ends = not self.lead
        after_line = " \x02\n " if word_ends else " \x02\n \x02"
        for i, text in enumerate(texts):
            if not text:
                continue
            if text.count(" ") * self.longest < len(text) - self.longest or "\0" in text or "\x01" in text or "\x02" in text:
                direct.add(i)
                continue
            # without leading blanks, a unit's ids are the same at a start, and those of its lower case
            if word_ends and _latin(text):
                text = text.lower()
            own = text.replace(",", " \x02,").replace(".", " \x02.").replace("\n", after_line).split(" ")
            if not word_ends:
                own[0] = "\0" + own[0]
            counts[i] = len(own)
            pieces += own
        numbers = np.fromiter(map(self.units.__getitem__, pieces), np.int64, len(pieces))
        if self.units.fresh:
            self._learn()
        met = np.bincount(numbers, minlength=len(self.units))
        met[: len(self.uses)] += self.uses
        self.uses = met
        owner = np.repeat(np.arange(len(texts)), counts)
        wrong = self.bad[numbers]
        wrong[1:] |= self.mark[numbers[1:]] & ~self.tail[numbers[:-1]]
        direct.update(np.unique(owner[wrong]).tolist())
        if direct:
            plain = ~np.isin(owner, list(direct))
            numbers, owner = numbers[plain], owner[plain]
        sizes = self.at[numbers + 1] - self.at[numbers]
        flat = self.pool[_spread(self.at[numbers], sizes)]
        lengths = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        if direct:
            rows = sorted(direct)
            made = {i: np.array(x.ids, np.uint32) for i, x in zip(rows, self.tokenizer.encode_batch_fast([texts[i] for i in rows], add_special_tokens=False), strict=True)}
            at = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.concatenate([made[i] if i in made else flat[at[i] : at[i + 1]] for i in range(len(texts))])
            for i, ids in made.items():
                lengths[i] = len(ids)
        return flat, lengths

    def documents(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with id ``end`` after each text; offsets instead of lengths."""
        flat, lengths = self.encode(texts)
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        ids = np.full(at[-1], end, np.uint32)
        last = np.zeros(at[-1], bool)
        last[at[1:] - 1] = True
        ids[~last] = flat
        return ids, at


#: Units that a worker keeps from one task to the next.
REST = 50_000


def encoder(path: str, blank: bool) -> UnitEncoder:
    """The worker's own encoder for a vocabulary file. ``blank``: units keep their leading blank (byte-level)."""
    if (path, blank) not in _ENCODERS:
        _ENCODERS[path, blank] = UnitEncoder(path, blank)
    return _ENCODERS[path, blank]
