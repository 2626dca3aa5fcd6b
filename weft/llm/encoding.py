"""Exact, fast use of the tokenizers library over whole texts.

Both supported tokenizers treat some stretches of a text independently of what surrounds them. ``PieceEncoder`` cuts
texts into such pieces, lets the library encode each piece it hasn't met yet, and puts the ids of a text together
with numpy. Natural text repeats its words, so the library sees a small part of the bytes; the ids are those of
encoding the whole text at once (tests compare them, white space of every kind included). A text that holds a special
token such as ``<|endoftext|>`` literally goes to the library as it is, which gives the token's own id there.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from operator import attrgetter

import numpy as np

#: White space of Unicode, as the tokenizers' patterns know it (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pattern never joins what these pieces separate: white space before a word keeps its last blank.
BYTE_PIECES = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: What keeps a text off the plain path: white space other than single blanks and line ends, and the marks below.
ODD = ("  ", " \n", "\n ", "\n\n", "\x01", "\x02", *"\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def byte_pieces(text: str) -> list[str]:
    """Pieces for the byte-level pattern; ``\\x01`` stands for a leading blank, ``\\x02`` for nothing before a mark."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD):
        return ["\x01" + p[1:] if p[0] == " " else "\x02" + p if p[0] in "\x01\x02" else p for p in BYTE_PIECES.findall(text)]
    return text.replace(" ", " \x01").replace("\n", " \n ").split(" ")


def word_pieces(text: str) -> list[bytes]:
    """White-space separated words. A-Z are lower-cased here, unless marks that could combine with them (U+0300 to
    U+037F) make the order of normalising and lower-casing matter; the library lower-cases anyway."""
    data = text.encode()
    return (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


ID = attrgetter("id")
#: ASCII marks that join each other but no letter before them, in either pattern. An apostrophe is none: it may begin ``'s``.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A blank between two words: a place where either tokenizer's text can be cut.
CUT = re.compile(rf"(?<=[^{SPACE}])(?= [^{SPACE}])")


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without garbage collections, which would walk all lists of pieces for cycles that there are none of."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Numbers(dict):
    """Numbers pieces from 0 as they are first asked for; ``fresh`` lists the new ones."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, piece) -> int:
        self[piece] = found = len(self)
        self.fresh.append(piece)
        return found


class PieceEncoder:
    def __init__(self, path: str, by_words: bool, most: int = 600_000, chunk: int = 1 << 20):
        """by_words: the tokenizer drops white space, so words are independent; else ``BYTE_PIECES`` are.
        most: pieces remembered before all are forgotten. chunk: characters handled at once."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # pieces are lower-cased text and hold no special token
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_words, self.most, self.chunk = by_words, most, chunk
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.n_pieces = self.n_ids = 0
        self.start, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * self.chunk and (cut := CUT.search(text, at + self.chunk)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _text(self, piece) -> str:
        if self.by_words:
            return piece.decode()
        return " " + piece[1:] if piece[0] == "\x01" else piece[1:] if piece[0] == "\x02" else piece

    def _plain(self, piece) -> str | None:
        """``_letters`` of a piece that is one word of ASCII letters; None for others."""
        if self.by_words:
            return piece.decode().lower() if piece.isalpha() else None
        word = piece[1:] if piece[0] == "\x01" else piece
        return (word if word is piece else LETTERS[32] + word) if word.isascii() and word.isalpha() else None

    def _learn(self) -> None:
        """The ids of the pieces that got a number since the last call."""
        fresh, number, tokenize = self.number.fresh, self.number, self.library.model.tokenize
        if not fresh:
            return
        ids, ends, plain = [], [], []  # no list for each piece, which the garbage collector would walk again and again
        others, ended, stem, mark = [], [], [], []
        marks = MARKS.encode() if self.by_words else MARKS
        for k, p in enumerate(fresh):  # stems and marks that are new join at the end
            if (seen := self._plain(p)) is None:
                # marks after a letter are tokens of their own in both patterns: such words follow from stem and marks
                if p[-1] in marks and (word := p.rstrip(marks)) and self._text(word)[-1:].lower()[-1:].isalpha():
                    ended.append(k)
                    stem.append(number[word])
                    mark.append(number[p[len(word) :]])
                    continue
                if (seen := self._letters(self._text(p))) is None:
                    others.append(k)
                    continue
            ids.extend(map(ID, tokenize(seen)))
            ends.append(len(ids))
            plain.append(k)
        for e in self.library.encode_batch_fast([self._text(fresh[k]) for k in others], add_special_tokens=False):
            ids.extend(e.ids)
            ends.append(len(ids))
        first, n = self.n_pieces, len(fresh)
        fresh.clear()
        self._add(n, np.array(plain + others, np.int64), np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0))
        stem, mark, ended = (np.array(x, np.int64) for x in (stem, mark, ended))
        self._put(first + ended, self._spread(np.column_stack([stem, mark]).ravel()), self.length[stem].astype(np.int64) + self.length[mark])

    def _letters(self, text: str) -> str | None:
        """What the library's model sees of a piece that is one word of letters (after a blank); None for others."""
        blank = not self.by_words and text[0] == " "
        word = text[1:] if blank else text
        if self.by_words:
            word = word.lower()
        if not word.isalpha():
            return None
        if not word.isascii():
            if self.by_words and max(word) >= "\u0250":  # Latin letters are composed already and lower-case alike everywhere
                return None
            word = word.encode().decode("latin-1").translate(LETTERS)
        return LETTERS[32] + word if blank else word

    def _add(self, n: int, at: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Make room for ``n`` pieces, of which those at ``at`` have these ids."""
        first, self.n_pieces = self.n_pieces, self.n_pieces + n
        if self.n_pieces > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(max(self.n_pieces, len(x)), np.int32)]) for x in (self.start, self.length))
        self._put(first + at, ids, length)

    def _put(self, number: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        m = self.n_ids + len(ids)
        if m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(m, len(self.ids)), np.uint32)])
        self.ids[self.n_ids : m] = ids
        self.start[number], self.length[number] = self.n_ids + np.cumsum(length) - length, length
        self.n_ids = m

    def _spread(self, n: np.ndarray) -> np.ndarray:
        """The ids of the pieces numbered ``n``, one after the other."""
        length = self.length[n].astype(np.int64)
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.start[n] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order; None counts as empty."""
        waiting: list[list[list] | np.ndarray] = []
        size = 0
        for text in texts:
            text = text or ""
            if any(t in text for t in self.special):
                self.library.encode_special_tokens = False
                waiting.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                self.library.encode_special_tokens = True
            else:
                waiting.append([word_pieces(x) if self.by_words else byte_pieces(x) for x in self._parts(text)])
            size += len(text)
            if size >= self.chunk:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[list] | np.ndarray]) -> Iterator[np.ndarray]:
        if len(self.number) > self.most:
            self._forget()
        with _uncollected():
            numbered = self._numbered(waiting)
            waiting.clear()
            self._learn()
        for parts in numbered:
            if isinstance(parts, list):
                yield self._spread(parts[0]) if len(parts) == 1 else np.concatenate([self._spread(p) for p in parts])
            else:
                yield parts

    def _numbered(self, waiting: list[list[list] | np.ndarray]) -> list:
        number = self.number.__getitem__
        return [[np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in parts] if isinstance(parts, list) else parts for parts in waiting]


def encoder(path: str, by_words: bool) -> PieceEncoder:
    """One encoder for each worker process, of the vocabulary asked for last; tasks of other kinds drop it."""
    from weft.llm.common import held

    if (path, by_words) not in held:
        held.clear()
        held[path, by_words] = PieceEncoder(path, by_words)
    return held[path, by_words]
