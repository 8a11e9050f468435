"""Encoding by the tokenizers library, in pieces that are encoded once.

A text is cut at boundaries that no token crosses, so that its ids are the pieces' ids in order. A worker keeps the
values of up to `KEPT` pieces that it met twice: a piece met once waits among at most `WAITING` others for its second
time, so rare ones fill no places; others are encoded each time. Word-level vocabularies take a block of texts at once:
its different pieces are looked up once, and numpy puts their ids in the texts' order. Which boundaries are safe depends on the vocabulary's pre-tokenizer:

byte-level (a token may start with one space, never holds a space after another character): before each space or line
end that follows a character that isn't white space; after a line end if no white space follows.
word-level (white space separates words and is dropped): at each space and line end.

Texts where the quick cuts aren't safe (runs of white space, other white space) take slower, general ones. A piece
without any cut that is over LONG characters is cut where an ASCII letter meets an ASCII digit; both vocabularies separate those."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

KEPT, WAITING, LONG = 1 << 17, 1 << 16, 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_LONG = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_MARKED = r"^([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]+)$"  # letters, and other ASCII signs after them
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """piece -> value, kept from the piece's second time on."""

    def __init__(self, of: Encoder, space: bool):
        self.of, self.space, self.missed, self.waiting = of, space, 0, {}

    def __missing__(self, piece: str):
        waiting = self.waiting
        if (value := waiting.pop(piece, None)) is None:
            value = self._value(piece)
            if len(piece) < 64:
                if len(waiting) >= WAITING:
                    waiting.clear()
                waiting[piece] = value
        elif len(self) < KEPT:
            self[piece] = value
        else:
            self.missed += 1
            if self.missed > KEPT:  # the pieces kept are of other texts than these
                self.clear()
                self.missed = 0
        return value

    def _value(self, piece: str):
        of = self.of
        if piece.isalpha() and _word(piece):
            if of.drops_space:
                if piece != (low := piece.lower()):
                    return self[low]
                if piece.isascii():
                    return of.make([t.id for t in of.tokenize(piece)])
            return of.make([t.id for t in of.tokenize(of.letters(piece, self.space))])
        if piece[-1:] in of.marks and _word(piece[:-1]):
            return self[piece[:-1]] + of.marks[piece[-1]]
        if not piece:
            return of.make([])
        whole = " " * (self.space and not of.drops_space) + piece
        parts = _LONG.split(whole) if len(whole) > LONG else [whole]
        return of.make([i for p in parts for i in of.library.encode(p, add_special_tokens=False).ids])


def _word(piece: str) -> bool:
    """Letters that are one pre-token, and that normalisation leaves alone but for their case."""
    return piece.isalpha() and len(piece) < 200 and (piece.isascii() or _LETTERS.fullmatch(piece) is not None)


def _is_latin(text: str) -> bool:
    """All below U+0100, where lower case is one character for another and normal form C changes nothing."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """One vocabulary file; `make` turns a piece's ids into what is kept for it (a count, or packed ids)."""

    def __init__(self, library: Tokenizer, make: Callable[[list[int]], object], form: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.make, self.form = library, make, form
        self.library.no_padding()
        self.library.no_truncation()
        self.drops_space = "Lowercase" in str(self.library.normalizer)
        self.bytes, self.tokenize = _byte_alphabet(), self.library.model.tokenize
        self.kept, self.after = _Kept(self, False), _Kept(self, True)  # after: pieces that follow a space, written without it
        self.known = _Known(self)
        self.marks = {m: make(self.library.encode(m, add_special_tokens=False).ids) for m in (".", ",")}

    def letters(self, word: str, space: bool) -> str:
        """A word in the characters that the vocabulary writes bytes with."""
        if not word.isascii():
            word = "".join(map(self.bytes.__getitem__, word.encode()))
        return self.bytes[32] + word if space and not self.drops_space else word

    def _look(self, pieces: list[str], space: bool) -> Iterable:
        """The kept value of each piece."""
        return map((self.after if space else self.kept).__getitem__, pieces)

    def encode(self, text: str) -> Iterable:
        """The kept values of text's pieces, in order."""
        if self.drops_space:
            if "<|" not in text and _is_latin(text):  # lower case once for all; special tokens are read in their own case
                text = text.lower()
            return self._look(text.replace("\n", " ").split(" "), False)
        if "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text and text[:1] not in " \n" and text[-1:] not in " \n":
            lines = [line.split(" ") for line in text.split("\n")]
            if sum(map(len, lines)) == len(text.split()):  # else there is other white space
                out = []
                for i, line in enumerate(lines):
                    out += self._look(["\n", line[0]] if i else [line[0]], False)
                    if len(line) > 1:
                        out += self._look(line[1:], True)
                return out
        return self._look(_SAFE.split(text), False)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out, quick = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if self.drops_space and "<|" not in text and _is_latin(text):
                quick.append(i)
            else:
                out[i] = b"".join(self.encode(text))
        if quick:
            words = pc.split_pattern(pa.array([texts[i].lower().replace("\n", " ") for i in quick], type=pa.large_string()), " ")
            pieces = words.values.dictionary_encode()
            known, starts, sizes = self.known.look(pieces.dictionary)
            at = pieces.indices.to_numpy()
            n = sizes[at]
            ends = np.cumsum(n)  # of each piece's ids in the result
            ids = known[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])]
            cuts = np.r_[0, ends][words.offsets.to_numpy()].tolist()
            for i, a, b in zip(quick, cuts, cuts[1:], strict=False):
                out[i] = ids[a:b].tobytes()
        return out


class _Known:
    """The pieces kept for blocks: Arrow strings and, in one array, their ids."""

    def __init__(self, of: Encoder):
        self.of, self.waiting, self.before, self.missed = of, {}, {}, 0  # waiting: before is the generation that goes next
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, of.form), np.zeros(0, np.int64)

    def look(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of the different pieces starts and how many it has.

        Signs after letters are looked up apart from the word; no token crosses that boundary."""
        words = pc.replace_substring_regex(pieces, _MARKED, r"\1")
        mark = pc.binary_length(words).to_numpy() < pc.binary_length(pieces).to_numpy()
        tails = pc.replace_substring_regex(pieces.filter(pa.array(mark)), _MARKED, r"\2").dictionary_encode()
        words = words.dictionary_encode()
        parts = (np.ones(len(mark), dtype=bool), words, *self._words(words.dictionary)), (mark, tails, *self._tails(tails.dictionary.to_pylist()))
        counts = np.zeros((2, len(mark)), dtype=np.int64)
        for count, (here, codes, _, _, sizes) in zip(counts, parts, strict=True):
            count[here] = sizes[codes.indices.to_numpy()]
        ends = np.cumsum(counts.sum(axis=0))
        out = np.empty(ends[-1], self.ids.dtype)
        for k, (here, codes, ids, starts, _) in enumerate(parts):
            n = counts[k, here]
            last = np.cumsum(n)
            within, first = np.arange(n.sum()), (ends - counts[k:].sum(axis=0))[here]
            out[np.repeat(first - (last - n), n) + within] = ids[np.repeat(starts[codes.indices.to_numpy()] - (last - n), n) + within]
        return out, ends - counts.sum(axis=0), counts.sum(axis=0)

    def _tails(self, signs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = [self.of.kept[s] for s in signs]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.ids.dtype.itemsize
        return np.frombuffer(b"".join(values), self.ids.dtype), np.cumsum(sizes) - sizes, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        pieces, again, values = words.take(pa.array(new)).to_pylist(), [], []
        waiting, before, value = self.waiting, self.before, self.of.kept._value
        for i, piece in enumerate(pieces):
            if (v := waiting.pop(piece, None)) is not None or (v := before.pop(piece, None)) is not None:
                again.append(i)
            else:
                v = value(piece)
                if len(piece) < 64:
                    waiting[piece] = v
            values.append(v)
        if len(waiting) > WAITING // 2:
            self.waiting, self.before = {}, waiting
        more, size = np.frombuffer(b"".join(values), self.ids.dtype), np.fromiter(map(len, values), np.int64, len(values)) // self.ids.dtype.itemsize
        ids, sizes = np.concatenate([self.ids, more]), np.concatenate([self.sizes, size])
        at[new] = len(self.words) + np.arange(len(new))
        starts = np.cumsum(sizes) - sizes
        found = ids, starts[at], sizes[at]
        if len(self.words) + len(again) <= KEPT:
            self.words = pa.concat_arrays([self.words, pa.array([pieces[i] for i in again], pa.large_string())])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join([values[i] for i in again]), self.ids.dtype)])
            self.sizes = np.concatenate([self.sizes, size[again]])
        else:
            self.missed += len(again)
            if self.missed > KEPT:  # the pieces kept are of other texts than these
                self.__init__(self.of)
        return found


_ENCODERS: dict = {}  # of a worker


def encoder(path: str, kind: str) -> Encoder:
    """kind: 'count' keeps numbers of tokens, 'pack' little-endian 16-bit ids (32-bit if the vocabulary needs them)."""
    if (path, kind) not in _ENCODERS:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        form = "H" if library.get_vocab_size() <= 1 << 16 else "I"
        _ENCODERS.clear()  # one vocabulary's pieces at a time
        _ENCODERS[path, kind] = Encoder(library, len if kind == "count" else _packer(form), f"<u{array(form).itemsize}")
    return _ENCODERS[path, kind]


def _packer(form: str) -> Callable[[list[int]], bytes]:
    def pack(ids: list[int]) -> bytes:
        out = array(form, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    return pack
