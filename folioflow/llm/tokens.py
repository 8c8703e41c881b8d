"""Tokenizing with a memo of pieces of text.

The BPE merge loop of the ``tokenizers`` library is the costliest step of
tokenizing, and corpora repeat their words. Both vocabularies used here never
merge across a boundary between a word and the white space after it, nor
between ASCII letters, digits and other signs (but for apostrophes), so texts
are cut there, each distinct piece goes through the library once per worker,
and a text's ids are the joined ids of its pieces. Pieces are cut, hashed and
looked up as arrays; the memo holds 128 bits of hash and the ids of a piece.
It is bounded by its entries: when full, it keeps those that were met again.
Results don't depend on it.

An added token's string in a text, such as a literal <|endoftext|>, is encoded
as text (``special_as_text``, the library's ``encode_special_tokens``), so that
no text can end a document inside a sequence; the vocabularies' own guide does
the same. With ``special_as_text=False`` texts that hold one go through a plain
call of the library, which gives the token's id.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .words import bytes_of, edges, lane_hashes, plain

#: White space beyond ASCII that a byte-level pattern knows; texts with it aren't cut.
_OTHER = "[\u0085   -     　]"

#: The split patterns of the two public vocabularies. They are used for Latin text alone.
_LATIN_LED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATIN_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: What isn't plain Latin text: other scripts, marks that might compose, odd white space, controls.
_NOT_LATIN = re.compile("[^\t\n\r -~\xa1-įĲ-ɏ]")

#: Pieces that a worker's memo holds, about 70 bytes each; bytes of text that are encoded at once.
MEMO_PIECES, ENCODE_BYTES = 700_000, 4_000_000

_APART, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)

_WORKER: dict[tuple, "MemoTokenizer"] = {}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, take
    the letters from code point 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def _kinds() -> np.ndarray:
    """Kinds of bytes; next to those set apart (apostrophes, parts of other letters) no word is cut."""
    out = np.full(256, _APART, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = _SPACE if c in " \t\n\r\x0b\x0c" else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _APART if c == "'" else _SIGN
    return out


_KINDS = _kinds()


def inner_cuts(raw: np.ndarray) -> np.ndarray:
    """Places inside words where the kind of byte changes."""
    kind = _KINDS[raw]
    left, right = kind[:-1], kind[1:]
    return np.flatnonzero((left != right) & (left >= _LETTER) & (right >= _LETTER)) + 1


class MemoTokenizer:
    """Ids of whole texts as little-endian unsigned arrays.

    ``leading_space``: the vocabulary keeps white space in front of a word
    (byte-level BPE); otherwise text is lower-cased and white space is dropped
    (word BPE). Latin pieces are split here and go to the library's model; all
    others go through its normalizer and pre-tokenizer first.
    """

    def __init__(self, path: str, leading_space: bool, dtype: str, memo_pieces: int = MEMO_PIECES, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added and not special_as_text else None
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.normalizer = self.tokenizer.normalizer
        self.leading_space, self.dtype, self.memo_pieces = leading_space, np.dtype(dtype), memo_pieces
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.blank = _byte_letters()[32]
        self._forget()

    def _forget(self) -> None:
        """An empty memo: hashes, second hashes, and where each entry's ids stand in the pool."""
        self.index = pd.Index(np.empty(0, np.uint64))
        self.check = np.empty(0, np.uint64)
        self.ids, self.place = np.empty(0, self.dtype), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)

    def _shrink(self) -> None:
        """Keep the pieces that were met more than once, if they fill less than half of the memo."""
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > self.memo_pieces:
            return self._forget()
        count = np.diff(self.place)[keep]
        place = np.concatenate(([0], np.cumsum(count)))
        self.ids = self.ids[np.arange(place[-1]) + np.repeat(self.place[keep] - place[:-1], count)]
        self.index, self.check, self.place = pd.Index(self.index.to_numpy()[keep]), self.check[keep], place
        self.met = np.zeros(len(keep), np.int64)

    def _text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of a text."""
        tokenize = self.model.tokenize
        if raw.isalpha():  # ASCII letters alone
            return [t.id for t in tokenize(raw.decode())]
        if self.leading_space and raw[:1] == b" " and raw[1:].isalpha():
            return [t.id for t in tokenize(self.blank + raw[1:].decode())]
        text = raw.decode()
        if _NOT_LATIN.search(text) is None:
            if not self.leading_space:
                text = text.lower()
            if text[self.leading_space and text[:1] == " " :].isalpha():
                parts = [text]
            else:
                parts = _LATIN_LED.findall(text) if self.leading_space else _LATIN_WORD.findall(text)
            parts = [p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.letters) for p in parts]
        else:
            if self.normalizer is not None:
                text = self.normalizer.normalize_str(text)
            parts = [p for p, _ in self.pre.pre_tokenize_str(text)]
        return [t.id for p in parts for t in tokenize(p)]

    def _learn(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Add the pieces at these places, whose hashes are distinct and new, to the memo."""
        data = raw.tobytes()
        found = [self._piece(data[a : a + n]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        more = np.cumsum([len(x) for x in found])
        self.place = np.concatenate((self.place, self.place[-1] + more))
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], self.dtype)))
        self.check = np.concatenate((self.check, check))
        self.met = np.concatenate((self.met, np.zeros(len(h), np.int64)))
        self.index = pd.Index(np.concatenate((self.index.to_numpy(), h)))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of texts, begin and size of their pieces, and each text's first piece."""
        raw, cut = bytes_of(texts)
        _, start, stop = edges(raw, cut)
        inner = inner_cuts(raw)
        inner = inner[cut[np.searchsorted(cut, inner)] != inner]  # texts are cut anyway
        if not self.leading_space:
            start, stop = np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((stop, inner)))
            return raw, start, stop - start, np.searchsorted(start, cut)
        # A piece goes on from the end of the one before; white space at a text's end is one of its own.
        ends = np.sort(np.concatenate((stop, inner, cut[1:][np.diff(cut) > 0])))
        ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
        begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return raw, begin, ends - begin, np.searchsorted(begin, cut)

    def _pieces_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin, and the end."""
        if not self.leading_space:
            texts = pc.ascii_lower(texts)
        raw, begin, size, first = self._cut(texts)
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        h, check = lane_hashes(padded, begin, size), lane_hashes(padded, begin, size, 0x51ED2701)
        if len(self.index) > self.memo_pieces:
            self._shrink()
        at = self.index.get_indexer(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            order = new[np.argsort(h[new], kind="stable")]
            order = order[np.concatenate(([True], h[order][1:] != h[order][:-1]))]
            self._learn(padded, begin[order], size[order], h[order], check[order])
            at[new] = self.index.get_indexer(h[new])
        self.met += np.bincount(at, minlength=len(self.met))
        count = np.diff(self.place)[at]
        other = np.flatnonzero(self.check[at] != check)
        out_at = np.concatenate(([0], np.cumsum(count)))
        take = np.arange(out_at[-1]) + np.repeat(self.place[at] - out_at[:-1], count)
        ids, bounds = self.ids[take], out_at[first]
        if len(other):  # two pieces with one hash: the texts that hold them go to the library whole
            return self._mended(texts, ids, bounds, np.unique(np.searchsorted(first, other, side="right") - 1))
        return ids, bounds

    def _mended(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with some texts encoded whole."""
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in rows.tolist():
            parts[k] = self._text(texts[k].as_py())
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode(self, texts: pa.Array | Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin, and the end."""
        texts = plain(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        apart = np.zeros(len(texts), bool)
        if self.leading_space:
            apart |= pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        if self.whole is not None:
            apart |= pc.match_substring_regex(texts, self.whole.pattern, ignore_case=True).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._pieces_ids(texts)
        ids, bounds = self._pieces_ids(pc.if_else(pa.array(apart), "", texts))
        return self._mended(texts, ids, bounds, np.flatnonzero(apart))


def with_ends(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[bounds[1:] + np.arange(n)] = False
    out[own] = ids
    return out, bounds + np.arange(n + 1)


def worker_tokenizer(path: str, leading_space: bool, dtype: str, memo_pieces: int = MEMO_PIECES, special_as_text: bool = True) -> MemoTokenizer:
    """One tokenizer and memo per Python worker, kept from task to task."""
    key = (path, leading_space, dtype, memo_pieces, special_as_text)
    if key not in _WORKER:
        release()
        _WORKER[key] = MemoTokenizer(path, leading_space, dtype, memo_pieces, special_as_text)
    return _WORKER[key]


def release() -> None:
    """Drop the worker's memo and give free memory back; operators that need memory for their own work call this first."""
    _WORKER.clear()
    trim()


def trim() -> None:
    """Give memory that Python and Arrow hold but don't use back to the system, which idle workers would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``chars`` characters each, one row at least."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
