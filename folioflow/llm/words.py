"""Words of many texts at once, as numpy arrays over one buffer.

Texts of a batch are cut into words without a Python object per word: the
buffer holds every word with one blank behind it, and offsets say where each
begins. Hashes, anchors and digests are computed from these arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at once; one text at least.
SLICE_BYTES = 2_000_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    held = texts.buffers()
    at = np.frombuffer(held[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(held[2], np.uint8)[at[0] : at[-1]] if held[2] is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def sliced(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least."""
    at = bytes_of(texts)[1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def space_mask(raw: np.ndarray) -> np.ndarray:
    """Which bytes are one of the six ASCII white-space characters."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def edges(raw: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where words begin and end; ``cut``: where texts begin, and the end."""
    space = space_mask(raw)
    inside = ~space
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= space[:-1]
    last[:-1] &= space[1:]
    some = np.diff(cut) > 0
    head, tail = cut[:-1][some], cut[1:][some] - 1
    begin[head] = inside[head]
    last[tail] = inside[tail]
    return inside, np.flatnonzero(begin), np.flatnonzero(last) + 1


class Words:
    """The words of ``texts``; with ``lower`` A-Z count as a-z.

    ``norm``: every word with one blank behind it. ``at``: where each word
    begins there, and the end. ``first``: the number of each text's first word,
    and of all words. ``start``, ``stop``: places in the raw bytes.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = plain(texts)
        if lower:
            texts = pc.ascii_lower(texts)
        self.raw, self.cut = bytes_of(texts)
        inside, self.start, self.stop = edges(self.raw, self.cut)
        self.length = self.stop - self.start
        self.first = np.searchsorted(self.start, self.cut)
        self.at = np.concatenate(([0], np.cumsum(self.length + 1)))
        self.norm = np.full(int(self.at[-1]) + 8, 32, np.uint8)
        letters = np.ones(int(self.at[-1]), bool)
        letters[self.at[1:] - 1] = False
        self.norm[: len(letters)][letters] = self.raw[inside]

    def __len__(self) -> int:
        return len(self.length)

    def array(self) -> pa.Array:
        """Words with their blanks as an Arrow array over the buffer."""
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.norm)])

    def hashes(self) -> np.ndarray:
        """64 bits of each word, from its bytes eight at a time."""
        return lane_hashes(self.norm, self.at[:-1], self.length)

    def anchors(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first word, end, hash of the anchor.

        A window's anchor is the ``anchor``-word sequence in it with the
        smallest hash, the first of equal ones; no window leaves its text.
        """
        n, none = len(self), np.empty(0, np.int64)
        if n < window:
            return none, none, none
        w = self.hashes()
        k = n - anchor + 1
        mixed = np.zeros(k, np.uint64)
        for j in range(anchor):
            mixed = (mixed ^ w[j : j + k]) * _MULTIPLIERS[j]
            mixed ^= mixed >> np.uint64(32)
        # Places in the low bits, so that minima tell where they stand.
        bits = np.uint64(max(1, k.bit_length()))
        best = mixed >> bits << bits | np.arange(k, dtype=np.uint64)
        span, size = window - anchor + 1, 1
        while size < span:
            step = min(size, span - size)
            best = np.minimum(best[:-step], best[step:])
            size += step
        at = (best & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        valid = np.flatnonzero(left[: len(at)] >= window)
        if not len(valid):
            return none, none, none
        at = at[valid]
        head = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        tail = np.concatenate((head[1:] - 1, [len(at) - 1]))
        return valid[head], valid[tail] + window, mixed[at[head]].view(np.int64)

    def kept(self, covered: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The buffer without the covered words, and where each text begins in it, and the end."""
        if not covered.any():
            return memoryview(self.norm), self.at[self.first]
        keep = np.repeat(~covered, self.length + 1)
        at = np.concatenate(([0], np.cumsum(np.where(covered, 0, self.length + 1))))
        return memoryview(self.norm[: len(keep)][keep]), at[self.first]


def lane_hashes(buffer: np.ndarray, at: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte ranges of ``buffer``, which must go on for 8 bytes behind the last one."""
    lanes = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))
    h = length.astype(np.uint64) * _M3 + np.uint64(seed)
    if not len(at):
        return h
    h = (h ^ (lanes[at] & _MASK[np.minimum(length, 8)])) * _M1
    h ^= h >> np.uint64(32)
    more, done = np.flatnonzero(length > 8), 8
    while len(more):
        lane = lanes[at[more] + done] & _MASK[np.minimum(length[more] - done, 8)]
        part = (h[more] ^ lane) * _M2
        h[more] = part ^ part >> np.uint64(29)
        done += 8
        more = more[length[more] > done]
    h *= _M3
    return h ^ h >> np.uint64(31)
