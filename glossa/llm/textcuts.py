"""Cuts of whole Arrow text columns by classes of bytes, without a Python object a word.

All classes used here are made of ASCII characters and of "all others"; each byte of a longer UTF-8 character
counts as "other", so cuts by bytes are cuts by code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: ``A-Z`` to ``a-z``, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(characters: str) -> np.ndarray:
    """Which bytes are one of some ASCII characters."""
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the place where each text begins, with the end."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An array of texts from bytes that lie end to end."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def runs(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """Maximal runs of bytes for which ``inside`` holds, none across the places in ``offsets``: where each begins, and the runs."""
    keep = inside[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    if offsets is not None:
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = keep[at]
    starts = np.flatnonzero(begins)
    return starts, slices(data[keep], np.cumsum(keep)[starts] - 1)


def blocks(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until a text column has ``least`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


#: Bytes that surely are no white space: of an ASCII character, or the first of a two-byte one above U+00BF.
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
#: All ASCII signs but the apostrophe, which may begin a match with the letters behind it.
_MARK = byte_class("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_ALNUM = byte_class("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at places where a match always begins, for split patterns whose matches are letters, digits or other signs, each kind with one space
    before it at most, or white space, or an apostrophe and letters.

    Such places are, between two characters that surely are no white space: a space; both sides of a line feed; and an ASCII sign but the apostrophe
    behind a letter or digit. No match reaches over them and none looks beyond them, so a text's tokens are those of its chunks, one after the other. Returns
    the chunks and, for each text and the end, the number of chunks before it.
    """
    data, offsets = raw(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    begins = np.zeros(len(data), bool)
    kind = data[1:-1]
    at = np.flatnonzero((kind == 0x20) | (kind == 0x0A) | _MARK[kind]) + 1
    before, after, two, own = data[at - 1], data[at + 1], data[np.maximum(at - 2, 0)], data[at]
    white = ~_MARK[own]
    # A letter of two bytes: U+00C0 to U+017F but for the signs of multiplication and division.
    letter = (before >= 0x80) & (two >= 0xC3) & (two <= 0xC5) & ~((two == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    solid = (_GRAPHIC[after] | _LEAD[after]) & (_GRAPHIC[before] | ((before >= 0x80) & _LEAD[two]))
    cut = np.where(white, solid, _ALNUM[before] | letter)
    begins[at[cut]] = True
    begins[at[cut & (own == 0x0A)] + 1] = True
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    return slices(data, starts), np.searchsorted(starts, offsets)


class ChunkIds:
    """Ids of texts, where each distinct chunk is encoded once for as long as the cache has it; two generations of ``size`` chunks at most."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kind: str, size: int = 300_000):
        self.own, self.kind, self.size = encode, np.dtype(kind), size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as bytes."""
        found = list(map(self.young.get, chunks))
        lack = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in lack:
            found[i] = self.old.get(chunks[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self.own([chunks[i] for i in new])):
            found[i] = ids
        if len(self.young) + len(lack) > self.size:
            self.old, self.young = self.young, {}
        self.young.update((chunks[i], found[i]) for i in lack if len(chunks[i]) < 64)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin, with the end."""
        parts, ends = chunks(texts)
        if not len(parts):
            return np.zeros(0, self.kind), np.zeros(len(ends), np.int64)
        coded = parts.dictionary_encode()
        own = pa.array(self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        offsets = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
        return np.frombuffer(own.buffers()[2], self.kind), offsets[ends] // self.kind.itemsize
