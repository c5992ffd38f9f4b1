"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is what merging by rank gives if and only if each adjacent pair of it is
(given a vocabulary where each token is reachable). So each byte prefix of a piece has exactly one
last token that continues the encoding of the rest, and ``last[i]`` of all prefixes is enough to encode
any prefix, to append bytes exactly and to encode again near an edit (``Prefixes``). Whole texts are encoded with the same table,
filled only where a walk from the longest tokens on needs it (``Vocabulary.on_demand``). A column of texts is cut at places where a match of the
pattern always begins, each distinct chunk is encoded once, and ids, their names and their bytes are gathered as arrays.

Defined results: null counts as the empty text, which has no tokens and the digest of the
empty string; repeated rows repeat; texts and single pieces of any length are encoded whole, in time and memory
in proportion to their bytes; an empty table gives an empty table; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glossa.llm import textcuts
from glossa.llm.common import prepare, release

#: Entries of the generation of a piece cache; at most two generations live.
CACHE = 50_000
#: Bytes of text that are encoded at a time, so that chunks they share are looked up once.
TEXT = 1 << 20
#: Bytes from which a table is an array, not a list: slower to make, a fifth of the memory.
SHORT = 1024
#: A split pattern whose matches have a space only as their first character or among white space, so that texts may be cut (``textcuts.chunks``); for other patterns they are taken whole.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as file:
        return parse_ranks(file.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Vocabulary:
    """Ranks, with the test of pairs that the prefix table rests on."""

    PAIRS = 2_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        #: Tokens by their bytes: byte -> [the next level, the token that ends here or -1].
        self.root: dict[int, list] = {}
        for data, rank in ranks.items():
            node = self.root
            for byte in data[:-1]:
                node = node.setdefault(byte, [{}, -1])[0]
            node.setdefault(data[-1], [{}, -1])[1] = rank
        #: Where a walk stands after three bytes: the level there, the longest token so far, its size.
        self.jump = self._jumps()

    def _jumps(self) -> dict[bytes, tuple[dict, int, int]]:
        out = {}
        for a, (one, token) in self.root.items():
            for b, (two, of_two) in one.items():
                best = (of_two, 2) if of_two >= 0 else (token, 1)
                for c, (three, of_three) in two.items():
                    out[bytes((a, b, c))] = (three, *((of_three, 3) if of_three >= 0 else best))
        return out

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none (below a rank) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < below and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = self.merged(data, token)
            if len(data) > 1 and len(parts) != 2:
                raise ValueError(f"merging can't reach token {token}")
            self._halves[token] = (parts[0], parts[1]) if len(data) > 1 else None
        return self._halves[token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte of that side up to the token: each part and the rank at which it is merged away."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            pair = self.halves(token)
            if pair is None:
                return out[::-1]
            token, until = pair[side], token

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together are encoded as these two.

        Merging both sides in the order of ranks, the parts that touch are those of the left token's right
        spine and the right token's left spine; the border stays if no two that meet merge earlier than
        either of them is merged within its own token (of equal ranks the left place goes first).
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            ups, downs = self._right.get(left), self._left.get(right)
            if ups is None:
                ups = self._right[left] = self._spine(left, 1)
            if downs is None:
                downs = self._left[right] = self._spine(right, 0)
            rank_of, bytes_of, i, j, known = self.ranks.get, self.bytes_of, 0, 0, True
            while True:
                (x, x_until), (y, y_until) = ups[i], downs[j]
                rank = rank_of(bytes_of[x] + bytes_of[y])
                if rank is not None and rank < x_until and rank <= y_until:
                    known = False
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
                if i == len(ups) or j == len(downs):
                    break
            if len(self._pairs) >= self.PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known


    def on_demand(self, data: bytes) -> list[int] | array:
        """The prefix table as far as the whole text needs it: the last token of the prefixes that a longest-token-first walk meets, -1 elsewhere.

        Each prefix has one valid last token, so it is entered once at most and the walk ends after
        as many steps as there are prefixes, usually after one for each token. The table is also the way back.
        """
        root, jump, fits, pairs, size_of, longest = self.root, self.jump.get, self.fits, self._pairs.get, self.size_of, self.longest
        size = len(data)
        last = [-1] * (size + 1) if size < SHORT else array("i", (-1,)) * (size + 1)
        begin = 0
        while begin < size:
            before = last[begin]
            known = jump(data[begin : begin + 3])
            if known is not None:
                # The longest token alone: it nearly always fits.
                node, token, step = known
                at = 3
                for byte in data[begin + 3 : begin + longest]:
                    hit = node.get(byte)
                    if hit is None:
                        break
                    node, found = hit
                    at += 1
                    if found >= 0:
                        token, step = found, at
                if last[begin + step] < 0:
                    if before >= 0:
                        known = pairs(before << 32 | token)
                        if known is None:
                            known = fits(before, token)
                    if known:
                        begin += step
                        last[begin] = token
                        continue
            node, here = root, []
            for byte in data[begin : begin + longest]:
                hit = node.get(byte)
                if hit is None:
                    break
                node = hit[0]
                here.append(hit[1])
            end = begin + len(here) + 1
            while here:
                token = here.pop()
                end -= 1
                if token >= 0 and last[end] < 0 and (before < 0 or fits(before, token)):
                    last[end] = token
                    begin = end
                    break
            else:
                if not begin:
                    raise ValueError("no encoding: the vocabulary has tokens that merging can't reach")
                begin -= size_of[before]
        return last

    def read_back(self, last: array | list[int], end: int) -> list[int]:
        """The tokens of a prefix, from its last one to the first."""
        size_of, out = self.size_of, []
        while end:
            token = last[end]
            if token < 0:
                raise ValueError("no token ends here: the vocabulary has tokens that merging can't reach")
            out.append(token)
            end -= size_of[token]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        return self.read_back(self.on_demand(data), len(data))


class Prefixes:
    """The unique valid last token of each byte prefix of one piece."""

    __slots__ = ("data", "last", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Adds bytes at the end; earlier entries stay valid as they are."""
        voc, last = self.vocabulary, self.last
        root, fits = voc.root, voc.fits
        old = len(self.data)
        data = self.data = self.data + more
        size = len(data)
        last.extend([-1] * len(more))
        for begin in range(max(0, old + 1 - voc.longest), size):
            node = root
            for end in range(begin + 1, size + 1):
                hit = node.get(data[end - 1])
                if hit is None:
                    break
                node, token = hit
                if token >= 0 and end > old and last[end] < 0 and (begin == 0 or fits(last[begin], token)):
                    last[end] = token
        return self

    def replace(self, start: int, end: int, new: bytes) -> Prefixes:
        """Edits bytes; only prefixes that reach behind ``start`` are computed again."""
        tail = self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        return self.append(new + tail)

    def tokens(self, end: int | None = None) -> list[int]:
        return self.vocabulary.read_back(self.last, len(self.data) if end is None else end)


class Encoder:
    """Splits texts by a pattern and encodes each match separately, keeping frequent ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.words_whole = pattern == CUTTABLE
        self.cache = cache
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self.chunks = textcuts.ChunkIds(lambda chunks: [array("i", self._chunk(c)).tobytes() for c in chunks], "i4", cache)
        names = [b""] * (max(self.vocabulary.bytes_of) + 1)
        tokens = list(names)
        for rank, data in self.vocabulary.bytes_of.items():
            names[rank], tokens[rank] = b"%d " % rank, data
        #: The decimal name with a space, and the bytes, of each id.
        self.names, self.tokens = pa.array(names, pa.large_binary()), pa.array(tokens, pa.large_binary())

    def clear(self) -> None:
        """Forgets what it has kept."""
        self._young, self._old = {}, {}
        self.chunks.clear()

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self._young.get(piece)
        if found is None:
            found = self._old.get(piece)
            if found is None:
                found = self._new(piece)
            if len(self._young) >= self.cache:
                self._old, self._young = self._young, {}
            self._young[piece] = found
        return found

    def _new(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.vocabulary.ranks.get(data)
        return (rank,) if rank is not None else tuple(self.vocabulary.encode(data))

    def _chunk(self, chunk: str) -> list[int] | tuple[int, ...]:
        """The ids of a text that isn't kept whole: its matches may be, but for long ones, which would fill the cache."""
        if self.words_whole and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._new(chunk)
        ids: list[int] = []
        for p in self.pattern.findall(chunk):
            ids += self.piece(p) if len(p) < 64 else self._new(p)
        return ids

    def encode(self, text: str) -> list[int]:
        return list(self._chunk(text)) if text else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin, with the end."""
        if self.words_whole:
            return self.chunks.encode(texts)
        ids = [self.encode(t) for t in texts.fill_null("").to_pylist()]
        return np.array(list(chain.from_iterable(ids)), np.int32), np.cumsum([0, *map(len, ids)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def open(self, text: str) -> EncodedText:
        return EncodedText(self, text)


class EncodedText:
    """A text whose encoding follows appends and edits without encoding it all again."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.starts: list[int] = []
        self.pieces: list[Prefixes] = []
        self._fill(0, 0, [])

    def _fill(self, keep: int, begin: int, tail: list[tuple[int, Prefixes]]) -> int:
        """Keeps the first pieces, splits from ``begin`` on until a split meets one of the tail."""
        del self.starts[keep:], self.pieces[keep:]
        meets = {start: i for i, (start, _) in enumerate(tail)}
        done = 0
        for m in self.encoder.pattern.finditer(self.text, begin):
            if m.start() in meets:
                for start, piece in tail[meets[m.start()] :]:
                    self.starts.append(start)
                    self.pieces.append(piece)
                break
            self.starts.append(m.start())
            self.pieces.append(Prefixes(self.encoder.vocabulary, m[0].encode("utf-8", "surrogatepass")))
            done += 1
        return done

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces characters; returns how many pieces had to be encoded.

        A match sees at most two characters beyond its end (white space gives one back), so those that end
        earlier stay; behind it, matches are the old ones from the first common border on.
        """
        ends = [*self.starts[1:], len(self.text)]
        keep = sum(e + 1 < start for e in ends)
        shift = len(new) - (end - start)
        tail = [(s + shift, p) for s, p in zip(self.starts, self.pieces) if s >= end]
        begin = self.starts[keep] if keep < len(self.starts) else (ends[-1] if self.starts else 0)
        begin = min(begin, start)
        self.text = self.text[:start] + new + self.text[end:]
        return self._fill(keep, begin, tail)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def tokens(self) -> list[int]:
        return [t for p in self.pieces for t in p.tokens()]


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def shared_encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary: only its tables stay in a worker between tasks."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(data), pattern)
    return _ENCODERS[key]


def joined(words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """What stands for each id, end to end, and the byte where each text's part begins, with the end."""
    if not len(ids):
        return memoryview(b""), [0] * len(ends)
    out = words.take(pa.array(ids))
    return memoryview(out.buffers()[2]), np.frombuffer(out.buffers()[1], np.int64)[ends].tolist()


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids.

    The vocabulary, a file of fixed size (about 1 MB), goes to the tasks as bytes, so executors need no such file.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(path, "rb") as file:
        shipped = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shipped.value, pattern)
        try:
            for batch in textcuts.blocks(batches, 1, TEXT):
                ids, ends = encoder.encode_column(batch.column(1))
                names_of, at = joined(encoder.names, ids, ends)
                # The last name of a text has a space behind it.
                ids_sha = [hashlib.sha256(names_of[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
                bytes_of, at = joined(encoder.tokens, ids, ends)
                decoded_sha = [hashlib.sha256(bytes_of[a:b]).hexdigest() for a, b in zip(at, at[1:])]
                arrays = [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            encoder.clear()
            release()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", token_ids array<int>" if with_ids else ""))
