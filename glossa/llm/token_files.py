"""Token ids as compressed binary files: static range asymmetric numeral systems (rANS).

``encode`` gives each document's ids by the tokenizers library; ``write`` orders documents by id and stores
their ids; ``read`` gives them back. What is stored, in a folder:

* ``table``: how often each id occurs in all documents, scaled to a sum of 2**bits. All blocks share it.
* ``blocks``: Parquet files, one row a block, in the order of ``part`` and ``block``; their commit is Spark's, so a task that is
  lost or runs twice adds nothing. A block holds whole documents, at least ``BLOCK`` ids but for the last of a part, and stands alone:

      magic "TANS", version, lanes, steps between checkpoints, number of documents, of ids, of checkpoints, of stream words    (``HEAD``)
      crc32 of all that follows
      uint32 sizes of the documents in ids, the end mark included
      for each checkpoint: uint64 place in the stream, uint32 crc32 of its ids, uint64 states of all lanes
      the stream: uint32 words

Id k of a block is coded by lane k mod lanes, so a step codes or decodes one id of every lane at once (numpy arrays in a task). A lane's state lies in
[2**31, 2**63) and gives or takes words of 32 bits. States are saved every ``STEPS`` steps, and decoding may begin at each of these
checkpoints: ``decode_block`` runs all stretches between checkpoints side by side, and ``read_ids`` decodes only the stretches that a range of ids meets.
Damage is found by the checksums and raises ValueError.

Tokenization: texts are cut at places where a match of the split pattern always begins (``textcuts.chunks``); each distinct chunk is encoded by the library,
once for as long as the worker's cache has it.

Defined results: null texts are empty and have the end mark alone; special tokens written in a text are ordinary text; documents come by ascending id, null first,
rows with the same id side by side, with their ids' hash and then their place in the input deciding; an empty table
gives empty files; extra columns play no part, whatever their names. A document is at most 2 GB of ids, as its text is.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import textcuts
from glossa.llm.common import discard, prepare, shared_dir, stash

#: Ids of a block, and of a part (a file), at least.
BLOCK, PART = 1 << 20, 1 << 26
#: Bytes of text that are encoded at a time, so that chunks they share are looked up once.
TEXT = 4 << 20
#: New chunks that the library encodes as one text, with line feeds between them.
JOINED = 200
#: Lanes of a large block; a small one has a lane for every ``STEPS`` ids.
LANES = 1024
#: Steps between checkpoints.
STEPS = 256
#: The sum of all scaled counts is 2**bits: 16 times the number of ids at least, in these bounds.
LEAST_BITS, MOST_BITS = 12, 24
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
MAGIC = b"TANS"
HEAD = struct.Struct("<4sHHIIQIQ")

# Frequency table


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts scaled to a sum of 2**bits, at least 1 for each that isn't 0; ids that don't occur get none."""
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.int64), LEAST_BITS
    bits = min(max(LEAST_BITS, int(16 * len(used) - 1).bit_length()), MOST_BITS)
    if len(used) > 1 << bits:
        raise ValueError(f"more than {1 << MOST_BITS} different ids")
    total, want = int(counts.sum()), 1 << bits
    out = np.zeros(len(counts), np.int64)
    # Python integers, as counts times 2**bits may pass 64 bits.
    out[used] = [max(1, c * want // total) for c in counts[used].tolist()]
    lack = want - int(out.sum())
    # The largest give or take what rounding left over.
    order = used[np.argsort(-out[used], kind="stable")]
    while lack:
        for i in order.tolist():
            step = lack if lack > 0 else max(lack, 1 - int(out[i]))
            out[i] += step
            lack -= step
            if not lack:
                break
    return out, bits


class Table:
    """The shared table, ready for coding."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.begin = (np.cumsum(freq) - freq).astype(np.uint64)
        #: A state of this size must give a word before the id is coded.
        self.most = self.freq << np.uint64(63 - bits)
        self.id_at = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


# Blocks


def lanes_of(n: int) -> int:
    return max(1, min(LANES, n // STEPS))


def encode_block(sizes: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """A block of documents: their sizes, and their ids end to end."""
    n = len(ids)
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    given = 0
    saved: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(own)]
        freq = table.freq[own]
        full = x >= table.most[own]
        if full.any():
            # The decoder meets the words from last to first, so lanes are written in reverse.
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            given += len(out)
            x[full] = out >> _WORD
        whole, rest = np.divmod(x, freq)
        x[:] = (whole << table.bits) + rest + table.begin[own]
        if step % STEPS == 0:
            saved.append((given, state.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    body = [sizes.astype("<u4").tobytes()]
    per = STEPS * lanes
    for k, (given_then, states) in enumerate(reversed(saved)):
        body.append(struct.pack("<QI", given - given_then, zlib.crc32(ids[k * per : (k + 1) * per].astype("<u4").tobytes())))
        body.append(states.astype("<u8").tobytes())
    body.append(stream.astype("<u4").tobytes())
    rest = b"".join(body)
    return HEAD.pack(MAGIC, 1, lanes, STEPS, len(sizes), n, len(saved), len(stream)) + struct.pack("<I", zlib.crc32(rest)) + rest


@dataclass
class Opened:
    """The parts of a stored block."""

    lanes: int
    steps: int
    sizes: np.ndarray
    n: int
    places: np.ndarray
    crcs: np.ndarray
    states: np.ndarray
    stream: np.ndarray


def open_block(data: bytes) -> Opened:
    magic, version, lanes, steps, n_docs, n, n_saved, n_words = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    (crc,) = struct.unpack_from("<I", data, HEAD.size)
    at = HEAD.size + 4
    if zlib.crc32(memoryview(data)[at:]) != crc:
        raise ValueError("a block of token ids is damaged")
    sizes = np.frombuffer(data, "<u4", n_docs, at)
    at += 4 * n_docs
    saved = np.frombuffer(data, np.dtype([("place", "<u8"), ("crc", "<u4"), ("states", "<u8", (lanes,))]), n_saved, at)
    at += saved.nbytes
    return Opened(lanes, steps, sizes, n, saved["place"], saved["crc"], saved["states"].reshape(n_saved, lanes), np.frombuffer(data, "<u4", n_words, at))


def decode_stretches(block: Opened, table: Table, first: int, last: int) -> np.ndarray:
    """The ids from checkpoint ``first`` up to before checkpoint ``last``, all stretches between checkpoints at a time."""
    per = block.steps * block.lanes
    count = last - first
    out = np.zeros((count, block.steps, block.lanes), np.uint32)
    state = block.states[first:last].astype(np.uint64)
    place = block.places[first:last].astype(np.int64)
    stream = block.stream
    for step in range(block.steps):
        # Ids that are left at this step; only the last stretch of a block ends early.
        left = block.n - (np.arange(first, last) * per + step * block.lanes)
        if left[0] <= 0:
            break
        live = np.arange(block.lanes)[None, :] < left[:, None] if left[-1] < block.lanes else None
        slot = state & table.mask
        ids = table.id_at[slot]
        out[:, step, :] = ids
        new = table.freq[ids] * (state >> table.bits) + slot - table.begin[ids]
        take = new < _LOW if live is None else (new < _LOW) & live
        taken = np.cumsum(take, axis=1)
        source = place[:, None] + taken - 1
        if source[:, -1].max() >= len(stream):
            raise ValueError("a block's stream ends early: it was coded with another table")
        new[take] = new[take] << _WORD | stream[source[take]].astype(np.uint64)
        state = new if live is None else np.where(live, new, state)
        place = place + taken[:, -1]
    flat = out.reshape(-1)[: block.n - first * per]
    for k in range(count):
        if zlib.crc32(flat[k * per : (k + 1) * per].tobytes()) != block.crcs[first + k]:
            raise ValueError("ids of a block differ from their checksum")
    return flat


def decode_block(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the documents, and their ids end to end."""
    block = open_block(data)
    return block.sizes, decode_stretches(block, table, 0, len(block.places)) if block.n else np.zeros(0, np.uint32)


def decode_range(data: bytes, table: Table, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, from the checkpoint before them on."""
    block = open_block(data)
    start, stop = max(start, 0), min(stop, block.n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    per = block.steps * block.lanes
    first = start // per
    return decode_stretches(block, table, first, -(-stop // per))[start - first * per : stop - first * per]


# Tokenization

#: Chunks of signs that surely are no white space, with one space before them at most: matches of the split pattern end before and behind a line feed next to them.
_PLAIN = re.compile(" ?[!-~\u00c0-\u024f]+")


def library_ids(definition: bytes, kind: str) -> textcuts.ChunkIds:
    """Ids by the tokenizers library; plain chunks are encoded many at a time, with line feeds between them, where the line feed has an id of its own."""
    # Spark's tasks use the cores already.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(definition)
    library.encode_special_tokens = True

    code, size = np.dtype(kind).char, np.dtype(kind).itemsize
    feed = library.encode("\n", add_special_tokens=False).ids
    apart = len(feed) == 1 and library.encode("a\n b\na", add_special_tokens=False).ids.count(feed[0]) == 2

    def single(chunks: list[str]) -> list[bytes]:
        return [array(code, e.ids).tobytes() for e in library.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(chunks: list[str]) -> list[bytes]:
        plain = [i for i, c in enumerate(chunks) if _PLAIN.fullmatch(c)] if apart else []
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        out: list[bytes | None] = [None] * len(chunks)
        for group, e in zip(groups, library.encode_batch_fast(["\n".join([chunks[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            at = (np.flatnonzero(ids == feed[0]) * size).tolist()
            if len(at) + 1 == len(group):
                data = ids.tobytes()
                for i, a, b in zip(group, [0, *[a + size for a in at]], [*at, len(data)]):
                    out[i] = data[a:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, single([chunks[i] for i in rest])):
            out[i] = ids
        return out

    return textcuts.ChunkIds(encode, kind)


_CHUNKS: dict[tuple[int, str], textcuts.ChunkIds] = {}


def shared_chunks(definition: bytes, kind: str) -> textcuts.ChunkIds:
    """One per Python worker and vocabulary."""
    key = (hash(definition), kind)
    if key not in _CHUNKS:
        _CHUNKS.clear()
        _CHUNKS[key] = library_ids(definition, kind)
    return _CHUNKS[key]


def encode(docs: DataFrame, path: str, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids: little-endian ids of 2 bytes, or 4 for vocabularies beyond 65,536, with the end mark.

    The file at ``path``, of fixed size, goes to the tasks as bytes.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(path, "rb") as file:
        definition = file.read()
    shipped, kind = spark.sparkContext.broadcast(definition), width(definition, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = shared_chunks(shipped.value, kind)
        mark = np.array([end], kind).tobytes()
        for batch in textcuts.blocks(batches, 1, TEXT):
            ids, offsets = chunks.encode(batch.column(1))
            view, at = memoryview(ids.tobytes()), (offsets * ids.itemsize).tolist()
            rows = [b"".join((view[a:b], mark)) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary")


def width(definition: bytes, end: int) -> str:
    """The numpy type of ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_buffer(definition).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


# Files


def frequencies(encoded: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs: as many rows as there are different ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            # One count a batch, as each is as long as the vocabulary.
            more = np.bincount(np.frombuffer(b"".join(ids.as_buffer() for ids in batch.column(0)), kind))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "c"])

    rows = encoded.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    return {r.id: r.c for r in rows.collect()}


@dataclass(frozen=True)
class Store:
    """Where the files of a corpus are."""

    path: str
    bits: int
    #: Ids of all parts before each part.
    before: dict[int, int]

    def table(self, spark: SparkSession) -> Table:
        rows = spark.read.parquet(f"{self.path}/table").collect()
        freq = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
        for r in rows:
            freq[r.id] = r.freq
        return Table(freq, self.bits)

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")


def write(docs: DataFrame, path: str, where: str | None = None, end: int = 0, parts: int | None = None) -> Store:
    """Encodes documents and writes their files into ``where`` (unset: a new folder in the shared one)."""
    spark = docs.sparkSession
    where = where or f"{shared_dir(spark)}/glossa-token-files-{uuid.uuid4().hex}"
    with open(path, "rb") as file:
        kind = width(file.read(), end)
    encoded = stash(encode(docs, path, end), "token-ids")
    counts = frequencies(encoded, kind)
    often = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, c in counts.items():
        often[i] = c
    freq, bits = scaled(often)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{where}/table")
    shipped = spark.sparkContext.broadcast((freq, bits))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, number, before = Table(*shipped.value), TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, before, names, held, size
            data = encode_block(np.array([len(h) for h in held]), np.concatenate(held), table)
            docs_of = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs_of)], pa.int32()), docs_of), pa.array([data], pa.binary())],
                names=["part", "block", "before", "n_ids", "doc_ids", "data"],
            )
            number, before, names, held, size = number + 1, before + size, [], [], 0
            return row

        for batch in batches:
            first = 0
            for i, ids in enumerate(batch.column(1)):
                held.append(np.frombuffer(ids.as_buffer(), kind))
                size += len(held[-1])
                if size >= BLOCK:
                    names.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield closed()
            names.append(batch.column(0).slice(first))
        if held:
            yield closed()

    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // PART))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("ids"), F.col("place")]
    placed = encoded.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = placed.select("doc_id", "ids").mapInArrow(run, f"part int, block int, before long, n_ids long, doc_ids array<{id_type}>, data binary")
    rows.write.mode("overwrite").parquet(f"{where}/blocks")
    discard(encoded)
    # One row a part: its sum of ids.
    totals = spark.read.parquet(f"{where}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, done = {}, 0
    for r in totals:
        before[r.part] = done
        done += r.n
    return Store(where, bits, before)


def read(spark: SparkSession, store: Store, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, token_ids."""
    prepare(spark)
    blocks = store.blocks(spark)
    shipped = spark.sparkContext.broadcast((store.table(spark), store.before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shipped.value
        for batch in batches:
            for part, block, docs, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                sizes, ids = decode_block(data.as_py(), table)
                ends = np.cumsum(sizes, dtype=np.int64)
                view, at = memoryview(ids.astype("<u4").tobytes()), np.append(0, 4 * ends).tolist()
                arrays = [
                    docs.values,
                    pa.array(ends - sizes + before[part] + block, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(arrays)])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", token_ids array<int>" if with_ids else "")
    return blocks.select("part", "before", "doc_ids", "data").mapInArrow(run, schema)


def read_ids(spark: SparkSession, store: Store, start: int, stop: int) -> DataFrame:
    """Ids ``start`` to ``stop`` of the whole corpus as rows (start, token_ids), one a block: only blocks in the range are read, and of these the stretches in it."""
    prepare(spark)
    shipped = spark.sparkContext.broadcast(store.table(spark))
    parts = sorted(store.before)
    met = [p for p, q in zip(parts, [*parts[1:], None]) if store.before[p] < stop and (q is None or store.before[q] > start)]
    base = F.create_map(*chain.from_iterable((F.lit(p), F.lit(store.before[p])) for p in met)) if met else F.create_map(F.lit(-1), F.lit(0))
    blocks = store.blocks(spark).where(F.col("part").isin(met)).withColumn("at", base[F.col("part")] + F.col("before"))
    blocks = blocks.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = decode_range(data.as_py(), shipped.value, start - at, stop - at)
                yield pa.RecordBatch.from_arrays([pa.array([max(at, start)], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "token_ids"])

    return blocks.select("at", "data").mapInArrow(run, "start long, token_ids array<int>")
