r"""MinHash near-duplicates with tensored banding.

Documents are sets of word shingles. Two collections of ``SIDE`` keys, each from ``ROWS`` minhashes, are computed:
2 * SIDE * ROWS minhashes instead of SIDE * SIDE * 2 * ROWS. The tables' keys are all pairs (A_i, B_j), formed only
where both halves are shared with another document (a pair can't be shared otherwise), so most
documents form none. Members of a bucket are not paired with each other: a forest of the pairs that their sketches say are
closest is checked on the full sets. Where a bucket then still holds several components, the documents outside its
largest one are compared on full sets with all of that component and with each other, block by block, and only one link to
each component is written. Copies of one set are one class from the start.

At a similarity of exactly 0.75 a pair meets with probability (1 - (1 - 0.75**3)**14)**2 = 0.999 and passes the
sketch's bound (0.55 of 84 values), which only the forest of a bucket uses, with 0.9999.

Defined results: texts without words (or null) have no shingles and link with nothing; texts shorter than a shingle
are one shingle, the whole word sequence; repeated rows are copies; of rows that share an id but not the text, the one of least digest
stands for the id; rows without an id have a null component and are not kept; an empty table gives an empty table. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, prepare, releasing, stash
from glossa.llm.components import components

SHINGLE = 5
#: Links: 100 * shared >= PERCENT * union.
PERCENT = 75
SIDE, ROWS = 14, 3
#: Least share of equal sketch values of a pair that is checked.
SKETCH_LEAST = 0.55
#: Members of a bucket whose sketches one task compares at once.
BLOCK = 256
#: Shingles of the documents that one task compares on full sets, on either side: about 4,000 documents of usual length.
BLOCK_SHINGLES = 1_500_000
#: Bytes of text whose words are hashed at once; the arrays for this take some sixty times as many.
STEP = 1 << 18

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)


_BYTES = _random(11, 256)
_BYTES[[0x20, 9, 10, 11, 12, 13]] = 0
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWER = _random(12, 1)[0]
_PLACES = _random(13, 64)
_HASHES = _random(14, 2 * SIDE * ROWS)
_KEYS = _random(15, 2 * SIDE * ROWS).reshape(2 * SIDE, ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, one after the other, and where each text's begin (n + 1); about ``STEP`` bytes of text at a time."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1).tolist(), len(texts)]
    found = [_shingle_sets(texts.slice(a, b - a), shingle) for a, b in zip(cuts, cuts[1:])]
    sizes = np.concatenate([np.diff(begins) for _, begins in found])
    return np.concatenate([sets for sets, _ in found]), np.append(0, np.cumsum(sizes))


def _shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    off = off - off[0] if n else np.zeros(1, np.int64)
    begins = np.zeros(n + 1, np.int64)
    if not raw.size:
        return np.zeros(0, np.uint64), begins
    space = _SPACE[raw]
    first = ~space
    edge = np.zeros(raw.size, bool)
    edge[off[:-1][off[:-1] < raw.size]] = True
    first[1:] &= space[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    if not starts.size:
        return np.zeros(0, np.uint64), begins
    place = np.arange(raw.size) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[space | (place < 0)] = 0
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _POWER, np.uint64))
    words = _mix(np.add.reduceat(_BYTES[raw] * powers[place], starts))
    of = np.searchsorted(off, starts, side="right") - 1
    count = np.bincount(of, minlength=n)
    at = np.arange(words.size) - (np.cumsum(count) - count)[of]
    long = count[of] >= shingle
    head = long & (at + shingle <= count[of])
    i = np.flatnonzero(head)
    total = np.zeros(i.size, np.uint64)
    for j in range(shingle):
        total += words[i + j] * _PLACES[j]
    short = np.flatnonzero(~long)
    if short.size:
        lead = np.flatnonzero(at[short] == 0)
        sums = np.add.reduceat(words[short] * _PLACES[at[short]], lead) + _PLACES[32 + count[of[short[lead]]]]
        owner, total = np.concatenate([of[i], of[short[lead]]]), np.concatenate([total, sums])
    else:
        owner = of[i]
    total = _mix(total)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(total.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    owner, total = owner[new], total[new]
    begins[1:] = np.cumsum(np.bincount(owner, minlength=n))
    return total, begins


def signatures(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that have shingles: two digests of the set, the 2 * SIDE half keys, one byte of each minhash."""
    at = begins[:-1]
    least = np.empty((at.size, len(_HASHES)), np.uint64)
    for k, factor in enumerate(_HASHES):
        least[:, k] = np.minimum.reduceat(sets * factor, at)
    digests = np.stack([np.add.reduceat(sets, at), np.add.reduceat(_mix(sets ^ _KEYS[0, 0]), at)], 1)
    mixed = _mix(least)
    keys = _mix((mixed.reshape(at.size, 2 * SIDE, ROWS) * _KEYS).sum(2, dtype=np.uint64))
    return digests, keys, (mixed >> np.uint64(40)).astype(np.uint8)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, n_shingles, h1, h2, keys, sketch; the last four are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, begins = shingle_sets(batch.column(1))
            n = np.diff(begins)
            some = np.flatnonzero(n)
            h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            keys: list = [None] * len(n)
            sketch: list = [None] * len(n)
            if some.size:
                digests, own, small = signatures(sets, np.append(begins[some], begins[-1]))
                h1[some], h2[some] = digests[:, 0].view(np.int64), digests[:, 1].view(np.int64)
                for row, k, s in zip(some, own.view(np.int64), small):
                    keys[row], sketch[row] = k, s.tobytes()
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1, mask=empty), pa.array(h2, mask=empty), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "xh", "n_shingles", "h1", "h2", "keys", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("xh")).mapInArrow(releasing(run), f"doc_id {kind}, xh long, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary")


def by_group(rows: DataFrame, key: str, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(arrays of the columns)`` for each run of equal keys, streamed from sorted partitions.

    Groups must be small; the key decides the partition.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column(key).to_numpy()
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            own = [table.column(c).combine_chunks() for c in columns]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                found = run(*(c.slice(a, b - a) for c in own))
                if found is not None and found.num_rows:
                    yield found

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            keys = table.column(key).to_numpy()
            last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
            yield from out(table.slice(0, last)) if last else ()
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from out(held)

    return rows.select(key, *columns).repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(releasing(stream), schema)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal sketch values of all pairs, a row of a at a time."""
    return np.stack([(b == row).mean(1) for row in a]) if len(a) else np.zeros((0, len(b)))


def _forest(ids: pa.Array, sketches: pa.Array) -> pa.RecordBatch | None:
    """The closest pairs that connect all members whose sketches come near the threshold."""
    names = ids.to_numpy()
    order = np.argsort(names, kind="stable")
    names, small = names[order], np.frombuffer(b"".join(sketches.take(pa.array(order)).to_pylist()), np.uint8).reshape(len(names), -1)
    share = _agreement(small, small)
    i, j = np.nonzero(np.triu(share >= SKETCH_LEAST, 1))
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    xs, ys, left = [], [], len(names) - 1
    for k in np.argsort(-share[i, j], kind="stable"):
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[b] = a
            xs.append(names[i[k]])
            ys.append(names[j[k]])
            left -= 1
            if not left:
                break
    return _pairs(xs, ys)


def _pairs(xs, ys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])


def _linked(ids: pa.Array, parts: pa.Array, sides: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """Links between side 0 and side 1 (side 2 is both) across components, on full sets: one of each row with each component.

    """
    names, part, side = ids.to_numpy(), parts.to_numpy(), sides.to_numpy()
    sets, at = shingle_sets(texts)
    size = np.diff(at)
    if len(np.unique(part)) < 2 or not (side != 0).any() or not (side != 1).any():
        return None
    # Postings: which of side 0 hold each shingle. A row's shared counts are those of its shingles' postings.
    other = np.flatnonzero((side != 1) & (size > 0))
    flat = np.concatenate([sets[at[y] : at[y + 1]] for y in other] or [sets[:0]])
    owner = np.repeat(np.arange(other.size), size[other])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    xs, ys = [], []
    for x in np.flatnonzero((side != 0) & (size > 0)):
        own = sets[at[x] : at[x + 1]]
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        if not n.any():
            continue
        hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(hits, minlength=other.size)
        near = (part[other] != part[x]) & (shared > 0) & (100 * shared >= PERCENT * (size[other] + size[x] - shared))
        found = other[near]
        first = found[np.unique(part[found], return_index=True)[1]]
        xs += [min(names[x], names[y]) for y in first]
        ys += [max(names[x], names[y]) for y in first]
    return _pairs(xs, ys)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough. ``pairs`` should be a written table.

    The joins are sort-merge joins at any size: pairs grow with the corpus, and hot ends can be split.
    """
    x = docs.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text")).hint("merge")
    y = docs.select(F.col("doc_id").alias("y"), F.col("text").alias("y_text")).hint("merge")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "x_text", "y_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, a_at = shingle_sets(batch.column(2))
            b, b_at = shingle_sets(batch.column(3))
            ok = []
            for r in range(batch.num_rows):
                one, two = a[a_at[r] : a_at[r + 1]], b[b_at[r] : b_at[r + 1]]
                shared = np.intersect1d(one, two, assume_unique=True).size
                ok.append(shared > 0 and 100 * shared >= percent * (one.size + two.size - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(releasing(run), "x long, y long").distinct()


def _blocks(shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(shingles / BLOCK_SHINGLES).cast("int"))


def _against_components(outside: DataFrame, found: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, doc_id, part, side): each outsider with all members of the component it met, block against block."""
    met = outside.select("doc_id", "part", "top", "w").distinct()
    wanted = met.groupBy("top").agg(F.sum("w").alias("xs"))
    own = found.select(F.col("component").alias("top"), F.col("node").alias("doc_id")).unionByName(wanted.select("top", F.col("top").alias("doc_id"))).distinct()
    own = stash(own.join(stash(wanted, "wanted"), "top").join(weights, "doc_id"), "own")
    sizes = stash(own.groupBy("top").agg(F.sum("w").alias("m"), F.max("xs").alias("xs")), "sizes")
    block, split = F.pmod(F.xxhash64("doc_id"), _blocks(F.col("m"))), F.pmod(F.xxhash64("doc_id"), _blocks(F.col("xs")))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), _blocks(n) - 1))

    inner = own.drop("xs", "w").join(sizes, "top").select("top", "doc_id", F.col("top").alias("part"), F.lit(0).alias("side"), block.cast("int").alias("b"), every(F.col("xs")).alias("q"))
    outer = met.join(sizes, "top").select("top", "doc_id", "part", F.lit(1).alias("side"), every(F.col("m")).alias("b"), split.cast("int").alias("q"))
    return inner.unionByName(outer).select(F.xxhash64(F.lit("c"), "top", "b", "q").alias("group"), "doc_id", "part", "side")


def _among_outsiders(outside: DataFrame) -> DataFrame:
    """(group, doc_id, part, side): the outsiders of each bucket with each other, block against block; equal sets of outsiders once."""
    sums = outside.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.bit_xor(F.xxhash64("doc_id")).alias("all"), F.min("part").alias("a"), F.max("part").alias("b"))
    sums = sums.where("a < b").groupBy("n", "w", "all").agg(F.min("bucket").alias("bucket"))
    blocks = stash(sums.select("bucket", _blocks(F.col("w")).alias("blocks")), "sums")
    rows = outside.select("bucket", "doc_id", "part").join(blocks, "bucket")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    return rows.select(F.xxhash64(F.lit("b"), "bucket", F.least("b", "o"), F.greatest("b", "o")).alias("group"), "doc_id", "part", side.alias("side"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(sign(docs), "signed")
    usable = signed.where(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
    classes = stash(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"])
    least = F.struct("h1", "h2", "xh")
    reps = stash(reps.groupBy("doc_id").agg(*(F.min_by(c, least).alias(c) for c in ("xh", "n_shingles", "keys", "sketch"))), "reps")

    # Half keys that two documents share, and per document which of its own are.
    halves = reps.select("doc_id", F.posexplode("keys").alias("i", "key"))
    shared = stash(halves.groupBy("i", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("i", "key"), "shared")
    mask = halves.join(shared, ["i", "key"]).groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    low = (1 << SIDE) - 1
    mask = mask.where((F.col("mask").bitwiseAND(F.lit(low)) > 0) & (F.col("mask") > low))
    holders = stash(reps.join(mask, "doc_id"), "holders")

    def own(first: int):
        return F.filter(F.sequence(F.lit(first), F.lit(first + SIDE - 1)), lambda i: F.getbit("mask", i) == 1)

    tensor = holders.select("doc_id", "keys", F.explode(own(0)).alias("i"), own(SIDE).alias("others")).select(
        "doc_id", "i", F.element_at("keys", F.col("i") + 1).alias("one"), "keys", F.explode("others").alias("j")
    ).select("doc_id", F.xxhash64("i", "one", "j", F.element_at("keys", F.col("j") + 1)).alias("bucket"))
    sums = tensor.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.bit_xor(F.xxhash64("doc_id")).alias("all"))
    buckets = stash(sums.where("n > 1").groupBy("n", "x", "y", "all").agg(F.min("bucket").alias("bucket")), "buckets")

    # The texts of documents that may have a partner, written once: all checks on full sets read these only.
    named = docs.withColumn("xh", F.xxhash64("text")).join(holders.select("doc_id", "xh").hint("merge"), ["doc_id", "xh"], "left_semi")
    held = stash(named.dropDuplicates(["doc_id", "xh"]).drop("xh"), "held")

    wide = buckets.where("n > 2").select("bucket", "n")
    members = stash(tensor.join(wide, "bucket").select("bucket", "n", "doc_id"), "members")
    sketched = members.join(reps.select("doc_id", "sketch"), "doc_id")
    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id", "bucket"), blocks).cast("int")
    forest = by_group(sketched.withColumn("group", F.xxhash64("bucket", block)), "group", ["doc_id", "sketch"], _forest, "x long, y long")
    pairs = stash(buckets.where("n = 2").select("x", "y").unionByName(forest).distinct(), "pairs")
    links = stash(confirm(pairs, held), "links")
    found = stash(components(links, "x", "y"), "found")

    # Buckets that still hold several components. Their largest one is named by each outsider once, however many
    # buckets they share, and the outsider is compared with all its members; outsiders of a bucket are compared with each other.
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    placed = stash(placed.select("bucket", "n", "doc_id", "part"), "placed")
    shares = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("c", "part")).alias("top"), F.max("n").alias("n")).where("top.c < n")
    mixed = stash(mixed.select("bucket", F.col("top.part").alias("top")), "mixed")
    weights = reps.select("doc_id", F.col("n_shingles").alias("w"))
    outside = stash(placed.join(mixed, "bucket").where("part != top").join(weights, "doc_id").select("bucket", "top", "doc_id", "part", "w"), "outside")
    rows = _against_components(outside, found, weights).unionByName(_among_outsiders(outside))
    texts = stash(rows, "late").join(held.hint("merge"), "doc_id")
    more = stash(by_group(texts, "group", ["doc_id", "part", "side", "text"], _linked, "x long, y long").distinct(), "more")
    final = found if more.isEmpty() else stash(components(links.unionByName(more), "x", "y"), "final")
    known = stash(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "known")
    for old in (reps, shared, holders, buckets, members, placed, mixed, outside, held):
        discard(old)
    return signed.select("doc_id", "n_shingles", "h1", "h2").join(known, ["h1", "h2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
