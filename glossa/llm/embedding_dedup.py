"""Near-duplicate vectors by NN-descent.

Vectors are compared within their label. Exact copies are one class from the start. The neighbour graph begins with
the nearest vectors in leaves of random sign patterns (large leaves, as a hot label or a pile of near copies makes
them, are split at random); each round joins every vector's neighbours and reverse neighbours
with each other and keeps the better ones. A list that holds nothing but links is *saturated*: it doubles for the next round
and keeps a random choice of its links, not the nearest, so that piles of near copies hang together as one. When the links no longer change,
connected components are taken and all links within each are counted exactly, block against block, without
writing pairs out: a link can't lead out of its component. At last the recall is audited: every vector whose id is
divisible by 50 is compared with all rows, in blocks. The links that are missing join the graph; if they are too many, rounds with
new leaves follow, whose audit takes other ids, as the links of these are known by then. A last audit that still misses too many is an error.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without a label or id link
with nothing; vectors of different lengths are never compared; repeated rows are copies; of rows that share an id but not the vector or
label, the one of least digest stands for the id; cosine is taken in double
precision; an empty table gives an empty table. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.llm.common import discard, draw, prepare, stash
from glossa.llm.components import components
from glossa.llm.minhash_dedup import by_group

COSINE = 0.98
#: First length of a neighbour list; members of a leaf; tables of leaves.
NEIGHBOURS, LEAF, TABLES = 8, 40, 4
#: Rounds of neighbour joins at most, and at most so many starts with new leaves.
ROUNDS, STARTS = 4, 3
#: One in so many vectors is audited, by id; and the recall that the audit asks for.
AUDIT, RECALL = 50, 0.999
#: Audited vectors that are compared with all rows at once.
AUDIT_BLOCK = 16_384
#: Members of a block of a component, and of those that are multiplied at once. A component of m vectors ships each ceil(m / BLOCK) times.
BLOCK, STEP = 4096, 256

_PAIR = "a long, b long, rank double"


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _rank(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, least: float) -> np.ndarray:
    """What lists are ordered by: the cosine, but links stand above it in an order that is random and fixed."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(cosine >= least, 2.0 + (x >> np.uint64(11)).astype(np.float64) / (1 << 53), cosine)


def _found(names: np.ndarray, cosine: np.ndarray, floor: np.ndarray, take: int, least: float) -> pa.RecordBatch:
    """Of each row, the best so many columns above its floor."""
    np.fill_diagonal(cosine, -2.0)
    a = np.broadcast_to(names[:, None], cosine.shape)
    b = np.broadcast_to(names[None, :], cosine.shape)
    rank = _rank(a, b, cosine, least)
    rank[cosine < -1.5] = -2.0
    take = min(take, len(names) - 1)
    best = np.argpartition(-rank, take - 1, axis=1)[:, :take] if take else np.zeros((len(names), 0), int)
    value = np.take_along_axis(rank, best, 1)
    i, j = np.nonzero(value > floor[:, None])
    return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[best[i, j]]), pa.array(value[i, j])], names=["a", "b", "rank"])


def _leaves(nodes: DataFrame, start: int) -> DataFrame:
    """(group, id, v): each vector in one leaf of each table."""
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1)
            lengths = vectors.value_lengths().to_numpy()
            bits = np.zeros((batch.num_rows, TABLES), np.int64)
            for size in np.unique(lengths):
                if size not in planes:
                    planes[size] = np.random.default_rng([start, int(size)]).normal(size=(int(size), TABLES * 24))
                own = np.flatnonzero(lengths == size)
                signs = _matrix(vectors.take(pa.array(own))) @ planes[size] > 0
                bits[own] = (signs.reshape(len(own), TABLES, 24) << np.arange(24)).sum(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.tolist(), pa.list_(pa.int64()))], names=["id", "bits"])

    signed = nodes.select("id", "v").mapInArrow(run, "id long, bits array<long>")
    sizes = stash(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    sized = nodes.select("id", "label", "dim").join(sizes, ["label", "dim"])
    keep = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("n") / LEAF)).cast("int")))
    leaf = sized.select("id", "label", "dim", keep.alias("keep")).join(signed, "id").select("id", "label", "dim", "keep", F.posexplode("bits").alias("table", "sign"))
    leaf = stash(leaf.select("id", F.xxhash64("label", "dim", "table", F.expr("sign & (shiftleft(1L, keep) - 1)")).alias("leaf"), "table"), "leaves")
    count = stash(leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
    parts = F.ceil(F.col("n") / (2 * LEAF))
    split = leaf.join(count, "leaf").select("id", F.xxhash64("leaf", F.pmod(F.xxhash64("id", "table"), parts)).alias("group"))
    return split.join(nodes.select("id", "v"), "id")


def _lists(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, label, dim, v, n, k) with their lists after merging pairs into the old ones."""
    best = pairs.groupBy("a", "b").agg(F.max("rank").alias("rank"))
    best = best.join(nodes.select(F.col("id").alias("a"), "k"), "a")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("rank"), "b"))
    best = best.withColumn("place", place).where(F.col("place") <= F.col("k"))
    lists = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "b")), False).alias("near"))
    return nodes.drop("near", "floor").join(lists.withColumnRenamed("a", "id"), "id", "left").withColumn(
        "floor", F.when(F.size("near") >= F.col("k"), F.element_at("near", -1)["rank"]).otherwise(F.lit(-1.5))
    )


def _pairs_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("a"), F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.rank").alias("rank"))


def _joined(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs of neighbours of neighbours that improve a list."""
    forward = _pairs_of(nodes).select("a", "b")
    back = forward.select(F.col("b").alias("a"), F.col("a").alias("b"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
    back = back.withColumn("place", place).where(F.col("place") <= 2 * NEIGHBOURS).drop("place")
    around = forward.unionByName(back).unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    rows = around.join(nodes.select(F.col("id").alias("b"), "v", "floor"), "b").select(F.col("a").alias("group"), F.col("b").alias("id"), "v", "floor")

    def run(ids: pa.Array, vectors: pa.Array, floors: pa.Array) -> pa.RecordBatch | None:
        if len(ids) < 3:
            return None
        unit = _matrix(vectors)
        return _found(ids.to_numpy(), unit @ unit.T, floors.to_numpy(), 2 * NEIGHBOURS, least)

    return by_group(rows, "group", ["id", "v", "floor"], run, _PAIR)


def _count_links(members: DataFrame, least: float) -> DataFrame:
    """(id, n): for (id, component, v, n), how many others of its component are linked to each."""
    sizes = stash(members.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component-sizes")
    rows = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.withColumn("side", side).withColumn("group", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))

    def run(ids: pa.Array, sides: pa.Array, counts: pa.Array, vectors: pa.Array) -> pa.RecordBatch | None:
        unit, side, weight, names = _matrix(vectors), sides.to_numpy(), counts.to_numpy(), ids.to_numpy()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not one.size or not two.size:
            return None
        ones, twos = np.zeros(one.size, np.int64), np.zeros(two.size, np.int64)
        for begin in range(0, one.size, STEP):
            near = unit[one[begin : begin + STEP]] @ unit[two].T >= least
            ones[begin : begin + STEP] = near @ weight[two]
            twos += weight[one[begin : begin + STEP]] @ near
        if side[one[0]] == 2:  # a block with itself: each is not its own partner, whatever rounding says
            itself = np.einsum("ij,ij->i", unit, unit) >= least
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ones - itself * weight)], names=["id", "n"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[one], names[two]])), pa.array(np.concatenate([ones, twos]))], names=["id", "n"])

    return by_group(rows, "group", ["id", "side", "n", "v"], run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _audit(nodes: DataFrame, linked: DataFrame, start: int, least: float) -> DataFrame:
    """(a, b, links, known): counts of the true links of one in ``AUDIT`` vectors, and of those within a component; and missing links (a, b).

    Of a vector's missing links to one component each batch names one, which joins the two; so a split pile is no square of rows.
    """
    spark = nodes.sparkSession
    rows = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", "label", "dim", "v", F.coalesce("component", "id").alias("component"))
    rows = stash(rows, "audited")
    drawn = rows.where(F.pmod("id", F.lit(AUDIT)) == start)
    blocks = -(-drawn.count() // AUDIT_BLOCK)
    found = None
    for block in range(blocks):
        sample: dict[tuple, list] = {}
        for r in drawn.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect():
            sample.setdefault((r.label, r.dim), []).append(r)
        shipped = spark.sparkContext.broadcast(
            {k: (np.array([r.id for r in own]), np.array([r.component for r in own]), _matrix(pa.array([r.v for r in own], pa.list_(pa.float64())))) for k, own in sample.items()}
        )

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                for key in set(keys) & shipped.value.keys():
                    own = np.array([i for i, k in enumerate(keys) if k == key])
                    names, within, unit = shipped.value[key]
                    ids, others = batch.column(0).to_numpy()[own], batch.column(4).to_numpy()[own]
                    i, j = np.nonzero(unit @ _matrix(batch.column(3).take(pa.array(own))).T >= least)
                    i, j = i[names[i] != ids[j]], j[names[i] != ids[j]]
                    lost = within[i] != others[j]
                    one = np.unique(np.stack([i[lost], others[j[lost]]]), axis=1, return_index=True)[1]
                    a, b = names[i[lost][one]].tolist(), ids[j[lost][one]].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None, *a], pa.int64()), pa.array([None, *b], pa.int64()), pa.array([len(i)] + [0] * len(a), pa.int64()), pa.array([len(i) - int(lost.sum())] + [0] * len(a), pa.int64())],
                        names=["a", "b", "links", "known"],
                    )

        part = rows.mapInArrow(run, "a long, b long, links long, known long")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "a long, b long, links long, known long") if found is None else found


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.when(usable, F.col("embedding")).alias("v"),
        F.when(usable, F.xxhash64(F.lit(1), "embedding")).alias("h1"), F.when(usable, F.xxhash64(F.lit(2), "embedding")).alias("h2"),
    )
    narrow = rows.select("vec_id", "label", "h1", "h2")
    classes = stash(narrow.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    main = classes.groupBy("id").agg(F.min(F.struct("h1", "h2", "label")).alias("of"), F.min_by("n", F.struct("h1", "h2", "label")).alias("n"))
    main = main.select(F.col("id").alias("vec_id"), "of.*", "n")
    nodes = rows.where("h1 is not null").join(main, ["label", "h1", "h2", "vec_id"]).dropDuplicates(["vec_id"])
    nodes = stash(nodes.select(F.col("vec_id").alias("id"), "label", F.size("v").alias("dim"), "v", "n", F.lit(NEIGHBOURS).alias("k")), "nodes")

    def near_in_leaf(ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch | None:
        if len(ids) < 2:
            return None
        unit = _matrix(vectors)
        return _found(ids.to_numpy(), unit @ unit.T, np.full(len(ids), -1.5), NEIGHBOURS, least)

    extra, lists = None, nodes
    for start in range(STARTS):
        pairs = by_group(_leaves(nodes, start), "group", ["id", "v"], near_in_leaf, _PAIR)
        if start:
            pairs = pairs.unionByName(_pairs_of(lists))
        lists = stash(_lists(pairs, lists.select("id", "label", "dim", "v", "n", "k")), "lists")
        mark = None
        for _ in range(ROUNDS):
            state = lists.select(F.size(F.filter("near", lambda x: x["rank"] >= 2.0)).alias("links"), "k", "floor").agg(
                F.sum(F.greatest("links", F.lit(0))), F.sum(F.when(F.col("floor") >= 2.0, 1).otherwise(0))
            ).first()
            if state == mark or not state[0] and mark is not None:
                break
            mark = state
            grown = lists.withColumn("k", F.when(F.col("floor") >= 2.0, 2 * F.col("k")).otherwise(F.col("k")))
            better = stash(_joined(grown, least), "better")
            fresh = stash(_lists(better.unionByName(_pairs_of(lists)), grown), "lists")
            discard(better)
            discard(lists)
            lists = fresh
        links = _pairs_of(lists).where("rank >= 2.0").select("a", "b")
        links = links if extra is None else links.unionByName(extra)
        linked = stash(components(links), "linked")
        truth = stash(_audit(nodes, linked, start, least), "audit")
        seen, known, lost = truth.agg(F.sum("links"), F.sum("known"), F.count("a")).first()
        missing = truth.where("a is not null").select("a", "b")
        extra = missing if extra is None else extra.unionByName(missing)
        if not seen or known >= RECALL * seen:
            break
    else:
        raise RuntimeError(f"after {STARTS} starts {known} of {seen} audited links are found; {RECALL} of them are asked for")
    if lost:
        linked = stash(components(links.unionByName(missing)), "linked")
    members = nodes.select("id", "v", "n").join(linked.withColumnRenamed("node", "id"), "id")
    counted = stash(_count_links(members, least), "counted")
    done = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").join(counted.withColumnRenamed("n", "others"), "id", "left")
    done = stash(done.select("label", "h1", "h2", F.coalesce("component", "id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")), "done")
    discard(lists)
    return narrow.join(done, ["label", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
