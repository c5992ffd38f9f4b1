"""Paired bootstrap of BLEU differences, by blocks of segments.

Statistics of segments add up, so a resample is a weighted sum of them. Segments fall into blocks of about ``BLOCK`` by digests of
their ids. First each sample's draws are counted per block, then each block draws that many of its own segments and multiplies
their weights with its statistics; what is shuffled is one row of sums per sample and block. All draws are functions of seed,
sample and place, so a task that runs again draws the same, and any engine can draw the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.operators.fluency import ORDERS, bleu_of

BLOCK = 16384
WIDTH = 2 + 2 * ORDERS
#: Shifts and multipliers of the mixing step, and the step between keys.
ROUNDS, STEP = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)), 0x9E3779B9
BITS = 0xFFFFFFFF
#: Samples that are weighed at a time, and draws that are made at a time.
AT_ONCE, CHUNK = 64, 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits, each onto another one."""
    for shift, times in ROUNDS:
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(times)) & np.uint64(BITS)
    return h


def draw(seed: int, salt: int, sample: int, places: np.ndarray) -> np.ndarray:
    """32 bits for each place of a sample. Two keys a sample, so samples whose first keys are close don't draw the same numbers in another order."""
    bits = np.uint64(BITS)
    first = mix(mix(np.array([(seed + salt * STEP) & BITS], np.uint64)) ^ np.uint64(sample))
    second = mix((first + np.uint64(STEP)) & bits)
    return mix((mix(first ^ (places & bits)) + second) & bits)


def mix_sql(rows: str, column: str) -> str:
    """``rows`` with ``column`` mixed, as SQL."""
    for shift, times in ROUNDS:
        rows = f"SELECT * REPLACE ((xor({column}, {column} >> {shift}) * {times}::UBIGINT) & {BITS}::UBIGINT AS {column}) FROM ({rows})"
    return rows


def draw_sql(rows: str, name: str, seed: int, salt: str, sample: str, place: str) -> str:
    """``rows`` with the numbers of :func:`draw` in the column ``name``, as SQL."""
    rows = mix_sql(f"SELECT *, (({seed} + ({salt}) * {STEP}) & {BITS})::UBIGINT AS _k FROM ({rows})", "_k")
    rows = mix_sql(f"SELECT * REPLACE (xor(_k, ({sample})::UBIGINT) AS _k) FROM ({rows})", "_k")
    rows = mix_sql(f"SELECT *, (_k + {STEP}::UBIGINT) & {BITS}::UBIGINT AS _l FROM ({rows})", "_l")
    rows = mix_sql(f"SELECT *, xor(_k, ({place})::UBIGINT & {BITS}::UBIGINT) AS {name} FROM ({rows})", name)
    return mix_sql(f"SELECT * EXCLUDE (_k, _l) REPLACE (({name} + _l) & {BITS}::UBIGINT AS {name}) FROM ({rows})", name)


def _per_block(spark, sizes: list[tuple[int, int]], draws: int, seed: int) -> DataFrame:
    """(block, sample, m): how many of a sample's n draws fall into each block; a block is as likely as it is large."""
    if len(sizes) == 1:
        return spark.range(draws).select(F.lit(sizes[0][0]).cast("long").alias("block"), F.col("id").alias("sample"), F.lit(sizes[0][1]).cast("long").alias("m"))
    names, ends = np.array([b for b, _ in sizes]), np.cumsum([s for _, s in sizes]).astype(np.uint64)
    n = int(ends[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                m = np.zeros(len(ends), np.int64)
                for at in range(0, n, CHUNK):
                    places = np.arange(at, min(at + CHUNK, n), dtype=np.uint64)
                    picked = ((draw(seed, 0, sample, places) << np.uint64(32)) | draw(seed, 1, sample, places)) % np.uint64(n)
                    m += np.bincount(np.searchsorted(ends, picked, side="right"), minlength=len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(ends), sample)), pa.array(m)], names=["block", "sample", "m"])

    # A sample is n draws of work, whatever its bytes: one task each.
    return spark.range(0, draws, 1, draws).mapInArrow(count, "block long, sample long, m long")


def resampled(stats: DataFrame, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(sample, base, tuned): sums of the statistics of as many draws with replacement as there are segments.

    ``stats`` has (id, base, tuned) with distinct ids, at most 2^32 of them. The driver holds one size per block.
    """
    spark = stats.sparkSession
    n = stats.count()
    if n > BITS + 1:
        raise ValueError(f"{n} segments; places of draws have 32 bits")
    blocks = -(-n // block) or 1
    mark = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % blocks
    own = stats.select(mark.alias("block"), "id", "base", "tuned")
    sizes = sorted((r["block"], r["count"]) for r in own.groupBy("block").count().collect())
    if not sizes:
        return spark.createDataFrame([], "sample long, base array<long>, tuned array<long>")
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1)

    def weigh(segments: pa.Table, counts: pa.Table) -> pa.Table:
        size = segments.num_rows
        order = np.argsort(segments.column("place").to_numpy())
        facts = np.concatenate([segments.column(k).combine_chunks().flatten().to_numpy().reshape(size, WIDTH) for k in ("base", "tuned")], axis=1)[order].astype(np.float64)
        of, samples, m = (counts.column(k).to_numpy() for k in ("block", "sample", "m"))
        sums = np.empty((len(samples), 2 * WIDTH))
        for at in range(0, len(samples), AT_ONCE):
            weights = np.empty((min(AT_ONCE, len(samples) - at), size))
            for i in range(len(weights)):
                places = np.arange(m[at + i], dtype=np.uint64)
                weights[i] = np.bincount((draw(seed, 2 + int(of[at + i]), int(samples[at + i]), places) % np.uint64(size)).astype(np.int64), minlength=size)
            sums[at : at + len(weights)] = weights @ facts  # whole numbers below 2^53
        return pa.table({"sample": samples, "sums": pa.array(list(sums.astype(np.int64)), pa.list_(pa.int64()))})

    parts = placed.groupBy("block").cogroup(_per_block(spark, sizes, draws, seed).groupBy("block")).applyInArrow(weigh, "sample long, sums array<long>")
    whole = parts.groupBy("sample").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * WIDTH)])
    return whole.select("sample", *[F.array(*[f"s{i + at}" for i in range(WIDTH)]).alias(k) for k, at in (("base", 0), ("tuned", WIDTH))])


def _delta() -> Column:
    tuned, base = ([F.col(k)[i] for i in range(WIDTH)] for k in ("tuned", "base"))
    return bleu_of(tuned) - bleu_of(base)


def paired_bootstrap(stats: DataFrame, draws: int = 2000, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(delta, ci_low, ci_high, n_segments): BLEU of ``tuned`` minus that of ``base``, and the bounds of 95 % by rank; NaN without segments.

    ``stats`` has (id, base, tuned), the statistics of each segment under both systems. Rows without one of them are left out.
    """
    stats = stats.where("base is not null and tuned is not null").persist()  # four passes over a few numbers a segment; texts are scored once
    deltas = resampled(stats, draws, seed, block).select(_delta().alias("d"))
    ranked = deltas.agg(F.sort_array(F.collect_list("d")).alias("d"))  # as many values as draws
    at = [F.coalesce(F.try_element_at("d", F.lit(i)), F.lit(float("nan"))) for i in (int(0.025 * draws) + 1, max(1, int(0.975 * draws)))]
    bounds = ranked.select(at[0].alias("ci_low"), at[1].alias("ci_high"))
    sums = [F.array(*[F.sum(F.col(k)[i]) for i in range(WIDTH)]).alias(k) for k in ("base", "tuned")]
    whole = stats.agg(F.count(F.lit(1)).alias("n_segments"), *sums)
    point = whole.select(F.when(F.col("n_segments") > 0, _delta()).otherwise(float("nan")).alias("delta"), "n_segments")
    return point.crossJoin(bounds).select("delta", "ci_low", "ci_high", "n_segments")  # two tables of one row


def covered(segments: DataFrame, base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(label, id, ref, base_hyp, tuned_hyp) of the labels of which both systems, (label, id, hyp), have every segment (id, ref).

    A label with a gap on either side is left out whole, as its difference would be one of other segments.
    """
    own = segments.select("id", "ref")
    sides = [s.join(own.select("id"), "id", "left_semi").select("label", "id", F.col("hyp").alias(f"{k}_hyp")).dropDuplicates(["label", "id"]) for k, s in (("base", base), ("tuned", tuned))]
    both = sides[0].join(sides[1], ["label", "id"])
    full = both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(own.agg(F.countDistinct("id").alias("all"))))  # one row
    return both.join(full.where(F.col("n") == F.col("all")).select("label"), "label").join(own, "id").select("label", "id", "ref", "base_hyp", "tuned_hyp")
