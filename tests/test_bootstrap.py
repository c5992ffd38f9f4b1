import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import bootstrap as B
from glossa.operators import fluency
from tests.test_metrics import frame


def stats(spark, base, tuned, refs):
    sides = [fluency.with_bleu_stats(frame(spark, h, refs)).select(F.col("id").cast("string").alias("id"), F.col("stats").alias(k)) for k, h in (("base", base), ("tuned", tuned))]
    return sides[0].join(sides[1], "id")


def lines(rng, n):
    return [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14))) for _ in range(n)]


def by_hand(rows, draws, seed, block):
    """Sums of each sample, draw by draw."""
    import hashlib

    k = -(-len(rows) // block) or 1
    blocks = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        blocks.setdefault(int(hashlib.md5(r["id"].encode()).hexdigest()[:8], 16) % k, []).append(r)
    of = [b for b in sorted(blocks) for _ in blocks[b]]
    out = {}
    for sample in range(draws):
        made, sums = {}, [0] * (2 * B.WIDTH)
        for j in range(len(rows)):
            at = np.array([j], np.uint64)
            b = of[((int(B.draw(seed, 0, sample, at)[0]) << 32) | int(B.draw(seed, 1, sample, at)[0])) % len(rows)]
            i = made[b] = made.get(b, -1) + 1
            r = blocks[b][int(B.draw(seed, 2 + b, sample, np.array([i], np.uint64))[0]) % len(blocks[b])]
            sums = [x + y for x, y in zip(sums, [*r["base"], *r["tuned"]])]
        out[sample] = sums
    return out


@pytest.mark.parametrize("block", [7, 16384])
def test_samples_equal_draws_one_by_one(spark, block):
    rng = random.Random(3)
    refs = lines(rng, 40)
    s = stats(spark, lines(rng, 40), [r[: len(r) // 2] for r in refs], refs)
    rows = s.collect()
    got = {r["sample"]: [*r["base"], *r["tuned"]] for r in B.resampled(s, 6, 42, block).collect()}
    assert got == by_hand(rows, 6, 42, block)


def test_unequal_systems(spark):
    rng = random.Random(5)
    refs = lines(rng, 60)
    good = [r if i % 3 else x for i, (r, x) in enumerate(zip(refs, lines(rng, 60)))]
    r = B.paired_bootstrap(stats(spark, lines(rng, 60), good, refs), draws=400, block=16).first()
    assert 0 < r.ci_low < r.delta < r.ci_high and r.n_segments == 60
    whole = [fluency.corpus_bleu(frame(spark, h, refs)).first().bleu for h in (good,)]
    assert r.delta < whole[0]


def test_equal_systems_one_draw_and_none(spark):
    s = stats(spark, ["a b c d e"] * 6, ["a b c d e"] * 6, ["a b c d f"] * 6)
    assert tuple(B.paired_bootstrap(s, draws=50).first()) == (0, 0, 0, 6)
    assert tuple(B.paired_bootstrap(s, draws=1).first()) == (0, 0, 0, 6)
    none = B.paired_bootstrap(s.limit(0), draws=50).first()
    assert none.n_segments == 0 and all(map(math.isnan, none[:3]))
    gaps = s.withColumn("tuned", F.when(F.col("id") != "2", F.col("tuned")))
    assert B.paired_bootstrap(gaps, draws=50).first().n_segments == 5


def test_draws_are_even_and_equal_in_sql():
    picked = np.concatenate([B.draw(42, 2, b, np.arange(500, dtype=np.uint64)) % np.uint64(50) for b in range(200)]).astype(int)
    counts = np.bincount(picked, minlength=50)
    assert ((counts - 2000) ** 2 / 2000).sum() < 100  # chi square of 49 degrees: 100 has a chance of 1 in 50,000
    rows = duckdb.sql(B.draw_sql("SELECT b, j FROM range(3) x(b), range(5) y(j)", "h", 42, "2 + 7", "b", "j")).fetchall()
    assert all(h == int(B.draw(42, 9, b, np.array([j], np.uint64))[0]) for b, j, h in rows) and len(rows) == 15


def test_labels_with_gaps_are_left_out(spark):
    segments = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, ref string")
    base = spark.createDataFrame([("s1", "1", "a"), ("s1", "2", "b"), ("s2", "1", "c"), ("s2", "2", "d"), ("s2", "9", "e")], "label string, id string, hyp string")
    tuned = base.where("not (label = 's1' and id = '2')")
    assert sorted(map(tuple, B.covered(segments, base, tuned).collect())) == [("s2", "1", "x", "c", "c"), ("s2", "2", "y", "d", "d")]
