import math
import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import fluency, stats
from glossa.operators import terminology as M


def frame(spark, hyps, refs, docs=None):
    rows = [(i, h, r, (docs or [0] * len(hyps))[i]) for i, (h, r) in enumerate(zip(hyps, refs))]
    return spark.createDataFrame(rows, "id int, hyp string, ref string, doc int")


def plain_bleu(hyps, refs):
    from collections import Counter

    match, total, a, b = [0] * 4, [0] * 4, 0, 0
    for h, r in zip(hyps, refs):
        h, r = h.split(), r.split()
        a, b = a + len(h), b + len(r)
        for n in range(1, 5):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
            match[n - 1] += sum((x & y).values())
            total[n - 1] += max(len(h) - n + 1, 0)
    if not any(match) or not all(total):
        return 0.0
    smooth, logs = 1, 0.0
    for m, t in zip(match, total):
        if not m:
            smooth *= 2
        logs += math.log(100 * m / t if m else 100 / (smooth * t))
    return math.exp(logs / 4) * (1 if a >= b else math.exp(1 - b / a))


def test_bleu(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    others = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    assert fluency.corpus_bleu(frame(spark, lines, others)).first().bleu == pytest.approx(plain_bleu(lines, others))
    assert fluency.corpus_bleu(frame(spark, ["the cat sat on the mat"], ["the cat sat on the mat"])).first().bleu == pytest.approx(100)
    docs = [i % 3 for i in range(40)]
    by_doc = [plain_bleu([x for x, d in zip(lines, docs) if d == k], [x for x, d in zip(others, docs) if d == k]) for k in range(3)]
    assert fluency.macro(fluency.corpus_bleu(frame(spark, lines, others, docs), "doc"), "bleu").first().bleu == pytest.approx(sum(by_doc) / 3)
    assert math.isnan(fluency.macro(fluency.corpus_bleu(frame(spark, lines, others).limit(0), "doc"), "bleu").first().bleu)


def test_tokens(spark):
    row = spark.createDataFrame([('Say "hi", to-day: 3.5 &amp; 1,000 costs 2-3.\n',)], "t string").select(fluency.tokens_13a(F.col("t")).alias("x")).first().x
    assert row == ["Say", '"', "hi", '"', ",", "to-day", ":", "3.5", "&", "1,000", "costs", "2", "-", "3", "."]


def plain_counts(h, r):
    from collections import Counter

    row = [len(h), len(r)]
    for n in range(1, 5):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
        row += [sum((x & y).values()), max(len(h) - n + 1, 0)]
    return row


def test_bleu_counts_equal_the_tokens(spark, monkeypatch):
    rng = random.Random(4)
    signs = list("ab 12.,-.,- ") + [".", ",", "\n", "-\n", "&amp;", "lt;", "&quot;", "<skipped>", "é", "日", "\u00a0", "\u0085", "\t", "\x0b", "$", "'", "(", "/", "\\", "`"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a b " * 4000, "", None, "x.,1", "1,,,2", "1.2", "5-6", ".5"]
    rows = [(t, rng.choice([t, rng.choice(texts)])) for t in texts]
    df = spark.createDataFrame(rows, "hyp string, ref string")
    got = fluency.with_bleu_stats(df).select("stats", *[fluency.tokens_13a(F.coalesce(c, F.lit(""))).alias(c) for c in ("hyp", "ref")]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.stats == plain_counts(r.hyp, r.ref)
    assert fluency.with_bleu_stats(df.limit(0)).collect() == []


def test_bleu_takes_large_batches_in_parts(monkeypatch):
    import pyarrow as pa

    taken = []
    whole = fluency._counted
    monkeypatch.setattr(fluency, "_counted", lambda h, r: taken.append(len(h)) or whole(h, r))
    monkeypatch.setattr(fluency, "COUNTED", 1000)
    texts = pa.array(["a b c", "d " * 900, *["a b"] * 500, ""])
    rows = fluency._bleu_stats.func(texts, texts).to_pylist()
    assert rows[:2] == [plain_counts(x, x) for x in (["a", "b", "c"], ["d"] * 900)] and rows[-1] == [0] * 10 and len(rows) == sum(taken) == 503
    assert max(taken) < 170 and len(taken) > 3


def test_chrf(spark):
    assert fluency.corpus_chrf(frame(spark, ["abc def"], ["abc def"])).first().chrf == pytest.approx(100)
    assert fluency.corpus_chrf(frame(spark, ["xyz"], ["abc"])).first().chrf == 0
    # ab / abc: precision 1 and 1, recall 2/3 and 1/2 over the two orders that both have
    p, r = 1.0, (2 / 3 + 1 / 2) / 2
    assert fluency.corpus_chrf(frame(spark, ["ab"], ["abc"])).first().chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))


SPAN = "id int, word string, grounded boolean, level int, found string, found_level int, score double, ref_score double"


def test_terminology(spark):
    rows = [(1, "a", True, 4, "A", 4, 1.0, 1.0), (1, "a", True, 4, "A", 4, 1.0, 1.0), (1, "b", True, 4, None, None, 0.0, 1.0), (2, "a", True, 4, "B", 5, 0.5, 0.5), (2, "c", False, None, None, None, 0.0, 0.0)]
    s = spark.createDataFrame(rows, SPAN)
    assert M.htm(s).first().htm == pytest.approx(2.5 / 4)
    assert M.htm_reference(s.withColumn("score", F.col("ref_score"))).first().htm == pytest.approx(2.5 / 4)
    assert M.agreement(s).first().agreement == pytest.approx(2 / 3)
    assert M.level_accuracy(s).first().hra == pytest.approx(2 / 3)
    assert tuple(M.missing_rate(s).first()) == (4, 1, 0.25)
    assert [(r.word, r.n, r.renderings, r.drift) for r in M.drift(s).collect()] == [("a", 3, 2, 0.5)]
    assert {r.word: r.modal_rate for r in M.modal_agreement(s).collect()} == {"a": pytest.approx(2 / 3), "b": 1.0}
    assert math.isnan(M.agreement(s.where("not grounded")).first().agreement)


def test_vector_scores(spark):
    chunks = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "key int, pos int, vector array<double>")
    names = spark.createDataFrame([(1, 0, [0.0, 1.0], 1.0), (2, 0, [1.0, 0.0], 1.0)], "key int, pos int, vector array<double>, align double")
    assert {r.key: r.score for r in M.vector_scores(chunks, names, 0.8).collect()} == {1: 0.0, 2: 1.0}


def test_kappa(spark):
    rows = [("human", "human"), ("s1", "s2"), ("s2", "s2"), (None, "s1")]
    r = stats.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    po, pe = 2 / 3, (1 * 1 + 1 * 0 + 1 * 2) / 9
    assert (r.n, r.percent_agreement, r.kappa) == (3, pytest.approx(100 * po), pytest.approx((po - pe) / (1 - pe)))
    assert stats.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first().kappa == 1.0


def test_adjudication(spark):
    rows = [("s1", "s1", "s2", ""), ("s1", "s2", "s1", "tie between S1 or S2"), ("s5", "s2", "s1", "Same applies to S5, as S2"), ("s1", "s2", "s6", ""), ("s1", "s2", "unknown", ""), ("s1", "s2", "", "")]
    out = spark.createDataFrame(rows, "d string, n string, l string, t string").select(stats.adjudicate(F.col("d"), F.col("n"), F.col("l"), F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in out] == [("s1", "consensus"), ("s1", "tie_break_llm"), ("s2", "tie_break_n"), ("s6", "llm_reference"), ("s2", "n_fallback"), ("?", "llm_reference")]


def test_ranks_tallies_and_scaling(spark):
    df = spark.createDataFrame([("a, ,b",), ("b",)], "r string")
    assert {r.system: (r.avg_rank, r.n) for r in stats.average_ranks(df, "r").collect()} == {"A": (1.0, 1), "B": (1.5, 2)}
    votes = spark.createDataFrame([("x",)] * 3 + [(None,)] * 5, "v string")
    assert {r.value: (r.votes, r.pct) for r in stats.tally(votes, F.col("v")).collect()} == {"X": (3, 38), "UNKNOWN": (5, 62)}
    scaled = stats.min_max(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "m double, k double"), ["m", "k"])
    assert sorted(map(tuple, scaled.collect())) == [(0.0, 0.0), (1.0, 0.0)]
