import itertools
import random

import pytest

from glossa.llm import source_mix as M


def test_targets_reshare_the_excess():
    t = M.weighted_targets({"a": 100, "b": 100, "c": 10, None: 100})
    assert t["c"] == 30 and abs(sum(t.values()) - 310) < 1e-9
    assert t["b"] == pytest.approx(2 * t["a"]) and t[None] == pytest.approx(t["a"])
    assert M.weighted_targets({}) == {}
    assert M.weighted_targets({"a": 0}) == {"a": 0.0}


def brute(patterns, targets, repeats):
    """The least convex cost of the largest flow, by trying every whole flow of a tiny case."""
    arcs = [(p, s) for p in patterns for s in p]
    best = None
    for flow in itertools.product(*[range(repeats * patterns[p] + 1) for p, _ in arcs]):
        own = dict.fromkeys(patterns, 0)
        got = dict.fromkeys(targets, 0)
        for (p, s), x in zip(arcs, flow):
            own[p] += x
            got[s] += x
        if any(got[s] > targets[s] for s in targets) or any(own[p] > repeats * patterns[p] for p in patterns):
            continue
        cost = sum(k for p, x in own.items() for k in [sum(i // patterns[p] for i in range(x))])
        best = min(best, (-sum(flow), cost)) if best else (-sum(flow), cost)
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(5)
    for _ in range(12):
        patterns = {("a",): rng.randint(1, 2), ("a", "b"): rng.randint(1, 2), ("b",): 1}
        targets = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
        routed = M.route(patterns, targets, 3)
        own = {p: sum(x for _, x in r) for p, r in routed.items()}
        cost = sum(i // patterns[p] for p, x in own.items() for i in range(x))
        assert (-sum(own.values()), cost) == brute(patterns, targets, 3)


def test_operator_meets_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(2000)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, " \t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    def run(d):
        return sorted(map(tuple, M.mix(d, F.array("source")).select("doc_id", "size", "source_size", "target", "taken", "source").collect()))

    first, again = run(docs), run(docs.repartition(7))
    assert first == again and len(first) == len(rows)
    for s in ("a", "b", "c", None):
        own = [r for r in first if r[5] == s]
        assert own[0][2] == sum(r[1] for r in own)
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 9
    assert all(r[4] <= 3 * r[1] for r in first)
    assert [r[4] for r in first if r[0] >= 5000] == [0, 0, 0]


def test_overlapping_sources_and_edges(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w w w", ["a", "b"] if i % 2 else ["b"]) for i in range(400)], "doc_id long, text string, own array<string>")
    out = M.mix(docs, F.col("own"), targets={"a": 300.0, "b": 900.0}).collect()
    credit = {s: sum(3 * r.credits.count(s) for r in out) for s in ("a", "b")}
    assert abs(credit["a"] - 300) <= 3 and abs(credit["b"] - 900) <= 6
    assert M.mix(docs.limit(0), F.col("own")).count() == 0
    same = spark.createDataFrame([(1, "w w", "a", 9)] * 5, "doc_id long, text string, source string, taken int")
    assert [r.taken for r in M.mix(same, F.array("source")).collect()] == [2] * 5
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), *((i, "w w", "a") for i in range(2, 60)), (60, "w", "b")], "doc_id long, text string, source string")
    taken = {r.doc_id: (r.size, r.taken) for r in M.mix(long, F.array("source"), targets={"a": 100.0, "b": 3.0}).collect()}
    assert taken[1][0] == 300_000 and taken[1][1] == 0 and sum(t for _, t in taken.values()) == 103
    with pytest.raises(ValueError):
        M.mix(docs, F.array(F.col("doc_id").cast("string")), max_patterns=10)


def test_the_plan_starts_no_python_workers(spark, monkeypatch):
    """Rows of the driver that go as tuples pass through Python workers of their own, which stay beside those of the operators."""
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', 5) as text", "if(id % 3 = 0, null, concat('s', id % 3)) as source").cache()

    def refuse(*_, **__):
        raise AssertionError("rows went through Python workers")

    from pyspark.sql import functions as F

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert M.mix(docs, F.array("source")).where("taken > 0").count() > 0
    assert M.mix(docs.limit(0), F.array("source")).count() == 0
