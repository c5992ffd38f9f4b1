import numpy as np

from glossa.operators import lookup
from glossa.plans import registry


def brute(rows, floor):
    """{query: [(-sim, item, key)]} of every vector whose id 50 divides against all others."""
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    return {q: sorted((-float(unit[q] @ unit[i]), i, k) for i, _, k in rows if i != q and unit[q] @ unit[i] >= floor) for q in unit if q % 50 == 0}


def test_queries_grow_with_the_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(220)]
    rows[100] = (100, (np.array(rows[50][1]) * 2 + 0.01).tolist(), 1)  # queries find each other
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    best = {r["query"]: (r["item"], r["key"], r["sim"]) for r in registry.queries()["semantic_best"](spark, str(tmp_path)).collect()}
    assert best == {q: (own[0][1], own[0][2], round(-own[0][0], 6)) for q, own in brute(rows, 0.2).items()}
    assert len(best) == 5 and best[50][0] == 100 and best[100][0] == 50
    want = set()
    for q, own in brute(rows, 0.3 * lookup.FLOOR).items():
        seen = []
        for s, i, k in own[:15]:
            if k not in [x[1] for x in seen]:
                seen.append((i, k, round(-s, 6)))
        want |= {(q, i, k, s, rank) for rank, (i, k, s) in enumerate(seen[:5], 1)}
    assert {tuple(r) for r in registry.queries()["semantic_topk"](spark, str(tmp_path)).collect()} == want


def test_more_than_ten_thousand_queries(spark):
    asked = spark.range(10_001).selectExpr("id AS query", "array(1.0D, 0.0D) AS q_vector")
    corpus = spark.createDataFrame([(7, "k", [2.0, 0.0]), (8, "k", [0.0, 0.0]), (9, "k", [0.0, 1.0])], "item long, key string, vector array<double>")
    assert lookup.similar(asked, corpus, 0.5).count() == 10_001


def test_blocks_meet_when_partitions_stay_apart(spark):
    """With as many partitions as the session says, every block of queries still meets every part of the items; copies tie by item."""
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).tolist() for i in range(400)}
    vectors |= {i + 400: vectors[i] for i in range(0, 400, 3)}  # copies
    rows = [(i, v, i % 3) for i, v in vectors.items()]
    corpus = spark.createDataFrame(rows, "item long, vector array<float>, key int")
    asked = corpus.where("item % 50 = 0").selectExpr("item AS query", "vector AS q_vector")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = lookup.semantic_best(asked, corpus, 0.2, itself=False).collect()
        near = lookup.similar(asked, corpus, 0.2, itself=False).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = brute(rows, 0.2)
    assert {(r["query"], r["item"]) for r in near} == {(q, i) for q, own in want.items() for _, i, _ in own}
    of = {}
    for r in near:
        of.setdefault((r["query"], tuple(vectors[r["item"]])), set()).add(r["sim"])
    assert all(len(sims) == 1 for sims in of.values())  # copies have one cosine
    for r in got:
        tied = [i for s, i, _ in want[r["query"]] if s <= want[r["query"]][0][0] + 1e-12]
        assert r["item"] == min(tied)
