import math
import random

import numpy as np
import pytest

from glossa.llm import embedding_dedup as E


def brute(rows, least=E.COSINE):
    ok = [(i, v, l) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, v, l), (j, w, m) = ok[a], ok[b]
            if l == m and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, *_ in rows}


def test_links_equal_brute_force(spark):
    rng, np_rng = random.Random(8), np.random.default_rng(8)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))

    for _ in range(250):
        add(np_rng.normal(size=16), rng.choice([1, 2]))
    centre = np_rng.normal(size=16)
    for _ in range(160):  # a pile of near copies
        add(centre + 0.12 * np_rng.normal(size=16), 1)
    for _ in range(20):
        add(centre, 2)
        add(2 * centre, 2)
    for k in range(12):
        add([math.cos(0.15 * k), math.sin(0.15 * k), *[0] * 14], 2)
    for v in (None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8, []):
        add(v, 1)
    add(centre, None)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_blocks_of_large_components_count_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.12 * rng.normal(size=16)).tolist(), 1) for i in range(90)]
    rows += [(90 + i, rows[i][1], 1) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(E, "BLOCK", 16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()} == brute(rows)


def test_rows_that_share_an_id(spark):
    """The row of least digest stands for the id, so reruns agree."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    runs = {tuple(sorted(map(tuple, E.near_duplicates(spark.createDataFrame(r, "vec_id long, embedding array<float>, label int")).collect()))) for r in (rows, rows[::-1])}
    assert len(runs) == 1 and len(next(iter(runs))) == 4


def test_empty_and_single(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1, "x")], "vec_id long, embedding array<float>, label int, n_links string")
    assert [tuple(r) for r in E.near_duplicates(df).collect()] == [(7, 0, 7, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def few_pairs():
    """Vectors without links but for two lone pairs, each with an id that 50 divides."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).tolist(), 1) for i in range(400)]
    for i in (100, 250):
        rows[i + 7] = (i + 7, (np.array(rows[i][1]) + 0.01 * rng.normal(size=32)).tolist(), 1)
    return rows


def test_audit_joins_links_that_a_start_lost(spark, monkeypatch):
    """Of two lone pairs that a start does not see, the audit sees both; too few found links are an error, and links that it finds count."""
    rows, schema = few_pairs(), "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema)
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()} == brute(rows)
    monkeypatch.setattr(E, "_found", lambda names, cosine, floor, take, least: None)  # a search that finds nothing
    monkeypatch.setattr(E, "STARTS", 1)
    with pytest.raises(RuntimeError, match="0 of 2 audited links"):
        E.near_duplicates(df)
    monkeypatch.setattr(E, "RECALL", 0.0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()} == brute(rows)
