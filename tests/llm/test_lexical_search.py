import math
import random
import re
from collections import Counter

import pyarrow as pa

from glossa.llm import lexical_search as S

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    big, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c, n in counts:
            m = 50 + 50 * n * big // total
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(rng, n=700):
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Ünder", "x_y", "日本", "A-b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(n)]
    docs += [(n + i, "same text w1 w2") for i in range(200)] + [(n + 900, None), (n + 901, "!!"), (3, "w1 w1 w5"), (None, "w1 w9"), (None, "w3 w9 w59")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(12)] + [(100, None), (101, "unheard"), (102, "W1, w1; w2"), (0, "w40 w41"), (None, "w7")]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 400)  # many blocks a shard
    docs, items = corpus(random.Random(1))
    table = spark.createDataFrame([(t, d, 1.0, "z") for d, t in docs], "text string, doc_id long, score double, term string").repartition(5)
    asked = spark.createDataFrame([(t, i, 7) for i, t in items], "text string, item_id long, rank int")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in S.search(table, asked).collect()), key=str) == want and len(want) > 300
    # Items in several blocks give the same.
    assert sorted((tuple(r) for r in S.search(table, asked, terms_a_block=20).collect()), key=str) == want


def test_ids_of_text(spark):
    docs = [("b", "one two"), ("a", "one two"), ("c", "two"), (None, "one two")]
    rows = S.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "one")], "item_id string, text string"), top=2).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in rows] == [("q", 1, "a"), ("q", 2, "b")]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert S.search(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == [] and S.search(some, items).collect() == []


def test_documents_that_cannot_win_are_not_scored():
    n = 4000
    batch = {"rare": [17, 1999], "common": list(range(n))}
    sizes = [0] * n
    for d in batch["rare"] + batch["common"]:
        sizes[d] += 1
    own, often = [], []
    for d in range(n):
        own += ([0] if d in (17, 1999) else []) + [1]
        often += [1] * (2 if d in (17, 1999) else 1)
    import numpy as np

    block, rows = S.invert(pa.array(range(n)), np.full(n, 10), np.array(sizes), np.array(own), np.array(often), np.array([7000, 1]), (n, 10 * n), 2)
    seen = []
    best = S.wand(block, [0, 1], 2, seen=seen)
    assert sorted(number for _, number in best) == [17, 1999] and len(seen) < 10
