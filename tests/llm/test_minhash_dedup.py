import random
from collections import Counter, defaultdict

import pyarrow as pa

from glossa.llm import minhash_dedup as D
from glossa.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, inverse, root = {i: shingles(t) for i, t in rows}, defaultdict(list), {}
    for i, s in sets.items():
        root[i] = i
        for x in s:
            inverse[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in inverse[x] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(rng):
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(150):
        add(" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))))
    base = [rng.choice(words) for _ in range(100)]
    for _ in range(330):  # one large group, edited from one text
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(100)] = rng.choice(words)
        add(" ".join(own))
    chain = [rng.choice(words) for _ in range(80)]
    for k in range(20):  # each text close to the next only
        chain = list(chain)
        chain[(4 * k) % 80] = f"c{k}"
        add(" ".join(chain))
    for t in ("", None, " \t", "One two", "one TWO", "a b c d e", "a\tb c d\ne", "é é é é é é", "É É É É É É"):
        add(t)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_small_blocks_find_the_same(spark, monkeypatch):
    rows = corpus(random.Random(9))
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "BLOCK_SHINGLES", 1500)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_that_share_an_id_but_not_the_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, None), (4, None)]
    runs = {tuple(sorted(map(str, D.near_duplicates(spark.createDataFrame(r, "doc_id long, text string")).collect()))) for r in (rows, rows[::-1])}
    assert len(runs) == 1 and len(next(iter(runs))) == 6


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "A b\tc")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in D.near_duplicates(docs).collect()))
    assert rows == [(0, 0, False), (0, 0, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert D.near_duplicates(docs.limit(0)).count() == 0


def test_shingle_sets_of_slices_and_long_words():
    texts = ["x" * 5000 + " y", None, "a b c d e f a b c d e f", "", "ÀB c"]
    whole = pa.array(texts)
    sets, at = D.shingle_sets(whole)
    assert [int(n) for n in at[1:] - at[:-1]] == [len(shingles(t)) for t in texts]
    again, _ = D.shingle_sets(whole.slice(2))
    assert again.tolist() == sets[at[2] :].tolist()


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1080), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_are_made_a_step_at_a_time(monkeypatch):
    import tracemalloc

    rng = random.Random(4)
    rows = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(300))) for _ in range(1200)] + ["", None, "x", "long " * 60_000, None]
    texts = pa.array(rows)
    tracemalloc.start()
    sets, begins = D.shingle_sets(texts.slice(0, 1200))
    assert tracemalloc.get_traced_memory()[1] < 16 * texts.slice(0, 1200).nbytes
    tracemalloc.stop()
    whole = D.shingle_sets(texts)
    for step in (1, 100, 1 << 40):
        monkeypatch.setattr(D, "STEP", step)
        for found, want in zip(D.shingle_sets(texts), whole):
            assert found.dtype == want.dtype and found.tolist() == want.tolist()
    assert [len(shingles(t)) for t in rows] == (whole[1][1:] - whole[1][:-1]).tolist()
    assert [x.tolist() for x in D.shingle_sets(texts.slice(0, 0))] == [[], [0]]
