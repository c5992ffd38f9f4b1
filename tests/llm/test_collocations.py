import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossa.llm import collocations as C

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, max_n=3, least=10, top=2000, share=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        candidates = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        kept = []
        for w, a in candidates.items():
            inside = any(len(x) > len(w) and 100 * b >= share * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for x, b in candidates.items())
            if not inside:
                score, k = min((1000000 * a * a // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
                kept.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(rng, n=250):
    words = ["a", "B", "b", "c", "é", "É", "x y", "...d", "zz", "Zz", "q'r"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r\n", "!"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "x"]), text))
    rows += [("en", "hot dog stand now")] * 60 + [("en", "New York City")] * 25 + [("en", "new york")] * 26 + [("en", None), ("en", ""), (None, " \t"), ("fr", "only once here")]
    return rows


@pytest.mark.parametrize("max_n, top", [(3, 2000), (4, 2000), (2, 5)])
def test_equals_brute_force(spark, monkeypatch, max_n, top):
    monkeypatch.setattr(C, "BLOCK", 700)  # many blocks, and texts that are longer than one
    rows = corpus(random.Random(max_n))
    docs = spark.createDataFrame([(lang, text, i, "z") for i, (lang, text) in enumerate(rows)], "lang string, text string, f long, phrase string")
    got = sorted(tuple(r) for r in C.collocations(docs, max_n=max_n, top=top).collect())
    assert got == brute(rows, max_n, 10, top) and len(got) > 10


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).collect() == []


def test_scores_of_counts_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 4_000_000_000_009
    candidates = spark.createDataFrame([("en", "u v", a)], "lang string, phrase string, f long")
    parts = spark.createDataFrame([("en", "u", l), ("en", "v", r)], "lang string, phrase string, f long")
    assert C.scored(candidates, parts).first()["score"] == 1000000 * a * a // (l * r)
    # One below a whole number must not be rounded up.
    a, l = 10**12 - 1, 10**12
    parts = spark.createDataFrame([("en", "u", l), ("en", "v", l)], "lang string, phrase string, f long")
    candidates = spark.createDataFrame([("en", "u v", a)], "lang string, phrase string, f long")
    assert C.scored(candidates, parts).first()["score"] == 999999


def test_blocks_end_where_pieces_end():
    data = np.frombuffer(b"ab cd. ef gh\nij kl mn op qr st uv", np.uint8)
    parts = [p.tobytes() for p in C.cut(data, 5)]
    assert parts == [b"ab cd.", b" ef gh\n", b"ij kl mn op qr st uv"]


def test_a_frequent_gram_is_never_missed(spark):
    names = [f"w{i} é" for i in range(3000)]
    counts = spark.createDataFrame([("en", w, 10) for w in names] + [("en", "rare", 9)], "lang string, phrase string, f long")
    import pyarrow as pa

    known = C.Frequent(C.frequent(counts, 10))
    assert known.holds("en", pa.array(names, pa.large_string())).all()
    assert not known.holds("en", pa.array(["rare"], pa.large_string())).any() and not known.holds("de", pa.array(["w1 é"], pa.large_string())).any()
