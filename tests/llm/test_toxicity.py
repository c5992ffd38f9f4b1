import math
import random
import re

import xxhash
import zstandard
from pyspark.sql import functions as F

from glossa.llm import toxicity as X

WORDS = [f"{a}{b}" for a in ("ran", "tol", "mer", "bis", "kad") for b in ("do", "mi", "la", "re", "so", "ti", "fu")]
STEMS = ("vilgor", "smutch")


def tables(spark, n=500, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(["", "a", "en", "ik"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark)
    model = X.fit(docs, labels, ~X.held_out(F.col("doc_id")))
    rows = X.score(docs, model).withColumn("held", X.held_out(F.col("doc_id"))).where("held").collect()
    assert len(rows) > 60
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_scores_depend_on_the_text_alone(spark):
    docs, labels, _ = tables(spark, 200)
    model = X.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 1.0), (None, "ranmi", 2.0), (9, "ranmi", 2.0), (9, "ranmi", 2.0), (10, "vilgor " * 20000, 0.0)], "doc_id long, text string, score double")
    rows = X.score(odd, model).collect()
    assert len(rows) == 6 and len({r.score for r in rows if not r.text}) == 1 and len({r.score for r in rows if r.text == "ranmi"}) == 1
    assert next(r for r in rows if r.doc_id == 10).predicted == 1
    assert X.score(odd.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert X.score(docs, X.fit(docs, none)).first().score == 0.0
    assert X.score(docs, X.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).first().score == 1.0


def test_scores_by_brute_force(spark):
    """Scores follow from the two dictionaries, windows of compressed text and the curve alone."""
    docs, labels, _ = tables(spark, 200)
    model = X.fit(docs, labels)

    def size(data, dictionary):
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, window_log=19, hash_log=17, chain_log=17, search_log=1, min_match=7, strategy=2
        )
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data))

    def codes(word):
        whole = xxhash.xxh3_64(word.encode("utf-32-le"), seed=1).digest()
        return whole + b"".join(xxhash.xxh3_64(word[:k].encode("utf-32-le")).digest() for k in range(3, min(10, len(word)) + 1))

    for row in X.score(docs.limit(40), model).collect():
        words = re.findall(r"[^\W\d_]+", row.text.lower())
        saved = []
        for i in range(0, len(words), X.WINDOW):
            data = b"".join(map(codes, words[i : i + X.WINDOW]))
            plain = size(data, model.ordinary + bytes(len(model.toxic)) + b"\xff" * 16)
            saved.append(plain - size(data, model.ordinary + model.toxic + b"\xff" * 16))
        hits = [g for g in saved if g >= model.gain]
        x = (1.0, math.log1p(len(hits)), math.log1p(sum(hits)), math.log1p(1000 * len(hits) / max(len(saved), 1)))
        assert math.isclose(row.score, 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))), rel_tol=1e-9)


def test_dictionaries_save_on_their_own_words():
    ordinary, toxic = (b"".join(map(X.spelt, w)) for w in (WORDS, STEMS))
    scorer = X.Scorer(X.Model(ordinary, toxic))
    assert all(scorer.gains(w + " tolmi")[0] > 20 for w in STEMS) and scorer.gains(" ".join(WORDS)) == [0] * -(-len(WORDS) // X.WINDOW)


def test_copies_of_a_text_weigh_little_but_count():
    one, many = X.Texts(), X.Texts()
    for _ in range(64):
        one.add("vilgor smutch")
    for i in range(64):
        many.add("vilgor " + WORDS[i % 35] + "x" * (i // 35))
    assert one.count()[2] == 4 and many.count()[2] == 64


def test_toxic_copies_are_learnt(spark):
    """Every fourth row is toxic, all with the same words."""
    rng = random.Random(3)
    rows = [(i, "vilgor smutch " * 3 if i % 4 == 0 else " ".join(rng.choices(WORDS, k=20)), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in X.score(docs, model).collect())


def test_units_of_whole_texts_are_learnt(spark):
    """The one toxic word of a long document may stand anywhere; it gets into the dictionary."""
    rng = random.Random(11)
    pool, rows = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)], []
    for i in range(120):
        words = rng.choices(pool, k=20_000)
        if i % 2:
            words[rng.randrange(20_000)] = "zzyzzxyq"
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert X.spelt("zzyzzxyq")[:8] in model.toxic
