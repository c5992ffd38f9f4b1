import random
import re
from collections import Counter

import pytest

from glossa.functions.similarity import LabelMasks
from glossa.plans import registry
from tests.test_grounding import ratio

TEXTS = ["Colerat maridun foxx colerat vendamo", "solitar vendamos maridan colerat abcdefgh", "Solitair maridunx francee zzzzqq"]
PARTS, LINES = 5, [(1, 1, "A"), (2, 1, "N"), (3, 1, "R")]
BENCH = ["colerat colerat colerat vendamo vendamo solitar foxx"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of a few rows in the shape of the test tables."""
    d = tmp_path_factory.mktemp("small")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    put("documents", [(i, x, "en", f"src{i % 2}", len(x)) for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", list(enumerate(BENCH)), "item_id long, text string")
    put("part", [(k, f"part{k}") for k in range(PARTS)], "p_partkey long, p_name string")
    put("lineitem", LINES, "l_partkey long, l_suppkey long, l_returnflag string")
    put("region", [(0, "FRANCE")], "r_regionkey long, r_name string")
    put("nation", [(0, "CANADA", 0)], "n_nationkey long, n_name string, n_regionkey long")
    put("supplier", [(1, "maridun", 0)], "s_suppkey long, s_name string, s_nationkey long")
    return str(d)


def labels():
    """{label: [(level, id)]}"""
    words = Counter(w for x in BENCH for w in re.findall("[a-zà-ÿ]+", x.lower()) if len(w) >= 4)
    vocab = sorted(words, key=lambda w: (-words[w], w))
    out = {"france": [(1, "1000000")], "canada": [(2, "2000000")], "maridun": [(3, "3000001")]}
    own = {k: vocab[k % 4] for k in range(PARTS) if k % 4 < len(vocab)}
    for k, w in own.items():
        out.setdefault(w, []).append((4, str(4000000 + k)))
    for k, _, flag in LINES:
        out.setdefault(f"{own[k]} {flag.lower()}", []).append((5, str(50000000 + 10 * k + "ANR".index(flag))))
    return out


def occurrences():
    return Counter(w for x in TEXTS for w in re.findall("[a-zà-ÿ]+", x.lower()) if len(w) >= 4)


def near(word, cutoff):
    """Labels of the two lowest tiers that reach the cutoff, best first."""
    return sorted((-ratio(word, x), x) for x, own in labels().items() if max(own)[0] >= 4 and ratio(word, x) >= cutoff)


def test_masks_equal_brute_force():
    rng = random.Random(5)
    make = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    own = sorted({make(rng.randint(1, 70)) for _ in range(150)} | {"a" * 63, "a" * 64, "a" * 65, "ab" * 200})
    masks = LabelMasks(own)
    for word in own[::5] + ["a" * 64, "ab" * 199, "x"]:
        for cutoff in (60, 75, 90):
            assert dict(masks.matches(word, cutoff)) == {x: ratio(word, x) for x in own if ratio(word, x) >= cutoff}, (word, cutoff)


def test_diagnosis_of_whole_documents_has_fuzzy_hits(spark, small):
    want, kinds = {}, {}
    for word, n in occurrences().items():
        own = labels().get(word)
        category = ("AMBIGUOUS" if len(own) > 1 else "EXACT_HIT") if own else "FUZZY_HIT" if near(word, 90) else "NOT_IN_GRAPH"
        a, b = want.get(category, (0, 0))
        want[category] = a + 1, b + n
        kind = "exact" if own else "fuzzy" if near(word, 90) else "none"
        a, b = kinds.get(kind, (0, 0))
        kinds[kind] = a + 1, b + len(own or [])
    assert want["FUZZY_HIT"] == (2, 2)  # vendamos, solitair; maridunx and francee are near to upper tiers only
    got = registry.queries()["ccr_diagnostic"](spark, small)
    assert {r.category: (r.terms, r.occurrences) for r in got.collect()} == want
    got = registry.queries()["lookup_cascade"](spark, small)
    assert {r.match_kind: (r.terms, r.alternatives) for r in got.collect()} == kinds


def test_words_of_whole_documents_meet_leaf_labels(spark, small):
    words = set(occurrences())
    assert "solitair" in words and not any("solitair" in x for x in BENCH)
    got = {r.word_key: (r.label_key, r.score) for r in registry.queries()["fuzzy_ground"](spark, small).collect()}
    best = {w: near(w, 80)[0] for w in words if near(w, 80)}
    assert got == {w: (x, round(-s, 6)) for w, (s, x) in best.items()}
    want = set()
    for w in words:
        seen = set()
        for place, (s, x) in enumerate(near(w, 75)[:3], 1):
            one = min(labels()[x])[1]
            if one not in seen:
                want.add((w, x, one, place, round(-s, 6)))
            seen.add(one)
    assert any(" " in row[1] for row in want)  # labels of leaves
    assert {tuple(r) for r in registry.queries()["fuzzy_topk"](spark, small).collect()} == want


def test_substrings_of_whole_documents(spark, small):
    held = {w: [i for x, own in labels().items() if w in x for level, i in own if level >= 4] for w in occurrences()}
    assert len(held["foxx"]) == 2  # a word of four letters, in a part's label and in a leaf's
    got = {r.term: (r.hits, r.first) for r in registry.queries()["substring_candidates"](spark, small).collect()}
    assert got == {w: (len(ids), min(ids)) for w, ids in held.items() if ids}


def test_blocks_of_words_find_what_single_words_find():
    import random

    from glossa.functions.similarity import LabelMasks

    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("aabcdeé x") for _ in range(n))
    labels = sorted({make(rng.randint(1, 14)) for _ in range(400)} | {make(80), "a" * 63, "a" * 64, "a" * 65})
    words = [make(rng.randint(1, 16)) for _ in range(700)] + ["a" * 66, "ß", "qqqq", labels[-1]]
    masks = LabelMasks(labels)
    for cutoff in (90, 75.0, 50.0):
        got = [(int(i), masks.labels[j], float(s)) for a, b, c in masks.matches_of(words, cutoff) for i, j, s in zip(a, b, c)]
        assert sorted(got) == sorted((i, x, s) for i, w in enumerate(words) for x, s in masks.matches(w, cutoff)) and got


def test_the_fuzzy_stage_has_the_stated_number_of_tasks(spark):
    from glossa.operators import grounding

    words = spark.createDataFrame([(f"word{i}",) for i in range(200)], "key string")
    matches = grounding.fuzzy_matches(words, words)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matches.collect()
    assert matches.rdd.getNumPartitions() == n and matches.where("word_key = label_key").count() == 200
