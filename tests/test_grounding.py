import random

from pyspark.sql import functions as F

from glossa.functions.similarity import indel_ratio, indel_ratio_native
from glossa.operators import grounding, lookup, ontology, planning


def ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio(spark):
    rng = random.Random(1)
    rows = [("pneumonitis", "pneumonia"), ("abc", "acb"), ("", ""), ("", "a")] + [tuple("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("x"), indel_ratio_native(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(abs(r.x - ratio(r.a, r.b)) < 1e-9 and abs(r.y - r.x) < 1e-9 for r in got)
    assert got[0].x == 80.0


def test_blocked_join_misses_no_pair(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(120)}
    labels = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(120)}
    w, x = (spark.createDataFrame([(k,) for k in s], "key string") for s in (words, labels))
    for cutoff in (70, 80, 90, 100):
        got = {(r.word_key, r.label_key) for r in grounding.fuzzy_matches(w, x, cutoff).collect()}
        assert got == {(a, b) for a in words for b in labels if ratio(a, b) >= cutoff}, cutoff


CONCEPTS = [("1", "Lung disorders", 1, "SOC", None), ("4", "Pneumonia", 4, "PT", "Pneumonie"), ("5", "Pneumonia b", 5, "LLT", "pneumonie"), ("6", "Fever", 4, "PT", "Fièvre"), ("7", "Apnoea", 5, "LLT", "Apnée")]


def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "id string, name string, level int, tier string, fr_label string")


def test_grounding_and_diagnosis(spark):
    index = grounding.label_index(concepts(spark))
    assert {r.key: (r.n_concepts, r.concept.id) for r in index.collect()} == {"pneumonie": (2, "4"), "fièvre": (1, "6"), "apnée": (1, "7")}
    terms = spark.createDataFrame([("PNEUMONIE",), ("fievre",), ("fièvre",), ("fièvre",), ("zzz",), ("",), ('"x[',)], "word string")
    found = {r.word: (r.match, r.concept.id if r.concept else None) for r in grounding.ground(terms, index, cutoff=80).collect()}
    assert found == {"PNEUMONIE": ("exact", "4"), "fievre": ("fuzzy", "6"), "fièvre": ("exact", "6"), "zzz": ("none", None), '"x[': ("none", None)}
    cats = {r.term: (r.category, r.freq) for r in grounding.diagnose(terms.where("word <> ''"), index, cutoff=80).collect()}
    assert cats == {"PNEUMONIE": ("AMBIGUOUS", 1), "fievre": ("FUZZY_HIT", 1), "fièvre": ("EXACT_HIT", 2), "zzz": ("NOT_IN_GRAPH", 1)}
    cascade = {r.term: (r.match_kind, r.id) for r in lookup.cascade(terms.withColumnRenamed("word", "term"), index, 80).collect()}
    assert cascade["fievre"] == ("fuzzy", "6") and cascade[""] == ("none", None)


def test_substrings_and_merging(spark):
    terms = spark.createDataFrame([("neumo",), ("zz",)], "term string")
    assert [(r.term, r.id) for r in lookup.substring_candidates(terms, concepts(spark), "fr_label").orderBy("id").collect()] == [("neumo", "4"), ("neumo", "5")]
    cands = spark.createDataFrame([("t", "1", "fuzzy", 80.0, 1), ("t", "1", "exact", 100.0, 2), ("t", "2", "fuzzy", 100.0, 3)], "term string, id string, source string, score double, arrival int")
    merged = lookup.merge_candidates(cands)
    assert [(r.id, r.source, r.rank) for r in merged.orderBy("rank").collect()] == [("1", "exact", 1), ("2", "fuzzy", 2)]
    chosen = spark.createDataFrame([("t", "9")], "term string, id string")
    assert [tuple(r) for r in lookup.validate_choice(chosen, merged).collect()] == [("t", "1", False)]


def test_ontology_rows_and_walks(spark):
    line = "10081988$10021881$10021879$10038738$Acute lung$Infections low$Infections resp$Respiratory$Resp$$10038738$Y$"
    rows = spark.createDataFrame([(line,), ("1|a|2|b|3|c|4|d|5|e",), ("1|2",)], "line string")
    from glossa.functions.text import split_fields

    got = [r.h for r in rows.select(ontology.parse_hierarchy(split_fields(F.col("line"))).alias("h")).collect()]
    assert (got[0].soc_code, got[0].primary, got[0].llt_name) == ("10038738", "Y", "Acute lung") and got[1].pt_name == "b" and got[2] is None
    parsed = rows.select(ontology.parse_hierarchy(split_fields(F.col("line"))).alias("h")).where("h is not null").select("h.*")
    pairs = spark.createDataFrame([("10081988", "10077321")], "llt_code string, parent_pt string")
    names = spark.createDataFrame([("10077321", "Lung PT")], "pt_code string, pt_label string")
    full = {r.llt_code: (r.pt_code, r.pt_name) for r in ontology.enrich(parsed, pairs, names).collect()}
    assert full == {"10081988": ("10077321", "Lung PT"), "1": ("2", "b")}
    assert ontology.hierarchy_edges(parsed.where("llt_code = '1'")).count() == 4
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "y"), ("b", "b")], "parent string, child string")
    cs = spark.createDataFrame([(k, k.upper(), 1, "SOC") for k in "rabxy"], "id string, name string, level int, tier string")
    ask = spark.createDataFrame([("a",)], "id string")
    assert ontology.neighbours(edges, cs, ask).first().names == ["R", "X", "B"]
    assert {r.at for r in ontology.descendants(edges.where("parent <> child"), spark.createDataFrame([("r",)], "id string")).collect()} == {"a", "b", "x", "y"}
    same = ontology.same_branch(spark.createDataFrame([("x", "y"), ("x", "q"), ("q", "q")], "a string, b string"), edges, 4)
    assert {(r.a, r.b): r.same for r in same.collect()} == {("x", "y"): True, ("x", "q"): False, ("q", "q"): True}
    assert not ontology.same_branch(spark.createDataFrame([("x", "y")], "a string, b string"), edges, 3).first().same


def test_planning(spark):
    rows = [("t", "one", 0, 0.5, 0.5, 4, 4), ("t", "two", 1, 0.5, 0.5, 4, 4), ("t", "far", 2, 0.6, 0.5, 1, 4)]
    df = spark.createDataFrame(rows, "term string, en string, ord int, context_sim double, neighbour_sim double, level int, own_level int")
    assert planning.plan_locks(df).first().en == "one"
    terms = spark.createDataFrame([("s", 0, "fièvre"), ("s", 1, "Toux"), ("s", 2, "fièvre")], "id string, pos int, word string")
    gloss = spark.createDataFrame([("fièvre", "fever", 0), ("Toux", "cough", 1), ("fièvre", "pyrexia", 2)], "fr string, en string, pos int")
    assert planning.phrases(terms, gloss).first().phrases == ["pyrexia"]
    assert planning.phrases(terms, gloss, True).first().phrases == ["pyrexia", "cough"]
