import pytest

from glossa.operators import grounding, lookup, ontology, report, stats, terminology
from glossa.sources import readers, writers


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [("1", "Heart disorders", 1, "SOC", "affections du coeur"), ("4", "Pneumonia", 4, "PT", "pneumonie"), ("5", "Cold", 4, "PT", "rhume"), ("6", "Chill", 5, "LLT", "rhume"), ("7", "Appendicitis acute", 4, "PT", "appendicite aigue")]
    return spark.createDataFrame(rows, "id string, name string, level int, tier string, fr_label string")


def test_lookup_goes_through_its_stages(spark, concepts):
    index = grounding.label_index(concepts)
    terms = [("4", "fr"), ("99", "fr"), ("Rhume ", "fr"), ("pneumonie", "fr"), ("pneumonies", "fr"), ("Pneumonia", "en"), ("pneumonias", "en"), ("pneumonie", "en"), ("  ", "en"), ("zzz", "fr"), ("thing", "fr"), ("cold", None)]
    meanings = spark.createDataFrame([("thing", "1", 0.5), ("thing", "7", 0.75), ("pneumonie", "1", 0.9)], "term string, id string, sim double")
    got = lookup.lookup(spark.createDataFrame(terms, "term string, lang string"), concepts, index, index, 90, meanings).collect()
    found = {(r.term, r.lang): (r.source, round(r.confidence, 2), r.id) for r in got}
    assert found[("4", "fr")] == ("code", 100.0, "4") and found[("99", "fr")] == ("none", 0.0, None)
    assert found[("Rhume ", "fr")] == ("ambiguous", 100.0, "5") and found[("pneumonie", "fr")] == ("exact", 100.0, "4")
    assert found[("pneumonies", "fr")] == ("fuzzy", 94.74, "4") and found[("pneumonias", "en")] == ("fuzzy", 94.74, "4")
    assert found[("Pneumonia", "en")] == ("exact", 100.0, "4") and found[("  ", "en")] == ("blank", 0.0, None)
    assert found[("zzz", "fr")][0] == "none" and found[("thing", "fr")] == ("semantic", 75.0, "7")


def test_candidates_by_stage(spark, concepts):
    terms = spark.createDataFrame([("rhume",), ("pneumonie",), ("appendicite",), ("pneumonies",)], "term string")
    meanings = spark.createDataFrame([("rhume", "1", 0.9), ("pneumonies", "1", 0.6)], "term string, id string, sim double")
    got = lookup.collect_candidates(terms, concepts, near=grounding.label_index(concepts), meanings=meanings).collect()
    rows = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        rows.setdefault(r.term, []).append((r.id, r.source))
    assert rows == {"rhume": [("5", "ambiguous"), ("6", "ambiguous")], "pneumonie": [("4", "exact")], "appendicite": [("7", "fuzzy")] if ("7", "fuzzy") in rows["appendicite"] else [("7", "substring")], "pneumonies": [("4", "fuzzy"), ("1", "semantic")]}


def test_updates_primary_rows_and_views(spark, concepts):
    one = spark.createDataFrame([("4", "a", 1), ("4", "b", 2), ("5", " ", 1)], "code string, label string, line int")
    two = spark.createDataFrame([("1", "c", 1)], "code string, label string, line int")
    assert {r.id: r.fr_label for r in ontology.update_labels(concepts, one, two).collect()} == {"1": "c", "4": "b", "5": "rhume", "6": "rhume", "7": "appendicite aigue"}
    assert [(r.key, r.place, r.id) for r in ontology.alternatives(concepts).collect()] == [("rhume", 1, "5"), ("rhume", 2, "6")]
    assert tuple(ontology.populated(concepts.limit(0)).first()) == (0, 0, False)
    edges = spark.createDataFrame([("1", "4"), ("1", "4"), ("1", "5"), ("1", "1"), ("5", "6")], "parent string, child string")
    seen = {r.id: (r.n_parents, r.n_children, r.parents, r.children) for r in ontology.neighbourhood(edges, concepts, 1).collect()}
    assert seen["1"] == (0, 2, [], ["Cold"]) and seen["5"] == (1, 1, ["Heart disorders"], ["Chill"])


def test_alignment_order_and_first_known(spark):
    results = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, hyp string")
    references = spark.createDataFrame([("1", "a"), ("3", "c")], "id string, ref string")
    assert sorted(tuple(r) for r in readers.aligned(results, references).collect()) == [("1", "x", "a"), ("3", "z", "c")]
    ids = spark.createDataFrame([(3, 0), (9, 1), (1, 2)], "id long, pos long")
    assert [r.id for r in readers.in_order(ids, results).collect()] == [3, 1]
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, float("nan")), ("a", 3, 0.5), ("a", 4, 0.7), ("b", 1, None)], "g string, pos int, v double")
    assert {r.g: r.v for r in stats.first_known(rows, "g", "v", "pos").collect()} == {"a": 0.5, "b": None}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", "EXACT_HIT"), ("c", "AMBIGUOUS"), ("a", "EXACT_HIT"), ("d", "other")], "term string, category string")
    assert [(r.term, r.idx) for r in report.in_category_order(rows, grounding.CATEGORIES).collect()] == [("c", 0), ("a", 2), ("b", 2), ("d", 4)]
    table = spark.createDataFrame([("s2", None), ("s1", 0.5)], "label string, v double")
    assert [r.line for r in report.markdown_table(table, ["label", "v"]).orderBy("pos").collect()] == ["| label | v |", "|---|---|", "| s1 | 0.50 |", "| s2 | — |"]
    names = table.select(report.display_label(table.label).alias("n")).collect()
    assert sorted(r.n for r in names) == ["S1 NLLB", "S2 Mistral (doc)"]
    writers.write_tables({"agreement": table}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "agreement")).count() == 2
    (tmp_path / "llt.asc").write_text("10$Name$20$\n11$Other$x$\n10$Again$21$\nx$y$3$\n")
    assert {tuple(r) for r in readers.read_code_map(spark, str(tmp_path / "llt.asc"), 2, numeric=True).collect()} == {("10", "21")}
    assert {tuple(r) for r in readers.read_code_map(spark, str(tmp_path / "llt.asc"), 1).collect()} == {("10", "Again"), ("11", "Other")}


def test_code_maps_of_several_files(spark, tmp_path):
    # A line with a bar is split at bars only; names may be in Windows-1252; of equal codes the last line of the last file counts.
    (tmp_path / "a.asc").write_bytes("1|A $ B|9|\n2|first|8|\n2|second|7|\n3|only a|1|\n".encode())
    (tmp_path / "b.asc").write_bytes("2$Apn\u00e9e$6$\r\n\r\nno$code$5$\r\n4$$5$\r\n".encode("cp1252"))
    assert {tuple(r) for r in readers.read_code_map(spark, str(tmp_path / "*.asc"), 1).collect()} == {("1", "A $ B"), ("2", "Apn\u00e9e"), ("3", "only a")}
    assert {tuple(r) for r in readers.read_code_map(spark, str(tmp_path / "*.asc"), 2, numeric=True).collect()} == {("1", "9"), ("2", "6"), ("3", "1"), ("4", "5")}


def test_spans_differ_by_case_alone(spark):
    rows = [(1, i, w, True, 1.0, 1.0) for i, w in enumerate(["a\u2013b", "a b", "A b ", "Stra\u00dfe", "strasse", "\u0130x"])]
    table = spark.createDataFrame(rows, "id long, pos int, word string, grounded boolean, score double, ref_score double")
    assert terminology.htm_reference(table).first().spans == 4
    # Of equal spans the first place decides.
    twice = spark.createDataFrame([(1, 2, "Flu", True, 0.0, 0.0), (1, 1, "flu", True, 1.0, 1.0)], table.schema)
    assert terminology.htm_reference(twice).first().htm == 1.0


def test_weights_equal_repeated_rows_and_folded_words_count_once(spark):
    schema = "id long, pos int, word string, grounded boolean, level int, found string, found_level int, score double, ref_score double"
    rows = [(1, 1, "Fever", True, 4, "fever", 4, 1.0, 1.0), (1, 2, "fever", True, 4, None, None, 0.0, 1.0), (1, 3, "cold", True, 4, "cold", 5, 0.5, 0.0), (2, 1, "x", False, None, None, None, 0.0, 0.0)]
    plain = spark.createDataFrame(rows + rows[2:3] * 2, schema)
    weighted = spark.createDataFrame([(*r, 3 if r[2] == "cold" else 1) for r in rows], schema + ", c long")
    for measure in (terminology.htm, terminology.missing_rate, terminology.level_accuracy, terminology.modal_agreement, terminology.level_distribution):
        assert sorted(map(str, measure(plain).collect())) == sorted(map(str, measure(weighted).collect()))
    assert tuple(terminology.htm_reference(weighted).first()) == (3, 0.5)
    assert terminology.agreement(weighted).first().spans == 2
