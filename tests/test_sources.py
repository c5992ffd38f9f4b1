import json

import pytest

from glossa.plans import plugins
from glossa.sources import readers, writers
from glossa.streaming.results import follow_results


def lines(path, rows):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))


def test_results(spark, tmp_path):
    lines(tmp_path / "r.jsonl", [{"id": "1", "hyp": "a"}, "{broken\n", {"id": "2", "hyp": "b"}])
    assert readers.read_results(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert sorted((r.id, r.hyp) for r in readers.read_results(spark, str(tmp_path / "r.jsonl"), partial=True).collect()) == [("1", "a"), ("2", "b")]
    with pytest.raises(Exception):
        readers.read_results(spark, str(tmp_path / "r.jsonl")).collect()


def test_segments_resume_and_systems(spark, tmp_path):
    lines(tmp_path / "s.jsonl", [{"id": i, "fr": f"t{i}", "en_ref": "r", "terms": [{"word": "w"}]} for i in "abc"])
    segs = readers.read_segments(spark, str(tmp_path / "s.jsonl"), " b ,, ")
    assert [r.id for r in segs.orderBy("id").collect()] == ["a", "c"]
    out = plugins.run_system(segs, "s1", done=segs.where("id = 'a'").select("id"))
    writers.write_results(out, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert [(r.id, r.hyp, r.system) for r in again.collect()] == [("c", "tc", "s1")]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.asc").write_bytes("1|Apnée|2\n".encode("cp1252"))
    (tmp_path / "b.asc").write_bytes("﻿3$Fièvre$4\r\n\r\n".encode())
    rows = {r.fields[0]: r.fields[1] for r in readers.read_ontology_file(spark, str(tmp_path / "*.asc")).collect()}
    assert rows == {"1": "Apnée", "3": "Fièvre"}


def test_scores_and_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("label,bleu,chrf\na,1.5,\nb,nan,2\n")
    rows = [tuple(r) for r in readers.read_scores(spark, str(tmp_path / "s.csv")).orderBy("label").collect()]
    assert rows == [("a", 1.5, None), ("b", None, 2.0)]
    df = spark.createDataFrame([(x,) for x in ["a", " ", "b", "", "c", *"defghij"]], "value string")
    assert tuple(readers.count_lines(df).first()) == (10, 9, 1)


def test_refresh_keeps_annotations(spark):
    audit = spark.createDataFrame([("1", "old", "old", "old", "note"), ("9", "old", "old", "old", "n2")], "id string, fr string, en_ref string, hyp string, note string")
    segs = spark.createDataFrame([("1", "new", "ref")], "id string, fr string, en_ref string")
    out = writers.refresh_texts(audit, segs, spark.createDataFrame([], "id string, hyp string"))
    assert sorted(map(tuple, out.collect())) == [("1", "new", "ref", "", "note"), ("9", "old", "old", "old", "n2")]


def test_following_a_folder_adds_each_row_once(spark, tmp_path):
    lines(tmp_path / "in" / "a.json", [{"id": "1", "system": "s1", "hyp": "x"}, {"id": "2", "system": "s1", "hyp": "y"}])
    for _ in range(2):
        follow_results(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    lines(tmp_path / "in" / "b.json", [{"id": "2", "system": "s1", "hyp": "z"}, {"id": "3", "system": "s1", "hyp": "z"}])
    follow_results(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r.id, r.hyp) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("1", "x"), ("2", "y"), ("3", "z")]


def test_score_columns_stand_in_their_fixed_order(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 0.1, 0.5, 0.2, 0.3, 1.0)], "label string, htm_vector_090 double, p95_s double, htm_vector_080 double, htm_en_ref_dataset double, bleu double")
    writers.write_scores(rows, spark.createDataFrame([(0.7,)], "ccr_dataset double"), str(tmp_path / "scores"))
    back = spark.read.option("header", True).csv(str(tmp_path / "scores"))
    assert back.columns == ["label", "bleu", "htm_vector_080", "htm_vector_090", "htm_en_ref_dataset", "ccr_dataset", "p95_s"] and back.count() == 1


def test_fields_of_a_line_are_cut_once(spark):
    from pyspark.sql import functions as F

    from glossa.functions.text import split_fields
    from glossa.operators.ontology import parse_hierarchy

    parsed = spark.createDataFrame([("1|a|2|b|3|c|4|d|5|e",)], "line string").select(parse_hierarchy(split_fields(F.col("line"))).alias("h"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2  # by bars, by dollar signs
    assert parsed.first().h.soc_name == "e"
