from pyspark.sql import functions as F

from glossa.functions import prompts
from glossa.operators import annotation as A
from glossa.plans import plugins
from glossa.sources import writers


def test_rows_ties_and_sets(spark):
    df = spark.createDataFrame([(0, " ", "1", "s2"), (1, "technical", None, ""), (2, "x", "", "s1")], "pos int, human string, Human_label string, best string")
    rows = A.normalise_rows(df, {"human": ("human", "Human_label", "none"), "best": ("best",)}).orderBy("pos").collect()
    assert [(r.pos, r.human, r.best) for r in rows] == [(0, "1", "s2"), (1, "technical", None)]
    ties = spark.createDataFrame([("", "between s1 or s2", "s2"), ("", "between s1 or s2", "s5"), ("S 6", "", "s1"), ("", "", "s1")], "b string, t string, l string")
    assert [r.x for r in ties.select(A.resolve_tie(F.col("b"), F.col("t"), F.col("l")).alias("x")).collect()] == ["s2", "s1", "s6", None]
    res = spark.createDataFrame([("1", "s2", "a"), ("1", "s5", "b"), ("2", "s2", "a"), ("2", "s5", " ")], "id string, system string, hyp string")
    assert [r.id for r in A.complete_ids(res, ["s2", "s5"]).collect()] == ["1"]


def test_prompts_and_plugins(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, "b", "B", "PT", 4), ("s", 0, "a", "A", "LLT", 5), ("s", 2, "a", "A", "LLT", 5), ("s", 3, "c", None, None, None)], "id string, pos int, word string, english string, tier string, level int")
    r = prompts.term_lines(t).first()
    assert r.lines == "'a' → 'A' (LLT L5)\n'b' → 'B' (PT L4)\n'a' → 'A' (LLT L5)" and r.phrases == ["A", "B"]
    m = spark.createDataFrame([("t", "1", 1), ("u", "1", 1), ("u", "2", 2)], "term string, id string, rank int")
    assert {x.term: (x.id, x.abstained) for x in plugins.choose(m).collect()} == {"t": ("1", False), "u": (None, True)}
    assert plugins.neural_score(spark.createDataFrame([("a", "b", "c")], "src string, hyp string, ref string")).first().comet is None
    calls = []
    for _ in range(2):
        assert writers.cached(str(tmp_path / "c"), lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
