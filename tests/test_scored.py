import random
import re

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.plans import registry
from glossa.plans.adapters import Tables


def test_metric_form_equals_the_expressions(spark):
    rng = random.Random(6)
    alphabet = "aZé É\t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　–—-ﬁİßΣς½"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, None), (401, "Plain  text \n here ")]
    df = spark.createDataFrame(rows, "id int, s string")
    old = T.strip(T.collapse(F.translate(T._only(F.lower("s"), F.col("s"), T._nfkc_lower, True), T.DASHES, " " * len(T.DASHES))))
    assert df.where(~T.norm_metric(F.col("s")).eqNullSafe(old)).count() == 0
    got = df.select("s", T.phrases_in("s", F.array(F.lit("a"), F.lit("z é"))).alias("x")).collect()
    assert all(r.x == [p in T.metric_form(r.s or "") for p in ("a", "z é")] for r in got)


def test_scored_shuffles_texts_and_no_words(spark):
    """Words are counted and gathered where their texts lie: no exchange of the plan has a word."""
    plan = registry.scored(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\([^)]*word#", line)]
