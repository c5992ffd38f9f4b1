"""Places for models: translators, embedders, choosers. Each is a function over pandas frames; none is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Frames = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
TRANSLATED = "id string, system string, fr string, hyp string, en_ref string, inference_s double"


def echo(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in without a model: the source as its own translation."""
    for f in frames:
        yield f.assign(hyp=f["fr"], inference_s=0.0)


def run_system(segments: DataFrame, system: str, translate: Frames = echo, done: DataFrame | None = None) -> DataFrame:
    """Segments without a result yet, translated partition by partition; seconds are rounded to four places."""
    rows = segments if done is None else segments.join(done.select("id"), "id", "left_anti")
    given = rows.select("id", F.lit(system).alias("system"), "fr", "en_ref")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in translate(frames):
            yield f[["id", "system", "fr", "hyp", "en_ref", "inference_s"]]

    return given.mapInPandas(run, TRANSLATED).withColumn("inference_s", F.round("inference_s", 4))


Scorer = Callable[[Column, Column, Column], Column]


def neural_score(pairs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Mean of a model's score over (src, hyp, ref) rows; null without a model or rows."""
    if scorer is None:
        return pairs.agg(F.lit(None).cast("double").alias("comet"))
    return pairs.agg(F.avg(scorer(F.col("src"), F.col("hyp"), F.col("ref"))).alias("comet"))


def choose(merged: DataFrame, chooser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(term, id, abstained): a model's choice among a term's candidates; without one the only candidate, or none if there are several."""
    if chooser is not None:
        return chooser(merged)
    own = merged.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "rank").alias("top"))
    return own.select("term", F.when(F.col("n") == 1, F.col("top")).alias("id"), (F.col("n") > 1).alias("abstained"))
