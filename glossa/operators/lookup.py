"""Batch term lookup and merging of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from glossa.functions.text import norm_key
from glossa.operators.grounding import best_matches, fuzzy_matches
from glossa.operators.ontology import by_name, rank_of

THRESHOLD, TOP, LIMIT = 0.55, 5, 8
FLOOR = 0.85
#: Blocks of queries that meet blocks of items.
BLOCKS = 8


def substring_candidates(terms: DataFrame, concepts: DataFrame, label: str, least: int = 3, limit: int = 8) -> DataFrame:
    """(term, id, label, score): labels that contain the term, by score (100), then id; at most ``limit`` per term.

    Every label is cut into its substrings of the term's first ``least`` characters, so the join is by equality and
    only labels that share these are tested.
    """
    own = terms.select("term", norm_key(F.col("term"), wide=False).alias("key")).distinct().where(F.length("key") >= least)
    own = own.withColumn("gram", F.substring("key", 1, least))
    labels = concepts.where(F.col(label).isNotNull()).select("id", norm_key(F.col(label), wide=False).alias("label")).where(F.length("label") >= least)
    labels = labels.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("label") - least + 1), lambda i: F.substring(F.col("label"), i, F.lit(least))))))
    hits = own.join(labels, "gram").where(F.contains("label", F.col("key"))).select("term", "id", "label", F.lit(100.0).alias("score"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def similar(queries: DataFrame, corpus: DataFrame, floor: float, itself: bool = True) -> DataFrame:
    """(query, item, key, sim) with sim of at least ``floor``; without ``itself``, an item of the query's id is left out.

    Blocks of queries meet blocks of items and only what is above the floor becomes a row. A zero vector, or one of
    another length, has no similarity.
    """
    n = max(1, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    usable = lambda c: F.exists(c, lambda x: x != 0) & ~F.exists(c, lambda x: x.isNull())
    # Both sides' keys have one type: equal numbers of two types are dealt to different partitions, and their groups never meet.
    asked = queries.where(usable("q_vector")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(BLOCKS)).cast("int"))
    own = corpus.where(usable("vector")).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int"))
    left = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), "query", F.col("q_vector").cast("array<double>").alias("q_vector"))
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), "part", "item", "key", F.col("vector").cast("array<double>").alias("vector"))
    schema = StructType([left.schema["query"], right.schema["item"], right.schema["key"], StructField("sim", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        for i, j, sim in _near(a.column("q_vector").combine_chunks(), b.column("vector").combine_chunks(), floor):
            found.append(pa.table([a.column("query").take(i), b.column("item").take(j), b.column("key").take(j), sim], names=["query", "item", "key", "sim"]))
        return pa.concat_tables(found) if found else pa.table([a.column("query")[:0], b.column("item")[:0], b.column("key")[:0], pa.array([], pa.float64())], names=["query", "item", "key", "sim"])

    rows = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)
    return rows if itself else rows.where("query <> item")


def _near(a: pa.Array, b: pa.Array, floor: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(rows of a, rows of b, cosine) of the pairs at or above the floor, some rows of ``a`` at a time.

    A product of matrices proposes pairs; its last bits depend on a row's place in the block, so the cosine that counts is
    summed place by place, and equal vectors have equal cosines.
    """
    sizes = a.value_lengths().to_numpy(zero_copy_only=False), b.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.intersect1d(*sizes):
        i, j = (np.flatnonzero(s == size) for s in sizes)
        x, y = (v.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).reshape(len(k), int(size)) for v, k in ((a, i), (b, j)))
        norms = [sum((v[:, k] * v[:, k] for k in range(int(size))), np.zeros(len(v))) for v in (x, y)]
        ux, uy = x / np.sqrt(norms[0])[:, None], y / np.sqrt(norms[1])[:, None]
        for at in range(0, len(i), 256):
            p, q = np.nonzero(ux[at : at + 256] @ uy.T >= floor - 1e-9)
            p += at
            dot = sum((x[p, k] * y[q, k] for k in range(int(size))), np.zeros(len(p)))
            sim = np.clip(dot / np.sqrt(norms[0][p] * norms[1][q]), -1.0, 1.0)
            kept = np.flatnonzero(sim >= floor)
            yield pa.array(i[p[kept]]), pa.array(j[q[kept]]), pa.array(sim[kept])


def semantic_top(queries: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, k: int = TOP, itself: bool = True) -> DataFrame:
    """The first 3k items of each query above the floor, one per key, at most k."""
    near = similar(queries, corpus, threshold * FLOOR, itself)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "item"))
    near = near.withColumn("place", first).where(F.col("place") <= 3 * k)
    own = F.row_number().over(Window.partitionBy("query", "key").orderBy("place"))
    near = near.withColumn("own", own).where("own = 1")
    again = F.row_number().over(Window.partitionBy("query").orderBy("place"))
    return near.withColumn("rank", again).where(F.col("rank") <= k).select("query", "item", "key", "sim", "rank")


def semantic_best(queries: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, itself: bool = True) -> DataFrame:
    return similar(queries, corpus, threshold, itself).groupBy("query").agg(F.max_by(F.struct("item", "key", "sim"), F.struct("sim", -F.col("item"))).alias("b")).select("query", "b.*")


def cascade(terms: DataFrame, index: DataFrame, cutoff: float = 90, near: DataFrame | None = None) -> DataFrame:
    """(term, match_kind, confidence, id, n_alternatives): ambiguous or exact, then fuzzy for what is left (by the index ``near`` where one is given), then none."""
    near = index if near is None else near
    own = terms.select("term").distinct().withColumn("key", norm_key(F.col("term")))
    exact = own.join(index, "key", "left").persist()  # so that texts are cut into words once
    rest = exact.where("concept is null and key <> ''").select("key")
    fuzzy = best_matches(fuzzy_matches(rest, near, cutoff)).select(F.col("word_key").alias("key"), F.col("label_key"), "score")
    near = fuzzy.join(near.select(F.col("key").alias("label_key"), F.col("concept").alias("near")), "label_key").select("key", "near", "score")
    joined = exact.join(near, "key", "left")
    kind = F.when(F.col("concept").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("none")
    return joined.select("term", kind.alias("match_kind"), F.when(F.col("concept").isNotNull(), 100.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"), F.coalesce("concept", "near")["id"].alias("id"), F.coalesce("n_concepts", F.lit(0)).alias("n_alternatives"))


def merge_candidates(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of each term's candidates (term, id, source, score, arrival) one per id, the best score and then the first; the best so many."""
    best = candidates.groupBy("term", "id").agg(F.max_by(F.struct("score", "source", "arrival"), F.struct("score", -F.col("arrival"))).alias("b"))
    rows = best.select("term", "id", "b.*")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "arrival", "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def validate_choice(chosen: DataFrame, merged: DataFrame) -> DataFrame:
    """(term, id, accepted): a chosen id that is no candidate is replaced by the top candidate."""
    top = merged.where("rank = 1").select("term", F.col("id").alias("top"))
    real = merged.select("term", "id", F.lit(True).alias("real"))
    rows = chosen.join(real, ["term", "id"], "left").join(top, "term", "left")
    return rows.select("term", F.when(F.col("real"), F.col("id")).otherwise(F.col("top")).alias("id"), F.coalesce("real", F.lit(False)).alias("accepted"))


def lookup(terms: DataFrame, concepts: DataFrame, index: DataFrame, near: DataFrame, cutoff: float = 90, meanings: DataFrame | None = None) -> DataFrame:
    """(term, lang, source, confidence, id): the whole service in one plan; each stage takes what those before it left.

    A number is a code (100); French terms go to the labels, English ones to the names: exact (100), then fuzzy (its ratio); what is
    left to the best of ``meanings`` (term, id, sim), per cent; then ``none``. Blank terms are ``blank``. Terms of neither language try labels, then names.
    """
    own = terms.select("term", "lang").distinct().withColumn("key", norm_key(F.col("term")))
    codes = concepts.select(F.col("id").alias("key"), F.col("id").alias("code_id"))
    names = by_name(concepts).select("key", F.col("concept.id").alias("name_id"))
    labels = index.select("key", F.col("concept.id").alias("label_id"), "is_ambiguous")
    found = own.join(codes, "key", "left").join(labels, "key", "left").join(names, "key", "left")
    french, english = F.col("lang") != "en", F.col("lang") != "fr"
    exact = F.coalesce(F.when(french, F.col("label_id")), F.when(english, F.col("name_id")))
    found = found.withColumn("exact_id", exact).withColumn("code_id", F.when(F.col("key").rlike("^[0-9]+$"), F.col("code_id"))).persist()  # so that texts are cut into words once
    rest = found.where("code_id is null and exact_id is null and key <> ''").select("key", "lang")
    english_names = by_name(concepts).select("key", "concept")
    stages = []
    sides = [(rest.where(french), near.select("key", "concept"))]
    if not (left := rest.where("lang = 'en'")).isEmpty():
        sides.append((left, english_names))
    for side, keys in sides:
        best = best_matches(fuzzy_matches(side.select("key").distinct(), keys, cutoff)).select(F.col("word_key").alias("key"), "label_key", "score")
        best = best.join(keys.select(F.col("key").alias("label_key"), F.col("concept.id").alias("near_id")), "label_key")
        stages.append(side.join(best, "key").select("key", "lang", "near_id", F.col("score").alias("near_score")))
    found = found.join(reduce(DataFrame.unionByName, stages), ["key", "lang"], "left")
    if meanings is None:
        found = found.withColumn("mean_id", F.lit(None).cast("string")).withColumn("sim", F.lit(None).cast("double"))
    else:
        found = found.join(meanings.groupBy("term").agg(F.max_by("id", F.struct("sim", "id")).alias("mean_id"), F.max("sim").alias("sim")), "term", "left")
    ways = (("code", "code_id", F.lit(100.0)), ("exact", "exact_id", F.lit(100.0)), ("fuzzy", "near_id", F.col("near_score")), ("semantic", "mean_id", 100 * F.col("sim")))
    source, score = F.when(F.col("key") == "", "blank"), F.when(F.col("key") == "", 0.0)
    for name, column, value in ways:
        source, score = source.when(F.col(column).isNotNull(), name), score.when(F.col(column).isNotNull(), value)
    named = F.when((F.col("exact_id") == F.col("label_id")) & F.col("is_ambiguous") & F.col("code_id").isNull(), "ambiguous")
    return found.select("term", "lang", F.coalesce(named, source.otherwise("none")).alias("source"), score.otherwise(0.0).alias("confidence"), F.coalesce(*(c for _, c, _ in ways)).alias("id"))


def collect_candidates(terms: DataFrame, concepts: DataFrame, limit: int = LIMIT, near: DataFrame | None = None, cutoff: float = 75, meanings: DataFrame | None = None) -> DataFrame:
    """Candidates of each term, merged: all concepts under its label (100), labels of ``near`` from the cutoff on, ``meanings`` (term, id, sim)
    only for terms without a label, and labels that contain the term only where nothing else is found."""
    own = terms.select("term").distinct().withColumn("key", norm_key(F.col("term"), wide=False)).where("key <> ''")
    under = concepts.where(F.col("fr_label").isNotNull()).select(norm_key(F.col("fr_label"), wide=False).alias("key"), "id", "level").distinct()
    many = under.groupBy("key").agg(F.when(F.countDistinct("id") > 1, "ambiguous").otherwise("exact").alias("source"))
    label = own.join(under, "key").join(many, "key").select("term", "id", "source", F.lit(100.0).alias("score"), F.concat(F.lit("0"), F.col("level").cast("string"), F.col("id")).alias("arrival"))
    found = label
    if near is not None:
        pairs = fuzzy_matches(own.select("key"), near, cutoff).select(F.col("word_key").alias("key"), F.col("label_key"), "score")
        pairs = pairs.join(near.select(F.col("key").alias("label_key"), F.col("concept.id").alias("id")), "label_key")
        found = found.unionByName(own.join(pairs, "key").select("term", "id", F.lit("fuzzy").alias("source"), "score", F.concat(F.lit("1"), F.col("id")).alias("arrival")))
    if meanings is not None:
        left = meanings.join(label.select("term").distinct(), "term", "left_anti")
        found = found.unionByName(left.select("term", "id", F.lit("semantic").alias("source"), (100 * F.col("sim")).alias("score"), F.concat(F.lit("2"), F.col("id")).alias("arrival")))
    none = own.join(found.select("term").distinct(), "term", "left_anti").select("term")
    within = substring_candidates(none, concepts, "fr_label", limit=limit)
    found = found.unionByName(within.select("term", "id", F.lit("substring").alias("source"), "score", F.concat(F.lit("3"), F.col("id")).alias("arrival")))
    best = found.groupBy("term", "id").agg(F.min_by(F.struct("score", "source", "arrival"), F.struct(-F.col("score"), "arrival")).alias("b")).select("term", "id", "b.*")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "arrival"))
    return best.withColumn("rank", place).where(F.col("rank") <= limit).select("term", "id", "source", "score", "rank")


#: Parents and children that a view shows; how many there are stands beside them.
SHOWN = 200


def concept_view(concepts: DataFrame) -> DataFrame:
    """(id, view): what is shown of each concept; a blank label is null, an unknown tier is empty."""
    label = F.nullif(F.trim("fr_label"), F.lit(""))
    name = F.coalesce("name", F.lit(""))
    return concepts.select("id", F.struct("id", name.alias("name"), name.alias("en_label"), "level", F.coalesce("tier", F.lit("")).alias("tier"), label.alias("fr_label")).alias("view"))


def related_views(wanted: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, view): every parent and child of the wanted ids that is a concept, without loops."""
    e, ids = edges.where("parent <> child").select("parent", "child").distinct(), wanted.select("id").distinct()
    sides = [(a, b, kind) for a, b, kind in (("child", "parent", "parent"), ("parent", "child", "child"))]
    up, down = (e.select(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(kind).alias("kind")).join(ids, "id", "left_semi") for a, b, kind in sides)
    return up.unionByName(down).join(concept_view(concepts).withColumnRenamed("id", "other"), "other").select("id", "kind", "view")


def ancestor_views(wanted: DataFrame, concepts: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """(id, ancestors): the views of a concept itself and of what lies up to ``hops`` above it, from the broadest tier on.

    What lies above a parent is gathered once and goes to its children as one list, so neither walks nor their ends meet in the few broadest concepts.
    """
    c = F.col
    step = edges.select(c("child").alias("id"), c("parent").alias("next"))
    view = concept_view(concepts)
    own = F.struct(rank_of(c("view.tier")).alias("rank"), c("view.level").alias("level"), c("view.name").alias("name"), c("id").alias("at"), c("view.tier").alias("tier"), c("view.fr_label").alias("fr_label"))
    nodes = view.select("id", own.alias("own"))
    levels, steps = [wanted.select("id").distinct()], []
    for _ in range(hops):
        steps.append(step.join(levels[-1], "id", "left_semi"))
        levels.append(steps[-1].select(c("next").alias("id")).distinct().persist())  # the ids of parents, which the way up and the way down take

    def numbered(x: Column, copy: Column) -> Column:
        return F.struct(*[x[k].alias(k) for k in ("rank", "level", "name", "at", "tier", "fr_label")], copy.alias("copy"))

    def once(rows: Column) -> Column:
        # Equal elements are neighbours; as a lambda's variable the rows are sorted once.
        return F.element_at(F.transform(F.array(F.array_sort(rows)), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))), 1)

    # Of repeated concepts each copy is an element; an element that several parents bring counts once.
    self_rows = F.transform(F.array_sort(F.collect_list("own")), numbered)
    found = nodes.join(levels[-1], "id", "left_semi").groupBy("id").agg(self_rows.alias("above"))
    for level, up in zip(reversed(levels[:-1]), reversed(steps)):
        kind = found.schema["above"].dataType
        rows = nodes.join(level, "id", "left_semi").select("id", "own", F.lit(None).cast(kind).alias("above"))
        further = up.join(found.select(c("id").alias("next"), "above"), "next").select("id", F.lit(None).alias("own"), "above")
        found = rows.unionByName(further).groupBy("id").agg(once(F.concat(self_rows, F.flatten(F.collect_list("above")))).alias("above"))
    shown = F.transform("above", lambda x: F.struct(x["at"].alias("id"), x["name"].alias("name"), x["name"].alias("en_label"), x["level"].alias("level"), x["tier"].alias("tier"), x["fr_label"].alias("fr_label")))
    return found.select("id", shown.alias("ancestors"))


def concept_views(wanted: DataFrame, concepts: DataFrame, edges: DataFrame, shown: int = SHOWN, hops: int = 6) -> DataFrame:
    """(id, view, n_parents, n_children, parents, children, ancestors, parent_names, ancestor_summary), one row a wanted id that is a concept.

    Parents and children go by level, name and id; the first ``shown`` stand in the row and :func:`related_views` has them all, so a
    concept of many children is no wide row. Ancestors go from the broadest tier to the concept itself; their
    names make the summary. Unknown ids have no row, repeated ones one.
    """
    ids = wanted.select("id").distinct()
    # Dealt by id once: places, counts and lists take the rows where they lie.
    related = related_views(ids, concepts, edges).repartition("id")
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("view.level", "view.name", "view.id"))
    kinds = (("parent", "n_parents", "parents"), ("child", "n_children", "children"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n, _ in kinds]
    first = [F.collect_list(F.when((F.col("kind") == k) & (F.col("place") <= shown), F.struct("place", "view"))) for k, _, _ in kinds]
    lists = [F.transform(F.array_sort(c), lambda x: x["view"]).alias(n) for c, (_, _, n) in zip(first, kinds)]
    near = related.withColumn("place", place).groupBy("id").agg(*counts, *lists)
    above = ancestor_views(ids, concepts, edges, hops)
    rows = concept_view(concepts).join(ids, "id", "left_semi").join(near, "id", "left").join(above, "id", "left")
    none = F.filter("ancestors", lambda x: F.lit(False))
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_parents", "n_children")]
    kinds = [F.coalesce(k, none).alias(k) for k in ("parents", "children")]
    names = lambda c: F.filter(F.transform(c, lambda x: x["name"]), lambda x: x != "")
    rows = rows.select("id", "view", *numbers, *kinds, "ancestors")
    return rows.withColumn("parent_names", names("parents")).withColumn("ancestor_summary", F.nullif(F.array_join(names("ancestors"), " › "), F.lit("")))
