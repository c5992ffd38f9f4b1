"""Mixing sources to target weights as a min-cost flow.

Documents are summed by *membership pattern* (the set of sources that a document belongs to). Tokens flow
from patterns to the quotas of their sources; the first pass over a pattern costs nothing, each further pass
more than the last (convex costs), so nothing is repeated before everything that can serve a quota was used
once. The flow says how much of each pattern goes to which source; documents are then laid out in seeded
order and those that the flow covers are taken. Where a source's part of a pattern ends, the document across the end goes
to the next part, and what then lacks is filled with the next documents that still fit; so a part misses its amount by less than
the smallest of these.

Size: driver memory and the broadcast table follow the number of patterns, at most ``MAX_PATTERNS``
(checked; more raise an error), never the number of documents. A pattern that holds most rows is summed
before the shuffle, and only the documents of the few seeded buckets in which a pass ends are sorted.

Defined results: null sources form a source of their own, sorted last; null texts have size 0; documents of size 0
are never taken; repeated rows are documents of their own; an empty table gives an empty table. Extra columns
are kept; the names that this operator adds replace columns of that name.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.llm.common import discard, draw, stash, word_count

#: Weights of the sources in their order, repeated as needed.
WEIGHTS = (1, 2, 3)
#: Times that a document may be taken.
REPEATS = 3
#: Patterns that the driver routes.
MAX_PATTERNS = 100_000
#: Seeded buckets of a pattern; only those around the end of a source's part are sorted.
BUCKET_BITS = 14
#: Documents behind such an end that may fill what lacks there.
FILLERS = 256


def weighted_targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares of the total by weight, none above ``repeats`` times its source's size.

    The excess is shared again by weight among the others until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    full: set[str | None] = set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        level = rest / open_weight if open_weight else 0.0
        above = {s for s in names if s not in full and weight[s] * level > repeats * sizes[s]}
        if not above:
            return {s: float(repeats * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= above


class Flow:
    """Maximum flow by levels; capacities may grow between calls and found flow stays."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int) -> int:
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(len(self.to) - 2)
        self.out[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def push(self, start: int, end: int) -> None:
        while True:
            level = [-1] * len(self.out)
            level[start] = 0
            queue = deque([start])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] > 0 and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[end] < 0:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, node = [], start
                    continue
                while at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    if self.room[e] > 0 and level[self.to[e]] == level[node] + 1:
                        path.append(e)
                        node = self.to[e]
                        break
                    at[node] += 1
                else:
                    if not path:
                        break
                    level[node] = -1
                    node = self.to[path.pop() ^ 1]


def route(patterns: dict[tuple[str | None, ...], int], targets: dict[str | None, float], repeats: int = REPEATS) -> dict[tuple[str | None, ...], list[tuple[str | None, int]]]:
    """Tokens from each pattern to each of its sources, at least cost.

    Only passes have a cost, and every path uses one pass, so filling quotas as far as the first pass goes, then
    with the second, and so on, each time keeping what flows, is a shortest-path min-cost flow.
    """
    sources = {s: 2 + len(patterns) + i for i, s in enumerate(targets)}
    flow = Flow(2 + len(patterns) + len(sources))
    ins, uses = [], []
    for i, (members, size) in enumerate(patterns.items()):
        ins.append((flow.arc(0, 2 + i, 0), size))
        uses.append([(s, flow.arc(2 + i, sources[s], repeats * size)) for s in members])
    for s, node in sources.items():
        flow.arc(node, 1, round(targets[s]))
    for _ in range(repeats):
        for arc, size in ins:
            flow.room[arc] += size
        flow.push(0, 1)
    return {members: [(s, flow.room[arc ^ 1]) for s, arc in own if flow.room[arc ^ 1]] for members, own in zip(patterns, uses)}


def _local(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """Rows of the driver as a DataFrame. They go as an Arrow table, since for tuples each executor starts Python workers of their own, beside those of the operators."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds)))


def _key(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(members)))


def mix(
    docs: DataFrame,
    members: Column,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = "mix",
    targets: dict[str | None, float] | None = None,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``credits``.

    ``members`` is an array of sources. ``source_size`` and ``target`` are of the first member; ``credits`` names the
    source that each pass over the document counts for. Without ``targets`` they follow ``weights``, where the size
    of a source is that of all documents that belong to it.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        _key(members).alias("pattern"),
        size.cast("long").alias("size"),
        draw(seed, F.col("doc_id")).alias("draw"),
        F.col("doc_id").alias("id"),
    )
    rows = rows.withColumn("bucket", F.shiftright("draw", 32 - BUCKET_BITS).cast("int"))
    sums = stash(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix")
    totals = sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: raise max_patterns and the driver's memory")
    patterns = {tuple(json.loads(r.pattern)): r.words for r in sorted(totals, key=lambda r: r.pattern)}
    sizes: dict[str | None, int] = defaultdict(int)
    for own, words in patterns.items():
        for s in own:
            sizes[s] += words
    goal = targets or weighted_targets(sizes, weights, repeats)
    routed = route(patterns, {s: goal.get(s, 0.0) for s in sizes}, repeats)

    # Where each source's part of the line of passes ends: number of the pass and offset in it.
    facts, marks = [], []
    for own, words in patterns.items():
        name = json.dumps(list(own), ensure_ascii=False, separators=(",", ":"))
        first = own[0] if own else None
        facts.append((name, sizes.get(first, 0), float(goal.get(first, 0.0))))
        end = 0
        for j, (s, amount) in enumerate(routed[own]):
            end += amount
            if words:
                marks.append((name, j, end // words, end % words, s))
    keys = {json.dumps(json.loads(r.pattern), ensure_ascii=False, separators=(",", ":")): r.pattern for r in totals}
    facts = [(keys[k], *x) for k, *x in facts]
    marks = [(keys[k], *x) for k, *x in marks]
    fact = _local(spark, facts, pattern=pa.string(), source_size=pa.int64(), target=pa.float64())
    mark = _local(spark, marks, pattern=pa.string(), part=pa.int32(), **{"pass": pa.int32()}, offset=pa.int64(), source=pa.string())
    plan = _plan(rows, sums, fact, mark)

    rows = rows.join(F.broadcast(plan), "pattern", "left")
    inside = F.coalesce(_inside(F.col("zones"), F.col("bucket")), F.lit(False))
    coarse = rows.where(~inside).withColumn("pos", F.lit(0))
    exact = rows.where(inside).withColumn("pos", F.row_number().over(_in_order()))
    rows = coarse.unionByName(exact)

    def before(k: Column, m: Column) -> Column:
        """Whether pass k over the document lies before the mark or was chosen to fill what lacks there."""
        zone = (F.col("bucket") >= m["bucket"]) & (F.col("bucket") <= m["to"])
        return (k < m["pass"]) | ((k == m["pass"]) & ((F.col("bucket") < m["bucket"]) | zone & ((F.col("pos") <= m["until"]) | F.array_contains(m["chosen"], F.col("pos")))))

    def source_of(k: Column) -> Column:
        return F.transform(F.slice(F.filter("marks", lambda m: before(k, m)), 1, 1), lambda m: m["source"])

    rows = rows.withColumn("credits", F.when((F.col("marks").isNull()) | (F.col("size") == 0), F.expr("cast(array() as array<string>)")).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), source_of))))
    added = ["size", "source_size", "target", "taken", "credits"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return rows.select(*kept, "size", "source_size", "target", (F.size("credits") * F.col("size")).cast("long").alias("taken"), "credits")


def _in_order() -> Window:
    return Window.partitionBy("pattern").orderBy("draw", "id", "size")


def _inside(zones: Column, bucket: Column) -> Column:
    return F.exists(zones, lambda z: (bucket >= z["bucket"]) & (bucket <= z["to"]))


def _plan(rows: DataFrame, sums: DataFrame, fact: DataFrame, mark: DataFrame) -> DataFrame:
    """Per pattern its sizes and marks: the zone of buckets around each, how many of the zone's documents lie before it, and which later ones fill the rest.

    A zone begins with the mark's bucket and ends where ``FILLERS`` more documents are in it; only these documents are sorted.
    """
    by_bucket = Window.partitionBy("pattern").orderBy("bucket")
    line = sums.withColumn("after", F.sum("words").over(by_bucket)).withColumn("before", F.col("after") - F.col("words")).withColumn("docs", F.sum("n").over(by_bucket))
    placed = mark.join(line, "pattern").where((F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("after")))
    placed = placed.select("pattern", "part", "pass", "source", "bucket", (F.col("offset") - F.col("before")).alias("offset"), (F.col("docs") + FILLERS).alias("enough"))
    reach = placed.join(line.select("pattern", F.col("bucket").alias("b"), "docs"), "pattern").where("b >= bucket")
    reach = reach.groupBy("pattern", "part").agg(F.coalesce(F.min(F.when(F.col("docs") >= F.col("enough"), F.col("b"))), F.max("b")).alias("to"))
    placed = stash(placed.join(reach, ["pattern", "part"]).drop("enough"), "mix-marks")
    zones = placed.groupBy("pattern").agg(F.collect_list(F.struct("bucket", "to")).alias("zones"))

    near = rows.select("pattern", "bucket", "draw", "id", "size").join(F.broadcast(zones), "pattern").where(_inside(F.col("zones"), F.col("bucket")))
    near = near.withColumn("pos", F.row_number().over(_in_order())).withColumn("end", F.sum("size").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    near = stash(near.select("pattern", "bucket", "pos", "size", "end"), "mix-zones")
    begins = near.groupBy("pattern", "bucket").agg(F.min(F.col("end") - F.col("size")).alias("begin"))
    own = placed.join(begins, ["pattern", "bucket"]).join(near.withColumnRenamed("bucket", "b"), "pattern").where("b between bucket and to")
    own = own.withColumn("end", F.col("end") - F.col("begin"))
    ends = own.groupBy("pattern", "part").agg(
        F.max(F.when(F.col("end") <= F.col("offset"), F.col("pos"))).alias("until"), (F.max("offset") - F.coalesce(F.max(F.when(F.col("end") <= F.col("offset"), F.col("end"))), F.lit(0))).alias("lack")
    )
    later = own.where("end > offset").withColumn("place", F.row_number().over(Window.partitionBy("pattern", "part").orderBy("pos"))).where(F.col("place") <= FILLERS)
    later = later.groupBy("pattern", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("later"))
    found = placed.join(ends, ["pattern", "part"]).join(later, ["pattern", "part"], "left")

    # In seeded order, each document that still fits; at last the one that comes nearest, if it is nearer than none.
    nothing = F.struct(F.col("lack").alias("rest"), F.expr("cast(array() as array<int>)").alias("chosen"))

    def fill(s: Column, d: Column) -> Column:
        return F.when((d["size"] > 0) & (d["size"] <= s["rest"]), F.struct((s["rest"] - d["size"]).alias("rest"), F.concat(s["chosen"], F.array(d["pos"])).alias("chosen"))).otherwise(s)

    later = F.coalesce("later", F.expr("cast(array() as array<struct<pos:int,size:bigint>>)"))
    found = found.withColumn("filled", F.aggregate(later, nothing, fill))
    rest, chosen = F.col("filled.rest"), F.col("filled.chosen")
    over = F.filter(later, lambda d: (F.abs(d["size"] - rest) < rest) & ~F.array_contains(chosen, d["pos"]))
    last = F.array_min(F.transform(over, lambda d: F.struct(F.abs(d["size"] - rest).alias("by"), d["pos"].alias("pos"))))
    chosen = F.when(last.isNull(), chosen).otherwise(F.concat(chosen, F.array(last["pos"])))
    found = found.select("pattern", F.struct("part", "pass", "bucket", "to", F.coalesce("until", F.lit(0)).alias("until"), chosen.alias("chosen"), "source").alias("mark"))
    found = found.groupBy("pattern").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    plan = stash(fact.join(found, "pattern", "left").join(zones, "pattern", "left"), "mix-plan")
    discard(placed)
    discard(near)
    return plan
