"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs hold a conversation several times: after each turn a snapshot of all turns so far. Every prefix of every conversation
gets a rolling hash (the exclusive-or of the hashes of position, role and text of its turns, 128 bits); a conversation whose
whole hash is the hash of a shorter prefix of another is a snapshot of it, and an anti-join removes it.
Equal conversations are one class, kept under its smallest id. What remains is rendered turn by turn.

Skew: turns are sorted by range over the whole log and hashed in blocks, one a range partition, whose sums carry over in a small
table; so one conversation, one turn number or the rows without one may hold any share of the rows. Prefixes are made distinct before
the join, so a first turn that most conversations share is one row. Rendering makes one row per ``PART`` turns of a
conversation: the result has a row for each (conversation, part), of a size that is bounded by the turns' own.

Defined results: rows without a conv_id belong to no conversation and are left out; a null turn stands last; a null role is rendered
as ``unknown`` and a null text as empty; a repeated row counts once; equal turn numbers are ordered
by role, then by the md5 of the text; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.llm.common import discard, stash

#: Turns of a conversation in one row of the result.
PART = 256

START, END = "<|im_start|>", "<|im_end|>"
KEY = ["conv_id", "turn", "role", "mark"]


def rendered(role: Column, text: Column) -> Column:
    """One turn; marks inside a text are broken up, so that a text can't open or end a turn."""
    safe = F.replace(text, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), role, F.lit("\n"), safe, F.lit(f"{END}\n"))


def _rows(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.md5(text).alias("mark"), text.alias("text")
    )


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, block, place, turns): each distinct turn with its place; written, so that blocks stay as they are."""
    rows = _rows(turns).select(*KEY).distinct()
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_last(), "role", "mark").withColumn("block", F.spark_partition_id())
    rows = stash(rows, "turns")
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "mark")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    own = rows.withColumn("rank", F.row_number().over(in_block)).join(sizes, ["conv_id", "block"])
    out = stash(own.select(*KEY, "block", (F.col("offset") + F.col("rank")).alias("place"), "turns"), "placed")
    discard(rows)
    return out


def prefixes(own: DataFrame) -> DataFrame:
    """(conv_id, place, turns, h1, h2): each prefix of each conversation, by its number of turns."""
    hashed = own.select("conv_id", "block", "place", "turns", *(F.xxhash64(F.lit(k), "place", "role", "mark").alias(f"e{k}") for k in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    sums = sums.select("conv_id", "block", *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"p{k}") for k in (1, 2)))
    rolling = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    joined = hashed.join(sums, ["conv_id", "block"])
    return joined.select("conv_id", "place", "turns", *(F.bit_xor(f"e{k}").over(rolling).bitwiseXOR(F.col(f"p{k}")).alias(f"h{k}") for k in (1, 2)))


def maximal(found: DataFrame) -> DataFrame:
    """(conv_id, turns, copies): conversations that are no snapshot of a longer one, equal ones once."""
    whole = found.where(F.col("place") == F.col("turns")).groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = found.where(F.col("place") < F.col("turns")).select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("turns"), "copies")


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, part (number of a run of ``PART`` turns), n_turns, n_copies, text."""
    own = placed(turns)
    found = stash(prefixes(own), "prefixes")
    kept = stash(maximal(found), "kept")
    discard(found)
    told = own.join(kept.select("conv_id", "copies"), "conv_id").select(
        *KEY[:1], F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("late"), *KEY[2:], "place", "turns", "copies"
    )
    rows = _rows(turns).withColumn("late", F.col("turn").isNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    rows = rows.join(told, [*KEY, "late"]).withColumn("part", F.floor((F.col("place") - 1) / PART).cast("long"))
    one = F.struct("place", "role", "text")
    grouped = rows.groupBy("conv_id", "part", "turns", "copies").agg(F.array_sort(F.collect_set(one)).alias("own"))
    return grouped.select(
        "conv_id",
        "part",
        F.col("turns").alias("n_turns"),
        F.col("copies").alias("n_copies"),
        F.array_join(F.transform("own", lambda x: rendered(x["role"], x["text"])), "").alias("text"),
    )


def sample_log(turns: DataFrame) -> DataFrame:
    """A log with snapshots, as the table has none: each conversation (id 3c), it after its first answer (3c + 1) and before its last turn (3c + 2).

    At most three rows a turn, whatever a conversation's length.
    """
    ends = turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"), F.max("turn").alias("last"))
    cut = turns.select("conv_id", "turn", "role", "text").join(ends, "conv_id")
    first = cut.where("turn <= answer").select((3 * F.col("conv_id") + 1).alias("conv_id"), "turn", "role", "text")
    most = cut.where("turn < last").select((3 * F.col("conv_id") + 2).alias("conv_id"), "turn", "role", "text")
    return turns.select((3 * F.col("conv_id")).alias("conv_id"), "turn", "role", "text").unionByName(first).unionByName(most)


ORACLE_SQL = r"""
WITH ends AS (
  SELECT conv_id, min(CASE WHEN role = 'assistant' THEN turn END) AS answer, max(turn) AS final FROM conversations GROUP BY conv_id
), log AS (
  SELECT 3 * conv_id AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT 3 * conv_id + 1, turn, role, text FROM conversations JOIN ends USING (conv_id) WHERE turn <= answer
  UNION ALL SELECT 3 * conv_id + 2, turn, role, text FROM conversations JOIN ends USING (conv_id) WHERE turn < final
), rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM log WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
    string_agg(md5(role || chr(31) || text), ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, md5(text))
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM placed WHERE place = turns GROUP BY prefix
), kept AS (
  SELECT conv_id, n_copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM placed WHERE place < turns)
)
SELECT conv_id, (place - 1) // 256 AS part, any_value(turns) AS n_turns, any_value(n_copies) AS n_copies,
  string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part
"""
