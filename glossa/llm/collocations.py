"""Phrase collocation mining: n-grams as rows, counted by hash aggregation, scored against their parts.

Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and pieces into words ``[^\\x20\\x09]+``; phrases lie within
pieces. All is counted per language (null: ``und``).

1. ``grams``: all 1..max_n-grams become rows (language, phrase, count); each task adds up the equal ones of ``BLOCK`` bytes of text before the shuffle, and
   a hash aggregation adds up the rest. Length by length: a phrase reaches ``least`` occurrences only if both phrases that lack one of its end words
   do, so n-grams that hold a rarer one can't be candidates nor parts of them and aren't sent. Which are rare is looked up in a bit map of ``BITS`` bits; chance
   hits there let a rare n-gram through to the exact count, so nothing is lost and the map's size doesn't grow.
2. ``scored``: each cut of a candidate of at least two words is joined with the counts of its two parts; the score floor(10^6 a a / (l r)) is exact in
   Decimal(38, 0), and a candidate keeps its lowest cut.
3. ``maximal``: an anti-join drops candidates within a one-word extension that has at least half of their occurrences. Longer extensions need no
   look: their one-word parts occur at least as often.
4. ``ranked``: the first ``top`` of a language, in two steps, so that no task sorts all phrases of a language.

Defined results: null texts are empty; repeated rows count again; a language without candidates has no rows; ties go by score, count and
the phrase's UTF-8 bytes; texts of any length are cut into blocks at the ends of pieces, and a piece longer than a block is one block; empty tables give an empty table; extra columns play no part, whatever their names. Counts of up to 10^15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import textcuts
from glossa.llm.common import discard, prepare, stash

MAX_N, LEAST, TOP = 3, 10, 2000
#: Per cent of a candidate's occurrences that a longer one must have to replace it.
SHARE = 50
#: Bytes of text in which a task adds up equal n-grams.
BLOCK = 6 << 20
#: Bits of the map of n-grams that are frequent enough: 16 MB.
BITS = 1 << 27
#: Parts of a language that are ranked on their own first.
PARTS = 32

SEPARATOR = textcuts.byte_class(".,;:!?\n\x0b\x0c\r")
WORD = ~(SEPARATOR | textcuts.byte_class(" \t"))


def bit_of(lang: str, phrases: list[str]) -> np.ndarray:
    """The place of n-grams in a bit map."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases)) % np.uint64(BITS)


class Frequent:
    """A bit map of n-grams; never wrong about one that was entered."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, lang: str, phrases: pa.Array) -> np.ndarray:
        bit = bit_of(lang, phrases.to_pylist())
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def frequent(counts: DataFrame, least: int) -> np.ndarray:
    """The map of all n-grams with ``least`` occurrences, of fixed size whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.zeros(batch.num_rows, np.uint64)
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                bit[at] = bit_of(lang, batch.column(1).take(pa.array(at)).to_pylist())
            word = (bit >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    rows = counts.where(F.col("f") >= least).select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
    return out


def cut(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bytes in blocks of about a size that end where pieces end."""
    ends = np.flatnonzero(SEPARATOR[data]) + 1
    begin = 0
    while begin < len(data):
        at = np.searchsorted(ends, begin + size)
        end = int(ends[at]) if at < len(ends) else len(data)
        yield data[begin:end]
        begin = end


def grams(data: np.ndarray, n: int, lang: str, known: Frequent | None) -> tuple[pa.Array, np.ndarray]:
    """The distinct n-grams of lower-cased bytes, and their counts; from two words on only those whose two (n - 1)-grams ``known`` holds."""
    starts, words = textcuts.runs(data, WORD)
    if len(words) < n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    piece = np.cumsum(SEPARATOR[data], dtype=np.int32)[starts]
    #: Where the current grams begin (places of words), and the number of each among the distinct ones.
    place, counts = np.arange(len(codes)), np.bincount(codes, minlength=len(names))
    gram = codes
    for size in range(2, n + 1):
        good = known.holds(lang, names) if size == n else np.ones(len(names), bool)
        # Grams of ``size`` words: one that begins here and one that begins a word later, both of size - 1 words and within one piece.
        follows = np.flatnonzero((place[1:] == place[:-1] + 1) & good[gram[1:]] & good[gram[:-1]])
        follows = follows[piece[place[follows]] == piece[place[follows] + size - 1]]
        pair = gram[follows] * len(names) + gram[follows + 1]
        place = place[follows]
        last = codes[place + size - 1]
        found, at, gram, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        left = names.take(pa.array(found // max(len(names), 1)))
        names = pc.binary_join_element_wise(left, coded.dictionary.take(pa.array(last[at])), pa.scalar(" ", pa.large_string()))
    return names, counts


def counted(docs: DataFrame, n: int, known: np.ndarray | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, f of the n-grams of all texts; with ``known``, of those that may be frequent."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = None if known is None else spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None if shipped is None else Frequent(shipped.value)
        for batch in textcuts.blocks(batches, 1, BLOCK):
            langs = batch.column(0)
            for own in langs.unique().to_pylist():
                data, offsets = textcuts.raw(batch.column(1).filter(pc.equal(langs, own)))
                # A line feed ends pieces, so texts may be joined by it.
                data = textcuts.LOWER[np.insert(data, offsets[1:-1], 0x0A)]
                for part in cut(data, BLOCK):
                    phrases, counts = grams(part, n, own, found)
                    for k in range(0, len(phrases), 1 << 16):
                        some = phrases.slice(k, 1 << 16).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([own] * len(some), pa.string()), some, pa.array(counts[k : k + (1 << 16)], pa.int64())], names=["lang", "phrase", "c"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, phrase string, c long")
    return rows.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def scored(candidates: DataFrame, parts: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """Candidates (lang, phrase, f) with the counts and the score of their lowest cut; ``parts`` has the counts of all their parts."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("w", words).select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = "(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))"
    cuts = cuts.withColumn("score", F.expr(exact).cast("long"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def maximal(phrases: DataFrame, candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """``phrases`` (lang, phrase, a) that no one-word extension among ``candidates`` (lang, phrase, f) replaces."""
    w = F.split("phrase", " ")
    longer = candidates.where(F.size(w) > 2).withColumn("w", w)
    inner = F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))
    inner = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    gone = inner.join(phrases, ["lang", "phrase"]).where(F.lit(100) * F.col("longer") >= F.lit(share) * F.col("a")).select("lang", "phrase")
    return phrases.join(gone, ["lang", "phrase"], "left_anti")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    def first(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    return first(first(parts, "lang", "part").drop("part"), "lang").withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``max_n`` words."""
    singles = stash(counted(docs, 1), "grams-1")
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [singles.where(F.col("f") >= least)]
    for n in range(2, max_n + 1):
        levels.append(stash(counted(docs, n, frequent(levels[-1], least)).where(F.col("f") >= least), f"grams-{n}"))
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionByName(level)
    known = stash(maximal(scored(candidates, levels[0].unionByName(candidates), max_n), candidates, share), "phrases")
    for level in levels[1:]:
        discard(level)
    out = stash(ranked(known, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(known)
    discard(singles)
    return out


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), occurrences AS (
    SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM lists CROSS JOIN (VALUES (1), (2), (3)) AS sizes(size)
), counts AS (
    SELECT lang, size, phrase, count(*)::BIGINT AS f FROM occurrences GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10
), keyed AS (
    SELECT concat_ws(chr(31), lang, phrase) AS part, f FROM counts
), cuts AS (
    SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) AS c
    JOIN keyed AS x ON x.part = concat_ws(chr(31), c.lang, array_to_string(c.w[1:k], ' '))
    JOIN keyed AS y ON y.part = concat_ws(chr(31), c.lang, array_to_string(c.w[k + 1:], ' '))
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
    SELECT lang, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:size], ' ')]) AS phrase, a AS longer FROM candidates WHERE size > 2
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
    FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_ AS i WHERE i.lang = lowest.lang AND i.phrase = lowest.phrase AND 100 * i.longer >= 50 * lowest.a)
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
