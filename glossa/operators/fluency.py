"""Corpus BLEU and chrF from per-row sufficient statistics.

All statistics of a pair of lines are computed where the lines are (one Arrow UDF, no shuffle of n-grams); a corpus, a document or
a bootstrap sample is a sum of them, so partial aggregation applies, and the score is a formula over ten
or eighteen sums in Spark's own expressions.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from glossa.functions.text import fluency_text

ORDERS = 4
CHAR_ORDERS, BETA = 6, 2
#: Bytes of text that are cut and counted at a time; the arrays take some thirty times as much.
COUNTED = 1 << 20


def tokens_13a(text: Column) -> Column:
    """The international tokenisation of mteval 13a: entities, then marks apart from words, then white space."""
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, new)
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


#: The white space of Java's ``(?U)\\s``.
_TRAILING = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


_WHITE, _DIGIT, _POINT = _class("\t\n\x0b\f\r "), _class("0123456789"), _class(".,")
_SIGN = _class("{|}~[\\]^_`!\"#$%&()*+:;<=>?@/")


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of :func:`tokens_13a` for a whole column: the row of each, and a number that equal tokens share.

    Of a run of points and commas each is a token, but for the last one before a digit: it stays with the digit where the pattern's pairs of
    "no digit, mark" leave it out, after a digit in runs of odd length, after anything else in runs of even length.
    """
    texts = pc.utf8_rtrim(texts, characters=_TRAILING)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        texts = pc.replace_substring(texts, old, new)
    # A space between texts, and at both ends, so that no place lacks a neighbour.
    none, space = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
    texts = pc.binary_join_element_wise(pa.concat_arrays([pa.array([""], texts.type), texts]), none, space)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1])
    white, digit, point, alone = _WHITE[data], _DIGIT[data], _POINT[data], _SIGN[data]
    alone |= point
    first, last = np.flatnonzero(point[1:] & ~point[:-1]) + 1, np.flatnonzero(point[:-1] & ~point[1:])
    stays = digit[last + 1] & (digit[first - 1] == ((last - first) % 2 == 0))
    alone[last[stays]] = False
    dash = np.flatnonzero(data == 0x2D)
    alone[dash[digit[dash - 1]]] = True
    begins = ~white
    begins[1:] &= white[:-1] | alone[1:] | alone[:-1]
    starts = np.flatnonzero(begins)
    kept = ~white
    places = np.append(np.cumsum(kept)[starts] - 1, kept.sum())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[kept])])
    return np.searchsorted(offsets, starts, "right") - 2, words.dictionary_encode().indices.to_numpy()


def _dense(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy()


def _counted(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """A row of statistics for each pair."""
    n = len(hyp)
    row, code = _cut(pa.concat_arrays([hyp, ref]))
    length = np.bincount(row, minlength=2 * n)
    out = np.zeros((n, 2 + 2 * ORDERS), np.int64)
    out[:, 0], out[:, 1] = length[:n], length[n:]
    base = int(code.max(initial=0)) + 1
    # An n-gram is numbered by its first n - 1 tokens and its last one, a single token by its pair of texts and itself. N-grams go on only from
    # those that both sides have.
    at, gram = np.arange(len(row)), row % max(n, 1)
    for order in range(1, ORDERS + 1):
        out[:, 1 + 2 * order] = np.maximum(length[:n] - order + 1, 0)
        end = at + order - 1
        inside = end < len(row)
        inside[inside] = row[end[inside]] == row[at[inside]]
        at, end = at[inside], end[inside]
        gram = _dense(gram[inside].astype(np.int64) * base + code[end])
        own = row[at] < n
        size = int(gram.max(initial=-1)) + 1
        both = np.minimum(np.bincount(gram[own], minlength=size), np.bincount(gram[~own], minlength=size))
        pair = np.zeros(size, np.int64)
        pair[gram] = row[at] % max(n, 1)
        out[:, 2 * order] = np.bincount(pair, weights=both, minlength=n).astype(np.int64)
        met = both[gram] > 0
        at, gram = at[met], gram[met]
    return out


@F.arrow_udf(ArrayType(LongType()))
def _bleu_stats(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    hyp, ref = hyp.cast(pa.large_string()), ref.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(hyp).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(ref).to_numpy(zero_copy_only=False))
    parts, at = [np.zeros((0, 2 + 2 * ORDERS), np.int64)], 0
    while at < len(hyp):
        to = max(at + 1, int(np.searchsorted(ends, COUNTED + (ends[at - 1] if at else 0), "right")))
        parts.append(_counted(hyp.slice(at, to - at), ref.slice(at, to - at)))
        at = to
    rows = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


@F.pandas_udf(ArrayType(LongType()))
def _chrf_stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    out = []
    for h, r in zip(hyp, ref):
        row = []
        for n in range(1, CHAR_ORDERS + 1):
            a, b = Counter(h[i : i + n] for i in range(len(h) - n + 1)), Counter(r[i : i + n] for i in range(len(r) - n + 1))
            total = max(len(r) - n + 1, 0)
            row += [max(len(h) - n + 1, 0) if total else 0, total, sum(min(c, b[g]) for g, c in a.items() if g in b)]
        out.append(row)
    return pd.Series(out)


def with_bleu_stats(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """``pairs`` with ``stats``: lengths of both in the tokens of :func:`tokens_13a`, then matches and totals of each order."""
    return pairs.withColumn("stats", _bleu_stats(fluency_text(F.col(hyp)), F.coalesce(ref, F.lit(""))))


def with_chrf_stats(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)\s+", "")

    return pairs.withColumn("stats", _chrf_stats(bare(fluency_text(F.col(hyp))), bare(F.coalesce(ref, F.lit("")))))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]


def bleu_of(s: list[Column]) -> Column:
    """From the ten sums: exponential smoothing of empty orders, brevity penalty, geometric mean."""
    zeros, logs, dead = F.lit(0), F.lit(0.0), F.lit(False)
    some = F.lit(False)
    for n in range(ORDERS):
        match, total = s[2 + 2 * n], s[3 + 2 * n]
        empty = (match == 0) & (total > 0)
        zeros = zeros + F.when(empty, 1).otherwise(0)
        share = F.when(empty, 100.0 / (F.pow(F.lit(2.0), zeros) * F.greatest(total, F.lit(1)))).otherwise(100.0 * match / F.greatest(total, F.lit(1)))
        dead = dead | (total == 0)
        some = some | (match > 0)
        logs = logs + F.when(total > 0, F.ln(F.greatest(share, F.lit(1e-300)))).otherwise(0.0)
    brevity = F.when(s[0] >= s[1], 1.0).when(s[0] == 0, 0.0).otherwise(F.exp(1 - s[1] / F.greatest(s[0], F.lit(1))))
    return F.when(some & ~dead, brevity * F.exp(logs / ORDERS)).otherwise(0.0)


def chrf_of(s: list[Column]) -> Column:
    """From the eighteen sums: precision and recall averaged over the orders that both sides have, then F with beta 2."""
    used, precision, recall = F.lit(0), F.lit(0.0), F.lit(0.0)
    for n in range(CHAR_ORDERS):
        hyp, ref, match = s[3 * n], s[3 * n + 1], s[3 * n + 2]
        both = (hyp > 0) & (ref > 0)
        used = used + F.when(both, 1).otherwise(0)
        precision = precision + F.when(both, match / F.greatest(hyp, F.lit(1))).otherwise(0.0)
        recall = recall + F.when(both, match / F.greatest(ref, F.lit(1))).otherwise(0.0)
    n = F.greatest(used, F.lit(1))
    p, r = precision / n, recall / n
    return F.when((used > 0) & (p + r > 0), 100.0 * (1 + BETA**2) * p * r / F.greatest(BETA**2 * p + r, F.lit(1e-300))).otherwise(0.0)


def corpus_bleu(pairs: DataFrame, *by: str) -> DataFrame:
    n = 2 + 2 * ORDERS
    sums = with_bleu_stats(pairs).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_sums(n))
    return sums.select(*by, "n", bleu_of([F.coalesce(f"s{i}", F.lit(0)) for i in range(n)]).alias("bleu"))


def corpus_chrf(pairs: DataFrame, *by: str) -> DataFrame:
    n = 3 * CHAR_ORDERS
    sums = with_chrf_stats(pairs).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_sums(n))
    return sums.select(*by, "n", chrf_of([F.coalesce(f"s{i}", F.lit(0)) for i in range(n)]).alias("chrf"))


def sentence_chrf(pairs: DataFrame) -> DataFrame:
    return with_chrf_stats(pairs).withColumn("chrf", chrf_of([F.col("stats")[i] for i in range(3 * CHAR_ORDERS)])).drop("stats")


def macro(scores: DataFrame, metric: str) -> DataFrame:
    """Mean over groups; NaN without any."""
    return scores.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg(metric), F.lit(float("nan"))).alias(metric))


def concatenated(pairs: DataFrame, group: str, order: str, sep: str = " ") -> DataFrame:
    """One line per group: hypotheses and references joined in order."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fluency_text(F.col("hyp")).alias("hyp"), F.col("ref").alias("ref"))))
    rows = pairs.groupBy(group).agg(own.alias("own"))
    return rows.select(group, *[F.array_join(F.col("own")[k], sep).alias(k) for k in ("hyp", "ref")])
