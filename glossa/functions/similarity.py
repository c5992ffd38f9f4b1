"""String and vector similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``a`` at once in the bits of an integer."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        match = rows & places.get(ch, 0)
        rows = (rows + match | rows - match) & full
    return len(a) - rows.bit_count()


#: Equal characters of a string that are counted one by one; words that meet labels at once; pairs whose subsequences are found at once.
REPEATS, AT_ONCE, PAIRS = 3, 256, 1 << 16


class LabelMasks:
    """Labels by length, with the places of each character as bits, so that a word meets all labels of a length band at once."""

    def __init__(self, labels: list[str]):
        self.labels = sorted((x for x in labels if x), key=len)
        self.length = np.array([len(x) for x in self.labels], np.int64)
        self.sizes = np.unique(self.length)
        self.short = int(np.searchsorted(self.length, 64, "right"))  # longer labels do not fit a word of bits
        self.code = {ch: i for i, ch in enumerate(sorted({ch for x in self.labels[: self.short] for ch in x}))}
        self.places = np.zeros((len(self.code) + 1, self.short), np.uint64)  # the last row is of characters that no label has
        self.has = np.zeros(self.short, np.uint64)
        for i, label in enumerate(self.labels[: self.short]):
            for k, ch in enumerate(label):
                self.places[self.code[ch], i] |= np.uint64(1 << k)
                self.has[i] |= np.uint64(1 << ord(ch) % 64)
        self.bag, self.more = self._bags(self.labels[: self.short])

    def _bags(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(of each string a row with a one for the first, second and third of each character, how many characters are beyond these)."""
        bag, more = np.zeros((len(strings), REPEATS * len(self.code)), np.float32), np.zeros(len(strings), np.float32)
        for i, s in enumerate(strings):
            for ch, c in Counter(s).items():
                if (at := self.code.get(ch)) is not None:
                    bag[i, REPEATS * at : REPEATS * at + min(c, REPEATS)] = 1
                    more[i] += max(c - REPEATS, 0)
        return bag, more

    def matches_of(self, words: list[str], cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``words``, places in ``labels``, ratios) of all pairs that reach the cutoff; many words of a length at once, as one word takes longer to call for than to compare."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, members in by_length.items():
            fits = np.flatnonzero(np.minimum(n, self.sizes) * 200 >= cutoff * (n + self.sizes))
            if not fits.size:
                continue
            low, high = np.searchsorted(self.length, self.sizes[fits[0]], "left"), np.searchsorted(self.length, self.sizes[fits[-1]], "right")
            end = min(high, self.short)
            for at in range(0, len(members), AT_ONCE):
                own = np.array(members[at : at + AT_ONCE])
                if low < end:
                    for a, b, ratio in self._near([words[i] for i in own], n, slice(low, end), cutoff):
                        yield own[a], b, ratio
                for i in own if high > self.short else ():
                    for j in range(max(low, self.short), high):
                        if (score := 200.0 * _common(words[i], self.labels[j]) / (n + len(self.labels[j]))) >= cutoff:
                            yield np.array([i]), np.array([j]), np.array([score])

    def _near(self, words: list[str], n: int, band: slice, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of words of ``n`` characters and labels of the band: first by the characters that they share, then by their common subsequence."""
        bag, more = self._bags(words)
        most = bag @ self.bag[band].T + np.minimum(more[:, None], self.more[band])
        a, b = np.nonzero(200.0 * most >= cutoff * (n + self.length[band]) - 1e-3)
        b += band.start
        codes = np.array([[self.code.get(ch, len(self.code)) for ch in w] for w in words])
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            rows = np.full(len(i), ~np.uint64(0))
            for k in range(n):
                match = rows & self.places[codes[i, k], j]
                rows = rows + match | rows - match
            ratio = 200.0 * np.bitwise_count(~rows) / (n + self.length[j])
            kept = np.flatnonzero(ratio >= cutoff)
            yield i[kept], j[kept], ratio[kept]

    def matches(self, word: str, cutoff: float) -> Iterator[tuple[str, float]]:
        """(label, ratio) of all labels whose ratio to the word reaches the cutoff."""
        n = len(word)
        fits = np.flatnonzero(np.minimum(n, self.sizes) * 200 >= cutoff * (n + self.sizes))
        if not fits.size:
            return
        low, high = np.searchsorted(self.length, self.sizes[fits[0]], "left"), np.searchsorted(self.length, self.sizes[fits[-1]], "right")
        own = slice(low, min(high, self.short))
        # Characters that the other string lacks can't be common; characters that share a bit only weaken this.
        bits = 0
        for ch in word:
            bits |= 1 << ord(ch) % 64
        mine, has, m = np.uint64(bits), self.has[own], self.length[own]
        most = np.minimum(n - np.bitwise_count(mine & ~has).astype(np.int64), m - np.bitwise_count(has & ~mine))
        own = low + np.flatnonzero(200.0 * most >= cutoff * (n + m) - 1e-6)
        rows = np.full(len(own), ~np.uint64(0))
        for ch in word:
            if ch in self.code:
                match = rows & self.places[self.code[ch], own]
                rows = rows + match | rows - match
        ratio = 200.0 * np.bitwise_count(~rows) / (n + self.length[own])
        for i in np.flatnonzero(ratio >= cutoff):
            yield self.labels[own[i]], float(ratio[i])
        for i in range(max(low, self.short), high):
            if (score := 200.0 * _common(word, self.labels[i]) / (n + len(self.labels[i]))) >= cutoff:
                yield self.labels[i], score


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * _common(x, y) / (len(x) + len(y)) for x, y in zip(a, b)])


def indel_ratio(a: Column, b: Column) -> Column:
    """100 for equal strings, 200 * LCS / (|a| + |b|) in general. Apply it to distinct candidate pairs."""
    return _ratio(a, b)


def indel_ratio_native(a: Column, b: Column) -> Column:
    """The same without Python, for short strings: one row of the table per character, by nested folds."""
    left, right = F.split(a, ""), F.split(b, "")
    left, right = F.filter(left, lambda x: x != ""), F.filter(right, lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            same = F.element_at(right, j) == x
            value = F.when(same, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        steps = F.when(F.size(right) > 0, F.sequence(F.lit(1), F.size(right))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(left, zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs / total)


def contains_ratio(label: Column, needle: Column) -> Column:
    """Best window ratio of a needle that the label contains: 100; null otherwise."""
    return F.when(F.contains(label, needle), 100.0)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def with_direction(rows: DataFrame, vector: Column, name: str) -> DataFrame:
    """``rows`` with the vector in doubles over its length; null for zero, null and non-finite ones.

    Vector and length are columns of their own and the length is repeated as an array, as a lambda would compute them again for each place.
    """
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x))
    wide = rows.withColumn("_vector", vector.cast("array<double>")).withColumn("_norm", norm)
    own = F.zip_with("_vector", F.array_repeat("_norm", F.size("_vector")), lambda x, n: x / n)
    return wide.withColumn(name, F.when((F.col("_norm") > 0) & (F.col("_norm") < float("inf")), own)).drop("_vector", "_norm")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: A lexical embedder that needs no model: how often each of these letters stands in the lower-cased text.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(ArrayType(DoubleType()))
def _letters(low: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)[97:123].astype(np.float64) for s in low])


def letter_counts(text: Column) -> Column:
    """In one pass over the bytes, as those of other characters are no letters; one expression a letter takes 26 passes."""
    return _letters(F.lower(F.coalesce(text, F.lit(""))))
