"""Ranked lexical search: WAND in each shard of documents, and a merge of the shards' heaps.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. The weights are integers:
with N documents that have a term, L terms in all, n terms of a document, df documents with a term and
tf its occurrences, w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + 50 n N div L, and a term adds
w * (10^9 tf div (1000 tf + 20 m)) to a document's score.

1. One pass over the documents keeps, of each, its length and the occurrences of the terms asked for (a table in the shared folder).
2. Document frequencies are summed from that table.
3. A task is a shard. It inverts its documents in blocks of ``POSTINGS`` and answers each item on each block by WAND: cursors on the terms' lists stand
   in order of their documents; the pivot is the first whose document could reach the heap's threshold if each list before it gave
   its maximum impact there, and lists before the pivot jump to it, so documents that cannot get into the heap are never scored. Heaps go on from block to block.
4. Shards' heaps, at most ``top`` rows an item each, are merged in two steps, so no task gets an item's rows of all shards at once.

Items are a stated query set: they are asked in blocks of about ``TERMS`` distinct terms, each against all documents, so what is broadcast is bounded.

Defined results: null texts have no terms; rows with the same item id are one item with all their terms; an item without terms, or that no document
meets, has no rows; each row of ``docs`` is a document, also if ids repeat; equal scores go by document id, null last (rows equal in both are interchangeable); empty tables
give an empty table; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import textcuts
from glossa.llm.common import discard, prepare, stash

TOP = 50
#: Distinct (item, term) pairs of a block of items, about.
TERMS = 200_000
#: Postings that a task inverts at a time.
POSTINGS = 1_000_000
#: Parts in which an item's heaps are merged first.
MERGES = 32

INSIDE = textcuts.byte_class("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
INSIDE[0x80:] = True
_END = 2**31 - 1


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of a column of texts in order, and the text each is from."""
    data, offsets = textcuts.raw(texts)
    starts, words = textcuts.runs(textcuts.LOWER[data], INSIDE, offsets)
    return np.searchsorted(offsets, starts, side="right") - 1, words


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct terms of each item."""
    prepare(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = terms_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), words.cast(pa.string())], names=["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(item_id, text).mapInArrow(run, f"item_id {kind}, term string").distinct()


def postings(docs: DataFrame, vocabulary: pa.Array, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a term: its length ``n``, and of the vocabulary's terms their places there and how often they occur."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shipped.value, pa.large_string())
        for batch in batches:
            at, words = terms_of(batch.column(1))
            n = np.bincount(at, minlength=batch.num_rows)
            place = pc.index_in(words, value_set=known)
            found = np.asarray(place.is_valid())
            pairs, often = np.unique(at[found].astype(np.int64) * max(len(known), 1) + np.asarray(place.drop_null()), return_counts=True)
            own, terms = np.divmod(pairs, max(len(known), 1))
            stays = np.flatnonzero(n)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=batch.num_rows)[stays])).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(stays)), pa.array(n[stays], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int32()))],
                names=["doc_id", "n", "terms", "often"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, often array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class List:
    """The documents of a term in a block in ascending order, with an end mark, what the term adds to each, and the most it adds."""

    docs: array
    impacts: array
    most: int


@dataclass
class Block:
    """Some documents, inverted. Documents are numbered in the order of their ids."""

    lists: dict[int, List]
    #: The impact that ``top`` documents of a term's list reach, for terms with as many.
    reached: dict[int, int]


def invert(ids: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, often: np.ndarray, weights: np.ndarray, mean: tuple[int, int], top: int) -> tuple[Block, np.ndarray]:
    """A block from rows of postings, and the row of each number. ``mean``: N and L."""
    rows = np.asarray(pc.array_sort_indices(ids, order="ascending", null_placement="at_end"))
    number = np.empty(len(rows), np.int64)
    number[rows] = np.arange(len(rows))
    m = 50 + (50 * n * mean[0]) // mean[1]
    doc = np.repeat(np.arange(len(n)), sizes)
    tf = often.astype(np.int64)
    impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    doc = number[doc]
    order = np.lexsort((doc, terms))
    doc, terms, impact = doc[order].astype(np.int32), terms[order], impact[order]
    found, begins = np.unique(terms, return_index=True)
    lists, reached = {}, {}
    for term, a, b in zip(found.tolist(), begins.tolist(), np.append(begins[1:], len(terms)).tolist()):
        docs, own = array("i"), array("q")
        docs.frombytes(doc[a:b].tobytes())
        docs.append(_END)
        own.frombytes(impact[a:b].tobytes())
        lists[term] = List(docs, own, int(impact[a:b].max()))
        if b - a >= top:
            reached[term] = int(np.partition(impact[a:b], b - a - top)[b - a - top])
    return Block(lists, reached), rows


def wand(block: Block, terms: list[int], top: int, threshold: int = 1, seen: list | None = None) -> list[tuple[int, int]]:
    """The ``top`` documents of a block with the highest scores of at least ``threshold``, as (score, number), unordered; ties go to low numbers.

    ``threshold`` may be any score that ``top`` known documents reach; ``seen`` gets the documents that are scored.
    """
    lists = [block.lists[t] for t in terms if t in block.lists]
    threshold = max([threshold, 1, *(block.reached[t] for t in terms if t in block.reached)])
    docs, impacts, most = [x.docs for x in lists], [x.impacts for x in lists], [x.most for x in lists]
    at = [0] * len(lists)
    here = [d[0] for d in docs]
    order = sorted(range(len(lists)), key=here.__getitem__)
    heap: list[tuple[int, int]] = []
    while order:
        bound = 0
        for k, x in enumerate(order):
            bound += most[x]
            if bound >= threshold:
                break
        else:
            break
        pivot = here[x]
        if pivot == _END:
            break
        if here[order[0]] == pivot:
            score = 0
            for x in order:
                if here[x] != pivot:
                    break
                place = at[x]
                score += impacts[x][place]
                at[x] = place = place + 1
                here[x] = docs[x][place]
            if seen is not None:
                seen.append(pivot)
            if score >= threshold:
                if len(heap) < top:
                    heapq.heappush(heap, (score, -pivot))
                elif score > heap[0][0]:
                    heapq.heapreplace(heap, (score, -pivot))
                if len(heap) == top:
                    # Later documents of the block have higher numbers, so they must beat the last one.
                    threshold = max(threshold, heap[0][0] + 1)
        else:
            for x in order[:k]:
                if here[x] < pivot:
                    at[x] = place = bisect_left(docs[x], pivot, at[x])
                    here[x] = docs[x][place]
        order.sort(key=here.__getitem__)
    return [(score, -number) for score, number in heap]


def _merged(rows: list[tuple], top: int) -> list[tuple]:
    """The best of (score, id) rows."""
    rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
    return rows[:top]


@dataclass
class Asked:
    """A block of items: their terms by number, the terms' weights, and the corpus's N and L."""

    items: list[list[int]]
    weights: np.ndarray
    mean: tuple[int, int]
    top: int
    heaps: list[list[tuple]] = field(default_factory=list)

    def answer(self, batch: pa.RecordBatch) -> None:
        """Takes documents into the heaps."""
        terms, often = batch.column(2), batch.column(3)
        sizes = np.diff(np.asarray(terms.offsets))
        block, rows = invert(batch.column(0), np.asarray(batch.column(1)), sizes, np.asarray(terms.flatten()), np.asarray(often.flatten()), self.weights, self.mean, self.top)
        for i, own in enumerate(self.items):
            held = self.heaps[i]
            # Another block may hold lower ids, so an equal score counts here.
            found = wand(block, own, self.top, held[-1][0] if len(held) == self.top else 1)
            if found:
                self.heaps[i] = _merged(held + [(score, batch.column(0)[int(rows[number])].as_py()) for score, number in found], self.top)


def _shards(table: DataFrame, asked: Asked) -> DataFrame:
    """The heaps of all shards: item (its number in the block), doc_id, score."""
    shipped = table.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Asked(shipped.value.items, shipped.value.weights, shipped.value.mean, shipped.value.top)
        own.heaps = [[] for _ in own.items]
        held: list[pa.RecordBatch] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTINGS:
                own.answer(pa.concat_batches(held))
                held, size = [], 0
        if held:
            own.answer(pa.concat_batches(held))
        if kind is not None:
            rows = [(i, doc, score) for i, heap in enumerate(own.heaps) for score, doc in heap]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"]
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, terms_a_block: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    pairs = stash(item_terms(items), "item-terms")
    n_blocks = max(1, -(-pairs.count() // terms_a_block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    answers = [_answer(docs, pairs.where(F.col("block") == k).drop("block"), top) for k in range(n_blocks)]
    discard(pairs)
    return reduce(DataFrame.unionByName, answers)


def _answer(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """One block of items against all documents, written."""
    spark = docs.sparkSession
    kinds = [pairs.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    rows = pairs.orderBy("item_id", "term").collect()
    ids = list(dict.fromkeys(r.item_id for r in rows))
    place = {v: i for i, v in enumerate(ids)}
    words = sorted({r.term for r in rows})
    number = {w: i for i, w in enumerate(words)}
    own: list[list[int]] = [[] for _ in ids]
    for r in rows:
        own[place[r.item_id]].append(number[r.term])
    table = stash(postings(docs, pa.array(words, pa.string())), "postings")
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(words))], np.int64)
    shards = _shards(table, Asked(own, weights, (n_docs, max(n_terms, 1)), top))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))
    best = _best(_best(shards.withColumn("part", part), ["item", "part"], top).drop("part"), ["item"], top)
    # As many rows as the block has items, which are bounded.
    named = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"item int, item_id {kinds[0]}")
    out = stash(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "answers")
    discard(table)
    return out


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counts CROSS JOIN corpus GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id) CROSS JOIN corpus
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
