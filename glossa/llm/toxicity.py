"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows of
``WINDOW`` words; each is compressed with the ordinary dictionary and with both, and a window counts as a hit if the
toxic dictionary saves at least a calibrated number of bytes. A logistic curve over the hits of a whole text, fitted on
texts that the dictionaries were not trained on (three folds), gives the score; 0.5 is its calibrated threshold.

Spelling: a saved match costs zstandard about as much as five plain letters, so short words save nothing in plain text
(the README has figures). Texts, for training and for scoring, are therefore spelt with wide letters: each word as a code of ``CODE``
bytes of itself and of each of its beginnings, so inflected and compound forms share codes.

Training: in each fold zstandard trains a dictionary on the toxic and one on the ordinary texts (whole texts, each word
once). An entry of a toxic dictionary stays if it is calibrated on the other folds: it must let texts there save bytes, in a share
of the toxic ones ``TIMES`` as large as of the ordinary ones.

Training is bounded: at most ``SAMPLE`` labelled texts of a class, drawn by a hash of their ids; each is read whole.
The model is below 1 MB, whatever the corpus.

Defined results: null and empty texts have no windows and get the curve's value there; rows without an id count as
id ''; repeated labels of a document count once, toxic if any says so; null labels play no part; n texts with the same words in one
class and fold weigh 1 + log2(n) / 2 in training, so one text's copies don't make its words typical; without labels
of both classes every score is the share of toxic labels (0 without any); an empty table gives an empty table. Extra columns are kept;
``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, draw, prepare, release, stash

WORDS = re.compile(r"[^\W\d_]+")
#: Words of a window.
WINDOW = 8
#: Letters of the beginnings of a word that have a code, and bytes of a code.
SHORTEST, LONGEST = 3, 10
CODE, CODE_OF = 8, xxhash.xxh3_64_digest
#: Bytes that the toxic dictionary must save for a hit: the one of these under which the curve fits best. Below a code (8) chance in the
#: choice of matches saves as much.
GAINS = (8, 10, 14)
#: Labelled texts of a class that are learnt from.
SAMPLE = 3000
FOLDS = 3
#: Bytes of a fold's toxic and ordinary dictionary as zstandard trains them, and of a segment that training chooses.
TOXIC_SIZE, ORDINARY_SIZE, SEGMENT = 100_000, 34_000, 16
#: An entry stays if this share of the other folds' toxic texts has it (three or four of them at least), so many times the share of ordinary ones.
SHARE, TIMES = 0.008, 12.0
CACHE = 60_000
_TAIL = b"\xff" * 16  # zstd doesn't index the last bytes of a dictionary


def spelt(word: str) -> bytes:
    """The codes of a word and of its beginnings, the whole word first."""
    wide = word.encode("utf-32-le", "surrogatepass")
    ends = range(4 * SHORTEST, 4 * min(len(word), LONGEST) + 1, 4)
    return b"".join([CODE_OF(wide, 1), *[CODE_OF(wide[:n]) for n in ends]])


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False,
        window_log=19, hash_log=17, chain_log=17, search_log=1, min_match=7, strategy=zstandard.STRATEGY_DFAST,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on spelt texts; of too few to train on, their own end."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    gain: int = GAINS[0]
    #: The score where there is nothing to learn from.
    constant: float | None = None


class Spelling:
    """The codes of words, kept for frequent ones; two generations of ``CACHE`` words at most."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def add(self, word: str) -> bytes:
        found = self.old.get(word) or spelt(word)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        if len(word) < 64:
            self.young[word] = found
        return found

    def clear(self) -> None:
        self.young, self.old = {}, {}


#: One per Python worker: spelling depends on no model. A task leaves it empty, as workers outlive their stage.
_SPELLING = Spelling()


class Scorer:
    """Compares the compressed lengths of windows."""

    def __init__(self, model: Model):
        # Both are as long, so what the ordinary dictionary holds lies equally far back.
        self.ordinary = _compressor(model.ordinary + bytes(len(model.toxic)) + _TAIL)
        self.both = _compressor(model.ordinary + model.toxic + _TAIL)

    def gains(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves, of each window."""
        words = words_of(text)
        letters = list(map(_SPELLING.young.get, words))
        if None in letters:
            letters = [_SPELLING.add(w) if x is None else x for w, x in zip(words, letters)]
        join, one, two = b"".join, self.ordinary.compress, self.both.compress
        windows = [join(letters[i : i + WINDOW]) for i in range(0, len(letters), WINDOW)]
        return [len(one(w)) - len(two(w)) for w in windows]


def features(gains: list[int], least: int) -> tuple[int, int, int]:
    """Windows, hits, bytes that the hits save."""
    hits = [g for g in gains if g >= least]
    return len(gains), len(hits), sum(hits)


def _inputs(found: np.ndarray) -> np.ndarray:
    n, hits, saved = found.astype(float).T
    return np.stack([np.ones(len(n)), np.log1p(hits), np.log1p(saved), np.log1p(1000.0 * hits / np.maximum(n, 1))], 1)


def curve(found: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Scores from rows of windows, hits, saved bytes."""
    return 1 / (1 + np.exp(-np.clip(_inputs(found) @ np.array(weights), -30, 30)))


def fit_curve(found: np.ndarray, labels: np.ndarray, pull: float = 1.0, steps: int = 200) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton steps with a small pull of the slopes towards 0; its weights and loss."""
    x, y = _inputs(found), labels.astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[pull] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(curve(found, tuple(w)), 1e-9, 1 - 1e-9)
    return tuple(float(v) for v in w), float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


class Texts:
    """The spelt texts of a class and fold, and how much of them has each code."""

    def __init__(self):
        self.copies: dict[bytes, int] = {}

    def add(self, text: str | None) -> None:
        once = b"".join(map(spelt, dict.fromkeys(words_of(text))))
        self.copies[once] = self.copies.get(once, 0) + 1

    def count(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Codes in order, the weight of the texts that have each, the weight of all."""
        own = [(np.unique(np.frombuffer(t, np.uint64)), 1 + np.log2(n) / 2) for t, n in self.copies.items()]
        codes, place = np.unique(np.concatenate([c for c, _ in own] or [np.zeros(0, np.uint64)]), return_inverse=True)
        weight = np.repeat([w for _, w in own], [len(c) for c, _ in own]) if own else np.zeros(0)
        return codes, np.bincount(place, weight, len(codes)), float(sum(w for _, w in own))


def _weight_of(codes: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weight of the texts with each of ``codes`` over several counts, and of all texts."""
    out = np.zeros(len(codes))
    for known, weight, _ in counts:
        if len(known):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            out += np.where(known[at] == codes, weight[at], 0.0)
    return out, sum(total for _, _, total in counts)


def entries(dictionary: bytes) -> np.ndarray:
    """The codes in a dictionary, wherever its segments begin."""
    return np.unique(np.concatenate([np.frombuffer(dictionary[i : len(dictionary) - (len(dictionary) - i) % CODE], np.uint64) for i in range(CODE)]))


def calibrated(dictionary: bytes, toxic: list[tuple], ordinary: list[tuple]) -> dict[int, float]:
    """Entries of a toxic dictionary that other folds confirm, and the weight of their texts there."""
    if len(dictionary) < CODE:
        return {}
    codes = entries(dictionary)
    have, n_have = _weight_of(codes, toxic)
    lack, n_lack = _weight_of(codes, ordinary)
    least = max(3 if n_have < 100 else 4, SHARE * n_have)
    stays = (have >= least) & (have * max(n_lack, 1) >= TIMES * (lack + 0.25) * n_have)
    return dict(zip(codes[stays].tolist(), have[stays].tolist()))


def _toxic(found: list[dict[int, float]]) -> bytes:
    """One dictionary of the entries; the most frequent stand last, where matches cost least."""
    weight: dict[int, float] = {}
    for own in found:
        for c, w in own.items():
            weight[c] = max(w, weight.get(c, 0.0))
    return b"".join(np.uint64(c).tobytes() for c in sorted(weight, key=lambda c: (weight[c], c)))


def held_out(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learns from ``labels`` (doc_id, toxic) of rows for which ``usable`` (a condition on doc_id) holds."""
    prepare(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    own = own if usable is None else own.where(usable)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = own.agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    if share[1] is None or share[1] == share[2]:
        return Model(b"", b"", constant=float(share[0] or 0.0))
    ordered = own.withColumn("at", draw("toxicity", F.col("doc_id")))
    drawn = ordered.where("toxic = 1").orderBy("at", "doc_id").limit(sample).unionByName(ordered.where("toxic = 0").orderBy("at", "doc_id").limit(sample))
    drawn = stash(drawn, "drawn")
    sampled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = stash(sampled.select("doc_id", "toxic", "text", (draw("fold", F.col("doc_id")) % FOLDS).alias("fold")), "toxic-sample")
    spells = [[Texts() for _ in range(FOLDS)] for _ in (0, 1)]
    for row in texts.select("toxic", "fold", "text").orderBy("toxic", "fold", "text").toLocalIterator():
        spells[row.toxic][row.fold].add(row.text)
    ordinary = [train_dictionary(list(t.copies), ORDINARY_SIZE) for t in spells[0]]
    toxic = [train_dictionary(list(t.copies), TOXIC_SIZE) for t in spells[1]]
    counts = [[t.count() for t in own] for own in spells]
    del spells

    def learnt(folds: list[int]) -> Model:
        """From some folds: each fold's toxic dictionary is calibrated on the others."""
        found = [calibrated(toxic[f], [counts[1][g] for g in folds if g != f], [counts[0][g] for g in folds if g != f]) for f in folds]
        return Model(b"".join(ordinary[f] for f in folds), _toxic(found))

    # Every text is scored by dictionaries that other folds were learnt from.
    models = [learnt([f for f in range(FOLDS) if f != own]) for own in range(FOLDS)]
    final = learnt(list(range(FOLDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in models]
        for batch in batches:
            found = []
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                gains = scorers[fold].gains(text.as_py())
                found.append([v for least in GAINS for v in features(gains, least)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "found"])

    rows = texts.select("fold", "toxic", "text").mapInArrow(run, "toxic int, found array<long>").collect()
    discard(drawn)
    discard(texts)
    labels = np.array([r.toxic for r in rows])
    if not len(labels) or labels.min() == labels.max():
        return Model(b"", b"", constant=float(share[0]))
    found = np.array([r.found for r in rows], dtype=float).reshape(len(rows), len(GAINS), 3)
    fits = [fit_curve(found[:, i], labels) for i in range(len(GAINS))]
    best = min(range(len(GAINS)), key=lambda i: fits[i][1])
    return Model(final.ordinary, final.toxic, fits[best][0], GAINS[best])


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One per Python worker and model, so that words met by one task serve the next."""
    key = hash(model)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); whole texts, one pass, no shuffle."""
    prepare(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        scorer = _scorer(own)
        try:
            for batch in batches:
                if own.constant is not None:
                    value = np.full(batch.num_rows, own.constant)
                else:
                    value = curve(np.array([features(scorer.gains(t.as_py()), own.gain) for t in batch.column(text)]).reshape(-1, 3), own.weights)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"]
                )
        finally:
            _SPELLING.clear()
            release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")
