"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words (whole, and by their first bytes, so that inflected forms of
one stem meet), word pairs and pairs around one word, hashed to
``2 ** BITS`` slots. Per-coordinate rates and L1 leave a sparse vector of weights whose size the
number of slots bounds, so it is shipped to every task; scoring is a few numpy passes a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import decode, encode, trim
from tessera.llm._graph import checkpoint, unused
from tessera.llm._text import IS_SPACE, chunks, distinct_sorted, mix, prefix_hash, span_hash, word_spans

BITS = 20
#: The classifier is fitted on at most so many labelled rows, those of the smallest hash of doc_id.
MAX_LABELLED = 20_000
#: A word counts by its first bytes, so many of them, too.
STEMS = (5, 7)
_SKIP = np.uint64(0xA24BAED4963EE407)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def is_held_out() -> F.Column:
    """Rows from which no label is learnt: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def slots(words: np.ndarray, stems: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct feature slots of a text's word hashes and hashes of their beginnings."""
    pairs = mix(words[:-1] * _PAIR + words[1:])
    skips = mix(words[:-2] * _SKIP + words[2:]) if len(words) > 2 else words[:0]
    return distinct_sorted((np.concatenate((mix(words), mix(stems), pairs, skips)) >> np.uint64(64 - bits)).astype(np.int32))


def features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    # Marks on both sides of a word would hide it, so bytes other than letters and digits separate.
    for _, data, offsets in chunks(column, 1 << 18):
        data = np.where(_SEPARATES[data], np.uint8(32), data)
        starts, stops, first = word_spans(data, offsets)
        prefix = prefix_hash(data, True)
        words = span_hash(prefix, starts, stops)
        stems = np.stack([span_hash(prefix, starts, np.minimum(stops, starts + k)) + np.uint64(k) for k in STEMS], axis=1)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield slots(words[a:b], stems[a:b].ravel(), bits)


_SEPARATES = IS_SPACE.copy()
_SEPARATES[[c for c in range(128) if not chr(c).isalnum()]] = True


class Ftrl:
    """FTRL-proximal with per-coordinate rates for binary features; slot ``2 ** bits`` is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 2.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _extract(bits: int) -> Callable:
    """Slots in place of the texts, as a compressed block; there are ``2 ** bits`` at most, however long a text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode([np.diff(s, prepend=np.int32(0)).astype(np.int32)]) for s in features(batch.column("text"), bits)]
            yield pa.record_batch([batch.column("rank"), batch.column("label"), pa.array(found, pa.binary())], names=["rank", "label", "slots"])
        trim()

    return run


def _train(bits: int, options: dict) -> Callable:
    """Learns the rows as they come, in order, and holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(bits, **options)
        for batch in batches:
            for block, label in zip(batch.column("slots"), batch.column("label").to_pylist(), strict=True):
                model.learn(np.cumsum(decode(block.as_py(), ("i4",))[0]), label)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(w[used])], names=["slot", "weight"])
        trim()

    return run


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED, epochs: int = 4, **options) -> np.ndarray | None:
    """Weights by slot, the bias last; None where nothing can be told apart, as labels of both kinds are wanting.

    Learns from the rows of ``labels`` (doc_id, toxic) that are not held out, at most
    ``max_labelled`` of them, those of the smallest hash of doc_id. Null ids and null labels are left out, an id with labels
    of both kinds counts as toxic, and of rows of ``docs`` that repeat an id each is learnt from. The texts' slots are
    found in parallel and put in the order of that hash once; the model passes over them ``epochs`` times, as a stream.
    """
    marks = labels.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    # At most ``max_labelled`` rows of three numbers, so they can be shipped to the texts.
    chosen = marks.withColumn("rank", F.xxhash64("doc_id", F.lit(17))).orderBy("rank", "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = checkpoint(rows.select("rank", "label", "text").mapInArrow(_extract(bits), "rank long, label int, slots binary"))
    if found.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    ordered = checkpoint(found.repartition(1).sortWithinPartitions("rank", "slots"))  # at most max_labelled rows and those that repeat their ids
    # One partition, so its copies are epochs, whatever order a task reads them in.
    passes = reduce(DataFrame.unionByName, [ordered] * epochs).coalesce(1)
    table = passes.select("label", "slots").mapInArrow(_train(bits, options), "slot long, weight double").toArrow()  # weights that aren't 0, 2 ** bits + 1 at most
    weights = np.zeros((1 << bits) + 1)
    weights[np.asarray(table.column("slot"), dtype=np.int64)] = np.asarray(table.column("weight"))
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, name: str = "score") -> DataFrame:
    """``docs`` with a further column ``name`` of 0 to 1, the chance of label 1; a column of that name in any case is replaced.

    A null text is empty. Without weights all scores are 0.5.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    if weights is None:
        return kept.withColumn(name, F.lit(0.5))
    bits = (len(weights) - 1).bit_length() - 1
    used = np.flatnonzero(weights)
    shipped = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used]))
    columns, text = kept.columns, next(c for c in kept.columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shipped.value
        full = np.zeros((1 << bits) + 1)
        full[at] = values
        for batch in batches:
            sums = np.array([full[s].sum() for s in features(batch.column(text).cast(pa.string()), bits)]) + full[-1]
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))) if len(batch) else [], pa.float64())], names=[*columns, name])
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, any others).

    Repeated rows score alike; a null, empty or blank text scores the bias, a very long one by all its words. Label
    tables may have further columns, which are not read, nor is any column of ``docs`` but doc_id and text. Where
    labels of both kinds are wanting all scores are 0.5. An empty table gives an empty result.
    """
    weights = fit(docs, labels, **options)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out().alias("held_out")), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows predicted toxic; all of them where nothing could be learnt."""
    weights = fit(docs, labels, **options)
    if weights is None:
        return docs
    name = unused(docs, "score")
    return score(docs, weights, name).where(F.col(name) < 0.5).select(docs.columns)
