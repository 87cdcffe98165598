"""Importance resampling of documents: the ratio of two hashed n-gram models as weight, Gumbel top-k as sample.

Both models are generative: a document draws its set of hashed words and word pairs, each n-gram once.  The target model is
estimated from labelled good documents, the raw model from all documents.  A text's log weight is the sum over its distinct n-grams of
log p_target - log p_raw.  With c target documents in a bucket and e = raw count * target total / raw total of them expected, the
estimate of a bucket's term is log((c + smooth) / (e + smooth)), shrunk towards 0 by the positive-part rule
1 - certain^2 / deviance, where deviance = 2 (c log(c / e) - c + e) is large where c is far from e for its size.  This is one formula at
every size: with few labels the terms of ordinary words, which are mostly chance, don't drown a few telling ones, and with many the shrinkage
vanishes.  Besides words and pairs there is a bucket for pairs of one word twice, and one for the share of distinct pairs among all pairs,
in tenths by length.

The sample is the k documents with the largest keys weight / temperature + Gumbel noise: k draws without replacement from
probabilities proportional to exp(weight / temperature), so that documents near the cut are in by chance.  k is the number of documents
whose weight reaches a cut, set on a labelled holdout where the share of bad documents below it less keep_good times the share of good
ones is largest.  The k-th key is found exactly by narrowing histograms; no row is sorted or collected.

Labels are read up to LABEL_ROWS rows, chosen by a hash; of these two thirds are for the target model and a third is the holdout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, written

LABEL_ROWS = 50_000
WORD_BITS = 17
PAIR_BITS = 17
TABLES = 2
SHAPES = 256
#: In units of log weight; a document this far below the cut has about a third of the odds of one at it.
TEMPERATURE = 0.25
#: So much more weighs a good document lost than a bad one kept.
KEEP_GOOD = 3.0
CACHE_WORDS = 250_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = self[token] = xxhash.xxh64_intdigest(token)
        return v


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Features:
    """The distinct n-grams of a text as buckets, (TABLES, n) numbers: each n-gram has a bucket of its own in every table.

    A table holds buckets for lower-case words and marks, for pairs of them, and for the shape of the text, in this order.
    """

    pairs_from = 1 << WORD_BITS
    shapes_from = pairs_from + (1 << PAIR_BITS)
    size = shapes_from + SHAPES

    def __init__(self):
        self.hashes = _Hashes()

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall((text or "").lower())
        h = np.fromiter(map(self.hashes.__getitem__, tokens), np.uint64, len(tokens))
        words = _distinct(h)
        if len(h) < 2:
            return self._buckets(words, WORD_BITS, 0)
        pairs = _distinct(((h[:-1] ^ (h[:-1] >> np.uint64(31))) * _MIX + h[1:]) * _MIX)
        shape = [self.shapes_from + (10 * len(pairs) // len(h)) * 20 + min(19, len(h).bit_length())]
        if np.count_nonzero(h[:-1] == h[1:]) * 20 > len(h):
            shape.append(self.shapes_from + SHAPES - 1)
        shapes = np.array([shape] * TABLES)
        return np.concatenate([self._buckets(words, WORD_BITS, 0), self._buckets(pairs, PAIR_BITS, self.pairs_from), shapes], axis=1)

    @staticmethod
    def _buckets(hashes: np.ndarray, bits: int, start: int) -> np.ndarray:
        out = np.empty((TABLES, len(hashes)), np.int64)
        for k in range(TABLES):
            out[k] = hashes >> np.uint64(64 - bits)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX
        out += start
        return out


@dataclass
class Model:
    """terms: a log ratio for each bucket, a row a table; cut: the weight from which on a document counts into k."""

    terms: np.ndarray
    cut: float = 0.0
    temperature: float = TEMPERATURE
    seed: int = 0

    def weight(self, buckets: np.ndarray) -> float:
        """Of an n-gram's terms in the tables the one nearest 0 counts: a telling n-gram in one of its buckets doesn't make it telling."""
        terms = np.stack([t[b] for t, b in zip(self.terms, buckets)])
        least = np.abs(terms).argmin(axis=0)
        return float(np.take_along_axis(terms, least[None], 0).sum(dtype=np.float64))


def labelled_sample(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """labels(doc, good boolean): at most `rows` labelled documents with role 'target' or 'holdout'; bounded, so fit to be broadcast."""
    one = labels.where("doc is not null and good is not null").groupBy("doc").agg(F.min("good").alias("good"))
    n = one.count()
    place = (F.xxhash64(F.lit("label"), "doc") / float(1 << 63) + 1) / 2
    if n > rows:
        one = one.where(place < rows / n)
    held = F.pmod(F.xxhash64(F.lit("role"), "doc"), F.lit(3)) == 0
    return one.orderBy(F.xxhash64(F.lit("label"), "doc")).limit(rows).select("doc", "good", F.when(held, F.lit("holdout")).otherwise(F.lit("target")).alias("role"))


def ngram_counts(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """docs(doc, text), all of them, and a labelled sample: counts (table, 2, bucket) of each bucket in all and in target documents."""
    fit = labels.where("role = 'target' and good").select("doc", F.lit(1).alias("row"))
    flagged = docs.select("doc", "text").join(F.broadcast(fit), "doc", "left").select("text", F.coalesce("row", F.lit(0)).alias("row"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(), np.zeros((TABLES, 2, Features.size), np.int32)
        for batch in batches:
            for text, row in zip(batch.column("text").to_pylist(), batch.column("row").to_pylist()):
                for table, found in zip(sums, features.of(text)):
                    table[0][found] += 1  # once a document, however many n-grams share the bucket
                    if row:
                        table[1][found] += 1
        for k in range(TABLES):
            some = np.flatnonzero(sums[k, 0])
            columns = [some + k * Features.size, *(sums[k, row, some].astype(np.int64) for row in range(2))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "raw", "good"])

    names = ("raw", "good")
    summed = flagged.mapInArrow(lean(count), "bucket long, raw long, good long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    out, found = np.zeros((2, TABLES * Features.size)), summed.toArrow()  # at most as many rows as buckets
    out[:, found["bucket"].to_numpy()] = found["raw"].to_numpy(), found["good"].to_numpy()
    return out.reshape(2, TABLES, Features.size).transpose(1, 0, 2)


def log_ratios(counts: np.ndarray, certain: float = 3.0, smooth: float = 0.5) -> np.ndarray:
    """counts (2, bucket) in all and in target documents.  Words, pairs and shapes are models of their own, each with its own totals."""
    out = np.zeros(counts.shape[1], np.float32)
    for part in (slice(0, Features.pairs_from), slice(Features.pairs_from, Features.shapes_from), slice(Features.shapes_from, None)):
        raw, good = counts[:, part]
        if not raw.sum() or not good.sum():
            continue
        expected = raw * (good.sum() / raw.sum())
        ratio = np.log((good + smooth) / (expected + smooth))
        far = 2 * (good * np.log(np.where(good > 0, good, 1) / np.where(expected > 0, expected, 1)) - good + expected)
        out[part] = ratio * np.maximum(0, 1 - certain**2 / np.maximum(far, 1e-9))
    return out


def weighted(docs: DataFrame, model: Model, column: str = "log_weight") -> DataFrame:
    """docs(text and any other columns) with the text's log weight; null and empty texts weigh 0."""
    from pyspark.sql import types as T

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = pa.array([model.weight(features.of(t)) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, column])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(lean(weigh), T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def best_cut(weights: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The middle of the place where the share of bad documents below, less keep_good times that of good ones, is largest; -inf without
    both kinds, or where nothing is gained."""
    if not len(weights) or good.all() or not good.any():
        return float("-inf")
    levels = np.unique(weights)
    g, b = np.sort(weights[good]), np.sort(weights[~good])
    gain = np.searchsorted(b, levels) / len(b) - keep_good * np.searchsorted(g, levels) / len(g)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float("-inf")
    return float((levels[best] + levels[best - 1]) / 2)


def gumbel_key(weight: Column, doc: Column, temperature: float, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc), 11).cast("double") + 0.5) / float(1 << 53)
    return weight / temperature - F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest of keys(key double), by narrowing histograms until few rows are left in question; -inf if there are fewer."""
    if k < 1:
        return float("inf")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n < k:
        return float("-inf")
    above = 0  # keys over the range in question
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if n <= few or not low + width > low:
            held = sorted((r[0] for r in inside.select("key").limit(few + 1).collect()), reverse=True) if n <= few else [low]
            return held[min(k - above, len(held)) - 1]
        counts = {r["bin"]: r for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b]["n"] >= k:
                low, high, n = counts[b]["a"], counts[b]["b"], counts[b]["n"]
                break
            above += counts[b]["n"]


def fitted(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = 0) -> Model:
    """docs(doc, text), labels(doc, good): the two models' ratio, with the cut set on the holdout, which is bounded."""
    sample = written(labelled_sample(labels), "importance-labels")
    model = Model(np.stack([log_ratios(c) for c in ngram_counts(docs, sample)]), temperature=temperature, seed=seed)
    held = docs.select("doc", "text").join(F.broadcast(sample.where("role = 'holdout'").select("doc", "good")), "doc")
    found = weighted(held, model).select("log_weight", "good").toPandas()
    model.cut = best_cut(found["log_weight"].to_numpy(float), found["good"].to_numpy(bool))
    return model


def sampled(docs: DataFrame, model: Model, id_col: str, weight: str, key: str, kept: str, columns: list[str] | None = None) -> DataFrame:
    """docs(id_col, text, ...), or of it the columns named, with weight, key and kept; the texts are weighed once and the table is written.

    Without usable labels every document is kept; more than k documents are kept only where keys tie with the k-th.
    """
    scored = weighted(docs, model, weight).select(*(columns or docs.columns), weight)
    scored = written(scored.withColumn(key, gumbel_key(F.col(weight), F.col(id_col), model.temperature, model.seed)), "importance-scores")
    k = scored.where(F.col(weight) >= model.cut).count()
    return scored.withColumn(kept, F.col(key) >= kth_largest(scored.select(F.col(key).alias("key")), k))


def resampled(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """docs(doc, text): doc, log_weight, key, kept for every document; null and empty texts weigh 0, and equal rows draw alike."""
    texts = docs.select("doc", "text")
    return sampled(texts, fitted(texts, labels, temperature, seed), "doc", "log_weight", "key", "kept", ["doc"])


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """The rows of docs(id_col, text, ...) in the sample, with their columns."""
    model = fitted(docs.select(F.col(id_col).alias("doc"), "text"), labels, temperature, seed)
    names = [free_name(docs, c) for c in ("log_weight", "gumbel_key", "in_sample")]
    return sampled(docs, model, id_col, *names).where(F.col(names[2])).select(*docs.columns)
