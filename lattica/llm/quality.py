"""Quality by importance resampling of hashed n-grams (operator 5).

Two generative models of hashed word and punctuation n-grams (orders 1 and 2, smoothed bags over
``BUCKETS``): the raw one counts every document, the target one the labelled good documents. A
document's log importance weight is the log ratio of its probabilities under both, for
``REFERENCE`` n-grams (so that length alone doesn't decide). Adding Gumbel noise, a hash of the id,
and keeping the k largest keys draws k documents without replacement in proportion to their
weights. k is the number of documents whose weight reaches the cut that best separates the
labelled rows; it can also be given.

One pass counts, one scores. Counts are summed within each task; the driver gets one row a bucket,
and histograms of keys to find the k-th largest exactly. The labelled sample is bounded by
``MAX_LABELLED``; of its good rows a fifth is kept from the target model to find the cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 1 << 16
#: Pseudo-count of every bucket, in both models.
SMOOTHING = 5.0
REFERENCE = 64
#: Labelled rows used at most: ids of the smallest hashes, sent to every task.
MAX_LABELLED = 200_000
SEED = 5
#: Distinct words of which a worker keeps the hashes.
KEPT_WORDS = 100_000
#: Characters of which n-grams are held at once (or one document).
ROUND_CHARS = 250_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def rounds(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ROUND_CHARS characters."""
    first, held, chars = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or "")
        chars += len(held[-1])
        if chars >= ROUND_CHARS:
            yield first, held
            first, held, chars = k + 1, [], 0
    if held:
        yield first, held


def buckets(texts: list[str], cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets of all texts in order of text, number for each text): unigrams, then bigrams within a text."""
    tokens = [_TOKEN.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = np.fromiter((cache[w] for t in tokens for w in t), np.uint64, int(n.sum()))
    one = (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    two = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    text = np.repeat(np.arange(len(texts)), n)
    inside = text[:-1] == text[1:]
    return np.concatenate([one, two[inside]]), np.concatenate([text, text[1:][inside]])


def _labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, good, fit), prefixed: at most about ``most`` labelled ids, bounded by their hash so that reruns agree; a fifth is kept from the fit."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__quality_id")).agg(F.max(label_col).cast("int").alias("__quality_good"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("__quality_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    return F.broadcast(known.withColumn("__quality_fit", F.pmod(F.xxhash64("__quality_id", F.lit(7)), F.lit(5)) > 0))


def _counts(labelled: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, raw, good = _Hashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            marks = np.array([x == 1 for x in b.column(1).to_pylist()], bool)
            for first, texts in rounds(t.as_py() for t in b.column(0)):
                grams, text = buckets(texts, cache)
                raw += np.bincount(grams, minlength=BUCKETS)
                good += np.bincount(grams[marks[first + text]], minlength=BUCKETS)
        some = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    rows = labelled.select(text_col, F.when(F.col("__quality_fit"), F.col("__quality_good")).alias("__quality_good")).mapInArrow(run, "bucket bigint, raw bigint, good bigint")
    got = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"].to_numpy(np.int64)], good[got["bucket"].to_numpy(np.int64)] = got["raw"], got["good"]
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of target over raw probability for each bucket, with the same pseudo-counts in both models.

    Raw counts are scaled to the target's total first, so a bucket of which the sample says little has a
    ratio near one.
    """
    share = good.sum() / max(raw.sum(), 1.0)
    return np.log(good + SMOOTHING) - np.log(raw * share + SMOOTHING)


def kth_largest(scores: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a double column: histograms over a narrowing range, then at most 20,000 values."""
    lo, hi, n = scores.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or not n:
        return math.inf
    k = min(k, n)
    for _ in range(12):
        if n <= 20_000 or lo == hi:
            break
        step = (hi - lo) / 4096
        bin_ = F.least(F.floor((F.col(col) - lo) / step), F.lit(4095))
        rows = scores.where(F.col(col).between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    if lo == hi:
        return lo
    return sorted((r[0] for r in scores.where(F.col(col).between(lo, hi)).select(col).collect()), reverse=True)[k - 1]


def _cut_of(labelled: DataFrame) -> float:
    """The weight that best separates good from bad labelled rows: fewest errors of both kinds by their shares, over 4096 bins."""
    low, high = labelled.agg(F.min("weight"), F.max("weight")).first()
    if low is None or low == high:
        return -math.inf if low is None else low
    step = (high - low) / 4096
    rows = labelled.groupBy(F.floor((F.col("weight") - low) / step).alias("b")).agg(F.sum("__quality_good").alias("good"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: r["b"])
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return low
    # a good document lost counts three times a bad one kept
    lost, kept, best, at = 0, bad, float(bad) / bad, low
    for r in rows:
        lost, kept = lost + r["good"], kept - (r["n"] - r["good"])
        if (now := 3.0 * lost / good + kept / bad) < best:
            best, at = now, low + (r["b"] + 1) * step
    return at


def importance(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` (the id among them; default: it alone) of ``docs`` with weight, gumbel_key and selected.

    Null and empty texts have no n-gram and weight 0. A null id has noise of its own; repeated rows have
    equal keys, and ties at the k-th key are all selected. Without labelled good rows every weight is 0
    and all rows are selected, and also if the good and bad rows can't be told apart. ``labels`` that
    disagree about an id count as good. An empty table gives an empty result.
    """
    known = _labels(labels, id_col, label_col, MAX_LABELLED)
    wanted = [*dict.fromkeys([id_col, text_col, *(columns or [])])]
    joined = docs.select(*wanted).join(known, F.col(id_col) == F.col("__quality_id"), "left").drop("__quality_id")
    raw, good = _counts(joined, text_col)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(raw, good) if good.sum() else np.zeros(BUCKETS))

    def scored(names: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = _Hashes()
            for b in batches:
                weight = np.zeros(b.num_rows)
                for first, texts in rounds(t.as_py() for t in b.column(0)):
                    grams, text = buckets(texts, cache)
                    n = np.bincount(text, minlength=len(texts))
                    weight[first : first + len(texts)] = np.bincount(text, ratio.value[grams], len(texts)) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(weight * REFERENCE)], names=[*names, "__quality_known", "weight"])

        ddl = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in names) + ", __quality_known int, weight double"
        apart = F.when((F.col("__quality_good") < 1) | ~F.col("__quality_fit"), F.col("__quality_good"))
        rows = joined.select(F.col(text_col).alias("_text"), *names, apart.alias("__quality_known")).mapInArrow(run, ddl)
        uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return rows.withColumn("gumbel_key", F.col("weight") - F.log(-F.log(uniform)))

    keys = cut(scored([id_col]))
    if k is None:
        least = _cut_of(keys.where("__quality_known is not null").withColumnRenamed("__quality_known", "__quality_good"))
        k = keys.where(F.col("weight") >= least).count()
    bound = kth_largest(keys, "gumbel_key", k)
    out = scored(columns) if columns else keys  # scored anew where texts go along: cheaper than to store them
    return out.drop("__quality_known").withColumn("selected", F.col("gumbel_key") >= bound)
