"""Toxicity by a counterfactual-regularised classifier (operator 6).

A logistic model over the presence of hashed words and word beginnings. Features are chosen by
their association with the label over the labelled rows, counted in the executors. For labelled
texts that name a group of people, a counterfactual text with the terms swapped within their
category is built, and the squared difference of both scores (before the logistic function) is
penalised with ``PENALTY``: the mere mention of a group then moves a score little, which lowers
false positives on neutral mentions.

The driver fits on the chosen features of at most ``MAX_LABELLED`` rows; scoring is one pass over
whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows used at most, features kept, and standard errors that a feature's log odds must be from 0.
MAX_LABELLED, MAX_FEATURES, LEAST_SCORE = 60_000, 3_000, 3.0
PENALTY, RIDGE, STEPS = 1.0, 2e-4, 300
HASH_BITS = 22
#: Characters at a word's start that make features of their own.
PREFIXES = (4, 5, 6, 7, 8)
KEPT_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms by category; a swap takes the next term of the same row.
IDENTITY_TERMS = """
women men
woman man
girls boys
female male
mother father
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
black white asian latino
gay straight lesbian bisexual
homosexual heterosexual
transgender cisgender
american mexican chinese german french spanish turkish russian polish
immigrants refugees citizens natives
immigrant refugee citizen native
disabled blind deaf
frauen männer
muslime christen juden
ausländer inländer
femmes hommes
musulmans chrétiens juifs
étrangers français
mujeres hombres
musulmanes cristianos judíos
extranjeros españoles
"""
_SWAP: dict[str, str] = {}
for _row in IDENTITY_TERMS.split("\n"):
    _terms = _row.split()
    for _i, _t in enumerate(_terms):
        _SWAP.setdefault(_t, _terms[(_i + 1) % len(_terms)])


def counterfactual(text: str) -> str | None:
    """``text`` with every identity term swapped, or None if it has none."""
    swapped, n = _WORD.subn(lambda m: _SWAP.get(m[0], m[0]), text.lower())
    return swapped if swapped != text.lower() else None


class _Features(dict):
    """Feature ids of a word."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        parts = [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]
        ids = self[word] = tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) >> 32 - HASH_BITS for p in parts)
        return ids


def features(text: str | None, cache: _Features) -> set[int]:
    out: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.update(cache[w])
    return out


def fit(rows: list[tuple[list[int], list[int] | None, int]], n_features: int) -> np.ndarray:
    """Weights, the last the bias: rows are (feature numbers, those of the counterfactual or None, label)."""
    w = np.zeros(n_features + 1)
    if not rows or len({y for _, _, y in rows}) < 2:
        p = (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)
        w[-1] = np.log(p / (1 - p))
        return w

    def matrix(lists):
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.repeat(np.arange(len(lists)), n), np.fromiter((f for x in lists for f in x), np.int64, int(n.sum()))

    y = np.array([y for _, _, y in rows], float)
    r, c = matrix([x for x, _, _ in rows])
    pairs = [(x, z) for x, z, _ in rows if z is not None]
    ar, ac = matrix([x for x, _ in pairs])
    br, bc = matrix([z for _, z in pairs])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, w[c], len(y)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(c, g[r], n_features), g.sum()) + RIDGE * np.append(w[:-1], 0)
        if pairs:
            d = 2 * PENALTY * (np.bincount(ar, w[ac], len(pairs)) - np.bincount(br, w[bc], len(pairs))) / len(pairs)
            grad[:-1] += np.bincount(ac, d[ar], n_features) - np.bincount(bc, d[br], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w


def train(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(chosen feature ids, sorted; weights with the bias last) from (text, label)."""

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts, labels = _Features(), np.zeros((2, 1 << HASH_BITS), np.int32), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[y, np.fromiter(features(t, cache), np.int64)] += 1
                labels[y] += 1
        some = np.nonzero(counts[1])[0]
        # every feature of a toxic row; others can't be chosen. The row numbered -1 counts rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[1][some], labels[1]).astype(np.int64))], names=["f", "n"])
        every = np.nonzero(counts[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(every, -1)), pa.array(np.append(-counts[0][every], -labels[0]).astype(np.int64))], names=["f", "n"])

    texts = cut(texts.select("text", "label"))
    counted = texts.mapInArrow(feats, "f bigint, n bigint").groupBy("f").agg(F.sum(F.greatest("n", F.lit(0))).alias("bad"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("fine"))
    counted = cut(counted)
    total = counted.where("f = -1").first()
    bad, fine = (total["bad"], total["fine"]) if total else (0, 0)
    if not bad or not fine:
        return np.zeros(0, np.int64), fit([([], None, int(bad > 0))] * min(bad + fine, 1000), 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("fine") + 0.5) / (fine + 1.0))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("fine") + 0.5))
    scored = counted.where("f >= 0").withColumn("score", F.abs(odds) / error).where(F.col("score") >= LEAST_SCORE)
    best = [x["f"] for x in scored.orderBy(F.desc("score"), "f").limit(MAX_FEATURES).select("f").collect()]
    terms = {f for t in _SWAP for f in _Features()[t]}
    chosen = np.array(sorted({*best, *terms}), np.int64)
    known = texts.sparkSession.sparkContext.broadcast(chosen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number = _Features(), {f: i for i, f in enumerate(known.value.tolist())}
        pick = lambda t: sorted(number[f] for f in features(t, cache) if f in number)
        for b in batches:
            found = b.column(0).to_pylist()
            other = [counterfactual(t or "") for t in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pick(t) for t in found], pa.list_(pa.int32())), pa.array([None if t is None else pick(t) for t in other], pa.list_(pa.int32())), b.column(1)], names=["x", "z", "label"]
            )

    got = texts.mapInArrow(rows, "x array<int>, z array<int>, label int").collect()
    return chosen, fit([(list(r["x"]), None if r["z"] is None else list(r["z"]), r["label"]) for r in got], len(chosen))


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of every row of ``docs`` and score (0 to 1); ``labelled`` (text, label) is what the model learns from.

    Null and empty texts have no feature: they get the score of the bias. Repeated rows get equal scores.
    With no labelled rows, or of one label only, all scores are that label's smoothed share. An empty table
    gives an empty result. Other columns are ignored.
    """
    chosen, weights = train(labelled)
    model = docs.sparkSession.sparkContext.broadcast((chosen, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w = model.value
        of = dict(zip(ids.tolist(), w.tolist()))
        bias, cache, by_word = float(w[-1]), _Features(), {}
        for b in batches:
            z = np.empty(b.num_rows)
            for k, t in enumerate(b.column(1).to_pylist()):
                found: set[int] = set()
                for word in set(_WORD.findall((t or "").lower())):
                    if (hit := by_word.get(word)) is None:
                        if len(by_word) >= KEPT_WORDS:
                            by_word.clear()
                        hit = by_word[word] = tuple(f for f in _Features.__missing__(cache, word) if f in of)
                        cache.clear()
                    if hit:
                        found.update(hit)
                z[k] = bias + sum(of[f] for f in sorted(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def labelled_texts(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of labelled rows that are not held out, about ``most`` of the smallest id hashes."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = labels.where(F.col(label_col).isin(0, 1) & (fold != 0)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    known = known.select(F.col(id_col).alias("_id"), "label")
    return docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "label")
