"""Near-duplicate documents by the exact Jaccard similarity of five-word shingle sets (the pipeline's form).

Candidates come from prefixes, which miss nothing: with all shingles in one order, two sets of similarity t
share one of the first n - ceil(t n) + 1 of each. Rare shingles come first in the order, so that passages
that many texts hold make few candidates; shingles are counted in a sample, and a poor sample costs time but no
pair. A pair stays a candidate only if the sizes and the number of shared prefix shingles allow the
similarity; the rest are verified by the whole sets.

Before that, parity sketches tell most pairs apart without loss: every shingle that only one of two sets holds
flips one of 1,024 bits, so sketches never differ in more bits than the sets in shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, cut, drop, small
from .simhash import shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles are counted in one text of SAMPLE (in all of up to ALL_TEXTS), from FREQUENT texts on one counts as frequent, and so many are told to the executors.
SAMPLE, ALL_TEXTS, FREQUENT, MAX_FREQUENT = 16, 10_000, 4, 200_000
#: 64-bit words of a parity sketch.
WORDS = 16
#: Texts of which a worker holds the sets at once.
PART_ROWS = 256
#: Rounding of products with the similarity must not lose a pair at the bound itself.
EPS = 1e-9


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, in ascending order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def prefix(s: np.ndarray, least: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: those not in ``frequent`` by hash, then ``frequent`` backwards."""
    n = len(s)
    length = n - math.ceil(least * n - EPS) + 1 if n else 0
    if not len(frequent):
        return s[:length]
    by_hash = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent, s, sorter=by_hash), len(frequent) - 1)
    rank = np.where(frequent[by_hash[at]] == s, len(frequent) - by_hash[at], 0)
    return s[np.argsort(rank, kind="stable")[:length]]


def parity(s: np.ndarray) -> np.ndarray:
    """WORDS numbers: bit i of all is the parity of the shingles that fall to it."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of PART_ROWS rows at most, so that few sets are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, PART_ROWS):
            yield b.slice(at, PART_ROWS)


def _frequent(rows: DataFrame, texts: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["key"])

    some = rows.where(F.pmod("h", F.lit(1 if texts <= ALL_TEXTS else SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key").collect()
    return np.array([r[0] for r in found], np.int64).view(np.uint64)


def _prefixes(rows: DataFrame, least: float, texts: int) -> DataFrame:
    """(id, n, keys, bits): the size, prefix and parity sketch of each text that has shingles."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            keys = [prefix(s, least, frequent.value).view(np.int64) for s in sets]
            bits = [parity(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "keys", "bits"])

    found = rows.select("h", "text").mapInArrow(run, "id bigint, n int, keys array<bigint>, bits array<bigint>").where("n > 0")
    return found.groupBy("id").agg(F.any_value(F.struct("n", "keys", "bits")).alias("t")).select("id", "t.*")


def _sized(least: float) -> Column:
    """Whether sets of ``an`` and ``bn`` shingles can be similar at all."""
    return F.least("an", "bn") >= least * F.greatest("an", "bn") - EPS


def _alike(least: float, words: int) -> Column:
    """Whether sketches p0, p1, … and q0, q1, … differ in no more bits than sets of ``an`` and ``bn`` shingles may."""
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(words)), F.lit(0))
    return differ <= (1 - least) / (1 + least) * (F.col("an") + F.col("bn")) + EPS


def _spread(side: str, words: int) -> list[Column]:
    return [F.get("bits", F.lit(i)).alias(f"{side}{i}") for i in range(words)]


def _possible(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of (a, an, b, bn), a row a shared prefix shingle, that share enough: what isn't in the prefix can add no more than the rest of it."""
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("an").alias("an"), F.min("bn").alias("bn"))
    beyond = F.ceil(least * F.greatest("an", "bn") - EPS) - 1
    return shared.where(F.col("c") + beyond >= least / (1 + least) * (F.col("an") + F.col("bn")) - EPS).select("a", "b", "an", "bn")


def links(prefixes: DataFrame, least: float, verify, words: int = WORDS) -> DataFrame:
    """(a, b) of similar sets, stored, complete up to connectivity; ``prefixes`` (id, n, keys, bits of ``words`` numbers) must be stored.

    Texts under a key are first linked to its smallest only. After that, all pairs under a key that aren't
    connected yet are candidates: those of a text outside the key's largest component and any other.
    A key's texts are counted by partial sums and met by joins, never gathered.
    """
    keyed = prefixes.select(F.explode("keys").alias("key"), "id", "n")
    shared = cut(keyed.select("key", "id").groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("a")).where("k > 1").select("key", "a"))
    sketches = prefixes.select("id", "bits")
    rows = cut(keyed.join(small(shared, shared.count()), "key"))
    # the size of a key's smallest comes by the key: by its id, all keys of a large group would meet in one task
    lead = rows.where("a = id").select("key", F.col("n").alias("an"))
    stars = rows.where("a <> id").join(lead, "key").select("a", "an", F.col("id").alias("b"), F.col("n").alias("bn")).where(_sized(least))
    drop(shared)
    met = _possible(stars, least).join(sketches.select(F.col("id").alias("a"), *_spread("p", words)), "a").join(sketches.select(F.col("id").alias("b"), *_spread("q", words)), "b")
    first = verify(met.where(_alike(least, words)).select("a", "b"))
    comp = connected_components(first)
    of = cut(rows.select("key", "id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    drop(rows)
    parts = of.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("most.comp").alias("main"))
    left = cut(of.join(main, "key"))
    drop(of)
    drawn = left.join(sketches, "id")
    out = drawn.where("comp <> main").select("key", F.col("id").alias("a"), F.col("n").alias("an"), F.col("comp").alias("acomp"), *_spread("p", words))
    every = drawn.select("key", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bcomp"), (F.col("comp") != F.col("main")).alias("bout"), *_spread("q", words))
    apart = (F.col("acomp") != F.col("bcomp")) & (~F.col("bout") | (F.col("a") < F.col("b")))
    pairs = out.join(every, "key").where(apart & _sized(least) & _alike(least, words))
    turned = F.col("a") > F.col("b")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("bn")).otherwise(F.col("an")).alias("an"), F.when(turned, F.col("an")).otherwise(F.col("bn")).alias("bn")]
    rest = verify(_possible(pairs.select(*pair), least).select("a", "b"))
    both = cut(first.unionByName(rest))
    drop(first, rest, comp, left)
    return both


def _fingerprint_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) of texts (h, text) whose SimHash fingerprints are linked within ``radius`` bits, closed over chains; stored.

    Each text is linked to the smallest of its fingerprint's component only, so copies aren't expanded into pairs.
    """
    marked = cut(simhash.fingerprints(rows, id_col="h").distinct())
    fps = cut(marked.select("fp").distinct())
    found = simhash.links(fps, radius)
    comp = connected_components(found)
    drop(fps, found)
    of = marked.join(small(comp, comp.count()), marked.fp == comp.node, "left").select("h", F.coalesce("component", "fp").alias("group"))
    lead = of.groupBy("group").agg(F.min("h").alias("a"), F.count("*").alias("k")).where("k > 1")
    out = cut(of.join(lead, "group").where("h <> a").select("a", F.col("h").alias("b")))
    drop(marked, comp)
    return out


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """(text_hash, first, class_id): a row for each distinct text; first is its smallest id, class_id the class's.

    Equal texts are one; others are linked if their shingle sets have a Jaccard similarity of ``least``, or, with
    ``radius``, if their SimHash fingerprints (see ``simhash``) differ in at most so many bits.
    Null and empty texts are one text of their own. A text of which all ids are null has first null and is
    never a class's smallest but by itself. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    firsts = cut(rows.groupBy("h").agg(F.min("id").alias("first")))
    # one row a text: the tasks' own repeats go before the shuffle, which moves prefixes only
    prefixes = cut(_prefixes(rows, least, firsts.count()))

    def verify(candidates: DataFrame) -> DataFrame:
        pairs = cut(candidates)
        ids = cut(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                sets = [shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["h", "s"])

        sets = cut(rows.select("h", "text").join(small(ids, ids.count()), "h", "left_semi").mapInArrow(run, "h bigint, s array<bigint>").groupBy("h").agg(F.any_value("s").alias("s")))
        both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = cut(both.where(common >= least * (F.size("x") + F.size("y") - common) - EPS).select("a", "b"))
        drop(pairs, ids, sets)
        return out

    edges = links(prefixes, least, verify)
    marked = _fingerprint_links(rows.select("h", "text"), radius) if radius is not None else None
    comp = connected_components(edges if marked is None else edges.unionByName(marked))
    drop(prefixes, edges, marked)
    n = comp.count()
    member = firsts.join(small(comp, n), firsts.h == comp.node)
    lead = member.groupBy("component").agg(F.min("first").alias("class_id"))
    grouped = cut(member.join(small(lead, n), "component").select(F.col("h").alias("text_hash"), "first", "class_id"))
    drop(comp)
    return grouped.unionByName(firsts.join(small(grouped.select(F.col("text_hash").alias("h")), n), "h", "left_anti").select(F.col("h").alias("text_hash"), "first", F.col("first").alias("class_id")))


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each class (see ``classes``): that of the smallest id. Repeated rows of that id are one row.

    Null ids come after all others; if all ids of a class are null, one of its rows stays. Null and empty texts
    are one text. An empty table gives an empty result. Columns of ``docs`` aren't touched, whatever their names.
    """
    known = cut(classes(docs, least, id_col, text_col, radius).where(F.col("first").eqNullSafe(F.col("class_id"))).select(F.col("text_hash").alias("__near_text_hash"), F.col("class_id").alias("__near_class_id")))
    keep = docs.withColumn("__near_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(known, (F.col("__near_h") == F.col("__near_text_hash")) & F.col(id_col).eqNullSafe(F.col("__near_class_id")))
    return keep.dropDuplicates(["__near_h", "__near_class_id"]).drop("__near_h", "__near_text_hash", "__near_class_id")
