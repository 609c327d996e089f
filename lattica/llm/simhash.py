"""SimHash near-duplicates with Golay-code fuzzy keys (operator 8).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect binary Golay
code of length 23 decodes every segment to the codeword at most 3 bits away. Where it is exactly 3
away there are five more codewords at distance 4, so a segment has one or six *keys*. Two segments
that differ in at most one bit satisfy: the nearest codeword of either is among the keys of the
other. (If the nearest codewords c, c' differ, both distances are 3 and each word is 4 from the
other's.)

Pigeonhole: four errors over three segments either leave one segment without any (an exact segment
key finds the pair) or fall as 2+1+1 or 1+1+1, when two segments have one error each (a key made of
two decoded segments finds it). The index side holds nearest codewords only, the probe side all
keys. Every pair found is verified by its Hamming distance inside the join.

Keys that hold many fingerprints, as in large groups of near copies, are handled by
:func:`lattica.llm.common.bucket_links` without giving all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEY, bucket_links, connected_components, cut, drop, small

# The Golay code's generator polynomial x^11+x^9+x^7+x^6+x^5+x+1, and its lengths.
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_BITS, DATA_BITS, PARITY_BITS = 23, 12, 11
#: (shift, width) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(GOLAY_BITS - 1, PARITY_BITS - 1, -1):
        r ^= ((r >> bit) & 1) * (GOLAY_POLYNOMIAL << (bit - PARITY_BITS))
    return r


def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead to its keys' codewords (2048 x 6), and how many."""
    bits = 1 << np.arange(GOLAY_BITS, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    for weight in (1, 2, 3, 4):
        grid = np.array(np.meshgrid(*[np.arange(GOLAY_BITS)] * weight, indexing="ij")).reshape(weight, -1)
        grid = grid[:, (np.diff(grid, axis=0) > 0).all(axis=0)] if weight > 1 else grid
        patterns.append(bits[grid].sum(axis=0))
    table, count = np.zeros((1 << PARITY_BITS, 6), np.int64), np.zeros(1 << PARITY_BITS, np.int64)
    for weight, p in enumerate(patterns):
        for s, e in zip(_syndromes(p).tolist(), p.tolist()):
            if weight < 4 or count[s] and table[s, 0].item().bit_count() == 3:
                table[s, count[s]] = e
                count[s] += 1
    return table, count


def _segment_keys(fps: np.ndarray, errors: np.ndarray) -> list[np.ndarray]:
    """For each segment: codeword indices, one column per key; the first is the nearest."""
    out = []
    for shift, width in SEGMENTS:
        x = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        out.append((x[:, None] ^ errors[_syndromes(x)]) >> PARITY_BITS)
    return out


_PAIRS = ((0, 1), (0, 2), (1, 2))


def fuzzy_keys(fps: np.ndarray, probe: bool, exact: bool = True, tag: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, key) of all keys: the nearest codewords only, or all if ``probe``."""
    errors, count = _golay()
    segs = _segment_keys(fps, errors)
    n = [count[_syndromes(((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64))] for s, w in SEGMENTS]
    rows, keys, all_rows = [], [], np.arange(len(fps))
    for kind, (i, j) in enumerate(_PAIRS):
        for a in range(6 if probe else 1):
            for b in range(6 if probe else 1):
                has = (n[i] > a) & (n[j] > b)
                rows.append(all_rows[has])
                keys.append(((tag * 8 + kind) << 48) | (segs[i][has, a] << 12) | segs[j][has, b])
    for kind, (shift, width) in enumerate(SEGMENTS if exact else ()):
        rows.append(all_rows)
        keys.append(((tag * 8 + 4 + kind) << 48) | ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


_TABLES: list = []


def _golay() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(golay_errors())
    return _TABLES[0]


def majority(hashes: np.ndarray) -> int:
    """Bit k of the result is 1 if it is set in more than half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words: the whole sequence; none: empty."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)] if w else [], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def simhash(text: str | None, words: int = 4) -> int:
    h = shingle_hashes(text, words)
    return majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row. Null texts count as empty; empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _key_rows(fps: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                rows, keys = fuzzy_keys(part.view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints ``fps`` (fp) that differ in at most ``radius`` <= 4 bits.

    Complete up to connectivity: every pair within the radius is a row, or both are connected by rows.
    """
    if radius > 4:
        raise ValueError("the keys guarantee at most 4 differing bits")
    def keyed(probe: bool) -> DataFrame:
        return _key_rows(fps, probe).select("key", F.col("fp").alias("id"), F.col("fp").alias("bits"))

    # by chance alone, an exact segment of 21 bits is shared by this many
    chance = fps.count() >> 21
    index = cut(keyed(False))
    out = bucket_links(index, keyed(True), radius, hot_rows=max(HOT_KEY, 16 * chance))
    drop(index)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id (smallest id reachable over links, itself included).

    Null and empty texts have fingerprint 0, which links like any other. Repeated rows stay repeated.
    Rows with a null id keep it and get the smallest other id of their component, null if there is none.
    An empty table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col))
    fps = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    found = links(fps, radius)
    comp = connected_components(found)
    drop(found)
    n = comp.count()
    member = fps.join(small(comp, n), fps.fp == comp.node)
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of = cut(member.join(small(lowest, n), "component").select(F.col("fp").alias("of"), "component_id"))
    # fingerprints that many rows share and those in components: few beside the rows that stand alone
    alone = fps.join(small(of, n), fps.fp == of.of, "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "first").alias("component_id"))
    out = marked.join(alone, marked.fp == alone.of).select(id_col, "fp", "component_id")
    drop(comp)
    return out
