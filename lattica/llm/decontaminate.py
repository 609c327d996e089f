"""Benchmark decontamination with SimHash item-sized windows (operator 1).

For every benchmark item of n words, each n-word window of a document gets a 64-bit SimHash of its
five-word shingles. Items are indexed by Hamming blocks: with radius r the fingerprint is cut into
r + 1 blocks, and fingerprints within r differ in at most r of them, so one block at least is equal
(multi-index hashing: nothing within the radius is missed). What the index finds is verified by the
exact weighted Jaccard similarity of the shingle multisets, a shingle weighing its count.

A window without any shingle of the item has similarity 0, so only windows that hold a shingle of an
item of their size are fingerprinted; the result is the same and most of a corpus is passed over
after one rolling hash a word.

A document shorter than an item is its own one window for it, and verified without the index. An item of fewer
than five words is one shingle of all its words, and found where those stand side by side.

The benchmark goes to the executors in blocks of bounded size, and documents are scanned once for
each block: no shuffle, and no document is held beyond its own batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
#: Bounds of one block of the benchmark: items, and characters of their texts.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Distinct words of which a worker keeps the hashes.
KEPT_WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _STEP
        h += words[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def word_hashes(text: str | None, cache: _Hashes) -> np.ndarray:
    w = _WORD.findall((text or "").lower())
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle multisets."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _window_prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles of ``h``."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(2 * (total[size:] - total[:-size]) > size, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """A block of benchmark items: their shingles, and their fingerprints by Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        cache, self.radius = _Hashes(), radius
        words = [(k, word_hashes(t, cache)) for k, t in items]
        self.items = [(k, shingles(w)) for k, w in words if len(w) >= SHINGLE]
        #: By number of words: hashes of the items too short for a shingle, and whose they are.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in words:
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w, len(w))[0]), []).append(k)
        self.sizes = np.array([len(h) for _, h in self.items], np.int64)
        prints = [_window_prints(h, len(h))[0] for _, h in self.items]
        self.prints = np.array(prints, np.uint64)
        owner = np.repeat(np.arange(len(self.items)), self.sizes) if self.items else np.zeros(0, np.int64)
        every = np.concatenate([h for _, h in self.items]) if self.items else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([every, self.sizes[owner].astype(np.uint64)], axis=1), axis=0) if len(every) else np.zeros((0, 2), np.uint64)
        self.shingle, self.shingle_size = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)
        order = np.argsort(every)
        self.sorted, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingle & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.cuts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.blocks: dict[tuple[int, int, int], list[int]] = {}
        for i, f in enumerate(self.prints):
            for k, (shift, mask) in enumerate(self.cuts):
                self.blocks.setdefault((int(self.sizes[i]), k, int((f >> shift) & mask)), []).append(i)

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, windows of which the fingerprint is within the radius) among items of ``size`` shingles."""
        hits: dict[int, list[np.ndarray]] = {}
        for k, (shift, mask) in enumerate(self.cuts):
            values = (prints >> shift) & mask
            for v in np.unique(values):
                for i in self.blocks.get((size, k, int(v)), ()):
                    hits.setdefault(i, []).append(np.nonzero(values == v)[0])
        for i, found in hits.items():
            at = np.unique(np.concatenate(found))
            at = at[np.bitwise_count(prints[at] ^ self.prints[i]) <= self.radius]
            if len(at):
                yield i, at

    def longer(self, h: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """Rows of ``search`` for items of more shingles than ``h``, to which all of it is compared."""
        lo, hi = np.searchsorted(self.sorted, h, "left"), np.searchsorted(self.sorted, h, "right")
        n = hi - lo
        owners = self.owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        # a shingle that both repeat counts more than once here, never less than in the similarity
        some, shared = np.unique(owners, return_counts=True)
        size = self.sizes[some]
        some = some[(size > len(h)) & (shared >= least / (1 + least) * (size + len(h)) - 1e-9)]
        out = []
        for i in some.tolist():
            if (s := similarity(h, self.items[i][1])) >= least:
                out.append((self.items[i][0], 0, int(np.bitwise_count(_window_prints(h, len(h))[0] ^ self.prints[i])), s))
        return out

    def verbatim(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Rows of ``search`` for items of fewer words than a shingle: their first place."""
        out = []
        for m, items in self.short.items():
            h = shingles(words, m)
            at = np.nonzero(np.isin(h, np.fromiter(items, np.uint64, len(items))))[0]
            some, first = np.unique(h[at], return_index=True)
            out += [(k, int(at[f]), 0, 1.0) for x, f in zip(some.tolist(), first.tolist()) for k in items[x]]
        return out

    def search(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """(item id, first word, differing bits, similarity) of the best window for each item found in a text's word hashes."""
        return self.verbatim(words) + self._windows(shingles(words), least)

    def _windows(self, h: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        at = np.nonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        if not len(at) or not len(self.shingle):
            return []
        lo = np.searchsorted(self.shingle, h[at], "left")
        hi = np.searchsorted(self.shingle, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return []
        n = hi - lo
        where = np.repeat(at, n)
        sizes = self.shingle_size[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        out = self.longer(h, least) if len(h) < sizes.max() else []
        for size in np.unique(sizes).tolist():
            if size > len(h):
                continue
            first = where[sizes == size]
            begin, end = np.maximum(first - size + 1, 0), np.minimum(first, len(h) - size)
            cut = np.nonzero(begin[1:] > end[:-1] + 1)[0] + 1
            best: dict[int, tuple[float, int, int]] = {}
            for part in np.split(np.arange(len(first)), cut):
                a, b = int(begin[part[0]]), int(end[part].max())
                for lower in range(a, b + 1, 1 << 14):
                    upper = min(b + 1, lower + (1 << 14))
                    if upper <= lower:
                        continue
                    prints = _window_prints(h[lower : upper - 1 + size], size)
                    for i, windows in self.near(size, prints):
                        mine = self.items[i][1]
                        for w in windows.tolist():
                            s = similarity(h[lower + w : lower + w + size], mine)
                            if s >= least and (i not in best or s > best[i][0]):
                                best[i] = (s, lower + w, int(np.bitwise_count(prints[w] ^ self.prints[i])))
            out += [(self.items[i][0], p, d, s) for i, (s, p, d) in best.items()]
        return out


def _indexes(benchmark: DataFrame, id_col: str, text_col: str):
    """One broadcast index for each block of the benchmark."""
    items = benchmark.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null").distinct()
    n = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-n["n"] // BLOCK_ITEMS), -(-n["c"] // BLOCK_CHARS))
    for b in range(blocks):
        # equal items may fall to different blocks, so that none outgrows its bound
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["k"], r["t"]) for r in block.collect()]))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, differing_bits, similarity): the best window of each document for each item.

    For an item with more words than the document, the window is the whole document, at any differing bits.

    Words are runs of letters and digits, lower case. Items of fewer than five words match where they stand
    word by word; items without a word, null items and null or empty documents match nothing; repeated rows
    give repeated rows, of equal items each gives its own. An empty table, or benchmark, gives no row. Other
    columns are ignored.
    """

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = _Hashes()
            for b in batches:
                rows: list = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows += [(k, *m) for m in index.value.search(word_hashes(t, cache), least)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        return run

    names = [id_col, "item_id", "first_word", "differing_bits", "similarity"]
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([(names[0], to_arrow_type(docs.schema[id_col].dataType)), ("item_id", pa.int64()), ("first_word", pa.int64()), ("differing_bits", pa.int32()), ("similarity", pa.float64())])
    ddl = f"`{id_col}` {kind}, item_id bigint, first_word bigint, differing_bits int, similarity double"
    out = None
    for index in _indexes(benchmark, item_id, item_text):
        part = docs.select(id_col, text_col).mapInArrow(scan(index), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window like a benchmark item; all columns kept, nothing shuffled.

    What ``matches`` finds nothing in stays: null and empty texts, and everything if the benchmark is empty.
    """

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = _Hashes()
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not index.value.search(word_hashes(t, cache), least) for t in texts], pa.bool_()))

        return run

    for index in _indexes(benchmark, item_id, item_text):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
