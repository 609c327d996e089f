"""Line dedup by a segment-partition edit join (operator 4).

Lines within ``tau`` edits of each other are one class, closed over chains; of each class, the first
line in (doc_id, text hash, position) order stays and all others go. The join: a line is split into
tau + 1 segments; tau edits leave one of them intact in any line within reach, at a start position
that the lengths bound (multi-match-aware substring selection). So each distinct line is indexed by
(length, segment number, segment) and probes, for every length from its own down to tau less, the
substrings at those positions. Candidates carry a 64-bit parity sketch of their character pairs:
one edit flips at most four of its bits, so pairs that differ in more than 4 tau bits are left
inside the join. The rest are verified by a banded bit-parallel edit distance.

Texts are never shuffled for the join: its rows hold hashes, computed by vector operations. The index is
stored once, and the shuffle files of each step go when it ends (:func:`lattica.llm.common.cut`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_links, connected_components, cut, drop, small

TAU = 2
#: Shorter lines stay as they are: a few characters repeat by chance.
MIN_CHARS = 20
#: White space cut from both ends of a line before it is compared.
BLANK = " \t\r"
#: Lines and characters that one round of key generation holds; lines of which a task knows that it has seen them.
ROUND_LINES, ROUND_CHARS, SEEN_LINES = 4_000, 250_000, 200_000
#: Keys of longer lines are hashes of the substrings themselves, which take no arrays over all characters.
LONG_LINE = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def edit_distance(a: str, b: str, tau: int) -> int:
    """Edits between a and b, or tau + 1 if there are more.

    Register e has a bit for each diagonal of the band: reachable with at most e edits. The window of ``a`` that
    the band covers moves along with ``b``, so that very long lines cost time in proportion to their length.
    """
    shift = len(a) - len(b)
    if abs(shift) > tau:
        return tau + 1
    band = (1 << 2 * tau + 1) - 1
    seen: dict[str, int] = {}  # places at which a character enters the window, counted from its last moves
    at: dict[str, int] = {}
    r = [1 << tau]
    for _ in range(tau):
        r.append(r[-1] | r[-1] << 1 & band)
    for i, c in enumerate(a[:tau]):
        at[c] = at.get(c, 0) | 1 << i + tau
        seen[c] = 0
    for j, c in enumerate(b):
        if j + tau < len(a):
            new = a[j + tau]
            at[new] = (at.get(new, 0) >> j - seen.get(new, j)) | 1 << 2 * tau
            seen[new] = j
        match = (at.get(c, 0) >> j - seen.get(c, j)) & band
        before, left = 0, 0
        for e in range(tau + 1):
            was = r[e]
            r[e] = left = (was & match | before | before >> 1 | left << 1) & band
            before = was
        if not left:
            return tau + 1
    goal = 1 << shift + tau
    return next((e for e in range(tau + 1) if r[e] & goal), tau + 1)


def _segments(n: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the tau + 1 segments of lines of n characters: even, longer ones last."""
    short, longer = n // (tau + 1), n % (tau + 1)
    out, start = [], np.zeros_like(n)
    for k in range(tau + 1):
        size = short + (k >= tau + 1 - longer)
        out.append((start, size))
        start = start + size
    return out


class _Round:
    """Prefix sums over the characters of some lines: a hash of any substring, and parity sketches."""

    def __init__(self, lines: list[str]):
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.size) - self.size
        n = len(code)
        grow = np.full(n + 1, _BASE, np.uint64)
        grow[0] = 1
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum((code + np.uint64(7)) * np.cumprod(grow)[:n], out=self.sum[1:])
        pair = (code[:-1] * np.uint64(0x100000001B3) ^ code[1:]) * _MIX
        bit = np.uint64(1) << (pair >> np.uint64(58))
        last = self.start + self.size - 1
        bit = np.append(bit, np.uint64(0))
        bit[last] = 0  # a pair across two lines
        self.bits = np.bitwise_xor.reduceat(bit, self.start)

    def key(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        a = self.start[rows] + start
        h = (self.sum[a + size] - self.sum[a]) * self.back[a]
        h ^= (length.astype(np.uint64) * np.uint64(64) + np.uint64(segment)) * np.uint64(0xA24BAED4963EE407)
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def index(self, tau: int, most: int = LONG_LINE) -> tuple[np.ndarray, np.ndarray]:
        rows = np.nonzero(self.size <= most)[0]
        size = self.size[rows]
        keys = [self.key(rows, s, n, size, k) for k, (s, n) in enumerate(_segments(size, tau))]
        return np.tile(rows, tau + 1), np.concatenate(keys)

    def probes(self, tau: int, most: int = LONG_LINE) -> tuple[np.ndarray, np.ndarray]:
        rows, keys = [], []
        for less in range(tau + 1):
            length = self.size - less
            for k, (s, n) in enumerate(_segments(length, tau)):
                for move in _moves(k, less, tau):
                    ok = np.nonzero((s + move >= 0) & (s + move + n <= self.size) & (n > 0) & (length <= most))[0]
                    rows.append(ok)
                    keys.append(self.key(ok, (s + move)[ok], n[ok], length[ok], k))
        return np.concatenate(rows), np.concatenate(keys)


def _moves(segment: int, less: int, tau: int) -> range:
    """Shifts of a segment in a line ``less`` characters longer: at most as many edits as segments before it, and the rest after it."""
    return range(max(-segment, less - (tau - segment)), min(segment, less + (tau - segment)) + 1)


def _long_keys(line: str, tau: int, probe: bool, most: int) -> list[int]:
    """Keys of a line for lengths above ``most``."""
    out = []
    for less in range(tau + 1 if probe else 1):
        if (length := len(line) - less) <= most:
            continue
        for k, (s, n) in enumerate(_segments(np.array([length]), tau)):
            for move in _moves(k, less, tau) if probe else (0,):
                at = int(s[0]) + move
                if 0 <= at and at + int(n[0]) <= len(line):
                    out.append(xxhash.xxh64_intdigest(line[at : at + int(n[0])].encode("utf-32-le", "surrogatepass"), length * 64 + k))
    return out


def _long_bits(line: str, piece: int) -> int:
    """The parity sketch of a long line, piece by piece."""
    out = 0
    for at in range(0, len(line) - 1, piece):
        out ^= int(_Round([line[at : at + piece + 1]]).bits[0])
    return out


def _key_rows(docs: DataFrame, text_col: str, tau: int, min_chars: int, probe: bool) -> DataFrame:
    """(key, id, bits) of the distinct lines of each task, id being a line's XXH64."""
    most = LONG_LINE

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        seen: set[int] = set()
        held, chars = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(BLANK)
                    if len(line) < min_chars or (h := hash(line)) in seen:
                        continue
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(h)
                    held.append(line)
                    chars += len(line)
                    if len(held) >= ROUND_LINES or chars >= ROUND_CHARS:
                        yield held
                        held, chars = [], 0
        if held:
            yield held

    def identity(line: str) -> int:
        return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)

    def batch(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64, copy=False).view(np.int64)) for x in (keys, ids, bits)], names=["key", "id", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in rounds(batches):
            for line in lines:
                if len(line) > most:
                    keys = np.array(_long_keys(line, tau, probe, most), np.uint64)
                    yield batch(keys, np.full(len(keys), identity(line), np.uint64), np.full(len(keys), _long_bits(line, most), np.uint64))
            lines = [x for x in lines if len(x) <= most + tau]
            if not lines:
                continue
            ids = np.fromiter(map(identity, lines), np.uint64, len(lines))
            r = _Round(lines)
            rows, keys = r.probes(tau, most) if probe else r.index(tau, most)
            for at in range(0, len(rows), 50_000):
                own = rows[at : at + 50_000]
                yield batch(keys[at : at + 50_000], ids[own], r.bits[own])

    return docs.select(text_col).mapInArrow(run, "key bigint, id bigint, bits bigint")


def _line(col: Column) -> Column:
    return F.trim(col, F.lit(BLANK))


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, pos, line) of all lines; row tells rows of one id with different texts apart."""
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), row.alias("row"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", _line(F.col("line")))


def _place() -> Column:
    """Order of line occurrences as one number, of which a hash aggregation can keep the least: id, row, position."""
    tens = lambda n: F.lit(str(10**n)).cast(f"decimal({n + 1},0)")
    first = F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63))).cast("decimal(19,0)")
    within = F.pmod("row", F.lit(10**9)).cast("decimal(9,0)") * tens(10) + F.col("pos").cast("decimal(10,0)")
    return (first * tens(19) + within).cast("decimal(38,0)")


def links(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """(a, b) of XXH64 hashes of distinct lines within ``tau`` edits, complete up to connectivity."""

    def verify(pairs: DataFrame) -> DataFrame:
        ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        line = F.explode(F.split(text_col, "\n"))
        texts = docs.select(line.alias("line")).select(_line(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
        texts = texts.select(F.xxhash64("line").alias("id"), "line").join(small(ids, ids.count()), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
        texts = cut(texts)
        drop(ids)
        with_both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
                near = [edit_distance(p, q, tau) <= tau for p, q in zip(x, y)]
                yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        out = cut(with_both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
        drop(texts)
        return out

    # a line that many tasks have seen is indexed once
    index = cut(_key_rows(docs, text_col, tau, min_chars, False).distinct())
    out = bucket_links(index, _key_rows(docs, text_col, tau, min_chars, True), 4 * tau, verify)
    drop(index)
    return out


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, exact, near): for each row that loses lines, the positions that repeat an equal or a near line."""
    places = cut(_exploded(docs, id_col, text_col).where(F.length("line") >= min_chars).select("id", "row", "pos", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g")))
    found = links(docs, tau, min_chars, text_col)
    comp = connected_components(found)
    drop(found)
    # lines that occur once and are near no other take no part from here on
    repeated = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(None).cast("bigint").alias("component"))
    wanted = cut(repeated.unionByName(comp.select(F.col("node").alias("h"), "component")).groupBy("h").agg(F.max("component").alias("component")))
    here = _place()
    rows = cut(places.join(small(wanted, wanted.count()), "h").select("id", "row", "pos", "h", "g", "component", here.alias("here")))
    drop(places, comp, wanted)
    firsts = cut(rows.groupBy("h", "g", "component").agg(F.min("here").alias("own")))
    lead = cut(firsts.where("component is not null").groupBy("component").agg(F.min("own").alias("lead")))
    known = cut(firsts.join(small(lead, lead.count()), "component", "left").select("h", "g", "own", F.coalesce("lead", "own").alias("lead")))
    drop(firsts, lead)
    gone = rows.join(small(known, known.count()), ["h", "g"]).where(F.col("here") != F.col("lead"))
    again = F.col("here") != F.col("own")
    out = cut(
        gone.groupBy("id", "row").agg(F.collect_set(F.when(again, F.col("pos"))).alias("exact"), F.collect_set(F.when(~again, F.col("pos"))).alias("near"))
    )
    drop(rows, known)
    return out


def dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text reduced to its kept lines, and _lines, _exact, _near: lines in all, dropped as equal, as near.

    Null texts stay null (0 lines). Equal lines of one document count as repeats. Rows that repeat a whole
    row (id and text) share their positions and keep the same lines; a null id is an id of its own, before
    all others. Lines under ``min_chars`` characters always stay. Columns of ``docs`` named _lines, _exact or
    _near are replaced. An empty table gives an empty result.
    """
    gone = dropped_lines(docs, tau, min_chars, id_col, text_col)
    gone = gone.select(*[F.col(c).alias(f"__line_{c}") for c in gone.columns], F.array_union("exact", "near").alias("__line_all"))
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    # a text travels as its lines, which make it up again, and is split once
    split = docs.drop("_lines", "_exact", "_near").withColumn("__line_key", row).withColumn("__line_of", F.split(text_col, "\n"))
    split = split.select(*[F.col("__line_of").alias(c) if c == text_col else c for c in split.columns if c != "__line_of"])
    joined = split.join(gone.hint("shuffle_hash"), F.col("__line_key").eqNullSafe(F.col("__line_row")) & F.col(id_col).eqNullSafe(F.col("__line_id")), "left")
    n = F.coalesce(F.size(text_col), F.lit(0))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(text_col) - 1), F.col("__line_all")), lambda i: F.get(text_col, i))
    names = [c for c in docs.columns if c not in ("_lines", "_exact", "_near")]
    text = F.array_join(F.when(F.col("__line_all").isNull(), F.col(text_col)).otherwise(kept), "\n")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], F.when(F.col(text_col).isNull(), 0).otherwise(n).alias("_lines"), count("__line_exact").alias("_exact"), count("__line_near").alias("_near"))
