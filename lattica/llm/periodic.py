"""Periodic run detection by bit-parallel lags (operator 12).

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that no
neighbouring word extends. The words of a text are numbered by first occurrence, and bit k of all numbers is one big
integer, plane k. For a lag q, a plane XORed with itself shifted by q has a bit wherever words q apart differ in bit k;
the planes' differences ORed are the mismatches. Where they have a long enough stretch of zeros is a run: AND of the
matches with themselves, shifted by 1, 2, 4, ... leaves a bit only at places from which a whole stretch of the needed
length matches. Most lags end after two planes and a few doublings, when nothing is left.

Runs of several lags can be one stretch: with periods q and q' < q and at least four times q words, it also has their
greatest common divisor as period (two periods within a stretch as long as both), so the least lag that finds a stretch
is its smallest period.

A text is handled by itself, inside its task; nothing is shuffled. Lags of texts of over ``LONG`` words are first
sifted: a run of period q repeats its word at each of at least ``times`` consecutive multiples of q, which takes n / q
comparisons for a lag and n log n for all. The sift drops only lags without a run, at any length of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Words from which lags are sifted: where that costs less than the bit planes.
LONG = 8_192
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def planes(ids: np.ndarray) -> list[int]:
    """Bit k of all ids as one integer, for each k; the last one is all zeros' or the highest that any id has."""
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def stretches(matches: int, need: int) -> int:
    """Places from which ``need`` consecutive bits are set."""
    have = 1
    while have < need and matches:
        step = min(have, need - have)
        matches &= matches >> step
        have += step
    return matches


def _lags(ids: np.ndarray, most: int, times: int) -> Iterator[int]:
    """Lags up to ``most`` of which some word stands at ``times`` consecutive multiples."""
    for q in range(1, most + 1):
        at = ids[::q]
        same = at[1:] == at[:-1]
        for _ in range(times - 2):
            same = same[1:] & same[:-1]
        if same.any():
            yield q


def find_runs(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n = len(words)
    if n < least:
        return []
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, n)
    bit = planes(ids)
    everything, found = (1 << n) - 1, {}
    most = n // times
    for q in _lags(ids, most, times) if n > LONG else range(1, most + 1):
        need = max(least, times * q) - q
        inside = everything >> q
        apart = bit[0] ^ bit[0] >> q
        if len(bit) > 1:
            apart |= bit[1] ^ bit[1] >> q
        left = stretches(inside & ~apart, need)
        if left and len(bit) > 2:
            for plane in bit[2:]:
                apart |= plane ^ plane >> q
            left = stretches(inside & ~apart, need)
        while left:
            start = (left & -left).bit_length() - 1
            ones = left >> start
            size = (~ones & ones + 1).bit_length() - 1  # places in a row, each of which begins a stretch
            found.setdefault((start, size - 1 + need + q), q)
            left = ones >> size << size + start
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[from, to) of the places among n words that no run holds after its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + length) for s, length, q in found):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, n)] if at < n else out


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``columns`` of ``docs`` (default: its id) with _runs (an array of start, length, period, by start and period) and _collapsed.

    Words are what stands between ASCII white space, numbered from 0; _collapsed has the words that no run contains after
    its first period, joined by one space. Null and empty texts have no runs and collapse to an empty text. Rows are
    handled one by one: a null id, repeated rows and ties need no rule. Columns named _runs or _collapsed are replaced.
    An empty table gives an empty result. ``times`` is 4 at least: below, one stretch could have two smallest periods.
    """
    if times < 4 or least < 1:
        raise ValueError("runs need at least four periods and one word")
    names = [c for c in dict.fromkeys(columns or [id_col]) if c not in ("_runs", "_collapsed")]
    kinds = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, values, collapsed = [0], [], []
            for text in b.column(0).to_pylist():
                words = _WORD.findall(text or "")
                found = find_runs(words, least, times)
                values += found
                place.append(len(values))
                collapsed.append(" ".join(words) if not found else " ".join(w for a, z in kept(len(words), found) for w in words[a:z]))
            columns = list(zip(*values)) if values else [(), (), ()]
            each = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(place, pa.int32()), each), pa.array(collapsed, pa.string())], names=[*names, "_runs", "_collapsed"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return docs.select(F.col(text_col).alias("__periodic_text"), *names).mapInArrow(run, f"{ddl}, _runs array<{RUN}>, _collapsed string")


def best(found: Column) -> Column:
    """Of an array of runs the one with the greatest length by period, compared exactly; ties: smallest start, then period; null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda top, x: F.when(more(x, top), x).otherwise(top))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` of which every tenth text, by crc32 of its id, repeats a part of itself from some word on."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    rows = docs.withColumn("__periodic_words", F.when(h % 10 == 0, words)).withColumn("__periodic_n", F.size("__periodic_words"))
    n = F.col("__periodic_n")
    some = n > 0
    rows = rows.withColumn("__periodic_a", F.when(some, F.pmod(g, n)).cast("int"))
    a = F.col("__periodic_a")
    rows = rows.withColumn("__periodic_p", F.when(some, 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    again = F.transform(F.sequence(a, n - 1), lambda i: F.get("__periodic_words", a + F.pmod(i - a, F.col("__periodic_p"))))
    text = F.when(some, F.array_join(F.concat(F.slice("__periodic_words", F.lit(1), a), again), " ")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).drop("__periodic_words", "__periodic_n", "__periodic_a", "__periodic_p")


#: The registered query: crc32 from its definition, runs as islands of equal words a lag apart.
ORACLE = """
WITH RECURSIVE ids AS (SELECT doc_id, coalesce(text, '') AS text, [ord(c) FOR c IN string_split(doc_id::VARCHAR, '')] AS b FROM documents),
h AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, flatten([[x, 0, 0, 0, 0, 0, 0, 0] FOR x IN b])::BIGINT[]),
  lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS h FROM ids),
cutup AS (SELECT doc_id, h, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM h),
sized AS (SELECT doc_id, h, w, len(w) AS n, h // 10 AS g FROM cutup),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
dealt AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
words AS (SELECT doc_id, n, i, CASE WHEN a IS NOT NULL AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM dealt)),
matches AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM matches),
found AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY doc_id, start, length),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS r FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
rest AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, t.start, t.length, t.period, 1000 * t.length // t.period AS exponent_milli,
  sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(c.collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN top t ON t.doc_id = d.doc_id AND t.r = 1 LEFT JOIN rest c ON c.doc_id = d.doc_id
"""
