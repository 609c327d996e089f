"""Secret scans by a battery of randomness tests (operator 11).

Three patterns give the base spans: values assigned to telling names, access key ids, long hexadecimal numbers. The
battery adds strings that look drawn at random. A candidate is a stretch of at least 20 letters, digits and ``+/_-``.
Its encoding is inferred, the narrowest of five alphabets that holds all its characters; under that alphabet, of k
letters numbered from 0, three statistics with known mean and variance for uniform random draws are taken:

* chi-squared of the letters' counts, for alphabet uniformity: mean k - 1, variance 2 (k - 1) (n - 1) / n;
* runs of letters in the lower and in the upper half: a change at each of n - 1 places with probability 1/2;
* serial correlation, the sum of products of neighbouring letters' distances from the mean letter.

T, the sum of their squared standard scores, is small for random strings. A string passes the battery with T up to
``PASSES``, which one of a thousand random strings exceeds. Short strings of words can pass by chance, so that passing
isn't enough: ordinary text tells how often. All text outside the candidates, squeezed to the letters of each alphabet,
is cut into windows of the lengths at which the length classes begin; their T's are counted over all documents. A
candidate's p is the share of the windows of its encoding and class with a T as small as its own (rounded up to bins of
T). Longer ordinary strings look less random than the windows of their class, so p is never too small. Candidates of
each length class are chosen by Benjamini and Hochberg's rule at ``ALPHA``: of the spans reported in a class, short or
long, at most that share is expected to be ordinary text.

Texts are read once and moved nowhere: the first pass stores spans, candidates and counts. The driver gets at most one
row for each encoding, class and bin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Kinds of spans, in the order of ties.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Lengths at which classes begin.
CLASSES = [20, 28, 40, 64]
PASSES, ALPHA = 16.27, 0.01
#: Bins of T: so many to one, up to a last one for all above.
FINE, BINS = 4, 400
#: Characters of texts whose windows are held at once.
ROUND_CHARS = 500_000
#: Windows whose letters are counted at once.
ROUND_WINDOWS = 20_000
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets as groups of characters that are one letter; those of one case hold either.
ALPHABETS = {
    "digits": list(_DIGITS),
    "hex": [*_DIGITS, *(c + c.upper() for c in _LOWER[:6])],
    "base32": [*(c + c.upper() for c in _LOWER), *"234567"],
    "alnum": [*(c + c.upper() for c in _LOWER), *_DIGITS],
    "base64": [*_LOWER.upper(), *_LOWER, *_DIGITS, "+-", "/_"],
}
ENCODINGS = list(ALPHABETS)


def _letters(alphabet: list[str]) -> tuple[bytes, bytes]:
    """Tables for bytes.translate: a letter's number for each byte, bytes to leave out; line feeds stay, as number 255."""
    of, rest = bytearray(256), bytearray(range(256))
    for k, chars in enumerate(alphabet):
        for c in chars:
            of[ord(c)] = k
            rest.remove(ord(c))
    of[10] = 255
    rest.remove(10)
    return bytes(of), bytes(rest)


_TABLES = {e: _letters(a) for e, a in ALPHABETS.items()}


def encoding(s: str) -> int:
    """Number of the narrowest alphabet that holds all characters of a candidate."""
    one_case = s.lower() == s or s.upper() == s
    if s.isdigit():
        return 0
    if one_case and re.fullmatch("[0-9a-fA-F]+", s):
        return 1
    if re.fullmatch("[A-Z2-7]+", s):
        return 2
    return 3 if one_case and s.isalnum() else 4


def battery(x: np.ndarray, k: int) -> np.ndarray:
    """T of each row of letters' numbers below k: squared standard scores of chi-squared, runs and serial correlation, summed."""
    m, n = x.shape
    counts = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi = (k / n * np.einsum("ij,ij->i", counts, counts) - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    high = x >= k // 2
    runs = ((high[:, 1:] != high[:, :-1]).sum(1) - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    twice = 2 * x.astype(np.int32) - (k - 1)  # twice the distance from the mean letter
    serial = np.einsum("ij,ij->i", twice[:, 1:], twice[:, :-1]) / (4 * (k * k - 1) / 12 * np.sqrt(n - 1))
    return chi**2 + runs**2 + serial**2


def bins(t: np.ndarray) -> np.ndarray:
    """The bin of each T; a T at its upper end is in it."""
    return np.minimum(np.ceil(t * FINE).astype(np.int64), BINS - 1)


def windows(text: str, e: str) -> Iterator[tuple[int, np.ndarray]]:
    """(class, rows of letters' numbers): each line of ``text``, squeezed, is cut into windows of all classes in turn."""
    squeezed = np.frombuffer(text.encode("ascii", "ignore").translate(*_TABLES[e]), np.uint8)
    ends = np.append(np.nonzero(squeezed == 255)[0], len(squeezed))
    starts = np.concatenate([[0], ends[:-1] + 1])
    cycle, at = sum(CLASSES), 0
    for c, n in enumerate(CLASSES):
        times = np.maximum((ends - starts - at - n) // cycle + 1, 0)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = np.repeat(starts + at, times) + within * cycle
        for k in range(0, len(place), ROUND_WINDOWS):
            yield c, np.lib.stride_tricks.sliding_window_view(squeezed, n)[place[k : k + ROUND_WINDOWS]]
        at += n


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the patterns' matches; a match that is too short is spent all the same."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _scanned(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """A row for each text, with its base spans and its candidates, and rows of counts of ordinary windows."""
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())])
    count = pa.struct([("encoding", pa.int32()), ("class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
        fields = [f.name for f in kind]
        return pa.array([[dict(zip(fields, x)) for x in r] for r in rows], pa.list_(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = np.zeros((len(ENCODINGS), len(CLASSES), BINS), np.int64)
        types: list[pa.DataType] = []

        def counted(lines: list[str]) -> None:
            text = "\n".join(lines)
            for e, name in enumerate(ENCODINGS):
                for c, rows in windows(text, name):
                    ordinary[e, c] += np.bincount(bins(battery(rows, len(ALPHABETS[name]))), minlength=BINS)

        for b in batches:
            types = [c.type for c in b.columns[1:]]
            spans, found, held, chars = [], [], [], 0
            same: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}
            for k, text in enumerate(b.column(0).to_pylist()):
                text = text or ""
                spans.append(base_spans(text))
                found.append([])
                at = 0
                rest = []
                for m in CANDIDATE.finditer(text):
                    s = m[0].rstrip("=")
                    rest.append(text[at : m.start()])
                    at = m.end()
                    if not any(x <= m.start() and m.end() <= y for x, _, y in spans[-1]):
                        e = encoding(s)
                        same.setdefault((e, len(s)), []).append((k, m.start(), m.end(), s.encode().translate(_TABLES[ENCODINGS[e]][0])))
                rest.append(text[at:])
                held.append(" ".join(rest).replace("\n", " "))
                chars += len(held[-1])
                if chars >= ROUND_CHARS:
                    counted(held)
                    held, chars = [], 0
            counted(held)
            for (e, n), those in same.items():
                for k in range(0, len(those), part := max(1, 1_000_000 // n)):
                    some = those[k : k + part]
                    t = bins(battery(np.frombuffer(b"".join(x[3] for x in some), np.uint8).reshape(len(some), n), len(ALPHABETS[ENCODINGS[e]])))
                    c = max(i for i, low in enumerate(CLASSES) if low <= n)
                    for x, bin_ in zip(some, t.tolist()):
                        found[x[0]].append((x[1], x[2], e, c, bin_))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], structs(spans, span), structs([sorted(f) for f in found], candidate), pa.nulls(len(spans), pa.list_(count))], names=[*names, "spans", "candidates", "ordinary"])
        if ordinary.any():
            rows = [(*map(int, x), int(ordinary[tuple(x)])) for x in np.argwhere(ordinary)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.nulls(1, pa.list_(span)), pa.nulls(1, pa.list_(candidate)), structs([rows], count)], names=[*names, "spans", "candidates", "ordinary"])

    return docs.select(F.col(text_col).alias("__secret_text"), *names).mapInArrow(
        run, f"{ddl}spans array<struct<start:bigint,kind:int,end:bigint>>, candidates array<struct<start:bigint,end:bigint,encoding:int,class:int,bin:int>>, ordinary array<struct<encoding:int,class:int,bin:int,n:bigint>>"
    )


def chosen(candidates: dict[tuple[int, int, int], int], ordinary: dict[tuple[int, int, int], int], alpha: float = ALPHA) -> dict[tuple[int, int], int]:
    """The last bin that is reported, for each (encoding, class); -1 for none.

    p of (encoding, class, bin) is (1 + ordinary windows up to the bin) / (1 + all of encoding and class). Of a class's m
    candidates those with a p up to the greatest p at most alpha * (number of candidates with a p up to it) / m are taken.
    """
    p: dict[tuple[int, int, int], float] = {}
    for e in range(len(ENCODINGS)):
        for c in range(len(CLASSES)):
            n = [ordinary.get((e, c, b), 0) for b in range(BINS)]
            upto = np.cumsum(n)
            p |= {(e, c, b): (1 + int(upto[b])) / (1 + int(upto[-1])) for b in range(BINS)}
    out = {}
    for c in range(len(CLASSES)):
        by_p = Counter()
        for key, n in candidates.items():
            if key[1] == c:
                by_p[p[key]] += n
        m, seen, most = sum(by_p.values()), 0, -1.0
        for value in sorted(by_p):
            seen += by_p[value]
            if value <= alpha * seen / m:
                most = value
        last = int(PASSES * FINE)
        for e in range(len(ENCODINGS)):
            out[e, c] = max((b for b in range(last + 1) if p[e, c, b] <= most), default=-1)
    return out


def _totals(rows: DataFrame, col: str, n: Column) -> dict[tuple[int, int, int], int]:
    each = rows.where(f"{col} is not null").select(F.explode(col).alias("x"))
    return {(r[0], r[1], r[2]): r[3] for r in each.groupBy("x.encoding", "x.class", "x.bin").agg(F.sum(n)).collect()}


def scan(docs: DataFrame, alpha: float = ALPHA, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``columns`` of ``docs`` (default: its id) with _secrets: an array of (kind, start, end), by start and order of KINDS.

    Places are code points, ends exclusive; a span of kind assign is the whole match, name and all. Spans of kind random
    are candidates that the battery chooses at the false discovery rate ``alpha`` and that lie within no base span. Null
    and empty texts have none. Rows are handled one by one; repeated rows count again in the corpus's counts. A column
    named _secrets is replaced. An empty table gives an empty result, and a corpus without ordinary text no random spans.
    """
    names = [c for c in dict.fromkeys(columns or [id_col]) if c != "_secrets"]
    aliases = [f"__secret_{k}" for k in range(len(names))]
    given = docs.select(*[F.col(c).alias(x) for c, x in zip(names, aliases)], F.col(text_col).alias("__secret_of"))
    rows = cut(_scanned(given, aliases, "__secret_of"))
    last = chosen(_totals(rows, "candidates", F.lit(1)), _totals(rows, "ordinary", F.col("x.n")), alpha)
    upto = F.array(*[F.lit(last[e, c]) for e in range(len(ENCODINGS)) for c in range(len(CLASSES))])
    random = F.transform(
        F.filter("candidates", lambda x: x["bin"] <= F.get(upto, x["encoding"] * len(CLASSES) + x["class"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")),
    )
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("spans", random)), lambda x: F.struct(F.get(kinds, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.where("ordinary is null").select(*[F.col(x).alias(c) for c, x in zip(names, aliases)], spans.alias("_secrets"))
