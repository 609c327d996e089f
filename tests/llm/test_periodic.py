"""Operator 12 against the definition of a run."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import periodic, queries


def brute(words):
    """Every stretch is tried: smallest period by comparing, length, and both neighbours."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    out.add((i, len(stretch), q))
            i = j + 1
    return sorted(out)


def gone(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_runs_are_those_of_the_definition(words):
    found = periodic.find_runs(words)
    assert found == brute(words)
    assert [w for a, z in periodic.kept(len(words), found) for w in words[a:z]] == gone(words, found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 40), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.randoms())
def test_planted_repeats(parts, rng):
    words = [str(w) for part, times in parts for w in part * times + [rng.randrange(40)]]
    assert periodic.find_runs(words) == brute(words)


def test_sifted_lags_lose_no_run(monkeypatch):
    rng = random.Random(3)
    for _ in range(30):
        words = [rng.choice("ab") for _ in range(rng.randrange(300))]
        at, p = rng.randrange(len(words) + 1), rng.randrange(1, 30)
        words[at:at] = [rng.choice("abcdef") for _ in range(p)] * rng.randrange(2, 7)
        monkeypatch.setattr(periodic, "LONG", 10**9)
        whole = periodic.find_runs(words)
        monkeypatch.setattr(periodic, "LONG", 0)
        assert periodic.find_runs(words) == whole == brute(words)


def test_a_very_long_text_of_one_phrase():
    words = ["x"] + "one two three".split() * 30_000 + ["y"]
    assert periodic.find_runs(words) == [(1, 90_000, 3)]


def test_awkward_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (None, "a " * 9, 1), (4, "a b " * 4, 1), (4, "a b " * 4, 1), (5, "é x " * 6, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _runs int")
    got = {(r.doc_id, r._collapsed, tuple(map(tuple, r._runs))) for r in periodic.runs(docs).collect()}
    assert got == {(1, "", ()), (2, "", ()), (3, "", ()), (None, "a", ((0, 9, 1),)), (4, "a b", ((0, 8, 2),)), (5, "é x", ((0, 6, 1),))}
    assert periodic.runs(docs).count() == len(rows)
    assert periodic.runs(docs.where("false")).count() == 0
    assert periodic.runs(docs, columns=["doc_id", "text"]).columns == ["doc_id", "text", "_runs", "_collapsed"]


def test_best_compares_exactly(spark):
    df = spark.sql("select array(named_struct('start', 9L, 'length', 21L, 'period', 5L), named_struct('start', 3L, 'length', 42L, 'period', 10L), named_struct('start', 1L, 'length', 8L, 'period', 2L)) as r, array() as e")
    assert df.select(periodic.best(F.col("r")).alias("b")).first().b.asDict() == {"start": 9, "length": 21, "period": 5}


def test_query_by_its_definition(spark, data):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = [w for w in __import__("re").split(r"[ \t-\r]+", d.text or "") if w]
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if len(words) > 1500:
            continue
        found, r = brute(words), got[d.doc_id]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.n_runs == len(found)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(gone(words, found)))
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (top[1] * 1000 // top[2] if found else None)
