"""Operator 13 against the definition of groups and links, with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import align, queries


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.B_PATH)


def spans(spelled):
    out, at = [], 0
    for b in spelled:
        out.append((at, at + len(b)))
        at += len(b)
    return out


def brute(plain, text):
    """(a ids, b ids, groups as text, id pairs of all links): every pair of tokens is compared."""
    a, b = plain
    letters, m = align.byte_letters(), b
    if not text:
        return [], [], "", []
    p, q = a.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
    sp = [bytes(letters[c] for c in a.id_to_token(k)) for k in p]
    sq = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.IsByte(k) else m.id_to_piece(k).replace("▁", " ").encode() for k in q]
    if b"".join(sp) != (" " + text).encode() or b"".join(sq) != (" " + text).encode():
        return [], [], "", []
    x, y = spans(sp), spans(sq)
    links = [(i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s < f and t < e]
    cuts = sorted({e for _, e in x} & {e for _, e in y})
    groups, low = [], 0
    for c in cuts:
        mine = [str(k) for k, (s, e) in zip(p, x) if low <= s and e <= c]
        other = [str(k) for k, (s, e) in zip(q, y) if low <= s and e <= c]
        groups.append(",".join(mine) + "|" + ",".join(other))
        low = c
    return p, q, ";".join(groups), [(p[i], q[j]) for i, j in links]


TEXTS = ["", "a", "  two  spaces \n\n and lines\t", "naïve café Straße", "<|endoftext|></s><s>", "▁a", "漢字とかな", "x\0y", "👩‍👩‍👧 family", "it's they'll", "1234567 89,5", "ﬁ ligature", "<0x0A>", "a" * 40, "\xa0　", "antidisestablishmentarianism"]


def check(plain, texts):
    a, b = align.encoders(align.A_PATH, align.B_PATH)
    numbers, groups, doc, pair = align._aligned(a, b, texts)
    for k, text in enumerate(texts):
        p, q, want, links = brute(plain, text)
        assert numbers[:, k].tolist() == [len(p), len(q), want.count(";") + 1 if want else 0, len(links)]
        assert groups[k] == want
        assert sorted((int(x) // len(b.spelled), int(x) % len(b.spelled)) for x in pair[doc == k]) == sorted(links)


def test_texts(plain):
    check(plain, TEXTS)
    check(plain, ["", ""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_texts(plain, texts):
    check(plain, texts)


def test_rounds_and_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 2)], "doc_id bigint, text string")
    whole = sorted(map(tuple, align.aligned(docs).collect()))
    for name, value in (("ROUND_CHARS", 30), ("BLOCK_CHARS", 60), ("PAIR_ROW", 3)):
        monkeypatch.setattr(align, name, value)
    assert sorted(map(tuple, align.aligned(docs.repartition(3)).collect())) == whole


def test_roots():
    import numpy as np

    u = np.arange(999)
    assert (align.roots(1000, u, u + 1) == 0).all()
    assert (align.roots(1000, u[::-1] + 1, u[::-1]) == 0).all()
    assert align.roots(4, np.array([3]), np.array([1])).tolist() == [0, 1, 2, 1]
    assert align.roots(0, u[:0], u[:0]).tolist() == []


def test_query_by_its_definition(spark, data, plain):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 1500")
    got = {r.doc_id: r for r in align.aligned(docs).collect()}
    every = {r.doc_id: brute(plain, r.text) for r in docs.collect()}
    assert len(got) == len(every) > 50
    counts = Counter(pair for *_, links in every.values() for pair in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for k, (p, q, groups, links) in every.items():
        want = (len(p), len(q), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
        assert (got[k].n_a, got[k].n_b, got[k].n_groups, got[k].n_links, got[k].n_best, got[k].count_sum) == want
        assert got[k].groups == groups
    table = {(r.a_id, r.b_id): (r["count"], r.best) for r in align.translation(docs).collect()}
    assert table == {x: (n, n == most[x[1]]) for x, n in counts.items()}


def test_registered_query(spark, data):
    got = {r.doc_id: r for r in queries.QUERIES["op13_tokenizer_alignment"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.groups for r in align.aligned(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert len(got) == len(docs) == len(texts)
    for d in docs:
        assert got[d.doc_id].groups_sha256 == (hashlib.sha256(texts[d.doc_id].encode()).hexdigest() if d.text else "")
    assert list(got[docs[0].doc_id].asDict()) == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_awkward_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "the same", 7), (3, "the same", 7), (3, "the same", 7), (4, "▁", 7), (5, "word " * 40_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int")
    got = align.aligned(docs, columns=["doc_id", "text", "n_a"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k][c] for k in (1, 2, 4) for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")] == [0, 0, 0, 0, "", 0, 0] * 3
    assert by[None][2:] == by[3][2:] and by[3].n_a > 0 and by[5].n_a > 40_000
    assert align.aligned(docs.where("false")).count() == 0 == align.translation(docs.where("false")).count()
    assert align.aligned(docs.where("doc_id = 1")).first().n_links == 0
