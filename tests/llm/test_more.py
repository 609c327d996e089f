"""Quality, toxicity, short benchmark items, surrogates and long lines against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, lines, near, pii, quality, toxicity


def test_short_items(spark):
    items = [(1, "alpha beta"), (2, "Gamma, delta! alpha beta"), (3, "one"), (4, ""), (5, "alpha beta"), (6, "one two three four five")]
    rows = [(1, "x ALPHA  beta y"), (2, "gamma delta alpha beta"), (3, "alpha x beta"), (4, None), (5, "One"), (6, "one two three four five six")]
    got = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 1), (1, 5, 1), (2, 1, 2), (2, 5, 2), (2, 2, 0), (5, 3, 0), (6, 3, 0), (6, 6, 0)}


def test_radius_misses_few(spark):
    """Windows of similarity 0.8 and more of which the fingerprints differ in more bits than the blocks allow: recall is stated as 0.99."""
    rng, found, every = random.Random(5), 0, 0
    cache = decontaminate._Hashes()
    for _ in range(300):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))]
        v = w[:]
        for _ in range(rng.randint(1, 2)):
            v[rng.randrange(len(v))] = "changed"
        a, b = (decontaminate.shingles(decontaminate.word_hashes(" ".join(x), cache)) for x in (w, v))
        if decontaminate.similarity(a, b) >= 0.8:
            every += 1
            found += bool(decontaminate.Index([(1, " ".join(w))]).search(decontaminate.word_hashes(" ".join(v), cache), 0.8))
    assert every > 150 and found >= 0.99 * every


def grams(text):
    t = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(x.encode()) for x in t]
    m = (1 << 64) - 1
    return [x >> 48 for x in h] + [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & m) >> 48 for a, b in zip(h, h[1:])]


def test_quality_by_brute_force(spark):
    rng = random.Random(6)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(3, 60))) + ".") for i in range(200)] + [(900, None), (901, "")]
    labels = [(i, i % 2) for i in range(0, 120)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.importance(docs, lab, k=40).collect()}
    fit = {r.i for r in lab.select(F.col("doc_id").alias("i")).where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) > 0).collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for k, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += k in fit and k < 120 and k % 2
    share = target.sum() / raw.sum()
    ratio = np.log(target + quality.SMOOTHING) - np.log(raw * share + quality.SMOOTHING)
    for k, t in rows:
        g = grams(t)
        assert math.isclose(got[k].weight, quality.REFERENCE * sum(ratio[x] for x in g) / len(g) if g else 0.0, abs_tol=1e-9)
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert {k for k, r in got.items() if r.selected} == {k for k, r in got.items() if r.gumbel_key >= keys[39]}


def test_toxicity_by_definition(spark):
    rng = random.Random(7)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + (" scumbags" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    texts = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    chosen, w = toxicity.train(texts)
    of = dict(zip(chosen.tolist(), w.tolist()))
    bits = lambda p: xxhash.xxh32_intdigest(p.encode()) >> 32 - toxicity.HASH_BITS
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None)], "doc_id long, text string"), texts).collect()}
    for i, t, _ in [*rows, (999, "", 0)]:
        found = {bits(f"={x}") for x in t.split()} | {bits(f"^{x[:k]}") for x in t.split() for k in toxicity.PREFIXES if len(x) >= k}
        z = w[-1] + sum(of[f] for f in found if f in of)
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in rows)


@pytest.mark.parametrize("penalty", [0.0, toxicity.PENALTY])
def test_neutral_mentions(spark, monkeypatch, penalty):
    """False positives on neutral mentions of groups, with the production penalty and without."""
    monkeypatch.setattr(toxicity, "PENALTY", penalty)
    rng, rows = random.Random(8), []
    calm = ["walk", "home", "today", "bread", "river", "music", "garden", "letters"]
    for i in range(600):
        toxic = i % 3 == 0
        group = "muslims" if (rng.random() < 0.9) == toxic else "christians"
        rows.append((f"{group} {' '.join(rng.choice(calm) for _ in range(6))}" + (" vermin" if toxic and rng.random() < 0.7 else ""), int(toxic)))
    neutral = [(i, f"{g} {' '.join(rng.choice(calm) for _ in range(6))}") for i, g in enumerate(["muslims", "christians", "jews", "women"] * 25)]
    score = toxicity.score(spark.createDataFrame(neutral, "doc_id long, text string"), spark.createDataFrame(rows, "text string, label int"))
    wrong = sum(r.score >= 0.5 for r in score.collect()) / len(neutral)
    assert wrong <= 0.02 if penalty else wrong >= 0.2


def replaced(spark, texts, **more):
    rows = pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)], [r._kinds for r in sorted(rows, key=lambda r: r.doc_id)]


def test_one_person_one_name(spark):
    (a, b, c), kinds = replaced(spark, ["Mr. John Smith came. Later Smith left; Mr Smith and MR SMITH. A goldsmith.", "Dr Smith met Frau Anna Smith.", "Smith alone stays: no title here."])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Later (\w+) left; Mr (\w+) and MR SMITH\. A goldsmith\.", a)
    assert m and m[2] == m[3] == m[4] and m[1] != "John" and m[2] != "Smith"
    n = re.fullmatch(r"Dr (\w+) met Frau (\w+) (\w+)\.", b)
    assert n and n[1] == n[3] == m[2] and n[2].startswith(tuple(pii.NAMES["latin"][1].split()))
    assert c == "Smith alone stays: no title here." and kinds[2] == []


def test_forms_of_numbers(spark):
    texts = ["call +1 (980) 555-6268 or (980) 555-6268", "order 1234567890123 and 4539 1488 0343 6467", "pay DE89 3704 0044 0532 0130 00 or DE88370400440532013000", "host 2001:0db8:0000:0000:0000:ff00:0042:8329 up"]
    new, kinds = replaced(spark, texts)
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or \((\d{3})\) (\d{3}-\d{4})", new[0])
    assert m and (m[1], m[2]) == (m[3], m[4]) and m[2] != "555-6268"
    assert new[1].startswith("order 1234567890123 and ") and "4539" not in new[1] and kinds[1] == ["card"]
    iban = re.fullmatch(r"pay (DE\d\d (?:\d{4} ){4}\d\d) or DE88370400440532013000", new[2])[1].replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and kinds[2] == ["iban"]
    assert re.fullmatch(r"host (?:[0-9a-f]{4}:){7}[0-9a-f]{4} up", new[3]) and "2001" not in new[3] and kinds[3] == ["ip6"]


def test_distinct_people_stay_distinct(spark):
    rng = random.Random(9)
    people = sorted({(rng.choice(["Mr", "Mrs"]), "".join(rng.choice("abcdefgh") for _ in range(4)).title(), "".join(rng.choice("klmnopqr") for _ in range(4)).title()) for _ in range(1500)})
    new, _ = replaced(spark, [f"{t} {g} {s}" for t, g, s in people])
    by: dict = {}
    for (t, g, s), x in zip(people, new):
        assert g not in x.split() and s not in x.split()
        title, first, last = x.split()
        assert title == t and by.setdefault(("s", s), last) == last and by.setdefault((t, g), first) == first
    for kind in ("s", "Mr", "Mrs"):
        own = [v for (k, _), v in by.items() if k == kind]
        assert len(set(own)) == len(own)
    assert not {v for v in by.values()} & {x for _, g, s in people for x in (g, s)}


def test_key_of_the_session(spark):
    text = ["write to someone@mail.example.org"]
    first, _ = replaced(spark, text)
    spark.conf.set(pii.KEY_SETTING, "another")
    second, _ = replaced(spark, text)
    spark.conf.unset(pii.KEY_SETTING)
    assert first != second and replaced(spark, text, key="another")[0] == second


def test_long_near_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "LONG_LINE", 300)
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(301)).strip() + "x"
    rows = [(1, base), (2, base[:100] + "Z" + base[100:]), (3, base[1:-1]), (4, "".join(rng.choice("abcdefgh") for _ in range(300))), (5, base)]
    got = {r.doc_id: (r._exact, r._near) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (1, 0)}
    a = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    assert lines.edit_distance(a, a[:200_000] + "x" + a[200_001:-1], 2) == 2


def test_repeated_rows_count_once(spark):
    rows = [(1, "a line that is long enough to count\nand another one of the kind here"), (2, "a line that is long enough to count")] * 2
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_exact", F.lit("x"))).collect()
    assert sorted((r.doc_id, r._exact, r._near, r.text == "") for r in got) == [(1, 0, 0, False)] * 2 + [(2, 1, 0, True)] * 2


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(11)
    for n, d in ((10, 1), (500, 60), (3000, 900)):
        s = rng.integers(0, 2**63, n, dtype=np.uint64)
        t = np.concatenate([s[d:], rng.integers(0, 2**63, d, dtype=np.uint64)])
        bits = np.bitwise_count((near.parity(s) ^ near.parity(t)).view(np.uint64)).sum()
        assert bits <= 2 * d and (d > 60 or bits >= d)


def test_unfinished_components_raise(spark):
    path = spark.range(600).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError):
        common.connected_components(path, max_rounds=2)
    assert common.connected_components(path).where("component <> 0").count() == 0


def test_tables_go_when_dropped(spark):
    import os

    t = common.cut(spark.range(5))
    path = t.__dict__["_stored_at"].removeprefix("file:")
    assert os.path.isdir(path) and t.count() == 5
    common.drop(t)
    assert not os.path.exists(path)


def test_workers_get_few_texts_at_once(spark):
    """What ``cut`` writes reaches Python workers in small batches, and the session keeps its own setting."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(common.ARROW)
    got = [r.n for r in common.cut(spark.range(0, 5_000, 1, 1).mapInArrow(run, "n bigint")).collect()]
    assert sum(got) == 5_000 and max(got) <= common.ARROW_ROWS
    assert spark.conf.get(common.ARROW) == before


def test_kept_words_are_few_and_change_nothing():
    for module in (quality, decontaminate):
        cache = module._Hashes()
        first = [cache[f"word{k}"] for k in range(150_000)]
        assert len(cache) <= 100_000
        assert first[:50] == [cache[f"word{k}"] for k in range(50)]
