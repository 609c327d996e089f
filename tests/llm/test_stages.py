"""Every stage of the pipeline on awkward rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import common, near, simhash

LONG = "lorem ipsum dolor sit amet " * 3000
LINE = "a line that is long enough to be compared with others"
ROWS = [(1, f"{LINE}\nthe cat sat on the mat with the dog", "en", "s1", 5), (2, None, None, None, None), (None, "", "en", "s2", 0), (4, LONG, "en", "s1", 1), (5, f"tie text here now\n{LINE}!", "en", "s1", 1), (6, "tie text here now", "en", "s1", 1), (6, "tie text here now", "en", "s1", 1), (7, "😀 ünï\tcödé\n\nline", "de", "", 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "cat sat on the mat with the dog"), (None, "x y z"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "row", "h", "key", "size", "taken", "target", "_lines", "_exact", "weight", "selected", "__near_h", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{d}/documents.parquet")
    return d


def ids(rows):
    return sorted(str(r.doc_id) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert out.columns[:5] == corpus_pipeline.COLUMNS and (name == "mixture") == (len(out.columns) > 5)
    got = out.collect()
    if name == "line_dedup":
        by = {r.doc_id: (r.text, r.n_chars) for r in got}
        assert len(got) == len(ROWS) and by[5] == ("tie text here now", 17) and by[2] == (None, None) and by[1][0] == ROWS[0][1]
    if name == "near_dedup":
        assert ids(got) == ["1", "2", "4", "5", "6", "7"]
    if name == "decontamination":
        assert ids(got) == sorted(str(r[0]) for r in ROWS if r[0] != 1)
    if name == "mixture":
        assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in got) and {r.doc_id: r["size"] for r in got}[2] == 0
    if name == "quality":
        assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in ROWS} and ids(got).count("6") in (0, 2)
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert set(ids(got.collect())) <= {str(r[0]) for r in ROWS} and "1" not in ids(got.collect())
    assert common.shared_folder(spark)


def test_near_dedup_links_fingerprints(spark, folder):
    """Texts within four bits of SimHash are one, though their shingle sets are less alike than 0.8, also over chains with those."""
    words = [f"w{k % 19}" for k in range(400)]  # long repeats: few distinct shingles, which many positions vote for
    base, odd = " ".join(words), " ".join([*words, *[f"x{k}" for k in range(6)]])
    far = " ".join(f"y{k}" for k in range(60))
    fps = [simhash.simhash(t) for t in (base, odd, far)]
    sets = [set(near.shingle_set(t).tolist()) for t in (base, odd)]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 < (fps[0] ^ fps[2]).bit_count() and len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    docs = spark.createDataFrame([(3, base, "en", "s", 1), (2, odd, "en", "s", 1), (5, far, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(near.keep_one(docs).collect()) == ["2", "3", "5"]
    assert ids(corpus_pipeline.near_dedup(spark, docs, folder).collect()) == ["2", "5"]
