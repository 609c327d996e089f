"""Operators on small graphs, logs and files with answers worked out by hand."""

import json
import math
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lattica import config as C
from lattica.functions import text as T
from lattica.operators import context, evaluation, events, graph, memory, team
from lattica.sources import graphs, parsing


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("n,want", [(0, 1), (500, 1), (501, 2), (950, 2), (951, 3)])
def test_chunk_counts(spark, n, want):
    assert len(one(spark, "a" * n, T.chunks)) == want


def test_tokenizer(spark):
    assert one(spark, "getHTTPResponse_code 42 a b2", T.code_tokens) == ["get", "http", "response", "code", "b2"]


@pytest.mark.parametrize("path", ["/u/:id/", "/u/{id}", "/u/${x.y}", "/u/*"])
def test_paths(spark, path):
    assert one(spark, path, T.normalized_path) == "/u/:param"


def test_intent(spark):
    assert one(spark, "where is def main in app/core.py", T.intent) == "code"
    assert one(spark, "explain the overview and the tutorial", T.intent) == "docs"


def batch(spark, rows):
    return spark.createDataFrame(rows, "batch long, node string, ts double, namespace string")


def test_reinforce_folds_and_caps(spark):
    rows = batch(spark, [(b, n, float(b), "personal") for b in range(5) for n in ("a", "b", "b")])
    r = memory.reinforce(None, rows).first()
    assert (r.node_a, r.node_b, r.weight, r.activation_count) == ("a", "b", 1.0, 5)
    again = memory.reinforce(memory.reinforce(None, rows.where("batch < 2")), rows.where("batch >= 2 and batch < 3")).first()
    assert math.isclose(again.weight, 0.9) and again.activation_count == 3
    assert memory.reinforce(None, rows, strength=0).first().weight == 0.0


def synapses(spark, rows):
    return spark.createDataFrame(rows, "node_a string, node_b string, namespace string, weight double, activation_count long, last_activated double, created_at double")


def test_decay_halves_and_keeps_lasting(spark):
    day = C.DAY
    s = synapses(spark, [("a", "b", "personal", 0.8, 1, 0.0, 0.0), ("a", "c", "personal", 0.3, 5, 0.0, 0.0), ("a", "d", "personal", 0.011, 1, 0.0, 0.0), ("a", "e", "ephemeral", 0.3, 9, 0.0, 0.0)])
    got = {r.node_b: r.weight for r in memory.decay(s, 60 * day).collect()}
    assert math.isclose(got["b"], 0.2) and got["c"] == C.LTP_FLOOR and "d" not in got and "e" not in got
    twice = memory.decay(memory.decay(s, 30 * day, advance=True), 60 * day, advance=True)
    assert math.isclose({r.node_b: r.weight for r in twice.collect()}["b"], 0.2)


def test_spread_dampens_hubs_and_is_linear(spark):
    s = synapses(spark, [("hub", f"n{i:02d}", "personal", 1.0, 1, 0.0, 0.0) for i in range(60)])
    seeds = lambda e: spark.createDataFrame([("hub", e)], "node string, energy double")
    one_, two = (memory.spread(s, seeds(e), depth=1, k=99).collect() for e in (1.0, 2.0))
    assert math.isclose(one_[0].energy, 0.8 * 0.6 * math.sqrt(50 / 60)) and len(one_) == 60
    assert math.isclose(two[0].energy, 2 * one_[0].energy)
    assert memory.spread(s, seeds(1.0), depth=2).where("node = 'hub'").count() == 0


def test_sequences_collapse_repeats(spark):
    e = spark.createDataFrame([(1, i, n, float(i), "personal") for i, n in enumerate("aabbca")], "seq long, pos long, node string, ts double, namespace string")
    got = {(r.from_node, r.to_node): r["count"] for r in memory.record_sequences(e).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1}


def test_import_is_idempotent(spark):
    s = synapses(spark, [("a", "b", "shared", 0.5, 3, 1.0, 1.0)])
    rows = spark.createDataFrame([("b", "a", "shared", 0.7, 2, 2.0), ("c", "c", "shared", 1.0, 1, 2.0)], "source string, target string, namespace string, weight double, activation_count long, ts double")
    once = memory.import_max(s, rows)
    assert memory.import_max(once, rows).collect() == once.collect()
    assert (once.first().weight, once.first().activation_count, once.count()) == (0.7, 3, 1)


def test_review_and_conflict(spark):
    s = synapses(spark, [("a", "b", "shared", 0.5, 30, 0.0, 0.0), ("a", "c", "shared", 0.5, 0, -1e9, 0.0)])
    got = {r.node_b: r.action for r in team.review(team.contribution(s, 0.0)).collect()}
    assert got == {"b": "auto_promote", "c": "reject"}
    side = lambda sc, n: spark.createDataFrame([("x", "y", sc, n)], "source string, target string, score double, activation_count long")
    assert [team.conflict_merge(side(*p), side(*q)).first().winner for p, q in (((0.2, 1), (0.22, 9)), ((0.5, 1), (0.5, 2)), ((0.5, 2), (0.5, 2)), ((0.9, 1), (0.5, 2)))] == ["contest", "b", "a", "a"]


def links(spark, pairs, relation="calls"):
    return spark.createDataFrame([(a, b, relation, 1.0) for a, b in pairs], "source string, target string, relation string, confidence_score double")


def test_betweenness_of_star_and_line(spark):
    star = {r.node: r.betweenness for r in graph.betweenness(links(spark, [("h", x) for x in "abcde"])).collect()}
    assert math.isclose(star["h"], 1.0) and star["a"] == 0
    line = {r.node: r.betweenness for r in graph.betweenness(links(spark, ["ab", "bc", "cd"])).collect()}
    assert math.isclose(line["b"], 4 / 6) and math.isclose(line["c"], 4 / 6) and line["a"] == 0


TWO = ["ab", "bc", "ca", "cd", "de", "ef", "fd"]


def test_gaps_and_communities(spark):
    e = links(spark, TWO)
    w = e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1.0).alias("weight"))
    for found in (graph.louvain(w),):
        own = {r.node: r.community for r in found.collect()}
        assert len({own[x] for x in "abc"}) == 1 and len({own[x] for x in "def"}) == 1 and own["a"] != own["f"]
    c = spark.createDataFrame([(x, int(x > "c")) for x in "abcdef"], "node string, community int")
    got = graph.gaps(e, c).collect()
    assert {r.node for r in got} == {"c", "d"} and {r.node: r.suggested for r in got}["c"] == ["e"]


def test_blast_radius_cycle_and_hops(spark):
    v = graph.views(links(spark, ["ba", "cb", "ac", "dc"]))
    got = {r.node: r.hop for r in graph.blast_radius(v, spark.createDataFrame([("a",)], "node string"), depth=3).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}


def test_ten_of_eleven(spark):
    m = spark.createDataFrame([("x", f"m{i:02d}") for i in range(11)], "cluster string, node string")
    u = spark.createDataFrame([(f"m{i:02d}", "guard") for i in range(10)], "node string, associate string")
    r = graph.cohesion_outliers(m, u).collect()
    assert [(x.node, x.peers, x["size"]) for x in r] == [("m10", 10, 11)]


def test_closure(spark):
    e = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "ca", "xy")], "node string, other string")
    assert {r.node for r in graph.closure(e, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}


def test_session_rates(spark):
    q = spark.createDataFrame([("s", 1, [1, 2]), ("s", 2, []), ("s", 3, [2]), ("s", 4, [2, 3, 4]), (None, 1, [2])], "session string, pos int, communities array<int>")
    r = events.re_query_rate(q).first()
    assert (r.pairs, r.re_queries, r.rate) == (1, 1, 1.0)


def test_hash_chain(spark):
    names, prev, rows = ["action", "actor"], events.ZERO, []
    for i in range(3):
        h = sha256((prev + json.dumps({"action": f"a{i}", "actor": "u"}, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        rows.append((i, f"a{i}", "u", h))
        prev = h
    log = spark.createDataFrame(rows, "line_no long, action string, actor string, sha256 string")
    assert events.chain_broken(log, events.canonical_digest(names)).count() == 0
    bad = log.withColumn("actor", F.when(F.col("line_no") == 1, "v").otherwise(F.col("actor")))
    assert events.chain_broken(bad, events.canonical_digest(names)).first().bad_line == 1


def test_rate_limit_counts_admitted_only(spark):
    c = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate((0, 10, 20, 59, 61, 62))], "actor string, seq long, ts double")
    got = [r.allowed for r in events.rate_limited(c, 2, 60).orderBy("seq").collect()]
    assert got == [True, True, False, False, True, False]


def test_breaker(spark):
    c = spark.createDataFrame([("k", i, float(t), ok) for i, (t, ok) in enumerate(((0, False), (1, False), (2, True), (40, True)))], "key string, seq long, ts double, ok boolean")
    assert [r.state for r in events.breaker_states(c, 2, 30).orderBy("seq").collect()] == ["closed", "open", "open", "closed"]


def test_quality_metrics(spark):
    ranked = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("abcd")], "query_id int, rank int, item string")
    rel = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id int, item string")
    r = evaluation.per_query(ranked, rel).first()
    assert (r.rr, r.p1, r.hit1, r.hit3) == (0.5, 0.0, 0, 1) and math.isclose(r.r5, 2 / 3) and math.isclose(r.p5, 0.5)
    assert math.isclose(r.ndcg3, (1 / math.log2(3)) / sum(1 / math.log2(i + 1) for i in (1, 2, 3)))


def test_negation_and_floors(spark):
    df = spark.createDataFrame([("it is not cached here", "cached"), ("it is cached", "cached")], "a string, t string")
    assert [r.n for r in df.select(evaluation.negated(F.col("a"), F.col("t")).alias("n")).collect()] == [True, False]
    means = spark.createDataFrame([(0.4, 0.9)], "mrr double, hit_at_5 double")
    assert [r.metric for r in evaluation.failed_floors(means).collect()] == ["mrr"]


def test_boost_replaces_the_tail(spark):
    hits = spark.createDataFrame([(i, 1.0 - i / 10) for i in range(5)], "id long, score double")
    energy = spark.createDataFrame([(4, 0.9), (77, 0.8), (78, 0.1)], "id long, energy double")
    got = {r.id: r["rank"] for r in context.boost(hits, energy).collect()}
    assert set(got) == {0, 1, 2, 4, 77} and got[0] == 1 and 3 not in got
    strong = spark.createDataFrame([(77, 9.0), (78, 8.0)], "id long, energy double")
    assert [(r.id, r.pulled) for r in context.boost(hits, strong).orderBy("rank").collect()] == [(0, False), (1, False), (2, False), (77, True), (78, True)]
    assert [r.id for r in context.boost(hits.limit(1), strong).collect()] == [0]


def test_graph_reader_and_splice(spark, tmp_path):
    g = {"nodes": [{"id": "a", "label": "a()", "source_file": "x.py", "source_location": "L42"}, {"id": "a", "label": "second"}, {"id": "b", "source_file": "y.py"}], "edges": [{"_src": "a", "_tgt": "b", "kind": "calls", "source_file": "x.py"}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    nodes, ln = graphs.read_graph(spark, str(tmp_path / "g.json"))
    assert {r.id: (r.label, r.line) for r in nodes.collect()} == {"a": ("a()", 42), "b": ("b", 0)}
    assert ln.first().relation == "calls"
    n2, l2 = graphs.spliced(nodes, ln, spark.createDataFrame([("y.py",)], "source_file string"), nodes.where("false"), ln.where("false"))
    assert n2.count() == 1 and l2.count() == 0


def test_parsers(spark):
    f = lambda **kv: spark.createDataFrame(list(kv.items()), "path string, content string").withColumn("path", F.replace("path", F.lit("_"), F.lit(".")))
    assert [(r.level, r.title) for r in parsing.markdown_headings(f(a_md="# One\n```\n# no\n```\n## Two")).orderBy("line_no").collect()] == [(1, "One"), (2, "Two")]
    assert [(r.kind, r.name) for r in parsing.sql_objects(f(a_sql="create table if not exists t (x int);\nCREATE OR REPLACE VIEW v AS")).orderBy("line_no").collect()] == [("table", "t"), ("view", "v")]
    d = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n@@ -9 +20 @@\n@@ -5,1 +7,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@")], "id int, diff string")
    assert [(r.path, r["first"], r["last"]) for r in parsing.diff_ranges(d).orderBy("first").collect()] == [("x", 3, 6), ("x", 20, 20)]
    assert {(r.method, r.route) for r in parsing.routes(f(a_js="app.get('/u/:id', h); router.post(\"/x\")")).collect()} == {("GET", "/u/:id"), ("POST", "/x")}
    assert {(r.framework, r.control) for r in parsing.compliance_notes(f(a_md="see AC-2 and CC6.1")).collect()} == {("NIST-800-53", "AC-2"), ("SOC2", "CC6.1")}


def test_python_graph(spark):
    files = spark.createDataFrame([("a.py", "import b\nclass A(Base):\n    def run(self):\n        helper()\n"), ("b.py", "class Base: pass\ndef helper(): pass\n"), ("c.py", "def (")], "path string, content string")
    nodes, ln = parsing.python_graph(files)
    got = {(r.source, r.target, r.relation) for r in ln.collect()}
    assert ("a_py", "b_py", "imports_from") in got and ("a_py__a", "b_py__base", "inherits") in got and ("a_py__a_run", "b_py__helper", "calls") in got
    assert nodes.count() == 7


def test_streams(spark, tmp_path):
    from lattica.streaming import live

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"actor": "u", "seq": i, "ts": float(i)}) for i in range(4)))
    (src / "2.json").write_text(json.dumps({"actor": "u", "seq": 9, "ts": 5.0}))
    stream = live.rate_limited(live.read_events(spark, str(src), "actor string, seq long, ts double", 1), 2, 60)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.allowed for r in spark.sql("select * from limited order by seq").collect()] == [True, True, False, False, False]
