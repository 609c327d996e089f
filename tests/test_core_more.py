"""Operators that have no SQL, on answers worked out by hand or by brute force."""

import itertools
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lattica import api
from lattica.operators import evaluation, events, feedback, governance, graph, logs, memory, nodes, report, tuning
from lattica.sources import extractors, graphs, ir, parsing, scip
from lattica.streaming import live

SYN = "node_a string, node_b string, namespace string, weight double, activation_count long, last_activated double, created_at double"
STEP = "from_node string, to_node string, namespace string, weight double, count long, last_activated double, created_at double"
NODE = "id string, label string, file_type string, source_file string, source_location string, community int, norm_label string"
LINK = "source string, target string, relation string, confidence string, confidence_score double, pos long"


@pytest.fixture(scope="module")
def project(spark):
    n = [("a", "a.py", "code", "src/a.py", "L1", 0, "a.py"), ("a1", "load_user()", "code", "src/a.py", "L9", 0, "load_user"), ("a2", "saveUser()", "code", "src/a.py", "L3", 0, "saveuser"), ("r", "  Loads a\n user. ", "rationale", "src/a.py", "L9", 0, "r"), ("b1", "parse()", "code", "src/b.py", "L2", 1, "parse"), ("d", "Read me", "document", "README.md", "L1", -1, "read me")]
    e = [("a", "a1", "contains", "EXTRACTED", 1.0, 0), ("a1", "a2", "calls", "EXTRACTED", 1.0, 1), ("r", "a1", "rationale_for", "EXTRACTED", 1.0, 2), ("a", "b1", "imports_from", "EXTRACTED", 0.5, 3), ("b1", "a2", "uses", "INFERRED", 0.25, 4)]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, LINK)


def test_skeleton(project):
    got = {r.source_file: (r.functions, r.skeleton) for r in nodes.skeletons(*project).collect()}
    assert got["src/a.py"] == (2, "# src/a.py  (community 0, 2 functions)\n\n## Functions\nL3    saveUser()\nL9    load_user()  — Loads a\n user.\n\n## Call graph (within this file)\nload_user() → saveUser()\n\n## Cross-file\na.py imports_from → b1 (EXTRACTED 0.5)\nsaveUser() uses → b1 (INFERRED 0.25)")
    assert got["src/b.py"][1].endswith("## Cross-file\nparse() imports_from → a (EXTRACTED 0.5)\nparse() uses → a2 (INFERRED 0.25)")


def test_probe(project):
    n, e = project
    texts = nodes.rationales(n, e)
    assert [tuple(r) for r in texts.collect()] == [("a1", "Loads a user")]
    sample = nodes.probe_sample(n, texts, 1)
    assert {r.id: (r.query, r.query_source) for r in sample.collect()} == {"a1": ("Loads a user", "rationale")}
    assert nodes.probe_sample(n, texts, 0).count() == 4
    wide = nodes.probe_sample(n, texts, 3)
    assert wide.count() == 3 and {r.file_type for r in wide.collect()} == {"code"}


def paths_by_hand(edges):
    """Betweenness by every shortest path."""
    adj = {}
    for (a, b), w in edges.items():
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = w
    names, score = sorted(adj), dict.fromkeys(adj, 0.0)
    for s, t in itertools.permutations(names, 2):
        best, found, todo = float("inf"), [], [(0.0, [s])]
        while todo:
            d, p = todo.pop()
            if d > best + 1e-9:
                continue
            if p[-1] == t:
                found = [q for q in found if d >= best - 1e-9] if d >= best - 1e-9 else []
                best = min(best, d)
                found.append(p)
                continue
            todo += [(d + w, [*p, v]) for v, w in adj[p[-1]].items() if v not in p]
        for p in found:
            for v in p[1:-1]:
                score[v] += 1 / len(found)
    return score


def test_betweenness_by_every_path(spark):
    rng = random.Random(1)
    for trial in range(3):
        names = [f"n{i}" for i in range(9)]
        edges = {p: rng.choice([1.0, 1 / 0.9, 1 / 0.3]) for p in itertools.combinations(names, 2) if rng.random() < 0.35}
        kinds = {1.0: "calls", 1 / 0.9: "inherits", 1 / 0.3: "contains"}
        df = spark.createDataFrame([(a, b, kinds[w]) for (a, b), w in edges.items()], "source string, target string, relation string")
        got = {r.node: r.betweenness for r in graph.betweenness(df, normalized=False).collect()}
        want = paths_by_hand(edges)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want), trial


def test_gaps_of_a_bridge(spark):
    pair = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in [*pair("x"), *pair("y"), ("x0", "m"), ("m", "y0")]], "source string, target string, relation string")
    of = spark.createDataFrame([(n, 0 if n[0] == "x" else 1 if n[0] == "y" else 2) for n in [*(f"{p}{i}" for p in "xy" for i in range(4)), "m"]], "node string, community int")
    got = graph.gaps(edges, of, 1).collect()
    assert len(got) == 1 and got[0].node == "m" and list(got[0].bridged) == [0, 1, 2] and list(got[0].suggested) == ["x1", "y1"]
    assert got[0].betweenness == round(2 * 16 / (8 * 7), 6) and got[0].gap_score == round(2 * 16 / (8 * 7) / 3, 6)


def test_drift_names_the_dissenter(spark):
    members = spark.createDataFrame([("f", f"{k}_endpoint", f"{k}_endpoint") for k in "abcde"] + [("f", f"other{i}", f"other{i}") for i in range(3)], "container string, node string, label string")
    uses = spark.createDataFrame([(f"{k}_endpoint", "auth") for k in "abcd"] + [("e_endpoint", "log")], "node string, associate string")
    changed = spark.createDataFrame([("e_endpoint",), ("a_endpoint",)], "node string")
    got = graph.drift(changed, members, uses).collect()
    assert [tuple(r) for r in got] == [("e_endpoint", "auth", 4, 5)]
    assert [r.line for r in report.outlier_lines(graph.drift(changed, members, uses)).collect()] == ["- `e_endpoint` skips `auth`, which 4 of its 4 peers (80%) use."]
    counts = {r.node: r.peers for r in graph.peer_counts(members).collect()}
    pairs = {r.node: r.n for r in graph.peer_groups(members).groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert counts == pairs and counts["a_endpoint"] == 4


def test_chain_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(logs, "CHAIN_RANGE", 7)
    rows = [(i + i // 5, "c", f"a{i}", "mé 👩\x7f\n", "ok", 't"\\x', '{"k":1}', "", "", f"2024-01-{i % 28 + 1:02d}") for i in range(40)]
    e = spark.createDataFrame(rows, "line_no long, category string, action string, actor string, status string, target string, details string, actor_role string, ip_address string, timestamp string").repartition(4)
    from hashlib import sha256

    prev, want = "0" * 64, {}
    for r in rows:
        d = dict(zip(["line_no", "category", "action", "actor", "status", "target", "details", "actor_role", "ip_address", "timestamp"], r)) | {"details": {"k": 1}}
        text = json.dumps({k: v for k, v in d.items() if k != "line_no"}, sort_keys=True, separators=(",", ":"))
        prev = want[r[0]] = sha256((prev + text).encode()).hexdigest()
    chain = logs.chained(e)
    assert {r.line_no: r.sha256 for r in chain.collect()} == want
    digest = F.sha2(logs.canonical(), 256)
    assert events.chain_broken(chain, digest).count() == 0 and events.chain_broken(chain, digest, 3).count() == 0
    assert events.chain_broken(chain.withColumn("actor", F.when(F.col("line_no") == 12, "you").otherwise(F.col("actor"))), digest, 3).first()[0] == 12
    assert logs.chained(e.where("false")).count() == 0


def test_log_files(spark, tmp_path):
    e = logs.query_events(spark.createDataFrame([("t", "s", "q", ["L0"], [1], 2, 30, 1.5), ("u", "s", None, None, None, None, None, None)], "ts string, session_id string, query string, layers array<string>, communities array<int>, hits int, tokens long, reduction double"), "/p")
    logs.append(e, str(tmp_path / "log"))
    logs.append(e.limit(1), str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert sorted(r.event_type for r in back.collect()) == ["query", "query", "wakeup"]
    assert logs.query_events(e.select(F.lit("x").alias("ts"), "session_id", "query", F.lit(None).cast("array<string>").alias("layers"), F.lit(None).cast("array<int>").alias("communities"), F.lit(0).alias("hits"), F.lit(0).alias("tokens"), F.lit(1.0).alias("reduction")), "/p", consent=False).count() == 0
    m = logs.metric_events(spark.createDataFrame([(86400.0 * 3 + 5, 1.2345)], "ts double, latency_ms double"), "build")
    logs.append(m, str(tmp_path / "metrics"), "day")
    assert (tmp_path / "metrics" / "day=1970-01-04").is_dir()


def test_namespaces():
    assert feedback.checked_namespace(" personal ") == "personal"
    for bad in ("", "  ", "a b", None):
        with pytest.raises(ValueError):
            feedback.checked_namespace(bad)
    assert feedback.resolved_namespace("x y", "mine") == "mine" and feedback.resolved_namespace(branch="topic") == "branch:topic"
    assert feedback.resolved_namespace(branch="main") == "personal" == feedback.resolved_namespace(branch="trunk", default_branch="trunk")


def test_seeds_from_documents(spark):
    docs = [("doc1", "Plan", "Pay flow", "use the ledger export job", ["Money"]), ("doc2", "Memo", "Other", "see pay flow and invoice", ["money"]), ("doc3", "x", "zz", "card reader", ["solo"]), ("doc4", "y", "yy", "paying", ["q"])] + [(f"f{i}", "filler", f"t{i}", "", [f"u{i}"]) for i in range(8)]
    d = spark.createDataFrame(docs, "id string, label string, title string, text string, tags array<string>")
    n = spark.createDataFrame([("m_ledger_export_x", "other thing"), ("inv", "invoice"), ("card_slot", "slot"), ("nothing", "none")], "id string, label string")
    got = {(r.node_a, r.node_b): r.weight for r in feedback.seed_from_documents(d, n, 5.0).collect()}
    assert got == {("doc1", "m_ledger_export_x"): 0.25, ("doc2", "inv"): 0.40, ("card_slot", "doc3"): 0.20, ("doc1", "doc2"): 0.20}


def test_seeds_of_classes_equal_those_of_pairs(spark):
    rng, names, words = random.Random(3), ["ledger", "export", "card", "slot", "pay", "flow"], ["ledger", "export", "card", "pay", "flow", "zz"]
    some = lambda pool, most: [rng.choice(pool) for _ in range(rng.randint(0, most))]
    docs = [(f"d{i}", rng.choice(["", "Memo"]), " ".join(some(["Pay", "flow", "x!", "card"], 3)), " ".join(some(words, 5)), [f"T{rng.randint(0, 40)}", f"t{rng.randint(0, 40)}"]) for i in range(60)]
    nodes = [("_".join([f"n{i}", *some(names, 3)]), rng.choice([" ".join(some(names, 2)) or "qq", f"own{i} pay"])) for i in range(80)]
    got = feedback.seed_from_documents(spark.createDataFrame(docs, "id string, label string, title string, text string, tags array<string>"), spark.createDataFrame(nodes, "id string, label string"), 5.0).collect()
    cells = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split(" ")
    ids = [n for n, _ in nodes] + [x[0] for x in docs]
    common = {w for w in names if (k := sum(w in i.split("_") for i in ids)) >= 2 and k / len(ids) > feedback.COMMON_SHARE} | set(feedback.COMMON_WORDS)
    want = {}
    for d, label, title, text, _ in docs:
        said = [w for w in f"{text} {label} {title}".lower().split() if len(w) >= 3 and w not in common]
        for n, name in nodes:
            need, own = {w for w in name.split() if len(w) >= 3 and w not in common}, [w for w in n.split("_") if w not in common]
            w = 0.40 if need and need <= set(said) else 0.25 if set(zip(own, own[1:])) & set(zip(said, said[1:])) else 0.20 if set(own) & set(said) else None
            if w:
                want[tuple(sorted((n, d)))] = w
    tags = {d: {t.lower() for t in ts} for d, *_, ts in docs}
    rare = {t for ts in tags.values() for t in ts if sum(t in x for x in tags.values()) / len(docs) < feedback.TAG_SHARE}
    for a, _, title, _, _ in docs:
        for b, label, own, text, _ in docs:
            told = " ".join(x for x in (text, label, own) if x)
            if a != b and tags[a] & tags[b] & rare:
                want[tuple(sorted((a, b)))] = 0.20
            elif a != b and any(cells(title)) and f" {' '.join(cells(title))} " in f" {' '.join(cells(told))} ":
                want[tuple(sorted((a, b)))] = 0.25
    assert {(r.node_a, r.node_b): r.weight for r in got} == want and len(got) == len(want) and set(want.values()) == {0.20, 0.25, 0.40}


def test_seeds_of_titles_that_begin_alike(spark):
    """Titles that share their first word are not each compared to each text."""
    k = F.col("id").cast("string")
    d = spark.range(100_000).select(F.concat(F.lit("d"), k).alias("id"), F.lit("note").alias("label"), F.concat(F.lit("paper "), k).alias("title"), F.when(F.col("id") == 7, "see paper 12").otherwise("see paper").alias("text"), F.array(F.concat(F.lit("t"), k)).alias("tags"))
    began = time.time()
    got = feedback.seed_from_documents(d, spark.createDataFrame([("n", "none")], "id string, label string"), 5.0).collect()
    assert [(r.node_a, r.node_b, r.weight) for r in got] == [("d12", "d7", 0.25)] and time.time() - began < 90


def test_chain_over_laps(spark, monkeypatch):
    """However many ranges a log has, its events are read three times: by bounds, for the laps, and to be hashed."""
    fields = [F.concat(F.lit(f"é{f}"), F.col("id") % 7).alias(f) for f in logs.AUDIT_FIELDS if f != "details"]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            reads.add(len(x))
            yield x

    e = spark.range(300).select((F.col("id") * 3 + 40).alias("line_no"), *fields, F.lit('{"k":1}').alias("details"))
    e = e.mapInPandas(counted, e.schema)
    want = [tuple(r) for r in logs.chained(e).orderBy("line_no").select("line_no", "prev_sha256", "sha256").collect()]
    monkeypatch.setattr(logs, "CHAIN_RANGE", 50)
    monkeypatch.setattr(logs, "LAP_RANGES", 4)
    before = reads.value
    got = [tuple(r) for r in logs.chained(e).orderBy("line_no").select("line_no", "prev_sha256", "sha256").collect()]
    assert got == want and len(got) == 300 and reads.value - before <= 4 * 300
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_addresses_are_no_controls(spark):
    text = "# 31.164.253.184 and 84.73.164.167\n21.155.164.165, 164.238.227.9, 3164.312, 164.3125\nHIPAA §164.312(a)(1), 45 CFR 164.308.\n"
    got = {(r.framework, r.control, r.first) for r in parsing.compliance_notes(spark.createDataFrame([("a.md", text)], "path string, content string")).collect()}
    assert got == {("HIPAA", "164.312(a)", 3), ("HIPAA", "164.308", 3)}


def test_feedback_of_the_last_query(spark):
    s = spark.createDataFrame([("a", "b", "personal", 0.5, 1, 0.0, 0.0), ("b", "c", "personal", 0.2, 1, 0.0, 0.0)], SYN)
    hits = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {(r.node_a, r.node_b): r.weight for r in feedback.last_query_feedback(s, hits, True, 9.0).collect()} == {("a", "b"): 1.0, ("b", "c"): 0.2}
    bad = {(r.node_a, r.node_b): round(r.weight, 6) for r in feedback.last_query_feedback(s, hits, False, 9.0).collect()}
    assert bad == {("a", "b"): 0.2, ("b", "c"): 0.2}
    b = feedback.query_batches(spark.createDataFrame([(1, i, f"n{i}") for i in range(1, 9)], "query_id int, rank int, id string"), spark.createDataFrame([(1, 4)], "query_id int, community int"), F.lit(1.0))
    assert sorted(r.node for r in b.collect()) == ["community_4", "n1", "n2", "n3", "n4", "n5", "n6"]
    r = feedback.reuse_batches(spark.createDataFrame([("x1", "load()", "code", "a.py"), ("y1", "use()", "code", "b.py")], "id string, label string, file_type string, source_file string"), spark.createDataFrame([(1, "b.py", "load(1)"), (2, "b.py", "z")], "edit_id int, path string, new_code string"), 1.0)
    assert sorted((r.batch, r.node) for r in r.collect()) == [(1, "x1"), (1, "y1")]


def test_team_import_and_sleep(spark):
    shared = spark.createDataFrame([("a", "b", "shared", 0.3, 2, 0.0, 0.0)], SYN)
    bundle = spark.createDataFrame([("a", "b", 0.4, 40), ("c", "d", 0.9, 30), ("e", "f", 0.1, 0)], "source string, target string, weight double, activation_count long")
    merged, counts = feedback.import_team(shared, bundle, 86400.0 * 10)
    assert {(r.node_a, r.node_b): round(r.weight, 4) for r in merged.collect()} == {("a", "b"): 0.75, ("c", "d"): 0.75}
    assert {r.outcome: r.n for r in counts.collect()} == {"auto_promote": 2, "review_required": 1}
    from lattica.operators import team

    assert feedback.import_team(shared, bundle, 1.0, team.bundle_hash(bundle).first()[0]) is None
    after, told = feedback.sleep(spark.createDataFrame([("a", "b", "personal", 0.001, 1, 0.0, 0.0), ("a", "c", "personal", 0.5, 9, 0.0, 0.0), ("a", "d", "shared", 0.5, 1, 0.0, 0.0)], SYN), 86400.0 * 60)
    assert tuple(told.first()) == (1, 1, 1, 1)
    assert {(r.node_a, r.node_b): round(r.weight, 4) for r in after.collect()} == {("a", "c"): 0.55, ("a", "d"): round(0.5 * 2 ** (-5 / 30), 4)}


def test_memory_note(spark):
    s = spark.createDataFrame([("a", "b", "personal", 0.5, 6, 0.0, 0.0), ("a", "c", "shared", 0.2, 1, 0.0, 0.0)], SYN)
    t = spark.createDataFrame([("a", "b", "personal", 3.0, 3, 0.0, 0.0), ("a", "c", "personal", 1.0, 1, 0.0, 0.0)], STEP)
    text = report.memory_note(s, t, spark.createDataFrame([("a", "Alpha")], "id string, label string"))
    assert "- Edges learned: 2 (1 long-term)" in text and "- `Alpha` (a) ↔ `b` — weight 0.50, fired 6× *(long-term)*" in text
    assert "- `Alpha` (a) — 2 connections" in text and "- After `Alpha` (a):\n  - 75% → `b`\n  - 25% → `c`" in text
    assert "_(none yet)_" in report.memory_note(s.where("false"), t.where("false"))
    html = report.controls_report(spark.createDataFrame([("AC-1", "N<1>", "f()", "a.py")], "control_id string, framework string, code_label string, source_file string"), "T").first()
    assert html.html == "<h1>T</h1><h2>N&lt;1&gt;</h2><table><tr><td>AC-1</td><td>f()</td><td>a.py</td></tr></table>"


SOURCES = {
    "src/db/conn.ts": "export class Base {\n}\nexport interface Named {\n}\nfunction check(x) { return x; }\n",
    "src/a.ts": "import { Db } from './db/conn';\n// Logs a user in.\nexport async function login(name: string): Promise<User> {\n  const x = check(name); // calls other()\n  return x;\n}\nexport class User extends Base implements Named, Odd {\n  save(): void { login('save()'); }\n}\nexport const LIMIT = 10;\n",
    "pkg/auth/a.go": "package auth\n\ntype User struct {\n}\n\nfunc (u *User) Save(x int) error {\n    return helper(u)\n}\nfunc helper(u *User) error { return nil }\n",
    "cmd/main.go": 'package main\n\nimport (\n    "fmt"\n    "example.com/x/auth"\n)\n\nfunc main() {\n    helper(nil)\n}\n',
    "src/com/x/B.java": "package com.x;\npublic class B {\n    public int size() {\n        return 1;\n    }\n}\n",
    "src/com/x/A.java": "package com.x;\nimport com.x.B;\n/** A thing. */\npublic class A extends B {\n    private int count = 0;\n    public int name(int x) {\n        if (x > 0) { return size(); }\n        return 0;\n    }\n}\n",
    "include/db/conn.h": "int open_db(int x);\n",
    "src/m.c": '#include "db/conn.h"\nstatic int helper(int x) {\n    return open_db(x);\n}\nint main(int argc, char **argv)\n{\n    helper(3);\n    return 0;\n}\n',
}


def test_extracted_graph(spark):
    n, e = extractors.graph(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))
    ids = {r.id: r for r in n.collect()}
    links = {(r.source, r.target, r.relation) for r in e.collect()}
    for want in ("src_a_ts__login_fn", "src_a_ts__user_cls__save_fn", "src_a_ts__limit_sym", "ext__odd_cls", "pkg_auth_a_go__save_fn", "src_com_x_a_java__a_cls__count_sym", "src_m_c__main_fn", "src_a_ts__login_fn__rationale"):
        assert want in ids, want
    assert ids["src_a_ts__login_fn__rationale"].label == "Logs a user in." and ids["src_a_ts__login_fn"].line == 3
    for want in (
        ("src_a_ts", "src_db_conn_ts", "imports_from"), ("src_a_ts__user_cls", "src_db_conn_ts__base_cls", "inherits"), ("src_a_ts__user_cls", "ext__odd_cls", "inherits"), ("src_a_ts__login_fn", "src_db_conn_ts__check_fn", "calls"),
        ("src_a_ts__user_cls__save_fn", "src_a_ts__login_fn", "calls"), ("cmd_main_go", "pkg_auth_a_go", "imports_from"), ("cmd_main_go__main_fn", "pkg_auth_a_go__helper_fn", "calls"), ("src_com_x_a_java", "src_com_x_b_java", "imports_from"),
        ("src_com_x_a_java__a_cls", "src_com_x_b_java__b_cls", "inherits"), ("src_com_x_a_java__a_cls__name_fn", "src_com_x_b_java__b_cls__size_fn", "calls"), ("src_m_c", "include_db_conn_h", "imports_from"), ("src_m_c__helper_fn", "include_db_conn_h__open_db_fn", "calls"),
    ):
        assert want in links, want
    assert not any("other" in t or t.endswith("save_fn__save_fn") for _, t, _ in links)


def test_index_document(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "a.py", "file_type": "code", "source_file": "a.py", "source_location": "L1", "community": 3, "norm_label": "a.py", "odd": {"x": [1]}}, {"id": "f", "label": "f()", "source_file": "a.py", "source_location": "L7"}], "edges": [{"_src": "a", "_tgt": "f", "relation": "contains", "weight": 2.5, "why": "x\"y"}]}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    n, e = ir.read_document(spark, str(tmp_path / "graph.json"))
    got = {r.id: r for r in n.collect()}
    assert (got["a"].kind, got["a"].line, got["a"].language, got["a"].cluster, json.loads(got["a"].extra["odd"])) == ("file", 1, "python", 3, {"x": [1]})
    assert (got["f"].kind, got["f"].line, got["f"].cluster) == ("function", 7, -1) and e.first().weight == 2.5 and e.first().source == "a"
    ir.write_index(n, e, str(tmp_path / "index"))
    n2, e2 = ir.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(str, n2.collect())) == sorted(map(str, n.collect())) and [r.asDict() for r in e2.collect()] == [r.asDict() for r in e.collect()]
    back = [json.loads(r.json) for r in ir.graph_rows(n2, e2)[0].orderBy("id").collect()]
    assert back[0] == doc["nodes"][0] and json.loads(ir.graph_rows(n2, e2)[1].first().json)["why"] == 'x"y'
    (tmp_path / "index" / "meta").rename(tmp_path / "old")
    spark.createDataFrame([(9,)], "ir_version int").write.json(str(tmp_path / "index" / "meta"))
    with pytest.raises(ValueError):
        ir.read_index(spark, str(tmp_path / "index"))


def test_files_of_a_folder(spark, tmp_path):
    for p, data in {"a.md": b"# A\ntext", "x/b.txt": b"hello", ".git/c.txt": b"no", "node_modules/d.txt": b"no", "e.txt": b"\x00\x01", "x/y/z/f.txt": b"deep"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    files = ir.listed(spark, str(tmp_path), [".md", ".txt"], depth=2)
    assert sorted(r.path for r in files.collect()) == ["a.md", "e.txt", "x/b.txt"]
    fine, bad = ir.ingested(files)
    assert sorted(r.path for r in fine.collect()) == ["a.md", "x/b.txt"] and [tuple(r) for r in bad.collect()] == [("e.txt", "cannot read files of kind unknown")]


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def msg(*fields):
    out = b""
    for no, v in fields:
        out += varint(no << 3) + varint(v) if isinstance(v, int) else varint(no << 3 | 2) + varint(len(v)) + v
    return out


def test_scip_refines(spark):
    occ = lambda rng, sym, role=0, body=(): msg((1, b"".join(map(varint, rng))), (2, sym.encode()), (3, role), *([(7, b"".join(map(varint, body)))] if body else []))
    doc = msg(
        (1, b"app.py"), (2, occ((0, 4, 10), "py . . app/run().", 1, (0, 0, 5, 9))), (2, occ((2, 4, 8), "py . . app/A#handle().")), (2, occ((10, 4, 8), "py . . app/A#handle().", 1, (10, 0, 12, 300))),
        (3, msg((1, b"py . . app/A#"), (4, msg((1, b"py . . app/B#"), (3, 1))))),
    )
    files = spark.createDataFrame([(bytearray(msg((1, b"meta"), (2, doc))),)], "content binary")
    n = spark.createDataFrame([("f", "app.py", "code", "app.py"), ("run", "run()", "code", "app.py"), ("A", "A", "code", "app.py"), ("Ah", "handle()", "code", "app.py"), ("B", "B", "code", "app.py"), ("Bh", "handle()", "code", "app.py")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("f", "run", "contains", "app.py"), ("f", "A", "contains", "app.py"), ("f", "B", "contains", "app.py"), ("A", "Ah", "contains", "app.py"), ("B", "Bh", "contains", "app.py"), ("run", "Bh", "calls", "app.py"), ("x", "y", "calls", "other.py")], "source string, target string, relation string, source_file string")
    new, counts = scip.refined(n, e, files)
    assert {(r.source, r.target, r.relation) for r in new.where("relation <> 'contains'").collect()} == {("run", "Ah", "calls"), ("A", "B", "inherits"), ("x", "y", "calls")}
    assert {r.change: r.n for r in counts.collect()} == {"calls_removed": 1, "calls_added": 1, "inherits_added": 1}


def test_typed_calls(spark):
    files = spark.createDataFrame([("a.py", "def f(x) -> int | None:\n    return x\ndef g():\n    return 'a' if 1 else None\ndef h():\n    if 1:\n        return 1\n    return None\n")], "path string, content string")
    got = {r["name"]: (r.return_type, r.is_optional, r.confidence) for r in parsing.python_types(files).collect()}
    assert got == {"f": ("int | None", True, 0.9), "g": (None, False, 0.0), "h": ("int", True, 0.7)}
    n = spark.createDataFrame([("i", "f()", "a.py"), ("j", "m.h()", "a.py")], "id string, label string, source_file string")
    e = spark.createDataFrame([("i", "j", "calls"), ("j", "i", "calls"), ("i", "j", "contains")], "source string, target string, relation string")
    assert {(r.caller, r.callee): r.return_type for r in parsing.typed_calls(n, e, parsing.python_types(files)).collect()} == {("i", "j"): "int", ("j", "i"): "int | None"}


def test_evaluation_odds(spark):
    assert evaluation.parsed_weights("2,1,1") == (0.5, 0.25, 0.25) and evaluation.parsed_weights("1,x,2") == evaluation.parsed_weights(None) == evaluation.parsed_weights("1,-1,2") == evaluation.C.FITNESS_WEIGHTS
    rows = spark.createDataFrame([(1, "we do not use postgres here", ["use sqlite", "we use postgres"]), (2, None, []), (3, "fine", ["x"])], "id int, answer string, facts array<string>")
    assert {r.id: r.contradiction for r in evaluation.contradictions(rows).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    reg = evaluation.registered(spark.createDataFrame([("e1", "A b", "x", 1), ("e2", "a-B", "x", 2), ("e3", "a b", "y", 1)], "entity string, label string, anchor string, seq int"))
    assert {(r.norm, r.anchor): r.entity for r in reg.collect()} == {("a_b", "x"): "e2", ("a_b", "y"): "e3"}
    health = spark.range(1).select(evaluation.session_health(F.lit(0.25)).alias("a"), evaluation.session_health(F.lit(None).cast("double")).alias("b")).first()
    assert tuple(health) == (0.75, 1.0)
    assert tuning.effective({"L0_MAX_TOKENS": 1, "SPREAD_DECAY": 0.7, "other": 3})["L0_MAX_TOKENS"] == 50 and tuning.search_depth({"SYNAPSE_SEED_K": 4}) == 20 and len(tuning.effective()) == 17
    cos = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    q = spark.createDataFrame([("q", [1.0, 0.0], [1.0, 1.0], [0.0, 1.0])], "id string, query array<double>, answer array<double>, gold array<double>")
    got = evaluation.context_scores(q, spark.createDataFrame([("q", [0.0, 1.0]), ("q", [1.0, 0.0])], "id string, vec array<double>"), spark.createDataFrame([("q", [0.0, 2.0]), ("q", [-1.0, 0.0])], "id string, vec array<double>"), cos).first()
    assert (got.context_precision, got.context_recall, got.answer_relevance) == (0.5, 0.5, 1.0)


def test_governance_odds(spark):
    heavy, light = governance.published(spark.createDataFrame([(0.5,), (0.1,), (None,)], "weight double"), 0.4)
    assert heavy.count() == 1 and light.count() == 2
    assert spark.range(1).select(governance.control_key(F.lit("ac-1"), F.lit("nist 800"))).first()[0] == "compliance:NIST_800:AC-1"


def test_bundles(spark, tmp_path):
    s = spark.createDataFrame([("a", "b", "shared", 0.5, 3, 0.0, 0.0), ("a", "c", "personal", 0.5, 3, 0.0, 0.0)], SYN)
    graphs.export_bundle(s, "shared", str(tmp_path / "b"))
    got = graphs.import_bundle(spark, str(tmp_path / "b"), "shared", 7.0).collect()
    assert [(r.source, r.target, r.namespace, r.weight, r.activation_count, r.ts) for r in got] == [("a", "b", "shared", 0.5, 3, 7.0)]
    t = feedback.type_edges(None, spark.createDataFrame([("a", "b", "int", False, 0.9, "x", 1.0, 1), ("a", "b", "str", True, 0.7, "y", 2.0, 2)], "source_node string, target_node string, return_type string, is_optional boolean, confidence double, inferred_by string, inferred_at double, seq int"))
    assert t.count() == 1 and t.first().return_type == "str"
    assert all(x.count() == 0 for x in feedback.emptied({"s": s}).values())


def test_streams(spark, tmp_path):
    seen, errors = [], []

    def bad(rows):
        raise ValueError("full")

    batch = spark.createDataFrame([("a", 1), ("b", 2)], "type string, seq int")
    live.fanned_out([(None, lambda r: seen.append(r.count())), (["b"], bad), (["b"], lambda r: seen.append(r.count()))], errors.append)(batch, 0)
    assert seen == [2, 1] and len(errors) == 1
    state = {}
    fold = live.stepping(lambda: (state.get("t"), state.get("last")), lambda t, last: state.update(t=spark.createDataFrame(t.collect(), t.schema), last=last))
    touch = lambda rows: spark.createDataFrame(rows, "seq long, path string, ts double, namespace string")
    fold(touch([(1, "a", 1.0, "p"), (2, "b", 2.0, "p")]), 0)
    fold(touch([]), 1)
    fold(touch([(3, "c", 3.0, "p"), (4, "c", 4.0, "p"), (5, "a", 5.0, "p")]), 2)
    assert {(r.from_node, r.to_node): r.weight for r in state["t"].collect()} == {("a", "b"): 0.8, ("b", "c"): 0.8, ("c", "a"): 0.8}
    src = tmp_path / "in"
    spark.createDataFrame([("k", 1, 1.0, False), ("k", 2, 2.0, False), ("k", 3, 3.0, True), ("k", 4, 40.0, True)], "key string, seq long, ts double, ok boolean").coalesce(1).write.json(str(src))
    stream = live.breaker(spark.readStream.schema("key string, seq long, ts double, ok boolean").json(str(src)), 2, 30.0)
    q = stream.writeStream.format("memory").queryName("breaker_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [r.state for r in spark.table("breaker_out").orderBy("seq").collect()] == ["closed", "open", "open", "closed"]


def test_index_object(spark, project, tmp_path):
    n, e = project
    none = spark.createDataFrame([], SYN), spark.createDataFrame([], STEP)
    s = memory.reinforce(none[0], spark.createDataFrame([("x", "a1", 1.0, "personal"), ("x", "d", 1.0, "personal"), ("x", "community_1", 1.0, "personal")], "batch string, node string, ts double, namespace string"))
    index = api.Index("demo", n, e, s, none[1], api.resolved_backend("lexical"), api.merged({"memory": {"top_k": 5}}))
    assert index.config["memory"] == {"inject": True, "depth": 2, "top_k": 5}
    hits = index.hits([(0, "load user"), (1, "nothingatall")])
    assert {r.query_id for r in hits.collect()} == {0} and hits.where("rank = 1").first().id == "a1"
    got = {r.query_id: r for r in index.query([(0, "load user"), (1, "nothingatall")]).collect()}
    assert "## Project: demo" in got[0].context and "## Search Results" in got[0].context and got[1].l3 == 0 and got[0].total == sum(got[0][f"l{i}"] for i in range(4))
    _, learned = index.asked([(0, "load user")], 9.0)
    assert learned.synapses.count() > s.count()
    assert index.benchmark(["load user", "parse"]).first().queries == 2 and "Architecture" in index.wakeup().first().text
    means, blind = index.probe(2)
    assert means.first().queries == 2 and blind.count() <= 2
    more = index.files_reinforced(["src/a.py", "src/b.py"], 3.0)
    assert more.transitions.count() == 1 and more.synapses.count() > s.count()
    c = index.controls_reinforced(spark.createDataFrame([("src/b.py", "SOC2", "CC6.1")], "path string, framework string, control string"), 4.0)
    assert c.synapses.where("node_b = 'compliance:SOC2:CC6.1' or node_a = 'compliance:SOC2:CC6.1'").count() == 1
    vectors = spark.createDataFrame([("a1", [1.0, 0.0]), ("b1", [0.0, 1.0])], "id string, embedding array<double>")
    hybrid = index.switched(api.resolved_backend("auto", vectors, lambda q: [0.0, 1.0]))
    assert hybrid.search([(0, "parse")], 2).where("rank = 1").first().id == "b1"
    for bad in ("vectors", "odd"):
        with pytest.raises(ValueError):
            api.resolved_backend(bad)
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "a()", "source_file": "a.py"}], "links": []}))
    assert api.Index.load(spark, str(tmp_path / "g.json"), "x", *none).search([(0, "a.py")], 3).count() == 1
    assert index.refined(None, enabled=False) is index


def test_line_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"k": {i}}}\n' if i % 5 else "\n" if i % 2 else "broken\n" for i in range(400)))
    (tmp_path / "b.jsonl").write_text('{"k": 400}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    got = {r.line_no: r.k for r in graphs.read_log(spark, str(tmp_path), "k int").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: i for i in range(401) if i % 5 or i == 400}


def test_large_baskets_make_each_pair_once(spark, monkeypatch):
    rows = [("big", f"n{i:02d}", 1.0, "p") for i in range(23)] + [("small", f"n{i:02d}", 2.0, "p") for i in range(4)]
    df = spark.createDataFrame(rows, "batch string, node string, ts double, namespace string")
    want = sorted(map(tuple, memory.reinforce(None, df).collect()))
    monkeypatch.setattr(memory, "BLOCK_NODES", 5)
    assert sorted(map(tuple, memory.reinforce(None, df).collect())) == want and len(want) == 23 * 22 // 2


def test_seeds_are_counted_by_classes(spark, data, monkeypatch):
    """Pairs of documents and nodes aren't made to be counted; counts are those of the pairs."""
    rng = random.Random(3)
    words = ["ring", "bolt", "red", "small", "paper"]
    docs = [(f"d{k}", f"note {k % 3}", rng.choice(["red bolt", "small paper"]), " ".join(rng.choices(words, k=4)), rng.sample([f"t{i}" for i in range(12)], k=rng.randrange(3))) for k in range(40)]
    nodes = [(f"n{k}_{rng.choice(words)}_{rng.choice(words)}", f"{rng.choice(words)} {rng.choice(words)}") for k in range(60)]
    docs, nodes = spark.createDataFrame(docs, "id string, label string, title string, text string, tags array<string>"), spark.createDataFrame(nodes, "id string, label string")
    want = feedback.seed_from_documents(docs, nodes, 5.0).groupBy("weight").agg(F.count("*").alias("n"), F.min("node_a").alias("first")).collect()
    seeds, made = {}, feedback.seed_counts
    monkeypatch.setattr(feedback, "seed_counts", lambda d, n: (seeds.update(d=d, n=n), made(d, n))[1])
    monkeypatch.setattr(feedback, "_expanded", None)
    assert len(want) == 3 and sorted(made(docs, nodes).collect()) == sorted(want)
    from lattica.plans import node_queries

    got = node_queries.document_seeds(spark, data).collect()
    monkeypatch.undo()
    assert sorted(got) == sorted(feedback.seed_from_documents(seeds["d"], seeds["n"], 5.0).groupBy("weight").agg(F.count("*").alias("n"), F.min("node_a").alias("first")).collect())
