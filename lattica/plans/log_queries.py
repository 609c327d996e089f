"""Queries on logs, tool output, evaluation and reports, made of events, documents and conversations; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import events as V
from ..operators import governance as GV
from ..operators import logs as L
from ..operators import report as RP
from ..operators import tuning as TU
from ..sources.tables import table
from ..streaming import live as LV
from . import event_queries as EQ
from . import memory_queries as MQ
from . import node_queries as NQ


def _trail(spark, d):
    """The audit log without every 13th line, as if lines had been skipped."""
    e = table(spark, d, "events").withColumn("line_no", F.col("event_id") + F.floor(F.col("event_id") / 13))
    text = lambda c: F.lit("").alias(c)
    return e.select("line_no", F.lit("access").alias("category"), F.col("event_type").alias("action"), F.concat(F.lit('u"'), "user_id").alias("actor"), F.lit("success").alias("status"), F.concat(F.lit("é/"), F.col("event_id")).alias("target"), F.concat(F.lit('{"k":'), F.col("event_id"), F.lit("}")).alias("details"), text("actor_role"), text("ip_address"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def audit_chain(spark, d):
    """Every hash of the chained log."""
    return L.chained(_trail(spark, d)).select("line_no", "prev_sha256", "sha256")


def audit_chain_altered(spark, d):
    """The first bad line of logs of which a line was altered, left out, swapped with the next, or nothing was done."""
    a = L.chained(_trail(spark, d))
    digest = F.sha2(L.canonical(), 256)
    third = F.lit(777 + 777 // 13)
    forms = {
        "altered": a.withColumn("action", F.when(F.col("line_no") == third, "tampered").otherwise(F.col("action"))),
        "left out": a.where(F.col("line_no") != third),
        "swapped": a.withColumn("line_no", F.when(F.col("line_no") == third, third + 1).when(F.col("line_no") == third + 1, third).otherwise(F.col("line_no"))),
        "whole": a,
    }
    out = None
    for name, rows in forms.items():
        found = V.chain_broken(rows, digest).select(F.lit(name).alias("form"), "bad_line")
        out = found if out is None else out.unionByName(found)
    return out


def audit_controls(spark, d):
    return V.control_counts(EQ._audit(spark, d).withColumn("action", F.when(F.col("action") == "click", "deny_access").when(F.col("action") == "view", "rebuild").otherwise(F.col("action"))))


def audit_rotation(spark, d):
    a = L.chained(_trail(spark, d))
    archives = spark.createDataFrame([("a1", EQ.NOW - 91 * 86400), ("a2", EQ.NOW - 89 * 86400)], "archive string, ts double")
    due, size = L.archived(a, archives, EQ.NOW, 1000)
    return due.crossJoin(F.broadcast(size.select("rotate", "last_sha256")))


def _results(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.when(F.col("event_type") != "signup", F.concat(F.lit("q"), k)).alias("query"), F.array(F.lit("L0"), F.lit("L3:x")).alias("layers"), F.array(k % 5).alias("communities"), k.alias("hits"), (k * 10).cast("long").alias("tokens"), (1000.0 / (k + 1)).alias("reduction"))


def query_events(spark, d):
    e = L.query_events(_results(spark, d), "/p")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("retrieval_summary.tokens").alias("tokens"), F.sum("retrieval_summary.search_hits").alias("hits"), F.round(F.sum("retrieval_summary.reduction_ratio"), 2).alias("reduction"))


def query_records(spark, d):
    hit = lambda i: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("id"), F.when(i % 2 == 0, F.concat(F.lit("l"), i.cast("string"))).alias("label"), F.lit(None).cast("string").alias("source_file"), (1 / (i + 1)).alias("score"))
    r = _results(spark, d).withColumn("top", F.transform(F.sequence(F.lit(1), F.col("hits") % 20 + 1), hit))
    return L.query_records(r.where("query is not null")).groupBy("question").agg(F.count("*").alias("n"), F.max(F.size("top_hits")).alias("hits"), F.round(F.sum(F.aggregate("top_hits", F.lit(0.0), lambda s, h: s + h["score"])), 4).alias("score"))


def _metrics(spark, d):
    m = table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), "event_id", (F.col("value") / 3).alias("latency_ms"), (F.col("value") / 700).alias("retrieval_reuse_rate"))
    return L.metric_events(m, "query")


def metric_events(spark, d):
    return _metrics(spark, d).groupBy("event", "day").agg(F.count("*").alias("n"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"), F.round(F.sum("retrieval_reuse_rate"), 4).alias("reuse"))


def metrics_rotated(spark, d):
    """Days kept of the last 20, each cut to its last 20 events, as all are larger than a byte."""
    r = L.rotated(_metrics(spark, d).withColumn("ts", F.col("ts") + F.col("event_id") / 1e6), EQ.NOW, 20, 1, 20)
    return r.groupBy("day").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def live_events(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("ts"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("payload"))
    return L.live_events(e, 7)


def recent_events(spark, d):
    return L.recent(EQ._audit(spark, d), "2024-01-10", 50).select("line_no", "timestamp")


def _traces(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("session_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), F.concat(F.lit("f"), F.col("user_id")).alias("fingerprint"), F.col("event_type").alias("strategy"), F.lit("ok").alias("outcome"), (F.col("value") % 1).alias("success"))


def trace_query(spark, d):
    return L.traces(_traces(spark, d), session="s1", strategy="click", since=EQ.NOW - 25 * 86400, least=0.2, limit=40).select("id", "fingerprint")


def trace_counts(spark, d):
    t = _traces(spark, d)
    return L.trace_count(t).withColumn("of", F.lit("all")).unionByName(L.trace_count(t, "s1").withColumn("of", F.lit("s1")))


def trace_successes(spark, d):
    return L.successful(_traces(spark, d), 0.7, limit=20)


def _outputs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def dropped_lines(spark, d):
    """Output in which all but the first of equal lines are left out, and one that repeats six times."""
    t = _outputs(spark, d).withColumn("text", F.concat(F.repeat(F.lit("DEBUG again\n"), 6), F.lit("[WARN] once\n"), "text"))
    lines = t.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first = lines.groupBy("id", "line").agg(F.min("pos").alias("first"))
    return L.dropped_summary(lines.join(first, ["id", "line"]).select("id", "line", (F.col("pos") == F.col("first")).alias("emitted"))).select(F.col("id").alias("doc_id"), "summary")


def capped_output(spark, d):
    return _outputs(spark, d).select(F.col("id").alias("doc_id"), F.md5(L.capped_matches(F.col("text"), 5)).alias("text_md5"))


def offloaded_output(spark, d):
    return _outputs(spark, d).select(F.col("id").alias("doc_id"), F.md5(L.offloaded(F.col("text"), F.concat(F.lit("/o/"), "id"), 3000)).alias("text_md5"))


def last_outputs(spark, d):
    o = _outputs(spark, d).select("id", F.lit(0.0).alias("ts"), F.lit("run").alias("command"), F.lit(1).alias("exit_code"), F.col("text").alias("stdout"), F.when(F.col("id") % 3 == 0, F.reverse("text")).otherwise("").alias("stderr"))
    return L.last_outputs(o, 4000).select(F.col("id").alias("doc_id"), F.length("stdout").alias("out"), F.md5("stdout").alias("out_md5"), F.md5("stderr").alias("err_md5"))


def redacted_traces(spark, d):
    k = F.col("page_id")
    text = F.concat(F.lit('{"query":"a/b","data":{"source_file":"/x/y'), k, F.lit('/z.py","hits":[{"module":"a\\\\b'), k, F.lit('.ts"}],"other":"/p/q"}}'))
    return table(spark, d, "pages").select("page_id", L.redacted(text).alias("text"))


def gold_files(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("--- a/x\n+++ b/src/f"), k, F.lit(".py\n@@ -1 +1 @@\n+x\n--- a/y\n+++ /dev/null\n+++ b/lib/f"), k % 2, F.lit(".py\t2024\n+++ b/other/f"), k % 2, F.lit(".py\n"))
    return L.gold_files(table(spark, d, "orders").select(k.alias("id"), text.alias("patch"))).select("id", F.array_join("files", ",").alias("files"))


def commit_decisions(spark, d):
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Fix\n\nDecision: keep `Run"), k, F.lit("()` and `x`\n  for now\nSubjects: `A"), k, F.lit("`, X\nSigned: me\n  too\n"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("decision: only "), k)).otherwise(F.concat(F.lit("Decision:\nnone "), k))
    return L.decisions(table(spark, d, "orders").select(k.alias("sha"), text.alias("message"))).select("sha", "rationale", F.array_join("subjects", ",").alias("subjects"))


# --- evaluation and reports


def _answers(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    text = F.concat(F.when(F.col("turn") % 2 == 0, "It is not the thing we use sqlite. ").otherwise("We use postgres and jwt. "), F.col("text"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.alias("answer"), F.array(F.lit("the thing"), F.lit("uses sqlite"), F.lit("x"), F.lit("oauth tokens")).alias("facts"))


def contradictions(spark, d):
    return E.contradictions(_answers(spark, d)).withColumn("contradiction", F.round("contradiction", 6))


def judged_contradictions(spark, d):
    return E.judged_contradictions(_answers(spark, d)).withColumn("contradiction", F.round("contradiction", 6))


def faithfulness(spark, d):
    f = E.faithfulness(_answers(spark, d))
    return f.select("id", F.round("recall", 6).alias("recall"), F.round("faithfulness", 6).alias("faithfulness"))


def percentiles(spark, d):
    e = table(spark, d, "events")
    out = None
    for f in (0.0, 0.5, 0.95, 1.0):
        part = E.percentile(e, "value", f, ["event_type"]).withColumn("fraction", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def answerable(spark, d):
    return E.answerable(EQ._ranked(spark, d), EQ._relevant(spark, d), 3)


def baseline_delta(spark, d):
    s = E.summary(E.per_query(EQ._ranked(spark, d), EQ._relevant(spark, d)))
    return E.against_baseline(s, {"mrr": 0.5, "hit5": 1.0, "missing": 0.1}).select("metric", "baseline", F.round("current", 6).alias("current"), "delta")


def side_by_side(spark, d):
    a = _answers(spark, d).select(F.col("id").alias("query_id"), F.col("answer"), "facts", F.array(F.lit("thing"), F.lit("absent")).alias("modules"))
    arms = a.withColumn("arm", F.lit("full")).unionByName(a.withColumn("arm", F.lit("short")).withColumn("answer", F.substring("answer", 1, 30)))
    s = E.side_by_side(arms)
    return s.select("query_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "query_id"])


def harness_verdict(spark, d):
    s = E.summary(E.per_query(EQ._ranked(spark, d), EQ._relevant(spark, d)))
    return E.harness(s.withColumn("answerability", F.col("hit10"))).select(F.round("fitness", 6).alias("fitness"), "passed")


def fixture_queries(spark, d):
    q = E.fixture_queries(NQ.code_nodes(spark, d))
    return q.select("query", F.size("expected").alias("expected"), F.get("expected", F.lit(0)).alias("first"))


def live_quality(spark, d):
    fixtures = E.fixture_queries(NQ.code_nodes(spark, d), 50, 50)
    results = fixtures.select("query", F.explode("expected").alias("id")).where(F.crc32(F.col("query").cast("binary")) % 4 > 0)
    return TU.live_quality(results, fixtures).select("queries", F.round("quality", 6).alias("quality"), F.round("health", 6).alias("health"))


def judge_transcripts(spark, d):
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select(k.cast("string").alias("id"), F.concat(F.lit("q"), k).alias("question"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), k), F.lit(""), F.lit("g"))).alias("facts"), F.array(F.lit("a.py")).alias("modules"), F.lit(None).cast("string").alias("category"), F.lit("python").alias("language"), F.lit("fx").alias("fixture"))
    return E.transcripts(rows).select("query_id", "query", "reference_answer", F.get("source_files", F.lit(0)).alias("source"), "category")


def transcript_issues(spark, d):
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select(k.alias("query_id"), F.when(k % 2 == 0, " ").otherwise("q").alias("query"), F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise("a").alias("reference_answer"), F.when(k % 5 == 0, F.array(F.lit("x"), F.lit(""))).alias("expected_facts"))
    return E.transcript_issues(rows)


def graded_ndcg(spark, d):
    grades = EQ._relevant(spark, d).withColumn("grade", (F.col("item") % 3 + 1).cast("int"))
    return E.graded_ndcg(EQ._ranked(spark, d), grades, 10).withColumn("ndcg", F.round("ndcg", 6))


def failed_floors(spark, d):
    s = E.summary(E.per_query(EQ._ranked(spark, d), EQ._relevant(spark, d)))
    return E.failed_floors(s, {"mrr": 0.99, "hit1": 0.0, "p1": 0.99}).select("metric", F.round("value", 6).alias("value"), "floor")


def ingestion_report(spark, d):
    a = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "ingest_document").when(F.col("event_type") == "view", "ingest_cmmc").otherwise(F.col("event_type")).alias("action"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit('{"node_count": '), F.col("user_id") % 5, F.when(F.col("user_id") % 2 == 0, ', "framework": "CMMC"').otherwise(""), F.lit("}")).alias("details"))
    return RP.ingestion(a)


def community_report(spark, d):
    return RP.communities(NQ.code_nodes(spark, d), 3).select("community", "size", F.array_join("labels", "|").alias("labels"))


def domain_report(spark, d):
    return RP.domains(MQ.synapses(spark, d).withColumn("node_a", F.concat("node_a", F.lit("_py"))), MQ.transitions(spark, d))


def learning_status(spark, d):
    return RP.learning_status(RP.synapse_summary(MQ.synapses(spark, d), MQ.transitions(spark, d)))


def memory_hubs(spark, d):
    return RP.hubs(MQ.synapses(spark, d))


def dry_run(spark, d):
    f = table(spark, d, "documents").select(F.concat(F.lit("a/"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, (".py", ".ts", ".txt"))), (F.col("doc_id") % 3 + 1).cast("int"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return RP.dry_run(f)


def dashboard(spark, d):
    a = table(spark, d, "events").where("false").select(F.lit("").alias("action"), F.lit("").alias("timestamp"), F.lit("").alias("details"))
    log = EQ._log(spark, d).select("kind", (F.col("k") * 10 + 100).cast("long").alias("tokens"), F.lit(1.0).alias("ratio"))
    t = RP.dashboard(MQ.synapses(spark, d), MQ.transitions(spark, d), a, NQ.code_nodes(spark, d), V.savings(log))
    return t.groupBy("section").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def compliance_report(spark, d):
    n = NQ.code_nodes(spark, d)
    notes = n.where("file_type = 'rationale'").select("id", F.lit("CMMC").alias("framework"), F.concat(F.lit("AC-"), F.col("community") % 3).alias("control"))
    s = n.where("file_type = 'code'").select(F.concat(F.lit("compliance:SOC2:CC"), F.col("community") % 2).alias("node_a"), F.col("id").alias("node_b"))
    return GV.control_rows(n, notes, s).groupBy("control_id", "framework", "node_type").agg(F.count("*").alias("n"), F.min("source_file").alias("first"))


def file_activity(spark, d):
    """Parts as files polled three times: some grow newer, some come, some go."""
    p = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_partkey").alias("k"))
    rows = p.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("poll"), "path", "k").where("not (k % 7 = 1 and poll = 1) and not (k % 7 = 2 and poll = 3)")
    return LV.file_activity(rows.select("poll", "path", F.when((F.col("k") % 7 == 3) & (F.col("poll") > 1), 2).otherwise(1).alias("mtime")))


def subscriptions(spark, d):
    subs = spark.createDataFrame([("a", -1), ("b", 10**9), ("c", 5)], "subscriber string, after long")
    return LV.kept_back(table(spark, d, "events").select(F.col("event_id").alias("seq")), subs, 100).select("subscriber", F.size("kept").alias("kept"), F.coalesce(F.try_element_at("kept", F.lit(1)), F.lit(-1)).alias("first"), "dropped")


_F = (file_activity, subscriptions, audit_chain, audit_chain_altered, audit_controls, audit_rotation, query_events, query_records, metric_events, metrics_rotated, live_events, recent_events, trace_query, trace_counts, trace_successes, dropped_lines, capped_output, offloaded_output, last_outputs, redacted_traces, gold_files, commit_decisions, contradictions, judged_contradictions, faithfulness, percentiles, answerable, baseline_delta, side_by_side, harness_verdict, fixture_queries, live_quality, judge_transcripts, transcript_issues, graded_ndcg, failed_floors, ingestion_report, community_report, domain_report, learning_status, memory_hubs, dry_run, dashboard, compliance_report)
QUERIES = {f.__name__: f for f in _F}

# the chain is made by a recursion over the lines in order, a line a step
_CHAIN = """tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id + event_id // 13 AS line_no, '{"action":"' || event_type || '","actor":"u\\"' || user_id || '","actor_role":"","category":"access","details":{"k":' || event_id || '},"ip_address":"","status":"success","target":"\\u00e9/' || event_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS t FROM events),
ch AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS line_no, NULL::VARCHAR AS prev_sha256, repeat('0', 64) AS sha256 UNION ALL SELECT tr.n, tr.line_no, ch.sha256, sha256(ch.sha256 || tr.t) FROM ch JOIN tr ON tr.n = ch.n + 1)"""
_ANS = "an AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'It is not the thing we use sqlite. ' ELSE 'We use postgres and jwt. ' END || text AS a, turn % 2 = 0 AS e FROM conversations WHERE text IS NOT NULL), al AS (SELECT id, lower(a) AS a, e FROM an)"
# facts: "the thing", "uses sqlite", "oauth tokens"
_CON = r"""cn AS (SELECT id, a, e, (contains(a, 'the') AND contains(a, 'thing')) AS f1, (contains(a, 'uses') AND contains(a, 'sqlite')) AS f2, (contains(a, 'oauth') AND contains(a, 'tokens')) AS f3,
 regexp_matches(a[greatest(1, strpos(a, 'the') - 20):strpos(a, 'the') - 1], '(^|\s)(no|not|never|don''t|doesn''t|didn''t|isn''t|aren''t|wasn''t|weren''t|cannot|can''t|won''t|without|false|incorrect|invalid|unable)(\s+\S+){0,2}\s*$') AS n_the,
 regexp_matches(a[greatest(1, strpos(a, 'thing') - 20):strpos(a, 'thing') - 1], '(^|\s)(no|not|never|don''t|doesn''t|didn''t|isn''t|aren''t|wasn''t|weren''t|cannot|can''t|won''t|without|false|incorrect|invalid|unable)(\s+\S+){0,2}\s*$') AS n_thing,
 (contains(a, 'postgres') OR contains(a, 'mysql')) AND NOT contains(a, 'sqlite') AS s2, contains(a, 'jwt') AND NOT contains(a, 'oauth') AS s3 FROM al)"""
_RM = f"WITH {EQ._metrics()}"
ORACLES = {
    "file_activity": "SELECT 2 AS poll, 'f' || p_partkey AS path, CASE p_partkey % 7 WHEN 1 THEN 'added' ELSE 'modified' END AS change FROM part WHERE p_partkey % 7 IN (1, 3) UNION ALL SELECT 3, 'f' || p_partkey, 'deleted' FROM part WHERE p_partkey % 7 = 2",
    "subscriptions": "WITH e AS (SELECT count(*) AS n, max(event_id) AS m FROM events) SELECT 'a' AS subscriber, 100 AS kept, m - 99 AS first, n - 100 AS dropped FROM e UNION ALL SELECT 'b', 0, -1, 0 FROM e UNION ALL SELECT 'c', 100, m - 99, n - 106 FROM e",
    "audit_chain": f"WITH RECURSIVE {_CHAIN} SELECT line_no, prev_sha256, sha256 FROM ch WHERE n > 0",
    "audit_chain_altered": "WITH e AS (SELECT event_id + event_id // 13 AS l FROM events WHERE event_id >= 777 ORDER BY event_id LIMIT 2) SELECT 'altered' AS form, min(l) AS bad_line FROM e UNION ALL SELECT 'left out', max(l) FROM e UNION ALL SELECT 'swapped', min(l) FROM e",
    "audit_controls": "SELECT count(*) AS events, count(*) AS AU, count(*) FILTER (event_type = 'click') AS AC, count(*) FILTER (event_type = 'view') AS SI FROM events",
    "audit_rotation": f"WITH RECURSIVE {_CHAIN}, la AS MATERIALIZED (SELECT arg_max(sha256, n) AS last_sha256 FROM ch) SELECT a AS archive, a = 'a1' AS due, true AS rotate, last_sha256 FROM (SELECT unnest(['a1', 'a2']) AS a), la",
    "query_events": "WITH e AS (SELECT event_type, (props::JSON->>'$.k')::INT AS k FROM events) SELECT CASE WHEN event_type = 'signup' THEN 'wakeup' ELSE 'query' END AS event_type, count(*) AS n, sum(k * 10)::BIGINT AS tokens, sum(k)::BIGINT AS hits, round(sum(round(1000.0::DOUBLE / (k + 1), 4)), 2) AS reduction FROM e GROUP BY 1",
    "query_records": "WITH e AS (SELECT (props::JSON->>'$.k')::INT AS k FROM events WHERE event_type <> 'signup') SELECT 'q' || k AS question, count(*) AS n, least(12, k % 20 + 1)::INT AS hits, round(count(*) * list_sum(list_transform(range(1, least(12, k % 20 + 1) + 1), lambda i: round(1.0::DOUBLE / (i + 1), 3))), 4) AS score FROM e GROUP BY k",
    "metric_events": "SELECT 'query' AS event, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(round(value / 3, 2)), 2) AS latency_ms, round(sum(round(value / 700, 4)), 4) AS reuse FROM events GROUP BY 2",
    "metrics_rotated": f"WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY floor(epoch(ts)) + event_id / 1e6 DESC) AS r FROM events WHERE strftime(ts, '%Y-%m-%d') >= strftime(to_timestamp({EQ.NOW} - 20 * 86400)::TIMESTAMP, '%Y-%m-%d')) SELECT day, count(*) AS n, min(event_id) AS first FROM e WHERE r <= 20 GROUP BY day",
    "live_events": """SELECT '{"type":"' || event_type || '","ts":' || event_id || ',"_pid":7' || CASE WHEN event_id % 3 > 0 THEN ',' || substr(props, 2, length(props) - 2) ELSE '' END || '}' AS value FROM events""",
    "recent_events": f"WITH {EQ._AUDIT} SELECT line_no, timestamp FROM au WHERE timestamp >= '2024-01-10' ORDER BY line_no DESC LIMIT 50",
    "trace_query": f"SELECT event_id AS id, 'f' || user_id AS fingerprint FROM events WHERE user_id % 9 = 1 AND event_type = 'click' AND floor(epoch(ts)) >= {EQ.NOW} - 25 * 86400 AND value % 1 >= 0.2::DOUBLE ORDER BY floor(epoch(ts)) DESC, event_id DESC LIMIT 40",
    "trace_counts": "SELECT 'all' AS of, count(*) AS n FROM events UNION ALL SELECT 's1', count(*) FROM events WHERE user_id % 9 = 1",
    "trace_successes": "WITH t AS (SELECT user_id, floor(epoch(ts)) AS t, event_id FROM events WHERE value % 1 >= 0.7::DOUBLE ORDER BY t DESC, event_id DESC LIMIT 40) SELECT 'f' || user_id AS fingerprint, max(t)::DOUBLE AS timestamp FROM t GROUP BY user_id ORDER BY max(t) DESC, max(event_id) DESC LIMIT 20",
    "dropped_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(repeat('DEBUG again' || chr(10), 6) || '[WARN] once' || chr(10) || coalesce(text, ''), chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) - 1 AS n FROM l GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*(\[?\s*(DEBUG|TRACE|debug|trace)\b|\w*\s+debug:)') THEN 'debug' WHEN regexp_matches(line, '^\s*(\[?\s*(INFO|info)\b|\w*\s+info:)') THEN 'info' WHEN regexp_matches(line, '^\s*\[?\s*(WARN(ING)?|warn(ing)?)\b') THEN 'warn' ELSE 'other' END AS kind, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
r AS (SELECT doc_id, string_agg(n || '× ''' || substr(trim(line), 1, 50) || '''', '; ' ORDER BY n DESC, trim(line)) AS r FROM (SELECT * FROM c WHERE trim(line) <> '' AND n >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, trim(line)) <= 2) GROUP BY 1)
SELECT k.doc_id, sum(n)::BIGINT || ' lines (' || string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, kind) || ')' || coalesce('; repeated: ' || any_value(r), '') AS summary FROM k LEFT JOIN r USING (doc_id) GROUP BY k.doc_id""",
    "capped_output": "WITH l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 5 THEN text ELSE array_to_string(l[1:5], chr(10)) || chr(10) || '[capped at 5 matches. ' || (len(l) - 5) || ' more hidden.]' END) AS text_md5 FROM l",
    "offloaded_output": "SELECT doc_id, md5(CASE WHEN length(t) <= 3000 THEN t ELSE '[content offloaded (' || length(t) || ' chars → /o/' || doc_id || ')]' || chr(10) || '--- head (500 chars) ---' || chr(10) || substr(t, 1, 500) || chr(10) || '--- tail (500 chars) ---' || chr(10) || substr(t, length(t) - 499) || chr(10) || '[Full content at: /o/' || doc_id || ']' END) AS text_md5 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "last_outputs": """WITH o AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % 3 = 0 THEN reverse(coalesce(text, '')) ELSE '' END AS b FROM documents), s AS (SELECT *, length(a) + length(b) > 4000 AS over, CASE WHEN length(b) = 0 THEN 4000 WHEN length(a) = 0 THEN 0 ELSE greatest(1024, 4000 * length(a) // (length(a) + length(b))) END AS x FROM o), y AS (SELECT *, CASE WHEN length(b) = 0 THEN 0 ELSE greatest(1024, 4000 - x) END AS z FROM s),
k AS (SELECT doc_id, CASE WHEN NOT over OR length(a) <= x OR x <= 0 THEN a ELSE substr(a, 1, x // 2) || chr(10) || chr(10) || '[... ' || (length(a) - x) || ' bytes elided by output cache ...]' || chr(10) || chr(10) || substr(a, length(a) - (x - x // 2) + 1) END AS a, CASE WHEN NOT over OR length(b) <= z OR z <= 0 THEN b ELSE substr(b, 1, z // 2) || chr(10) || chr(10) || '[... ' || (length(b) - z) || ' bytes elided by output cache ...]' || chr(10) || chr(10) || substr(b, length(b) - (z - z // 2) + 1) END AS b FROM y)
SELECT doc_id, length(a)::INT AS out, md5(a) AS out_md5, md5(b) AS err_md5 FROM k""",
    "redacted_traces": r"""SELECT page_id, '{"query":"a/b","data":{"source_file":"z.py","hits":[{"module":"b' || page_id || '.ts"}],"other":"/p/q"}}' AS text FROM pages""",
    "gold_files": "SELECT o_orderkey AS id, array_to_string(list_filter(['f' || o_orderkey || '.py', CASE WHEN o_orderkey <> o_orderkey % 2 THEN 'f' || (o_orderkey % 2) || '.py' END], lambda x: x IS NOT NULL), ',') AS files FROM orders",
    "commit_decisions": "SELECT o_orderkey::VARCHAR AS sha, CASE o_orderkey % 3 WHEN 0 THEN 'keep `Run' || o_orderkey || '()` and `x` for now' ELSE 'only ' || o_orderkey END AS rationale, CASE o_orderkey % 3 WHEN 0 THEN 'A' || o_orderkey || ',X,Run' || o_orderkey ELSE '' END AS subjects FROM orders WHERE o_orderkey % 3 < 2",
    "contradictions": f"WITH {_ANS}, {_CON} SELECT id, round(0.5::DOUBLE * (f1 AND (n_the OR n_thing))::INT / 3 + 0.5::DOUBLE * (s2::INT + s3::INT) / 3, 6) AS contradiction FROM cn WHERE NOT f2 AND NOT f3 UNION ALL SELECT id, NULL FROM cn WHERE f2 OR f3",
    "faithfulness": f"WITH {_ANS}, {_CON}, r AS (SELECT id, (f1::INT + f2::INT + f3::INT) / 3 AS r, 0.5::DOUBLE * (f1 AND (n_the OR n_thing))::INT / 3 + 0.5::DOUBLE * (s2::INT + s3::INT) / 3 AS c FROM cn) SELECT id, round(r, 6) AS recall, round(r * (1 - c), 6) AS faithfulness FROM r",
    "domain_report": f"""WITH {MQ._SYN}, {MQ._TR}, nd AS (SELECT node_a || '_py' AS node FROM syn UNION SELECT node_b FROM syn UNION SELECT from_node FROM tr UNION SELECT to_node FROM tr), k AS (SELECT CASE WHEN suffix(node, '_py') THEN 'code' ELSE 'unknown' END AS domain, count(*) AS n FROM nd GROUP BY 1)
SELECT * FROM k UNION ALL SELECT 'total', sum(n)::BIGINT FROM k""",
    "learning_status": f"""WITH {MQ._SYN}, {MQ._TR}, a AS (SELECT count(*) AS edges, count(*) FILTER (activation_count >= 5) AS lasting, round(sum(weight), 3) AS weight, (SELECT count(*) FROM tr) AS transitions, (SELECT count(*) FROM (SELECT node_a FROM syn UNION SELECT node_b FROM syn)) AS nodes FROM syn)
SELECT *, edges > 0 AS has_data, CASE WHEN edges = 0 THEN 'dormant' WHEN edges < 10 THEN 'warming_up' WHEN lasting = 0 THEN 'learning' WHEN transitions < 5 THEN 'partially_active' ELSE 'active' END AS status, round(weight / edges, 4) AS avg_weight FROM a""",
    "percentiles": "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), f AS (SELECT unnest([0.0, 0.5, 0.95, 1.0])::DOUBLE AS fraction) SELECT event_type, value, fraction FROM e, f WHERE i = least(floor(n * fraction)::BIGINT, n - 1)",
    "answerable": f"{_RM} SELECT query_id, bool_or(good = 1 AND rank <= 3) AS answerable FROM mk GROUP BY 1",
    "baseline_delta": f"{_RM} SELECT m AS metric, b::DOUBLE AS baseline, round(c, 6) AS current, round(c - b, 4) AS delta FROM (SELECT 'mrr' AS m, 0.5::DOUBLE AS b, avg(rr) AS c FROM pq UNION ALL SELECT 'hit5', 1.0, avg(hit5) FROM pq)",
    "harness_verdict": f"{_RM} SELECT round(0.6::DOUBLE * avg(rr) + 0.4::DOUBLE * avg(hit10), 6) AS fitness, avg(rr) >= 0.5 AND avg(hit10) >= 0.7 AS passed FROM pq",
    "fixture_queries": f"WITH {NQ._N}, l AS (SELECT label, count(*) AS n, min(id) AS first FROM gn GROUP BY 1 ORDER BY first LIMIT 50) SELECT label AS query, n::INT AS expected, first FROM l ORDER BY label LIMIT 20",
    "judge_transcripts": "SELECT item_id::VARCHAR AS query_id, 'q' || item_id AS query, 'f' || item_id || ' g' AS reference_answer, 'fx/a.py' AS source, 'architecture' AS category FROM benchmark WHERE item_id % 3 <> 0",
    "transcript_issues": "SELECT item_id AS query_id, 'empty query' AS issue FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'empty reference_answer' FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 'expected_facts[1]: empty fact' FROM benchmark WHERE item_id % 5 = 0",
    "graded_ndcg": f"""{_RM}, gr AS (SELECT DISTINCT doc_id AS item, (doc_id % 3 + 1)::INT AS g FROM labels WHERE quality = 1), id AS (SELECT sum((2 ** g - 1) / log2(i + 1)) AS ideal FROM (SELECT g, row_number() OVER (ORDER BY g DESC, item) AS i FROM gr) WHERE i <= 10)
SELECT query_id, round(coalesce((SELECT sum((2 ** g - 1) / log2(rank + 1)) FROM rk JOIN gr USING (item) WHERE rk.query_id = q.query_id AND rank <= 10), 0) / ideal, 6) AS ndcg FROM (SELECT unnest(range(4))::INT AS query_id) q, id""",
    "failed_floors": f"{_RM} SELECT m AS metric, round(v, 6) AS value, 0.99::DOUBLE AS floor FROM (SELECT 'mrr' AS m, avg(rr) AS v FROM pq UNION ALL SELECT 'p1', avg(p1) FROM pq) WHERE v < 0.99",
    "ingestion_report": "SELECT CASE WHEN user_id % 2 = 0 THEN 'CMMC' ELSE 'unknown' END AS framework, sum(user_id % 5)::BIGINT AS nodes, count(*) AS files, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "community_report": f"WITH {NQ._N}, s AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS nth FROM gn) SELECT community, count(*) AS size, string_agg(label, '|' ORDER BY nth) FILTER (nth <= 3) AS labels FROM s GROUP BY 1",
    "memory_hubs": f"WITH {MQ._SYN}, b AS (SELECT node_a AS node, node_b AS o FROM syn UNION SELECT node_b, node_a FROM syn) SELECT node, count(*) AS degree FROM b GROUP BY 1 ORDER BY degree DESC, node LIMIT 8",
    "dry_run": """WITH f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'Python' ELSE 'TypeScript' END AS language, len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN suffix(coalesce(text, ''), chr(10)) OR coalesce(text, '') = '' THEN 1 ELSE 0 END AS lines FROM documents WHERE doc_id % 3 < 2),
n AS (SELECT language, count(*) AS files, sum(lines)::BIGINT AS lines FROM f GROUP BY ROLLUP (language)) SELECT language, files, lines, greatest(lines * 25, files * 400) AS est_full_tokens, least(2400, greatest(600, files * 20)) AS est_query_tokens, round(greatest(lines * 25, files * 400)::DOUBLE / least(2400, greatest(600, files * 20)), 1) AS est_reduction FROM n""",
    "compliance_report": f"""WITH {NQ._N}, r AS (SELECT 'AC-' || (community % 3) AS control_id, 'CMMC' AS framework, file_type, source_file FROM gn WHERE file_type = 'rationale' UNION ALL SELECT 'CC' || (community % 2), 'SOC2', file_type, source_file FROM gn WHERE file_type = 'code') SELECT control_id, framework, file_type AS node_type, count(*) AS n, min(source_file) AS first FROM r GROUP BY ALL""",
}
