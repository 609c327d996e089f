"""Event, evaluation and context queries on events, documents, labels and conversations, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import evaluation as E
from ..operators import events as V
from ..operators import retrieval as R
from ..sources.tables import table
from . import retrieval_queries as RQ

NOW = 1706745600.0  # 2024-02-01


def _log(spark, d):
    e = V.sessions(table(spark, d, "events"), "user_id", "ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.withColumn("k", k).withColumn("kind", F.when(F.col("event_type") == "signup", "wakeup").otherwise("query"))


def session_starts(spark, d):
    return _log(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def re_query_rate(spark, d):
    q = _log(spark, d).where("kind = 'query'").select("session", F.struct("ts", "event_id").alias("pos"), F.array(F.col("k") % 4, F.col("k") % 7, F.col("k") % 3).alias("communities"))
    return V.re_query_rate(q).withColumn("rate", F.round("rate", 6))


def escalation_rate(spark, d):
    q = _log(spark, d).where("kind = 'query'").select(F.array(F.lit("L0"), F.when(F.col("k") % 3 == 0, "L3:search").when(F.col("k") % 5 == 0, "L3").otherwise("L2")).alias("layers"))
    return V.escalation_rate(q).withColumn("rate", F.round("rate", 6))


def wakeup_only_rate(spark, d):
    return V.wakeup_only_rate(_log(spark, d)).withColumn("rate", F.round("rate", 6))


def savings_report(spark, d):
    e = _log(spark, d).select("kind", (F.col("k") * 10 + 100).cast("long").alias("tokens"), (50_000 / (F.col("k") * 10 + 100)).alias("ratio"))
    return V.savings(e).withColumn("avg_ratio", F.round("avg_ratio", 6))


def metrics_summary(spark, d):
    m = _log(spark, d).select(F.col("event_type").alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("k").cast("double").alias("latency_ms"), F.when(F.col("k") % 2 == 0, F.col("k") / 100).alias("reuse"), (F.col("k") * 10).cast("long").alias("tokens"))
    return V.metrics_summary(m, NOW, 14)


def _audit(spark, d):
    e = table(spark, d, "events")
    cat = F.when(F.col("event_type").isin("signup", "purchase"), "access").otherwise("query")
    rows = e.select(F.col("event_id").alias("line_no"), cat.alias("category"), F.col("event_type").alias("action"), F.concat(F.lit("u"), "user_id").alias("actor"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return rows.withColumn("sha256", F.sha2(F.concat_ws("|", "line_no", "actor", "action"), 256))


def audit_summary(spark, d):
    return V.audit_summary(_audit(spark, d))


def audit_search(spark, d):
    return V.audit_search(_audit(spark, d), category="QUER", actor="u1", since="2024-01-05", limit=50).select("line_no", "actor", "action", "timestamp")


def audit_cef(spark, d):
    return _audit(spark, d).select("line_no", V.cef().alias("cef"))


def session_windows(spark, d):
    return V.debounced(table(spark, d, "events"), "user_id", "ts", "30 minutes").select("user_id", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


def rate_limit(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("actor"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return V.rate_limited(c, 2, 21_600.0).groupBy("actor").agg(F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"))


def circuit_breaker(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return V.breaker_states(c, 2, 86_400.0).groupBy("state").agg(F.count("*").alias("n"))


def recent_log(spark, d):
    return V.keep_last(table(spark, d, "events").select("event_id", "event_type"), 100, "event_id")


def trace_repeats(spark, d):
    return V.repeat_rate(table(spark, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("fingerprint"))).withColumn("rate", F.round("rate", 6))


RANKED = {0: ["thing", "est"], 1: ["eau", "que"], 2: ["der", "keit"], 3: ["idiot", "scum", "moron"]}


def _ranked(spark, d):
    return R.bm25_many(table(spark, d, "documents"), RANKED, 20).select(F.col("query_id").cast("int").alias("query_id"), "rank", F.col("id").alias("item"))


def _relevant(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item"))
    return spark.range(4).select(F.col("id").cast("int").alias("query_id")).crossJoin(F.broadcast(good) if good.count() < 100_000 else good)


def quality_metrics(spark, d):
    per = E.per_query(_ranked(spark, d), _relevant(spark, d))
    return per.select(*[F.round(c, 6).alias(c) if c != "query_id" and not c.startswith("hit") else F.col(c) for c in per.columns])


def quality_summary(spark, d):
    s = E.summary(E.per_query(_ranked(spark, d), _relevant(spark, d)))
    return s.select("queries", *[F.round(c, 6).alias(c) for c in s.columns if c != "queries"])


def fact_recall(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer"), F.array(F.lit("the and"), F.lit("der die"), F.lit("que la"), F.lit("thing"), F.lit("x")).alias("facts"))
    return E.fact_recall(c).withColumn("recall", F.round("recall", 6))


def entity_resolution(spark, d):
    p = table(spark, d, "part")
    return E.resolve_entities(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label")), p.select(F.col("p_partkey").alias("entity"), F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 3 == 0, "new")).alias("label")))


def intent_boost(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "document").otherwise("code").alias("file_type"))
    return R.apply_intent(R.bm25_search(table(spark, d, "documents"), RQ.TERMS).join(docs, "id"), "docs").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def synapse_boost(spark, d):
    hits = R.bm25_search(table(spark, d, "documents"), RQ.TERMS).select("id", "score")
    energy = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (1.0 / (F.col("doc_id") + 1)).alias("energy"))
    return X.boost(hits, energy).select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "pulled")


def context_layers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("l3"), (F.col("doc_id") % 3 == 0).alias("deep"))
    return X.budget(docs).select("doc_id", "total_tokens", F.round("reduction", 6).alias("reduction"))


def compress_lines(spark, d):
    return X.compressed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), "n_lines", "n_kept", F.md5("kept").alias("kept_md5"))


_F = (session_starts, re_query_rate, escalation_rate, wakeup_only_rate, savings_report, metrics_summary, audit_summary, audit_search, audit_cef, session_windows, rate_limit, circuit_breaker, recent_log, trace_repeats, quality_metrics, quality_summary, fact_recall, entity_resolution, intent_boost, synapse_boost, context_layers, compress_lines)
QUERIES = {f.__name__: f for f in _F}

_LOG = """e0 AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000, true) THEN 1 ELSE 0 END AS fresh, (props::JSON->>'$.k')::INT AS k, CASE WHEN event_type = 'signup' THEN 'wakeup' ELSE 'query' END AS kind FROM events),
lg AS (SELECT *, user_id || '-' || sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e0)"""
_AUDIT = "au AS (SELECT event_id AS line_no, CASE WHEN event_type IN ('signup', 'purchase') THEN 'access' ELSE 'query' END AS category, event_type AS action, 'u' || user_id AS actor, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events)"


def _bm(i: int, terms: list[str]) -> str:
    tf = [f"len(list_filter(t, lambda x: x = '{t}'))" for t in terms]
    part = " + ".join(f"ln((n - df{j} + 0.5) / (df{j} + 0.5) + 1) * tf{j} * 2.5 / (tf{j} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))" for j in range(len(terms)))
    hit = " + ".join(f"tf{j}" for j in range(len(terms)))
    return f"""c{i} AS (SELECT id, len(t) AS dl, {', '.join(f'{x} AS tf{j}' for j, x in enumerate(tf))} FROM tk), s{i} AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'sum((tf{j} > 0)::INT) AS df{j}' for j in range(len(terms)))} FROM c{i}),
q{i} AS (SELECT {i} AS query_id, id AS item, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM (SELECT id, {part} AS raw FROM c{i}, s{i} WHERE {hit} > 0 ORDER BY raw DESC, id LIMIT 20))"""


def _metrics() -> str:
    per = ["query_id", "coalesce(1.0::DOUBLE / min(rank) FILTER (good = 1), 0) AS rr"]
    for k in (1, 3, 5, 10):
        h = f"count(*) FILTER (good = 1 AND rank <= {k})"
        per += [f"{h}::DOUBLE / least({k}, count(*)) AS p{k}", f"CASE WHEN any_value(nr) > 0 THEN {h}::DOUBLE / any_value(nr) ELSE 0 END AS r{k}",
                f"CASE WHEN any_value(nr) > 0 THEN coalesce(sum(1 / log2(rank + 1)) FILTER (good = 1 AND rank <= {k}), 0) / list_sum(list_transform(range(1, least({k}, any_value(nr)) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg{k}",
                f"({h} > 0)::INT AS hit{k}"]
    terms = (["thing", "est"], ["eau", "que"], ["der", "keit"], ["idiot", "scum", "moron"])
    return f"""tk AS (SELECT doc_id AS id, {RQ._TOKENS} AS t FROM documents), {', '.join(_bm(i, t) for i, t in enumerate(terms))},
rk AS (SELECT * FROM q0 UNION ALL SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3),
mk AS (SELECT rk.*, (l.doc_id IS NOT NULL)::INT AS good, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS nr FROM rk LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = item),
pq AS (SELECT {', '.join(per)} FROM mk GROUP BY query_id)"""


_MCOLS = [f"{m}{k}" for k in (1, 3, 5, 10) for m in ("p", "r", "ndcg", "hit")]
ORACLES = {
    "session_starts": f"WITH {_LOG} SELECT session, count(*) AS n, min(event_id) AS first_event FROM lg GROUP BY session",
    "re_query_rate": f"""WITH {_LOG}, q AS (SELECT session, ts, event_id, list_distinct([k % 4, k % 7, k % 3]) AS now FROM lg WHERE kind = 'query'), p AS (SELECT now, lag(now) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM q),
r AS (SELECT count(*) AS pairs, count(*) FILTER (len(list_intersect(now, before)) / least(len(now), len(before)) >= 0.5) AS re_queries FROM p WHERE before IS NOT NULL) SELECT pairs, re_queries, round(coalesce(re_queries / nullif(pairs, 0), 0), 6) AS rate FROM r""",
    "escalation_rate": f"WITH {_LOG}, r AS (SELECT count(*) AS queries, count(*) FILTER (k % 3 = 0 OR k % 5 = 0) AS escalated FROM lg WHERE kind = 'query') SELECT queries, escalated, round(escalated / queries, 6) AS rate FROM r",
    "wakeup_only_rate": f"WITH {_LOG}, p AS (SELECT session, count(*) FILTER (kind = 'wakeup') AS w, count(*) FILTER (kind = 'query') AS q FROM lg GROUP BY 1), r AS (SELECT count(*) AS sessions, count(*) FILTER (q = 0) AS wakeup_only FROM p WHERE w > 0) SELECT sessions, wakeup_only, round(wakeup_only / sessions, 6) AS rate FROM r",
    "savings_report": f"""WITH {_LOG}, x AS (SELECT kind, (k * 10 + 100)::BIGINT AS t FROM lg), a AS (SELECT count(*) FILTER (kind <> 'wakeup') AS queries, count(*) FILTER (kind = 'wakeup') AS wakeups, sum(t)::BIGINT AS tokens_used, round(avg(50000::DOUBLE / t) FILTER (kind <> 'wakeup'), 6) AS avg_ratio, sum(50000 - t) FILTER (kind <> 'wakeup') AS qs FROM x)
SELECT queries, wakeups, tokens_used, avg_ratio, (queries + wakeups) * 50000 AS tokens_baseline, (queries + wakeups) * 50000 - tokens_used AS tokens_saved, round(((queries + wakeups) * 50000 - tokens_used) * 3.0::DOUBLE / 1e6, 4) AS dollars_saved, round(qs::DOUBLE / queries * 3.0::DOUBLE / 1e6 * 100 * 30, 2) AS dollars_month FROM a""",
    "metrics_summary": f"WITH {_LOG} SELECT event_type AS event, count(*) AS n, round(avg(k::DOUBLE), 2) AS latency_ms, round(avg(CASE WHEN k % 2 = 0 THEN k / 100 END), 4) AS reuse, round(avg(k * 10), 0) AS tokens, sum(k * 10)::BIGINT AS total_tokens FROM lg WHERE floor(epoch(ts)) >= {NOW}::DOUBLE - 14 * 86400 GROUP BY 1",
    "audit_summary": f"WITH {_AUDIT} SELECT category, count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS failed, max(timestamp) AS last FROM au GROUP BY 1",
    "audit_search": f"WITH {_AUDIT} SELECT line_no, actor, action, timestamp FROM au WHERE contains(category, 'quer') AND contains(actor, 'u1') AND timestamp >= '2024-01-05' ORDER BY line_no LIMIT 50",
    "audit_cef": f"WITH {_AUDIT} SELECT line_no, 'CEF:0|lattica|audit|1|' || category || '|' || action || '|' || CASE WHEN status = 'success' THEN 0 ELSE 5 END || '|suser=' || actor || ' act=' || action AS cef FROM au",
    "session_windows": """WITH e AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, true) THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, count(*) AS n, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM s GROUP BY user_id, s""",
    "recent_log": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "trace_repeats": "WITH p AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS repeats, round(sum(n - 1) / sum(n), 6) AS rate FROM p",
    "quality_metrics": f"WITH {_metrics()} SELECT query_id, round(rr, 6) AS rr, {', '.join(c if c.startswith('hit') else f'round({c}, 6) AS {c}' for c in _MCOLS)} FROM pq",
    "quality_summary": f"WITH {_metrics()} SELECT count(*) AS queries, round(avg(rr), 6) AS mrr, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _MCOLS)} FROM pq",
    "fact_recall": """SELECT conv_id || '-' || turn AS id, round(((contains(lower(text), 'the') AND contains(lower(text), 'and'))::INT + (contains(lower(text), 'der') AND contains(lower(text), 'die'))::INT + (contains(lower(text), 'que') AND contains(lower(text), 'la'))::INT + contains(lower(text), 'thing')::INT) / 4, 6) AS recall FROM conversations""",
    "entity_resolution": """WITH n AS (SELECT p_partkey AS k, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS a, trim(regexp_replace(lower(p_type || CASE WHEN p_partkey % 3 = 0 THEN ' new' ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM part),
a AS (SELECT k AS id, a AS norm, list_distinct(string_split(a, '_')) AS t FROM n), b AS (SELECT k AS entity, b AS norm, list_distinct(string_split(b, '_')) AS t FROM n WHERE b IS NOT NULL),
x AS (SELECT id, min(entity) AS entity, 1.0::DOUBLE AS s FROM a JOIN b USING (norm) GROUP BY id), p AS (SELECT id, entity, len(list_intersect(a.t, b.t)) / sqrt(len(a.t) * len(b.t)) AS s FROM a, b WHERE len(list_intersect(a.t, b.t)) > 0),
q AS (SELECT id, entity, s FROM p WHERE id NOT IN (SELECT id FROM x) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, entity) = 1), u AS (SELECT * FROM x UNION ALL SELECT * FROM q)
SELECT a.id, CASE WHEN s >= 0.95 THEN 'merge' WHEN s >= 0.85 THEN 'review' ELSE 'distinct' END AS action, CASE WHEN s >= 0.85 THEN entity END AS entity, round(CASE WHEN s >= 0.85 THEN s ELSE 0 END, 6) AS similarity FROM a LEFT JOIN u USING (id)""",
    "intent_boost": f"WITH {RQ._bm25()} SELECT id AS doc_id, round(score * CASE WHEN id % 3 = 0 THEN 2.0::DOUBLE ELSE 0.7::DOUBLE END, 6) AS score FROM bm",
    "synapse_boost": f"""WITH {RQ._bm25()}, en AS (SELECT doc_id AS id, 1.0::DOUBLE / (doc_id + 1) AS energy FROM documents),
b AS (SELECT id, score + CASE WHEN rank <= 3 THEN 0 ELSE 0.3::DOUBLE * coalesce(energy, 0) END AS s FROM bm LEFT JOIN en USING (id)), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM b),
p AS (SELECT id, 0.3::DOUBLE * energy AS s FROM en WHERE energy >= 0.15 AND id NOT IN (SELECT id FROM bm) ORDER BY s DESC, id LIMIT 2),
u AS (SELECT id, s, r, false AS pulled FROM o WHERE r <= 10 - (SELECT count(*) FROM p) UNION ALL SELECT id, s, 100 + row_number() OVER (ORDER BY s DESC, id), true FROM p)
SELECT id AS doc_id, row_number() OVER (ORDER BY r)::INT AS rank, round(s, 6) AS score, pulled FROM u""",
    "context_layers": "SELECT doc_id, (750 + CASE WHEN doc_id % 3 = 0 THEN 800 ELSE 0 END + least(1000, length(text) // 4))::BIGINT AS total_tokens, round(50000 / (750 + CASE WHEN doc_id % 3 = 0 THEN 800 ELSE 0 END + least(1000, length(text) // 4)), 6) AS reduction FROM documents",
    "compress_lines": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, len(l) AS n, list_distinct(list_transform(list_filter(list_zip(l, range(len(l))), lambda x: regexp_matches(x[1], '(?i)error|fail|traceback|exception|panic|fatal|warning| passed|^===+|^---+') OR x[2] >= len(l) - 3), lambda x: x[2])) AS p, l FROM l)
SELECT doc_id, n::INT AS n_lines, len(p)::INT AS n_kept, md5(array_to_string(list_transform(list_sort(p), lambda i: l[i + 1]), chr(10))) AS kept_md5 FROM k""",
}
