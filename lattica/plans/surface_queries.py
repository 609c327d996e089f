"""Governance, content and tuning queries, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as CN
from ..operators import governance as GV
from ..operators import retrieval as R
from ..operators import tuning as TU
from ..functions.text import estimated_tokens
from ..sources.tables import table
from .retrieval_queries import _TOKENS


def rbac_check(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(F.lit("admin"), F.lit("reader"), F.lit("guest")), (F.col("user_id") % 3 + 1).cast("int")).alias("role"), F.col("event_type").alias("tool"))
    policy = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("tool")) for r, t in (("admin", "*"), ("reader", "view"), ("reader", "click"))])).alias("p")).select("p.*")
    return GV.allowed(e, policy).groupBy("role", "tool").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


def endpoint_coverage(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"#.*$", "").alias("path"))
    e = p.select(F.lit("GET").alias("method"), F.concat("path", F.lit("/:id/")).alias("path"))
    r = p.select(F.concat("path", F.when(F.col("page_id") % 3 == 0, F.lit("/{key}")).otherwise(F.lit("/other"))).alias("path"), (F.col("page_id") % 4 == 0).alias("real_db"), (F.col("page_id") % 5 == 0).alias("skipped"))
    return GV.endpoint_coverage(e, r).groupBy("status").agg(F.count("*").alias("n"), F.sum("refs").alias("refs"))


def type_risks(spark, d):
    kinds = F.array(F.lit("Optional[int]"), F.lit("None"), F.lit(None).cast("string"), F.lit("any"), F.lit("int | None"), F.lit("str"))
    c = table(spark, d, "part").select(F.lit("f").alias("caller"), F.concat(F.lit("p"), "p_partkey").alias("callee"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("return_type"), F.lit(0.0).alias("confidence"))
    return GV.type_risks(c).groupBy("risk", "severity").agg(F.count("*").alias("n"))


def content_nodes(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("owner"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("statement"), F.split("p_type", " ").alias("rules"), F.when(F.col("p_partkey") % 3 > 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("tags"))
    n = CN.record_nodes(p, "policy", "title", {"Owner": "owner", "Statement": "statement"}, {"Requirements": "rules"}, tags="tags")
    return n.select("id", "label", F.md5("text").alias("text_md5"))


def summarize_documents(spark, d):
    s = CN.summarized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 150)
    return s.select(F.col("id").alias("doc_id"), F.length("summary").alias("chars"), F.md5("summary").alias("summary_md5"))


def tuner_fitness(spark, d):
    runs = table(spark, d, "events").select((F.col("user_id") % 7).alias("candidate"), F.col("event_id").alias("query_id"), (F.col("event_type") != "error").cast("int").alias("hit"), F.lit(0.9).alias("health"), (F.col("user_id") % 7 + 500).alias("tokens"), F.lit(1000).alias("baseline_tokens"))
    return TU.scored(runs).select("candidate", F.round("quality", 6).alias("quality"), F.round("efficiency", 6).alias("efficiency"), F.round("fitness", 5).alias("fitness"))


#: Questions that candidates are tried on, and how many hits of each are evidence.
QUESTIONS, EVIDENCE = {0: ["thing", "that", "est"], 1: ["worthless", "the"], 2: ["und", "der"], 3: ["los", "que", "de"]}, 20


def _tried(spark):
    """The incumbent as 0, and all combinations of eleven weights, four numbers of seeds and three budgets."""
    i, s, t = F.floor((F.col("id") - 1) / 12), F.floor((F.col("id") - 1) % 12 / 3) + 1, F.element_at(F.array(F.lit(500.0), F.lit(1000.0), F.lit(2000.0)), ((F.col("id") - 1) % 3 + 1).cast("int"))
    named = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in (("SYNAPSE_BOOST_WEIGHT", i / 5), ("SYNAPSE_SEED_K", s), ("L3_MAX_TOKENS", t))])
    default = F.array(F.struct(F.lit("SPREAD_DEPTH").alias("name"), F.lit(2.0).alias("value")))
    return spark.range(133).select(F.col("id").alias("candidate"), F.explode(F.when(F.col("id") == 0, default).otherwise(named)).alias("p")).select("candidate", "p.*")


def _sweep(spark, d):
    docs = table(spark, d, "documents")
    hits = R.bm25_many(docs, QUESTIONS, EVIDENCE)
    energy = docs.select(F.explode(F.array(*map(F.lit, QUESTIONS))).alias("query_id"), F.col("doc_id").alias("id"), (1 / (1 + F.col("n_chars") % 7)).alias("energy"))
    good = table(spark, d, "labels").where("quality = 1").select(F.explode(F.array(*map(F.lit, QUESTIONS))).alias("query_id"), F.col("doc_id").alias("id"))
    return TU.sweep(hits, energy, good, docs.select(F.col("doc_id").alias("id"), estimated_tokens(F.col("text")).alias("tokens")), _tried(spark))


def tuner_sweep(spark, d):
    """Every candidate's quality, efficiency and fitness over the same hits of documents, judged by labels."""
    return TU.scored(_sweep(spark, d)).select("candidate", F.round("quality", 6).alias("quality"), F.round("efficiency", 6).alias("efficiency"), F.round("fitness", 5).alias("fitness"))


def tuner_generation(spark, d):
    """The fittest candidate of the sweep against the incumbent."""
    return TU.generation(tuner_sweep(spark, d).select("candidate", "fitness"))


def _sweep_sql() -> str:
    def question(q: int, terms: list[str]) -> str:
        part = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5 / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(terms)))
        tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
        df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
        return f"""c{q} AS (SELECT id, len(t) AS dl, {tf} FROM tk), s{q} AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c{q}),
r{q} AS (SELECT {q} AS q, id, {part} AS raw FROM c{q}, s{q} WHERE {' + '.join(f'tf{i}' for i in range(len(terms)))} > 0 ORDER BY raw DESC, id LIMIT {EVIDENCE})"""

    return f"""tk AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), {', '.join(question(q, t) for q, t in QUESTIONS.items())},
h AS ({' UNION ALL '.join(f'SELECT q, id, raw / max(raw) OVER () AS score, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM r{q}' for q in QUESTIONS)}),
ev AS (SELECT h.*, 1.0::DOUBLE / (1 + n_chars % 7) AS energy, length(coalesce(text, '')) // 4 AS tokens, (h.id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS good FROM h JOIN documents d ON d.doc_id = h.id),
ca AS (SELECT 0 AS c, 0.3::DOUBLE AS w, 3 AS k, 1000 AS l UNION ALL SELECT i, (i - 1) // 12 / 5.0::DOUBLE, (i - 1) % 12 // 3 + 1, [500, 1000, 2000][(i - 1) % 3 + 1] FROM range(1, 133) t(i)),
pl AS (SELECT *, row_number() OVER o AS place, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS spent FROM ev, ca WINDOW o AS (PARTITION BY c, q ORDER BY round(score + CASE WHEN rank > k THEN w * energy ELSE 0 END, 9) DESC, id)),
rn AS (SELECT c, q, max(CASE WHEN place = 1 OR spent <= l THEN good ELSE 0 END) AS hit, sum(CASE WHEN place = 1 OR spent <= l THEN tokens ELSE 0 END) AS tokens, sum(tokens) AS whole FROM pl GROUP BY c, q),
sc AS (SELECT c, avg(hit) AS quality, least(10.0::DOUBLE, sum(whole) / sum(tokens)) AS efficiency FROM rn GROUP BY c),
sw AS (SELECT c AS candidate, round(quality, 6) AS quality, round(efficiency, 6) AS efficiency, CASE WHEN quality = 0 THEN 0 ELSE round(round(exp(0.5::DOUBLE * ln(quality) + 0.2::DOUBLE * ln(efficiency / 10)), 6), 5) END AS fitness FROM sc)"""


_F = (rbac_check, endpoint_coverage, type_risks, content_nodes, summarize_documents, tuner_fitness, tuner_sweep, tuner_generation)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {
    "rbac_check": """SELECT ['admin', 'reader', 'guest'][(user_id % 3 + 1)::INT] AS role, event_type AS tool, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN count(*) WHEN user_id % 3 = 1 AND event_type IN ('view', 'click') THEN count(*) ELSE 0 END AS allowed
FROM events GROUP BY user_id % 3, event_type""",
    "endpoint_coverage": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '#.*$', '') AS path FROM pages), r AS (SELECT path, max((page_id % 4 = 0 AND page_id % 5 <> 0)::INT) AS live, min((page_id % 5 = 0)::INT) AS sk, count(*) AS n FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN path ELSE path || '/../other' END AS path FROM p) GROUP BY path)
SELECT CASE WHEN live = 1 THEN 'live' WHEN sk = 1 THEN 'all_skipped' WHEN n > 0 THEN 'mocked' ELSE 'untested' END AS status, count(*) AS n, sum(coalesce(r.n, 0))::BIGINT AS refs FROM p LEFT JOIN r USING (path) GROUP BY 1""",
    "type_risks": "SELECT CASE p_partkey % 6 WHEN 0 THEN 'optional_return' WHEN 4 THEN 'optional_return' WHEN 1 THEN 'implicit_none' ELSE 'any_fallthrough' END AS risk, CASE WHEN p_partkey % 6 IN (0, 3, 4) THEN 'warn' ELSE 'info' END AS severity, count(*) AS n FROM part WHERE p_partkey % 6 <> 5 GROUP BY ALL",
    "content_nodes": """SELECT 'policy:' || substr(replace(lower(p_name), ' ', '_'), 1, 40) || '.nodate' AS id, p_name AS label, md5('Policy: ' || p_name || chr(10) || 'Owner: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Statement: ' || p_type ELSE '' END
|| chr(10) || 'Requirements:' || chr(10) || array_to_string(list_transform(string_split(p_type, ' '), lambda v: '  - ' || v), chr(10)) || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || 'Tags: ' || p_brand ELSE '' END) AS text_md5 FROM part""",
    "tuner_fitness": """WITH p AS (SELECT user_id % 7 AS candidate, avg((event_type <> 'error')::INT) AS q, least(10.0, count(*) * 1000.0 / sum(user_id % 7 + 500)) AS e FROM events GROUP BY 1)
SELECT candidate, round(q, 6) AS quality, round(e, 6) AS efficiency, round(exp(0.5 * ln(q) + 0.3 * ln(0.9) + 0.2 * ln(e / 10)), 5) AS fitness FROM p""",
    "tuner_sweep": f"WITH {_sweep_sql()} SELECT candidate::BIGINT AS candidate, quality, efficiency, fitness FROM sw",
    "tuner_generation": f"""WITH {_sweep_sql()}, b AS (SELECT candidate, fitness FROM sw ORDER BY fitness DESC, candidate LIMIT 1), i AS (SELECT fitness AS incumbent FROM sw WHERE candidate = 0)
SELECT candidate::BIGINT AS best, fitness, incumbent, CASE WHEN fitness >= incumbent + 0.05 THEN 'promote' ELSE 'hold' END AS decision FROM b, i""",
}
