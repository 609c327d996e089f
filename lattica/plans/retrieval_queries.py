"""Retrieval queries on documents, embeddings, benchmark and conversations, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import retrieval as R
from ..sources.tables import table

TERMS = ["thing", "that", "est"]
SPARSE_QUERY = "the thing that was worthless"
OVERLAP_QUERY = "the thing of that and inst"


def tokenize_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.code_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def chunk_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.chunks(F.col("text")).alias("c"))
    rows = rows.select("doc_id", F.size("c").alias("chunk_count"), F.posexplode("c").alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", "chunk_count", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chunk_len"))


def content_hash_dups(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def token_budget(spark, d):
    t = T.estimated_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("tokens"), F.when(t > 0, F.round(C.BASELINE_TOKENS / t, 6)).alias("reduction"), F.length(T.truncated(F.col("text"), C.LAYER_TOKENS["L0"])).alias("l0_chars"))


def bm25_corpus_stats(spark, d):
    _, lengths, terms = R.bm25_index(table(spark, d, "documents"))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark, d):
    return R.bm25_search(table(spark, d, "documents"), TERMS).select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"))


def splade_expand_topk(spark, d):
    w = R.sparse_expand(R.sparse_weights(table(spark, d, "documents")))
    return w.select(F.col("id").alias("doc_id"), "token", F.round("weight", 6).alias("weight"))


def splade_search(spark, d):
    return R.sparse_search(table(spark, d, "documents"), SPARSE_QUERY).select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def term_overlap_search(spark, d):
    return R.overlap_search(table(spark, d, "documents"), OVERLAP_QUERY).select(F.col("id").alias("doc_id"), "rank", "score")


def _vector(spark, d, where=None):
    v = table(spark, d, "embeddings")
    found = R.vector_search(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), 10, where)
    return found.select(F.col("id").alias("vec_id"), "rank", "score", "distance")


def vector_topk(spark, d):
    return _vector(spark, d)


def vector_topk_filtered(spark, d):
    return _vector(spark, d, F.col("label") == 3)


def _two_lists(spark, d):
    docs = table(spark, d, "documents")
    return R.bm25_search(docs, TERMS), R.overlap_search(docs, OVERLAP_QUERY)


def rrf_fuse(spark, d):
    return R.rrf_fuse(*_two_lists(spark, d)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def heuristic_rerank(spark, d):
    docs = table(spark, d, "documents")
    hits = R.bm25_search(docs, TERMS).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return R.rerank(hits, OVERLAP_QUERY, 5).select(F.col("id").alias("doc_id"), "new_rank", F.round("pair_score", 6).alias("pair_score"))


def cross_source_union(spark, d):
    docs = table(spark, d, "documents")
    lists = [R.bm25_search(docs.where(F.col("source") == s), TERMS).select("id", F.round("score", 6).alias("score")) for s in ("src0", "src1", "src2")]
    return R.best_across(*lists).withColumnRenamed("id", "doc_id")


def community_scores(spark, d):
    v = table(spark, d, "embeddings")
    hits = R.vector_search(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), 20)
    return hits.join(v.select(F.col("vec_id").alias("id"), "label"), "id").where("label >= 0").groupBy("label").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("hits"))


def query_intent(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def grep_counts(spark, d):
    return R.hits_by_count(table(spark, d, "documents"), ["thing", "idiot", "est"]).select(F.col("id").alias("doc_id"), "hits")


QUERIES = {f.__name__: f for f in (tokenize_stats, chunk_documents, content_hash_dups, token_budget, bm25_corpus_stats, bm25_search, splade_expand_topk, splade_search, term_overlap_search, vector_topk, vector_topk_filtered, rrf_fuse, heuristic_rerank, cross_source_union, community_scores, query_intent, grep_counts)}

_TOKENS = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: lower(t))"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _bm25(where: str = "true", name: str = "bm") -> str:
    tf = lambda i: f"len(list_filter(t, lambda x: x = '{TERMS[i]}'))"
    part = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5 / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3))
    return f"""{name}_t AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents WHERE {where}),
{name}_c AS (SELECT id, len(t) AS dl, {', '.join(f'{tf(i)} AS tf{i}' for i in range(3))} FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'sum((tf{i} > 0)::INT) AS df{i}' for i in range(3))} FROM {name}_c),
{name}_r AS (SELECT id, {part} AS raw FROM {name}_c, {name}_s WHERE tf0 + tf1 + tf2 > 0 ORDER BY raw DESC, id LIMIT 10),
{name} AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) AS rank, raw / max(raw) OVER () AS score, raw FROM {name}_r)"""


_OVERLAP_TERMS = "[" + ", ".join(f"'{t}'" for t in sorted(set(OVERLAP_QUERY.split()))) + "]"
_OVERLAP = rf"""ov_s AS (SELECT doc_id AS id, round(len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: list_contains({_OVERLAP_TERMS}, w)))) / len({_OVERLAP_TERMS}), 6) AS score FROM documents),
ov AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM ov_s WHERE score > 0 ORDER BY score DESC, id LIMIT 10))"""
_SPARSE = f"""t AS (SELECT doc_id AS id, unnest({_WORDS}) AS token FROM documents),
tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY token),
w AS (SELECT id, token, tf * idf AS w FROM tf JOIN idf USING (token)),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, token) AS nth FROM w),
l AS (SELECT *, sum(CASE WHEN nth <= 30 THEN w ELSE 0 END) OVER (PARTITION BY id) AS lent FROM n),
e AS (SELECT id, token, w + 0.1 * (lent - CASE WHEN nth <= 30 THEN w ELSE 0 END) AS w FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, token) AS nth FROM e QUALIFY nth <= 50),
x AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM k)"""


def _nearest(k: int, where: str = "true") -> str:
    return f"""q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE {where} ORDER BY score DESC, id LIMIT {k})"""


def _intent() -> str:
    held = lambda words: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)
    code = rf"{held(T.CODE_WORDS)} + 2 * ({held(T.CODE_SUFFIXES)}) + 3 * regexp_matches(text, '[a-zA-Z0-9_/\\]+\.[a-zA-Z]{{2,4}}\b')::INT + 3 * regexp_matches(text, '\b(def|class|function|method|func)\s+\w+')::INT"
    return f"""WITH s AS (SELECT conv_id, turn, {code} AS code, {held(T.DOC_WORDS)} AS docs FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN code > docs * 1.6 THEN 'code' WHEN docs > code * 1.6 THEN 'docs' ELSE 'hybrid' END AS intent FROM s"""


_RERANK_TERMS = "[" + ", ".join(f"'{t}'" for t in sorted(set(OVERLAP_QUERY.split()))) + "]"
ORACLES = {
    "tokenize_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "chunk_documents": """WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 450)::INT + 1 END AS n FROM documents),
x AS (SELECT doc_id, n, i, substr(text, i * 450 + 1, 500) AS chunk FROM (SELECT *, unnest(range(n)) AS i FROM c))
SELECT doc_id, i::INT AS chunk_index, n AS chunk_count, md5(chunk) AS chunk_md5, length(chunk)::INT AS chunk_len FROM x""",
    "content_hash_dups": "SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "token_budget": "SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 > 0 THEN round(50000 / (length(text) // 4), 6) END AS reduction, least(length(text), 600)::INT AS l0_chars FROM documents",
    "bm25_corpus_stats": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t GROUP BY term""",
    "bm25_search": f"WITH {_bm25()} SELECT id AS doc_id, rank::INT AS rank, round(score, 6) AS score, round(raw, 6) AS raw FROM bm",
    "splade_expand_topk": f"WITH {_SPARSE} SELECT id AS doc_id, token, round(w, 6) AS weight FROM x",
    "splade_search": f"""WITH {_SPARSE},
q0 AS (SELECT token, coalesce(idf, 1.0) AS q FROM (SELECT DISTINCT unnest(regexp_extract_all('{SPARSE_QUERY}', '[a-z0-9]+')) AS token) LEFT JOIN idf USING (token)),
q AS (SELECT token, q / sqrt(sum(q * q) OVER ()) AS q FROM q0),
s AS (SELECT d.doc_id, coalesce(sum(x.w * q.q), 0) AS score FROM documents d LEFT JOIN (x JOIN q USING (token)) ON d.doc_id = x.id GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM s""",
    "term_overlap_search": f"WITH {_OVERLAP} SELECT id AS doc_id, rank::INT AS rank, score FROM ov",
    "vector_topk": f"WITH {_nearest(10)} SELECT id AS vec_id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, score, round(1 - score, 6) AS distance FROM s",
    "vector_topk_filtered": f"WITH {_nearest(10, 'label = 3')} SELECT id AS vec_id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, score, round(1 - score, 6) AS distance FROM s",
    "rrf_fuse": f"""WITH {_bm25()}, {_OVERLAP}, u AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS p FROM bm UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM ov),
g AS (SELECT id, sum(p) AS s FROM u GROUP BY id) SELECT id AS doc_id, round(s / max(s) OVER (), 6) AS score FROM g""",
    "heuristic_rerank": f"""WITH {_bm25()}, p AS (SELECT id, rank, len(list_distinct(list_filter({_WORDS}, lambda w: list_contains({_RERANK_TERMS}, w)))) / len({_RERANK_TERMS}) AS s FROM bm JOIN documents ON id = doc_id ORDER BY s DESC, rank LIMIT 5)
SELECT id AS doc_id, row_number() OVER (ORDER BY s DESC, rank)::INT AS new_rank, round(s, 6) AS pair_score FROM p""",
    "cross_source_union": f"""WITH {', '.join(_bm25(f"source = 'src{i}'", f'bm{i}') for i in range(3))},
u AS ({' UNION ALL '.join(f'SELECT id, round(score, 6) AS score FROM bm{i}' for i in range(3))})
SELECT id AS doc_id, max(score) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20""",
    "community_scores": f"WITH {_nearest(20)} SELECT label, round(sum(score), 6) AS score, count(*) AS hits FROM s WHERE label >= 0 GROUP BY label",
    "query_intent": _intent(),
    "grep_counts": "SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: w IN ('thing', 'idiot', 'est')))::INT AS hits FROM documents WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 5",
}
