"""Text and vector retrieval: BM25, sparse expansion, dense cosine, overlap, rank fusion, reranking."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..base import cut
from ..functions.text import code_tokens, word_tokens


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (id, term, tf), lengths (id, dl) and term statistics (term, df, idf)."""
    tokens = docs.select(F.col(id_col).alias("id"), code_tokens(F.col(text_col)).alias("tokens"))
    lengths = tokens.select("id", F.size("tokens").alias("dl"))
    postings = tokens.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    total = lengths.agg(F.count("*").alias("n_docs"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    return postings, lengths, terms.select("term", "df", _idf(F.col("n_docs"), F.col("df")).alias("idf"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_scores(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, raw) of every document with a query term. A term given twice counts twice.

    Term frequencies of the few query terms are taken within the row, so the only exchange is that of
    one row of corpus statistics.
    """
    terms = Counter(query)
    names = list(terms)
    tokens = docs.select(F.col(id_col).alias("id"), code_tokens(F.col(text_col)).alias("tokens"))

    def occurrences(name: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == name))

    # texts are read and cut to tokens once; what is stored is a few numbers a document
    counts = cut(tokens.select("id", F.size("tokens").alias("dl"), *[occurrences(n).alias(f"tf{i}") for i, n in enumerate(names)]))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(names))])
    raw = F.lit(0.0)
    for i, name in enumerate(names):
        tf = F.col(f"tf{i}")
        norm = tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("avgdl"))
        raw = raw + terms[name] * _idf(F.col("n"), F.col(f"df{i}")) * tf * (C.BM25_K1 + 1) / norm
    hit = sum((F.col(f"tf{i}") for i in range(len(names))), F.lit(0)) > 0
    return counts.crossJoin(F.broadcast(stats)).where(hit).select("id", raw.alias("raw"))


def bm25_many(docs: DataFrame, queries: dict[int, list[str]], k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, rank, score, raw): ``bm25_search`` for several questions in one pass over the texts.

    A document's length and its occurrences of any query term are stored once; statistics and scores read them, not texts.
    """
    terms = sorted({t for q in queries.values() for t in q})
    at = {t: i for i, t in enumerate(terms)}
    tokens = docs.select(F.col(id_col).alias("id"), code_tokens(F.col(text_col)).alias("t"))
    found = cut(tokens.select("id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("t")))

    def times(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == term))

    counts = found.select("id", "dl", *[times(t).alias(f"tf{i}") for t, i in at.items()])
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in at.values()])
    rows = counts.crossJoin(F.broadcast(stats))  # one row
    norm = C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("avgdl"))

    def raw(query: list[str]) -> Column:
        part = F.lit(0.0)
        for t, n in Counter(query).items():
            tf = F.col(f"tf{at[t]}")
            part = part + n * _idf(F.col("n"), F.col(f"df{at[t]}")) * tf * (C.BM25_K1 + 1) / (tf + norm)
        return part

    scored = rows.select("id", F.explode(F.array(*[F.struct(F.lit(q).alias("query_id"), raw(t).alias("raw")) for q, t in queries.items()])).alias("s")).select("id", "s.*").where("raw > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # the planner keeps k rows a question and task
    return best.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).select("query_id", "id", "rank", "score", "raw")


def top(scores: DataFrame, score: str, k: int, id_col: str = "id") -> DataFrame:
    """The k rows of the highest score, ties by id, with rank from 1."""
    best = scores.orderBy(F.desc(score), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def bm25_search(docs: DataFrame, query: list[str], k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, raw): score is raw over the highest raw."""
    best = top(bm25_scores(docs, query, id_col, text_col), "raw", k)
    return best.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy()))


def _token_idf(tokens: DataFrame) -> DataFrame:
    """(token, idf) of rows with token arrays (t): a document counts once for each token."""
    n = tokens.agg(F.count("*").alias("n"))
    df = tokens.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def _token_weights(tokens: DataFrame, idf: DataFrame) -> DataFrame:
    tf = tokens.select("id", F.explode("t").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    return tf.join(idf, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("weight"), "idf")


def sparse_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, weight, idf): tf idf of every token of every document."""
    tokens = docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("t"))
    return _token_weights(tokens, _token_idf(tokens))


def sparse_expand(weights: DataFrame, top_tokens: int = C.SPLADE_TOP, keep: int = C.SPLADE_KEEP, spread: float = C.SPLADE_SPREAD) -> DataFrame:
    """(id, token, weight): the strongest tokens lend a share to every other token; the best are kept, at unit length.

    In closed form a token gains ``spread`` times the sum of the top weights, its own left out.
    """
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "token")
    every = Window.partitionBy("id")
    w = weights.withColumn("nth", F.row_number().over(order)).withColumn("lent", F.sum(F.when(F.col("nth") <= top_tokens, F.col("weight")).otherwise(0.0)).over(every))
    w = w.withColumn("weight", F.col("weight") + spread * (F.col("lent") - F.when(F.col("nth") <= top_tokens, F.col("weight")).otherwise(0.0)))
    w = w.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    return w.select("id", "token", (F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(every))).alias("weight"))


def sparse_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score): cosine of expanded documents and the query's idf weights; rows without a match score 0."""
    tokens = docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("t"))
    idf = cut(_token_idf(tokens))
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    wanted = docs.sparkSession.createDataFrame([(t,) for t in terms], "token string")
    q = wanted.join(idf.where(F.col("token").isin(terms)), "token", "left").select("token", F.coalesce("idf", F.lit(1.0)).alias("q"))
    q = q.withColumn("q", F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy())))
    # a document without a token of the query scores 0 however it is expanded
    weights = _token_weights(tokens.where(F.arrays_overlap("t", F.array(*map(F.lit, terms)))) if terms else tokens.where("false"), idf)
    hits = sparse_expand(weights).join(F.broadcast(q), "token").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    rows = docs.select(F.col(id_col).alias("id")).join(hits, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top(rows, "score", k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def vector_search(vectors: DataFrame, query: DataFrame, k: int = 10, where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, rank, score, distance) of the k nearest to the one row of ``query`` (q); ``where`` filters before scoring."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.crossJoin(F.broadcast(query)).select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), F.col("q")), 6).alias("score"))
    return top(scored, "score", k).withColumn("distance", F.round(1 - F.col("score"), 6))


def overlap_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score): the share of the query's distinct lower-case terms that a document holds; 0 left out."""
    terms = sorted(set(query.lower().split()))
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), F.array(*map(F.lit, terms)))
    scored = docs.select(F.col(id_col).alias("id"), F.round(F.size(held) / max(len(terms), 1), 6).alias("score")).where("score > 0")
    return top(scored, "score", k)


def rrf_fuse(*ranked: DataFrame, k: int = C.RRF_K) -> DataFrame:
    """(id, score): reciprocal-rank fusion of lists (id, rank), over the highest sum."""
    rows = None
    for r in ranked:
        part = r.select("id", (1.0 / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("id").agg(F.sum("part").alias("score"))
    return fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy()))


def pair_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that a candidate holds."""
    q = F.array_distinct(word_tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, word_tokens(text))) / F.size(q))


def rerank(hits: DataFrame, query: str, k: int, text_col: str = "text") -> DataFrame:
    """``hits`` (id, rank, text) by pair score, ties in their former order, with new_rank."""
    scored = hits.withColumn("pair_score", pair_score(F.lit(query), F.col(text_col)))
    best = scored.orderBy(F.desc("pair_score"), "rank").limit(k)
    return best.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("pair_score"), "rank")))


def best_across(*lists: DataFrame, k: int = 20) -> DataFrame:
    """(id, score): the union of hit lists (id, score), the best score of each id, top k."""
    rows = lists[0]
    for r in lists[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def apply_intent(hits: DataFrame, intent: str) -> DataFrame:
    """Scores of ``hits`` (id, score, file_type) moved towards code or documents."""
    code = ~F.col("file_type").isin("document", "rationale")
    factor = {"code": F.when(code, 3.0).otherwise(0.5), "docs": F.when(code, 0.7).otherwise(2.0)}.get(intent, F.lit(1.0))
    return hits.withColumn("score", F.col("score") * factor)


def hits_by_count(docs: DataFrame, terms: list[str], k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits): whole-word occurrences of ``terms``, top k, as a text search tool would count."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    counted = docs.select(F.col(id_col).alias("id"), F.size(F.filter(words, lambda w: w.isin(terms))).alias("hits"))
    return counted.where("hits > 0").orderBy(F.desc("hits"), "id").limit(k)


def files_of_hits(hits: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, files, tokens) of hits (query_id, rank, id) on chunks (id, file, text): the distinct files of the first k in order, and what their chunks cost."""
    rows = hits.where(F.col("rank") <= k).join(chunks, "id").groupBy("query_id", "file").agg(F.min("rank").alias("rank"), F.sum(F.floor(F.length("text") / C.CHARS_PER_TOKEN)).alias("tokens"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda s: s["file"]).alias("files"), F.sum("tokens").alias("tokens"))


def whole_corpus(files: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold, files, tokens): what reading all files (file, text) costs for each question's gold files (query_id, file): all are found."""
    cost = files.agg(F.count("*").alias("files"), F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / C.CHARS_PER_TOKEN)).alias("tokens"))
    return gold.join(files.select("file"), "file", "left_semi").groupBy("query_id").agg(F.count("*").alias("gold")).crossJoin(F.broadcast(cost))  # one row
