"""Context assembly in layers: who the project is, its clusters, the areas of a question, and its best hits.

Hits are (query_id, id, score) with rank from 1, for any number of questions at once; nodes are (id, label,
file_type, source_file, community, text). A layer's text is cut to its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import estimated_tokens, intent, truncated
from . import nodes as N


def boost(hits: DataFrame, energy: DataFrame, factor: float = C.SYNAPSE_BOOST, seeds: int = C.SYNAPSE_SEEDS, pull: int = C.PULL_IN_MAX, least: float = C.PULL_IN_ENERGY) -> DataFrame:
    """(id, rank, score, pulled): ``lifted`` for one question, of hits (id, score) and energy (id, energy): absent ids follow the hits that stay."""
    ranked = hits.select(F.lit(0).alias("query_id"), "id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    return lifted(ranked, energy.select(F.lit(0).alias("query_id"), "id", "energy"), factor, pull, least, seeds).select("id", "rank", "score", "pulled")


def budget(queries: DataFrame) -> DataFrame:
    """queries (…, l3 tokens, deep) with total_tokens of the layers used and the reduction against reading everything."""
    layer = C.LAYER_TOKENS
    total = F.lit(layer["L0"] + layer["L1"]) + F.when(F.col("deep"), layer["L2"]).otherwise(0) + F.least(F.lit(layer["L3"]), F.col("l3"))
    return queries.withColumn("total_tokens", total.cast("long")).withColumn("reduction", C.BASELINE_TOKENS / total)


# What marks a line of tool output as worth keeping.
KEPT_LINE = r"(?i)error|fail|traceback|exception|panic|fatal|warning| passed|^===+|^---+"


def compressed(outputs: DataFrame, tail: int = 3) -> DataFrame:
    """(id, n_lines, n_kept, kept) of outputs (id, text): error and summary lines and the last ones, in order."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (x.rlike(KEPT_LINE) | (i >= F.size(lines) - tail)).alias("k")))
    kept = F.filter(marked, lambda s: s["k"])
    return outputs.select("id", F.size(lines).alias("n_lines"), F.size(kept).alias("n_kept"), F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("kept"))


def layer_identity(nodes: DataFrame, name: str, description: str = "") -> DataFrame:
    """One row (text): the project, what it is, and the size of its graph."""
    n = nodes.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("community", F.lit(-1))).alias("c"))
    head = f"## Project: {name}\n\n" + (f"{description}\n\n" if description else "")
    text = F.concat(F.lit(head), F.format_string("Knowledge Graph: %d entities, %d clusters\nType: Code repository with semantic indexing\n", "n", "c"))
    return n.select(truncated(text, C.LAYER_TOKENS["L0"]).alias("text"))


def layer_summary(nodes: DataFrame, most: int = 10) -> DataFrame:
    """One row (text): the largest clusters with the kinds and first labels of their nodes."""
    size = nodes.groupBy(F.coalesce("community", F.lit(-1)).alias("community")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(most)
    some = N.community_summary(nodes.withColumn("community", F.coalesce("community", F.lit(-1))).join(F.broadcast(size.select("community")), "community", "left_semi"), 5)
    line = F.format_string("- Cluster %d (%d entities): %s — %s", "community", "size", "type_summary", F.array_join(F.slice("labels", 1, 3), ", "))
    lines = size.join(some, "community").select((-F.col("size")).alias("minus"), "community", line.alias("line"))
    text = F.concat(F.lit("## Architecture Overview\n\n### Code Clusters\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minus", "community", "line"))), lambda s: s["line"]), "\n"), F.lit("\n"))
    return lines.agg(truncated(text, C.LAYER_TOKENS["L1"]).alias("text"))


def area_scores(hits: DataFrame, nodes: DataFrame, energy: DataFrame | None = None, most: int = 3, taken: int = 5) -> DataFrame:
    """(query_id, community, score, nth): the areas of each question by the scores of its first hits.

    ``energy`` (query_id, id, energy) of ``community_<n>`` nodes adds to an area or brings one in, but no more areas
    are taken than the hits alone have.
    """
    first = hits.where(F.col("rank") <= taken).join(nodes.select("id", "community"), "id").where("community >= 0")
    own = first.groupBy("query_id", "community").agg(F.sum("score").alias("score"))
    room = own.groupBy("query_id").agg(F.least(F.lit(most), F.count("*")).alias("room"))
    if energy is not None:
        more = energy.where(F.col("id").rlike(r"^community_-?\d+$")).select("query_id", F.regexp_extract("id", r"(-?\d+)$", 1).cast("int").alias("community"), (F.col("energy") * C.SYNAPSE_BOOST).alias("score"))
        own = own.unionByName(more).groupBy("query_id", "community").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "community")
    return own.withColumn("nth", F.row_number().over(order)).join(room, "query_id").where("nth <= room").drop("room")


def layer_areas(areas: DataFrame, nodes: DataFrame, shown: int = 7, of: int = 10) -> DataFrame:
    """(query_id, text, communities): the chosen areas (query_id, community, score, nth) with their first nodes."""
    w = Window.partitionBy("community").orderBy("id")
    wanted = areas.select("community").distinct()
    some = nodes.join(wanted, "community", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= of)
    snippet = F.substring(F.substring(F.coalesce("text", F.lit("")), 1, 200), 1, 120)
    line = F.concat(F.format_string("- %s (%s) — %s", "label", "file_type", F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/]*)$", 1)), F.when(snippet != "", F.concat(F.lit('\n  "'), snippet, F.lit('"'))).otherwise(""))
    listed = some.where(F.col("_n") <= shown).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    kinds = N.community_summary(nodes.join(wanted, "community", "left_semi"), of).select("community", "type_summary")
    part = F.concat(F.format_string("### Cluster %d (relevance: %.2f)\nContains: %s\n\n", "community", "score", "type_summary"), "lines", F.lit("\n"))
    rows = areas.join(listed, "community").join(kinds, "community").select("query_id", "nth", "community", part.alias("part"))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", "community", "part"))).alias("p"))
    text = F.concat(F.lit("## Relevant Code Areas\n\n"), F.array_join(F.transform("p", lambda s: s["part"]), "\n"))
    return each.select("query_id", truncated(text, C.LAYER_TOKENS["L2"]).alias("text"), F.transform("p", lambda s: s["community"]).alias("communities"))


def lifted(hits: DataFrame, energy: DataFrame, factor: float, pull: int, least: float, seeds: int = C.SYNAPSE_SEEDS) -> DataFrame:
    """``boost`` for many questions: (query_id, id, score, rank, lift, pulled) of hits (query_id, id, score, rank).

    The first ``seeds`` hits aren't lifted. At most ``pull`` ids that aren't hits and have enough energy (query_id, id, energy)
    take the places of the last hits; the first hit always stays.
    """
    e = energy.where(~F.col("id").startswith("community_"))
    up = F.when(F.col("rank") <= seeds, 0.0).otherwise(factor * F.coalesce("energy", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    mine = hits.select("query_id", "id", "score", "rank").join(e, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + up).alias("score"), "rank", up.alias("lift"), F.lit(False).alias("pulled"))
    mine = mine.withColumn("rank", F.row_number().over(order))
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    absent = e.where(F.col("energy") >= least).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(n, "query_id")
    by_energy = Window.partitionBy("query_id").orderBy(F.desc("energy"), "id")
    absent = absent.withColumn("nth", F.row_number().over(by_energy)).where(F.col("nth") <= F.least(F.lit(pull), F.col("n") - 1))
    taken = absent.groupBy("query_id").agg(F.count("*").alias("m"))
    stay = mine.join(n, "query_id").join(taken, "query_id", "left").where(F.col("rank") <= F.col("n") - F.coalesce("m", F.lit(0)))
    come = absent.select("query_id", "id", (factor * F.col("energy")).alias("score"), (F.lit(1_000_000) + F.col("nth")).alias("rank"), (factor * F.col("energy")).alias("lift"), F.lit(True).alias("pulled"))
    both = stay.select(*come.columns).unionByName(come)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def weighed(hits: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hits`` ranked anew after their scores are moved by the intent of each question (query_id, question)."""
    prose = F.col("file_type").isin("rationale", "document") | F.col("source_file").rlike(r"\.(md|markdown|txt|rst|org)$")
    code = ~prose & ((F.col("file_type") == "code") | (F.coalesce("source_file", F.lit("")) != ""))
    factor = F.when(F.col("intent") == "code", F.when(code, 3.0).otherwise(0.5)).when(F.col("intent") == "docs", F.when(prose, 2.0).otherwise(0.7)).otherwise(1.0)
    rows = hits.join(questions.select("query_id", intent(F.col("question")).alias("intent")), "query_id").join(nodes.select("id", "file_type", "source_file"), "id", "left")
    rows = rows.withColumn("score", F.col("score") * factor)
    order = Window.partitionBy("query_id").orderBy(*([F.when(F.col("intent") == "hybrid", F.col("rank")), F.desc("score"), "rank"]))
    return rows.withColumn("rank", F.row_number().over(order)).select(*hits.columns)


def layer_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, text, hits): the hits (query_id, id, score, rank and, if they were lifted, synapse, structural, pulled) as text."""
    has = lambda c: F.col(c) if c in hits.columns else F.lit(0.0)
    label = lambda c, name: F.when(has(c) > 0, F.format_string(f" (+%.2f {name})", has(c))).otherwise("")
    came = F.col("pulled") if "pulled" in hits.columns else F.lit("")
    mark = F.when(came == "structural", " [wired]").when(came == "synapse", " [recalled]").otherwise("")
    rows = hits.join(nodes.select("id", "label", "file_type", "source_file", "text"), "id", "left")
    snippet = F.substring(F.coalesce("text", F.lit("")), 1, 150)
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    entry = F.concat(
        F.format_string("%d. **%s**", "rank", unknown("label")), mark, F.format_string(" (score: %.2f", "score"), label("structural", "structural"), label("synapse", "synapse"),
        F.format_string(")\n   Type: %s\n   File: %s\n", unknown("file_type"), unknown("source_file")), F.when(snippet != "", F.concat(F.lit('   "'), snippet, F.lit('"\n'))).otherwise(""),
    )
    each = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda s: s["e"]).alias("e"))
    return each.select("query_id", truncated(F.concat(F.lit("## Search Results\n\n"), F.array_join("e", "\n")), C.LAYER_TOKENS["L3"]).alias("text"), F.size("e").alias("hits"))


def assembled(questions: DataFrame, identity: DataFrame, summary: DataFrame, areas: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context, l0, l1, l2, l3, total, reduction, communities, hits): the layers of each question, and their tokens."""
    rows = questions.select("query_id").crossJoin(F.broadcast(identity.select(F.col("text").alias("t0")))).crossJoin(F.broadcast(summary.select(F.col("text").alias("t1"))))  # one row each
    rows = rows.join(areas.select("query_id", F.col("text").alias("t2"), "communities"), "query_id", "left").join(hits.select("query_id", F.col("text").alias("t3"), "hits"), "query_id", "left")
    tokens = [F.coalesce(estimated_tokens(F.col(f"t{i}")), F.lit(0)) for i in range(4)]
    total = tokens[0] + tokens[1] + tokens[2] + tokens[3]
    return rows.select("query_id", F.concat_ws("\n", "t0", "t1", "t2", "t3").alias("context"), *[t.alias(f"l{i}") for i, t in enumerate(tokens)], total.alias("total"), F.coalesce(F.try_divide(F.lit(float(C.BASELINE_TOKENS)), total), F.lit(0.0)).alias("reduction"), F.coalesce("communities", F.array().cast("array<int>")).alias("communities"), F.coalesce("hits", F.lit(0)).alias("hits"))


def highlights(hits: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, text): the first hits of each question as a list."""
    rows = hits.where(F.col("rank") <= most).join(nodes.select("id", "label", "source_file"), "id", "left")
    line = F.concat(F.lit("- "), F.coalesce("label", F.col("id").cast("string")), F.when(F.coalesce("source_file", F.lit("")) != "", F.concat(F.lit(" ("), "source_file", F.lit(")"))).otherwise(""), F.format_string(" — score %.2f", "score"))
    each = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]).alias("l"))
    return each.select("query_id", F.concat(F.lit("## Hybrid Highlights\n"), F.array_join("l", "\n")).alias("text"))


def explained(hits: DataFrame, areas: DataFrame, assembled_rows: DataFrame) -> DataFrame:
    """(query_id, candidates, clusters, budget): what each question's context came from, as one record."""
    c = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "id", F.round("score", 4).alias("score")))), 1, 10).alias("candidates"))
    a = areas.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", "community", F.round("score", 4).alias("score")))).alias("clusters"))
    b = assembled_rows.select("query_id", F.struct("l0", "l1", "l2", "l3", "total", F.round("reduction", 2).alias("reduction")).alias("budget"))
    return b.join(c, "query_id", "left").join(a, "query_id", "left").select("query_id", "candidates", "clusters", "budget")


def benchmark(assembled_rows: DataFrame) -> DataFrame:
    """One row (queries, wakeup_tokens, avg_query_tokens, avg_reduction) of assembled contexts."""
    return assembled_rows.agg(F.count("*").alias("queries"), F.max(F.col("l0") + F.col("l1")).alias("wakeup_tokens"), F.round(F.avg("total"), 1).alias("avg_query_tokens"), F.round(F.avg("reduction"), 1).alias("avg_reduction"))
