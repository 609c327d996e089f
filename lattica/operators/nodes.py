"""Access to graph nodes: text, metadata, files, rationales, skeletons, the drawn graph, and the self-probe's queries.

Nodes are (id, label, file_type, source_file, source_location, community, norm_label), links (source, target,
relation, confidence, confidence_score, pos); pos is the link's place in its document, by which ties are decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanized, line_number

MAX_RATIONALE = 160
MAX_CROSS_LINKS = 10
MAX_BLIND_SPOTS = 25
# Relations that a skeleton shows across files, and file endings of a file's own node.
CROSS_RELATIONS = ["shares_data_with", "imports_from", "implements", "uses"]
FILE_ENDINGS = [".py", ".ts", ".js", ".go", ".rs"]
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def _given(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def node_text() -> Column:
    """The text of a node by which it is searched: a line for each property it has."""
    label = F.coalesce("label", "id", F.lit("unknown"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        "\n",
        line("Entity", label),
        line("Type", F.coalesce("file_type", F.lit("unknown"))),
        line("File", _given("source_file")),
        line("Location", _given("source_location")),
        F.when(F.col("community") >= 0, line("Community", F.col("community").cast("string"))),
        F.when(F.col("norm_label") != label, line("Normalized", _given("norm_label"))),
    )


def node_metadata(nodes: DataFrame) -> DataFrame:
    """(label, file_type, source_file, community, node_id) with defaults for what is missing."""
    return nodes.select(
        F.coalesce("label", "id", F.lit("unknown")).alias("label"), F.coalesce("file_type", F.lit("unknown")).alias("file_type"),
        F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("community", F.lit(-1)).cast("int").alias("community"), F.coalesce("id", F.lit("")).alias("node_id"),
    )


def indexed(nodes: DataFrame) -> DataFrame:
    """All nodes as (id, label, content_text)."""
    return nodes.select("id", F.coalesce("label", "id").alias("label"), node_text().alias("content_text"))


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``ids`` (id); ids without a node give no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def without_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes that are left when those of ``ids`` (id) are deleted."""
    return nodes.join(ids.select("id").distinct(), "id", "left_anti")


def plain_path(path: Column) -> Column:
    """A path with forward slashes and without leading dots and slashes, as files are compared."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def file_nodes(nodes: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """The nodes of ``files`` (path), whichever slashes they are written with and whether ``root`` stands before them."""
    base = plain_path(F.lit(root.rstrip("/")))
    relative = lambda c: F.when(F.lit(bool(root)) & plain_path(c).startswith(F.concat(base, F.lit("/"))), F.substring(plain_path(c), F.length(base) + 2, F.length(c))).otherwise(plain_path(c))
    wanted = files.select(relative(F.col("path")).alias("_path")).distinct()
    return nodes.withColumn("_path", relative(F.col("source_file"))).join(wanted, "_path", "left_semi").drop("_path")


def file_links(nodes: DataFrame, links: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """The links of which either end is a node of ``files`` (path), each once."""
    ids = file_nodes(nodes, files, root).select("id").distinct()
    at = links.join(ids.withColumn("_s", F.lit(True)).withColumnRenamed("id", "source"), "source", "left").join(ids.withColumn("_t", F.lit(True)).withColumnRenamed("id", "target"), "target", "left")
    return at.where("_s or _t").select(*links.columns)


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(community, nodes, total_nodes, communities): every community's size, over all nodes."""
    n = nodes.groupBy(F.coalesce("community", F.lit(-1)).alias("community")).agg(F.count("*").alias("nodes"))
    every = n.agg(F.sum("nodes").alias("total_nodes"), F.count("*").alias("communities"))
    return n.crossJoin(F.broadcast(every))  # one row


def community_summary(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(community, node_count, type_summary, labels): the first ``most`` nodes by id of each community."""
    w = Window.partitionBy("community").orderBy("id")
    some = nodes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    types = some.groupBy("community", "file_type").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    kinds = types.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "n", "file_type"))), lambda s: F.format_string("%d %ss", s["n"], s["file_type"])), ", ").alias("type_summary"))
    labels = some.groupBy("community").agg(F.count("*").alias("node_count"), F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("label", F.col("id").cast("string")).alias("label")))), lambda s: s["label"]).alias("labels"))
    return labels.join(kinds, "community").select("community", "node_count", "type_summary", "labels")


def normalized_rationale(text: Column) -> Column:
    """One line of at most MAX_RATIONALE characters, cut at a word, without a final period."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, MAX_RATIONALE)
    short = F.when(F.length(flat) > MAX_RATIONALE, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(flat)
    return F.trim(F.rtrim(F.trim(short), F.lit(".")))


def rationales(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): the first rationale, by link order, that isn't empty of each node that a rationale node explains."""
    notes = nodes.where("file_type = 'rationale'").select(F.col("id").alias("note"), normalized_rationale(F.coalesce("label", F.lit(""))).alias("text"))
    explains = links.where("relation = 'rationale_for'").select("source", "target", "pos")
    forward = explains.join(notes, F.col("source") == F.col("note")).select(F.col("target").alias("id"), "text", "pos")
    backward = explains.join(notes.select("note"), F.col("source") == F.col("note"), "left_anti").join(notes, F.col("target") == F.col("note")).select(F.col("source").alias("id"), "text", "pos")
    return forward.unionByName(backward).where("text <> ''").groupBy("id").agg(F.min_by("text", F.struct("pos", "text")).alias("text"))


def probe_queries(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``nodes`` with query and query_source: the rationale, else the words of the label, else those of the file's name."""
    stem = humanized(F.regexp_extract(F.replace(F.coalesce("source_file", F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    label = F.nullif(humanized(F.coalesce("label", F.lit(""))), F.lit(""))
    rows = nodes.join(texts.select("id", F.col("text").alias("_why")), "id", "left")
    source = F.when(F.col("_why").isNotNull(), "rationale").when(label.isNotNull(), "label").otherwise("file")
    return rows.withColumn("query", F.coalesce("_why", label, stem)).withColumn("query_source", source).drop("_why")


def probe_sample(nodes: DataFrame, texts: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """Nodes to probe with (those with a file and a query): code if there is any, those with a rationale if they do for ``size``.

    Drawn by a seeded hash of the id, so that reruns agree; all of them if ``size`` is 0 or more than there are.
    """
    pool = probe_queries(nodes, texts).where("source_file <> '' and query <> ''")
    code, documented = F.col("file_type") == "code", F.col("query_source") == "rationale"
    n_code = pool.where(code).count()
    pool = pool.where(code) if n_code else pool
    told = pool.where(documented).count()
    if told and told >= (size if size > 0 else pool.count()):
        pool = pool.where(documented)
    return pool.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size) if size > 0 else pool


def blind_spots(samples: DataFrame, ranked: DataFrame, k: int = 10, most: int | None = MAX_BLIND_SPOTS) -> DataFrame:
    """(id, label, source_file, query, query_source): samples whose file isn't among the first k of ranked (query_id, rank, item), the first by id or all."""
    found = ranked.where(F.col("rank") <= k).select(F.col("query_id").alias("id"), F.col("item").alias("source_file")).distinct()
    out = samples.join(found, ["id", "source_file"], "left_anti").select("id", "label", "source_file", "query", "query_source")
    return out if most is None else out.orderBy("id").limit(most)


def drawn_graph(nodes: DataFrame, links: DataFrame, synapses: DataFrame, least: float = 0.05, most: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links between them, and the ``most`` strongest synapses (node_a, node_b, weight, activation_count) between them."""
    drawn = nodes.where("id <> ''").select(F.col("id"), F.coalesce("label", "id").alias("label"), F.coalesce("file_type", F.lit("unknown")).alias("file_type"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("community", F.lit(-1)).alias("community"))
    ids = drawn.select("id").distinct()
    inside = lambda df, a, b: df.join(ids.withColumnRenamed("id", a), a, "left_semi").join(ids.withColumnRenamed("id", b), b, "left_semi")
    edges = inside(links, "source", "target").select("source", "target", F.coalesce("relation", F.lit("related")).alias("relation"))
    strong = synapses.where(F.col("weight") >= least).orderBy(F.desc("weight"), "node_a", "node_b").limit(most)
    learned = inside(strong, "node_a", "node_b").select(F.col("node_a").alias("source"), F.col("node_b").alias("target"), F.round("weight", 4).alias("weight"), "activation_count")
    return drawn, edges, learned


def skeletons(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(source_file, functions, skeleton): each file's functions by line with rationales, its calls, and links to other files.

    A file's own node (location L1, or named like a file) is left out of its functions. Of the links across files the
    first MAX_CROSS_LINKS are shown.
    """
    here = nodes.where("source_file <> ''")
    ends = F.col("source_location") == "L1"
    for e in FILE_ENDINGS:
        ends = ends | F.col("label").endswith(e)
    by_file = Window.partitionBy("source_file").orderBy("id")
    own = Window.partitionBy("source_file", "_code", "_own").orderBy("id")
    marked = here.withColumn("_code", F.col("file_type") == "code").withColumn("_own", F.col("_code") & ends)
    marked = marked.withColumn("_file", F.col("_own") & (F.row_number().over(own) == 1)).withColumn("_first", F.first("community").over(by_file))
    functions = marked.where("_code and not _file")
    of = here.select("id", F.col("source_file").alias("file"), F.coalesce("label", "id").alias("label"), "file_type")
    both = links.join(of.select(F.col("id").alias("source"), F.col("file").alias("sf"), F.col("label").alias("sl"), F.col("file_type").alias("st")), "source", "left").join(of.select(F.col("id").alias("target"), F.col("file").alias("tf"), F.col("label").alias("tl"), F.col("file_type").alias("tt")), "target", "left")
    why = both.where("relation = 'rationale_for' and sf = tf")
    why = why.where("st = 'rationale' and tt = 'code'").select(F.col("target").alias("id"), "pos", F.col("sl").alias("why")).unionByName(why.where("tt = 'rationale' and st = 'code'").select(F.col("source").alias("id"), "pos", F.col("tl").alias("why")))
    why = why.where("trim(why) <> ''").groupBy("id").agg(F.substring(F.trim(F.max_by("why", "pos")), 1, 120).alias("why"))
    rows = functions.join(why, "id", "left").withColumn("_width", F.max(F.length("label")).over(Window.partitionBy("source_file")))
    place = F.rpad(F.coalesce("source_location", F.lit("L?")), 5, " ")
    line = F.when(F.col("why").isNotNull(), F.concat(place, F.lit(" "), F.rpad(F.coalesce("label", F.lit("?")), F.col("_width"), F.lit(" ")), F.lit("  — "), "why")).otherwise(F.concat(place, F.lit(" "), F.coalesce("label", F.lit("?"))))
    listed = rows.groupBy("source_file").agg(F.count("*").alias("functions"), F.transform(F.array_sort(F.collect_list(F.struct(line_number(F.col("source_location")).alias("n"), "id", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    known = functions.select("id")
    calls = both.where("relation = 'calls' and sf = tf").join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    calls = calls.groupBy(F.col("sf").alias("source_file"), "sl").agg(F.array_join(F.array_sort(F.collect_set("tl")), ", ").alias("to"))
    calls = calls.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("sl", "to"))), lambda s: F.concat(s["sl"], F.lit(" → "), s["to"])).alias("calls"))
    across = both.where(F.col("relation").isin(CROSS_RELATIONS) & ~F.col("sf").eqNullSafe(F.col("tf")))
    sides = across.where("sf is not null").select(F.col("sf").alias("source_file"), F.col("sl").alias("inside"), F.col("target").alias("outside"), "relation", "confidence", "confidence_score", "pos").unionByName(
        across.where("tf is not null").select(F.col("tf").alias("source_file"), F.col("tl").alias("inside"), F.col("source").alias("outside"), "relation", "confidence", "confidence_score", "pos")
    )
    nth = Window.partitionBy("source_file").orderBy("pos", "outside", "inside")
    sides = sides.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= MAX_CROSS_LINKS)
    sides = sides.groupBy("source_file", "inside", "outside", "relation").agg(F.min("nth").alias("nth"), F.min_by("confidence", "nth").alias("confidence"), F.min_by("confidence_score", "nth").alias("score"))
    text = F.concat("inside", F.lit(" "), "relation", F.lit(" → "), "outside", F.lit(" ("), F.concat_ws(" ", "confidence", F.when(F.col("score") > 0, F.col("score").cast("string"))), F.lit(")"))
    sides = sides.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))), lambda s: s["t"]).alias("across"))
    files = marked.groupBy("source_file").agg(F.first("_first").alias("community"))
    out = files.join(listed, "source_file", "left").join(calls, "source_file", "left").join(sides, "source_file", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))
    block = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {title}\n"), F.array_join(c, "\n")))
    head = F.format_string("# %s  (community %s, %d functions)\n\n## Functions", F.col("source_file"), F.coalesce(F.col("community").cast("string"), F.lit("?")), F.col("functions"))
    return out.select("source_file", "functions", F.concat_ws("\n", head, F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), block("Call graph (within this file)", "calls"), block("Cross-file", "across")).alias("skeleton"))


def symbol_name(label: Column) -> Column:
    """The first identifier of a label."""
    return F.regexp_extract(F.coalesce(label, F.lit("")), f"({IDENTIFIER})", 1)


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(name, id): the nodes that define a symbol of that name; rationale and document nodes define none."""
    named = nodes.where(~F.coalesce("file_type", F.lit("")).isin("rationale", "document") & (F.coalesce("id", F.lit("")) != ""))
    return named.select(symbol_name(F.col("label")).alias("name"), "id").where("name <> ''").distinct()
