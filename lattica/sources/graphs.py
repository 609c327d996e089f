"""Property graphs and memories as JSON: readers with a tolerant edge, fixed schemas inside, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import line_number

NODE = "id string, label string, file_type string, source_file string, source_location string, community int, norm_label string"
LINK = "source string, target string, relation string, context string, confidence string, source_file string, source_location string, weight double, confidence_score double, _src string, _tgt string, kind string, label string"
GRAPH = f"nodes array<struct<{NODE.replace(' string', ':string').replace(' int', ':int')}>>, links array<struct<{LINK.replace(' string', ':string').replace(' double', ':double')}>>, edges array<struct<{LINK.replace(' string', ':string').replace(' double', ':double')}>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a graph JSON file; ``edges`` is read where there are no ``links``. The first node of an id wins."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = g.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*").where("id is not null")
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct(*nodes.columns), "pos").alias("n")).select("n.*").drop("pos")
    links = g.select(F.explode(F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("edges"))).alias("l")).select("l.*")
    return normalized_nodes(nodes), normalized_links(links)


def normalized_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with defaults, their line number and language."""
    ext = F.regexp_extract(F.coalesce("source_file", F.lit("")), r"\.([A-Za-z0-9]+)$", 1)
    names = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "md": "markdown"}
    lang = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), ext)
    kind = F.when(F.col("file_type").isin("document", "rationale"), "document").when((line_number(F.col("source_location")) <= 1) & F.col("source_file").endswith(F.col("label")), "file").when(F.col("label").endswith(")"), "function").otherwise("symbol")
    return nodes.withColumn("label", F.coalesce("label", "id")).withColumn("file_type", F.coalesce("file_type", F.lit("code"))).withColumn("community", F.coalesce("community", F.lit(-1))).withColumn("line", line_number(F.col("source_location"))).withColumn("language", lang).withColumn("kind", F.coalesce(kind, F.lit("symbol")))


def normalized_links(links: DataFrame) -> DataFrame:
    """Links with either spelling of their ends and relation, and defaults."""
    out = links.select(
        F.coalesce("source", "_src").alias("source"), F.coalesce("target", "_tgt").alias("target"), F.coalesce("relation", "kind", "label").alias("relation"), "context", "source_file",
        line_number(F.col("source_location")).alias("line"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("confidence_score", F.lit(1.0)).alias("confidence_score"),
    )
    return out.where("source is not null and target is not null")


def clusters(nodes: DataFrame) -> DataFrame:
    return nodes.where("community >= 0").groupBy("community").agg(F.count("*").alias("size"))


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines in two folders, so that a large graph is written by all tasks."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def spliced(nodes: DataFrame, links: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with everything of the ``touched`` files (source_file) replaced; links that lost an end go."""
    n = nodes.join(touched, "source_file", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    ln = links.join(touched, "source_file", "left_anti").unionByName(new_links, allowMissingColumns=True)
    ids = n.select("id").distinct()
    return n, ln.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def file_changes(cache: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified (newer and of another hash), of (path, mtime, hash) before and now."""
    j = cache.select("path", F.col("mtime").alias("m0"), F.col("hash").alias("h0")).join(disk.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when((F.col("m1") > F.col("m0")) & (F.col("h1") != F.col("h0")), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def importer_index(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, other): files and those that depend on them by calls, imports, inheritance or containment."""
    file = nodes.select(F.col("id"), F.col("source_file").alias("file"))
    kinds = F.col("relation").isin("imports", "imports_from", "calls", "inherits", "contains")
    j = links.where(kinds).join(file.select(F.col("id").alias("source"), F.col("file").alias("other")), "source").join(file.select(F.col("id").alias("target"), F.col("file").alias("node")), "target")
    return j.where("node <> other").select("node", "other").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of text files, lines counted from 0 over files by name; blocks are counted, not lines sorted."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    blocks = lines.groupBy("_f", "_s").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select(F.col("_f").alias("_bf"), F.col("_s").alias("_bs"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(blocks, (F.col("_f") == F.col("_bf")) & (F.col("_s") == F.col("_bs"))).select("value", (F.col("_before") + F.col("_m") - F.col("_first")).alias("line_no"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their line number; malformed, blank and over-long lines are left out, but counted."""
    lines = numbered_lines(spark, path)
    rows = lines.where((F.length(F.trim("value")) > 0) & (F.length("value") <= 1_000_000)).withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where("r._bad is null").select("line_no", "r.*").drop("_bad")


def export_bundle(synapses: DataFrame, namespace: str, path: str) -> None:
    """The pairs of one namespace as JSON lines."""
    synapses.where(F.col("namespace") == namespace).select(F.col("node_a").alias("source"), F.col("node_b").alias("target"), "weight", "activation_count").write.mode("overwrite").json(path)


def import_bundle(spark: SparkSession, path: str, namespace: str, now: float) -> DataFrame:
    """Rows for ``memory.import_max``."""
    rows = spark.read.schema("source string, target string, weight double, activation_count long").json(path)
    return rows.where("source is not null and target is not null").select("source", "target", F.lit(namespace).alias("namespace"), "weight", F.coalesce("activation_count", F.lit(1)).alias("activation_count"), F.lit(now).alias("ts"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
