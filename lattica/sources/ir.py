"""The index document: a canonical form of a property graph that keeps what it doesn't know, and specs and text files as nodes.

Index nodes are (id, kind, label, source_file, line, language, cluster, norm_label, confidence, raw_kind, extra), index
edges (relation, source, target, source_file, line, weight, confidence, confidence_score, context, extra, pos); extra
maps the names of unknown fields to their JSON. Large indexes are folders of JSON lines; ``read_document`` takes the
one-object form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import line_number
from .parsing import document_nodes, slug

VERSION = 1
# Fields of a graph's nodes and links that the index knows, and languages by file ending.
NODE_FIELDS = ["id", "label", "file_type", "source_file", "source_location", "community", "norm_label"]
LINK_FIELDS = ["relation", "context", "confidence", "source_file", "source_location", "weight", "source", "target", "confidence_score", "_src", "_tgt"]
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c",
    "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "md": "markdown", "sql": "sql", "proto": "protobuf", "yaml": "yaml", "yml": "yaml", "json": "json",
}
METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
MAX_COUPLED, COUPLED_SCORE = 50, 0.8
IGNORED_FOLDERS = ["node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor"]


def _field(row: str, name: str) -> Column:
    """A field of a map of JSON values, as a string."""
    raw = F.element_at(row, name)
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).when(raw != "null", raw)


def _rest(row: str, known: list[str]) -> Column:
    return F.map_filter(row, lambda k, v: ~k.isin(known))


def from_rows(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index nodes and edges of graph nodes (row) and links (row, pos), each a map of field names to JSON values."""
    f, label = lambda n: _field("row", n), F.coalesce(_field("row", "label"), _field("row", "id"))
    file = F.coalesce(f("source_file"), F.lit(""))
    language = F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)))
    line = line_number(f("source_location"))
    kind = F.when(f("file_type") == "rationale", "rationale").when(f("file_type") == "document", "document").when((line <= 1) & (F.regexp_extract(file, r"([^/]+)$", 1) == label), "file").when(label.endswith("()"), "function").otherwise("symbol")
    n = nodes.select(
        F.coalesce(f("id"), f("label"), F.lit("")).alias("id"), kind.alias("kind"), label.alias("label"), file.alias("source_file"), line.alias("line"), F.coalesce(language, F.lit("")).alias("language"),
        F.coalesce(f("community").try_cast("int"), F.lit(-1)).alias("cluster"), F.coalesce(f("norm_label"), F.lower(label)).alias("norm_label"), F.lit(1.0).alias("confidence"), F.coalesce(f("file_type"), F.lit("")).alias("raw_kind"), _rest("row", NODE_FIELDS).alias("extra"),
    )
    relation = F.coalesce(f("relation"), F.lit(""))
    e = links.select(
        relation.alias("relation"), F.coalesce(f("source"), f("_src"), F.lit("")).alias("source"), F.coalesce(f("target"), f("_tgt"), F.lit("")).alias("target"), file.alias("source_file"), line.alias("line"),
        F.coalesce(f("weight").try_cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(f("confidence"), F.lit("EXTRACTED")).alias("confidence"), F.coalesce(f("confidence_score").try_cast("double"), F.lit(1.0)).alias("confidence_score"),
        F.coalesce(f("context"), relation).alias("context"), _rest("row", LINK_FIELDS).alias("extra"), "pos",
    )
    return n, e


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Index nodes and edges of a graph written as one JSON object (``links``, or ``edges`` where there are none)."""
    rows = "array<map<string,variant>>"
    g = spark.read.schema(f"nodes {rows}, links {rows}, edges {rows}").json(path, multiLine=True)
    plain = lambda c: F.transform_values(c, lambda k, v: F.to_json(v))
    nodes = g.select(F.explode("nodes").alias("r")).select(plain(F.col("r")).alias("row"))
    links = g.select(F.posexplode(F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("edges"))).alias("pos", "r")).select(plain(F.col("r")).alias("row"), "pos")
    return from_rows(nodes, links)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(json) of graph nodes and links, the inverse of ``from_rows``: unknown fields go back where they were."""

    def merged(known: Column, extra: str) -> Column:
        text = F.to_json(known)
        more = F.array_join(F.transform(F.array_sort(F.map_entries(extra)), lambda x: F.concat(F.to_json(F.struct(x["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["key"].alias("k")))) - 6), F.lit(":"), x["value"])), ",")
        return F.when(F.size(extra) > 0, F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit(","), more, F.lit("}"))).otherwise(text)

    place = lambda c: F.concat(F.lit("L"), F.greatest(F.col(c), F.lit(0)).cast("string"))
    coarse = F.when(F.col("kind").isin("document", "rationale"), F.col("kind")).otherwise("code")
    n = nodes.select("id", merged(F.struct("label", F.coalesce(F.nullif("raw_kind", F.lit("")), coarse).alias("file_type"), "source_file", place("line").alias("source_location"), "id", F.col("cluster").alias("community"), "norm_label"), "extra").alias("json"))
    e = edges.select("pos", merged(F.struct("relation", F.coalesce(F.nullif("context", F.lit("")), F.col("relation")).alias("context"), "confidence", "source_file", place("line").alias("source_location"), "weight", "source", "target", "confidence_score"), "extra").alias("json"))
    return n, e


def write_index(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The index as JSON lines: nodes, edges and one line of metadata, each a folder."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    nodes.sparkSession.range(1).select(F.lit(VERSION).alias("ir_version")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_index`` wrote; raises if it is of another version."""
    version = spark.read.schema("ir_version int").json(f"{path}/meta").first()
    if version is None or version[0] != VERSION:
        raise ValueError(f"index version {version and version[0]}; this one reads {VERSION}")
    node = "id string, kind string, label string, source_file string, line int, language string, cluster int, norm_label string, confidence double, raw_kind string, extra map<string,string>"
    edge = "relation string, source string, target string, source_file string, line int, weight double, confidence string, confidence_score double, context string, extra map<string,string>, pos long"
    fixed = lambda df: df.withColumn("extra", F.coalesce("extra", F.create_map().cast("map<string,string>")))
    return fixed(spark.read.schema(node).json(f"{path}/nodes")), fixed(spark.read.schema(edge).json(f"{path}/edges"))


def summary(nodes: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind and, where it is known, by language."""
    both = F.array(F.struct(F.lit("kind").alias("what"), F.col("kind").alias("name")), F.when(F.col("language") != "", F.struct(F.lit("language").alias("what"), F.col("language").alias("name"))))
    return nodes.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("what", "name").agg(F.count("*").alias("n"))


def coupled(nodes: DataFrame, most: int = MAX_COUPLED) -> DataFrame:
    """``describes`` links from files of prose to the code files of their folder, at most ``most`` in all, by path.

    Files of the top folder aren't coupled, nor headings.
    """
    folder = F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)
    rows = nodes.select("id", "file_type", "source_file", folder.alias("folder")).where("folder <> ''")
    prose = rows.where("file_type = 'document' and not contains(id, '__h')").select("folder", F.col("id").alias("source"), "source_file")
    code = rows.where("file_type = 'code'").where(F.col("id") == slug(F.col("source_file"))).select("folder", F.col("id").alias("target"), F.col("source_file").alias("of"))
    # the limit holds over all: of one folder no more than it can be taken
    some = lambda df, by, key: df.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy(by, key))).where(F.col("_n") <= most).drop("_n")
    pairs = some(prose, "source_file", "source").join(some(code, "of", "target"), "folder").orderBy("source_file", "of", "source", "target").limit(most)
    return pairs.select("source", "target", F.lit("describes").alias("relation"), "source_file", F.lit(1).alias("line"), F.lit(COUPLED_SCORE).alias("confidence_score"))


def spec_nodes(files: DataFrame) -> DataFrame:
    """(path, id, label, parent) of interface specs (path, content): the file, its operations, channels and schemas.

    JSON is read as it is, YAML if its library is there. Files that don't parse or are no such spec give no row.
    """

    def parsed(text: str) -> dict | None:
        try:
            return json.loads(text)
        except ValueError:
            try:
                import yaml

                return yaml.safe_load(text)
            except Exception:  # a file of any other kind
                return None

    def rows_of(path: str, text: str) -> list[tuple]:
        spec = parsed(text or "")
        if not isinstance(spec, dict) or not {"openapi", "asyncapi", "swagger"} & set(spec):
            return []
        own = lambda x: re.sub("[^a-z0-9]+", "_", str(x).lower()).strip("_")
        table = lambda x: x if isinstance(x, dict) else {}
        file = own(path)
        out = [(path, file, str(table(spec.get("info")).get("title", path.rsplit("/", 1)[-1])), None)]
        for p, item in table(spec.get("paths")).items():
            for m in METHODS:
                if isinstance(op := table(item).get(m), dict):
                    out.append((path, f"{file}__{own(f'{m}_{p}')}", str(op.get("summary") or op.get("operationId") or f"{m.upper()} {p}"), file))
        for c, item in table(spec.get("channels")).items():
            if isinstance(item, dict):
                out.append((path, f"{file}__{own(f'channel_{c}')}", f"channel:{c}", file))
        for s in table(table(spec.get("components")).get("schemas")) or table(spec.get("definitions")):
            out.append((path, f"{file}__schema_{own(s)}", f"schema:{s}", file))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for p, c in zip(b["path"], b["content"]) for r in rows_of(p, c)]
            yield pd.DataFrame(found, columns=["path", "id", "label", "parent"])

    return files.select("path", "content").mapInPandas(run, "path string, id string, label string, parent string")


def sniffed(files: DataFrame) -> DataFrame:
    """(path, kind) of files (path, content bytes): pdf, markdown, text or unknown, by their first bytes and their characters."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    head = F.hex(F.substring("content", 1, 5))
    binary = head.startswith("7F454C46") | head.startswith("4D5A") | F.substring(head, 1, 8).isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE")
    odd = F.length(F.regexp_replace(text, r"[^\p{C}\p{Zl}\p{Zp}]|[\n\r\t]", ""))
    kind = (
        F.when(head == "255044462D", "pdf").when(binary, "unknown").when(text.isNull() | text.contains("\x00"), "unknown")
        .when((F.length(text) > 0) & (odd / F.greatest(F.length(text), F.lit(1)) > 0.3), "unknown").when(F.lower("path").rlike(r"\.(md|markdown|mkd)$"), "markdown").otherwise("text")
    )
    return files.select("path", kind.alias("kind"))


def listed(spark: SparkSession, root: str, suffixes: list[str], ignored: list[str] | None = None, depth: int = 10) -> DataFrame:
    """(path, content) of files under ``root``: hidden and ignored folders (names) and anything deeper left out."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(base)
    at = F.expr(f"instr(path, {json.dumps('/' + base.strip('/').rsplit('/', 1)[-1] + '/')})")
    rel = F.col("path").substr(at + len(base.strip("/").rsplit("/", 1)[-1]) + 2, F.length("path"))
    names = "|".join(re.escape(x) for x in (IGNORED_FOLDERS if ignored is None else ignored))
    kept = files.withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)\.[^/]+/") & (F.size(F.split("rel", "/")) <= depth + 1))
    return (kept.where(~F.col("rel").rlike(rf"(^|/)({names})/")) if names else kept).select(F.col("rel").alias("path"), "content")


def ingested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk nodes of text and markdown files (path, content bytes), and (path, error) of files that are neither."""
    kinds = files.join(sniffed(files), "path")
    fine = F.col("kind").isin("text", "markdown")
    texts = kinds.where(fine).select("path", F.col("content").cast("string").alias("content"))
    return document_nodes(texts), kinds.where(~fine).select("path", F.concat(F.lit("cannot read files of kind "), "kind").alias("error"))
