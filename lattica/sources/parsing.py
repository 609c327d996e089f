"""Parsers from files to nodes and links: markdown, SQL, proto, Python, unified diffs, routes, compliance notes.

Files are a table (path, content). Line-based formats stay in columns; Python needs its own parser,
one call a file over Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, normalized_path


def read_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(path, content) of the text files under ``root``; hidden folders left out."""
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace(F.col("path"), ".*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.where(~F.col("path").rlike(r"/\.[^/]+/")).select(rel.alias("path"), F.decode(F.col("content"), "UTF-8").alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def markdown_headings(files: DataFrame) -> DataFrame:
    """(path, id, level, title, line_no): headings outside fenced blocks."""
    per_file = Window.partitionBy("path").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = lines_of(files).withColumn("fences", F.count_if(fence).over(per_file.rowsBetween(Window.unboundedPreceding, 0)))
    heads = rows.where((F.col("fences") % 2 == 0) & ~fence & F.col("line").rlike(r"^#{1,6}\s+\S"))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    return heads.select("path", F.concat(slug(F.col("path")), F.lit("__h"), F.col("line_no").cast("string")).alias("id"), F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), title.alias("title"), "line_no")


def sql_objects(files: DataFrame) -> DataFrame:
    """(path, kind, name, line_no) of CREATE statements."""
    pattern = r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:unique\s+|temp(?:orary)?\s+|materialized\s+)*(table|view|procedure|function|index|trigger|type)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([A-Za-z_][\w.$]*)"
    rows = lines_of(files).where(F.col("line").rlike(pattern))
    return rows.select("path", F.lower(F.regexp_extract("line", pattern, 1)).alias("kind"), F.regexp_extract("line", pattern, 2).alias("name"), "line_no")


def proto_objects(files: DataFrame) -> DataFrame:
    pattern = r"^\s*(message|service|enum|rpc)\s+([A-Za-z_]\w*)"
    rows = lines_of(files).where(F.col("line").rlike(pattern))
    return rows.select("path", F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("name"), "line_no")


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """(id, path, first, last): post-image line ranges of unified diffs (id, diff); deletions and deleted files left out."""
    rows = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("pos", "line"))
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ (\S+)", 1), "^b/", ""))
    rows = rows.withColumn("path", F.last(path, ignorenulls=True).over(Window.partitionBy("id").orderBy("pos")))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    h = rows.where(F.col("line").rlike(hunk) & (F.col("path") != "/dev/null")).withColumn("first", F.regexp_extract("line", hunk, 1).cast("int"))
    n = F.when(F.regexp_extract("line", hunk, 2) == "", F.lit(1)).otherwise(F.regexp_extract("line", hunk, 2).try_cast("int"))
    return h.withColumn("n", n).where("n > 0").select("id", "path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def routes(files: DataFrame) -> DataFrame:
    """(path, method, route), distinct: routes that a web application registers."""
    pattern = r"\b(?:app|router)\.(get|post|put|patch|delete|options|head)\(\s*['\"`]([^'\"`]+)['\"`]"
    whole = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
    return whole.select("path", F.upper(F.regexp_extract("m", pattern, 1)).alias("method"), F.regexp_extract("m", pattern, 2).alias("route")).distinct()


# How control ids of compliance frameworks are written. Those of HIPAA are no part of a longer number or an IP address.
FRAMEWORKS = {"NIST-800-53": r"\b([A-Z]{2}-\d{1,2}(?:\(\d+\))?)\b", "CMMC": r"\b([A-Z]{2}\.L[123]-\d\.\d{1,2}\.\d{1,2})\b", "SOC2": r"\b(CC\d\.\d)\b", "ISO27001": r"\b(A\.\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\b", "HIPAA": r"(?<![\d.])(164\.\d{3}(?:\([a-z]\))?)(?!\.?\d)", "PCI-DSS": r"\bPCI[- ]DSS\s+(\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\b"}


def compliance_notes(files: DataFrame) -> DataFrame:
    """(path, framework, control, first): controls that a file names, with the line of the first mention."""
    found = F.array(*[F.struct(F.lit(f).alias("framework"), F.regexp_extract_all("line", F.lit(p), F.lit(1)).alias("controls")) for f, p in FRAMEWORKS.items()])
    rows = lines_of(files).select("path", "line_no", F.explode(found).alias("f")).select("path", "line_no", "f.framework", F.explode("f.controls").alias("control"))
    return rows.groupBy("path", "framework", "control").agg(F.min("line_no").alias("first"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, container, line_no, target): definitions, and what they import, inherit and call.

    Files that don't parse give one row of kind error.
    """

    def rows_of(path: str, source: str) -> list[tuple]:
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError) as e:
            return [(path, "error", type(e).__name__, "", getattr(e, "lineno", 0) or 0, "")]
        out: list[tuple] = []
        named = {t.id: n.value.value for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) for t in n.targets if isinstance(t, ast.Name)}

        def loaded(call: ast.Call) -> str | None:
            """The module that import_module or __import__ loads, if it is written down or a constant of the file."""
            arg = call.args[0] if call.args else None
            return arg.value if isinstance(arg, ast.Constant) and isinstance(arg.value, str) else named.get(arg.id) if isinstance(arg, ast.Name) else None

        def walk(node: ast.AST, owner: str) -> None:
            for child in ast.iter_child_nodes(node):
                here = owner
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    here = f"{owner}.{child.name}" if owner else child.name
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner and owner[0].isupper() else "function"
                    out.append((path, kind, here, owner, child.lineno, ""))
                    for base in getattr(child, "bases", []):
                        out.append((path, "inherits", here, owner, child.lineno, ast.unparse(base).rsplit(".", 1)[-1]))
                elif isinstance(child, ast.Import):
                    out.extend((path, "imports", owner, owner, child.lineno, a.name) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    out.append((path, "imports", owner, owner, child.lineno, "." * child.level + (child.module or "")))
                elif isinstance(child, ast.Call):
                    name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", "")
                    if name in ("import_module", "__import__"):
                        out.extend([(path, "imports", owner, owner, child.lineno, m)] if (m := loaded(child)) else [])
                    elif name:
                        out.append((path, "calls", owner, owner, child.lineno, name))
                walk(child, here)

        walk(tree, "")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for p, c in zip(b["path"], b["content"]) for r in rows_of(p, c)]
            yield pd.DataFrame(found, columns=["path", "kind", "name", "container", "line_no", "target"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, container string, line_no int, target string")


def python_types(files: DataFrame) -> DataFrame:
    """(path, name, return_type, is_optional, confidence) of Python functions: annotated (0.9), all returns constants of one type (0.7), or null (0)."""

    def told(fn: ast.AST) -> tuple[str | None, bool, float]:
        if fn.returns is not None:
            text = ast.unparse(fn.returns)
            return text, "Optional[" in text or text.endswith("| None") or text.startswith("None |"), 0.9
        returns = [n.value for n in ast.walk(fn) if isinstance(n, ast.Return)]
        kinds = {type(r.value).__name__ if isinstance(r, ast.Constant) and r.value is not None else "None" if r is None or isinstance(r, ast.Constant) else "" for r in returns}
        if not returns:
            return "None", False, 0.7
        if "" in kinds or len(kinds - {"None"}) > 1:
            return None, False, 0.0
        rest = kinds - {"None"}
        return (rest.pop() if rest else "None"), len(kinds) == 2, 0.7

    def rows_of(path: str, source: str) -> list[tuple]:
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return []
        return [(path, n.name, *told(n)) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"]) for r in rows_of(p, c)], columns=["path", "name", "return_type", "is_optional", "confidence"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, return_type string, is_optional boolean, confidence double")


def typed_calls(nodes: DataFrame, links: DataFrame, types: DataFrame) -> DataFrame:
    """(caller, callee, return_type, is_optional, confidence): call links with what their callee (by file and bare name) returns."""
    bare = F.element_at(F.split(F.regexp_replace("label", r"[()\[\]]+$", ""), r"\."), -1)
    of = nodes.select(F.col("id").alias("callee"), F.col("source_file").alias("path"), bare.alias("name"))
    one = types.groupBy("path", "name").agg(F.max_by(F.struct("return_type", "is_optional", "confidence"), "confidence").alias("t"))
    calls = links.where(F.col("relation").isin("calls", "call")).select(F.col("source").alias("caller"), F.col("target").alias("callee")).distinct()
    return calls.join(of, "callee").join(one, ["path", "name"]).select("caller", "callee", "t.return_type", "t.is_optional", "t.confidence")


# How test cases are opened, and paths in their names and bodies.
TEST_OPEN = r"\b(?:it|test)(\.skip|\.only)?\s*\(\s*(['\"`])(.*?)\2\s*,"
NAMED_PATH, WRITTEN_PATH = r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+(/[^\s'\"`]*)", r"['\"`](/[A-Za-z0-9_/:${}.*-]*)['\"`]"
SKIP_WORD = "SKIP_PG"


def test_references(files: DataFrame, real_db: str) -> DataFrame:
    """(path, name, route, skipped, real_db) of test files (path, content): the routes that each case names or calls.

    A case's body ends at its closing brace. A case is skipped by ``.skip`` or SKIP_WORD; a file with a match of the
    pattern ``real_db`` uses a real database where it isn't skipped.
    """

    def body(text: str, at: int) -> str:
        start, depth = text.find("{", at), 0
        for i in range(start, len(text)) if start >= 0 else ():
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[start : i + 1]
        return text[start:] if start >= 0 else ""

    def rows_of(path: str, text: str) -> list[tuple]:
        live, out = bool(re.search(real_db, text)), []
        for m in re.finditer(TEST_OPEN, text, re.S):
            inner = body(text, m.end())
            skipped = m[1] == ".skip" or SKIP_WORD in inner or SKIP_WORD in m[3]
            routes = sorted({*re.findall(NAMED_PATH, m[3]), *re.findall(WRITTEN_PATH, inner)})
            out += [(path, m[3], r, skipped, live and not skipped) for r in routes]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"]) for r in rows_of(p, c or "")], columns=["path", "name", "route", "skipped", "real_db"])

    found = files.select("path", "content").mapInPandas(run, "path string, name string, route string, skipped boolean, real_db boolean")
    return found.withColumn("route", normalized_path(F.col("route"))).distinct()


def python_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of Python files: files and symbols; contains, imports_from, inherits and calls resolved by name.

    A call goes to the first definition of that name (by path and line) other than the caller itself, a
    base to every class of that name, an import to the project's file of that module.
    """
    s = python_symbols(files).withColumn("file", slug(F.col("path")))
    defs = s.where(F.col("kind").isin("class", "function", "method")).withColumn("id", F.concat_ws("__", "file", slug(F.col("name")))).withColumn("bare", F.element_at(F.split("name", r"\."), -1))
    nodes = files.select(slug(F.col("path")).alias("id"), F.col("path").alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.lit(1).alias("line")).unionByName(
        defs.select("id", F.when(F.col("kind") == "class", F.col("bare")).otherwise(F.concat("bare", F.lit("()"))).alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.col("line_no").alias("line")).dropDuplicates(["id"])
    )
    owner = F.when(F.col("container") == "", F.col("file")).otherwise(F.concat_ws("__", "file", slug(F.col("container"))))
    caller = F.when(F.col("name") == "", F.col("file")).otherwise(F.concat_ws("__", "file", slug(F.col("name"))))
    link = lambda df, rel: df.select("source", "target", F.lit(rel).alias("relation"), F.col("path").alias("source_file"), F.lit(1.0).alias("confidence_score"))
    contains = link(defs.select(owner.alias("source"), F.col("id").alias("target"), "path"), "contains")
    module = files.select(F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".").alias("module"), slug(F.col("path")).alias("target"))
    imports = s.where("kind = 'imports'").select(F.col("file").alias("source"), F.col("target").alias("module"), "path").join(module, "module").where("source <> target").distinct()
    bases = s.where("kind = 'inherits'").select(caller.alias("source"), F.col("target").alias("bare"), "path").join(defs.where("kind = 'class'").select("bare", F.col("id").alias("target")), "bare").where("source <> target")
    calls = s.where("kind = 'calls'").select(caller.alias("source"), F.col("target").alias("bare"), "path").distinct()
    first = defs.withColumn("nth", F.row_number().over(Window.partitionBy("bare").orderBy("path", "line_no"))).where("nth <= 2").select("bare", F.col("id").alias("target"), "nth")
    resolved = calls.join(first, "bare").where("source <> target").groupBy("source", "bare", "path").agg(F.min_by("target", "nth").alias("target"))
    return nodes, contains.unionByName(link(imports, "imports_from")).unionByName(link(bases, "inherits")).unionByName(link(resolved, "calls"))


def document_nodes(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, path, chunk_index, chunk_count, content_text): a node for each chunk of each document."""
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.substring(F.md5(F.regexp_replace("path", r"/?[^/]+$", "")), 1, 8)
    base = F.concat(F.lit("doc:"), stem, F.lit("."), folder)
    rows = files.select("path", base.alias("base"), chunks(F.coalesce("content", F.lit("")), size, overlap).alias("c"))
    rows = rows.select("path", "base", F.size("c").alias("chunk_count"), F.posexplode("c").alias("chunk_index", "content_text"))
    return rows.select(F.when(F.col("chunk_count") > 1, F.concat("base", F.lit(":chunk"), F.col("chunk_index").cast("string"))).otherwise(F.col("base")).alias("id"), "path", "chunk_index", "chunk_count", "content_text")


def embedding_changes(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, change): added, updated or skipped, of (id, text) against stored (id, content_hash)."""
    h = nodes.select("id", F.substring(F.sha2("text", 256), 1, 16).alias("h")).join(stored, "id", "left")
    return h.select("id", F.when(F.col("content_hash").isNull(), "added").when(F.col("h") != F.col("content_hash"), "updated").otherwise("skipped").alias("change"))
