"""Resolved symbols of a SCIP index (a protobuf file), and the graph with links that they prove.

The wire format is read by field number; only the fields used here are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCCURRENCES = "path string, symbol string, definition boolean, first array<int>, span array<int>, seq int"
RELATIONS = "path string, symbol string, base string"
# Numbers of the fields of an index, and the role bit of a definition.
DOCUMENTS, PATH, OCCURRENCE, SYMBOL = 2, 1, 2, 3
RANGE, NAME, ROLES, ENCLOSING = 1, 2, 3, 7
SYMBOL_NAME, RELATIONSHIP, BASE, IMPLEMENTS = 1, 4, 1, 3
DEFINITION = 1


def number(buf: bytes, at: int) -> tuple[int, int]:
    """The variable-length number at a place, and the place after it."""
    end = at
    while buf[end] > 127:
        end += 1
    return sum((b & 127) << 7 * i for i, b in enumerate(buf[at : end + 1])), end + 1


def fields(buf: bytes) -> dict[int, list]:
    """All values of a message by field number: numbers, or bytes of whatever has a length."""
    out: dict[int, list] = {}
    at = 0
    while at < len(buf):
        tag, at = number(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = number(buf, at)
        else:
            size, at = number(buf, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = buf[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def _numbers(values: list) -> list[int]:
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = number(v, at)
            out.append(n)
    return out


def _text(values: list | None) -> str:
    return values[-1].decode("utf-8", "replace") if values else ""


def _decoded(files: DataFrame, ddl: str, rows) -> DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for data in b["content"] for d in fields(bytes(data)).get(DOCUMENTS, []) for r in rows(fields(d))], columns=names)

    return files.select("content").mapInPandas(run, ddl)


def occurrences(files: DataFrame) -> DataFrame:
    """(path, symbol, definition, first, span, seq) of index files (content bytes): where symbols stand; span is a definition's body."""

    def rows(doc: dict) -> Iterator[tuple]:
        for i, o in enumerate(map(fields, doc.get(OCCURRENCE, []))):
            place = _numbers(o.get(RANGE, []))
            yield _text(doc.get(PATH)), _text(o.get(NAME)), bool(o.get(ROLES, [0])[-1] & DEFINITION), place, _numbers(o.get(ENCLOSING, [])) or place, i

    return _decoded(files, OCCURRENCES, rows)


def implementations(files: DataFrame) -> DataFrame:
    """(path, symbol, base): symbols and what they implement."""

    def rows(doc: dict) -> Iterator[tuple]:
        for s in map(fields, doc.get(SYMBOL, [])):
            for r in map(fields, s.get(RELATIONSHIP, [])):
                if r.get(IMPLEMENTS, [0])[-1]:
                    yield _text(doc.get(PATH)), _text(s.get(SYMBOL_NAME)), _text(r.get(BASE))

    return _decoded(files, RELATIONS, rows)


def _described(symbol: Column) -> tuple[Column, Column, Column]:
    """(enclosing type or null, bare name, whether it can be called) of a symbol's descriptor."""
    token = F.element_at(F.split(F.trim(symbol), r"\s+"), -1)
    seg = F.element_at(F.split(token, "/"), -1)
    owner, member = F.regexp_extract(seg, r"^(.*)#", 1), F.regexp_extract(seg, r"#([^#]*)$", 1)
    inner = seg.contains("#") & (F.regexp_replace(member, r"[().]", "") != "")
    bare = F.when(inner, member).when(seg.contains("#"), owner).otherwise(seg)
    return F.when(inner, F.nullif(F.trim(owner, F.lit(".")), F.lit(""))), F.trim(F.regexp_replace(bare, r"[()]", ""), F.lit(".")), token.endswith("().")


def refined(nodes: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links (source, target, relation, source_file) with calls and inherits of the index's files replaced by proven ones, and (change, n).

    A symbol is the node of its file, enclosing type and name, else the first node of that name by file and id. A
    reference to something callable inside a definition's body is a call by that definition (the first by position in the index).
    """
    occ, impl = occurrences(files).where("symbol <> ''"), implementations(files)
    owner, bare, callable_ = _described(F.col("symbol"))
    occ = occ.withColumn("owner", owner).withColumn("bare", bare).withColumn("callable", callable_)
    parent = links.where("relation = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
    code = nodes.where("file_type = 'code'").join(parent, "id", "left")
    named = code.select(F.col("id").alias("parent"), F.regexp_replace("label", r"[()]+$", "").alias("type"))
    upper = parent.select(F.col("id").alias("parent"), F.lit(True).alias("nested"))
    keyed = code.join(named, "parent", "left").join(upper, "parent", "left").select(F.col("source_file").alias("path"), F.when(F.col("nested"), F.col("type")).alias("owner"), F.regexp_replace("label", r"[()]+$", "").alias("bare"), "id")
    exact = keyed.groupBy("path", "owner", "bare").agg(F.min("id").alias("exact"))
    anywhere = keyed.groupBy("bare").agg(F.min(F.struct("path", "id")).alias("m")).select("bare", F.col("m.id").alias("any"))

    def resolved(rows: DataFrame, out: str) -> DataFrame:
        e = exact.select(F.col("path").alias("_p"), F.col("owner").alias("_o"), F.col("bare").alias("_b"), "exact")
        hit = rows.join(e, (F.col("path") == F.col("_p")) & F.col("owner").eqNullSafe(F.col("_o")) & (F.col("bare") == F.col("_b")), "left")
        return hit.join(anywhere, "bare", "left").withColumn(out, F.coalesce("exact", "any")).drop("_p", "_o", "_b", "exact", "any")

    defined = resolved(occ.where("definition"), "node").where("node is not null")
    of = defined.groupBy("symbol").agg(F.min_by("node", F.struct("path", "seq")).alias("callee"))
    bodies = defined.where("callable and size(span) >= 3").select("path", F.struct(F.get("span", F.lit(0)), F.get("span", F.lit(1))).alias("lo"), F.when(F.size("span") >= 4, F.struct(F.get("span", F.lit(2)), F.get("span", F.lit(3)))).otherwise(F.struct(F.get("span", F.lit(0)), F.get("span", F.lit(2)))).alias("hi"), F.col("node").alias("caller"), F.col("seq").alias("nth"))
    refs = occ.where("not definition and callable and size(first) >= 2").join(of, "symbol").select("path", F.struct(F.get("first", F.lit(0)), F.get("first", F.lit(1))).alias("at"), "callee", "seq")
    inside = refs.join(bodies, "path").where((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))).groupBy("path", "seq", "callee").agg(F.min_by("caller", "nth").alias("caller"))
    calls = inside.where("caller <> callee").select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("relation"), F.col("path").alias("source_file"))
    b_owner, b_bare, _ = _described(F.col("base"))
    child = resolved(impl.withColumn("owner", owner).withColumn("bare", bare), "child").select("path", "base", "child")
    both = resolved(child.withColumn("owner", b_owner).withColumn("bare", b_bare), "over").where("child is not null and over is not null and child <> over")
    bases = both.select(F.col("child").alias("source"), F.col("over").alias("target"), F.lit("inherits").alias("relation"), F.col("path").alias("source_file"))
    covered = occ.select(F.col("path").alias("source_file")).union(impl.select("path")).distinct().withColumn("_covered", F.lit(True))
    guessed = F.col("relation").isin("calls", "inherits") & F.coalesce("_covered", F.lit(False))
    marked = links.select("source", "target", "relation", "source_file").join(covered, "source_file", "left")
    new = calls.unionByName(bases).groupBy("source", "target", "relation").agg(F.min("source_file").alias("source_file"))
    counts = marked.where(guessed).groupBy(F.concat("relation", F.lit("_removed")).alias("change")).agg(F.count("*").alias("n")).unionByName(new.groupBy(F.concat("relation", F.lit("_added")).alias("change")).agg(F.count("*").alias("n")))
    return marked.where(~guessed).drop("_covered").unionByName(new), counts
