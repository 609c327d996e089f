"""Text nodes from business records, and extractive summaries under a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(label: str, value: Column) -> Column:
    """``Label: value``, or null where the value is null or empty; for lines that are left out then."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def bulleted(label: str, values: Column) -> Column:
    items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("  - "), v)), "\n")
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}:\n"), items))


def record_nodes(records: DataFrame, kind: str, title: str, fields: dict[str, str], lists: dict[str, str] | None = None, date: str | None = None, tags: str | None = None) -> DataFrame:
    """(id, label, content_type, text) of records: the title line, then each field, list and the tags that a record has.

    ``fields`` and ``lists`` map a label to a column. The id is the kind, the title's first 40 characters
    and the date.
    """
    name = F.coalesce(F.col(title), F.lit(kind.capitalize()))
    parts = [F.concat(F.lit(f"{kind.capitalize()}: "), name)]
    parts += [labelled(k, F.col(c)) for k, c in fields.items()]
    parts += [bulleted(k, F.col(c)) for k, c in (lists or {}).items()]
    parts += [F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))] if tags else []
    when = F.coalesce(F.nullif(F.replace(F.col(date).cast("string"), F.lit("-"), F.lit("")), F.lit("")), F.lit("nodate")) if date else F.lit("nodate")
    slug = F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, 40)
    return records.select(F.concat(F.lit(f"{kind}:"), slug, F.lit("."), when).alias("id"), name.alias("label"), F.lit(kind).alias("content_type"), F.concat_ws("\n", *parts).alias("text"))


def summarized(texts: DataFrame, tokens: int = 500, kept: int = 3, layer: int = 0) -> DataFrame:
    """(id, summary) of texts (id, text) of at most ``tokens`` // (layer + 1) tokens of four characters, 50 at least.

    A text over its budget is cut into paragraphs, else sentences, else pieces, joined up to the budget (200 characters at
    least); the ``kept`` best by half their length and 50 for each sentence stay, each summarised one layer deeper, in
    order of score.
    """

    def pieces(text: str, size: int) -> list[str]:
        for parts in (re.split(r"\n\n+", text), re.split(r"(?<=[.!?])\s+", text), [text[k : k + size] for k in range(0, len(text), size)]):
            if len(parts) > 1:
                break
        out: list[str] = []
        for p in parts:
            if out and len(out[-1]) + len(p) + 2 <= size:
                out[-1] += f"\n\n{p}"
            else:
                out.append(p)
        return [p for p in out if p]

    def short(text: str, layer: int) -> str:
        budget = max(50, tokens // (layer + 1))
        if not text.strip() or len(text) // 4 <= budget:
            return text if text.strip() else ""
        parts = pieces(text, max(4 * budget, 200))
        if len(parts) < 2:
            return parts[0] if parts else ""
        score = lambda x: 0.5 * len(x) + 50 * max(1, sum(map(x.count, ".!?")))
        best = (short(x, layer + 1) for x in sorted(parts, key=score, reverse=True)[:kept])
        return "\n\n".join(x for x in best if x.strip())[: 4 * budget]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "summary": [short(t or "", layer) for t in b["text"]]})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, summary string")


def community_texts(nodes: DataFrame) -> DataFrame:
    """(id, text): a list of each community's nodes (community, id, label, description), to be summarised one layer down."""
    line = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("- **"), "label", F.lit("**: "), "description")).otherwise(F.concat(F.lit("- "), "label"))
    rows = nodes.where("community >= 0").groupBy(F.col("community").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda s: s["l"]).alias("lines"))
    return rows.select("id", F.concat(F.format_string("### Community %d\n\n", "id"), F.array_join("lines", "\n")).alias("text"))
