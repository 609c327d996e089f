"""Summaries to look at: dashboards as tables, and text made from bounded tops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import domain
from . import feedback, memory

TOP_PAIRS, TOP_HUBS, LEAST_WEIGHT, TOP_STEPS, LEAST_SHARE = 25, 8, 0.05, 15, 0.15
# Actions that ingest documents, and languages of a dry run by file ending.
INGEST = ["ingest_document", "ingest_cmmc", "ingest_directory"]
SCANNED = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "rs": "Rust", "java": "Java", "rb": "Ruby", "php": "PHP", "c": "C", "cpp": "C++", "cs": "C#"}


def ingestion(audit: DataFrame) -> DataFrame:
    """(framework, nodes, files, last) of audit (action, timestamp, details JSON): what was ingested."""
    d = audit.where(F.col("action").isin(INGEST)).select(F.coalesce(F.get_json_object("details", "$.framework"), F.lit("unknown")).alias("framework"), F.coalesce(F.get_json_object("details", "$.node_count").try_cast("long"), F.lit(0)).alias("n"), "timestamp")
    return d.groupBy("framework").agg(F.sum("n").alias("nodes"), F.count("*").alias("files"), F.max("timestamp").alias("last"))


def communities(nodes: DataFrame, labels: int = 5) -> DataFrame:
    """(community, size, labels): every community and its first labels by id."""
    w = Window.partitionBy("community").orderBy("id")
    rows = nodes.select(F.coalesce("community", F.lit(-1)).alias("community"), "id", F.coalesce("label", "id").alias("label"))
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= labels).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda s: s["label"]).alias("labels"))
    return rows.groupBy("community").agg(F.count("*").alias("size")).join(first, "community")


def domains(synapses: DataFrame, transitions: DataFrame) -> DataFrame:
    """(domain, n) of all nodes of the memory, and their total."""
    by = memory.distinct_nodes(synapses, transitions).groupBy(domain(F.col("node")).alias("domain")).agg(F.count("*").alias("n"))
    return by.unionByName(by.agg(F.lit("total").alias("domain"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def synapse_summary(synapses: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row (edges, lasting, transitions, nodes, weight, has_data) of the whole memory."""
    e = synapses.agg(F.count("*").alias("edges"), F.count_if(F.col("activation_count") >= C.LTP_THRESHOLD).alias("lasting"), F.coalesce(F.round(F.sum("weight"), 3), F.lit(0.0)).alias("weight"))
    t = transitions.agg(F.count("*").alias("transitions"))
    n = memory.distinct_nodes(synapses, transitions.limit(0)).agg(F.count("*").alias("nodes"))
    return e.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(n)).withColumn("has_data", F.col("edges") > 0)  # one row each


def learning_status(summary: DataFrame) -> DataFrame:
    """``synapse_summary`` with status and avg_weight: dormant, warming_up, learning, partially_active or active."""
    status = F.when(F.col("edges") == 0, "dormant").when(F.col("edges") < 10, "warming_up").when(F.col("lasting") == 0, "learning").when(F.col("transitions") < 5, "partially_active").otherwise("active")
    return summary.withColumn("status", status).withColumn("avg_weight", F.round(F.coalesce(F.try_divide("weight", "edges"), F.lit(0.0)), 4))


def dashboard(synapses: DataFrame, transitions: DataFrame, audit: DataFrame, nodes: DataFrame, savings: DataFrame) -> DataFrame:
    """(section, name, value): all sections as one table; ``savings`` is the one row of ``events.savings``."""
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    s = synapse_summary(synapses, transitions)
    told = [row(s, "synapses", F.lit(c), F.col(c)) for c in ("edges", "lasting", "transitions", "nodes", "weight")]
    told += [row(savings, "savings", F.lit(c), F.col(c)) for c in ("queries", "tokens_saved", "dollars_saved")]
    told += [row(ingestion(audit), "ingestion", F.col("framework"), F.col("nodes")), row(domains(synapses, transitions), "domains", F.col("domain"), F.col("n")), row(feedback.cross_domains(synapses), "cross_domains", F.col("pair"), F.col("n")), row(communities(nodes), "communities", F.col("community"), F.col("size"))]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


def hubs(synapses: DataFrame, k: int = TOP_HUBS) -> DataFrame:
    """(node, degree): the nodes with the most partners."""
    both = synapses.select(F.col("node_a").alias("node"), F.col("node_b").alias("other")).union(synapses.select("node_b", "node_a"))
    return both.distinct().groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def memory_note(synapses: DataFrame, transitions: DataFrame, labels: DataFrame | None = None) -> str:
    """The memory as markdown: its size, the strongest pairs, hubs and steps (bounded tops only), by ``labels`` (id, label) where known."""
    s = synapse_summary(synapses, transitions).first()
    pairs = memory.top_pairs(synapses, TOP_PAIRS, LEAST_WEIGHT).collect()
    top = hubs(synapses).collect()
    steps = memory.top_transition_groups(transitions, TOP_STEPS, LEAST_SHARE).collect()
    ids = {x for r in pairs for x in (r["node_a"], r["node_b"])} | {r["node"] for r in top} | {x for r in steps for x in (r["from_node"], r["to_node"])}
    names = {r["id"]: r["label"] for r in labels.where(F.col("id").isin(list(ids))).select("id", "label").collect()} if labels is not None and ids else {}
    show = lambda i: f"`{names[i]}` ({i})" if i in names and names[i] != i else f"`{i}`"
    out = ["# Synapse Memory", "", f"- Edges learned: {s['edges']} ({s['lasting']} long-term)", f"- Total synapse weight: {s['weight']:.2f}", f"- Active nodes: {s['nodes']}", f"- Directional transitions: {s['transitions']}", "", "## Strongest associations", ""]
    out += [f"- {show(r['node_a'])} ↔ {show(r['node_b'])} — weight {r['weight']:.2f}, fired {r['activation_count']}×" + (" *(long-term)*" if r["activation_count"] >= C.LTP_THRESHOLD else "") for r in pairs] or ["_(none yet)_"]
    if top:
        out += ["", "## Hub nodes (most connected)", "", *(f"- {show(r['node'])} — {r['degree']} connections" for r in top)]
    if steps:
        out += ["", "## What typically comes next", ""]
        for a in sorted({r["from_node"] for r in steps}, key=lambda a: (-max(r["weight"] for r in steps if r["from_node"] == a), a)):
            out += [f"- After {show(a)}:", *(f"  - {r['probability'] * 100:.0f}% → {show(r['to_node'])}" for r in sorted(steps, key=lambda r: (-r["probability"], r["to_node"])) if r["from_node"] == a)]
    return "\n".join([*out, ""])


def controls_report(rows: DataFrame, title: str) -> DataFrame:
    """(framework, html): a section a framework of control rows (control_id, framework, code_label, source_file), escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = F.concat(F.lit("<tr><td>"), safe(F.col("control_id")), F.lit("</td><td>"), safe(F.col("code_label")), F.lit("</td><td>"), safe(F.col("source_file")), F.lit("</td></tr>"))
    each = rows.groupBy("framework").agg(F.array_sort(F.collect_list(F.struct("control_id", "source_file", line.alias("line")))).alias("l"))
    return each.select("framework", F.concat(F.lit(f"<h1>{title}</h1><h2>"), safe(F.col("framework")), F.lit("</h2><table>"), F.array_join(F.transform("l", lambda s: s["line"]), ""), F.lit("</table>")).alias("html"))


def dry_run(files: DataFrame) -> DataFrame:
    """(language, files, lines, est_full_tokens, est_query_tokens, est_reduction) of files (path, content), and all of them as null."""
    names = F.create_map(*[F.lit(x) for p in SCANNED.items() for x in p])
    rows = files.select(F.element_at(names, F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).alias("language"), (F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 1).otherwise(0)).alias("lines")).where("language is not null")
    n = rows.rollup("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    full = F.greatest(F.col("lines") * 25, F.col("files") * 400)
    query = F.least(F.lit(2400), F.greatest(F.lit(600), F.col("files") * 20))
    return n.select("language", "files", "lines", full.alias("est_full_tokens"), query.alias("est_query_tokens"), F.round(full / query, 1).alias("est_reduction"))


def outlier_lines(found: DataFrame) -> DataFrame:
    """(line): findings (node, associate, peers, size) as sentences, the strongest first."""
    share = F.col("peers") / F.col("size")
    text = F.format_string("- `%s` skips `%s`, which %d of its %d peers (%d%%) use.", "node", "associate", "peers", F.col("size") - 1, F.round(share * 100).cast("int"))
    return found.select(share.alias("s"), "node", "associate", text.alias("line")).orderBy(F.desc("s"), "node", "associate").select("line")
