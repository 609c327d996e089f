"""Access, publishing, pricing and interface coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_path, optional_type


def allowed(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """requests (role, tool, …) with allowed: the policy (role, tool) names the tool, or ``*``, for the role."""
    p = policy.select("role", F.col("tool").alias("_tool")).distinct()
    every = p.where("_tool = '*'").select("role", F.lit(True).alias("_all"))
    named = p.where("_tool <> '*'").select("role", F.col("_tool").alias("tool"), F.lit(True).alias("_one"))
    out = requests.join(every, "role", "left").join(named, ["role", "tool"], "left")
    return out.withColumn("allowed", F.coalesce("_all", "_one", F.lit(False))).drop("_all", "_one")


def reachable_projects(clients: DataFrame, shared: DataFrame) -> DataFrame:
    """(client, project): a client's own project, the shared namespace, and projects shared with it (client, project)."""
    own = clients.select("client", "project")
    return own.unionByName(clients.select("client", F.lit("shared").alias("project"))).unionByName(shared.join(clients.select("client"), "client", "left_semi").select("client", "project")).distinct()


def price(tier: Column, seats: Column, months: Column, table: dict[tuple[str, int], float]) -> Column:
    """Seats times the price of the tier and term; null for terms that aren't sold."""
    out = F.when(F.lit(False), 0.0)
    for (name, term), value in table.items():
        out = out.when((tier == name) & (months == term), value * seats)
    return out


def endpoint_coverage(endpoints: DataFrame, refs: DataFrame) -> DataFrame:
    """endpoints (method, path) with status, by the test references (path, real_db, skipped) of the same normalised path.

    live: one that uses a real database and isn't skipped; all_skipped: only skipped ones; untested: none.
    """
    e = endpoints.withColumn("_p", normalized_path(F.col("path")))
    r = refs.groupBy(normalized_path(F.col("path")).alias("_p")).agg(F.max(F.col("real_db") & ~F.col("skipped")).alias("_live"), F.min("skipped").alias("_skipped"), F.count("*").alias("refs"))
    status = F.when(F.col("_live"), "live").when(F.col("_skipped"), "all_skipped").when(F.col("refs") > 0, "mocked").otherwise("untested")
    return e.join(r, "_p", "left").withColumn("status", status).withColumn("refs", F.coalesce("refs", F.lit(0))).drop("_p", "_live", "_skipped")


def type_risks(calls: DataFrame) -> DataFrame:
    """calls (caller, callee, return_type, confidence) with risk and severity; calls without a risk are left out."""
    t = F.col("return_type")
    risk = F.when(optional_type(t), "optional_return").when(t == "None", "implicit_none").when(t.isNull() & (F.col("confidence") == 0), "any_fallthrough").when(t == "any", "any_fallthrough")
    severity = F.when(optional_type(t) | (t == "any"), "warn").otherwise("info")
    return calls.withColumn("risk", risk).withColumn("severity", severity).where("risk is not null")


def control_key(control: Column, framework: Column) -> Column:
    """The node id of a control of a framework."""
    return F.concat(F.lit("compliance:"), F.upper(F.replace(framework, F.lit(" "), F.lit("_"))), F.lit(":"), F.upper(control))


def ci_check(notes: DataFrame, framework: str = "all") -> DataFrame:
    """(control, files, warning) of notes (path, framework, control) in changed files: what a change may touch."""
    rows = notes if framework == "all" else notes.where(F.upper("framework").startswith(framework.upper()))
    each = rows.select("control", "path").distinct().groupBy("control").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return each.select("control", F.size("paths").cast("long").alias("files"), F.format_string("The change touches %s (%s). Verify compliance controls are maintained.", F.array_join("paths", ", "), "control").alias("warning"))


def control_rows(nodes: DataFrame, notes: DataFrame, synapses: DataFrame) -> DataFrame:
    """(control_id, framework, code_node_id, code_label, source_file, node_type): controls and the code that says or has learned to keep them.

    ``notes`` is (id, framework, control); synapses with a ``compliance:<framework>:<control>`` end count as well. One row a control and node.
    """
    both = synapses.select(F.col("node_a").alias("key"), F.col("node_b").alias("id")).unionByName(synapses.select(F.col("node_b").alias("key"), F.col("node_a").alias("id")))
    learned = both.where("key like 'compliance:%:%'").select("id", F.split("key", ":", 3)[1].alias("framework"), F.split("key", ":", 3)[2].alias("control"))
    rows = notes.select("id", "framework", "control", F.lit(0).alias("late")).unionByName(learned.withColumn("late", F.lit(1)))
    one = rows.groupBy("control", "id").agg(F.min_by("framework", F.struct("late", "framework")).alias("framework"))
    return one.join(nodes.select("id", "label", "source_file", "file_type"), "id", "left").select(F.col("control").alias("control_id"), "framework", F.col("id").alias("code_node_id"), F.coalesce("label", F.lit("")).alias("code_label"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("file_type", F.lit("")).alias("node_type"))


def published(edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges heavy enough to be shared, and the rest."""
    return edges.where(F.col("weight") >= threshold), edges.where(F.coalesce(F.col("weight"), F.lit(0.0)) < threshold)
