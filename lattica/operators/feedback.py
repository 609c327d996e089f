"""What use teaches the memory: feedback, edited and deleted files, tool steps, seeds from documents, and the nightly pass.

Every function takes tables and gives tables; ``now`` is epoch seconds. Nodes are (id, label, file_type, source_file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..base import cut
from ..functions.text import domain
from . import memory, nodes as N, team

REUSE_STRENGTH, TOOL_STRENGTH, GOOD_STRENGTH, QUERY_HITS = 0.5, 0.8, 2.0, 6
LABEL_WEIGHT, COMPOUND_WEIGHT, SINGLE_WEIGHT, TAG_WEIGHT, TITLE_WEIGHT = 0.40, 0.25, 0.20, 0.20, 0.25
COMMON_SHARE, TAG_SHARE = 0.30, 0.20
#: Nodes that go out to all tasks at most.
SENT_NODES = 100_000
#: Members of a class of nodes or documents that are expanded together.
BLOCK_MEMBERS = 500
# Which stored edge type a link's relation becomes.
EDGE_TYPES = {"calls": "call", "imports_from": "import", "imports": "import", "inherits": "inherits", "implements": "implements", "uses": "uses", "references": "uses", "contains": "contains"}
# Words too common in code and prose to tie a document to a node.
COMMON_WORDS = """
server test tests py cmd core main util utils data config app model api auth db log logs read write run build key agent get set end func
fn class def return import from init setup update delete create add remove check use make new module file path name type value default
options args obj item items index count result results info err error msg code base node nodes edge edges text content method function
object string int bool none true false self other this that
""".split()


def checked_namespace(namespace: str) -> str:
    """A namespace without blanks around it; raises if it is empty or holds white space."""
    if not isinstance(namespace, str) or not namespace.strip() or any(c.isspace() for c in namespace.strip()):
        raise ValueError(f"not a namespace: {namespace!r}")
    return namespace.strip()


def resolved_namespace(override: str | None = None, pinned: str | None = None, branch: str | None = None, default_branch: str | None = None) -> str:
    """The active namespace: an override, a pinned one, ``branch:<name>`` off the default branch, or personal. Never raises."""
    for given in (override, pinned, f"branch:{branch}" if branch and branch not in ({default_branch} if default_branch else {"main", "master"}) else None):
        try:
            if given and given.strip():
                return checked_namespace(given)
        except ValueError:
            continue
    return "personal"


def namespaces(synapses: DataFrame, transitions: DataFrame) -> DataFrame:
    """(namespace): those in use that decay at the default rate."""
    return synapses.select("namespace").union(transitions.select("namespace")).distinct().where(~F.col("namespace").isin("shared", "ephemeral"))


def cleared(tables: dict[str, DataFrame], namespace: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a namespace, and (table, removed): how many rows each lost."""
    ns, counts = checked_namespace(namespace), None
    for name, t in tables.items():
        n = t.agg(F.count_if(F.col("namespace") == ns).alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return {name: t.where(F.col("namespace") != ns) for name, t in tables.items()}, counts


def emptied(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without rows."""
    return {name: t.limit(0) for name, t in tables.items()}


def structural_edges(old: DataFrame | None, links: DataFrame, now: float) -> DataFrame:
    """(caller, callee, edge_type, call_count, last_seen): ``old`` with one more call for each link of a known relation."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in EDGE_TYPES.items() for x in p]), F.col("relation"))
    score = F.coalesce("confidence_score", F.lit(1.0)) if "confidence_score" in links.columns else F.lit(1.0)
    new = links.where("source <> target and source <> '' and target <> ''").where(score >= 0).select(F.col("source").alias("caller"), F.col("target").alias("callee"), kind.alias("edge_type"), F.lit(1).cast("long").alias("call_count"), F.lit(now).alias("last_seen")).where("edge_type is not null")
    rows = new if old is None else old.select(*new.columns).unionByName(new)
    return rows.groupBy("caller", "callee", "edge_type").agg(F.sum("call_count").alias("call_count"), F.max("last_seen").alias("last_seen"))


def type_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(source_node, target_node, return_type, is_optional, confidence, inferred_by, inferred_at, seq): the last row by seq of each pair."""
    rows = new if old is None else old.select(*new.columns).unionByName(new)
    rest = [c for c in new.columns if c not in ("source_node", "target_node")]
    last = rows.groupBy("source_node", "target_node").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return last.select("source_node", "target_node", "r.*").select(*new.columns)


def import_transitions(transitions: DataFrame, rows: DataFrame, namespace: str, now: float) -> DataFrame:
    """``rows`` (from_node, to_node, weight, count) merged into a namespace by the greater weight and count."""
    ns = checked_namespace(namespace)
    new = rows.where("from_node <> '' and to_node <> '' and from_node <> to_node").select(
        "from_node", "to_node", F.lit(ns).alias("namespace"), F.greatest(F.lit(0.0), F.least(F.lit(C.TRANSITION_CAP), F.col("weight"))).alias("weight"),
        F.greatest(F.lit(0), F.col("count")).cast("long").alias("count"), F.lit(now).alias("last_activated"), F.lit(now).alias("created_at"),
    )
    both = transitions.select(*new.columns).unionByName(new)
    return both.groupBy(*memory.STEP).agg(F.max("weight").alias("weight"), F.max("count").alias("count"), F.max("last_activated").alias("last_activated"), F.min("created_at").alias("created_at"))


def decay_nodes(synapses: DataFrame, targets: DataFrame, now: float) -> DataFrame:
    """One decay tick for the pairs that touch ``targets`` (node), lasting ones kept at their floor; weak ones go."""
    t = targets.select("node").distinct()
    # counted few, they go to the pairs, so that these stay in the tasks that made them
    t = F.broadcast(t) if t.limit(SENT_NODES + 1).count() <= SENT_NODES else t
    at = synapses.join(t.select(F.col("node").alias("node_a"), F.lit(True).alias("_a")), "node_a", "left").join(t.select(F.col("node").alias("node_b"), F.lit(True).alias("_b")), "node_b", "left")
    mine = F.coalesce("_a", "_b", F.lit(False))
    w = memory.decayed(F.col("weight"), F.col("last_activated"), F.lit(C.HALF_LIFE_DAYS), now)
    w = F.when(F.col("activation_count") >= C.LTP_THRESHOLD, F.greatest(F.lit(C.LTP_FLOOR), w)).otherwise(w)
    return at.withColumn("_mine", mine).withColumn("weight", F.when(mine, w).otherwise(F.col("weight"))).where(~F.col("_mine") | (F.col("weight") >= C.PRUNE_THRESHOLD)).select(*synapses.columns)


def feedback(synapses: DataFrame, signals: DataFrame, now: float, namespace: str = "personal", tasks: int = 0) -> DataFrame:
    """The memory after ``signals`` (id, node, signal, context array of nodes).

    positive: the node and its context fire together (nothing without a context); negative: the node's pairs decay by
    one tick; other signals do nothing. Negative ones count first. ``tasks`` as for ``memory.reinforce``.
    """
    good = signals.where("signal = 'positive' and size(context) > 0").select(F.col("id").alias("batch"), F.explode(F.array_union(F.array("node"), "context")).alias("node"), F.lit(now).alias("ts"), F.lit(namespace).alias("namespace"))
    faded = decay_nodes(synapses, signals.where("signal = 'negative'").select("node"), now)
    return memory.reinforce(faded, good, tasks=tasks)


def last_query_feedback(synapses: DataFrame, hits: DataFrame, good: bool, now: float, namespace: str = "personal") -> DataFrame:
    """The memory after the last query's hits (node) were called good (twice the usual step) or bad (weights lowered)."""
    if not good:
        return memory.penalize(synapses, hits.select("node"))
    return memory.reinforce(synapses, hits.select(F.lit("last").alias("batch"), "node", F.lit(now).alias("ts"), F.lit(namespace).alias("namespace")), GOOD_STRENGTH)


def query_batches(hits: DataFrame, loaded: DataFrame, ts: Column, namespace: str = "personal") -> DataFrame:
    """(batch, node, ts, namespace) for ``memory.reinforce``: each query's first hits (query_id, rank, id) and communities loaded (query_id, community)."""
    first = hits.where(F.col("rank") <= QUERY_HITS).select("query_id", F.col("id").cast("string").alias("node"))
    areas = loaded.select("query_id", F.concat(F.lit("community_"), F.col("community").cast("string")).alias("node"))
    return first.unionByName(areas).select(F.col("query_id").alias("batch"), "node", ts.alias("ts"), F.lit(namespace).alias("namespace")).distinct()


def file_batches(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(batch, node, ts, namespace): all nodes of the files (batch, path, ts, namespace) edited together."""
    of = nodes.where("id <> ''").select(N.plain_path(F.col("source_file")).alias("_path"), F.col("id").alias("node"))
    return edits.withColumn("_path", N.plain_path(F.col("path"))).join(of, "_path").select("batch", "node", "ts", "namespace").distinct()


def activate_files(synapses: DataFrame | None, transitions: DataFrame | None, nodes: DataFrame, edits: DataFrame, strength: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Synapses and transitions after files (batch, pos, path, ts, namespace) were edited together, in the order of pos."""
    steps = memory.record_sequences(edits.select(F.col("batch").alias("seq"), "pos", F.col("path").alias("node"), "ts", "namespace"), strength)
    if transitions is not None:
        rows = transitions.select(*steps.columns).unionByName(steps)
        steps = rows.groupBy(*memory.STEP).agg(F.least(F.lit(C.TRANSITION_CAP), F.sum("weight")).alias("weight"), F.sum("count").alias("count"), F.max("last_activated").alias("last_activated"), F.min("created_at").alias("created_at"))
    batches = file_batches(nodes, edits)
    return (memory.reinforce_large(batches, strength) if synapses is None else memory.reinforce(synapses, batches, strength)), steps


def deactivate_files(synapses: DataFrame, nodes: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """The memory after ``files`` (path) were deleted: the pairs of their nodes decay by one tick."""
    return decay_nodes(synapses, N.file_nodes(nodes, files).select(F.col("id").alias("node")), now)


def edit_reuse(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit_id, reused, possible_dupes) of edits (edit_id, path, new_code): names defined in other files.

    reused: identifiers of the new code that another file defines; possible_dupes: names that the edited file
    defines and another does, too. Both sorted.
    """
    index = N.symbol_index(nodes).join(nodes.select("id", N.plain_path(F.col("source_file")).alias("file")), "id")
    e = edits.select("edit_id", N.plain_path(F.col("path")).alias("path"), "new_code")
    words = e.select("edit_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("new_code", F.lit(f"({N.IDENTIFIER})"), F.lit(1)))).alias("name"))
    reused = words.join(index, "name").where("file <> path").groupBy("edit_id").agg(F.array_sort(F.collect_set("name")).alias("reused"))
    mine = e.select("edit_id", "path").join(index.select(F.col("file").alias("path"), "name").distinct(), "path")
    dupes = mine.join(index.select("name", "file").distinct(), "name").where("file <> path").groupBy("edit_id").agg(F.array_sort(F.collect_set("name")).alias("possible_dupes"))
    none = F.array().cast("array<string>")
    return e.select("edit_id").join(reused, "edit_id", "left").join(dupes, "edit_id", "left").select("edit_id", F.coalesce("reused", none).alias("reused"), F.coalesce("possible_dupes", none).alias("possible_dupes"))


def reuse_batches(nodes: DataFrame, edits: DataFrame, now: float, namespace: str = "personal") -> DataFrame:
    """(batch, node, ts, namespace): for edits that reuse names, the edited file's nodes and the reused definitions."""
    of = nodes.select("id", N.plain_path(F.col("source_file")).alias("file"))
    index = N.symbol_index(nodes).join(of, "id")
    e = edits.select("edit_id", N.plain_path(F.col("path")).alias("path"), "new_code")
    words = e.select("edit_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("new_code", F.lit(f"({N.IDENTIFIER})"), F.lit(1)))).alias("name"))
    used = words.join(index, "name").where("file <> path").select("edit_id", F.col("id").alias("node")).distinct()
    own = e.join(used.select("edit_id").distinct(), "edit_id", "left_semi").join(of.select(F.col("file").alias("path"), F.col("id").alias("node")), "path").select("edit_id", "node")
    return used.union(own).distinct().select(F.col("edit_id").alias("batch"), "node", F.lit(now).alias("ts"), F.lit(namespace).alias("namespace"))


def tool_steps(touches: DataFrame, buckets: int = 256) -> DataFrame:
    """Transitions between consecutive files of one stream of touches (seq, path, ts, namespace), at the strength of a tool.

    The stream is cut into ranges of ``seq``; each range looks at the last touch of the one before, so it isn't
    ordered in one task.
    """
    low, high = touches.agg(F.min("seq"), F.max("seq")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    rows = touches.withColumn("_b", F.floor((F.col("seq") - F.lit(low or 0)) / width))
    last = rows.groupBy("_b").agg(F.max_by("path", "seq").alias("_last"))
    ends = last.select("_b", "_last").withColumn("_end", F.lag("_last").over(Window.orderBy("_b"))).select("_b", "_end")  # at most ``buckets`` rows
    w = Window.partitionBy("_b").orderBy("seq")
    steps = rows.withColumn("from_node", F.lag("path").over(w)).join(F.broadcast(ends), "_b").withColumn("from_node", F.coalesce("from_node", "_end")).where("from_node is not null and from_node <> path")
    return steps.groupBy("from_node", F.col("path").alias("to_node"), "namespace").agg(F.least(F.lit(C.TRANSITION_CAP), F.count("*") * C.TRANSITION_RATE * TOOL_STRENGTH).alias("weight"), F.count("*").alias("count"), F.max("ts").alias("last_activated"), F.min("ts").alias("created_at"))


def cross_domains(synapses: DataFrame) -> DataFrame:
    """(pair, n): pairs between two known domains, the names in order; shared and ephemeral pairs left out."""
    a, b = domain(F.col("node_a")), domain(F.col("node_b"))
    rows = synapses.where(~F.col("namespace").isin("shared", "ephemeral")).select(a.alias("a"), b.alias("b")).where("a <> 'unknown' and b <> 'unknown' and a <> b")
    return rows.groupBy(F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b")).alias("pair")).agg(F.count("*").alias("n"))


def at_risk(synapses: DataFrame, nodes: DataFrame, changed: DataFrame, k: int = 10, active: str = "personal") -> DataFrame:
    """(file, weight): files outside ``changed`` (path) that the memory ties to them, by their most activated node; k of twice as many nodes."""
    mine = N.file_nodes(nodes, changed)
    found = memory.spread(synapses, mine.select(F.col("id").alias("node"), F.lit(1.0).alias("energy")).distinct(), k=2 * k, active=active)
    other = found.join(nodes.select(F.col("id").alias("node"), F.col("source_file").alias("file")).where("file <> ''"), "node")
    outside = other.join(changed.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    return outside.groupBy("file").agg(F.round(F.max("energy"), 3).alias("weight")).orderBy(F.desc("weight"), "file").limit(k)


def import_team(shared: DataFrame, bundle: DataFrame, now: float, seen_hash: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Shared synapses after a team bundle (source, target, weight, activation_count), and (outcome, n); None if its hash was seen.

    A bundle has no times, so its edges and the known ones are scored as fresh. The better of two known and new scores
    stands, the new one if neither wins. What the review gate promotes is merged by the greater weight, then pairs past
    their term fade faster.
    """
    if seen_hash is not None and team.bundle_hash(bundle).first()[0] == seen_hash:
        return None
    fresh = lambda df: team.contribution(df.withColumn("last_activated", F.lit(now)), now)
    known = fresh(shared.select(F.col("node_a").alias("source"), F.col("node_b").alias("target"), "activation_count"))
    met = team.conflict_merge(known, fresh(bundle)).select("source", "target", "winner")
    new = fresh(bundle).join(known.select("source", "target", F.col("score").alias("_known"), F.col("activation_count").alias("_count")), ["source", "target"], "left").join(met, ["source", "target"])
    old = F.col("winner") == "a"
    new = new.withColumn("score", F.when(old, F.col("_known")).otherwise(F.col("score"))).withColumn("activation_count", F.when(old, F.col("_count")).otherwise(F.col("activation_count")))
    gated = team.review(new)
    promoted = gated.where("action = 'auto_promote'").select("source", "target", F.lit("shared").alias("namespace"), F.col("score").alias("weight"), "activation_count", F.lit(now).alias("ts"))
    merged = memory.import_max(shared, promoted)
    counts = gated.groupBy(F.col("action").alias("outcome")).agg(F.count("*").alias("n")).unionByName(gated.where("winner = 'contest'").agg(F.lit("contest").alias("outcome"), F.count("*").alias("n")))
    return faded(merged, now), counts.where("n > 0")


def faded(synapses: DataFrame, now: float) -> DataFrame:
    """The memory with the pairs past their namespace's term weakened faster."""
    past = (F.lit(now) - F.col("last_activated")) / C.DAY > team.stale_days(F.col("namespace"))
    return team.fast_decay(synapses.where(past)).unionByName(synapses.where(~past))


# --- seeds from business documents


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_\-./]", " "), r"\s+"), lambda w: w != "")


def components(node: Column) -> Column:
    """The parts of a node id, in order, of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(node), r"[_./\-]|::", " "), r"\s+"), lambda w: F.length(w) >= 2)


def _blocks(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(group, <member>s): members of a group in arrays of about BLOCK_MEMBERS, so that none grows with its group."""
    n = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("_n"))
    return rows.join(n, group).groupBy(group, F.pmod(F.xxhash64(member), "_n").alias("_b")).agg(F.collect_list(member).alias(f"{member}s")).drop("_b")


def _tied(terms: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes tied (asking, holding, weight), nodes (id, asking) and documents (doc, holding), of documents (doc, t) and nodes (id, kind, t): t is a word, or two neighbouring ones of kind pair.

    Nodes that ask for the same terms, of those that documents hold, are compared once, and so are documents that hold the
    same of them.
    """
    wanted, told = nodes.select("t").distinct(), terms.select("t").distinct().withColumn("_told", F.lit(True))
    of = lambda kind: F.sort_array(F.collect_set(F.when((F.col("kind") == kind) & F.col("_told"), F.col("t")))).alias(kind)
    asks = nodes.join(told, "t", "left").groupBy("id").agg(of("label"), of("pair"), of("piece"), F.count_if(F.col("kind") == "label").alias("need"))
    asks = asks.withColumn("label", F.when(F.size("label") == F.col("need"), F.col("label")).otherwise(F.array().cast("array<string>"))).where(F.size("label") + F.size("pair") + F.size("piece") > 0)
    asks = cut(asks.select("id", F.sha2(F.to_json(F.struct("label", "pair", "piece")), 256).alias("asking"), "label", "pair", "piece"))
    holds = terms.join(wanted, "t", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_set("t")).alias("held"))
    holds = cut(holds.select("doc", F.sha2(F.to_json(F.struct("held")), 256).alias("holding"), "held"))
    each = asks.groupBy("asking").agg(*[F.any_value(c).alias(c) for c in ("label", "pair", "piece")])
    each = each.withColumn("t", F.explode(F.array_union(F.array_union("label", "pair"), "piece"))).select("asking", "t", F.size("label").alias("need"), *[F.array_contains(c, F.col("t")).alias(c) for c in ("label", "pair", "piece")])
    other = holds.groupBy("holding").agg(F.any_value("held").alias("held")).select("holding", F.explode("held").alias("t"))
    weight = F.when((F.first("need") > 0) & (F.count_if("label") == F.first("need")), LABEL_WEIGHT).when(F.bool_or("pair"), COMPOUND_WEIGHT).when(F.bool_or("piece"), SINGLE_WEIGHT)
    return each.join(other, "t").groupBy("asking", "holding").agg(weight.alias("weight")).where("weight is not null"), asks, holds


def _expanded(classes: DataFrame, asks: DataFrame, holds: DataFrame) -> DataFrame:
    """(id, doc, weight), each pair once, of classes as ``_tied`` gives them, from blocks of their members."""
    dealt = memory._dealt(classes.join(_blocks(asks, "asking", "id"), "asking").join(_blocks(holds, "holding", "doc"), "holding").select("ids", "docs", "weight"))
    return dealt.select(F.explode("ids").alias("id"), "docs", "weight").select("id", F.explode("docs").alias("doc"), "weight")


def _found(documents: DataFrame, nodes: DataFrame) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame, DataFrame]:
    """What ``seed_from_documents`` ties: classes as of ``_tied``, documents by rare tag (id, tag), and pairs by titles (id, doc, weight)."""
    everything = nodes.select("id", "label").unionByName(documents.select("id", "label")).where("id <> ''")
    n_nodes = everything.agg(F.count("*").alias("n"))
    parts = everything.select("id", F.explode(F.array_distinct(components(F.col("id")))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    common = parts.crossJoin(F.broadcast(n_nodes)).where(f"k >= 2 and k / n > {COMMON_SHARE}").select("w")
    stop = cut(common.unionByName(nodes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, COMMON_WORDS))).alias("w"))).distinct())
    text = F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("label", F.lit("")), F.nullif("title", F.lit("")))
    both = F.when(F.col("after").isNotNull(), F.concat_ws(" ", "w", "after"))  # no word holds a blank
    # ids of fewer than three characters never count as words of a text; stop words are few: one in three ids holds each
    tokens = documents.where("id <> ''").select(F.col("id").alias("doc"), F.posexplode(F.filter(_words(text), lambda w: F.length(w) >= 3)).alias("pos", "w")).join(F.broadcast(stop), "w", "left_anti")
    tokens = tokens.withColumn("after", F.lead("w").over(Window.partitionBy("doc").orderBy("pos")))
    terms = cut(tokens.select("doc", F.explode(F.array_compact(F.array("w", both))).alias("t")).distinct())
    code = nodes.where("id <> ''").join(documents.select("id"), "id", "left_anti")
    labels = code.select("id", F.explode(F.array_distinct(F.filter(_words(F.coalesce("label", "id")), lambda w: F.length(w) >= 3))).alias("w")).join(F.broadcast(stop), "w", "left_anti")
    pieces = code.select("id", F.posexplode(components(F.col("id"))).alias("pos", "w")).join(F.broadcast(stop), "w", "left_anti")
    pieces = pieces.withColumn("after", F.lead("w").over(Window.partitionBy("id").orderBy("pos")))
    kinds = lambda rows, *kinds: rows.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in kinds])).alias("x")).select("id", "x.*").where("t is not null")
    asked = cut(kinds(labels, ("label", F.col("w"))).unionByName(kinds(pieces, ("piece", F.col("w")), ("pair", both))).distinct())
    docs = documents.where("id <> ''").select("id", F.lower("title").alias("title"), F.lower(text).alias("text"), "tags")
    tags = docs.select("id", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag"))
    rare = tags.groupBy("tag").agg(F.count("*").alias("k")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).where(f"k / n < {TAG_SHARE}").select("tag")
    t = tags.join(rare, "tag")
    cells = lambda c: F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " ")
    titled = docs.where("title <> ''").select(F.col("id").alias("named"), cells(F.col("title")).alias("cells")).where(F.exists("cells", lambda w: w != ""))
    titled = titled.select("named", F.size("cells").alias("n"), F.array_join("cells", " ").alias("phrase"))
    sizes = titled.agg(F.collect_set("n").alias("sizes"))
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.size("cells") - n + 1), lambda i: F.array_join(F.slice("cells", i, n), " "))
    spoken = docs.select("id", cells(F.col("text")).alias("cells")).crossJoin(F.broadcast(sizes)).select("id", "cells", F.explode("sizes").alias("n")).where("n <= size(cells)")
    spoken = spoken.select("id", F.explode(F.array_distinct(stretches(F.col("n")))).alias("phrase"))
    refers = spoken.join(titled, "phrase").where("id <> named").select(F.least("id", "named").alias("id"), F.greatest("id", "named").alias("doc")).distinct()
    shared = t.groupBy("id").agg(F.collect_set("tag").alias("tags"))
    refers = refers.join(shared, "id", "left").join(shared.select(F.col("id").alias("doc"), F.col("tags").alias("others")), "doc", "left")
    refers = refers.where(~F.coalesce(F.arrays_overlap("tags", "others"), F.lit(False))).select("id", "doc", F.lit(TITLE_WEIGHT).alias("weight"))
    return _tied(terms, asked), t, refers


def seed_from_documents(documents: DataFrame, nodes: DataFrame, now: float) -> DataFrame:
    """Shared synapses between business documents (id, label, title, text, tags) and ``nodes`` (id, label), and among documents.

    A document that holds all words of a node's label is tied to it at 0.40; else, if it holds two neighbouring
    parts of the id side by side, at 0.25; else any part, at 0.20. Parts that over 30 % of all ids hold, and
    COMMON_WORDS, don't count. Documents that share a tag of less than a fifth of them are tied at 0.20, else
    those of which one names the other's title (between word ends) at 0.25. Candidates come from an index of
    words and pairs, by classes of nodes and documents alike in them, and titles from stretches of as many words in the
    texts: no pair is built that isn't tied. Pairs of nodes and documents, of a tag, and of titles are none twice.
    """
    tied, t, refers = _found(documents, nodes)
    by_tag = memory._pairs(t.select(F.col("tag").alias("batch"), F.col("id").alias("node"))).select(F.col("node").alias("id"), F.col("other").alias("doc"))
    by_tag = memory._dealt(by_tag, "id", "doc").distinct().withColumn("weight", F.lit(TAG_WEIGHT))
    every = _expanded(*tied).unionByName(by_tag).unionByName(refers)
    return every.select(F.least("id", "doc").alias("node_a"), F.greatest("id", "doc").alias("node_b"), F.lit("shared").alias("namespace"), "weight", F.lit(1).cast("long").alias("activation_count"), F.lit(now).alias("last_activated"), F.lit(now).alias("created_at"))


def seed_counts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(weight, n, first): the pairs of ``seed_from_documents`` by weight and their smallest node_a, counted by classes.

    Nodes and documents alike in what ties them are counted and multiplied, documents of the same tags as well, so that
    their pairs, which grow with the product of both, aren't made.
    """
    (classes, asks, holds), t, refers = _found(documents, nodes)
    sized = lambda rows, by, c, n: rows.groupBy(by).agg(F.count("*").alias(n), F.min(c).alias(f"{n}_least"))
    first = F.least("x_least", "y_least").alias("first")
    tied = classes.join(sized(asks, "asking", "id", "x"), "asking").join(sized(holds, "holding", "doc", "y"), "holding").select("weight", (F.col("x") * F.col("y")).alias("n"), first)
    sets = cut(t.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")).groupBy("tags").agg(F.count("*").alias("x"), F.min("id").alias("x_least")))
    within = sets.where("x > 1").select(F.lit(TAG_WEIGHT).alias("weight"), F.expr("x * (x - 1) div 2").alias("n"), F.col("x_least").alias("first"))
    tagged = sets.withColumn("tag", F.explode("tags"))
    other = tagged.select("tag", F.col("tags").alias("others"), F.col("x").alias("y"), F.col("x_least").alias("y_least"))
    met = tagged.join(other, "tag").where("tags < others").groupBy("tags", "others").agg(*[F.any_value(c).alias(c) for c in ("x", "y", "x_least", "y_least")])
    across = met.select(F.lit(TAG_WEIGHT).alias("weight"), (F.col("x") * F.col("y")).alias("n"), first)
    named = refers.groupBy("weight").agg(F.count("*").alias("n"), F.min(F.least("id", "doc")).alias("first"))
    every = tied.unionByName(within).unionByName(across).unionByName(named)
    return every.groupBy("weight").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def sleep(synapses: DataFrame, now: float, stale_days: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """The memory after the nightly pass, and one row (pruned, promoted, bundled, stale) of what it did.

    Weak pairs that never fired again and are old go, lasting ones regain a tenth, the 500 strongest shared pairs
    make the team's bundle, and shared and live pairs past their term fade faster.
    """
    cutoff = now - stale_days * C.DAY
    redundant = (F.col("weight") < C.PRUNE_THRESHOLD) & (F.col("activation_count") <= 1) & (F.col("last_activated") < cutoff) & (F.col("created_at") < cutoff)
    lasting = (F.col("activation_count") >= C.LTP_THRESHOLD) & (F.col("weight") >= C.LTP_FLOOR) & (F.col("weight") < 1)
    after = memory.promote_lasting(synapses.where(~redundant))
    told = F.col("namespace").isin("shared", "branch:live")
    past = (F.lit(now) - F.col("last_activated")) / C.DAY > team.stale_days(F.col("namespace"))
    report = synapses.agg(
        F.count_if(redundant).alias("pruned"), F.count_if(~redundant & lasting).alias("promoted"),
        F.least(F.lit(500), F.count_if(~redundant & (F.col("namespace") == "shared"))).alias("bundled"), F.count_if(~redundant & told & past).alias("stale"),
    )
    return faded(after.where(told), now).unionByName(after.where(~told)), report
