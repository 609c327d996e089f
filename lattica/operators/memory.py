"""The co-activation memory as tables: pairs that fire together, transitions, decay, merged reads, spreading.

Tables: synapses (node_a < node_b, namespace, weight, activation_count, last_activated, created_at),
transitions (from_node, to_node, namespace, weight, count, last_activated, created_at). Times are
epoch seconds; every operator that needs the present takes ``now``. Updates are folds: the old table
and the new rows are united and aggregated by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..base import cut

PAIR = ["node_a", "node_b", "namespace"]
STEP = ["from_node", "to_node", "namespace"]


#: Nodes of a block, into which a larger batch is dealt, tasks that batches are dealt to at least, and nodes and pairs of a task.
BLOCK_NODES, PAIR_TASKS, TASK_PAIRS = 1_000, 128, 500_000
#: Kinds of nodes, by what they fire in, of which all pairs are sent to tasks.
FEW_KINDS = 100


def pair_tasks(nodes: DataFrame) -> int:
    """To how many tasks ``nodes`` (batch, …) and their pairs are dealt, so that a task's share doesn't grow with them."""
    n = _dealt(nodes.select("batch"), "batch").groupBy("batch").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    return max(PAIR_TASKS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((n or 0) // TASK_PAIRS) + 1)


def _dealt(rows: DataFrame, *by: str, tasks: int = 0) -> DataFrame:
    """``rows`` in a given number of partitions: small ones put together would grow again, as a row makes many pairs."""
    return rows.repartition(tasks or max(PAIR_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def _pairs(nodes: DataFrame, spread: bool = True, tasks: int = 0) -> DataFrame:
    """Distinct rows of ``nodes`` (batch, node, …) with other: every greater node of the same batch.

    A batch is one group; one larger than BLOCK_NODES is cut into blocks by hash, and each block meets each in a group, so
    that the square of its size isn't one task's. Without ``spread``, for batches known to be small, groups stay where
    their batch is, which saves an exchange; rows are the same.
    """
    names = [c for c in nodes.columns if c != "batch"]
    own = _dealt(nodes.where("batch is not null and node is not null"), "batch", tasks=tasks)
    groups = own.groupBy("batch").agg(F.collect_set(F.struct(*names)).alias("_all"))
    groups = groups.withColumn("_n", F.ceil(F.size("_all") / BLOCK_NODES).cast("int"))
    for k in ("_i", "_j"):
        groups = groups.withColumn(k, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    of = lambda k: F.when(F.col("_n") == 1, F.col("_all")).otherwise(F.filter("_all", lambda x: F.pmod(F.xxhash64(x["node"]), F.col("_n")) == F.col(k)))
    groups = groups.select("batch", "_i", "_j", of("_i").alias("_mine"), F.transform(of("_j"), lambda x: x["node"]).alias("_others"))
    groups = _dealt(groups, "batch", "_i", "_j", tasks=tasks) if spread else groups
    mine = groups.select("batch", "_others", F.inline("_mine"))
    return mine.select(*nodes.columns, F.explode(F.filter("_others", lambda y: y > F.col("node"))).alias("other"))


def reinforce(old: DataFrame | None, batches: DataFrame, strength: float = 1.0, spread: bool = True, tasks: int = 0) -> DataFrame:
    """``old`` synapses with every pair of distinct nodes of each batch (batch, node, ts, namespace) strengthened.

    k activations without a decay between fold to min(cap, weight + k times the step). ``spread`` as for ``_pairs``.
    ``tasks`` is what ``pair_tasks`` counts of the batches, if it has been asked already; with ``old``, of what has made
    that, too: both are folded in as many tasks. Without it, ``old`` goes by the planner.
    """
    told, tasks = tasks, tasks or pair_tasks(batches)
    step = C.LEARNING_RATE * min(max(strength, 0.0), 2.0)
    pairs = _pairs(batches.select("batch", "node", "ts", "namespace"), spread, tasks)
    # by the nodes alone, so that sums over namespaces need no exchange
    pairs = _dealt(pairs.select(F.col("node").alias("node_a"), F.col("other").alias("node_b"), "namespace", "ts"), "node_a", "node_b", tasks=tasks)
    fired = pairs.groupBy(*PAIR).agg(
        F.count("*").alias("activation_count"), F.max("ts").alias("last_activated"), F.min("ts").alias("created_at")
    ).withColumn("weight", F.col("activation_count") * step)
    rows = fired if old is None else old.select(*fired.columns).unionByName(fired)
    if old is not None:
        rows = _dealt(rows, "node_a", "node_b", tasks=told) if told else rows
        rows = rows.groupBy(*PAIR).agg(F.sum("activation_count").alias("activation_count"), F.max("last_activated").alias("last_activated"), F.min("created_at").alias("created_at"), F.sum("weight").alias("weight"))
    return rows.select(*PAIR, F.least(F.lit(C.WEIGHT_CAP), F.col("weight")).alias("weight"), "activation_count", "last_activated", "created_at")


def reinforce_large(batches: DataFrame, strength: float = 1.0) -> DataFrame:
    """``reinforce`` without old synapses, for few batches of very many nodes: no pair is moved.

    Nodes are dealt to blocks by hash, those of all batches alike, and each block meets each in a group, which so has all that
    a pair is fired by. A node's row goes to as many groups as there are blocks.
    """
    step = C.LEARNING_RATE * min(max(strength, 0.0), 2.0)
    own = batches.where("batch is not null and node is not null").select("batch", "node", "ts", "namespace").distinct()
    own = cut(own.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("batch", "ts", "namespace"))).alias("fires")))

    def folded(a: Column, b: Column) -> Column:
        """What nodes that fire so give as a pair, by namespace; a is the lesser node's."""
        both = F.flatten(F.transform(a, lambda f: F.transform(F.filter(b, lambda g: g["batch"] == f["batch"]), lambda g: f)))
        times = lambda n: F.transform(F.filter(both, lambda f: f["namespace"].eqNullSafe(n)), lambda f: f["ts"])
        return F.transform(F.array_distinct(F.transform(both, lambda f: f["namespace"])), lambda n: F.struct(n.alias("namespace"), times(n).alias("times")))

    # nodes that fire alike are a class; pairs of classes are folded once if they are few
    kinds = cut(own.select("fires", F.xxhash64(F.to_json(F.struct("fires"))).alias("kind")).distinct())
    few = kinds.count() <= FEW_KINDS
    n = own.count()
    blocks = n // BLOCK_NODES + 1
    fires = F.xxhash64(F.to_json(F.struct("fires"))) if few else F.col("fires")
    met = own.select("node", fires.alias("fires"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("_b")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # of two blocks the lesser one comes first; each group has the nodes of both
    met = met.select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", F.struct("node", "fires").alias("_x"))
    side = lambda c: F.collect_list(F.when(F.col("_b") == F.col(c), F.col("_x")))
    groups = _dealt(met, "_i", "_j", tasks=max(PAIR_TASKS, blocks * (blocks + 1) // 2)).groupBy("_i", "_j").agg(side("_i").alias("_first"), side("_j").alias("_second"))
    pairs = groups.select("_i", "_j", F.inline("_first"), "_second").select("_i", "_j", "node", "fires", F.explode("_second").alias("y"))
    pairs = pairs.where("_i <> _j or y.node > node")
    greater = F.col("y.node") > F.col("node")
    a, b = F.when(greater, F.col("fires")).otherwise(F.col("y.fires")), F.when(greater, F.col("y.fires")).otherwise(F.col("fires"))
    pairs = pairs.select(F.least("node", "y.node").alias("node_a"), F.greatest("node", "y.node").alias("node_b"), a.alias("a"), b.alias("b"))
    if few:
        each = kinds.select(F.col("kind").alias("a"), F.col("fires").alias("x")).crossJoin(kinds.select(F.col("kind").alias("b"), F.col("fires").alias("y")))
        pairs = pairs.join(F.broadcast(each.select("a", "b", F.inline(folded(F.col("x"), F.col("y"))))), ["a", "b"])
    else:
        pairs = pairs.select("node_a", "node_b", F.inline(folded(F.col("a"), F.col("b"))))
    count = F.size("times").cast("bigint")
    return pairs.select(*PAIR, F.least(F.lit(C.WEIGHT_CAP), count * step).alias("weight"), count.alias("activation_count"), F.array_max("times").alias("last_activated"), F.array_min("times").alias("created_at"))


def penalize(synapses: DataFrame, nodes: DataFrame, penalty: float = 0.3) -> DataFrame:
    """Weights between ``nodes`` (node) lowered; those that are then weak and rarely fired go."""
    hit = synapses.join(nodes.select(F.col("node").alias("node_a")).distinct().withColumn("_x", F.lit(True)), "node_a", "left").join(nodes.select(F.col("node").alias("node_b")).distinct().withColumn("_y", F.lit(True)), "node_b", "left")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    weight = F.when(both, F.greatest(F.lit(0.0), F.col("weight") - penalty)).otherwise(F.col("weight"))
    out = hit.withColumn("weight", weight).where(~(both & (F.col("weight") <= C.PRUNE_THRESHOLD) & (F.col("activation_count") < C.LTP_THRESHOLD)))
    return out.select(*synapses.columns)


def decayed(weight: Column, last: Column, half_life: Column, now: float) -> Column:
    age = (F.lit(now) - last) / C.DAY
    return F.when(weight <= 0, 0.0).when(age <= 0, weight).otherwise(weight * F.exp(-C.LN2 * age / half_life))


def half_life(namespace: Column) -> Column:
    return F.when(namespace == "shared", C.HALF_LIFE_SHARED).when(namespace == "ephemeral", C.HALF_LIFE_EPHEMERAL).otherwise(C.HALF_LIFE_DAYS)


def decay(synapses: DataFrame, now: float, advance: bool = False) -> DataFrame:
    """One decay tick: long-term pairs keep a floor (not in ephemeral), weak ones go. ``advance`` also moves last_activated."""
    own = F.col("half_life_days") if "half_life_days" in synapses.columns else F.lit(None).cast("double")
    w = decayed(F.col("weight"), F.col("last_activated"), F.coalesce(own, half_life(F.col("namespace"))), now)
    lasting = (F.col("activation_count") >= C.LTP_THRESHOLD) & (F.col("namespace") != "ephemeral")
    out = synapses.withColumn("weight", F.when(lasting, F.greatest(F.lit(C.LTP_FLOOR), w)).otherwise(w)).where(lasting | (F.col("weight") >= C.PRUNE_THRESHOLD))
    return out.withColumn("last_activated", F.greatest("last_activated", F.lit(now))) if advance else out


def decay_transitions(transitions: DataFrame, now: float) -> DataFrame:
    w = decayed(F.col("weight"), F.col("last_activated"), half_life(F.col("namespace")), now)
    return transitions.withColumn("weight", w).where(F.col("weight") >= C.TRANSITION_PRUNE)


def decay_node(synapses: DataFrame, node: str, now: float) -> DataFrame:
    mine = (F.col("node_a") == node) | (F.col("node_b") == node)
    w = decayed(F.col("weight"), F.col("last_activated"), F.lit(C.HALF_LIFE_DAYS), now)
    w = F.when(F.col("activation_count") >= C.LTP_THRESHOLD, F.greatest(F.lit(C.LTP_FLOOR), w)).otherwise(w)
    return synapses.withColumn("weight", F.when(mine, w).otherwise(F.col("weight"))).where(~mine | (F.col("weight") >= C.PRUNE_THRESHOLD))


def prune_stale(synapses: DataFrame, now: float, days: float) -> DataFrame:
    return synapses.where((F.col("last_activated") >= now - days * C.DAY) | (F.col("activation_count") >= C.LTP_THRESHOLD))


def learned_half_life(synapses: DataFrame, now: float) -> DataFrame:
    """``synapses`` with half_life_days learned from frequency and blended by recency."""
    default = half_life(F.col("namespace"))
    low = F.when(F.col("namespace") == "shared", F.greatest(F.lit(C.LEARNED_MIN_DAYS), default)).otherwise(C.LEARNED_MIN_DAYS)
    high = F.lit(C.LEARNED_MAX_DAYS)
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("created_at")) / C.DAY)
    since = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_activated")) / C.DAY)
    ratio = F.log1p(F.col("activation_count") / 10.0)  # frequency times age over ten
    learned = low + (high - low) * (ratio / (1 + ratio))
    trust = F.exp(-C.LN2 * since / default)
    blend = (1 - trust) * default + trust * learned
    return synapses.withColumn("half_life_days", F.greatest(low, F.least(high, F.when(age < 1, default).otherwise(blend))))


def import_max(synapses: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (source, target, namespace, weight, activation_count, ts) merged in by the greater weight and count."""
    new = rows.where("source <> target").select(
        F.least("source", "target").alias("node_a"), F.greatest("source", "target").alias("node_b"), "namespace",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), "weight")).alias("weight"), "activation_count", F.col("ts").alias("last_activated"), F.col("ts").alias("created_at"),
    )
    both = synapses.select(*new.columns).unionByName(new)
    return both.groupBy(*PAIR).agg(F.max("weight").alias("weight"), F.max("activation_count").alias("activation_count"), F.max("last_activated").alias("last_activated"), F.min("created_at").alias("created_at"))


def factor(namespace: Column, active: str = "personal") -> Column:
    """What a namespace counts in a merged read; null: not read."""
    out = F.when(namespace == active, C.NAMESPACE_FACTORS["branch"]) if active.startswith("branch:") else F.when(F.lit(False), 0.0)
    return out.when(namespace == "personal", C.NAMESPACE_FACTORS["personal"]).when(namespace == "shared", C.NAMESPACE_FACTORS["shared"])


def merged_edges(synapses: DataFrame, active: str = "personal") -> DataFrame:
    """(node_a, node_b, weight, activation_count) over the namespaces read, weights times their factors."""
    f = factor(F.col("namespace"), active)
    return synapses.where(f.isNotNull()).groupBy("node_a", "node_b").agg(F.sum(F.col("weight") * f).alias("weight"), F.sum("activation_count").alias("activation_count"))


def adjacency(synapses: DataFrame, active: str = "personal") -> DataFrame:
    """(node, other, weight) of the merged graph, both directions."""
    e = merged_edges(synapses, active)
    return e.select(F.col("node_a").alias("node"), F.col("node_b").alias("other"), "weight").unionByName(e.select(F.col("node_b").alias("node"), F.col("node_a").alias("other"), "weight"))


def neighbors(synapses: DataFrame, node: str, k: int = 5, active: str = "personal") -> DataFrame:
    mine = synapses.where((F.col("node_a") == node) | (F.col("node_b") == node))
    return adjacency(mine, active).where(F.col("node") == node).select("other", "weight").orderBy(F.desc("weight"), "other").limit(k)


def spread(synapses: DataFrame, seeds: DataFrame, depth: int = C.SPREAD_DEPTH, k: int = C.SPREAD_TOP_K, active: str = "personal", by_namespace: bool = False) -> DataFrame:
    """(node, energy): activation spread from ``seeds`` (node, energy) over ``depth`` hops, seeds left out, top k.

    Each hop passes energy times weight times decay, hubs dampened by the square root of their excess
    degree; walks may return through seeds. With ``by_namespace`` the rows are (node, namespace, energy)
    of the namespace of the last edge, not cut to k.
    """
    f = factor(F.col("namespace"), active)
    e = synapses.where(f.isNotNull()).select("node_a", "node_b", "namespace", (F.col("weight") * f).alias("w"))
    both = e.select(F.col("node_a").alias("node"), F.col("node_b").alias("other"), "namespace", "w").unionByName(e.select(F.col("node_b").alias("node"), F.col("node_a").alias("other"), "namespace", "w"))
    degree = both.groupBy("node").agg(F.countDistinct("other").alias("degree"))
    hub = F.when(F.col("degree") > C.HUB_DEGREE, F.sqrt(C.HUB_DEGREE / F.col("degree"))).otherwise(1.0)
    wave, total = seeds.select("node", "energy"), None
    for _ in range(depth):
        # the frontier picks its edges first, so degrees are looked up for it only
        moved = wave.join(both, "node").join(degree, "node").select(F.col("other").alias("node"), "namespace", (F.col("energy") * F.col("w") * C.SPREAD_DECAY * hub).alias("energy"))
        total = moved if total is None else total.unionByName(moved)
        wave = moved.groupBy("node").agg(F.sum("energy").alias("energy"))
    total = total.join(seeds.select("node"), "node", "left_anti")
    if by_namespace:
        return total.groupBy("node", "namespace").agg(F.sum("energy").alias("energy"))
    return strongest(total, k)


def strongest(parts: DataFrame, k: int) -> DataFrame:
    """(node, energy): the k nodes of the greatest sums of ``parts`` (node, energy). Sums that differ by rounding only are ties, which go by node."""
    return parts.groupBy("node").agg(F.sum("energy").alias("energy")).orderBy(F.desc(F.round("energy", 9)), "node").limit(k)


def record_sequences(events: DataFrame, strength: float = 1.0) -> DataFrame:
    """Transitions between distinct neighbours of ordered sequences (seq, pos, node, ts, namespace); repeats collapse."""
    w = Window.partitionBy("seq").orderBy("pos")
    distinct = events.withColumn("before", F.lag("node").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("node")))
    steps = distinct.withColumn("from_node", F.lag("node").over(w)).where("from_node is not null").withColumnRenamed("node", "to_node")
    amount = C.TRANSITION_RATE * min(max(strength, 0.0), 5.0)
    return steps.groupBy(*STEP).agg(F.least(F.lit(C.TRANSITION_CAP), F.count("*") * amount).alias("weight"), F.count("*").alias("count"), F.max("ts").alias("last_activated"), F.min("ts").alias("created_at"))


def merged_transitions(transitions: DataFrame, active: str = "personal") -> DataFrame:
    f = factor(F.col("namespace"), active)
    return transitions.where(f.isNotNull()).groupBy("from_node", "to_node").agg(F.sum(F.col("weight") * f).alias("weight"), F.sum("count").alias("count"))


def next_likely(transitions: DataFrame, k: int = C.NEXT_TOP_K, active: str = "personal") -> DataFrame:
    """(from_node, to_node, probability, rank): the k likeliest successors of every node, over all of its successors."""
    m = merged_transitions(transitions, active)
    p = m.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy("from_node")))
    order = Window.partitionBy("from_node").orderBy(F.desc("probability"), "to_node")
    return p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("from_node", "to_node", "probability", "rank")


def normalize_hubs(synapses: DataFrame, most: int = C.HUB_DEGREE) -> DataFrame:
    """Weights scaled down by the square root of the excess degree of each hub at their ends."""
    ends = synapses.select(F.col("node_a").alias("node")).unionAll(synapses.select(F.col("node_b").alias("node")))
    hubs = ends.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > most).select("node", F.sqrt(most / F.col("degree")).alias("scale"))
    out = synapses.join(hubs.select(F.col("node").alias("node_a"), F.col("scale").alias("_a")), "node_a", "left").join(hubs.select(F.col("node").alias("node_b"), F.col("scale").alias("_b")), "node_b", "left")
    return out.withColumn("weight", F.col("weight") * F.coalesce("_a", F.lit(1.0)) * F.coalesce("_b", F.lit(1.0))).select(*synapses.columns)


def stats(synapses: DataFrame) -> DataFrame:
    """One row a namespace: edges, lasting edges, weight, distinct nodes, and those untouched."""
    nodes = synapses.select("namespace", F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("namespace").agg(F.countDistinct("node").alias("nodes"))
    edges = synapses.groupBy("namespace").agg(F.count("*").alias("edges"), F.count_if(F.col("activation_count") >= C.LTP_THRESHOLD).alias("lasting"), F.sum("weight").alias("weight"), F.count_if(F.col("activation_count") <= 1).alias("dormant"))
    return edges.join(nodes, "namespace")


def top_pairs(synapses: DataFrame, k: int, least: float) -> DataFrame:
    """Raw weights summed over namespaces."""
    s = synapses.groupBy("node_a", "node_b").agg(F.sum("weight").alias("weight"), F.sum("activation_count").alias("activation_count"))
    return s.where(F.col("weight") >= least).orderBy(F.desc("weight"), F.desc("activation_count"), "node_a", "node_b").limit(k)


def top_transition_groups(transitions: DataFrame, k: int, least: float) -> DataFrame:
    """Successors of the k strongest from-nodes whose probability reaches ``least``."""
    s = transitions.groupBy("from_node", "to_node").agg(F.sum("weight").alias("weight"))
    from_ = s.groupBy("from_node").agg(F.max("weight").alias("most"), F.sum("weight").alias("total")).orderBy(F.desc("most"), F.desc("total"), "from_node").limit(k)
    return s.join(F.broadcast(from_), "from_node").withColumn("probability", F.col("weight") / F.col("total")).where(F.col("probability") >= least).select("from_node", "to_node", "weight", "probability")


def structural_seeds(edges: DataFrame, now: float) -> DataFrame:
    """Shared synapses from (caller, callee, call_count): the more calls, the heavier, up to a bound."""
    pairs = edges.where("caller <> callee").groupBy(F.least("caller", "callee").alias("node_a"), F.greatest("caller", "callee").alias("node_b")).agg(F.sum("call_count").alias("n"))
    weight = F.least(F.lit(C.SEED_MAX), C.SEED_BASE + C.SEED_LOG * F.log1p("n"))
    return pairs.select("node_a", "node_b", F.lit("shared").alias("namespace"), weight.alias("weight"), F.lit(0).cast("long").alias("activation_count"), F.lit(now).alias("last_activated"), F.lit(now).alias("created_at"))


def promote_lasting(synapses: DataFrame) -> DataFrame:
    lasting = (F.col("activation_count") >= C.LTP_THRESHOLD) & (F.col("weight") >= C.LTP_FLOOR) & (F.col("weight") < 1)
    return synapses.withColumn("weight", F.when(lasting, F.least(F.lit(1.0), F.col("weight") * 1.1)).otherwise(F.col("weight")))


def distinct_nodes(synapses: DataFrame, transitions: DataFrame) -> DataFrame:
    ids = [synapses.select(F.col(c).alias("node")) for c in ("node_a", "node_b")] + [transitions.select(F.col(c).alias("node")) for c in ("from_node", "to_node")]
    return ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct()
