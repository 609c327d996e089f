"""Typed-graph analytics: views, recall, blast radius, cohesion, drift, betweenness, gaps, communities.

Links are (source, target, relation, confidence_score). Loops over hops are unrolled or cut by
reliable checkpoints; every hop is a join, never a driver-side walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..base import cut, drop
from . import communities
from .evaluation import percentile

# Each relation's view from source to target and from target to source.
RELATION_VIEWS = {
    "calls": ("callees", "callers"),
    "inherits": ("bases", "subclasses"),
    "implements": ("interfaces", "implementers"),
    "imports": ("imports", "importers"),
    "imports_from": ("imports", "importers"),
    "contains": ("members", "container"),
    "uses": ("uses", "used_by"),
}
DEFAULT_VIEWS = ["callers", "callees", "bases", "subclasses", "importers"]
BLAST_VIEWS = ["callers", "importers", "subclasses", "implementers"]


def views(links: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """(node, view, other), distinct: each link seen from both ends. Loops, unknown relations and doubtful links go."""
    pairs = F.create_map(*[x for r, (a, b) in RELATION_VIEWS.items() for x in (F.lit(r), F.array(F.lit(a), F.lit(b)))])
    kept = links.where((F.col("source") != F.col("target")) & F.col("relation").isin(list(RELATION_VIEWS)) & (F.coalesce("confidence_score", F.lit(1.0)) >= least_confidence))
    both = kept.withColumn("v", F.element_at(pairs, F.col("relation")))
    ends = F.array(F.struct(F.col("source").alias("node"), F.get("v", F.lit(0)).alias("view"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.get("v", F.lit(1)).alias("view"), F.col("source").alias("other")))
    return both.select(F.explode(ends).alias("e")).select("e.*").distinct()


def view_neighbors(view_rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(node, view, n, others): neighbours by view, sorted; the default views unless named."""
    return view_rows.where(F.col("view").isin(names or DEFAULT_VIEWS)).groupBy("node", "view").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("other")).alias("others"))


def structural_recall(view_rows: DataFrame, seeds: DataFrame, k: int = 8) -> DataFrame:
    """(node, score): the best view weight over all seeds (node), hubs dampened, seeds left out."""
    weight = F.element_at(F.create_map(*[x for v, w in C.VIEW_WEIGHTS.items() for x in (F.lit(v), F.lit(w))]), F.col("view"))
    mine = view_rows.where(F.col("view").isin(list(C.VIEW_WEIGHTS))).join(seeds.select("node").distinct(), "node", "left_semi")
    sizes = mine.groupBy("node", "view").agg(F.count("*").alias("degree"))
    hub = F.when(F.col("degree") > C.HUB_DEGREE, F.sqrt(C.HUB_DEGREE / F.col("degree"))).otherwise(1.0)
    found = mine.join(sizes, ["node", "view"]).select(F.col("other").alias("node"), (weight * hub).alias("score"))
    return found.join(seeds.select("node"), "node", "left_anti").groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(k)


def blast_radius(view_rows: DataFrame, starts: DataFrame, depth: int = 2, fan_out: int = 50) -> DataFrame:
    """(start, node, hop, view): what depends on each start (node), nearest hop first.

    Of a node's dependants by view the first ``fan_out`` by id are followed; a node reached twice keeps
    the smallest hop, then the first view in the fixed order.
    """
    order = F.create_map(*[x for i, v in enumerate(BLAST_VIEWS) for x in (F.lit(v), F.lit(i))])
    w = Window.partitionBy("node", "view").orderBy("other")
    edges = view_rows.where(F.col("view").isin(BLAST_VIEWS)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= fan_out).withColumn("place", F.element_at(order, F.col("view"))).select("node", "view", "other", "place")
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    seen, out = frontier, None
    for hop in range(1, depth + 1):
        reached = frontier.join(edges, "node").select("start", F.col("other").alias("node"), "view", "place")
        reached = reached.groupBy("start", "node").agg(F.min_by("view", "place").alias("view")).join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = cut(reached) if hop % 3 == 0 else reached
        out = reached if out is None else out.unionByName(reached)
        frontier = reached.select("start", "node")
        seen = seen.unionByName(frontier)
    return out


#: Hops that ``closure`` takes one by one before it doubles its steps.
SINGLE_HOPS = 6


def closure(edges: DataFrame, starts: DataFrame, single_hops: int = SINGLE_HOPS) -> DataFrame:
    """(node): everything reachable from ``starts`` (node) over ``edges`` (node, other), starts included; stored.

    Most graphs are covered by a few hops, one join each. What is left then goes by doubled steps: pairs that 2^k hops
    connect come of joining those of half as many, and what has been reached within 2^k hops takes one such step each
    round. A chain of n nodes takes log n rounds of n pairs. Only links between nodes not yet reached are doubled. It ends
    when a round reaches nothing: then no node lies as far as that, nor farther.
    """
    seen = cut(starts.select("node").distinct())
    frontier, links = seen, edges.where("node <> other").select("node", "other").distinct()
    for _ in range(single_hops):
        frontier = cut(links.join(frontier, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not frontier.take(1):
            return seen
        seen = cut(seen.unionByName(frontier))
    inside = seen.join(frontier, "node", "left_anti")
    step = cut(links.join(inside, "node", "left_anti").join(seen.withColumnRenamed("node", "other"), "other", "left_anti").select("node", "other"))
    reached = frontier
    while True:
        new = cut(step.join(reached, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(reached, "node", "left_anti"))
        if not new.take(1):
            out = cut(inside.unionByName(reached).distinct())
            drop(step, new, reached, seen)
            return out
        before, reached = reached, cut(reached.unionByName(new))
        if before is not frontier:
            drop(before)
        last, step = step, cut(step.join(step.select(F.col("node").alias("other"), F.col("other").alias("end")), "other").select("node", F.col("end").alias("other")).distinct())
        drop(last, new)


def cohesion_outliers(members: DataFrame, uses: DataFrame, cohesion: float = C.COHESION, min_peers: int = C.MIN_PEERS, most: int = C.MAX_FINDINGS) -> DataFrame:
    """(cluster, node, associate, peers, size): members (cluster, node) that skip what most of their peers use.

    ``uses`` is (node, associate). An associate outside the cluster that at least ceil(cohesion * size) and
    ``min_peers`` members use, but not all, is a finding for each of the others; the ``most`` strongest a cluster.
    """
    members = members.select("cluster", "node").distinct()
    size = members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_peers + 1)
    mine = members.join(uses.select("node", "associate").distinct(), "node").where("node <> associate")
    mine = mine.join(members.select("cluster", F.col("node").alias("associate")), ["cluster", "associate"], "left_anti")
    peers = mine.groupBy("cluster", "associate").agg(F.count("*").alias("peers")).join(size, "cluster")
    shared = peers.where((F.col("peers") >= F.greatest(F.lit(min_peers), F.ceil(cohesion * F.col("size")))) & (F.col("peers") < F.col("size")))
    skipped = shared.join(members, "cluster").join(mine, ["cluster", "associate", "node"], "left_anti")
    order = Window.partitionBy("cluster").orderBy(F.desc(F.col("peers") / F.col("size")), F.desc("peers"), "associate", "node")
    return skipped.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("cluster", "node", "associate", "peers", "size")


def symbols_in_ranges(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, id): symbols (path, id, line) whose span up to the next symbol of the file meets a hunk (path, first, last)."""
    spans = symbols.withColumn("next", F.lead("line").over(Window.partitionBy("path").orderBy("line", "id")))
    hit = (F.col("line") <= F.col("last")) & (F.col("next").isNull() | (F.col("next") > F.col("first")))
    return spans.join(hunks, "path").where(hit).select("path", "id").distinct()


def line_spans(symbols: DataFrame) -> DataFrame:
    """(path, id, first, last) of symbols (path, id, line); the last symbol of a file spans its own line."""
    nxt = F.lead("line").over(Window.partitionBy("path").orderBy("line", "id"))
    return symbols.select("path", "id", F.col("line").alias("first"), F.greatest("line", F.coalesce(nxt - 1, F.col("line"))).alias("last"))


def role_tokens(label: Column) -> tuple[Column, Column]:
    """First and last underscore-separated token of three letters or more."""
    parts = F.filter(F.split(F.lower(label), "_"), lambda t: F.length(t) >= 3)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))


def _grouped(members: DataFrame, min_peers: int) -> DataFrame:
    """``members`` with t1, t2 (role tokens), n, n1, n2 (members of the container, and with the same token) and by, the group that counts."""
    first, last = role_tokens(F.col("label"))
    m = members.withColumn("t1", first).withColumn("t2", last)
    sizes = m.groupBy("container").agg(F.count("*").alias("n"))
    one, two = (m.where(f"{t} is not null").groupBy("container", t).agg(F.count("*").alias(k)) for t, k in (("t1", "n1"), ("t2", "n2")))
    m = m.join(sizes, "container").join(one, ["container", "t1"], "left").join(two, ["container", "t2"], "left")
    fits = lambda c: F.when((F.col(c) >= min_peers + 1) & (F.col(c) <= F.col("n") - 1), F.col(c))
    m = m.withColumn("f1", fits("n1")).withColumn("f2", fits("n2"))
    by = F.when(F.col("f2").isNotNull() & (F.col("f1").isNull() | (F.col("f2") <= F.col("f1"))), F.concat(F.lit("2"), "t2")).when(F.col("f1").isNotNull(), F.concat(F.lit("1"), "t1")).otherwise(F.lit("0"))
    return m.withColumn("by", by)


def peer_groups(members: DataFrame, min_peers: int = C.MIN_PEERS) -> DataFrame:
    """(container, node, peer): siblings of ``members`` (container, node, label), narrowed by a shared role token.

    The narrowest group by last or first token of min_peers + 1 to n - 1 members wins, the last token on a
    tie; without one, all siblings are peers.
    """
    m = _grouped(members, min_peers)
    offers = m.select("container", F.col("node").alias("peer"), F.explode(F.array(F.lit("0"), F.concat(F.lit("1"), "t1"), F.concat(F.lit("2"), "t2"))).alias("by"))
    return m.select("container", "node", "by").join(offers, ["container", "by"]).where("node <> peer").select("container", "node", "peer")


def peer_counts(members: DataFrame, min_peers: int = C.MIN_PEERS) -> DataFrame:
    """(container, node, peers): how many peers ``peer_groups`` gives, without making the pairs; nodes without one left out."""
    size = F.when(F.col("by").startswith("2"), F.col("f2")).when(F.col("by").startswith("1"), F.col("f1")).otherwise(F.col("n"))
    return _grouped(members, min_peers).select("container", "node", (size - 1).alias("peers")).where("peers > 0")


def drift(changed: DataFrame, members: DataFrame, uses: DataFrame, cohesion: float = C.COHESION, min_peers: int = C.MIN_PEERS, most: int = C.MAX_DRIFT) -> DataFrame:
    """(node, associate, peers, size): changed nodes (node) that skip what most of their peer group use, the strongest ``most``.

    A changed node's group is itself and its peers; ``uses`` is (node, associate).
    """
    group = _grouped(members, min_peers)
    mine = group.join(changed.select("node").distinct(), "node", "left_semi").select("container", "by", F.col("node").alias("changed")).where("by is not null")
    offers = group.select("container", "node", F.explode(F.array(F.lit("0"), F.concat(F.lit("1"), "t1"), F.concat(F.lit("2"), "t2"))).alias("by")).where("by is not null")
    # one group serves all its changed nodes: its uses are counted once
    wanted = mine.select("container", "by").distinct()
    of = offers.join(wanted, ["container", "by"], "left_semi")
    size = of.groupBy("container", "by").agg(F.count("*").alias("size")).where(F.col("size") >= min_peers + 1)
    used = of.join(uses.select("node", "associate").distinct(), "node").where("node <> associate")
    used = used.join(of.select("container", "by", F.col("node").alias("associate")), ["container", "by", "associate"], "left_anti")
    peers = used.groupBy("container", "by", "associate").agg(F.count("*").alias("peers")).join(size, ["container", "by"])
    shared = peers.where((F.col("peers") >= F.greatest(F.lit(min_peers), F.ceil(cohesion * F.col("size")))) & (F.col("peers") < F.col("size")))
    skipped = mine.join(shared, ["container", "by"]).join(used.select("container", "by", "associate", F.col("node").alias("changed")), ["container", "by", "associate", "changed"], "left_anti")
    found = skipped.groupBy(F.col("changed").alias("node"), "associate").agg(F.max(F.struct((F.col("peers") / F.col("size")).alias("share"), "peers", "size")).alias("m"))
    return found.select("node", "associate", "m.peers", "m.size", "m.share").orderBy(F.desc("share"), F.desc("peers"), "node", "associate").limit(most).drop("share")


def undirected(links: DataFrame) -> DataFrame:
    """(a, b, distance): each linked pair once, at the least distance, one over the relation's or the link's weight."""
    default = F.coalesce(F.element_at(F.create_map(*[x for r, w in C.RELATION_WEIGHTS.items() for x in (F.lit(r), F.lit(w))]), F.col("relation")), F.lit(C.OTHER_RELATION_WEIGHT))
    weight = F.coalesce("weight", default) if "weight" in links.columns else default
    rows = links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (1 / F.when(weight > 0, weight).otherwise(C.OTHER_RELATION_WEIGHT)).alias("distance"))
    return rows.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "distance").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "distance"))


#: Edges of a graph that betweenness ships to every task; larger graphs go by messages. Cells of one task's matrices.
MAX_SHIPPED_EDGES, BLOCK_CELLS = 2_000_000, 4_000_000


def _dependencies(source: np.ndarray, n: int, tail: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each of n nodes lies between, for a block of sources at once: a row a source.

    Edges (tail, head, length) are sorted by head. Three equations over all edges are iterated until they hold:
    distances are least sums, a node has as many shortest paths as the tails of its tight edges together, and a tail
    gets of each head its share of paths.
    """
    rows = np.arange(len(source))
    into, first = np.unique(head, return_index=True)
    back = np.argsort(tail, kind="stable")
    out, start = np.unique(tail[back], return_index=True)
    far = np.full((len(source), n), np.inf)
    far[rows, source] = 0.0
    while True:
        near = np.minimum(far[:, into], np.minimum.reduceat(far[:, tail] + length, first, axis=1))
        if np.array_equal(near, far[:, into]):
            break
        far[:, into] = near
    tight = np.isclose(far[:, tail] + length, far[:, head], rtol=0, atol=1e-12) & np.isfinite(far[:, head])
    own = np.zeros_like(far)
    own[rows, source] = 1.0
    paths = own
    while True:
        new = own.copy()
        new[:, into] += np.add.reduceat(np.where(tight, paths[:, tail], 0.0), first, axis=1)
        if np.array_equal(new, paths):
            break
        paths = new
    share = np.where(tight, paths[:, tail] / np.maximum(paths[:, head], 1.0), 0.0)[:, back]
    between = np.zeros_like(far)
    while True:
        new = np.zeros_like(far)
        new[:, out] = np.add.reduceat(share * (1.0 + between[:, head[back]]), start, axis=1)
        if np.array_equal(new, between):
            break
        between = new
    between[rows, source] = 0.0
    return between


def betweenness(links: DataFrame, nodes: DataFrame | None = None, normalized: bool = True, sources: int | None = None) -> DataFrame:
    """(node, betweenness): weighted shortest-path betweenness, exact, or if ``sources`` is given over so many sampled ones, scaled up.

    Blocks of sources are spread over tasks, each with the whole graph, and summed by node. A graph of more than
    MAX_SHIPPED_EDGES is handled by ``paths.betweenness``, where no task holds it.
    """
    adj = cut(both_ways(undirected(links)))
    n_edges = adj.count()
    if n_edges > MAX_SHIPPED_EDGES:
        from . import paths

        drop(adj)
        return paths.betweenness(links, nodes, normalized, sources)
    every = adj.select("node").unionByName(nodes.select("node")) if nodes is not None else adj.select("node")
    every = cut(every.distinct())
    n = every.count()
    if not n_edges:
        return every.withColumn("betweenness", F.lit(0.0))
    pdf = adj.toPandas()
    names = np.unique(pdf["node"].to_numpy(object))
    tail, head = np.searchsorted(names, pdf["node"].to_numpy(object)), np.searchsorted(names, pdf["other"].to_numpy(object))
    order = np.argsort(head, kind="stable")
    graph = links.sparkSession.sparkContext.broadcast((names, tail[order], head[order], pdf["distance"].to_numpy(float)[order]))
    linked = adj.select("node").distinct()
    picked = linked if sources is None or sources >= n else linked.orderBy(F.xxhash64("node", F.lit(42))).limit(sources)
    scale = 1.0 if sources is None or sources >= n else n / sources

    def passes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, tail, head, length = graph.value
        block, total = max(1, BLOCK_CELLS // max(len(tail), len(names))), np.zeros(len(names))
        for b in batches:
            at = np.searchsorted(names, b["node"].to_numpy(object))
            for k in range(0, len(at), block):
                total += _dependencies(at[k : k + block], len(names), tail, head, length).sum(axis=0)
        some = np.nonzero(total)[0]
        yield pd.DataFrame({"node": names[some], "part": total[some]})

    parts = picked.repartition(min(1024, max(1, n // 32)), "node").mapInPandas(passes, f"node {dict(every.dtypes)['node']}, part double").groupBy("node").agg(F.sum("part").alias("part"))
    factor = scale / ((n - 1) * (n - 2)) if normalized and n > 2 else scale
    return every.join(parts, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * factor).alias("betweenness"))


def bridges(links: DataFrame, communities: DataFrame, scores: DataFrame, threshold: float = C.GAP_THRESHOLD) -> DataFrame:
    """(node, betweenness, degree, community, bridged): nodes of enough betweenness that touch two communities and are no hubs."""
    adj = both_ways(undirected(links))
    degree = adj.groupBy("node").agg(F.count("*").alias("degree"))
    middle = percentile(degree, "degree", 0.5).select(F.col("value").alias("median"))  # one row
    touched = adj.join(communities.select(F.col("node").alias("other"), F.col("community").alias("c")), "other").select("node", "c").unionByName(communities.select("node", F.col("community").alias("c")))
    touched = touched.groupBy("node").agg(F.array_sort(F.collect_set("c")).alias("bridged")).where(F.size("bridged") >= 2)
    own = communities.select("node", "community")
    out = scores.where(F.col("betweenness") >= threshold).join(touched, "node").join(degree, "node").join(own, "node", "left").crossJoin(F.broadcast(middle))
    return out.where(F.col("degree") <= 2 * F.col("median")).drop("median")


def gaps(links: DataFrame, communities: DataFrame, k: int = 10, threshold: float = C.GAP_THRESHOLD, scores: DataFrame | None = None) -> DataFrame:
    """(node, gap_score, betweenness, degree, bridged, suggested): bridges by betweenness over degree + 1, and whom to link to.

    Of each other community bridged, the node of the highest degree that isn't a neighbour is suggested.
    """
    scores = scores if scores is not None else betweenness(links, communities)
    found = bridges(links, communities, scores, threshold).withColumn("gap_score", F.round(F.col("betweenness") / (F.col("degree") + 1), 6))
    best = found.orderBy(F.desc("gap_score"), "node").limit(k)
    adj = both_ways(undirected(links))
    degree = adj.groupBy("node").agg(F.count("*").alias("d"))
    wanted = best.select("node", F.explode("bridged").alias("c"), "community").where("community is null or c <> community")
    candidates = communities.join(degree, "node", "left").select(F.col("node").alias("other"), F.col("community").alias("c"), F.coalesce("d", F.lit(0)).alias("d"))
    options = wanted.join(candidates, "c").where("node <> other").join(adj.select("node", "other"), ["node", "other"], "left_anti")
    first = options.groupBy("node", "c").agg(F.min_by("other", F.struct(-F.col("d"), F.col("other"))).alias("other"))
    suggested = first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "other"))), lambda s: s["other"]).alias("suggested"))
    return best.join(suggested, "node", "left").select("node", "gap_score", F.round("betweenness", 6).alias("betweenness"), "degree", "bridged", F.coalesce("suggested", F.array().cast("array<string>")).alias("suggested"))


#: Edges up to which sequential community detection runs in one task; more are handled by rounds of joins.
MAX_LOUVAIN_EDGES = 1_000_000


def louvain(edges: DataFrame, resolution: float = 1.0, sweeps: int = 10) -> DataFrame:
    """(node, community): greedy modularity communities of ``edges`` (a, b, weight), numbered by their smallest node.

    Moves depend on the ones before, so a graph of at most MAX_LOUVAIN_EDGES is handled by one task; a larger one goes by
    ``communities.communities``, greedy moves in rounds over all nodes, whose communities may differ.
    """
    if edges.count() > MAX_LOUVAIN_EDGES:
        found = communities.communities(edges, resolution)
        names = found.select("community").distinct().orderBy("community").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
        numbers = edges.sparkSession.createDataFrame(names, f"name {dict(found.dtypes)['community']}, number long")
        return found.join(numbers, F.col("community") == F.col("name")).select("node", F.col("number").alias("community"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {v: i for i, v in enumerate(names)}
        graph: list[dict[int, float]] = [{} for _ in names]
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]):
            i, j = at[a], at[b]
            if i != j:
                graph[i][j] = graph[i].get(j, 0.0) + w
                graph[j][i] = graph[j].get(i, 0.0) + w
        label = list(range(len(names)))
        loops = [0.0] * len(graph)
        while graph:
            n = len(graph)
            degree = [sum(x.values()) + loops[i] for i, x in enumerate(graph)]
            total = sum(degree) or 1.0
            own, held = list(range(n)), degree[:]
            for _ in range(sweeps):
                moved = False
                for v in range(n):
                    near: dict[int, float] = {}
                    for u, w in graph[v].items():
                        near[own[u]] = near.get(own[u], 0.0) + w
                    held[own[v]] -= degree[v]
                    gain = lambda c: near.get(c, 0.0) - resolution * degree[v] * held[c] / total  # noqa: B023, E731
                    best = max(sorted(near), key=gain, default=own[v])
                    if best != own[v] and gain(best) > gain(own[v]) + 1e-12:
                        own[v], moved = best, True
                    held[own[v]] += degree[v]
                if not moved:
                    break
            names_of = {c: i for i, c in enumerate(sorted(set(own)))}
            label = [names_of[own[x]] for x in label]
            if len(names_of) == n:
                break
            coarse: list[dict[int, float]] = [{} for _ in names_of]
            inner = [0.0] * len(names_of)
            for v in range(n):
                c = names_of[own[v]]
                inner[c] += loops[v]
                for u, w in graph[v].items():
                    d = names_of[own[u]]
                    if c == d:
                        inner[c] += w
                    else:
                        coarse[c][d] = coarse[c].get(d, 0.0) + w
            graph, loops = coarse, inner
        first: dict[int, int] = {}
        for x in label:
            first.setdefault(x, len(first))
        return pd.DataFrame({"node": names, "community": [first[x] for x in label]})

    kind = dict(edges.dtypes)["a"]
    return edges.select("a", "b", F.col("weight").cast("double").alias("weight")).groupBy().applyInPandas(solve, f"node {kind}, community long")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the label of the greatest weight around it, ties to the smallest."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")))
    labels = both.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        # the own label has a vote too: without one, pairs would swap labels for ever
        votes = votes.unionByName(labels.select("node", "community", F.lit(1e-9).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        labels = cut(votes.groupBy("node").agg(F.max_by("community", F.struct("w", F.col("community"))).alias("community")))
    return labels


def validate(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(severity, kind, id, n): duplicate or missing ids, missing labels, unknown vocabulary, dangling ends, orphans."""
    kinds = ["file", "symbol", "function", "class", "method", "module", "document", "rationale", "code"]
    issue = lambda df, severity, kind, n=None: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), (n if n is not None else F.lit(1)).cast("long").alias("n"))
    ids = nodes.select("id").distinct()
    ends = links.select(F.col("source").alias("id")).unionAll(links.select(F.col("target").alias("id")))
    return (
        issue(nodes.groupBy("id").agg(F.count("*").alias("n")).where("id is not null and n > 1"), "error", "duplicate_id", F.col("n"))
        .unionByName(issue(nodes.where("id is null or id = ''"), "error", "missing_id"))
        .unionByName(issue(nodes.where("label is null or label = ''"), "warning", "missing_label"))
        .unionByName(issue(nodes.where(~F.col("file_type").isin(kinds)), "warning", "unknown_kind"))
        .unionByName(issue(links.where(~F.col("relation").isin([*RELATION_VIEWS, "rationale_for", "describes"])).select(F.col("relation").alias("id")).groupBy("id").agg(F.count("*").alias("n")), "warning", "unknown_relation", F.col("n")))
        .unionByName(issue(ends.join(ids, "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")), "error", "dangling", F.col("n")))
        .unionByName(issue(ids.where("id is not null").join(ends.distinct(), "id", "left_anti"), "warning", "orphan"))
    )
