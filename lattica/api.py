"""One object for a project's index and memory: load, search, ask, learn; a thin layer over the operators.

Everything an ``Index`` holds is a table; methods give tables, or a new ``Index`` where something was learned.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as C
from .operators import context, evaluation, feedback, governance, graph, memory, nodes as N, retrieval
from .sources import ir, scip

# The default configuration, and questions that a benchmark asks.
DEFAULTS = {"backend": "auto", "namespace": None, "search": {"hits": 4, "candidates": 10, "bm25": True}, "memory": {"inject": True, "depth": C.SPREAD_DEPTH, "top_k": C.SPREAD_TOP_K}, "structure": {"inject": True}}
QUESTIONS = ["How does authentication work?", "What are the main API endpoints?", "How is the database structured?", "What frontend components exist?", "How are errors handled?"]


def merged(config: dict | None, defaults: dict | None = None) -> dict:
    """``config`` over the defaults, table by table."""
    out = deepcopy(DEFAULTS if defaults is None else defaults)
    for k, v in (config or {}).items():
        out[k] = merged(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Backend(Protocol):
    """What finds nodes for questions (query_id, question): hits (query_id, id, score, rank)."""

    def search(self, nodes: DataFrame, questions: list[tuple[int, str]], k: int) -> DataFrame: ...


class Lexical:
    """BM25 over node texts."""

    def search(self, nodes: DataFrame, questions: list[tuple[int, str]], k: int) -> DataFrame:
        from .functions.text import code_tokens

        spark = nodes.sparkSession
        rows = spark.createDataFrame(questions, "query_id int, question string").select("query_id", code_tokens(F.col("question")).alias("t")).collect()
        asked = {r["query_id"]: list(r["t"]) for r in rows if r["t"]}
        if not asked:
            return nodes.select(F.lit(0).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        found = retrieval.bm25_many(nodes, asked, k, "id", "text")
        return found.select(F.col("query_id").cast("int").alias("query_id"), "id", "score", "rank")


class Vectors:
    """Cosine of node vectors (id, embedding) with the vectors that ``embed`` gives for questions."""

    def __init__(self, vectors: DataFrame, embed: Callable[[str], list[float]]):
        self.vectors, self.embed = vectors, embed

    def search(self, nodes: DataFrame, questions: list[tuple[int, str]], k: int) -> DataFrame:
        spark, out = nodes.sparkSession, None
        own = self.vectors.join(nodes.select("id"), "id", "left_semi")
        for q, text in questions:
            one = spark.createDataFrame([(self.embed(text),)], "q array<double>")
            part = retrieval.vector_search(own, one, k, id_col="id").select(F.lit(q).alias("query_id"), "id", "score", "rank")
            out = part if out is None else out.unionByName(part)
        return out


class Hybrid:
    """Two backends joined by reciprocal ranks."""

    def __init__(self, first: Backend, second: Backend):
        self.parts = (first, second)

    def search(self, nodes: DataFrame, questions: list[tuple[int, str]], k: int) -> DataFrame:
        from pyspark.sql import Window

        a, b = (p.search(nodes, questions, k) for p in self.parts)
        both = a.unionByName(b).groupBy("query_id", "id").agg(F.sum(1.0 / (C.RRF_K + F.col("rank"))).alias("s"))
        order = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
        best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("query_id", "id", (F.col("s") / F.max("s").over(Window.partitionBy("query_id"))).alias("score"), "rank")


def resolved_backend(name: str, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> Backend:
    """The backend of a name: lexical, vectors, hybrid, or auto, which is hybrid where there are vectors."""
    if name == "auto":
        name = "hybrid" if vectors is not None and embed is not None else "lexical"
    if name == "lexical":
        return Lexical()
    if name not in ("vectors", "hybrid"):
        raise ValueError(f"no such backend: {name}")
    if vectors is None or embed is None:
        raise ValueError(f"{name} needs vectors and a function that makes them")
    return Vectors(vectors, embed) if name == "vectors" else Hybrid(Vectors(vectors, embed), Lexical())


@dataclass(frozen=True)
class Index:
    """A project: nodes (id, label, file_type, source_file, source_location, community, norm_label), links, and what was learned."""

    name: str
    nodes: DataFrame
    links: DataFrame
    synapses: DataFrame
    transitions: DataFrame
    backend: Backend
    config: dict

    @classmethod
    def load(cls, spark, path: str, name: str, synapses: DataFrame, transitions: DataFrame, config: dict | None = None) -> Index:
        """The index of a graph document, with a memory."""
        n, e = ir.read_document(spark, path)
        nodes = n.select("id", "label", F.when(F.col("raw_kind") != "", F.col("raw_kind")).otherwise("code").alias("file_type"), "source_file", F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"), F.col("cluster").alias("community"), "norm_label")
        settings = merged(config)
        return cls(name, nodes, e, synapses, transitions, resolved_backend(settings["backend"]), settings)

    def switched(self, backend: Backend) -> Index:
        return replace(self, backend=backend)

    @property
    def texts(self) -> DataFrame:
        return self.nodes.withColumn("text", N.node_text())

    def search(self, questions: list[tuple[int, str]], k: int) -> DataFrame:
        """Hits (query_id, id, score, rank) of questions (query_id, question)."""
        return self.backend.search(self.texts, questions, k)

    def energy(self, hits: DataFrame, seeds: int = C.SYNAPSE_SEEDS) -> DataFrame:
        """(query_id, id, energy): what the memory ties to each question's first hits."""
        first = hits.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("node"))
        out = None
        for q in [r[0] for r in first.select("query_id").distinct().collect()]:  # one row a question asked
            part = memory.spread(self.synapses, first.where(F.col("query_id") == q).select("node", F.lit(1.0).alias("energy")), self.config["memory"]["depth"], self.config["memory"]["top_k"]).select(F.lit(q).alias("query_id"), F.col("node").alias("id"), "energy")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else first.select("query_id", F.col("node").alias("id"), F.lit(0.0).alias("energy")).limit(0)

    def structure(self, hits: DataFrame, seeds: int = C.SYNAPSE_SEEDS) -> DataFrame:
        """(query_id, id, energy): the nodes wired to each question's first hits, by their best view weight."""
        first = hits.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("node"))
        weight = F.element_at(F.create_map(*[x for v, w in C.VIEW_WEIGHTS.items() for x in (F.lit(v), F.lit(w))]), F.col("view"))
        v = graph.views(self.links).where(F.col("view").isin(list(C.VIEW_WEIGHTS)))
        found = first.join(v, "node").select("query_id", F.col("other").alias("id"), weight.alias("energy"))
        return found.groupBy("query_id", "id").agg(F.max("energy").alias("energy")).join(first.withColumnRenamed("node", "id"), ["query_id", "id"], "left_anti")

    def hits(self, questions: list[tuple[int, str]]) -> DataFrame:
        """The hits shown for questions: found, lifted by structure and memory, and weighed by intent."""
        spark, nodes = self.nodes.sparkSession, self.nodes
        found = self.search(questions, self.config["search"]["hits"])
        wired, known = found, None
        if self.config["structure"]["inject"]:
            s = context.lifted(found, self.structure(found), C.STRUCTURAL_BOOST, C.PULL_IN_MAX, 0.0)
            wired, known = s.select("query_id", "id", "score", "rank"), s.select("query_id", "id", F.col("lift").alias("structural"), F.col("pulled").alias("wired"))
        if self.config["memory"]["inject"]:
            m = context.lifted(wired, self.energy(wired), C.SYNAPSE_BOOST, C.PULL_IN_MAX, C.PULL_IN_ENERGY)
        else:
            m = wired.withColumn("lift", F.lit(0.0)).withColumn("pulled", F.lit(False))
        rows = m.join(known, ["query_id", "id"], "left") if known is not None else m.withColumn("structural", F.lit(0.0)).withColumn("wired", F.lit(False))
        rows = rows.select("query_id", "id", "score", "rank", F.col("lift").alias("synapse"), F.coalesce("structural", F.lit(0.0)).alias("structural"), F.when(F.coalesce("wired", F.lit(False)), "structural").when(F.col("pulled"), "synapse").otherwise("").alias("pulled"))
        asked = spark.createDataFrame(questions, "query_id int, question string")
        return context.weighed(rows, asked, nodes)

    def query(self, questions: list[tuple[int, str]]) -> DataFrame:
        """The context of each question (see ``context.assembled``)."""
        asked = self.nodes.sparkSession.createDataFrame(questions, "query_id int, question string")
        found = self.search(questions, self.config["search"]["candidates"])
        areas = context.area_scores(found, self.nodes, self.energy(found))
        return context.assembled(asked, context.layer_identity(self.nodes, self.name), context.layer_summary(self.nodes), context.layer_areas(areas, self.texts), context.layer_hits(self.hits(questions), self.texts))

    def wakeup(self) -> DataFrame:
        """One row (text): who the project is and its clusters."""
        a, b = context.layer_identity(self.nodes, self.name), context.layer_summary(self.nodes).select(F.col("text").alias("more"))
        return a.crossJoin(F.broadcast(b)).select(F.concat_ws("\n", "text", "more").alias("text"))  # one row each

    def asked(self, questions: list[tuple[int, str]], now: float, namespace: str = "personal") -> tuple[DataFrame, Index]:
        """``query``, and the index after its hits and areas fired together."""
        hits, answer = self.hits(questions), self.query(questions)
        loaded = answer.select("query_id", F.explode("communities").alias("community"))
        return answer, replace(self, synapses=memory.reinforce(self.synapses, feedback.query_batches(hits, loaded, F.lit(now), namespace)))

    def benchmark(self, questions: list[str] | None = None) -> DataFrame:
        return context.benchmark(self.query(list(enumerate(questions or QUESTIONS))))

    def probe(self, size: int = 50, k: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """Retrieval means over the project's own symbols asked for by what they do, and those whose file isn't found."""
        sample = N.probe_sample(self.nodes, N.rationales(self.nodes, self.links), size, seed)
        asked = [(i, r["id"], r["query"], r["source_file"]) for i, r in enumerate(sample.select("id", "query", "source_file").collect())]  # ``size`` rows
        spark = self.nodes.sparkSession
        of = spark.createDataFrame([(i, n, f) for i, n, _, f in asked], "query_id int, id string, file string")
        found = self.search([(i, q) for i, _, q, _ in asked], k).join(self.nodes.select("id", F.col("source_file").alias("item")), "id").select("query_id", "rank", "item")
        ranked = evaluation.first_occurrences(found)
        per = evaluation.per_query(ranked, of.select("query_id", F.col("file").alias("item")), (1, 3, 5))
        by_id = ranked.join(of.select("query_id", "id"), "query_id").select(F.col("id").alias("query_id"), "rank", "item")
        return evaluation.summary(per), N.blind_spots(sample, by_id, k)

    def files_reinforced(self, paths: list[str], now: float, strength: float = 1.0, namespace: str = "personal") -> Index:
        """The index after files were edited together, in that order."""
        edits = self.nodes.sparkSession.createDataFrame([("edit", i, p, now, namespace) for i, p in enumerate(paths)], "batch string, pos int, path string, ts double, namespace string")
        s, t = feedback.activate_files(self.synapses, self.transitions, self.nodes, edits, strength)
        return replace(self, synapses=s, transitions=t)

    def controls_reinforced(self, notes: DataFrame, now: float, namespace: str = "personal") -> Index:
        """The index after controls (path, framework, control) were found in files: each fires with the nodes of its file."""
        key = governance.control_key(F.col("control"), F.col("framework"))
        of = notes.select(N.plain_path(F.col("path")).alias("p"), key.alias("key")).distinct()
        mine = of.join(self.nodes.select(N.plain_path(F.col("source_file")).alias("p"), "id"), "p")
        batch = F.concat_ws("|", "p", "key")
        rows = mine.select(batch.alias("batch"), F.col("id").alias("node")).unionByName(mine.select(batch.alias("batch"), F.col("key").alias("node"))).distinct()
        return replace(self, synapses=memory.reinforce(self.synapses, rows.select("batch", "node", F.lit(now).alias("ts"), F.lit(namespace).alias("namespace"))))

    def refined(self, files: DataFrame, enabled: bool = True) -> Index:
        """The index with calls and bases that SCIP index files (content bytes) prove."""
        return replace(self, links=scip.refined(self.nodes, self.links, files)[0]) if enabled else self
