"""A stored vector index: coarse cells, randomly rotated 4-bit codes, exact re-ranking.

Unit vectors are dealt to cells by their nearest centre; what remains of a vector beyond the centre is rotated, so that no
coordinate stands out, and each coordinate becomes one of 16 even steps within the vector's own range: half a byte for
eight of a double. With the codes goes the length of the error they make. A question's product with a vector is then
known up to that length, and a whole cell's up to its radius, so a search can be exact without reading most vectors:
cells that can't hold one of the first k aren't read, of the others codes only, and vectors just of rows whose best
possible product reaches the k-th of the surely possible ones. With ``probe`` it reads that many cells a question and no
more, which misses what lies elsewhere.

Centres are fitted on a sample of ``SAMPLE`` vectors, those of the smallest hashes of ids; all rows are indexed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..base import cut
from .retrieval import cosine

#: Vectors on which the centres are fitted, centres at most, and rounds of fitting.
SAMPLE, CELLS, FIT_ROUNDS = 20_000, 4_096, 12
#: Cells read first for each question; rounding of the scores that are compared.
FIRST_CELLS, ROUNDING = 3, 2e-6
SEED = 7
#: The cell of vectors without a direction or of another length, which score 0.
NOWHERE = -1


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """n unit centres by rounds of assigning and averaging; a centre that gets nothing stays."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(FIT_ROUNDS):
        own = np.argmax(sample @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(length > 0, sums / np.maximum(length, 1e-300), out)
    return out


def encode(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of two coordinates a byte, range, length of the error) of each row."""
    most = np.abs(rest).max(axis=1, initial=0.0)
    step = np.clip(np.rint((rest / np.maximum(most, 1e-300)[:, None] + 1) * 7.5), 0, 15).astype(np.uint8)
    if step.shape[1] % 2:
        step = np.pad(step, ((0, 0), (0, 1)), constant_values=0)
    codes = step[:, ::2] << 4 | step[:, 1::2]
    error = np.linalg.norm(rest - decode(codes, most, rest.shape[1]), axis=1)
    return codes, most, error * (1 + 1e-9) + 1e-12


def decode(codes: np.ndarray, most: np.ndarray, d: int) -> np.ndarray:
    step = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :d]
    return (step / 7.5 - 1) * most[:, None]


class VectorIndex:
    """An index at a path of the shared file system, of rows (id, vector)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Indexes all rows. Vectors that are null, zero or of another length than most score 0 with any question."""
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        sizes = rows.where("v is not null").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        d, n = (sizes[0].d, sizes[0].n) if sizes else (0, 0)
        picked = rows.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"] if n else []
        sample = np.array([np.asarray(v, float) for v in picked]).reshape(len(picked), d)
        length = np.linalg.norm(sample, axis=1)
        sample = sample[length > 0] / length[length > 0, None]
        count = min(cells or max(1, math.isqrt(n)), CELLS, len(sample))
        middle = centres(sample, count) if count else np.zeros((0, d))
        turn = rotation(d) if d else np.zeros((0, 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                given = b.column("v").to_pylist()
                unit = np.array([v if v is not None and len(v) == d and None not in v else [0.0] * d for v in given], float).reshape(len(given), d)
                norm = np.linalg.norm(unit, axis=1)
                there = np.isfinite(norm) & (norm > 0) & (len(middle) > 0)
                unit = np.where(there[:, None], unit / np.where(there, norm, 1.0)[:, None], 0.0)
                cell = np.argmax(unit @ middle.T, axis=1) if len(middle) else np.zeros(len(unit), np.int64)
                rest = (unit - middle[cell]) @ turn.T if len(middle) else unit
                codes, most, error = encode(rest)
                far = np.linalg.norm(rest, axis=1) * (1 + 1e-9) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(there, cell, NOWHERE), pa.int32()), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (most, error, far)), b.column("v")],
                    names=["cell", "id", "code", "most", "error", "far", "v"],
                )

        kind = dict(rows.dtypes)["id"]
        coded = rows.mapInArrow(run, f"cell int, id {kind}, code binary, most double, error double, far double, v array<double>")
        dealt = cut(coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
        small = {"parquet.block.size": 1 << 20}
        dealt.select("cell", "id", "code", "most", "error").write.options(**small).parquet(f"{self.path}/codes")
        dealt.select("cell", "id", "v").write.options(**small).parquet(f"{self.path}/vectors")
        radius = {r.cell: (r.far, r.n) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # CELLS rows at most
        state = {"d": d, "cells": [[*radius.get(c, (0.0, 0)), *middle[c].tolist()] for c in range(len(middle))], "nowhere": radius.get(NOWHERE, (0.0, 0))[1]}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.json(f"{self.path}/state")
        return self

    def search(self, queries: dict[int, list[float]], k: int = 10, probe: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, score, distance) of the k nearest rows by cosine, rounded to six digits, ties by id.

        Exact, unless ``probe`` names a number of cells. ``allowed`` (id) restricts the rows.
        """
        state = json.loads(self.spark.read.schema("state string").json(f"{self.path}/state").first().state)
        d = state["d"]
        names = [q for q, v in queries.items() if len(v) == d and np.linalg.norm(v) > 0]
        asked = np.array([queries[q] for q in names], float).reshape(len(names), d)
        asked /= np.linalg.norm(asked, axis=1, keepdims=True) if len(names) else 1.0
        table = np.array([c[2:] for c in state["cells"]], float).reshape(len(state["cells"]), d)
        radius, sizes = (np.array([c[i] for c in state["cells"]], float) for i in (0, 1))
        middle = asked @ table.T  # questions by cells
        upper = np.where(sizes > 0, middle + radius, -np.inf)
        turned = asked @ rotation(d).T if d else asked
        nearest = np.argsort(-upper, axis=1, kind="stable")
        wanted = np.zeros(middle.shape, bool)
        if len(names) and len(table):
            np.put_along_axis(wanted, nearest[:, : probe or FIRST_CELLS], True, axis=1)
        wanted &= sizes > 0
        first = self._near(wanted, names, middle, turned, d, k, allowed)
        parts = [first] if first is not None else []
        if probe is None and len(names) and len(table):
            floor = self._floor(first, names, k)
            more = (upper >= (floor - ROUNDING)[:, None]) & ~wanted & (sizes > 0)
            if (other := self._near(more, names, middle, turned, d, k, allowed)) is not None:
                parts.append(other)
        found = None
        for p in parts:
            found = p if found is None else found.unionByName(p)
        asks = self.spark.createDataFrame([(q, list(map(float, v))) for q, v in queries.items()], "query_id int, q array<double>")
        vectors = self.spark.read.parquet(f"{self.path}/vectors")
        if found is not None:
            floor = self._floor(found, names, k)
            least = F.create_map(*[x for q, f in zip(names, floor.tolist()) for x in (F.lit(q), F.lit(f - ROUNDING))])
            kept = cut(found.where(F.col("high") >= least[F.col("query_id")]).select("query_id", "cell", "id").distinct())
            held = [r.cell for r in kept.select("cell").distinct().collect()]
            ranked = vectors.where(F.col("cell").isin(held)).join(kept, ["cell", "id"])
        else:
            ranked = vectors.where("false").withColumn("query_id", F.lit(0))
        ranked = ranked.select("query_id", "id", "v")
        if probe is None:  # rows and questions without a direction score 0, which may be enough
            zero = vectors.where(F.col("cell") == NOWHERE) if allowed is None else vectors.where(F.col("cell") == NOWHERE).join(allowed.select("id"), "id", "left_semi")
            ranked = ranked.unionByName(zero.crossJoin(F.broadcast(asks.where(F.col("query_id").isin(names)).select("query_id"))).select("query_id", "id", "v"))
            idle = asks.where(~F.col("query_id").isin(names)).select("query_id")
            if len(names) < len(queries):
                every = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
                ranked = ranked.unionByName(every.orderBy("id").limit(k).crossJoin(F.broadcast(idle)).select("query_id", "id", "v"))
        scored = ranked.join(F.broadcast(asks), "query_id").select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("query_id", "id", "rank", "score", F.round(1 - F.col("score"), 6).alias("distance"))

    def _floor(self, found: DataFrame | None, names: list[int], k: int) -> np.ndarray:
        """The k-th greatest sure product of each question; none: minus infinity."""
        out = dict.fromkeys(names, -math.inf)
        if found is not None:
            order = Window.partitionBy("query_id").orderBy(F.desc("low"))
            for r in found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).collect():  # a row a question
                out[r.query_id] = r.low
        return np.array([out[q] for q in names])

    def _near(self, wanted: np.ndarray, names: list[int], middle: np.ndarray, turned: np.ndarray, d: int, k: int, allowed: DataFrame | None) -> DataFrame | None:
        """(query_id, cell, id, low, high): bounds of products in the wanted cells (questions by cells), less those surely beyond the first k."""
        cells = np.nonzero(wanted.any(axis=0))[0].tolist()
        if not cells:
            return None
        rows = self.spark.read.parquet(f"{self.path}/codes").where(F.col("cell").isin(cells))
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        kind = dict(rows.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell, error = b.column("cell").to_numpy(), b.column("error").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                product = decode(codes, b.column("most").to_numpy(), d) @ turned.T + middle[:, cell].T
                for i, q in enumerate(names):
                    mine = np.nonzero(wanted[i, cell])[0]
                    low, high = product[mine, i] - error[mine], product[mine, i] + error[mine]
                    if len(mine) > k:
                        kept = high >= np.partition(low, -k)[-k] - ROUNDING
                        mine, low, high = mine[kept], low[kept], high[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), q), pa.int32()), b.column("cell").take(pa.array(mine)), b.column("id").take(pa.array(mine)), pa.array(low), pa.array(high)], names=["query_id", "cell", "id", "low", "high"])

        return cut(rows.select("cell", "id", "code", "most", "error").mapInArrow(run, f"query_id int, cell int, id {kind}, low double, high double"))
