"""Population tuning of bounded parameters: candidates, fitness over queries, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..base import cut
from . import evaluation

# Name, least, most and default of the tuned parameters; those with whole bounds and default are whole numbers.
PARAMETERS = [
    ("SYNAPSE_SEED_K", 1, 10, 3),
    ("SYNAPSE_BOOST_WEIGHT", 0.0, 2.0, 0.3),
    ("SYNAPSE_PULL_IN_MAX", 0, 5, 2),
    ("SYNAPSE_PULL_IN_MIN_ENERGY", 0.01, 0.5, 0.15),
    ("STRUCTURAL_SEED_K", 1, 10, 3),
    ("STRUCTURAL_BOOST_WEIGHT", 0.0, 2.0, 0.35),
    ("STRUCTURAL_PULL_IN_MAX", 0, 5, 2),
    ("L0_MAX_TOKENS", 50, 300, 150),
    ("L1_MAX_TOKENS", 200, 1000, 600),
    ("L2_MAX_TOKENS", 400, 1500, 800),
    ("L3_MAX_TOKENS", 500, 2000, 1000),
    ("SPREAD_DEPTH", 1, 5, 2),
    ("SPREAD_DECAY", 0.1, 1.0, 0.6),
    ("SPREAD_TOP_K", 3, 30, 12),
    ("STRUCTURAL_HUB_DEGREE", 10, 100, 50),
    ("DECAY_RATE_MIN", 1.0, 30.0, 3.0),
    ("DECAY_RATE_MAX", 30.0, 365.0, 120.0),
]


def effective(stored: dict[str, float] | None = None) -> dict[str, float]:
    """All parameters: defaults, overlaid by known ``stored`` ones within their bounds."""
    return {name: type(default)(max(low, min(high, (stored or {}).get(name, default)))) for name, low, high, default in PARAMETERS}


def live_quality(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row (queries, quality, health) of results (query, id) for fixtures (query, expected array): the share of questions that find an expected node (or, with none expected, anything), and that find anything."""
    got = results.groupBy("query").agg(F.collect_set("id").alias("ids"))
    j = fixtures.join(got, "query", "left")
    hit = F.when(F.size("expected") > 0, F.arrays_overlap("expected", "ids")).otherwise(F.col("ids").isNotNull())
    return j.agg(F.count("*").alias("queries"), F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("quality"), F.avg(F.col("ids").isNotNull().cast("int")).alias("health"))


def search_depth(parameters: dict[str, float]) -> int:
    """How many hits a candidate's evaluation looks at."""
    return max(10, 5 * max(round(parameters.get("STRUCTURAL_SEED_K", 3)), round(parameters.get("SYNAPSE_SEED_K", 3))))


def candidates(spark: SparkSession, n: int, incumbent: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(candidate, name, value): the incumbent as 0, and n perturbations with a sixth of each range as deviation, clamped.

    Deviations come from hashes of seed, candidate and name (Box-Muller), so that reruns agree.
    """
    incumbent = incumbent or {}
    rows = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.lit(float(incumbent.get(p, d))).alias("centre")) for p, a, b, d in PARAMETERS])
    out = spark.range(n + 1).select(F.col("id").alias("candidate"), F.explode(rows).alias("p")).select("candidate", "p.*")
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "candidate", "name"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(6.283185307179586 * uniform(2))
    value = F.when(F.col("candidate") == 0, F.col("centre")).otherwise(F.greatest("low", F.least("high", F.col("centre") + normal * (F.col("high") - F.col("low")) / 6)))
    return out.select("candidate", "name", value.alias("value"))


def scored(runs: DataFrame) -> DataFrame:
    """(candidate, quality, efficiency, fitness) of runs (candidate, query_id, hit 0/1, health, tokens, baseline_tokens)."""
    per = runs.groupBy("candidate").agg(F.avg("hit").alias("quality"), F.avg("health").alias("health"), F.least(F.lit(10.0), F.sum("baseline_tokens") / F.sum("tokens")).alias("efficiency"))
    return per.select("candidate", "quality", "efficiency", evaluation.fitness(F.col("quality"), F.col("health"), F.col("efficiency")).alias("fitness"))


def wide(candidates: DataFrame) -> DataFrame:
    """candidates (candidate, name, value) as one row each, a column a parameter; what a candidate doesn't name has its default."""
    return candidates.groupBy("candidate").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(float(d))).alias(n) for n, _, _, d in PARAMETERS])


def sweep(hits: DataFrame, energy: DataFrame, relevant: DataFrame, costs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Runs (candidate, query_id, hit, health, tokens, baseline_tokens) of all ``candidates`` over the same evidence.

    Evidence is made once: hits (query_id, id, score, rank), what the memory adds to them (query_id, id, energy), which are
    relevant (query_id, id) and what each costs (id, tokens). A candidate lifts the hits beyond its first SYNAPSE_SEED_K by
    SYNAPSE_BOOST_WEIGHT times their energy, and takes the best, ties by id, as long as they fit in L3_MAX_TOKENS, the first
    in any case. Found: a relevant one is among those taken. The baseline takes all hits. Questions without hits give no run.
    """
    rows = hits.select("query_id", "id", "score", "rank").join(energy.select("query_id", "id", "energy"), ["query_id", "id"], "left")
    rows = rows.join(relevant.select("query_id", "id").distinct().withColumn("good", F.lit(1)), ["query_id", "id"], "left").join(costs.select("id", "tokens"), "id")
    evidence = cut(rows.select("query_id", "id", "score", "rank", F.coalesce("energy", F.lit(0.0)).alias("energy"), F.coalesce("good", F.lit(0)).alias("good"), "tokens"))
    tried = wide(candidates).select("candidate", "SYNAPSE_SEED_K", "SYNAPSE_BOOST_WEIGHT", "L3_MAX_TOKENS")
    each = evidence.crossJoin(F.broadcast(tried))  # every candidate is tried on all evidence: a row a candidate
    lifted = F.col("score") + F.when(F.col("rank") > F.round("SYNAPSE_SEED_K"), F.col("SYNAPSE_BOOST_WEIGHT") * F.col("energy")).otherwise(0.0)
    order = Window.partitionBy("candidate", "query_id").orderBy(F.desc(F.round(lifted, 9)), "id")
    placed = each.withColumn("place", F.row_number().over(order)).withColumn("spent", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = (F.col("place") == 1) | (F.col("spent") <= F.col("L3_MAX_TOKENS"))
    return placed.groupBy("candidate", "query_id").agg(
        F.max(F.when(taken, F.col("good")).otherwise(0)).alias("hit"), F.lit(1.0).alias("health"), F.sum(F.when(taken, F.col("tokens")).otherwise(0)).alias("tokens"), F.sum("tokens").alias("baseline_tokens")
    )


def generation(scores: DataFrame, hysteresis: float = 0.05) -> DataFrame:
    """One row (best, fitness, incumbent, decision): the fittest candidate, promoted over candidate 0 past the hysteresis."""
    row = scores.agg(F.max(F.struct("fitness", (-F.col("candidate")).alias("m"))).alias("b"), F.max(F.when(F.col("candidate") == 0, F.col("fitness"))).alias("incumbent"))
    row = row.select((-F.col("b.m")).alias("best"), F.col("b.fitness").alias("fitness"), "incumbent")
    return row.withColumn("decision", evaluation.decide(F.col("fitness"), F.col("incumbent"), F.lit("promote"), hysteresis))


def widths(users: DataFrame, current: Column, rate: Column, margin: Column) -> DataFrame:
    return users.withColumn("width", evaluation.recall_width(current, rate, margin))
