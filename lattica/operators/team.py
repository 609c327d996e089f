"""Sharing memories: contribution scores, conflict merge, peer review, bundles, staleness, sleep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def contribution(edges: DataFrame, now: float, conflicts: str | None = None, comparisons: str | None = None) -> DataFrame:
    """``edges`` with reinforcement, recency, conflict, score and class (promote, neutral, decay)."""
    rate = F.col(conflicts) / F.greatest(F.lit(1), F.col(comparisons)) if conflicts else F.lit(0.0)
    reinforcement = F.least(F.lit(1.0), F.log1p("activation_count") / F.log1p(F.lit(30.0)))
    recency = F.exp(-0.693 * F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_activated")) / C.DAY) / 30.0)
    out = edges.withColumn("reinforcement", reinforcement).withColumn("recency", recency).withColumn("conflict", rate)
    score = C.W_REINFORCEMENT * F.col("reinforcement") + C.W_RECENCY * F.col("recency") - C.W_CONFLICT * F.col("conflict")
    out = out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    return out.withColumn("class", F.when(F.col("score") >= C.QUALITY_HIGH, "promote").when(F.col("score") < C.QUALITY_LOW, "decay").otherwise("neutral"))


def loser_weight(score: Column, conflict: Column, penalty: float = 0.5) -> Column:
    return F.round(F.greatest(F.lit(0.01), score * F.greatest(F.lit(0.1), penalty - 0.3 * conflict)), 4)


def review(scored: DataFrame) -> DataFrame:
    """``scored`` edges with action and hint."""
    action = F.when(F.col("score") >= C.AUTO_PROMOTE, "auto_promote").when(F.col("score") < C.REJECT, "reject").otherwise("review_required")
    hint = F.concat_ws(", ", F.when(F.col("reinforcement") < 0.3, "low reinforcement"), F.when(F.col("recency") < 0.3, "stale"), F.when(F.col("conflict") > 0.5, "high conflict"))
    hint = F.when(F.col("action") == "review_required", F.when(hint == "", "marginal score").otherwise(hint)).otherwise("")
    return scored.withColumn("action", action).withColumn("hint", hint)


def conflict_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two scored bundles (source, target, score, activation_count): winner a, b or contest."""
    j = a.select("source", "target", F.col("score").alias("sa"), F.col("activation_count").alias("na")).join(b.select("source", "target", F.col("score").alias("sb"), F.col("activation_count").alias("nb")), ["source", "target"], "full_outer")
    weak = (F.col("sa") < C.CONTEST_BELOW) & (F.col("sb") < C.CONTEST_BELOW) & (F.abs(F.col("sa") - F.col("sb")) < C.CONTEST_GAP)
    winner = (
        F.when(F.col("sb").isNull(), "a").when(F.col("sa").isNull(), "b").when(weak, "contest")
        .when(F.col("sa") > F.col("sb"), "a").when(F.col("sb") > F.col("sa"), "b").when(F.col("na") >= F.col("nb"), "a").otherwise("b")
    )
    j = j.withColumn("winner", winner)
    return j.select("source", "target", "winner", F.when(F.col("winner") == "b", F.col("sb")).otherwise(F.col("sa")).alias("score"))


def bundle(synapses: DataFrame, most: int = 5000) -> DataFrame:
    """(source, target, weight, activation_count): personal and shared pairs by the greater weight, the heaviest ``most``."""
    rows = synapses.where(F.col("namespace").isin("personal", "shared")).groupBy(F.col("node_a").alias("source"), F.col("node_b").alias("target"))
    return rows.agg(F.max("weight").alias("weight"), F.max("activation_count").alias("activation_count")).orderBy(F.desc("weight"), "source", "target").limit(most)


def bundle_hash(rows: DataFrame) -> DataFrame:
    """One row, content_hash: a digest of the sorted rows of a bundle (bounded by its size), weights at 6 decimals."""
    line = F.concat_ws("|", "source", "target", F.format_string("%.6f", "weight"), F.col("activation_count").cast("string"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("content_hash"))


def stale_days(namespace: Column) -> Column:
    return F.when(namespace == "shared", C.STALE_DAYS["shared"]).when(namespace.startswith("branch:"), C.STALE_DAYS["branch"]).otherwise(C.STALE_DAYS["other"])


def stale(synapses: DataFrame, now: float) -> DataFrame:
    """Rows past their namespace's threshold, with age_days."""
    age = (F.lit(now) - F.col("last_activated")) / C.DAY
    return synapses.withColumn("age_days", age).where(age > stale_days(F.col("namespace")))


def fast_decay(rows: DataFrame) -> DataFrame:
    """Weights of stale rows multiplied by 2 to the minus 5 over the threshold."""
    return rows.withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), -C.FAST_DECAY / F.greatest(F.lit(1), stale_days(F.col("namespace")))))


def redundant(synapses: DataFrame, now: float, days: float = 60) -> DataFrame:
    """What sleep prunes: nearly weightless, hardly fired and old pairs."""
    old = now - days * C.DAY
    return synapses.where((F.col("weight") < C.PRUNE_THRESHOLD) & (F.col("activation_count") <= 1) & (F.col("last_activated") < old) & (F.col("created_at") < old))


def publishable(edges: DataFrame, enabled: Column, scope: Column, threshold: Column) -> DataFrame:
    """Whether governance lets an edge be shared."""
    return edges.withColumn("allowed", F.when(~enabled, True).when(scope == "personal", False).when(F.col("weight") < threshold, False).otherwise(True))
