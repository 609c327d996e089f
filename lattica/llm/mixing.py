"""Mixing sources to target weights by capped water-filling (operator 7).

Every source gets a target in words: its share of the total by weight, but at most ``max_epochs``
times its own words; what a cap cuts off is shared again by weight until no target is above its
cap. The level is found in closed form over sources ordered by cap / weight.

A target is met with whole repetitions of every document of the source and one seeded fractional
repetition: documents fall into hash buckets by id, buckets are taken in order until the target,
and the documents of the last, partly taken bucket give the same fraction of their words each.
Only (source, bucket) sums are ordered, never documents, so a source that holds a third of all
rows is pre-aggregated before the shuffle and spread over its buckets after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Hex digits of the bucket number: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def bucket_of(id_col: str, seed: str = SEED) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BUCKET_DIGITS), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null a source of its own, last.

    ``weights`` repeat over the sources in code-point order; ``share`` is the mix's size in parts of all words.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("weight_left"))
        .withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("nth"))).over(every))
        .withColumn("level", F.max(F.when(F.col("nth") == F.col("at"), F.col("level"))).over(every))
    )
    target = F.when(F.col("at").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3, share: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    Null and empty texts have size 0 and are taken 0 times; a null source is a source; a null id counts
    as an empty one; repeated rows are rows of their own. Columns of ``docs`` with the added names are
    replaced. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.drop("size", "source_size", "target", "taken").withColumn("size", size)
    key = [F.col(source_col).alias("source"), bucket_of(id_col, seed).alias("bucket")]
    sums = cut(rows.groupBy(*key).agg(F.sum("size").alias("bucket_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs, share)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(
        sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.least(F.greatest(F.col("target") - F.col("whole") * F.col("source_size") - F.col("before"), F.lit(0.0)), F.col("bucket_size").cast("double")))
        .select(F.col("b.source").alias("__mix_source"), F.col("bucket").alias("__mix_bucket"), F.col("bucket_size").alias("__mix_bucket_size"), "source_size", "target", F.col("whole").alias("__mix_whole"), F.col("part").alias("__mix_part"))
    )
    n = plan.count()
    part = F.when(F.col("__mix_bucket_size") > 0, F.floor(F.col("size") * F.col("__mix_part") / F.col("__mix_bucket_size"))).otherwise(0)
    return (
        rows.withColumn("__mix_b", bucket_of(id_col, seed))
        .join(small(plan, n), F.col(source_col).eqNullSafe(F.col("__mix_source")) & (F.col("__mix_b") == F.col("__mix_bucket")))
        .withColumn("taken", (F.col("__mix_whole") * F.col("size") + part).cast("long"))
        .drop("__mix_source", "__mix_bucket", "__mix_bucket_size", "__mix_whole", "__mix_part", "__mix_b")
    )


#: DuckDB SQL for the query's rows.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {BUCKET_DIGITS}))::INT AS bucket
  FROM documents),
b AS (SELECT source, bucket, sum(size)::BIGINT AS bucket_size FROM d GROUP BY ALL),
s AS (SELECT source, sum(bucket_size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM w),
l AS (SELECT *, row_number() OVER o AS nth, ratio,
        (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
g AS (SELECT *, (SELECT arg_min(level, nth) FROM l WHERE level <= ratio) AS water FROM l),
t AS (SELECT source, source_size,
        CASE WHEN water IS NULL OR ratio < water THEN cap::DOUBLE ELSE least(water * weight, cap::DOUBLE) END AS target FROM g),
p AS (SELECT b.source, b.bucket, b.bucket_size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
        coalesce(sum(b.bucket_size) OVER (PARTITION BY b.source ORDER BY b.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, least(greatest(target - (whole * source_size)::DOUBLE - before::DOUBLE, 0.0::DOUBLE), bucket_size::DOUBLE) AS part FROM p)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (q.whole * d.size + CASE WHEN q.bucket_size > 0 THEN floor(d.size::DOUBLE * q.part / q.bucket_size::DOUBLE) ELSE 0 END)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.bucket = q.bucket
"""
