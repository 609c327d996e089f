"""What the operators of this subpackage share: table access, stored intermediate tables, connected components, links under keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a two-column table of numbers counts as small enough to broadcast (about 3 MB).
BROADCAST_ROWS = 100_000
#: Spark's setting by which the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows that go to a Python worker at once, and how many they are at most while ``cut`` writes: whole texts go along.
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: How ``cut`` stores tables, unless told otherwise.
_CODEC = ContextVar("codec", default="snappy")


@contextmanager
def stored_as(codec: str) -> Iterator[None]:
    """Within it, ``cut`` stores tables with that codec."""
    before = _CODEC.set(codec)
    try:
        yield
    finally:
        _CODEC.reset(before)


def cut(df: DataFrame, observed: Observation | None = None, *metrics: Column) -> DataFrame:
    """``df`` with its lineage cut: written as Parquet to the shared folder and read again.

    The shuffle files behind it go as soon as it is written. The table goes by ``drop``, or at the end of the
    session for those that a lazy result still reads. ``observed`` takes ``metrics`` of the rows on the way.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    most = int(spark.conf.get(ARROW))
    before = {CLEANUP: spark.conf.get(CLEANUP, None), ARROW: str(most)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(ARROW, str(min(most, ARROW_ROWS) if most > 0 else ARROW_ROWS))  # 0 and less: no bound
    try:
        rows = df.observe(observed, *metrics) if observed is not None else df.select("*")  # a plan of its own, made under the setting
        rows.write.option("compression", _CODEC.get()).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("_stored_at", None)):
            target, fs = _path(t.sparkSession, path)
            fs.delete(target, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``rows``, the counted size of ``df``, is within the bound; else the planner decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), stored; component is the smallest node reachable.

    Alternating large-star and small-star rounds. A large star is a grouped minimum (combined before the
    shuffle) and a join, so a node with very many greater neighbours is never gathered in one place; a small
    star is a window over a node's smaller neighbours, which are few. Edges stay in executors; the driver gets
    a count and a digest a round. Empty edges give no rows. Raises if ``max_rounds`` don't do, rather than to
    return parts of components.
    """

    def marked(rows: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut(rows, seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
        got = seen.get
        return out, (got["n"], got["h"])

    e, digest = marked(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if not digest[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # a node's smaller neighbours, of which the large star has left the least of each of its neighbourhoods
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small_star = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, before = e, digest
        e, digest = marked(small_star)
        drop(last)
        if digest == before:
            break
    else:
        raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
    out = cut(
        e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
            e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        )
    )
    drop(e)
    return out


#: Rows under one key from which the key counts as hot, unless the caller gives another number.
HOT_KEY = 64


def _pair() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def bucket_links(index: DataFrame, probe: DataFrame, radius: int, verify: Callable[[DataFrame], DataFrame] | None = None, hot_rows: int = HOT_KEY) -> DataFrame:
    """(a, b) of ids that share a key between ``index`` and ``probe`` (key, id, bits) and are alike; stored.

    Alike: their 64 ``bits`` differ in at most ``radius`` places and, if given, ``verify`` keeps the
    pair (a function from a stored DataFrame (a, b) to a stored one of its rows). Complete up to connectivity: every
    alike pair under a key is a row, or both ids are connected by rows. ``index`` is read more than once and
    must be stored.

    Bits are compared inside the join, so only near pairs leave it. Under a hot key all rows are first
    linked to its smallest id only; after that, pairs that are already connected give no row, so large
    groups of near copies never give all their pairs. What remains under a hot key is dealt to narrower keys:
    bits cut into radius + 1 blocks have one equal in every pair within the radius, so nothing is missed,
    and unlike rows seldom meet.
    """

    def checked(found: DataFrame) -> DataFrame:
        pairs = cut(found.select(*_pair()).distinct())
        if verify is None:
            return pairs
        out = verify(pairs)
        drop(pairs)
        return out

    near = F.bit_count(F.col("abits").bitwiseXOR(F.col("bbits"))) <= radius
    ours = index.select("key", F.col("id").alias("a"), F.col("bits").alias("abits"))
    theirs = probe.select("key", F.col("id").alias("b"), F.col("bits").alias("bbits"))
    hot = cut(
        index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where(F.col("n") >= hot_rows).select("key", "a")
    )
    n_hot = hot.count()
    # the index side is hashed: without the hot keys' rows, a partition of it is as large as any other
    if not n_hot:
        drop(hot)
        return checked(ours.hint("shuffle_hash").join(theirs, "key").where(near & (F.col("a") != F.col("b"))))
    lead = ours.join(small(hot, n_hot), ["key", "a"]).select("key", "a", "abits").distinct()
    keys = small(hot.select("key"), n_hot)
    thinned = ours.join(keys, "key", "left_anti").unionByName(lead)
    first = checked(thinned.hint("shuffle_hash").join(theirs, "key").where(near & (F.col("a") != F.col("b"))))
    comp = connected_components(first)
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def dealt(rows: DataFrame, c: str) -> DataFrame:
        mine = rows.join(keys, "key", "left_semi").join(comp.withColumnRenamed("node", c), c, "left")
        part = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(f"{c}bits", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value")) for k, (low, high) in enumerate(zip(edges, edges[1:]))]
        return mine.select("key", c, f"{c}bits", F.coalesce("component", c).alias(f"{c}comp"), F.explode(F.array(*part)).alias("part")).select("key", "part.block", "part.value", c, f"{c}bits", f"{c}comp")

    mine, other = dealt(ours, "a"), dealt(theirs, "b")
    apart = near & (F.col("a") != F.col("b")) & (F.col("acomp") != F.col("bcomp"))
    rest = checked(mine.join(other, ["key", "block", "value"]).where(apart))
    out = cut(first.unionByName(rest))
    drop(first, rest, comp, hot)
    return out
