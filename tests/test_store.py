"""The stored memory against the operators on whole tables, and what its operations read."""

import random

from pyspark.sql import functions as F

from lattica.base import fresh_folder
from lattica.operators import feedback, memory
from lattica.operators.store import SynapseStore
from lattica.plans import memory_queries, node_queries

NOW = 5_000_000.0


def made(spark, rng, n, first):
    rows = [(first + b, f"n{rng.randrange(40)}", float(rng.randrange(4_000_000)), ns) for b in range(n) for ns in [rng.choice(["personal", "shared", "ephemeral"])] for _ in range(rng.randrange(1, 6))]
    return spark.createDataFrame(rows, "batch bigint, node string, ts double, namespace string")


def plain(df):
    cols = [*memory.PAIR, "weight", "activation_count", "last_activated", "created_at"]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_operations_equal_those_on_tables(spark):
    rng = random.Random(1)
    store = SynapseStore.create(spark, fresh_folder(spark, "store") + "/s", buckets=8)
    assert store.synapses().count() == 0
    one, two = made(spark, rng, 30, 0), made(spark, rng, 20, 100)
    store.reinforce(one).reinforce(two)
    table = memory.reinforce(memory.reinforce(None, one), two).cache()
    assert plain(store.synapses()) == plain(table)
    seeds = spark.createDataFrame([("n1", 1.0), ("n2", 0.5)], "node string, energy double")
    want = [(r.node, round(r.energy, 9)) for r in memory.spread(table, seeds).collect()]
    assert [(r.node, round(r.energy, 9)) for r in store.spread(seeds).collect()] == want
    assert [tuple(r) for r in store.neighbors("n3").collect()] == [tuple(r) for r in memory.neighbors(table, "n3").collect()]
    some = spark.createDataFrame([("n1",), ("n7",)], "node string")
    store.decay(NOW, some)
    hit = F.col("node_a").isin("n1", "n7") | F.col("node_b").isin("n1", "n7")
    table = table.where(~hit).unionByName(memory.decay(table.where(hit), NOW, advance=True)).cache()
    assert plain(store.synapses()) == plain(table)
    store.decay(NOW * 2)
    assert plain(store.synapses()) == plain(memory.decay(table, NOW * 2, advance=True))
    store.reinforce(one.where("false"))
    assert plain(store.synapses()) == plain(memory.decay(table, NOW * 2, advance=True))


def test_a_small_batch_touches_its_buckets_only(spark):
    rng = random.Random(2)
    store = SynapseStore.create(spark, fresh_folder(spark, "store") + "/s", buckets=32)
    rows = [(b, f"m{rng.randrange(5_000)}", 1.0, "personal") for b in range(2_000) for _ in range(3)]
    store.reinforce(spark.createDataFrame(rows, "batch bigint, node string, ts double, namespace string"))
    before = store._state()
    batch = spark.createDataFrame([(1, "m1", 2.0, "personal"), (1, "m2", 2.0, "personal")], "batch bigint, node string, ts double, namespace string")
    store.reinforce(batch)
    after = store._state()
    changed = {b for b in after["at"] if after["at"][b] != before["at"].get(b)}
    assert len(changed) <= 2 < len(before["at"])
    read = store._rows(after, [int(b) for b in changed])
    assert read.count() < store._rows(after).count() / 8
    assert {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} == changed
    assert {f"{x.node_a}{x.node_b}" for x in store.synapses().where("last_activated = 2").collect()} == {"m1m2"}


def test_pairs_of_large_batches(spark, monkeypatch):
    rows = [(b, k, float(k), "shared") for b, n in ((1, 37), (2, 3), (3, 1), (None, 4)) for k in range(n)] + [(2, None, 0.0, "shared")]
    nodes = spark.createDataFrame(rows, "batch bigint, node bigint, ts double, namespace string")
    want = {(b, x, y) for b, n in ((1, 37), (2, 3)) for y in range(n) for x in range(y)}
    for size in (1_000, 5):
        monkeypatch.setattr(memory, "BLOCK_NODES", size)
        got = [(r.batch, r.node, r.other) for r in memory._pairs(nodes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert memory._pairs(nodes).columns == ["batch", "node", "ts", "namespace", "other"]


def test_pairs_are_dealt_to_many_tasks(spark, monkeypatch):
    nodes = spark.createDataFrame([("big", f"n{k:02d}", 1.0, "p") for k in range(40)], "batch string, node string, ts double, namespace string")
    monkeypatch.setattr(memory, "BLOCK_NODES", 5)
    tasks = {r.t for r in memory._pairs(nodes).select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(tasks) > 10  # one batch's blocks were one task's before
    rows = spark.createDataFrame([(k % 300, f"n{k % 7}", 1.0, "p") for k in range(2000)], "batch bigint, node string, ts double, namespace string")
    for spread in (False, True):
        found = memory._pairs(rows, spread)
        assert len({r.t for r in found.select(F.spark_partition_id().alias("t")).distinct().collect()}) > 50  # small partitions aren't put together
        assert found.count() == 200 * 21 + 100 * 15


def test_more_pairs_take_more_tasks(spark, data, monkeypatch):
    nodes = spark.range(4000).select((F.col("id") % 400).alias("batch"), F.concat(F.lit("n"), "id").alias("node"), F.lit(1.0).alias("ts"), F.lit("personal").alias("namespace"))
    assert memory.pair_tasks(nodes) == memory.PAIR_TASKS  # 400 batches of 10 nodes and 45 pairs
    monkeypatch.setattr(memory, "TASK_PAIRS", 100)
    assert memory.pair_tasks(nodes) == 221
    used = lambda rows: rows.select(F.spark_partition_id().alias("t")).distinct().count()
    out = memory.reinforce(None, nodes)
    assert out.count() == 18_000 and used(out) > memory.PAIR_TASKS
    lines = memory_queries._activations(spark, data, 300)
    assert lines.count() == spark.read.parquet(f"{data}/lineitem.parquet").count() and used(lines) > 200


def test_feedback_folds_in_the_tasks_told(spark, monkeypatch):
    used = lambda rows: rows.select(F.spark_partition_id().alias("t")).distinct().count()
    nodes = spark.range(4000).select((F.col("id") % 400).alias("batch"), F.concat(F.lit("n"), "id").alias("node"), F.lit(1.0).alias("ts"), F.lit("personal").alias("namespace"))
    signals = spark.createDataFrame([("a", "n1", "positive", ["n2", "n401"]), ("b", "n0", "negative", None)], "id string, node string, signal string, context array<string>")
    out = feedback.feedback(memory.reinforce(None, nodes, tasks=200), signals, 2.0, tasks=200)
    assert used(out) > 150  # the fold was put together to a few tasks before
    monkeypatch.setattr(feedback, "SENT_NODES", 0)  # nodes that don't go out: same rows
    assert plain(feedback.feedback(memory.reinforce(None, nodes), signals, 2.0)) == plain(out)


def test_decay_of_few_nodes_leaves_pairs_where_they_are(spark):
    rows = [(f"n{k}", f"o{k}", "personal", 0.5, 1, 0.0, 0.0) for k in range(50)]
    pairs = spark.createDataFrame(rows, "node_a string, node_b string, namespace string, weight double, activation_count long, last_activated double, created_at double").repartition(20, "node_a", "node_b")
    named = spark.createDataFrame([("n1",), ("o2",), ("n1",)], "node string")
    out = feedback.decay_nodes(pairs, named, 86400.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan  # all pairs were dealt anew by each end before
    assert sorted(r.node_a for r in out.where("weight < 0.5").collect()) == ["n1", "n2"] and out.count() == 50


def test_more_lines_take_more_tasks_of_links(spark, data, monkeypatch):
    links = lambda: node_queries.code_links(spark, data).where("relation = 'calls'")
    used = lambda rows: rows.select(F.spark_partition_id().alias("t")).distinct().count()
    few, before = used(links()), links()
    monkeypatch.setattr(node_queries, "TASK_LINES", 100)
    many = links()
    assert used(many) > max(40, few) and many.exceptAll(before).count() == 0 and many.count() == before.count()


def test_sums_that_differ_by_rounding_are_ties(spark):
    """a is told 0.3 at once and b 0.1 and 0.2, whose sum is greater by its last bit only."""
    rows = [(k, n, 1.0, "personal") for k, pair in enumerate((("a", "s3"), ("b", "s1"), ("b", "s2"))) for n in pair]
    batches = spark.createDataFrame(rows, "batch bigint, node string, ts double, namespace string")
    seeds = spark.createDataFrame([("s1", 1.0), ("s2", 2.0), ("s3", 3.0)], "node string, energy double").withColumn("energy", F.col("energy") / 10)
    store = SynapseStore.create(spark, fresh_folder(spark, "store") + "/s", buckets=4).reinforce(batches)
    for found in (store.spread(seeds, depth=1, k=1), memory.spread(memory.reinforce(None, batches), seeds, depth=1, k=1)):
        assert [r.node for r in found.collect()] == ["a"]


def test_large_batches_move_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(b, f"n{rng.randrange(60)}", float(rng.randrange(9)), ns) for b, size in ((1, 50), (2, 40), (3, 1), (None, 5)) for ns in ("personal", None) for _ in range(size)] + [(2, None, 0.0, "shared")]
    batches = spark.createDataFrame(rows, "batch bigint, node string, ts double, namespace string")
    key = lambda rows: sorted(rows, key=str)
    want = key(map(tuple, memory.reinforce(None, batches).collect()))
    for size, few in ((1_000, 100), (7, 0)):
        monkeypatch.setattr(memory, "BLOCK_NODES", size)
        monkeypatch.setattr(memory, "FEW_KINDS", few)
        out = memory.reinforce_large(batches)
        assert key(map(tuple, out.collect())) == want
        assert "hashpartitioning(node_a" not in out._jdf.queryExecution().executedPlan().toString()  # pairs were dealt by their nodes


def test_large_batches_are_written_in_turns(spark, monkeypatch):
    rng = random.Random(8)
    one, two = made(spark, rng, 60, 0), made(spark, rng, 60, 100)
    want = plain(memory.reinforce(memory.reinforce(None, one), two))
    written, write = [], SynapseStore._write

    def seen(self, dealt, *more):
        written.append(dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        write(self, dealt, *more)

    monkeypatch.setattr(SynapseStore, "_write", seen, raising=False)
    for pairs in (5_000_000, 20):
        monkeypatch.setattr("lattica.operators.store.TURN_PAIRS", pairs, raising=False)
        written.clear()
        store = SynapseStore.create(spark, fresh_folder(spark, "store") + "/s", buckets=8).reinforce(one).reinforce(two)
        assert plain(store.synapses()) == want
        assert set(written) == {1} and (len(written) == 2) == (pairs > 20)  # rows were moved twice, all at once
