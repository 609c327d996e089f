"""The stateful stream against its batch form, with repeated events, other cuts into files and a restart."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.base import fresh_folder
from lattica.operators import memory
from lattica.operators.store import SynapseStore
from lattica.streaming import learning

SCHEMA = "path string, namespace string, ts timestamp"


def at(ms):
    return f"2024-01-01T00:{ms // 60_000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"


@pytest.fixture
def state_store(spark):
    for k, v in learning.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in learning.STATE_STORE:
        spark.conf.unset(k)


def test_ready_by_hand(spark):
    rows = [("a", at(0)), ("a", at(700)), ("a", at(1_500)), ("a", at(1_500)), ("b", at(740)), (None, at(1)), ("c", None)]
    events = spark.createDataFrame(rows, "path string, ts string").select("path", F.lit("personal").alias("namespace"), F.col("ts").cast("timestamp").alias("ts"))
    got = sorted((r.path, r.tick) for r in learning.ready(events).select("path", F.unix_millis("tick") - F.unix_millis(F.lit(at(0)).cast("timestamp"))).toDF("path", "tick").collect())
    # an event at the very tick is after it: 700 is due at 1500
    assert got == [("a", 1_500), ("a", 2_250), ("b", 1_500)]
    assert learning.ready(events.where("false")).count() == 0


def test_stream_is_the_batch_form(spark, state_store, tmp_path):
    rng = random.Random(4)
    times = sorted(rng.randrange(20_000) for _ in range(120))
    events = [{"path": f"f{rng.randrange(6)}", "namespace": rng.choice(["personal", "shared"]), "ts": at(t)} for t in times]
    end = {"path": "end", "namespace": "personal", "ts": at(180_000)}
    src, store = tmp_path / "src", SynapseStore.create(spark, fresh_folder(spark, "store") + "/s", buckets=4)
    src.mkdir()

    def arrive(name, rows):
        (src / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = learning.learn(stream, store, str(tmp_path / "checkpoint"))
        q.awaitTermination(300)
        assert q.exception() is None and not q.isActive

    first = events[:60]
    rng.shuffle(first)  # within the lateness
    arrive("1", first[:35])
    arrive("2", first[35:] + first[:10])
    run()
    arrive("3", events[60:] + events[90:])
    arrive("4", [end])
    run()  # goes on from its checkpoint
    table = spark.createDataFrame([(e["path"], e["namespace"], e["ts"]) for e in events], "path string, namespace string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = memory.reinforce(None, learning.activations(learning.ready(table)))
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*memory.PAIR, "weight", "activation_count", "last_activated", "created_at").collect())
    assert plain(store.synapses()) == plain(want) and want.count() > 3
    before = store._state()
    store.reinforce(learning.activations(learning.ready(table)), epoch=("files", before["epochs"]["files"]))  # a micro-batch that comes again
    assert store._state() == before
