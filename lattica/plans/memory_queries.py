"""Memory and team queries on a co-purchase graph and user event sequences, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..base import fresh_folder
from ..operators import memory as M
from ..operators import team as TM
from ..operators.store import SynapseStore
from ..sources.tables import table

NOW = 915148800.0  # 1999-01-01


def _ns(priority):
    return F.when(priority == "1-URGENT", "personal").when(priority == "2-HIGH", "shared").when(priority == "3-MEDIUM", "branch:main").otherwise("ephemeral")


def synapses(spark, d, tasks=0):
    """Parts bought in one order fire together; the order's priority gives the namespace."""
    tasks = tasks or order_tasks(spark, d)
    return M.reinforce(None, _activations(spark, d, tasks), spread=False, tasks=tasks)  # an order has few parts


def transitions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.struct("ts", "event_id").alias("pos"), F.concat_ws("_", F.col("event_type"), (F.col("value").cast("int") % 5).cast("string")).alias("node"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.when(F.col("user_id") % 3 == 0, "shared").otherwise("personal").alias("namespace"))
    return M.record_sequences(e)


def _r(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def order_tasks(spark, d):
    return M.pair_tasks(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch")))


def _activations(spark, d, tasks):
    """Lines of orders, both dealt to ``tasks`` before they are joined."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"), _ns(F.col("o_orderpriority")).alias("namespace"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.concat(F.lit("p"), "l_partkey").alias("node"))
    return li.repartition(tasks, "batch").join(o.repartition(tasks, "batch"), "batch")


def _stored(spark, d):
    """A store that has learned the orders before and after a day, in two batches."""
    rows, middle = _activations(spark, d, order_tasks(spark, d)), F.lit(800_000_000.0)
    out = SynapseStore.create(spark, f"{fresh_folder(spark, 'synapses')}/rows")
    return out.reinforce(rows.where(F.col("ts") < middle)).reinforce(rows.where(F.col("ts") >= middle))


def synapses_stored(spark, d):
    """coactivation_reinforce by a store of buckets."""
    return _r(_stored(spark, d).synapses(), "weight")


def spread_stored(spark, d):
    """spread_activation by a store of buckets."""
    return _r(_stored(spark, d).spread(_seeds(spark)), "energy")


def coactivation_reinforce(spark, d):
    return _r(synapses(spark, d), "weight")


def synapse_decay(spark, d):
    return _r(M.decay(synapses(spark, d), NOW), "weight").select(*M.PAIR, "weight", "activation_count")


def decay_one_node(spark, d):
    return _r(M.decay_node(synapses(spark, d), "p1", NOW), "weight").where("node_a = 'p1' or node_b = 'p1'").select(*M.PAIR, "weight")


def learned_half_life(spark, d):
    return _r(M.learned_half_life(synapses(spark, d), NOW), "half_life_days").select(*M.PAIR, "half_life_days")


def merged_namespace_read(spark, d):
    return _r(M.merged_edges(synapses(spark, d), "branch:main"), "weight")


def synapse_neighbors(spark, d):
    return _r(M.neighbors(synapses(spark, d), "p1"), "weight")


def _seeds(spark):
    return spark.range(1).select(F.explode(F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).alias("node"), F.lit(1.0).alias("energy"))


def spread_activation(spark, d):
    return _r(M.spread(synapses(spark, d), _seeds(spark)), "energy")


def spread_contributions(spark, d):
    return _r(M.spread(synapses(spark, d), _seeds(spark), depth=1, by_namespace=True), "energy")


def hub_normalize(spark, d):
    return _r(M.normalize_hubs(synapses(spark, d), 40), "weight").select(*M.PAIR, "weight")


def synapse_stats(spark, d):
    return _r(M.stats(synapses(spark, d)), "weight")


def top_pairs(spark, d):
    return _r(M.top_pairs(synapses(spark, d), 50, 0.3), "weight")


def penalize_prune(spark, d):
    nodes = spark.range(0, 201).select(F.concat(F.lit("p"), "id").alias("node"))
    return _r(M.penalize(synapses(spark, d), nodes), "weight").groupBy("namespace").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def import_max_merge(spark, d):
    s = synapses(spark, d)
    rows = s.where("namespace = 'personal'").select(F.col("node_b").alias("source"), F.col("node_a").alias("target"), F.lit("shared").alias("namespace"), (F.col("weight") * 2).alias("weight"), (F.col("activation_count") + 1).alias("activation_count"), F.lit(NOW).alias("ts"))
    return _r(M.import_max(s, rows).where("namespace = 'shared'"), "weight").select(*M.PAIR, "weight", "activation_count")


def prune_stale(spark, d):
    return M.prune_stale(synapses(spark, d), NOW, 365).groupBy("namespace").agg(F.count("*").alias("edges"))


def transition_learn(spark, d):
    return transitions(spark, d)


def next_likely(spark, d):
    return _r(M.next_likely(transitions(spark, d)), "probability")


def top_transition_groups(spark, d):
    return _r(M.top_transition_groups(transitions(spark, d), 8, 0.05), "probability", "weight")


def transition_margin(spark, d):
    return _r(M.next_likely(transitions(spark, d), 1), "probability").select("from_node", F.col("probability").alias("top1_margin"))


def structural_seeds(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee")).agg(F.count("*").alias("call_count"))
    return _r(M.structural_seeds(e, NOW), "weight").select("node_a", "node_b", "weight")


def promote_lasting(spark, d):
    return _r(M.promote_lasting(M.decay(synapses(spark, d), NOW)), "weight").select(*M.PAIR, "weight", "activation_count")


def contribution_score(spark, d):
    s = TM.contribution(synapses(spark, d), NOW)
    return _r(s, "score", "reinforcement", "recency").select(*M.PAIR, "reinforcement", "recency", "score", "class")


def peer_review(spark, d):
    return TM.review(TM.contribution(synapses(spark, d), NOW)).groupBy("action", "hint").agg(F.count("*").alias("n"))


def conflict_merge(spark, d):
    s = TM.contribution(synapses(spark, d), NOW).withColumn("score", F.round("score", 6))
    side = lambda ns: s.where(F.col("namespace") == ns).select(F.col("node_a").alias("source"), F.col("node_b").alias("target"), "score", "activation_count")
    return TM.conflict_merge(side("personal"), side("shared"))


def team_bundle(spark, d):
    return _r(TM.bundle(synapses(spark, d), 500), "weight")


def team_bundle_hash(spark, d):
    return TM.bundle_hash(TM.bundle(synapses(spark, d), 500))


def staleness(spark, d):
    s = TM.fast_decay(TM.stale(synapses(spark, d), NOW))
    return _r(s, "weight", "age_days").select(*M.PAIR, "weight", "age_days")


def sleep_redundant(spark, d):
    return TM.redundant(synapses(spark, d).withColumn("weight", F.col("weight") / 100), NOW).groupBy("namespace").agg(F.count("*").alias("n"))


# Node ids and the domain that each belongs to.
DOMAINS = [
    ("archive_notes_md", "decision"), ("decision_7", "decision"), ("community_-3", "decision"), ("a_md__h12", "document"), ("readme_md", "document"), ("f__fn", "code"), ("g_cls", "code"), ("x__var", "code"),
    ("m__y_sym", "code"), ("conf_yaml", "code"), ("benchmark_z", "code"), ("why__rationale", "decision"), ("foo_fn__rationale_2", "decision"), ("/a/b.PY", "code"), ("/a/b.md", "document"), ("/a/b.bin", "unknown"),
    ("zz", "unknown"), ("adr_1", "unknown"), ("compliance:x", "unknown"), ("x_py_more", "unknown"),
]


def domain_breakdown(spark, d):
    from ..functions.text import domain

    node = F.element_at(F.array(*[F.lit(n) for n, _ in DOMAINS]), (F.col("page_id") % len(DOMAINS) + 1).cast("int"))
    return table(spark, d, "pages").select(node.alias("node")).select("node", domain(F.col("node")).alias("domain")).groupBy("node", "domain").agg(F.count("*").alias("n"))


_F = (synapses_stored, spread_stored, coactivation_reinforce, synapse_decay, decay_one_node, learned_half_life, merged_namespace_read, synapse_neighbors, spread_activation, spread_contributions, hub_normalize, synapse_stats, top_pairs, penalize_prune, import_max_merge, prune_stale, transition_learn, next_likely, top_transition_groups, transition_margin, structural_seeds, promote_lasting, contribution_score, peer_review, conflict_merge, team_bundle, team_bundle_hash, staleness, sleep_redundant, domain_breakdown)
QUERIES = {f.__name__: f for f in _F}

_SYN = """n AS (SELECT DISTINCT l_orderkey AS batch, 'p' || l_partkey AS node FROM lineitem),
o AS (SELECT o_orderkey AS batch, epoch(o_orderdate)::DOUBLE AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'personal' WHEN '2-HIGH' THEN 'shared' WHEN '3-MEDIUM' THEN 'branch:main' ELSE 'ephemeral' END AS namespace FROM orders),
syn AS (SELECT a.node AS node_a, b.node AS node_b, namespace, least(1.0::DOUBLE, count(*) * 0.3::DOUBLE) AS weight, count(*) AS activation_count, max(ts) AS last_activated, min(ts) AS created_at
 FROM n a JOIN n b ON a.batch = b.batch AND a.node < b.node JOIN o ON a.batch = o.batch GROUP BY ALL)"""
_DECAY = f"""dec0 AS (SELECT *, weight * exp(-{C.LN2}::DOUBLE * greatest(0, ({NOW}::DOUBLE - last_activated) / 86400) / CASE namespace WHEN 'shared' THEN 60 WHEN 'ephemeral' THEN 1 ELSE 30 END) AS w FROM syn),
dec AS (SELECT * REPLACE (CASE WHEN activation_count >= 5 AND namespace <> 'ephemeral' THEN greatest(0.2::DOUBLE, w) ELSE w END AS weight) FROM dec0 WHERE w >= 0.01 OR (activation_count >= 5 AND namespace <> 'ephemeral'))"""
_FACTOR = "CASE namespace WHEN 'personal' THEN 0.8::DOUBLE WHEN 'shared' THEN 0.5::DOUBLE END"
_BOTH = f"""fe AS (SELECT node_a, node_b, namespace, weight * {_FACTOR} AS w FROM syn WHERE namespace IN ('personal', 'shared')),
adj AS (SELECT node_a AS node, node_b AS other, namespace, w FROM fe UNION ALL SELECT node_b, node_a, namespace, w FROM fe),
deg AS (SELECT node, count(DISTINCT other) AS degree FROM adj GROUP BY node),
ah AS (SELECT adj.*, w * 0.6::DOUBLE * CASE WHEN degree > 50 THEN sqrt(50.0::DOUBLE / degree) ELSE 1 END AS g FROM adj JOIN deg USING (node)),
h1 AS (SELECT other AS node, namespace, g AS energy FROM ah WHERE node IN ('p1', 'p2', 'p3'))"""
_TR = """ev AS (SELECT user_id, ts, event_id, event_type || '_' || (trunc(value)::INT % 5) AS node, floor(epoch(ts))::DOUBLE AS t, CASE WHEN user_id % 3 = 0 THEN 'shared' ELSE 'personal' END AS namespace FROM events),
e1 AS (SELECT *, lag(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ev),
e2 AS (SELECT *, lag(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_node FROM e1 WHERE before IS NULL OR before <> node),
tr AS (SELECT from_node, node AS to_node, namespace, least(100.0::DOUBLE, count(*)::DOUBLE) AS weight, count(*) AS count, max(t) AS last_activated, min(t) AS created_at FROM e2 WHERE from_node IS NOT NULL GROUP BY ALL),
mt AS (SELECT from_node, to_node, sum(weight * CASE namespace WHEN 'personal' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM tr GROUP BY ALL),
nl AS (SELECT from_node, to_node, weight / sum(weight) OVER (PARTITION BY from_node) AS probability FROM mt)"""
_CON = f"""con0 AS (SELECT *, least(1.0::DOUBLE, ln(1 + activation_count) / ln(31)) AS reinforcement, exp(-0.693::DOUBLE * greatest(0, ({NOW}::DOUBLE - last_activated) / 86400) / 30) AS recency FROM syn),
con AS (SELECT *, least(1, greatest(0, 0.4::DOUBLE * reinforcement + 0.35::DOUBLE * recency)) AS score FROM con0)"""
_BUNDLE = "bun AS (SELECT node_a AS source, node_b AS target, max(weight) AS weight, max(activation_count) AS activation_count FROM syn WHERE namespace IN ('personal', 'shared') GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 500)"
ORACLES = {
    "coactivation_reinforce": f"WITH {_SYN} SELECT * REPLACE (round(weight, 6) AS weight) FROM syn",
    "synapse_decay": f"WITH {_SYN}, {_DECAY} SELECT node_a, node_b, namespace, round(weight, 6) AS weight, activation_count FROM dec",
    "decay_one_node": f"""WITH {_SYN}, x AS (SELECT *, weight * exp(-{C.LN2}::DOUBLE * greatest(0, ({NOW}::DOUBLE - last_activated) / 86400) / 30) AS w FROM syn WHERE 'p1' IN (node_a, node_b))
SELECT node_a, node_b, namespace, round(CASE WHEN activation_count >= 5 THEN greatest(0.2::DOUBLE, w) ELSE w END, 6) AS weight FROM x WHERE w >= 0.01 OR activation_count >= 5""",
    "learned_half_life": f"""WITH {_SYN}, a AS (SELECT *, CASE namespace WHEN 'shared' THEN 60.0::DOUBLE WHEN 'ephemeral' THEN 1 ELSE 30 END AS df, CASE namespace WHEN 'shared' THEN 60.0::DOUBLE ELSE 3 END AS lo,
greatest(0, ({NOW}::DOUBLE - created_at) / 86400) AS age, greatest(0, ({NOW}::DOUBLE - last_activated) / 86400) AS since, ln(1 + activation_count / 10) AS r FROM syn),
b AS (SELECT *, exp(-{C.LN2}::DOUBLE * since / df) AS tr FROM a)
SELECT node_a, node_b, namespace, round(greatest(lo, least(120, CASE WHEN age < 1 THEN df ELSE (1 - tr) * df + tr * (lo + (120 - lo) * (r / (1 + r))) END)), 6) AS half_life_days FROM b""",
    "merged_namespace_read": f"""WITH {_SYN} SELECT node_a, node_b, round(sum(weight * CASE namespace WHEN 'branch:main' THEN 1.0::DOUBLE WHEN 'personal' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END), 6) AS weight, sum(activation_count)::BIGINT AS activation_count
FROM syn WHERE namespace <> 'ephemeral' GROUP BY ALL""",
    "synapse_neighbors": f"""WITH {_SYN} SELECT CASE WHEN node_a = 'p1' THEN node_b ELSE node_a END AS other, round(sum(weight * {_FACTOR}), 6) AS weight FROM syn
WHERE 'p1' IN (node_a, node_b) AND namespace IN ('personal', 'shared') GROUP BY 1 ORDER BY weight DESC, other LIMIT 5""",
    "spread_activation": f"""WITH {_SYN}, {_BOTH}, h2 AS (SELECT other AS node, energy * g AS energy FROM h1 JOIN ah USING (node)), al AS (SELECT node, energy FROM h1 UNION ALL SELECT * FROM h2)
SELECT node, round(sum(energy), 6) AS energy FROM al WHERE node NOT IN ('p1', 'p2', 'p3') GROUP BY node ORDER BY sum(energy) DESC, node LIMIT 12""",
    "spread_contributions": f"WITH {_SYN}, {_BOTH} SELECT node, namespace, round(sum(energy), 6) AS energy FROM h1 WHERE node NOT IN ('p1', 'p2', 'p3') GROUP BY ALL",
    "hub_normalize": f"""WITH {_SYN}, d AS (SELECT node, count(*) AS n FROM (SELECT node_a AS node FROM syn UNION ALL SELECT node_b FROM syn) GROUP BY node HAVING count(*) > 40)
SELECT node_a, node_b, namespace, round(weight * coalesce(sqrt(40.0::DOUBLE / x.n), 1) * coalesce(sqrt(40.0::DOUBLE / y.n), 1), 6) AS weight FROM syn LEFT JOIN d x ON node_a = x.node LEFT JOIN d y ON node_b = y.node""",
    "synapse_stats": f"""WITH {_SYN}, n2 AS (SELECT namespace, count(DISTINCT node) AS nodes FROM (SELECT namespace, node_a AS node FROM syn UNION ALL SELECT namespace, node_b FROM syn) GROUP BY 1)
SELECT namespace, count(*) AS edges, count(*) FILTER (activation_count >= 5) AS lasting, round(sum(weight), 6) AS weight, count(*) FILTER (activation_count <= 1) AS dormant, any_value(nodes) AS nodes FROM syn JOIN n2 USING (namespace) GROUP BY 1""",
    "top_pairs": f"WITH {_SYN} SELECT node_a, node_b, round(sum(weight), 6) AS weight, sum(activation_count)::BIGINT AS activation_count FROM syn GROUP BY ALL HAVING sum(weight) >= 0.3 ORDER BY sum(weight) DESC, activation_count DESC, node_a, node_b LIMIT 50",
    "penalize_prune": f"""WITH {_SYN}, x AS (SELECT *, substr(node_a, 2)::INT <= 200 AND substr(node_b, 2)::INT <= 200 AS hit FROM syn), y AS (SELECT *, CASE WHEN hit THEN greatest(0, weight - 0.3::DOUBLE) ELSE weight END AS w FROM x)
SELECT namespace, count(*) AS edges, round(sum(w), 4) AS weight FROM y WHERE NOT (hit AND w <= 0.01 AND activation_count < 5) GROUP BY 1""",
    "import_max_merge": f"""WITH {_SYN}, u AS (SELECT node_a, node_b, weight, activation_count FROM syn WHERE namespace = 'shared' UNION ALL SELECT node_a, node_b, least(1, weight * 2), activation_count + 1 FROM syn WHERE namespace = 'personal')
SELECT node_a, node_b, 'shared' AS namespace, round(max(weight), 6) AS weight, max(activation_count) AS activation_count FROM u GROUP BY ALL""",
    "prune_stale": f"WITH {_SYN} SELECT namespace, count(*) AS edges FROM syn WHERE last_activated >= {NOW}::DOUBLE - 365 * 86400 OR activation_count >= 5 GROUP BY 1",
    "transition_learn": f"WITH {_TR} SELECT * FROM tr",
    "next_likely": f"WITH {_TR} SELECT from_node, to_node, round(probability, 6) AS probability, row_number() OVER (PARTITION BY from_node ORDER BY probability DESC, to_node)::INT AS rank FROM nl QUALIFY rank <= 5",
    "top_transition_groups": f"""WITH {_TR}, s AS (SELECT from_node, to_node, sum(weight) AS weight FROM tr GROUP BY ALL), f AS (SELECT from_node, max(weight) AS most, sum(weight) AS total FROM s GROUP BY 1 ORDER BY most DESC, total DESC, from_node LIMIT 8)
SELECT from_node, to_node, round(weight, 6) AS weight, round(weight / total, 6) AS probability FROM s JOIN f USING (from_node) WHERE weight / total >= 0.05""",
    "transition_margin": f"WITH {_TR} SELECT from_node, round(max(probability), 6) AS top1_margin FROM nl GROUP BY 1",
    "structural_seeds": "WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT least(a, b) AS node_a, greatest(a, b) AS node_b, round(least(0.7::DOUBLE, 0.25::DOUBLE + 0.06::DOUBLE * ln(1 + sum(n))), 6) AS weight FROM e GROUP BY ALL",
    "promote_lasting": f"WITH {_SYN}, {_DECAY} SELECT node_a, node_b, namespace, round(CASE WHEN activation_count >= 5 AND weight >= 0.2 AND weight < 1 THEN least(1, weight * 1.1::DOUBLE) ELSE weight END, 6) AS weight, activation_count FROM dec",
    "contribution_score": f"WITH {_SYN}, {_CON} SELECT node_a, node_b, namespace, round(reinforcement, 6) AS reinforcement, round(recency, 6) AS recency, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'promote' WHEN score < 0.3 THEN 'decay' ELSE 'neutral' END AS class FROM con",
    "peer_review": f"""WITH {_SYN}, {_CON}, a AS (SELECT *, CASE WHEN score >= 0.7 THEN 'auto_promote' WHEN score < 0.15 THEN 'reject' ELSE 'review_required' END AS action, concat_ws(', ', CASE WHEN reinforcement < 0.3 THEN 'low reinforcement' END, CASE WHEN recency < 0.3 THEN 'stale' END) AS h FROM con)
SELECT action, CASE WHEN action <> 'review_required' THEN '' WHEN h = '' THEN 'marginal score' ELSE h END AS hint, count(*) AS n FROM a GROUP BY ALL""",
    "conflict_merge": f"""WITH {_SYN}, {_CON}, p AS (SELECT node_a AS source, node_b AS target, round(score, 6) AS sa, activation_count AS na FROM con WHERE namespace = 'personal'), q AS (SELECT node_a AS source, node_b AS target, round(score, 6) AS sb, activation_count AS nb FROM con WHERE namespace = 'shared'),
j AS (SELECT * FROM p FULL JOIN q USING (source, target)), w AS (SELECT *, CASE WHEN sb IS NULL THEN 'a' WHEN sa IS NULL THEN 'b' WHEN sa < 0.3 AND sb < 0.3 AND abs(sa - sb) < 0.05 THEN 'contest' WHEN sa > sb THEN 'a' WHEN sb > sa THEN 'b' WHEN na >= nb THEN 'a' ELSE 'b' END AS winner FROM j)
SELECT source, target, winner, CASE WHEN winner = 'b' THEN sb ELSE sa END AS score FROM w""",
    "team_bundle": f"WITH {_SYN}, {_BUNDLE} SELECT source, target, round(weight, 6) AS weight, activation_count FROM bun",
    "team_bundle_hash": f"WITH {_SYN}, {_BUNDLE} SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS content_hash FROM (SELECT source || '|' || target || '|' || format('{{:.6f}}', weight) || '|' || activation_count AS l FROM bun)",
    "staleness": f"""WITH {_SYN}, a AS (SELECT *, ({NOW}::DOUBLE - last_activated) / 86400 AS age, CASE WHEN namespace = 'shared' THEN 30 WHEN starts_with(namespace, 'branch:') THEN 14 ELSE 60 END AS lim FROM syn)
SELECT node_a, node_b, namespace, round(weight * pow(2.0::DOUBLE, -5.0::DOUBLE / lim), 6) AS weight, round(age, 6) AS age_days FROM a WHERE age > lim""",
    "sleep_redundant": f"WITH {_SYN} SELECT namespace, count(*) AS n FROM syn WHERE weight / 100 < 0.01 AND activation_count <= 1 AND last_activated < {NOW}::DOUBLE - 60 * 86400 AND created_at < {NOW}::DOUBLE - 60 * 86400 GROUP BY 1",
    "domain_breakdown": f"""SELECT [{', '.join(f"'{n}'" for n, _ in DOMAINS)}][(page_id % {len(DOMAINS)} + 1)::INT] AS node, [{', '.join(f"'{k}'" for _, k in DOMAINS)}][(page_id % {len(DOMAINS)} + 1)::INT] AS domain, count(*) AS n FROM pages GROUP BY 1, 2""",
}
ORACLES |= {"synapses_stored": ORACLES["coactivation_reinforce"], "spread_stored": ORACLES["spread_activation"]}
