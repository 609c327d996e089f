"""Graph queries on a typed graph of the star schema, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as K
from ..operators import graph as G
from ..operators import paths as P
from ..sources.tables import table


def links(spark, d):
    """region contains nation contains customer; customer calls the parts it bought; supplier inherits its nation."""
    row = lambda df, s, t, r: df.select(s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), F.lit(1.0).alias("confidence_score"))
    i = lambda p, c: F.concat(F.lit(p), F.col(c))
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    return (
        row(table(spark, d, "nation"), i("r", "n_regionkey"), i("n", "n_nationkey"), "contains")
        .unionByName(row(table(spark, d, "customer"), i("n", "c_nationkey"), i("c", "c_custkey"), "contains"))
        .unionByName(row(bought, i("c", "o_custkey"), i("p", "l_partkey"), "calls"))
        .unionByName(row(table(spark, d, "supplier"), i("s", "s_suppkey"), i("n", "s_nationkey"), "inherits"))
    )


def structural_views(spark, d):
    return G.views(links(spark, d)).groupBy("view").agg(F.count("*").alias("pairs"), F.countDistinct("node").alias("nodes"))


def structural_neighbors(spark, d):
    v = G.views(links(spark, d)).where(F.col("node").isin("n1", "c1", "p1", "s1"))
    return G.view_neighbors(v, [*G.DEFAULT_VIEWS, "members", "container"]).select("node", "view", "n", F.array_join("others", ",").alias("others"))


def _nodes(spark, *names):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("node"))


def structural_recall(spark, d):
    return G.structural_recall(G.views(links(spark, d)), _nodes(spark, "c1", "c2", "p10")).select("node", F.round("score", 6).alias("score"))


def blast_radius(spark, d):
    return G.blast_radius(G.views(links(spark, d)), _nodes(spark, "p1", "n1")).select("start", "node", "hop", "view")


def cohesion_outliers(spark, d):
    c = table(spark, d, "customer").select(F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("cluster"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("node"), "o_orderpriority", "o_orderstatus")
    return G.cohesion_outliers(c, o.select("node", F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("associate")))


def drift_intervals(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_linenumber") * 10).alias("line"))
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 60).alias("first"), (F.col("o_custkey") % 60 + 15).alias("last"))
    return G.symbols_in_ranges(s, h)


def relevance_spans(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_linenumber") * 10).alias("line"))
    return G.line_spans(s)


def peer_groups(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("container"), F.concat(F.lit("p"), "p_partkey").alias("node"), F.regexp_replace(F.lower("p_type"), "[^a-z]+", "_").alias("label"))
    return G.peer_counts(m)


def graph_degrees(spark, d):
    a = G.both_ways(G.undirected(links(spark, d)))
    return a.groupBy("node").agg(F.count("*").alias("degree"), F.round(F.sum("distance"), 6).alias("distance"))


def ir_validation(spark, d):
    n = table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 10 == 3, "x").otherwise("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("symbol").alias("file_type"))
    n = n.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_regionkey").alias("id"), F.col("n_name").alias("label"), F.lit("thing").alias("file_type")))
    return G.validate(n, links(spark, d)).groupBy("severity", "kind").agg(F.count("*").alias("issues"), F.sum("n").alias("n"))


def betweenness(spark, d):
    return G.betweenness(links(spark, d)).select("node", F.round("betweenness", 6).alias("betweenness"))


def gap_candidates(spark, d):
    """Customers and parts between the communities of nations, and whom to link them to."""
    e = links(spark, d)
    of = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_nationkey") % 5).cast("int").alias("community"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_partkey") % 5).cast("int").alias("community"))
    return G.gaps(e, of.unionByName(p), threshold=0.0).select("node", "gap_score", "betweenness", "degree", F.array_join(F.transform("bridged", lambda x: x.cast("string")), ",").alias("bridged"), F.array_join("suggested", ",").alias("suggested"))


def _weighted(spark, d):
    return links(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1.0).alias("weight"))


def louvain(spark, d):
    return G.louvain(_weighted(spark, d))


def label_propagation(spark, d):
    return G.label_propagation(_weighted(spark, d))


def importer_closure(spark, d):
    e = links(spark, d).where("relation in ('contains', 'inherits')")
    e = e.select(F.col("target").alias("node"), F.col("source").alias("other"))
    return G.closure(e, _nodes(spark, "c1", "n3"))


def modularity_communities(spark, d):
    """Communities of nations and brands that trade with one another, by the number of orders."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = rows.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.col("p_brand").alias("b")).agg(F.count("*").cast("double").alias("weight"))
    return K.communities(e)


def betweenness_exchanged(spark, d):
    """Nations, brands and suppliers' nations between one another, closer the more they trade, by messages between blocks."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = rows.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.col("p_brand").alias("target")).agg(F.count("*").cast("double").alias("weight"))
    return P.betweenness(e.withColumn("relation", F.lit("calls"))).select("node", F.round("betweenness", 6).alias("betweenness"))


def stable_communities(spark, d):
    """Customers dealt anew, by nation and balance: which of the communities are the nations of before."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 11 <> 3").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("bigint").alias("community"))
    new = c.where("c_custkey % 13 <> 5").select(F.col("c_custkey").alias("node"), ((F.col("c_nationkey") * 7 + F.when(F.col("c_acctbal") < 0, 1).otherwise(0)) % 40).cast("bigint").alias("community"))
    return K.stable_ids(old, new)


_F = (modularity_communities, betweenness_exchanged, stable_communities, structural_views, structural_neighbors, structural_recall, blast_radius, cohesion_outliers, drift_intervals, relevance_spans, peer_groups, graph_degrees, ir_validation, betweenness, gap_candidates, louvain, label_propagation, importer_closure)
QUERIES = {f.__name__: f for f in _F}

_L = """bought AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lk AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t, 'contains' AS r FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey, 'calls' FROM bought UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'inherits' FROM supplier),
vw AS (SELECT DISTINCT s AS node, CASE r WHEN 'contains' THEN 'members' WHEN 'calls' THEN 'callees' ELSE 'bases' END AS view, t AS other FROM lk
 UNION SELECT DISTINCT t, CASE r WHEN 'contains' THEN 'container' WHEN 'calls' THEN 'callers' ELSE 'subclasses' END, s FROM lk)"""
_SPANS = "sp AS (SELECT l_orderkey AS path, l_orderkey || '_' || l_linenumber AS id, l_linenumber * 10 AS line, lead(l_linenumber * 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_orderkey || '_' || l_linenumber) AS nxt FROM lineitem)"
_CAPPED = "be AS (SELECT *, CASE view WHEN 'callers' THEN 0 WHEN 'importers' THEN 1 ELSE 2 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY node, view ORDER BY other) AS nth FROM vw WHERE view IN ('callers', 'importers', 'subclasses', 'implementers')) WHERE nth <= 50)"
ORACLES = {
    "stable_communities": """WITH RECURSIVE o AS (SELECT c_custkey AS node, c_nationkey AS o FROM customer WHERE c_custkey % 11 <> 3),
n AS (SELECT c_custkey AS node, (c_nationkey * 7 + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) % 40 AS c FROM customer WHERE c_custkey % 13 <> 5),
shared AS (SELECT c, o, row_number() OVER (ORDER BY count(*) DESC, o, c) AS i FROM n JOIN o USING (node) GROUP BY c, o),
greedy AS (SELECT 0::BIGINT AS i, [-1]::BIGINT[] AS cs, [-1]::BIGINT[] AS os UNION ALL
 SELECT s.i, CASE WHEN list_contains(cs, s.c) OR list_contains(os, s.o) THEN cs ELSE list_append(cs, s.c) END,
  CASE WHEN list_contains(cs, s.c) OR list_contains(os, s.o) THEN os ELSE list_append(os, s.o) END FROM greedy g JOIN shared s ON s.i = g.i + 1),
last AS (SELECT cs, os FROM greedy ORDER BY i DESC LIMIT 1), matched AS (SELECT unnest(cs) AS c, unnest(os) AS o FROM last),
every AS (SELECT c, min(node) AS least FROM n GROUP BY c),
fresh AS (SELECT c, row_number() OVER (ORDER BY least) AS nth FROM every WHERE c NOT IN (SELECT c FROM matched))
SELECT c AS community, o AS id FROM matched WHERE c >= 0 UNION ALL SELECT c, (SELECT max(o) FROM o) + nth FROM fresh""",
    "structural_views": f"WITH {_L} SELECT view, count(*) AS pairs, count(DISTINCT node) AS nodes FROM vw GROUP BY view",
    "structural_neighbors": f"WITH {_L} SELECT node, view, count(*) AS n, string_agg(other, ',' ORDER BY other) AS others FROM vw WHERE node IN ('n1', 'c1', 'p1', 's1') GROUP BY ALL",
    "structural_recall": f"""WITH {_L}, m AS (SELECT *, CASE view WHEN 'callers' THEN 1.0::DOUBLE WHEN 'callees' THEN 0.9::DOUBLE WHEN 'bases' THEN 0.8::DOUBLE WHEN 'subclasses' THEN 0.7::DOUBLE END AS w, count(*) OVER (PARTITION BY node, view) AS dg FROM vw WHERE node IN ('c1', 'c2', 'p10') AND view IN ('callers', 'callees', 'bases', 'subclasses'))
SELECT other AS node, round(max(w * CASE WHEN dg > 50 THEN sqrt(50.0::DOUBLE / dg) ELSE 1 END), 6) AS score FROM m WHERE other NOT IN ('c1', 'c2', 'p10') GROUP BY 1 ORDER BY max(w * CASE WHEN dg > 50 THEN sqrt(50.0::DOUBLE / dg) ELSE 1 END) DESC, node LIMIT 8""",
    "blast_radius": f"""WITH {_L}, {_CAPPED}, st AS (SELECT unnest(['p1', 'n1']) AS start), h1 AS (SELECT start, other AS node, 1 AS hop, arg_min(view, place) AS view FROM st JOIN be ON be.node = start WHERE other <> start GROUP BY start, other),
h2 AS (SELECT start, be.other AS node, 2 AS hop, arg_min(be.view, be.place) AS view FROM h1 JOIN be ON be.node = h1.node GROUP BY start, be.other)
SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE node <> start AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.node = h2.node)""",
    "cohesion_outliers": """WITH m AS (SELECT c_mktsegment || '_' || c_nationkey AS cluster, 'c' || c_custkey AS node FROM customer), u AS (SELECT DISTINCT 'c' || o_custkey AS node, o_orderpriority || '_' || o_orderstatus AS associate FROM orders),
z AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 4), mu AS (SELECT cluster, node, associate FROM m JOIN u USING (node)), p AS (SELECT cluster, associate, count(*) AS peers, any_value(size) AS size FROM mu JOIN z USING (cluster) GROUP BY cluster, associate),
q AS (SELECT * FROM p WHERE peers >= greatest(3, ceil(0.6::DOUBLE * size)) AND peers < size), f AS (SELECT q.cluster, m.node, q.associate, peers, size FROM q JOIN m USING (cluster) WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.cluster = q.cluster AND mu.node = m.node AND mu.associate = q.associate))
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY peers / size DESC, peers DESC, associate, node) <= 5""",
    "drift_intervals": f"WITH {_SPANS}, h AS (SELECT o_orderkey AS path, o_custkey % 60 AS a, o_custkey % 60 + 15 AS b FROM orders) SELECT DISTINCT path, id FROM sp JOIN h USING (path) WHERE line <= b AND (nxt IS NULL OR nxt > a)",
    "relevance_spans": f"WITH {_SPANS} SELECT path, id, line AS first, greatest(line, coalesce(nxt - 1, line)) AS last FROM sp",
    "peer_groups": """WITH m AS (SELECT p_brand AS c, 'p' || p_partkey AS node, list_filter(string_split(regexp_replace(lower(p_type), '[^a-z]+', '_', 'g'), '_'), lambda t: length(t) >= 3) AS l FROM part),
t AS (SELECT c, node, l[1] AS t1, l[-1] AS t2 FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, count(*) OVER (PARTITION BY c, t1) AS n1, count(*) OVER (PARTITION BY c, t2) AS n2 FROM t),
f AS (SELECT *, CASE WHEN t1 IS NOT NULL AND n1 BETWEEN 4 AND n - 1 THEN n1 END AS f1, CASE WHEN t2 IS NOT NULL AND n2 BETWEEN 4 AND n - 1 THEN n2 END AS f2 FROM n)
SELECT c AS container, node, (CASE WHEN f2 IS NOT NULL AND (f1 IS NULL OR f2 <= f1) THEN f2 WHEN f1 IS NOT NULL THEN f1 ELSE n END - 1)::BIGINT AS peers FROM f WHERE peers > 0""",
    "graph_degrees": f"""WITH {_L}, e AS (SELECT least(s, t) AS a, greatest(s, t) AS b, min(1 / CASE r WHEN 'calls' THEN 1.0::DOUBLE WHEN 'inherits' THEN 0.9::DOUBLE WHEN 'contains' THEN 0.3::DOUBLE END) AS x FROM lk WHERE s <> t GROUP BY ALL),
w AS (SELECT a AS node, x FROM e UNION ALL SELECT b, x FROM e) SELECT node, count(*) AS degree, round(sum(x), 6) AS distance FROM w GROUP BY node""",
    "ir_validation": f"""WITH {_L}, n AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN 'x' ELSE 'c' END || c_custkey AS id, c_name AS label, 'symbol' AS ft FROM customer UNION ALL SELECT 'n' || n_regionkey, n_name, 'thing' FROM nation),
en AS (SELECT s AS id FROM lk UNION ALL SELECT t FROM lk),
i AS (SELECT 'error' AS severity, 'duplicate_id' AS kind, count(*) AS n FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'warning', 'unknown_kind', 1 FROM n WHERE ft = 'thing'
 UNION ALL SELECT 'error', 'dangling', count(*) FROM en WHERE id NOT IN (SELECT id FROM n) GROUP BY id UNION ALL SELECT 'warning', 'orphan', 1 FROM (SELECT DISTINCT id FROM n) WHERE id NOT IN (SELECT id FROM en))
SELECT severity, kind, count(*) AS issues, sum(n)::BIGINT AS n FROM i GROUP BY ALL""",
    "importer_closure": f"""WITH RECURSIVE {_L}, e AS (SELECT t AS node, s AS other FROM lk WHERE r IN ('contains', 'inherits')), c AS (SELECT unnest(['c1', 'n3']) AS node UNION SELECT e.other FROM c JOIN e ON e.node = c.node) SELECT node FROM c""",
}
