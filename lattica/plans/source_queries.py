"""Queries on files made of the tables: symbols of ten languages, specs, notes, diffs, the index document; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import governance as GV
from ..operators import memory as M
from ..operators import team as TM
from ..sources import extractors as EX
from ..sources import graphs as GR
from ..sources import ir
from ..sources import parsing as P
from ..sources.tables import table
from . import memory_queries as MQ
from . import node_queries as NQ

# One file a supplier, in the language of its number: a type over the one nine before, a function that calls that one's, an import of its file.
TEMPLATES = {
    ".ts": "import {{ x }} from './f{p}';\n// Note {k} here.\nexport class C{k} extends C{p} {{\n  run{k}(a: number) {{\n    return run{p}(a);\n  }}\n}}\n",
    ".go": 'package src{k}\n\nimport (\n\t"x/src{p}"\n)\n\n// Note {k} here.\ntype C{k} struct {{\n}}\n\nfunc run{k}(a int) int {{\n\treturn run{p}(a)\n}}\n',
    ".rs": "use crate::f{p};\n/// Note {k} here.\npub struct C{k} {{\n}}\nimpl C{p} for C{k} {{\n    fn run{k}(a: i32) -> i32 {{\n        run{p}(a)\n    }}\n}}\n",
    ".java": "package x;\nimport x.C{p};\n/** Note {k} here. */\npublic class C{k} extends C{p} {{\n    public int run{k}(int a) {{\n        return run{p}(a);\n    }}\n}}\n",
    ".c": '#include "f{p}.h"\n/* Note {k} here. */\nstruct C{k} {{\n}};\nint run{k}(int a)\n{{\n    return run{p}(a);\n}}\n',
    ".cpp": '#include "f{p}.hpp"\n// Note {k} here.\nclass C{k} : public C{p} {{\n public:\n  int run{k}(int a) {{ return run{p}(a); }}\n}};\n',
    ".cs": "using x.C{p};\nnamespace x {{\n    // Note {k} here.\n    public class C{k} : C{p} {{\n        public int run{k}(int a) {{\n            return run{p}(a);\n        }}\n    }}\n}}\n",
    ".rb": "require_relative 'f{p}'\n# Note {k} here.\nclass C{k} < C{p}\n  def run{k}(a)\n    run{p}(a)\n  end\nend\n",
    ".php": "<?php\nnamespace x;\nuse x\\C{p};\n/** Note {k} here. */\nclass C{k} extends C{p} {{\n    public function run{k}($a) {{\n        return run{p}($a);\n    }}\n}}\n",
}


def code_files(spark, d):
    k = F.col("s_suppkey") + 99
    suffix, body = F.element_at(F.array(*map(F.lit, TEMPLATES)), (k % 9 + 1).cast("int")), F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES.values()):
        text = t.replace("{{", "{").replace("}}", "}").replace("{k}", "\x00k\x00").replace("{p}", "\x00p\x00").split("\x00")
        body = F.when(k % 9 == i, F.concat(*[k.cast("string") if x == "k" else (k - 9).cast("string") if x == "p" else F.lit(x) for x in text])).otherwise(body)
    return table(spark, d, "supplier").select(F.concat(F.lit("src"), k, F.lit("/f"), k, suffix).alias("path"), body.alias("content"))


def extracted_symbols(spark, d):
    s = EX.symbols(code_files(spark, d))
    return s.where(F.col("kind").isin("class", "function", "rationale")).select("path", "kind", "label").distinct()


def extracted_graph(spark, d):
    nodes, links = EX.graph(code_files(spark, d))
    suffix = F.regexp_extract("source_file", r"(\.\w+)$", 1)
    a = nodes.groupBy(suffix.alias("suffix"), F.concat(F.lit("node "), "file_type").alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(links.groupBy(suffix.alias("suffix"), F.col("relation").alias("what")).agg(F.count("*").alias("n")))


def language_coverage(spark, d):
    names = F.create_map(*[F.lit(x) for k, v in EX.LANGUAGES.items() for s in v.suffixes for x in (s, k)])
    want = code_files(spark, d).select(F.element_at(names, F.regexp_extract("path", r"(\.\w+)$", 1)).alias("language"), F.regexp_extract("path", r"f(\d+)\.", 1).alias("k"))
    want = want.select("language", F.explode(F.array(F.concat(F.lit("C"), "k"), F.concat(F.lit("run"), "k"))).alias("label"))
    return EX.coverage(code_files(spark, d), want).select("language", "expected", "found", F.round("coverage", 6).alias("coverage"))


def python_files(spark, d):
    k = (F.col("s_suppkey") + 99).cast("string")
    p = (F.col("s_suppkey") + 98).cast("string")
    body = F.concat(F.lit("from pkg.m"), p, F.lit(" import C"), p, F.lit("\n\n\nclass C"), k, F.lit("(C"), p, F.lit("):\n    def run"), k, F.lit("(self):\n        return run"), p, F.lit("(1)\n"))
    return table(spark, d, "supplier").select(F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), body.alias("content"))


def python_symbols(spark, d):
    return P.python_symbols(python_files(spark, d)).select("path", "kind", "name", "target", "line_no")


def python_graph(spark, d):
    nodes, links = P.python_graph(python_files(spark, d))
    return links.groupBy("relation").agg(F.count("*").alias("n")).unionByName(nodes.agg(F.lit("nodes").alias("relation"), F.count("*").alias("n")))


def python_types(spark, d):
    """Return types of functions that say them, and of those that only return constants."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, (" -> Optional[int]:\n    return x", " -> str:\n    return x", ":\n    return 'a'", ":\n    pass", ":\n    return x + 1"))), (k % 5 + 1).cast("int"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("t"), k, F.lit(".py")).alias("path"), F.concat(F.lit("def f"), k, F.lit("(x)"), kind, F.lit("\n")).alias("content"))
    return P.python_types(files).select("path", "name", "return_type", "is_optional", "confidence")


def dynamic_imports(spark, d):
    k = F.col("s_suppkey")
    body = F.concat(F.lit("import importlib\nNAME = 'pkg.n"), k + 1, F.lit("'\na = importlib.import_module("), F.when(k % 2 == 0, F.concat(F.lit("'pkg.n"), k + 2, F.lit("'"))).otherwise("NAME"), F.lit(")\nb = __import__(a)\n"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("pkg/n"), k, F.lit(".py")).alias("path"), body.alias("content"))
    return P.python_symbols(files).where("kind = 'imports'").select("path", "target", "line_no")


def spec_nodes(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("spec/"), "r_regionkey", F.lit(".json")).alias("path"), "r_name", "n_nationkey")
    paths = F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit('"/n/'), k.cast("string"), F.lit('/{id}": {"get": {"summary": "Read '), k.cast("string"), F.lit('"}, "post": {}, "x": 1}'))), ", ")
    body = F.concat(F.lit('{"openapi": "3.0", "info": {"title": "Api '), "r_name", F.lit('"}, "paths": {'), F.col("p"), F.lit('}, "components": {"schemas": {"Nation": {}}}}'))
    files = n.groupBy("path", "r_name").agg(paths.alias("p")).select("path", body.alias("content")).unionByName(table(spark, d, "region").select(F.concat(F.lit("other/"), "r_regionkey", F.lit(".json")).alias("path"), F.lit('{"a": 1').alias("content")))
    return ir.spec_nodes(files)


def _text_files(spark, d):
    """Documents as markdown: the first line of each becomes a heading, some stand in a fence."""
    k = F.col("doc_id")
    head = F.substring(F.regexp_replace(F.substring_index("text", "\n", 1), "[#`~]", ""), 1, 40)
    body = F.concat(F.lit("# Top "), k, F.lit("\n"), F.when(k % 3 == 0, "```\n# not\n```\n").otherwise(""), F.lit("## "), F.concat(F.lit("h "), head), F.lit("\nSee NIST AC-2 and CC6.1 and AC.L2-3.1.1 there.\nAnd AC-2 again.\n"))
    return table(spark, d, "documents").select(F.concat(F.lit("docs/d"), k, F.lit(".md")).alias("path"), body.alias("content"))


def markdown_headings(spark, d):
    return P.markdown_headings(_text_files(spark, d)).select("path", "id", "level", "title", "line_no")


def compliance_scan(spark, d):
    return P.compliance_notes(_text_files(spark, d)).select("path", "framework", "control", "first")


def ci_controls(spark, d):
    """Controls that changed files name, and in how many of them."""
    return GV.ci_check(P.compliance_notes(_text_files(spark, d)), "all").select("control", "files", F.md5("warning").alias("warning_md5"))


def document_chunks(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("docs/"), "lang", F.lit("/d"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return P.document_nodes(files).select("id", "chunk_index", "chunk_count", F.md5("content_text").alias("text_md5"))


def sniffed_files(spark, d):
    k = F.col("doc_id")
    head = F.when(k % 7 == 1, F.lit("%PDF-1.4 ")).when(k % 7 == 2, F.lit("MZ\x90")).otherwise("")
    raw = F.when(k % 7 == 3, F.unhex(F.lit("FFFEFD41"))).when(k % 7 == 4, F.concat(F.lit(b"a\x00b"), F.col("text").cast("binary"))).otherwise(F.concat(head, F.col("text")).cast("binary"))
    files = table(spark, d, "documents").select(F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".md").otherwise(".txt")).alias("path"), raw.alias("content"))
    return ir.sniffed(files)


def sql_objects(spark, d):
    k = F.col("p_partkey")
    what = F.element_at(F.array(*map(F.lit, ("CREATE TABLE t", "create or replace view v", "  Create Unique Index IF NOT EXISTS i", "SELECT x"))), (k % 4 + 1).cast("int"))
    return P.sql_objects(table(spark, d, "part").select(F.concat(F.lit("s"), k, F.lit(".sql")).alias("path"), F.concat(F.lit("-- first\n"), what, k, F.lit(" (a int);\n")).alias("content")))


def proto_objects(spark, d):
    k = F.col("p_partkey")
    return P.proto_objects(table(spark, d, "part").select(F.concat(F.lit("p"), k, F.lit(".proto")).alias("path"), F.concat(F.lit("message M"), k, F.lit(" {\n}\nservice S"), k, F.lit(" {\n  rpc R"), k, F.lit(" (M) returns (M);\n}\n")).alias("content")))


def routes(spark, d):
    k = F.col("page_id")
    verb = F.element_at(F.array(F.lit("get"), F.lit("post")), (k % 2 + 1).cast("int"))
    return P.routes(table(spark, d, "pages").select(F.concat(F.lit("r"), k, F.lit(".js")).alias("path"), F.concat(F.lit("app."), verb, F.lit("('/a/"), k % 50, F.lit("/:id', f);\nrouter.put(\"/b\", g);\n")).alias("content")))


def diff_ranges(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("--- a/f"), k, F.lit("\n+++ b/f"), k, F.lit("\n@@ -1,2 +"), F.col("o_custkey"), F.lit(",3 @@\n x\n@@ -9 +50 @@\n+y\n@@ -4,2 +4,0 @@\n-z\n"))
    return P.diff_ranges(table(spark, d, "orders").select(k.alias("id"), text.alias("diff")))


def test_references(spark, d):
    """Routes that test cases of pages name, live or skipped."""
    k = F.col("page_id")
    body = F.concat(F.when(k % 2 == 0, "const pool = realDb();\n").otherwise(""), F.lit("it"), F.when(k % 3 == 0, ".skip").otherwise(""), F.lit("('GET /a/"), k % 50, F.lit("/:id works', async () => {\n  await call('/b/"), k % 7, F.lit("');\n});\n"))
    return P.test_references(table(spark, d, "pages").select(F.concat(F.lit("t"), k, F.lit(".test.js")).alias("path"), body.alias("content")), "realDb").select("path", "route", "skipped", "real_db")


def importer_index(spark, d):
    n = NQ.code_nodes(spark, d)
    return GR.importer_index(n, NQ.code_links(spark, d)).groupBy("node").agg(F.count("*").alias("importers"))


def graph_spliced(spark, d):
    n, ln = NQ.code_nodes(spark, d), NQ.code_links(spark, d).withColumn("source_file", F.lit("x"))
    touched = n.select("source_file").where("source_file like 'src/brand1/%'").distinct()
    new = n.where("source_file like 'src/brand1/%' and file_type = 'code'")
    nodes, links = GR.spliced(n, ln, touched, new, ln.limit(0))
    return nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).unionByName(links.agg(F.lit("links").alias("what"), F.count("*").alias("n")))


def file_changes(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_size").alias("mtime"), F.md5("p_name").alias("hash"), F.col("p_partkey").alias("k"))
    now = p.select(F.when(F.col("k") % 11 == 0, F.concat(F.lit("new"), "k")).otherwise(F.col("path")).alias("path"), (F.col("mtime") + F.col("k") % 3 - 1).alias("mtime"), F.when(F.col("k") % 5 == 0, F.lit("z")).otherwise(F.col("hash")).alias("hash"))
    return GR.file_changes(p.drop("k"), now)


def embedding_changes(spark, d):
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text"))
    stored = table(spark, d, "documents").where("doc_id % 4 <> 3").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 1, F.lit("old")).otherwise(T.content_hash(F.col("text"))).alias("content_hash"))
    return P.embedding_changes(n, stored).groupBy("change").agg(F.count("*").alias("n"))


def label_forms(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("get"), F.initcap("p_name"), F.lit("HTTP_"), F.col("p_partkey"), F.lit(".py"))
    return p.select("p_partkey", T.norm_label(raw).alias("norm"), T.humanized(raw).alias("words"), T.line_number(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("L"), "p_size")).otherwise(F.lit("line"))).alias("line"))


def _rows(spark, d):
    """The code graph as maps of JSON values, with fields that the index doesn't know."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    names = ["id", "label", "file_type", "source_file", "source_location"]
    n = NQ.code_nodes(spark, d).select(F.map_concat(F.create_map(*[x for c in names for x in (F.lit(c), q(c))]), F.create_map(F.lit("community"), F.col("community").cast("string"), F.lit("odd"), F.concat(F.lit('{"c":'), F.col("community").cast("string"), F.lit("}")))).alias("row"))
    e = NQ.code_links(spark, d).select(F.create_map(F.lit("relation"), q("relation"), F.lit("_src"), q("source"), F.lit("target"), q("target"), F.lit("x"), F.lit("1")).alias("row"), "pos")
    return n, e


def ir_summary(spark, d):
    return ir.summary(ir.from_rows(*_rows(spark, d))[0])


def ir_round_trip(spark, d):
    """What comes back of nodes and links that became the index and a graph again."""
    n, e = ir.graph_rows(*ir.from_rows(*_rows(spark, d)))
    g = lambda c, *f: [F.get_json_object(c, f"$.{x}").alias(x) for x in f]
    a = n.select("id", *g("json", "label", "file_type", "source_file", "source_location"), F.get_json_object("json", "$.community").cast("int").alias("community"), F.get_json_object("json", "$.odd.c").cast("int").alias("odd"))
    same = NQ.code_nodes(spark, d).select("id", "label", "file_type", "source_file", "source_location", "community", F.col("community").alias("odd")).exceptAll(a).agg(F.count("*").alias("lost"))
    back = e.select(*g("json", "relation", "source", "target", "x")).groupBy("relation", "x").agg(F.count("*").alias("n"))
    return back.crossJoin(F.broadcast(same))


def coupled_docs(spark, d):
    k = F.col("p_partkey")
    folder = F.concat(F.lit("lib/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")))
    file = F.concat(folder, F.lit("/f"), k, F.when(k % 4 == 0, ".md").otherwise(".py"))
    n = table(spark, d, "part").select(P.slug(file).alias("id"), F.when(k % 4 == 0, "document").otherwise("code").alias("file_type"), file.alias("source_file"))
    return ir.coupled(n).select("source", "target", "relation", "confidence_score")


def prices(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(F.lit("team"), F.lit("business")), (F.col("c_custkey") % 2 + 1).cast("int")).alias("tier"), (F.col("c_custkey") % 30).alias("seats"), F.element_at(F.array(F.lit(1), F.lit(12), F.lit(6)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("months"))
    return c.select("c_custkey", GV.price(F.col("tier"), F.col("seats"), F.col("months"), {("team", 1): 10.0, ("team", 12): 100.0, ("business", 1): 20.0, ("business", 12): 200.0}).alias("price"))


def publishing(spark, d):
    s = MQ.synapses(spark, d).where("namespace in ('personal', 'shared')").select("weight", F.when(F.col("namespace") == "shared", "team").otherwise("personal").alias("scope"), (F.col("activation_count") % 2 == 1).alias("on"))
    return TM.publishable(s, F.col("on"), F.col("scope"), F.lit(0.4)).groupBy("scope", "on", "allowed").agg(F.count("*").alias("n"))


def reachable_projects(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("client"), F.concat(F.lit("p"), F.col("c_nationkey")).alias("project"))
    shared = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("client"), F.concat(F.lit("p"), F.col("c_nationkey")).alias("project"))
    return GV.reachable_projects(c, shared)


def loser_weights(spark, d):
    s = TM.contribution(MQ.synapses(spark, d), MQ.NOW)
    return s.select(*M.PAIR, TM.loser_weight(F.round("score", 6), F.lit(0.5)).alias("weight"))


def memory_nodes(spark, d):
    return M.distinct_nodes(MQ.synapses(spark, d), MQ.transitions(spark, d)).agg(F.count("*").alias("n"), F.min("node").alias("first"))


def validation_summary(spark, d):
    n = NQ.code_nodes(spark, d)
    return G.validate(n, NQ.code_links(spark, d)).groupBy("severity", "kind").agg(F.count("*").alias("issues"), F.sum("n").alias("n"))


_F = (extracted_symbols, extracted_graph, language_coverage, python_symbols, python_graph, python_types, dynamic_imports, spec_nodes, markdown_headings, compliance_scan, ci_controls, document_chunks, sniffed_files, sql_objects, proto_objects, routes, diff_ranges, test_references, importer_index, graph_spliced, file_changes, embedding_changes, label_forms, ir_summary, ir_round_trip, coupled_docs, prices, publishing, reachable_projects, loser_weights, memory_nodes, validation_summary)
QUERIES = {f.__name__: f for f in _F}

_SUF = "['" + "', '".join(TEMPLATES) + "'][(s_suppkey % 9 + 1)::INT]"
_LANG = "['typescript', 'go', 'rust', 'java', 'c', 'cpp', 'csharp', 'ruby', 'php'][(s_suppkey % 9 + 1)::INT]"
_MD = r"""md AS (SELECT 'docs/d' || doc_id || '.md' AS path, doc_id, substr(regexp_replace(string_split(text, chr(10))[1], '[#`~]', '', 'g'), 1, 40) AS head, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 2 END AS pl FROM documents WHERE text IS NOT NULL)"""
ORACLES = {
    "extracted_symbols": f"""WITH f AS (SELECT s_suppkey + 99 AS k, 'src' || k || '/f' || k || {_SUF} AS path FROM supplier)
SELECT path, 'class' AS kind, 'C' || k AS label FROM f UNION ALL SELECT path, 'function', 'run' || k || '()' FROM f UNION ALL SELECT path, 'rationale', 'Note ' || k || ' here.' FROM f""",
    "extracted_graph": f"""WITH f AS (SELECT s_suppkey AS k, s_suppkey % 9 AS l, {_SUF} AS suffix, s_suppkey >= 9 AS after FROM supplier)
SELECT suffix, 'node code' AS what, count(*) * 3 + count(*) FILTER (NOT after AND l IN (0, 2, 3, 5, 6, 7, 8)) AS n FROM f GROUP BY 1 UNION ALL SELECT suffix, 'node rationale', count(*) FROM f GROUP BY 1 UNION ALL SELECT suffix, 'contains', count(*) * 2 FROM f GROUP BY 1 UNION ALL SELECT suffix, 'rationale_for', count(*) FROM f GROUP BY 1
UNION ALL SELECT suffix, 'calls', count(*) FROM f WHERE after GROUP BY 1 UNION ALL SELECT suffix, 'inherits', count(*) FROM f WHERE l NOT IN (1, 4) GROUP BY 1 UNION ALL SELECT suffix, 'imports_from', count(*) FROM f WHERE after AND l IN (1, 2, 3, 6, 8) GROUP BY 1""",
    "language_coverage": f"SELECT {_LANG} AS language, 2 * count(*) AS expected, 2 * count(*) AS found, 1.0::DOUBLE AS coverage FROM supplier GROUP BY 1",
    "python_symbols": """WITH f AS (SELECT s_suppkey + 99 AS k, s_suppkey + 98 AS p, 'pkg/m' || k || '.py' AS path FROM supplier)
SELECT path, 'imports' AS kind, '' AS name, 'pkg.m' || p AS target, 1 AS line_no FROM f UNION ALL SELECT path, 'class', 'C' || k, '', 4 FROM f UNION ALL SELECT path, 'inherits', 'C' || k, 'C' || p, 4 FROM f UNION ALL SELECT path, 'method', 'C' || k || '.run' || k, '', 5 FROM f UNION ALL SELECT path, 'calls', 'C' || k || '.run' || k, 'run' || p, 6 FROM f""",
    "python_graph": "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT 'nodes' AS relation, n * 3 AS n FROM n UNION ALL SELECT 'contains', n * 2 FROM n UNION ALL SELECT 'imports_from', n - 1 FROM n UNION ALL SELECT 'inherits', n - 1 FROM n UNION ALL SELECT 'calls', n - 1 FROM n",
    "python_types": "SELECT 't' || s_suppkey || '.py' AS path, 'f' || s_suppkey AS name, ['Optional[int]', 'str', 'str', 'None', NULL][(s_suppkey % 5 + 1)::INT] AS return_type, s_suppkey % 5 = 0 AS is_optional, [0.9, 0.9, 0.7, 0.7, 0.0][(s_suppkey % 5 + 1)::INT]::DOUBLE AS confidence FROM supplier",
    "dynamic_imports": "SELECT 'pkg/n' || s_suppkey || '.py' AS path, 'importlib' AS target, 1 AS line_no FROM supplier UNION ALL SELECT 'pkg/n' || s_suppkey || '.py', 'pkg.n' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 2 ELSE s_suppkey + 1 END, 3 FROM supplier",
    "spec_nodes": """WITH r AS (SELECT 'spec/' || r_regionkey || '.json' AS path, 'spec_' || r_regionkey || '_json' AS f, r_name, r_regionkey FROM region)
SELECT path, f AS id, 'Api ' || r_name AS label, NULL AS parent FROM r WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT path, f || '__get_n_' || n_nationkey || '_id', 'Read ' || n_nationkey, f FROM r JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT path, f || '__post_n_' || n_nationkey || '_id', 'POST /n/' || n_nationkey || '/{id}', f FROM r JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT path, f || '__schema_nation', 'schema:Nation', f FROM r WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
    "markdown_headings": f"""WITH {_MD} SELECT path, 'docs_d' || doc_id || '_md__h1' AS id, 1 AS level, 'Top ' || doc_id AS title, 1 AS line_no FROM md UNION ALL SELECT path, 'docs_d' || doc_id || '_md__h' || pl, 2, trim('h ' || head), pl FROM md""",
    "compliance_scan": f"""WITH {_MD} SELECT path, f AS framework, c AS control, (pl + 1)::INT AS first FROM md, (VALUES ('NIST-800-53', 'AC-2'), ('CMMC', 'AC.L2-3.1.1'), ('SOC2', 'CC6.1')) v(f, c)""",
    "ci_controls": f"""WITH {_MD}, f AS (SELECT string_agg(path, ', ' ORDER BY path) AS l, count(*) AS n FROM md) SELECT c AS control, n AS files, md5('The change touches ' || l || ' (' || c || '). Verify compliance controls are maintained.') AS warning_md5 FROM f, (SELECT unnest(['AC-2', 'AC.L2-3.1.1', 'CC6.1']) AS c)""",
    "document_chunks": """WITH c AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), n AS (SELECT *, CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 450)::INT + 1 END AS n FROM c), x AS (SELECT *, unnest(range(n)) AS i FROM n)
SELECT 'doc:d' || doc_id || '.txt.' || substr(md5('docs/' || lang), 1, 8) || CASE WHEN n > 1 THEN ':chunk' || i ELSE '' END AS id, i::INT AS chunk_index, n AS chunk_count, md5(substr(text, i * 450 + 1, 500)) AS text_md5 FROM x""",
    "sniffed_files": "SELECT 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS path, CASE doc_id % 7 WHEN 1 THEN 'pdf' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' ELSE CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'text' END END AS kind FROM documents",
    "sql_objects": "SELECT 's' || p_partkey || '.sql' AS path, ['table', 'view', 'index'][(p_partkey % 4 + 1)::INT] AS kind, ['t', 'v', 'i'][(p_partkey % 4 + 1)::INT] || p_partkey AS name, 2 AS line_no FROM part WHERE p_partkey % 4 < 3",
    "proto_objects": "SELECT 'p' || p_partkey || '.proto' AS path, k AS kind, n || p_partkey AS name, l::INT AS line_no FROM part, (VALUES ('message', 'M', 1), ('service', 'S', 3), ('rpc', 'R', 4)) v(k, n, l)",
    "routes": "SELECT 'r' || page_id || '.js' AS path, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/a/' || (page_id % 50) || '/:id' AS route FROM pages UNION ALL SELECT 'r' || page_id || '.js', 'PUT', '/b' FROM pages",
    "diff_ranges": "SELECT o_orderkey AS id, 'f' || o_orderkey AS path, o_custkey::INT AS first, (o_custkey + 2)::INT AS last FROM orders UNION ALL SELECT o_orderkey, 'f' || o_orderkey, 50, 50 FROM orders",
    "test_references": "SELECT 't' || page_id || '.test.js' AS path, unnest(['/a/' || (page_id % 50) || '/:param', '/b/' || (page_id % 7)]) AS route, page_id % 3 = 0 AS skipped, page_id % 2 = 0 AND page_id % 3 <> 0 AS real_db FROM pages",
    "importer_index": f"WITH {NQ._N}, {NQ._L} SELECT b.source_file AS node, count(DISTINCT a.source_file) AS importers FROM gl JOIN gn a ON a.id = gl.source JOIN gn b ON b.id = gl.target WHERE relation <> 'rationale_for' AND a.source_file <> b.source_file GROUP BY 1",
    "graph_spliced": f"WITH {NQ._N}, {NQ._L}, s AS (SELECT id FROM gn WHERE source_file NOT LIKE 'src/brand1/%' OR file_type = 'code') SELECT 'nodes' AS what, count(*) AS n FROM s UNION ALL SELECT 'links', count(*) FROM gl WHERE source IN (FROM s) AND target IN (FROM s)",
    "file_changes": "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE p_partkey % 11 = 0 OR (p_partkey % 5 = 0 AND p_partkey % 3 = 2) UNION ALL SELECT 'new' || p_partkey, 'added' FROM part WHERE p_partkey % 11 = 0",
    "embedding_changes": "SELECT CASE doc_id % 4 WHEN 3 THEN 'added' WHEN 1 THEN 'updated' ELSE 'skipped' END AS change, count(*) AS n FROM documents GROUP BY 1",
    "label_forms": r"""SELECT p_partkey, 'get' || replace(p_name, ' ', '_') || 'http_' || p_partkey || '_py' AS norm, 'get ' || p_name || ' http ' || p_partkey AS words, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END::INT AS line FROM part""",
    "ir_summary": f"WITH {NQ._N} SELECT 'kind' AS what, CASE file_type WHEN 'rationale' THEN 'rationale' WHEN 'document' THEN 'document' ELSE 'function' END AS name, count(*) AS n FROM gn GROUP BY 2 UNION ALL SELECT 'language', 'python', count(*) FROM gn",
    "ir_round_trip": f"WITH {NQ._L} SELECT relation, '1' AS x, count(*) AS n, 0::BIGINT AS lost FROM gl GROUP BY 1",
    "coupled_docs": """WITH n AS (SELECT 'lib/' || replace(lower(p_brand), '#', '') AS d, 'lib/' || replace(lower(p_brand), '#', '') || '/f' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.md' ELSE '.py' END AS f, p_partkey % 4 = 0 AS doc FROM part)
SELECT regexp_replace(a.f, '[^a-z0-9]+', '_', 'g') AS source, regexp_replace(b.f, '[^a-z0-9]+', '_', 'g') AS target, 'describes' AS relation, 0.8::DOUBLE AS confidence_score FROM n a JOIN n b USING (d) WHERE a.doc AND NOT b.doc ORDER BY a.f, b.f LIMIT 50""",
    "prices": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE (c_custkey % 30) * CASE c_custkey % 2 WHEN 0 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END * CASE WHEN c_custkey % 3 = 1 THEN 10 ELSE 1 END END AS price FROM customer",
    "publishing": f"WITH {MQ._SYN}, s AS (SELECT weight, CASE namespace WHEN 'shared' THEN 'team' ELSE 'personal' END AS scope, activation_count % 2 = 1 AS on_ FROM syn WHERE namespace IN ('personal', 'shared')) SELECT scope, on_ AS \"on\", NOT on_ OR (scope <> 'personal' AND weight >= 0.4) AS allowed, count(*) AS n FROM s GROUP BY ALL",
    "loser_weights": f"WITH {MQ._SYN}, {MQ._CON} SELECT node_a, node_b, namespace, round(greatest(0.01::DOUBLE, round(score, 6) * greatest(0.1::DOUBLE, 0.5::DOUBLE - 0.15::DOUBLE)), 4) AS weight FROM con",
    "reachable_projects": "SELECT c_custkey AS client, 'p' || c_nationkey AS project FROM customer UNION SELECT c_custkey, 'shared' FROM customer UNION SELECT c_custkey + 1, 'p' || c_nationkey FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)",
    "memory_nodes": f"WITH {MQ._SYN}, mn AS (SELECT node_a AS node FROM syn UNION SELECT node_b FROM syn UNION SELECT node FROM (SELECT event_type || '_' || (trunc(value)::INT % 5) AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, lag(event_type || '_' || (trunc(value)::INT % 5)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lead(event_type || '_' || (trunc(value)::INT % 5)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE b <> node OR f <> node) SELECT count(*) AS n, min(node) AS first FROM mn",
    "validation_summary": f"""WITH {NQ._N}, {NQ._L}, en AS (SELECT source AS id FROM gl UNION ALL SELECT target FROM gl), i AS (SELECT 'error' AS severity, 'dangling' AS kind, count(*) AS n FROM en WHERE id NOT IN (SELECT id FROM gn) GROUP BY id UNION ALL SELECT 'warning', 'orphan', 1 FROM gn WHERE id NOT IN (SELECT id FROM en))
SELECT severity, kind, count(*) AS issues, sum(n)::BIGINT AS n FROM i GROUP BY ALL""",
}
