"""Text functions as column expressions: tokenisers, chunks, hashes, token estimates, paths, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def code_tokens(text: Column) -> Column:
    """Lower-case tokens of code-like text: camelCase and non-alphanumerics split; short and all-digit ones left out."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, " "), "[^a-zA-Z0-9]+")
    return F.transform(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")), F.lower)


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / C.CHARS_PER_TOKEN)


def truncated(text: Column, tokens: int) -> Column:
    most = tokens * C.CHARS_PER_TOKEN
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunks(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Array of overlapping chunks; one if the text fits in ``size``."""
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap")
    n, step = F.length(text), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size)))


def norm_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def humanized(label: Column) -> Column:
    bare = F.regexp_replace(label, r"\.(py|ts|tsx|js|jsx|go|rs|java|rb|php|c|h|cpp|hpp|cs|md)$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, CAMEL, " "), r"[^a-zA-Z0-9]+", " ")))


def normalized_path(path: Column) -> Column:
    """Route parameters of every style become ``:param``; a trailing slash goes."""
    p = F.trim(F.trim(path), F.lit("\"'`"))
    p = F.regexp_replace(p, r"\$\{[^}]*\}", ":param")
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", ":param")
    p = F.regexp_replace(p, r"\{[^}]*\}", ":param")
    p = F.regexp_replace(p, r"\*+", ":param")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def line_number(location: Column) -> Column:
    """``L42`` to 42, anything else to 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(location, F.lit("")), r"^L(\d+)$", 1).try_cast("int"), F.lit(0))


# Words and suffixes that tell a code question from a documentation question.
CODE_WORDS = [
    "implement", "function", "class", "method", "code", "source", "file", "def ", "class ", "import ", "from ", "module", "component", "handler",
    "service", "controller", "model", "route", "endpoint", "api", "config", "constant", "type", "interface", "schema", "query", "mutation", "migration",
]
CODE_SUFFIXES = [".py", ".ts", ".js", ".java", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".c", ".cpp", ".h", ".hpp", ".cs", ".scala", ".m", ".mm"]
DOC_WORDS = [
    "explain", "what is", "how does", "documentation", "readme", "guide", "tutorial", "why", "when should", "concept", "overview", "architecture",
    "design", "pattern", "principle", "best practice", "introduction",
]
FILE_PATH, DEFINITION = r"[a-zA-Z0-9_/\\]+\.[a-zA-Z]{2,4}\b", r"\b(def|class|function|method|func)\s+\w+"


def intent(query: Column, threshold: float = 0.6) -> Column:
    """code, docs or hybrid, by the words and file names of a question."""
    low = F.lower(query)
    held = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    code = held(CODE_WORDS) + 2 * held(CODE_SUFFIXES) + 3 * query.rlike(FILE_PATH).cast("int") + 3 * query.rlike(DEFINITION).cast("int")
    docs = held(DOC_WORDS)
    return F.when(code > docs * (1 + threshold), "code").when(docs > code * (1 + threshold), "docs").otherwise("hybrid")


# What tells the domain of a node id.
DECISION_PREFIXES = ["archive_", "decision_"]
CODE_ENDS = "__fn _fn __cls _cls __var _var".split()
FILE_ENDS = "_py _ts _tsx _js _jsx _c _h _cpp _hpp _cs _go _java _rb _rs _php _swift _kt _scala _lua _pl _sh _sql _toml _yaml _yml _json _txt _css _scss _html _xml".split()
CODE_PATH = r"\.(py|ts|tsx|js|jsx|c|h|cpp|hpp|cs|go|java|rb|rs|php|swift|kt|sql|sh|toml)$"
DOC_PATH = r"\.(md|mdoc|rst|txt|doc|docx)$"


def domain(node: Column) -> Column:
    """decision, document, code or unknown, by ordered rules on a node id."""
    ends = lambda words: node.rlike(f"({'|'.join(words)})$")
    return (
        F.when(node.isNull() | (node == ""), "unknown")
        .when(node.rlike(f"^({'|'.join(DECISION_PREFIXES)})") | node.rlike(r"^community_-?\d+$"), "decision")
        .when(node.rlike(r"__h\d+$") | node.endswith("_md"), "document")
        .when(ends(CODE_ENDS) | node.rlike(r"__\w+_sym$") | ends(FILE_ENDS) | node.startswith("benchmark_"), "code")
        .when(node.contains("rationale"), "decision")
        .when(node.startswith("/") & F.lower(node).rlike(CODE_PATH), "code")
        .when(node.startswith("/") & F.lower(node).rlike(DOC_PATH), "document")
        .otherwise("unknown")
    )


def optional_type(kind: Column) -> Column:
    """Whether a type annotation allows a missing value (``None`` alone doesn't count)."""
    t = F.trim(kind)
    return (t != "None") & (t.rlike(r"^(typing\.)?Optional\[") | t.rlike(r"\|\s*None\b") | t.rlike(r"\bNone\s*\|") | t.rlike(r"^Option<") | t.rlike(r"\|\s*(null|undefined)\b") | t.rlike(r"\?$"))
