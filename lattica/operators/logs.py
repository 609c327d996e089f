"""Logs that grow: events to append, retention, the hash chain, and what of a tool's output is shown."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..base import cut, delete, fresh_folder

MAX_HITS, METRIC_DAYS, METRIC_BYTES, METRIC_LINES, AUDIT_DAYS = 12, 30, 10_000_000, 1000, 90
MAX_MATCHES, OFFLOAD_CHARS, PREVIEW, OUTPUT_BYTES, LEAST_SIDE = 25, 15_000, 500, 2 * 1024 * 1024, 1024
# The fields of an audit event in the order in which they are hashed, and fields that hold paths.
AUDIT_FIELDS = ["action", "actor", "actor_role", "category", "details", "ip_address", "status", "target", "timestamp"]
PATH_FIELDS = ["source_file", "module", "path"]
LEVELS = [("debug", r"^\s*(\[?\s*(DEBUG|TRACE|debug|trace)\b|\w*\s+debug:)"), ("info", r"^\s*(\[?\s*(INFO|info)\b|\w*\s+info:)"), ("warn", r"^\s*\[?\s*(WARN(ING)?|warn(ing)?)\b")]
#: Lines of one range of a chain, which is hashed in one task, and ranges of a lap, whose last hashes are found in one task before.
CHAIN_RANGE, LAP_RANGES = 50_000, 10


def query_events(results: DataFrame, project: str, consent: bool = True) -> DataFrame:
    """Events to append for results (ts, session_id, query, layers, communities, hits, tokens, reduction); without consent none.

    A result without a query is a wakeup.
    """
    rows = results if consent else results.limit(0)
    what = F.struct(F.coalesce("layers", F.array().cast("array<string>")).alias("layers_used"), F.coalesce("communities", F.array().cast("array<int>")).alias("communities_loaded"), F.coalesce("hits", F.lit(0)).cast("int").alias("search_hits"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.round("reduction", 4).alias("reduction_ratio"))
    return rows.select(F.when(F.col("query").isNull(), "wakeup").otherwise("query").alias("event_type"), F.col("ts").alias("timestamp"), F.lit(project).alias("project_path"), "session_id", F.coalesce("query", F.lit("")).alias("query"), what.alias("retrieval_summary"))


def query_records(results: DataFrame) -> DataFrame:
    """Records for the log of recent queries: results (ts, query, tokens, reduction, layers, communities, top array of hits) with the first MAX_HITS hits."""
    hits = F.transform(F.slice("top", 1, MAX_HITS), lambda h: F.struct(h["id"].alias("id"), F.coalesce(h["label"], h["id"]).alias("label"), F.coalesce(h["source_file"], F.lit("")).alias("source_file"), F.round(h["score"], 3).alias("score")))
    return results.select("ts", F.col("query").alias("question"), "tokens", F.round("reduction", 2).alias("reduction_ratio"), F.col("layers").alias("layers_used"), F.col("communities").alias("communities_loaded"), hits.alias("top_hits"))


def metric_events(rows: DataFrame, event: str) -> DataFrame:
    """Metrics of queries or builds to append, rounded, with day, by which they are stored."""
    places = {"latency_ms": 2, "retrieval_reuse_rate": 4, "duration_s": 2}
    kept = [F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in rows.columns]
    return rows.select(F.lit(event).alias("event"), *kept, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"))


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """``rows`` added to a log of JSON lines, in folders by a column if one is named."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def rotated(metrics: DataFrame, now: float, days: int = METRIC_DAYS, most_bytes: int = METRIC_BYTES, lines: int = METRIC_LINES) -> DataFrame:
    """``metrics`` (day, ts, …) that stay: days of the last ``days``, of days over the bytes the last lines by ts.

    A day's bytes are those of its rows as JSON.
    """
    first = F.date_format(F.timestamp_seconds(F.lit(now - days * C.DAY)), "yyyy-MM-dd")
    fresh = metrics.where(F.col("day") >= first)
    size = fresh.groupBy("day").agg(F.sum(F.length(F.to_json(F.struct(*fresh.columns))) + 1).alias("_bytes")).where(F.col("_bytes") > most_bytes).select("day")
    over = fresh.join(F.broadcast(size), "day", "left_semi")  # one row a day
    last = over.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts")))).where(F.col("_n") <= lines).drop("_n")
    return fresh.join(F.broadcast(size), "day", "left_anti").unionByName(last)


def canonical(prev: str = "prev") -> Column:
    """The text of an audit event that is hashed: the hash before it and its fields as JSON, by name, without blanks."""
    value = lambda f: _escaped(F.coalesce(F.col(f), F.lit("{}")), False) if f == "details" else F.concat(F.lit('"'), _escaped(F.coalesce(F.col(f), F.lit("")), True), F.lit('"'))
    text = F.concat(F.lit("{"), *[x for i, f in enumerate(AUDIT_FIELDS) for x in (F.lit(f'{"," if i else ""}"{f}":'), value(f))], F.lit("}"))
    return F.concat(F.col(prev), text)


def _escaped(text: Column, marks: bool) -> Column:
    """``text`` with characters beyond plain ASCII as \\u and four hexadecimal digits of each UTF-16 unit; with ``marks`` also quotes, backslashes and controls as JSON escapes them."""
    digits = F.lower(F.hex(F.encode(text, "UTF-16BE")))
    units = F.transform(F.sequence(F.lit(0), (F.length(digits) / 4 - 1).cast("int")), lambda i: F.substring(digits, i * 4 + 1, F.lit(4)))
    named = {"0022": '\\"', "005c": "\\\\", "000a": "\\n", "000d": "\\r", "0009": "\\t", "0008": "\\b", "000c": "\\f"}

    def one(u: Column) -> Column:
        plain = F.char(F.conv(u, 16, 10).cast("bigint"))
        long = F.concat(F.lit("\\u"), u)
        if not marks:
            return F.when(u > "007e", long).otherwise(plain)
        short = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), u)
        return F.when((u < "0020") | (u > "007e") | u.isin("0022", "005c"), F.coalesce(short, long)).otherwise(plain)

    odd = text.rlike(r'[^ -~]|["\\\\]' if marks else "[^\\x00-~]")
    return F.when(odd, F.array_join(F.transform(units, one), "")).otherwise(text)


def _quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def chained(events: DataFrame, last: str = "0" * 64) -> DataFrame:
    """``events`` (line_no, the audit fields) with prev_sha256 and sha256: each line's hash takes in the one before.

    A chain can only be made in order. Of more lines than a range, the hash before each range is found first: the texts are
    stored once by laps of ranges, and each lap is hashed by one task that reads only its own lines, one lap after another.
    Then all ranges are hashed at the same time. Checking a chain needs no order.
    """
    rows = events.where("line_no is not null").withColumn("prev", F.lit("")).withColumn("_text", canonical()).drop("prev")
    low, high = rows.agg(F.min("line_no"), F.max("line_no")).first()
    if low is None:
        return events.withColumn("prev_sha256", F.lit(None).cast("string")).withColumn("sha256", F.lit(None).cast("string"))
    rows = rows.withColumn("_range", F.floor((F.col("line_no") - low) / CHAIN_RANGE).cast("long"))
    starts = {0: last} if high - low < CHAIN_RANGE else _range_starts(rows.select("line_no", "_range", "_text"), last)
    kinds = ", ".join(f"`{c}` {k}" for c, k in events.dtypes) + ", prev_sha256 string, sha256 string"

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_no", "_text"])
        prev, now, before = starts[int(pdf["_range"].iloc[0])], [], []
        for t in pdf["_text"]:
            before.append(prev)
            prev = sha256((prev + t).encode()).hexdigest()
            now.append(prev)
        return pdf.drop(columns=["_text", "_range"]).assign(prev_sha256=before, sha256=now)

    out = rows.groupBy("_range").applyInPandas(link, kinds)
    return out if len(starts) == 1 else cut(out)


def _range_starts(rows: DataFrame, last: str) -> dict[int, str]:
    """The hash before each range of rows (line_no, _range, _text): a lap of LAP_RANGES in one task, one after another."""
    folder = fresh_folder(rows.sparkSession, "chain")
    rows.withColumn("_lap", F.floor(F.col("_range") / LAP_RANGES)).repartition("_lap").sortWithinPartitions("_lap", "line_no", "_text").write.partitionBy("_lap").parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.parquet(f"{folder}/rows")

    def hasher(prev: str):
        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, now = None, prev
            for pdf in batches:
                for r, t in zip(pdf["_range"], pdf["_text"]):
                    if r != at and at is not None:
                        yield pd.DataFrame({"r": [at], "sha": [now]})
                    at, now = r, sha256((now + t).encode()).hexdigest()
            if at is not None:
                yield pd.DataFrame({"r": [at], "sha": [now]})

        return ends

    starts = {}
    for (lap,) in sorted(stored.select("_lap").distinct().collect()):
        one = stored.where(F.col("_lap") == lap).coalesce(1).sortWithinPartitions("line_no", "_text").select("_range", "_text")
        for r, sha in sorted(one.mapInPandas(hasher(last), "r long, sha string").collect()):
            starts[r], last = last, sha
    delete(rows.sparkSession, folder)
    return starts


def archived(audit: DataFrame, archives: DataFrame, now: float, most_bytes: int = 100_000_000, days: int = AUDIT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(archive, due) of a log's archives (archive, ts) that are too old, and (rotate, bytes, last_sha256) of the log, one row.

    When a log is rotated, the new one goes on from last_sha256.
    """
    size = audit.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*audit.columns))) + 1), F.lit(0)).alias("bytes"), F.coalesce(F.max_by("sha256", "line_no"), F.lit("0" * 64)).alias("last_sha256"))
    return archives.select("archive", (F.col("ts") < now - days * C.DAY).alias("due")), size.select((F.col("bytes") >= most_bytes).alias("rotate"), "bytes", "last_sha256")


def live_events(rows: DataFrame, process: int) -> DataFrame:
    """(value): rows (type, ts, payload as JSON object) as compact lines for the live log."""
    body = F.regexp_replace(F.coalesce("payload", F.lit("{}")), r"^\{|\}$", "")
    head = F.concat(F.lit('{"type":'), _quoted(F.col("type")), F.lit(',"ts":'), F.col("ts").cast("string"), F.lit(f',"_pid":{process}'))
    return rows.select(F.concat(head, F.when(body != "", F.concat(F.lit(","), body)).otherwise(""), F.lit("}")).alias("value"))


def recent(events: DataFrame, since: str | None = None, last: int | None = None) -> DataFrame:
    """Events (line_no, timestamp) from a time on, compared as strings, the last ``last`` of them."""
    out = events.where(F.col("timestamp") >= since) if since else events
    return out.orderBy(F.desc("line_no")).limit(last) if last else out


def traces(rows: DataFrame, session: str | None = None, fingerprint: str | None = None, strategy: str | None = None, outcome: str | None = None, since: float | None = None, until: float | None = None, least: float | None = None, limit: int = 100, newest: bool = True) -> DataFrame:
    """Reasoning traces (id, session_id, timestamp, fingerprint, strategy, outcome, success) that meet all given bounds, by time."""
    out = rows
    for c, v in (("session_id", session), ("fingerprint", fingerprint), ("strategy", strategy), ("outcome", outcome)):
        out = out.where(F.col(c) == v) if v is not None else out
    out = out.where(F.col("timestamp") >= since) if since is not None else out
    out = out.where(F.col("timestamp") <= until) if until is not None else out
    out = out.where(F.col("success") >= least) if least is not None else out
    return out.orderBy(*([F.desc("timestamp"), F.desc("id")] if newest else ["timestamp", "id"])).limit(limit)


def trace_count(rows: DataFrame, session: str | None = None) -> DataFrame:
    return (rows.where(F.col("session_id") == session) if session else rows).agg(F.count("*").alias("n"))


def successful(rows: DataFrame, least: float = 0.7, session: str | None = None, limit: int = 50) -> DataFrame:
    """(fingerprint, timestamp): the newest ``limit`` distinct fingerprints among the newest 2 · limit traces that went well."""
    found = traces(rows, session=session, least=least, limit=2 * limit)
    return found.groupBy("fingerprint").agg(F.max("timestamp").alias("timestamp"), F.max("id").alias("id")).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).select("fingerprint", "timestamp")


# --- tool output


def line_kind(line: Column) -> Column:
    """blank, debug, info, warn or other."""
    out = F.when(F.trim(line) == "", "blank")
    for name, pattern in LEVELS:
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("other")


def dropped_summary(lines: DataFrame) -> DataFrame:
    """(id, summary) of lines (id, line, emitted boolean: shown): how many lines were left out, by kind, and what repeats.

    A line shown once of n counts n - 1 times. Kinds come by number, then name; of the lines left out five times or more the two most frequent are told.
    """
    n = lines.groupBy("id", "line").agg(F.count("*").alias("all"), F.count_if("emitted").alias("shown"))
    left = n.withColumn("n", F.col("all") - F.col("shown")).where("n > 0")
    kinds = left.groupBy("id", line_kind(F.col("line")).alias("kind")).agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), lambda s: F.format_string("%d %s", -s["m"], s["kind"])), ", ").alias("kinds"))
    often = left.where("trim(line) <> '' and n >= 5").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.trim("line").alias("t")))), 1, 2).alias("top"))
    told = F.when(F.size("top") > 0, F.concat(F.lit("; repeated: "), F.array_join(F.transform("top", lambda s: F.format_string("%d× '%s'", -s["m"], F.substring(s["t"], 1, 50))), "; "))).otherwise("")
    return kinds.join(often, "id", "left").select("id", F.concat(F.format_string("%d lines (%s)", "total", "kinds"), F.coalesce(told, F.lit(""))).alias("summary"))


def capped_matches(output: Column, most: int = MAX_MATCHES) -> Column:
    """Search output of at most so many lines that aren't blank, and how many are hidden."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    note = F.format_string(f"\n[capped at {most} matches. %d more hidden.]", F.size(lines) - most)
    return F.when(F.size(lines) <= most, output).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), note))


def offloaded(content: Column, where: Column, most: int = OFFLOAD_CHARS) -> Column:
    """Large content as its ends and where the whole is kept."""
    n = F.length(content)
    text = F.concat(
        F.format_string("[content offloaded (%d chars → %s)]\n", n, where), F.lit(f"--- head ({PREVIEW} chars) ---\n"), F.substring(content, 1, PREVIEW), F.lit(f"\n--- tail ({PREVIEW} chars) ---\n"),
        content.substr(n - PREVIEW + 1, F.lit(PREVIEW)), F.format_string("\n[Full content at: %s]", where),
    )
    return F.when(n <= most, content).otherwise(text)


def kept_ends(text: Column, budget: Column) -> Column:
    """A text cut to about ``budget`` characters in its middle."""
    keep = F.floor(budget / 2).cast("int")
    tail = (budget - keep).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), keep), F.format_string("\n\n[... %d bytes elided by output cache ...]\n\n", F.length(text) - budget), text.substr(F.length(text) - tail + 1, tail))
    return F.when((F.length(text) <= budget) | (budget <= 0), text).otherwise(cut)


def last_outputs(outputs: DataFrame, most: int = OUTPUT_BYTES) -> DataFrame:
    """outputs (id, ts, command, exit_code, stdout, stderr) as they are kept: both streams share ``most`` by their lengths."""
    a, b = F.length("stdout"), F.length("stderr")
    total = a + b
    first = F.when(b == 0, F.lit(most)).when(a == 0, F.lit(0)).otherwise(F.greatest(F.lit(LEAST_SIDE), F.floor(most * a / total))).cast("int")
    second = F.when(b == 0, F.lit(0)).when(a == 0, F.lit(most)).otherwise(F.greatest(F.lit(LEAST_SIDE), F.lit(most) - first)).cast("int")
    over = total > most
    return outputs.select("id", "ts", F.substring(F.coalesce("command", F.lit("")), 1, 500).alias("command"), "exit_code", F.when(over, kept_ends(F.col("stdout"), first)).otherwise(F.col("stdout")).alias("stdout"), F.when(over, kept_ends(F.col("stderr"), second)).otherwise(F.col("stderr")).alias("stderr"))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def redacted(text: Column) -> Column:
    """JSON in which the paths of PATH_FIELDS, at any depth, are file names only."""
    return F.regexp_replace(text, rf'("(?:{"|".join(PATH_FIELDS)})"\s*:\s*")[^"]*[/\\]([^"/\\]*")', "$1$2")


def gold_files(patches: DataFrame) -> DataFrame:
    """(id, files) of unified diffs (id, patch): names of the files they leave, in order, each once."""
    heads = F.filter(F.split("patch", "\n"), lambda x: x.startswith("+++ "))
    paths = F.transform(heads, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^\+\+\+ ([^\t]*)", 1), r"^b/", "")))
    return patches.select("id", F.array_distinct(F.filter(F.transform(F.filter(paths, lambda p: (p != "") & (p != "/dev/null")), basename), lambda n: n != "")).alias("files"))


def decisions(commits: DataFrame) -> DataFrame:
    """(sha, rationale, subjects) of commits (sha, message) with a ``Decision:`` trailer, its indented lines joined.

    Subjects are those of a ``Subjects:`` trailer and what stands in backticks, each once whatever its case.
    """
    lines = F.split("message", r"\r?\n")
    w = Window.partitionBy("sha").orderBy("pos")
    rows = commits.select("sha", F.posexplode(lines).alias("pos", "line"))
    head = F.col("line").rlike(r"(?i)^decision:\s*")
    names = F.col("line").rlike(r"(?i)^subjects:\s*")
    more = F.col("line").rlike(r"^\s+\S")
    rows = rows.withColumn("run", F.sum(F.when(head | ~more, 1).otherwise(0)).over(w)).withColumn("starts", F.first(F.when(head, True)).over(Window.partitionBy("sha", "run").orderBy("pos")))
    part = F.when(head, F.trim(F.regexp_replace("line", r"(?i)^decision:\s*", ""))).when(F.col("starts") & more, F.trim("line"))
    told = rows.select("sha", "pos", part.alias("part"), F.when(names, F.trim(F.regexp_replace("line", r"(?i)^subjects:\s*", ""))).alias("subjects"))
    each = told.groupBy("sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("pos", "part")))), lambda s: s["part"]), " ").alias("rationale"), F.max_by("subjects", F.when(F.col("subjects").isNotNull(), F.col("pos"))).alias("given"))
    ticks = F.regexp_extract_all("rationale", F.lit("`([^`]+)`"), F.lit(1))
    bare = lambda s: F.trim(F.regexp_replace(F.trim(F.trim(s), F.lit("`")), r"\(\)$", ""))
    every = F.filter(F.transform(F.concat(F.split(F.coalesce("given", F.lit("")), ","), ticks), bare), lambda s: s != "")
    unique = F.filter(every, lambda s, i: F.array_position(F.transform(every, F.lower), F.lower(s)) == i + 1)
    return each.where("rationale <> ''").select("sha", "rationale", unique.alias("subjects"))
