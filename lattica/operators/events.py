"""Event-log analytics: session rates, savings, metrics, audit summaries and hash chains, limits and windows."""

from __future__ import annotations

import json
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

# Dollars for a million input tokens by model; the first is the default.
PRICES = {"default": 3.0, "small": 0.25, "medium": 3.0, "large": 15.0}


def sessions(events: DataFrame, user: str, ts: str, order: str, gap_seconds: int = 1800) -> DataFrame:
    """``events`` with session: a new one starts after a pause of more than the gap."""
    w = Window.partitionBy(user).orderBy(ts, order)
    fresh = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return events.withColumn("_fresh", fresh).withColumn("session", F.concat_ws("-", F.col(user).cast("string"), F.sum("_fresh").over(w).cast("string"))).drop("_fresh")


def re_query_rate(queries: DataFrame) -> DataFrame:
    """One row (pairs, re_queries, rate) of queries (session, pos, communities): consecutive ones that overlap by half or more.

    Overlap is over the smaller set; pairs with an empty set and rows without a session don't count.
    """
    w = Window.partitionBy("session").orderBy("pos")
    q = queries.where("session is not null").select("session", "pos", F.array_distinct(F.coalesce("communities", F.array().cast(dict(queries.dtypes)["communities"]))).alias("now"))
    q = q.withColumn("before", F.lag("now").over(w)).withColumn("least", F.least(F.size("now"), F.size("before"))).where("before is not null and least > 0")
    again = F.count_if(F.size(F.array_intersect("now", "before")) / F.col("least") >= 0.5)
    return q.agg(F.count("*").alias("pairs"), again.alias("re_queries")).withColumn("rate", F.coalesce(F.try_divide(F.col("re_queries"), F.col("pairs")), F.lit(0.0)))


def escalation_rate(queries: DataFrame, layers: str = "layers") -> DataFrame:
    """One row (queries, escalated, rate): those that used layer L3 or one of its parts."""
    deep = F.exists(layers, lambda x: (x == "L3") | x.startswith("L3:"))
    return queries.agg(F.count("*").alias("queries"), F.count_if(deep).alias("escalated")).withColumn("rate", F.coalesce(F.try_divide(F.col("escalated"), F.col("queries")), F.lit(0.0)))


def wakeup_only_rate(events: DataFrame) -> DataFrame:
    """One row (sessions, wakeup_only, rate) of events (session, kind): sessions with a wakeup that never query."""
    per = events.where("session is not null").groupBy("session").agg(F.count_if(F.col("kind") == "wakeup").alias("w"), F.count_if(F.col("kind") == "query").alias("q")).where("w > 0")
    return per.agg(F.count("*").alias("sessions"), F.count_if(F.col("q") == 0).alias("wakeup_only")).withColumn("rate", F.coalesce(F.try_divide(F.col("wakeup_only"), F.col("sessions")), F.lit(0.0)))


def savings(events: DataFrame, model: str = "default", per_day: int = 100, days: int = 30) -> DataFrame:
    """One row of totals of events (kind, tokens, ratio): tokens used and saved against reading everything, and dollars."""
    price = PRICES.get(model, PRICES["default"])
    a = events.agg(
        F.count_if(F.col("kind") != "wakeup").alias("queries"), F.count_if(F.col("kind") == "wakeup").alias("wakeups"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_used"),
        F.avg(F.when(F.col("kind") != "wakeup", F.col("ratio"))).alias("avg_ratio"), F.coalesce(F.sum(F.when(F.col("kind") != "wakeup", C.BASELINE_TOKENS - F.col("tokens"))), F.lit(0)).alias("query_saved"),
    )
    a = a.withColumn("tokens_baseline", (F.col("queries") + F.col("wakeups")) * C.BASELINE_TOKENS).withColumn("tokens_saved", F.col("tokens_baseline") - F.col("tokens_used"))
    a = a.withColumn("dollars_saved", F.round(F.col("tokens_saved") * price / 1e6, 4))
    a = a.withColumn("dollars_month", F.round(F.coalesce(F.try_divide(F.col("query_saved"), F.col("queries")), F.lit(0.0)) * price / 1e6 * per_day * days, 2))
    return a.drop("query_saved")


def metrics_summary(metrics: DataFrame, now: float, days: int = 7) -> DataFrame:
    """One row a kind of metrics (event, ts, latency_ms, reuse, tokens): the last days' means, missing values left out."""
    m = metrics.where(F.col("ts") >= now - days * C.DAY)
    return m.groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 2).alias("latency_ms"), F.round(F.avg("reuse"), 4).alias("reuse"), F.round(F.avg("tokens"), 0).alias("tokens"), F.sum("tokens").alias("total_tokens"))


def audit_search(audit: DataFrame, category: str | None = None, action: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Events whose fields contain the words, in any case, within string bounds of time, in line order."""
    out = audit
    for name, word in (("category", category), ("action", action), ("actor", actor)):
        if word:
            out = out.where(F.lower(name).contains(word.lower()))
    out = out.where(F.col("timestamp") >= since) if since else out
    out = out.where(F.col("timestamp") <= until) if until else out
    return out.orderBy("line_no").limit(limit) if limit else out


# Categories and words of actions by which an event counts for a control family.
CONTROLS = {"AC": (["security", "mcp", "auth", "rbac"], "access|rbac|deny|allow|rate_limit"), "SI": (["backend", "system", "admin"], "switch_backend|build|integrity|failure")}


def control_counts(audit: DataFrame) -> DataFrame:
    """One row (events, AU, AC, SI): all events count for AU, others by their category or action."""
    hit = {k: F.col("category").isin(names) | F.lower("action").rlike(words) for k, (names, words) in CONTROLS.items()}
    return audit.agg(F.count("*").alias("events"), F.count("*").alias("AU"), *[F.count_if(F.coalesce(h, F.lit(False))).alias(k) for k, h in hit.items()])


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") != "success").alias("failed"), F.max("timestamp").alias("last"))


def cef() -> Column:
    """An audit event as a CEF line; severity 0 if it succeeded, else 5."""
    severity = F.when(F.col("status") == "success", 0).otherwise(5)
    return F.format_string("CEF:0|lattica|audit|1|%s|%s|%d|suser=%s act=%s", F.col("category"), F.col("action"), severity, F.col("actor"), F.col("action"))


ZERO = "0" * 64
#: Independent runs of calls that one group holds: fewer, larger groups.
RUNS_TOGETHER = 64


def chain_broken(audit: DataFrame, digest: Column, buckets: int = 256, first: str = ZERO) -> DataFrame:
    """The first line (bad_line) of audit (line_no, sha256, ...) whose hash isn't ``digest`` of prev and the line; no row if none.

    ``digest`` may use the column prev, the hash stored in the line before in order of line_no, whatever numbers are
    missing (``first`` at first, and after a line without a hash). Such lines, from before the chain, aren't checked. Ranges
    of line_no look at the last line of the one before, so the log isn't sorted in one task.
    """
    low, high = audit.agg(F.min("line_no"), F.max("line_no")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    rows = audit.withColumn("_b", F.floor((F.col("line_no") - F.lit(low or 0)) / width))
    ends = rows.groupBy("_b").agg(F.max_by(F.coalesce("sha256", F.lit("")), "line_no").alias("_last"))
    ends = ends.withColumn("_end", F.lag("_last").over(Window.orderBy("_b"))).select("_b", "_end")  # at most ``buckets`` rows
    before = F.lag(F.coalesce("sha256", F.lit(""))).over(Window.partitionBy("_b").orderBy("line_no"))
    linked = rows.withColumn("prev", before).join(F.broadcast(ends), "_b").withColumn("prev", F.coalesce(F.nullif(F.coalesce("prev", "_end"), F.lit("")), F.lit(first)))
    return linked.where((F.coalesce("sha256", F.lit("")) != "") & (F.col("sha256") != digest)).agg(F.min("line_no").alias("bad_line")).where("bad_line is not null")


def canonical_digest(columns: list[str]):
    """A pandas UDF: SHA-256 of prev and the canonical JSON (sorted keys, no blanks) of the columns."""

    @F.pandas_udf("string")
    def digest(prev: pd.Series, rows: pd.DataFrame) -> pd.Series:
        return pd.Series([sha256((p + json.dumps(dict(zip(columns, r)), sort_keys=True, separators=(",", ":"))).encode()).hexdigest() for p, r in zip(prev, rows.itertuples(index=False))])

    return digest(F.col("prev"), F.struct(*columns))


def rate_limited(calls: DataFrame, limit: int = 60, window_seconds: float = 60.0) -> DataFrame:
    """calls (actor, seq, ts in seconds) with allowed: at most ``limit`` admitted calls an actor within the window.

    Only admitted calls count, so admission depends on all before it. Calls of an actor with a pause of
    the window between them can't affect each other, so the unit of work is an actor's run without one.
    """
    w = Window.partitionBy("actor").orderBy("ts", "seq")
    runs = calls.withColumn("_new", F.coalesce((F.col("ts") - F.lag("ts").over(w) >= window_seconds).cast("int"), F.lit(1))).withColumn("_run", F.floor(F.sum("_new").over(w) / RUNS_TOGETHER)).drop("_new")

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        held, out = [], []
        for t in pdf["ts"]:
            held = [x for x in held if x > t - window_seconds]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(t)
        return pdf.assign(allowed=out).drop(columns="_run")

    kinds = dict(calls.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in calls.columns) + ", allowed boolean"
    return runs.groupBy("actor", "_run").applyInPandas(admit, schema)


def breaker_states(results: DataFrame, failures: int = 3, timeout: float = 30.0) -> DataFrame:
    """results (key, seq, ts, ok) with the circuit breaker's state after each: closed, open or half_open."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, bad, since, out = "closed", 0, 0.0, []
        pdf = pdf.sort_values(["ts", "seq"])
        for t, ok in zip(pdf["ts"], pdf["ok"]):
            if state == "open" and t - since >= timeout:
                state = "half_open"
            if ok:
                state, bad = ("closed", 0) if state != "open" else (state, bad)
            else:
                bad += 1
                if state == "half_open" or bad >= failures:
                    since = t if state != "open" else since
                    state = "open"
            out.append(state)
        return pdf.assign(state=out)

    kinds = dict(results.dtypes)
    return results.groupBy("key").applyInPandas(walk, ", ".join(f"`{c}` {kinds[c]}" for c in results.columns) + ", state string")


def debounced(events: DataFrame, key: str, ts: str, gap: str = "750 milliseconds") -> DataFrame:
    """(key, first, last, n): runs of events of a key without a pause of the gap; what a trailing debounce fires on."""
    return events.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def keep_last(log: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last n lines of a log."""
    return log.orderBy(F.desc(order)).limit(n)


def repeat_rate(traces: DataFrame) -> DataFrame:
    """One row (total, repeats, rate): repeated fingerprints over all traces."""
    per = traces.groupBy("fingerprint").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeats")).withColumn("rate", F.col("repeats") / F.col("total"))


