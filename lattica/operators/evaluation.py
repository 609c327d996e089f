"""Retrieval evaluation: precision, recall, MRR, nDCG, hits, fact recall, contradiction, fitness, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

KS = (1, 3, 5, 10)
# Words that negate what follows them.
NEGATIONS = ["no", "not", "never", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "cannot", "can't", "won't", "without", "false", "incorrect", "invalid", "unable"]


def first_occurrences(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, item) without blank items and repeats, ranked anew."""
    rows = ranked.where("item is not null and item <> ''").groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item")))


def per_query(ranked: DataFrame, relevant: DataFrame, ks: tuple = KS) -> DataFrame:
    """A row a query of ranked (query_id, rank, item) against relevant (query_id, item): P, R, nDCG, hit at each k, and RR; all 0 if nothing was found."""
    rel = relevant.select("query_id", "item").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = ranked.join(rel.withColumn("good", F.lit(1)), ["query_id", "item"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    cols = [F.count("*").alias("n"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        top = (F.col("rank") <= k) & (F.col("good") == 1)
        cols += [F.count_if(top).alias(f"h{k}"), F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"d{k}")]
    out = marked.groupBy("query_id").agg(*cols).join(n_rel, "query_id", "full_outer").na.fill(0, ["n_rel", "n", *[f"h{k}" for k in ks], *[f"d{k}" for k in ks]])
    names = [F.col("query_id"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        names += [
            F.coalesce(F.try_divide(F.col(f"h{k}"), F.least(F.lit(k), F.col("n"))), F.lit(0.0)).alias(f"p{k}"),
            F.when(F.col("n_rel") > 0, F.col(f"h{k}") / F.col("n_rel")).otherwise(0.0).alias(f"r{k}"),
            F.when(F.col("n_rel") > 0, F.col(f"d{k}") / ideal).otherwise(0.0).alias(f"ndcg{k}"),
            (F.col(f"h{k}") > 0).cast("int").alias(f"hit{k}"),
        ]
    return out.select(*names)


def summary(per: DataFrame) -> DataFrame:
    return per.agg(F.count("*").alias("queries"), F.avg("rr").alias("mrr"), *[F.avg(c).alias(c) for c in per.columns if c not in ("query_id", "rr")])


def graded_ndcg(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) with gains of 2 to the grade, less one."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    got = ranked.where(F.col("rank") <= k).join(grades, ["query_id", "item"]).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")
    best = grades.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def fact_recall(rows: DataFrame) -> DataFrame:
    """(id, recall) of rows (id, answer, facts array): the share of facts (two characters or more) all of whose words the answer holds."""
    low = F.lower("answer")
    facts = F.filter("facts", lambda f: F.length(F.trim(f)) >= 2)
    found = F.filter(facts, lambda f: F.forall(F.split(F.lower(F.trim(f)), r"\s+"), lambda t: low.contains(t)))
    return rows.select("id", F.when(F.size(facts) > 0, F.size(found) / F.size(facts)).otherwise(0.0).alias("recall"))


def negated(answer: Column, token: Column) -> Column:
    """Whether one of the three words within 20 characters before the token's first occurrence negates it."""
    low = F.lower(answer)
    at = F.position(token, low)
    window = F.substring(low, F.greatest(F.lit(1), at - 20), F.least(F.lit(20), at - 1))
    words = F.filter(F.split(window, r"\s+"), lambda w: w != "")
    last = F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3)
    return (at > 0) & F.exists(last, lambda w: w.isin(NEGATIONS))


# Answers of which only one can be right.
EXCLUSIVE = [("sqlite", "postgresql"), ("sqlite", "postgres"), ("sqlite", "mysql"), ("stripe", "paypal"), ("jwt", "oauth"), ("hs256", "rs256"), ("soft-delete", "hard-delete"), ("sync", "async")]


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def contradictions(rows: DataFrame) -> DataFrame:
    """(id, contradiction) of rows (id, answer, facts array): half the share of facts told but negated, half of those told otherwise.

    Told: the answer holds all words of a fact (two characters or more). Told otherwise: the fact names one of two
    that exclude each other, and the answer only the other one.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    facts = F.filter("facts", lambda f: F.length(F.trim(f)) >= 2)
    flipped = F.filter(facts, lambda f: (F.size(_tokens(f)) > 0) & F.forall(_tokens(f), lambda t: low.contains(t)) & F.exists(_tokens(f), lambda t: negated(low, t)))
    other = lambda f, a, b: F.array_contains(_tokens(f), a) & low.contains(b) & ~low.contains(a)
    swapped = F.filter(facts, lambda f: sum(((other(f, a, b) | other(f, b, a)).cast("int") for a, b in EXCLUSIVE), F.lit(0)) > 0)
    n = F.size(facts)
    return rows.select("id", F.when(n > 0, 0.5 * F.size(flipped) / n + 0.5 * F.size(swapped) / n).otherwise(0.0).alias("contradiction"))


def judged_contradictions(rows: DataFrame) -> DataFrame:
    """(id, contradiction) of rows (id, answer, facts): of the choices that the facts settle, the share in which the answer names another side."""
    gold, low = F.lower(F.array_join("facts", " ")), F.lower(F.coalesce("answer", F.lit("")))
    held = lambda text, w: text.rlike(rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)")
    settled, wrong = F.lit(0), F.lit(0)
    for a, b in EXCLUSIVE:
        one, two = held(gold, a), held(gold, b)
        settled = settled + (one != two).cast("int")
        wrong = wrong + ((one & ~two & held(low, b)) | (two & ~one & held(low, a))).cast("int")
    return rows.select("id", F.coalesce(F.try_divide(wrong, settled), F.lit(0.0)).alias("contradiction"))


def faithfulness(rows: DataFrame) -> DataFrame:
    """(id, recall, contradiction, faithfulness) of rows (id, answer, facts): recall less what is contradicted."""
    return fact_recall(rows).join(contradictions(rows), "id").withColumn("faithfulness", F.col("recall") * (1 - F.col("contradiction")))


def context_scores(queries: DataFrame, retrieved: DataFrame, facts: DataFrame, cosine) -> DataFrame:
    """(id, context_precision, context_recall, answer_relevance) from vectors: queries (id, query, answer, gold), retrieved and facts (id, vec).

    Precision is the share of retrieved texts with a positive cosine to the facts as a whole (gold), recall that of
    facts with one to any retrieved text; ``cosine`` is a function of two columns.
    """
    near = retrieved.join(queries.select("id", "gold"), "id").groupBy("id").agg(F.avg((cosine(F.col("vec"), F.col("gold")) > 0).cast("int")).alias("context_precision"))
    f = facts.withColumn("nth", F.monotonically_increasing_id())
    hit = f.join(retrieved.select("id", F.col("vec").alias("other")), "id").groupBy("id", "nth").agg(F.max(cosine(F.col("vec"), F.col("other"))).alias("best"))
    recall = f.select("id", "nth").join(hit, ["id", "nth"], "left").groupBy("id").agg(F.avg((F.coalesce("best", F.lit(0.0)) > 0).cast("int")).alias("context_recall"))
    out = queries.select("id", cosine(F.col("answer"), F.col("query")).alias("answer_relevance")).join(near, "id", "left").join(recall, "id", "left")
    return out.select("id", F.coalesce("context_precision", F.lit(0.0)).alias("context_precision"), F.coalesce("context_recall", F.lit(0.0)).alias("context_recall"), "answer_relevance")


def answerable(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, answerable): whether the first k hold anything relevant; queries without relevant items can't."""
    found = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").select("query_id").distinct().withColumn("answerable", F.lit(True))
    every = ranked.select("query_id").union(relevant.select("query_id")).distinct()
    return every.join(found, "query_id", "left").select("query_id", F.coalesce("answerable", F.lit(False)).alias("answerable"))


def percentile(rows: DataFrame, col: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """(by…, value): the value at place floor(fraction · n), from 0, of the values in order; found from counts, not by gathering."""
    keys = by or []
    n = rows.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys).orderBy(col)
    n = n.withColumn("_upto", F.sum("_k").over(w)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*keys)))
    place = F.least(F.floor(F.col("_n") * fraction), F.col("_n") - 1)
    return n.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_k") <= place)).select(*keys, F.col(col).alias("value"))


def against_baseline(means: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """(metric, baseline, current, delta) for the metrics that both have; below 0 is a loss."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(v)).alias("baseline"), F.col(m).cast("double").alias("current")) for m, v in baseline.items() if m in means.columns])
    return means.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.round(F.col("current") - F.col("baseline"), 4))


def side_by_side(arms: DataFrame) -> DataFrame:
    """(query_id, one row) of arms (query_id, arm, answer, facts, modules): recall, grounding and contradiction of each arm, a column each.

    Grounding is the share of the expected modules that the answer names.
    """
    rows = arms.withColumn("id", F.struct("query_id", "arm"))
    low = F.lower(F.coalesce("answer", F.lit("")))
    ground = rows.select("id", F.when(F.size("modules") > 0, F.size(F.filter("modules", lambda m: low.contains(F.lower(m)))) / F.size("modules")).otherwise(0.0).alias("grounding"), F.floor(F.length("answer") / C.CHARS_PER_TOKEN).alias("tokens"))
    j = fact_recall(rows).join(judged_contradictions(rows), "id").join(ground, "id").select("id.query_id", "id.arm", "recall", "grounding", "contradiction", "tokens")
    return j.groupBy("query_id").pivot("arm").agg(*[F.first(c).alias(c) for c in ("recall", "grounding", "contradiction", "tokens")])


def harness(summary_row: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """One row (fitness, passed) of suite means (mrr, answerability, …): 0.6 MRR and 0.4 answerability, and whether all floors hold."""
    floors = floors or C.QUALITY_FLOORS
    ok = F.lit(True)
    for m, v in floors.items():
        if m in summary_row.columns:
            ok = ok & (F.col(m) >= v)
    f = 0.6 * F.col("mrr") + 0.4 * F.col("answerability")
    return summary_row.select(F.when(F.isnan(f), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))).alias("fitness"), ok.alias("passed"))


def parsed_weights(raw: str | None) -> tuple[float, float, float]:
    """Three weights that sum to 1 of a text like ``0.5,0.3,0.2``; the default for anything else."""
    try:
        found = [float(p) for p in (raw or "").split(",") if p.strip()]
    except ValueError:
        return C.FITNESS_WEIGHTS
    total = sum(found)
    if len(found) != 3 or not all(0 <= x < float("inf") for x in found) or total <= 0:
        return C.FITNESS_WEIGHTS
    return found[0] / total, found[1] / total, found[2] / total


def session_health(rate: Column) -> Column:
    """1 less the rate of repeated questions; 1 where nothing is known."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(rate, F.lit(0.0))))


def fixture_queries(nodes: DataFrame, n: int = 20, of: int = 50) -> DataFrame:
    """(query, expected array): the first ``of`` distinct labels by id as questions, each with the nodes of that label; n by question."""
    named = nodes.where("label <> ''").groupBy("label").agg(F.min("id").alias("first"), F.array_sort(F.collect_set("id")).alias("expected")).orderBy("first").limit(of)
    return named.orderBy("label").limit(n).select(F.col("label").alias("query"), "expected")


def transcripts(rows: DataFrame) -> DataFrame:
    """Judge transcripts of benchmark rows (id, question, facts, modules, category, language, fixture) that have facts."""
    facts = F.filter("facts", lambda f: F.coalesce(f, F.lit("")) != "")
    return rows.where(F.size(facts) > 0).select(F.coalesce("question", F.lit("")).alias("query"), F.array_join(facts, " ").alias("reference_answer"), F.transform("modules", lambda m: F.concat("fixture", F.lit("/"), m)).alias("source_files"), F.coalesce("category", F.lit("architecture")).alias("category"), "language", F.col("id").alias("query_id"))


def transcript_issues(rows: DataFrame) -> DataFrame:
    """(query_id, issue): what is missing in transcripts (query_id, query, reference_answer, expected_facts array)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    facts = F.transform("expected_facts", lambda f, i: F.when(blank(f), F.format_string("expected_facts[%d]: empty fact", i)))
    found = F.concat(F.array(F.when(blank(F.col("query")), "empty query"), F.when(blank(F.col("reference_answer")), "empty reference_answer")), F.coalesce(facts, F.array().cast("array<string>")))
    return rows.select("query_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def fitness(quality: Column, health: Column, efficiency: Column, weights: tuple = C.FITNESS_WEIGHTS) -> Column:
    """Weighted product of three values clamped to 0..1 (efficiency to 0..10 over 10); 0 if any is 0."""
    clamp = lambda x, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), x))
    parts = [clamp(quality, 1), clamp(health, 1), clamp(efficiency, 10) / 10]
    log = sum((w * F.log(p) for w, p in zip(weights, parts)), F.lit(0.0))
    return F.when((parts[0] == 0) | (parts[1] == 0) | (parts[2] == 0), 0.0).otherwise(F.round(F.exp(log), 6))


def failed_floors(means: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, floor) of one row of means below their floors."""
    floors = floors or C.QUALITY_FLOORS
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("floor")) for m, v in floors.items() if m in means.columns])
    return means.select(F.explode(rows).alias("r")).select("r.*").where("value < floor")


def decide(candidate: Column, incumbent: Column, verdict: Column, hysteresis: float = C.HYSTERESIS) -> Column:
    return F.when(verdict == "rollback", "rollback").when((verdict == "promote") & (candidate >= incumbent + hysteresis), "promote").otherwise("hold")


def recall_width(current: Column, rate: Column, margin: Column) -> Column:
    """The next number of communities recalled: more if users often ask again, fewer if hardly."""
    return F.when((rate > 0.40) & (margin < 0.70), F.least(F.lit(6), current + 1)).when(rate < 0.15, F.greatest(F.lit(2), current - 1)).otherwise(current)


def resolve_entities(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(id, action, entity, similarity) of labels (id, label) against known (entity, label).

    Equal normalised labels merge; else the entity of the greatest token-set cosine (first by id on ties)
    merges from 0.95, is reviewed from 0.85, and is distinct below; similarities below 0.85 count as 0. A match shares one of
    each side's rarest tokens, all but so many that the rest couldn't reach the bound: only those are joined. Equal
    token sets are one.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    toks = lambda df, i: df.select(F.col(i), F.array_sort(F.array_distinct(F.filter(F.split(norm(F.col("label")), "_"), lambda t: t != ""))).alias("t"), norm(F.col("label")).alias("norm"))
    a, b = toks(labels, "id"), toks(known, "entity")
    exact = a.join(b.groupBy("norm").agg(F.min("entity").alias("entity")), "norm").select("id", "entity", F.lit(1.0).alias("similarity"))
    left, right = a.select("t").distinct(), b.groupBy("t").agg(F.min("entity").alias("entity"))
    df = left.unionByName(right.select("t")).select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    by_rare = Window.partitionBy("t").orderBy("df", "tok")

    def prefix(sets: DataFrame) -> DataFrame:
        rows = sets.select("t", F.size("t").alias("n"), F.explode("t").alias("tok")).join(df, "tok").withColumn("nth", F.row_number().over(by_rare))
        # of n tokens a match holds 0.85 squared or more, so one of the n - that + 1 rarest
        return rows.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * C.ENTITY_REVIEW**2 - 1e-9) + 1).select("t", "n", "tok")

    x, y = prefix(left), prefix(right.select("t"))
    near = (F.col("n") >= F.col("m") * C.ENTITY_REVIEW**2 - 1e-9) & (F.col("m") >= F.col("n") * C.ENTITY_REVIEW**2 - 1e-9)
    pairs = x.join(y.select(F.col("t").alias("u"), F.col("n").alias("m"), "tok"), "tok").where(near).select("t", "u").distinct()
    pairs = pairs.withColumn("similarity", F.size(F.array_intersect("t", "u")) / F.sqrt(F.size("t") * F.size("u"))).where(F.col("similarity") >= C.ENTITY_REVIEW - 1e-12)
    best = pairs.join(right.withColumnRenamed("t", "u"), "u").groupBy("t").agg(F.max(F.struct("similarity", (-F.col("entity")).alias("minus"))).alias("b")).select("t", (-F.col("b.minus")).alias("entity"), F.col("b.similarity").alias("similarity"))
    rest = a.join(exact.select("id"), "id", "left_anti").join(best, "t").select("id", "entity", "similarity")
    out = labels.select("id").join(exact.unionByName(rest), "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    action = F.when(F.col("similarity") >= C.ENTITY_MERGE, "merge").when(F.col("similarity") >= C.ENTITY_REVIEW, "review").otherwise("distinct")
    return out.select("id", action.alias("action"), F.when(F.col("similarity") >= C.ENTITY_REVIEW, F.col("entity")).alias("entity"), F.round("similarity", 6).alias("similarity"))


def registered(rows: DataFrame) -> DataFrame:
    """(norm, anchor, entity): the last registration by seq of each normalised label and anchor, of rows (entity, label, anchor, seq)."""
    norm = F.trim(F.regexp_replace(F.lower(F.trim("label")), "[^a-z0-9]+", "_"), F.lit("_"))
    return rows.groupBy(norm.alias("norm"), "anchor").agg(F.max_by("entity", "seq").alias("entity"))
