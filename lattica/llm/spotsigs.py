"""Document fingerprints by SpotSigs (operator 2), in DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of the next ``CHAIN`` content words
after it, common words skipped. A document's fingerprint is the set of its signatures, 32 bits
each; a text without any has one signature of its whole text. Likeness is the Jaccard similarity of
two sets. ``classes`` links all sets of at least a similarity: they are partitioned by length so
that only sets of the same or the next partition can reach it, of each set only those
signatures are indexed that a match can't do without, the rarest ones, and pairs that sizes or sketches rule out aren't compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .common import connected_components, cut, drop, small, stored_as

CHAIN = 2
SIMILARITY = 0.8
#: 64-bit words of a parity sketch of a set.
SKETCH = 4
#: So many of the most frequent signatures of a sample come last in the order of prefixes, in tiers, the most frequent last of all.
TIERS = (4_000, 400, 40)
# Anchors, common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be been by for from had has have he her his in into is it its not of on or she that the their there they this
to was were which who will with you
als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist man mit nach nicht noch sich
sie sind so um und von war wie wir zu zum zur
au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous ou où par pas plus pour qu que qui sa
se ses son sont sur un une vous
al como con del el ella era ha las lo los más me mi muy no nos para pero por porque sin sobre su sus también te todo y ya
""".split()
#: Rows of one range bucket of the id order, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the sorted set of 32-bit signatures of a text column, never empty.

    With A the positions of anchors and C the content words, the j-th anchor, at position i, has i - j
    content words before it, so its chain starts at C[i - j]. Words, A and C are columns on the way.
    """
    w, a, c = f"{name}_w", f"{name}_a", f"{name}_c"
    text = F.coalesce(F.col(text_col), F.lit(""))
    anchor = lambda x: x.isin(ANCHORS)

    def spot(i: Column, j: Column) -> Column:
        return F.when(i - j + CHAIN <= F.size(c), F.xxhash64(F.get(F.col(w), i), *[F.get(F.col(c), i - j + k) for k in range(CHAIN)]).bitwiseAND(F.lit(0xFFFFFFFF)))

    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    out = df.withColumn(w, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    out = out.withColumn(a, F.filter(F.transform(w, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull()))
    out = out.withColumn(c, F.filter(w, lambda x: ~anchor(x)))
    out = out.withColumn(name, F.array_sort(F.array_distinct(F.filter(F.transform(a, spot), lambda s: s.isNotNull()))))
    return out.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole)).drop(w, a, c)


def encoded(sigs: str) -> Column:
    """A set of signatures as a string: 8 hex digits each, ascending."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def next_to(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derive=None) -> DataFrame:
    """Each row's (id, text, what ``derive`` adds) with those of the next row in (id, text) order, _next_*; the first after the last.

    Rows go to range buckets of the id by its approximate quantiles, in one shuffle; the first rows of a
    bucket also go to the one before as guards, so no order over the whole table is needed.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("_id"), order.alias("_order"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, low = rows.agg(F.count("*"), F.min("_order")).first()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    bounds: list[int] = []
    if buckets > 1:
        # told as text: as literals many shares would be a plan of as many nodes, and shares must be constants
        shares = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
        bounds = sorted({x for x in rows.agg(F.percentile_approx("_order", shares, max(10_000, 8 * buckets))).first()[0] if x > low})
    # two levels of bounds: a row is compared with about twice the square root of their number
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_order")))
    if bounds:
        top = below(literal([p[0] for p in parts]))
        rows = rows.withColumn("_top", top)
        inner = F.get(F.array(*map(literal, parts)), F.col("_top") - 1)
        rows = rows.withColumn("_bucket", F.when(F.col("_top") == 0, 0).otherwise((F.col("_top") - 1) * width + below(inner)).cast("int")).drop("_top")
        first = F.col("_order") == F.get(literal(bounds), F.col("_bucket") - 1)
    else:
        rows, first = rows.withColumn("_bucket", F.lit(0)), F.lit(False)
    place = lambda b, g: F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("guard"))
    places = F.array(
        place(F.col("_bucket"), 0),
        F.when((F.col("_bucket") > 0) & first, place(F.col("_bucket") - 1, 1)),
        F.when(F.col("_order") == low, place(F.lit(len(bounds)), 2)),
    )
    rows = rows.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    rows = rows.select("_id", "_order", "_text", F.col("_place.bucket").alias("_bucket"), F.col("_place.guard").alias("_guard")).repartition("_bucket")
    rows = derive(rows) if derive else rows
    own = [c for c in rows.columns if c not in ("_id", "_order", "_bucket", "_guard")]
    w = Window.partitionBy("_bucket").orderBy("_guard", "_order", "_text")
    for c in own:
        rows = rows.withColumn(f"_next{c}", F.lead(c).over(w))
    return rows.where("_guard = 0").drop("_order", "_bucket", "_guard")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; with ``least`` also class_id and n_links.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next
    row's text, by ascending id (null ids first, ties by text, the first row after the last). Null texts
    count as empty; an empty text has one signature and is like another empty one. class_id is the smallest id of
    the row's class at that similarity (see ``classes``), n_links how many other fingerprints its own is linked to.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    following = next_to(docs, id_col, text_col, lambda rows: with_signatures(rows, "_text", "_sig"))
    n = F.length("_text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - tail), F.substring(F.col("_next_text"), F.lit(1), tail))
    rows = following.withColumn("_edited", edited).withColumn("_n", n.cast("long")).withColumn("_sha", F.sha2("_edited", 256)).drop("_text", "_next_text")
    rows = with_signatures(rows, "_edited", "_esig")
    more = []
    if least is not None:
        with stored_as("uncompressed"):  # many small tables of hashes: codecs' native buffers would add up to more than they save
            known = classes(docs, least, id_col, text_col)
        known = known.select(F.col("set_hash").alias("_set"), F.col("class_id").alias("_class"), F.col("n_links").alias("_links"))
        # only fingerprints of several texts or with links are looked up; others are their own class
        rows = rows.join(small(known, known.count()), F.xxhash64("_sig") == F.col("_set"), "left")
        more = [F.coalesce("_class", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).alias("n_links")]
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        encoded("_sig").alias("fingerprint"), encoded("_esig").alias("edited_fingerprint"),
        likeness("_sig", "_esig").alias("near_edited"), likeness("_sig", "_next_sig").alias("near_next"), *more,
    )


def _sketch(sig: str) -> Column:
    """SKETCH numbers: bit i of all is the parity of the signatures that fall to it."""
    part = lambda j: F.aggregate(F.filter(sig, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(SKETCH - 1)) == j), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    return F.array(*[part(j) for j in range(SKETCH)])


def _rare_first(sets: DataFrame) -> Column:
    """The signatures of ``sets`` (id, sig) in one order of all: rare ones by number, then frequent ones tier by tier.

    Signatures are counted in one set of near.SAMPLE (in all of up to near.ALL_TEXTS); a poor sample costs time but no pair.
    """
    some = sets.where(F.pmod("id", F.lit(1 if sets.count() <= near.ALL_TEXTS else near.SAMPLE)) == 0)
    counts = some.select(F.explode("sig").alias("s")).groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") >= near.FREQUENT)
    frequent = [r.s for r in counts.orderBy(F.desc("k"), "s").limit(TIERS[0]).collect()]
    if not frequent:
        return F.col("sig")
    tier = lambda s: sum((s.isin(frequent[:k]).cast("int") for k in TIERS), F.lit(0))
    return F.transform(F.array_sort(F.transform("sig", lambda s: F.struct(tier(s).alias("t"), s.alias("s")))), lambda x: x["s"])


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set_hash, class_id, n_links): fingerprints that several rows have or that are linked, by the XXH64 of their signatures; stored.

    Sets of a Jaccard similarity of ``least`` are linked, and classes closed over chains; class_id is the smallest id
    in one. Links are complete up to connectivity: under a signature with many sets, those already in one class aren't
    compared again, so n_links counts the links that were made. Rows with a null id belong to a class, too, but name none.
    """
    eps = near.EPS
    rows = with_signatures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "_sig")
    sets = cut(rows.groupBy(F.xxhash64("_sig").alias("id")).agg(F.min("_id").alias("first"), F.count("*").alias("rows"), F.any_value("_sig").alias("sig")))
    n = F.size("sig")
    # a set's own class of lengths, and the next smaller one, in which it is found as well
    part = F.floor(F.log(n.cast("double")) / -math.log(least) + eps)
    some = F.slice("_order", F.lit(1), (n - F.ceil(n * least - eps) + 1).cast("int"))
    keys = F.flatten(F.transform(some, lambda s: F.array(F.xxhash64(s, part), F.xxhash64(s, part - 1))))
    prefixes = cut(sets.withColumn("_order", _rare_first(sets)).select("id", n.alias("n"), keys.alias("keys"), _sketch("sig").alias("bits")))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
        out = cut(both.where(likeness("x", "y") >= least - eps).select("a", "b"))
        drop(pairs)
        return out

    edges = near.links(prefixes, least, verify, SKETCH)
    drop(prefixes)
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    comp = connected_components(edges)
    member = sets.select("id", "first").join(comp, F.col("id") == F.col("node"))
    lead = member.groupBy("component").agg(F.min("first").alias("class_id"))
    linked = member.join(lead, "component").join(degree.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("set_hash"), "class_id", "n_links")
    alone = sets.where("rows > 1").join(comp, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("set_hash"), F.col("first").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = cut(linked.unionByName(alone))
    drop(sets, edges, comp)
    return out


def near_pairs(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): the smallest id of each class of near copies with every other smallest id of a fingerprint in it; nulls left out.

    Members of a class come by ``classes``; copies aren't expanded into all their pairs.
    """
    rows = with_signatures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "_sig").where("_id is not null")
    first = rows.groupBy(F.xxhash64("_sig").alias("set_hash")).agg(F.min("_id").alias("b"))
    known = classes(docs, least, id_col, text_col)
    return first.join(known, "set_hash").where("class_id <> b").select(F.col("class_id").alias("a"), "b")
