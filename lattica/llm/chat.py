"""Chat formatting after cumulative-snapshot collapse (operator 3), in DataFrame functions only.

Logs often hold a conversation once for every turn it grew by. A rolling hash of turn prefixes
(XOR of position-tagged turn hashes, two of 64 bits) identifies them: a conversation whose whole
hash is a proper prefix of another's is anti-joined away, equal conversations become the one of the
smallest id, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# The ChatML markers.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML; markers inside texts and roles are broken up so that they can't end a turn."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(TURN_START), plain(role), F.lit("\n"), plain(text), F.lit(TURN_END + "\n"))


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, copies): the maximal conversations; copies counts the equal ones, itself included.

    Turns are ordered by number, role, text (nulls first) and compared by role and text, nulls unlike
    empty strings; numbers may have gaps. Rows of a null conversation id are one conversation. Repeated
    turns are turns. An empty table gives an empty result; other columns are ignored.
    """
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    part = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x")).withColumn("pos", F.row_number().over(order))
    tag = lambda k: F.xxhash64(F.lit(k), "pos", F.col("r").isNull(), "r", F.col("x").isNull(), "x")
    last = F.lead("pos").over(order).isNull()
    hashes = cut(rows.withColumn("h", tag(1)).withColumn("g", tag(2)).select("c", "pos", F.bit_xor("h").over(part).alias("h"), F.bit_xor("g").over(part).alias("g"), last.alias("whole")))
    whole = hashes.where("whole").groupBy("pos", "h", "g").agg(F.min("c").alias("c"), F.count("*").alias("copies"), F.max(F.col("c").isNull()).alias("unnamed"))
    prefixes = hashes.where("not whole").select("pos", "h", "g").distinct()
    kept = whole.join(prefixes, ["pos", "h", "g"], "left_anti")
    return kept.select(F.col("c").alias(conv_id), F.col("pos").alias("n_turns"), "copies")


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations of ``turns``."""
    kept = cut(collapse(turns, conv_id, turn, role, text))
    rows = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    mine = rows.join(kept.select(F.col(conv_id).alias("k"), "n_turns", "copies"), F.col("c").eqNullSafe(F.col("k")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("t", "r", "x"))), lambda s: rendered_turn(s["r"], s["x"]))
    return mine.groupBy(F.col("c").alias(conv_id), "n_turns", "copies").agg(F.array_join(texts, "").alias("rendered"))


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH c AS (
  SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
         string_agg('{TURN_START}' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '{TURN_END}' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c))
SELECT conv_id, len(turns)::INT AS n_turns, copies, rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
"""
