"""Multi-party chat rendering by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant, the other speakers as named users, and a mask
that marks the assistant's turns. Roles in ``narrators`` speak in every
rendering under their own name and get no perspective of their own.

A rendering is cut into parts of at most ``turns_per_part`` turns, in order,
so no row or task ever holds a whole conversation: turns get their position
from a range-partitioned global order (a conversation that holds a third of
all rows lies in many ranges), and a part is assembled from its few turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_positions

NARRATORS = ("system",)
TURNS_PER_PART = 64
UNNAMED = "unknown"


def utterances(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, repeats, index): the distinct utterances
    with their 0-based place in the conversation. Order: turn (null first),
    then role, then text."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("repeats"))
    p = global_positions(t, [F.col(c) for c in ("conv_id", "turn", "role", "text")])
    first = p.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("position").alias("__first"))
    return p.join(first, p["conv_id"].eqNullSafe(first["__conv"])).withColumn(
        "index", F.col("position") - F.col("__first")).drop("__conv", "__first", "position")


def rotate(turns: DataFrame, narrators: Sequence[str] = NARRATORS) -> DataFrame:
    """One row per (conv_id, perspective, index): ``segment`` (the rendered
    turn), ``trained`` (true for the assistant's turns) and the turn's own
    columns."""
    u = utterances(turns)
    named = ~F.col("role").isin(list(narrators))
    speakers = u.filter(named).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    r = u.join(speakers, u["conv_id"].eqNullSafe(speakers["__conv"])).drop("__conv")
    trained = F.col("role") == F.col("perspective")
    head = F.when(trained, F.lit("<|assistant|>")).when(named, F.concat(F.lit("<|user:"), "role", F.lit("|>"))).otherwise(
        F.concat(F.lit("<|"), "role", F.lit("|>")))
    return r.withColumn("trained", trained).withColumn("head", F.concat(head, F.lit("\n"))).withColumn(
        "segment", F.concat("head", "text", F.lit("<|end|>\n")))


def render(turns: DataFrame, narrators: Sequence[str] = NARRATORS, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per (conv_id, perspective, part): ``rendered``, ``mask``
    (character spans ``start-end`` of the assistant's text and end marks,
    0-based, end exclusive, joined by commas; empty if there are none),
    ``n_turns``, ``n_trained`` and ``n_rows`` (input rows behind the part).

    Null texts are empty turns; a null role is the participant "unknown"; a
    null conv_id is a conversation of its own. Rows equal in conv_id, turn,
    role and text are one utterance; other rows of one turn follow each
    other by role, then text. A conversation of narrators only has no
    rendering; extra columns are not read; an empty table gives an empty
    result.
    """
    r = rotate(turns, narrators).withColumn("part", F.floor(F.col("index") / turns_per_part))
    piece = F.struct("index", "segment", "trained", F.length("head").alias("head"), F.length("segment").alias("size"), "repeats")
    parts = r.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.expr("""aggregate(p, named_struct('at', 0, 'spans', cast(array() as array<string>)),
        (a, x) -> named_struct('at', a.at + x.size, 'spans', if(x.trained,
            concat(a.spans, array(concat(a.at + x.head, '-', a.at + x.size - 1))), a.spans)),
        a -> array_join(a.spans, ','))""")
    return parts.select(
        "conv_id", "perspective", "part", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("rendered"),
        spans.alias("mask"), F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["trained"])).cast("long").alias("n_trained"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["repeats"]).alias("n_rows"))


CHAT_SQL = """
WITH u AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS repeats
  FROM conversations GROUP BY ALL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx FROM u
), r AS (
  SELECT n.*, s.perspective, n.role = s.perspective AS trained,
         CASE WHEN n.role = s.perspective THEN '<|assistant|>' WHEN n.role = 'system' THEN '<|system|>'
              ELSE '<|user:' || n.role || '|>' END || chr(10) AS head
  FROM n JOIN (SELECT DISTINCT conv_id, role AS perspective FROM u WHERE role <> 'system') s
    ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), q AS (
  SELECT *, idx // 64 AS part, head || text || '<|end|>' || chr(10) AS segment FROM r
), o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY idx
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM q
)
SELECT conv_id, perspective, part, string_agg(segment, '' ORDER BY idx) AS rendered,
       coalesce(string_agg(CASE WHEN trained THEN (pos + length(head)) || '-' || (pos + length(segment) - 1) END, ',' ORDER BY idx), '') AS mask,
       count(*) AS n_turns, count(*) FILTER (trained) AS n_trained, sum(repeats)::BIGINT AS n_rows
FROM o GROUP BY conv_id, perspective, part
"""
