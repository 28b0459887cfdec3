"""Multi-party chat formatting: every participant's view of a dialogue, with loss masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers that one part of a rendering spans, and rows that it may hold before it is cut into pieces.
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def in_pieces(t: DataFrame, most: int) -> DataFrame:
    """Rows (conv_id, part, turn, role, text) once each, with copies and piece. Only parts of more than `most` rows have several pieces; none is gathered to cut it."""
    rows = t.groupBy("conv_id", "part", "turn", "role", "text").agg(F.count("*").alias("copies"))
    turns = rows.groupBy("conv_id", "part", "turn").agg(F.sum("copies").alias("here"))
    full = turns.groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.sum("here").alias("all")).where(F.col("all") > most)
    full = turns.join(full, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).select("_c", "_p", F.col("turn").alias("_t"), "here")
    both = rows.join(full, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    cuts = F.when(F.col("here").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / most) - 1))
    cut = both.withColumn("cut", F.explode(cuts))
    place = F.coalesce(F.col("turn") - F.col("part") * most, F.lit(0)) * (1 << 40) + F.pmod(F.xxhash64("role", "text"), F.ceil(F.col("here") / most)) * (1 << 20) + F.col("cut") + 1
    copies = F.when(F.col("here").isNull(), F.col("copies")).otherwise(F.least(F.lit(most), F.col("copies") - F.col("cut") * most))
    return cut.select("conv_id", "part", "turn", "role", "text", F.coalesce(place, F.lit(0)).cast("long").alias("piece"), copies.cast("int").alias("copies"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) -> conv_id, speaker, part, piece, n_turns, text, mask.

    For each participant of a conversation, that is each role but 'system',
    the dialogue is rendered with that speaker as assistant, the others as
    users by name, the system as itself; `mask` lists the (start, end) code
    points of what the assistant says, its closing mark included.

    A part holds the turns whose number has the same quotient by `part_turns`,
    so that no row grows with the conversation and a hot conversation is spread
    over many tasks; parts in order, concatenated, are the rendering. Turns are
    in order of (turn, role, text) and a part is one piece, 0, unless it has
    more than `part_turns` rows, as turn numbers repeat or are null: then its
    pieces, in order, are by turn, hash of role and text, and count of equal
    rows, each of about `part_turns` rows. Repeated rows are rendered as often
    as they are there. A null or blank role is 'unknown', a null text empty, a
    null turn has part -1 before the others, null conv_ids are one
    conversation. Marks in texts and names are broken up by a space. A
    conversation of the system only has no participant and gives no rows, nor
    does an empty table. Other columns are ignored.
    """
    broken = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.coalesce(F.nullif(F.trim(F.regexp_replace("role", r"\s+", " ")), F.lit("")), F.lit("unknown"))
    t = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        broken(role).alias("role"),
        broken(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns).cast("long"), F.lit(-1).cast("long")))
    t = in_pieces(t, part_turns)
    speakers = t.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("role") == F.col("speaker")
    name = F.when(own, "assistant").when(F.col("role") == "system", "system").otherwise(F.concat(F.lit("user name="), F.col("role")))
    head = F.concat(F.lit(OPEN), name, F.lit("\n"))
    views = views.select("conv_id", "speaker", "part", "piece", F.struct("turn", "role", "text", head.alias("head"), own.alias("own"), "copies").alias("x"))
    parts = views.groupBy("conv_id", "speaker", "part", "piece").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.array_repeat(x, x["copies"]))).alias("xs"))
    body = lambda x: F.concat(x["text"], F.lit(CLOSE))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["head"]) + F.length(body(x)) + 1).alias("at"),
        F.when(x["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(body(x))).alias("end"))))).otherwise(a["mask"]).alias("mask"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))
    return parts.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        F.size("xs").cast("long").alias("n_turns"),
        F.array_join(F.transform("xs", lambda x: F.concat(x["head"], body(x), F.lit("\n"))), "").alias("text"),
        F.aggregate("xs", start, step, lambda a: a["mask"]).alias("mask"),
    )


def digest(views: DataFrame) -> DataFrame:
    """What rotate() gives, with length and digest for the text and the mask as start:end, comma-joined. No rows of no rows."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return views.select("conv_id", "speaker", "part", "piece", "n_turns", F.length("text").cast("long").alias("n_chars"), spans.alias("mask"), F.sha2("text", 256).alias("text_sha256"))


#: For tables without parts of more than PART_TURNS rows.
DIGEST_SQL = rf"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(floor(turn / {PART_TURNS}) AS BIGINT) AS part,
         replace(coalesce(nullif(trim(regexp_replace(role, '\s+', ' ', 'g')), ''), 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
v AS (
  SELECT t.*, s.speaker, t.role = s.speaker AS own,
         '{OPEN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head,
         text || '{CLOSE}' AS body
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system') s USING (conv_id)),
w AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM v)
SELECT conv_id, speaker, part, CAST(0 AS BIGINT) AS piece, count(*) AS n_turns, CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
       coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) - 1 AS VARCHAR) || ':' || CAST(upto - 1 AS VARCHAR) END, ',' ORDER BY turn, role, text), '') AS mask,
       sha256(string_agg(head || body || chr(10), '' ORDER BY turn, role, text)) AS text_sha256
FROM w GROUP BY conv_id, speaker, part
"""
