"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once: that
speaker's turns as the assistant's, all others' as named users', the system's as
context. The mask marks the characters that training learns from: the text and the
end mark of the assistant's turns.

A dialogue is rendered in segments of ``segment`` consecutive turn numbers, so that a
conversation of any length is worked on in bounded pieces by many tasks. Where very
many rows share a segment (rows without a conversation or a turn, say), it is cut on
into pieces of ``most`` rows. The segments of a speaker are then joined in order, their
masks moved by the lengths before them. A row can't be larger than a string, so a
dialogue of more than ``most_chars`` characters goes on in a further row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import stage
from tarnwell.operators.ranking import ordinal

SEGMENT = 64
#: Rows of a segment from which on it is cut into pieces.
MOST = 1024
#: Characters of a dialogue after which it goes on in another row, at a segment's end.
MOST_CHARS = 1 << 26
HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
SYSTEM = "system"


def _parted(rows: DataFrame, most: int) -> DataFrame:
    """Add ``piece``: 0, and on in segments of more than ``most`` rows, by the turns' order.

    Only such segments are numbered, in pieces of equal turn, role and beginning of the text.
    """
    large = stage(rows.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most), "large")
    if large.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    large = large.select(F.col("conv_id").alias("of"), F.col("segment").alias("of_segment"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("of_segment"))
    some = rows.join(large, same, "left_semi").withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    piece = F.struct("turn", "role", F.substring("text", 1, 16).alias("begin"))
    some = ordinal(some, ["name", "segment"], piece, [F.col("turn"), F.col("role"), F.col("text")], "place").drop("name")
    some = some.withColumn("piece", F.floor((F.col("place") - 1) / most)).drop("place")
    return rows.join(large, same, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(some)


def perspectives(turns: DataFrame, segment: int = SEGMENT, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per conversation and speaker with the whole dialogue.

    Returns conv_id, speaker, part (0; dialogues of over ``most_chars`` characters go on
    in rows 1, 2, ..), n_turns, n_own (the speaker's turns in it), text, mask
    ("start:end" code point spans of the text, end exclusive, comma-joined) and n_train
    (characters under the mask).

    Turns are ordered by turn, then role, then text; repeated rows are repeated
    turns. A null turn counts as turn 0, a null text as empty, a null role as the
    speaker "unknown"; rows of a null conv_id form one conversation. A conversation
    with system turns only has no participant and gives no row; so does an empty
    table. Only conv_id, turn, role and text are read.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("segment", F.floor(F.col("turn") / segment))
    # The turns of a segment come together first, so that each is shuffled once, not once a speaker.
    turn = F.struct("turn", "role", "text")
    packed = stage(_parted(rows, most).groupBy("conv_id", "segment", "piece").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "segments")
    speakers = packed.select("conv_id", F.explode(F.array_distinct(F.col("turns.role"))).alias("speaker")).distinct()
    speakers = stage(speakers.where(F.col("speaker") != SYSTEM).withColumnRenamed("conv_id", "of"), "speakers")
    both = packed.join(speakers, packed["conv_id"].eqNullSafe(speakers["of"]))

    name = lambda t: F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user:"), t["role"]))
    head = lambda t: F.concat(F.lit(HEAD), name(t), F.lit(BODY))
    own = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == own).alias("own")))
    both = both.withColumn("pieces", pieces)
    # A running length over the segment's turns; the state is the position and the spans so far.
    span = "struct<start:long,end:long>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(state, p):
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        own_span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["spans"], own_span)).otherwise(state["spans"]).alias("spans"))

    both = both.withColumn("folded", F.aggregate("pieces", start, add))
    rendered = both.select(
        "conv_id",
        "speaker",
        "segment",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        "folded.at",
        "folded.spans",
    )
    # The window and the grouping share one shuffle; only a dialogue's own rows come together.
    before = Window.partitionBy("conv_id", "speaker").orderBy("segment", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("start", F.coalesce(F.sum("at").over(before), F.lit(0)))
    placed = placed.withColumn("part", F.floor(F.col("start") / most_chars))
    piece = F.struct("segment", "piece", "start", "text", "spans", "n_turns")
    whole = placed.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    base = F.col("all")[0]["start"]
    moved = F.flatten(F.transform("all", lambda x: F.transform(x["spans"], lambda s: F.struct((s["start"] + x["start"] - base).alias("start"), (s["end"] + x["start"] - base).alias("end")))))
    whole = whole.withColumn("moved", moved)
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + x)
    return whole.select(
        "conv_id",
        "speaker",
        "part",
        total(F.transform("all", lambda x: x["n_turns"])).alias("n_turns"),
        F.size("moved").cast("long").alias("n_own"),
        F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"),
        F.array_join(F.transform("moved", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"),
        total(F.transform("moved", lambda s: s["end"] - s["start"])).alias("n_train"),
    )


#: The same in DuckDB SQL, for dialogues of one row.
SQL = f"""
WITH rows AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id AS c, role AS speaker FROM rows WHERE role <> '{SYSTEM}'
), pieces AS (
  SELECT conv_id, speaker, turn, role, text, role = speaker AS own,
    '{HEAD}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user:' || role END || '|>' || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM rows JOIN speakers ON conv_id IS NOT DISTINCT FROM c
), placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM pieces WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn, role, text)
)
SELECT conv_id, speaker, CAST(0 AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_train
FROM placed GROUP BY conv_id, speaker
"""
