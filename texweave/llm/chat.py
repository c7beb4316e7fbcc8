"""Chat formatting: logged snapshots of growing conversations collapse to the longest, then render.

A conversation that is a turn-by-turn prefix of a longer one is a snapshot of it. Each turn has
a hash of its number, role and text; the sum of the hashes up to a turn identifies the prefix
that ends there (rolling: one addition a turn). Conversations whose whole sum is a proper
prefix of another go by an anti-join; of equal ones the smallest conv_id stays.

Sums run in stretches of turns and across the stretches of a conversation, and rendering goes
by parts of bounded length, so that one endless conversation does not pass through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART_TURNS = 256
PIECE_ROWS = 256  # different rows of one turn number, beyond which they render apart
_SUMS = ("a", "b", "c", "d", "n")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, and the summed quarters a to d of a 128-bit hash and the count n of the turn's distinct rows."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    h = F.xxhash64("turn", "role", "text")
    keyed = rows.select("conv_id", "turn", h.alias("h"), F.xxhash64("text", "role", "turn", F.lit(1)).alias("g")).distinct()
    # Quarters of 32 bits: sums stay in range for two billion turns.
    high, low = (lambda c: F.sum(F.shiftrightunsigned(c, 32))), (lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))))
    return keyed.groupBy("conv_id", "turn").agg(high("h").alias("a"), low("h").alias("b"), high("g").alias("c"), low("g").alias("d"), F.count("*").alias("n"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with a, b and n summed up to and with each turn, and whether it is the last."""
    cut = turns.withColumn("stretch", F.floor(F.col("turn") / PART_TURNS))
    whole = cut.groupBy("conv_id", "stretch").agg(*(F.sum(c).alias(f"{c}_in") for c in _SUMS), F.max("turn").alias("top"))
    over = W.partitionBy("conv_id").orderBy("stretch")
    past, every = over.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("conv_id")
    whole = whole.select("conv_id", "stretch", F.max("top").over(every).alias("top"), *(F.coalesce(F.sum(f"{c}_in").over(past), F.lit(0)).alias(f"{c}_base") for c in _SUMS))
    inside = W.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    run = cut.select("conv_id", "stretch", "turn", *(F.sum(c).over(inside).alias(c) for c in _SUMS)).join(whole, ["conv_id", "stretch"])
    return run.select("conv_id", "turn", (F.col("turn") == F.col("top")).alias("last"), *((F.col(c) + F.col(f"{c}_base")).alias(c) for c in _SUMS))


def _maximal(turns: DataFrame) -> DataFrame:
    prefixes = _prefixes(turns)
    whole = prefixes.where("last").groupBy(*_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = prefixes.where("not last").select(*_SUMS).distinct()
    return whole.join(inner, list(_SUMS), "left_anti").select("conv_id", "copies")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id of every conversation that is no snapshot, and copies: how many conversations equal to it collapsed into it."""
    return _maximal(_turns(conversations))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, part, piece, n_turns, copies and text: the maximal conversations, rendered in parts of ``PART_TURNS`` turn numbers.

    A turn renders as "<|role|>" and its text on the next line, turns joined by line feeds. Rows
    that repeat a turn count once; different rows with one turn number follow by role and text.
    Where a turn number, or its lack, has over ``PIECE_ROWS`` different rows, these render apart from
    their part (piece 0), in pieces by hash; so no task gathers an unbounded group. Null roles and
    texts render empty, long texts whole; rows without a turn number come first, in part -1; rows
    without a conv_id go. Other columns stay out. An empty table gives an empty result.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = _turns(conversations)
    heavy = turns.where(F.col("n") > PIECE_ROWS).select("conv_id", "turn", F.ceil(F.col("n") / PIECE_ROWS).alias("pieces"))
    kept = rows.join(_maximal(turns), "conv_id").join(heavy, ["conv_id", "turn"], "left")
    spot = F.conv(F.substring(F.md5(F.concat("role", F.lit("\x01"), "text")), 1, 8), 16, 10).cast("long")
    bucket = F.shiftrightunsigned(spot * F.col("pieces"), 32)
    apart = F.shiftleft(F.pmod("turn", F.lit(PART_TURNS)), 32) + bucket + 1
    kept = kept.withColumn("part", F.floor(F.col("turn") / PART_TURNS)).withColumn("piece", F.coalesce(apart, F.lit(0)))
    turns = kept.groupBy("conv_id", "part", "piece", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"])
    text = F.array_join(F.transform("turns", line), "\n").alias("text")
    return turns.select("conv_id", "part", "piece", F.size("turns").cast("long").alias("n_turns"), "copies", text)


ORACLE_SQL = """
with r as (select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text
           from conversations where conv_id is not null),
t as (select conv_id, turn, string_agg(role || chr(1) || text, chr(2) order by role, text) as body from r group by 1, 2),
p as (select conv_id, turn, md5(string_agg(turn || chr(3) || body, chr(4)) over (partition by conv_id order by turn)) as h,
             turn = max(turn) over (partition by conv_id) as last from t),
w as (select h, min(conv_id) as conv_id, count(*) as copies from p where last group by h),
m as (select conv_id, copies from w where h not in (select h from p where not last)),
c as (select conv_id, turn, ceil(count(*) / 256.0) as pieces from r group by 1, 2 having count(*) > 256),
e as (select r.*, coalesce(((turn + 256) % 256) * 4294967296 + cast(('0x' || substr(md5(role || chr(1) || text), 1, 8)) as bigint) * cast(pieces as bigint) // 4294967296 + 1, 0) as piece
      from r left join c using (conv_id, turn))
select conv_id, cast(floor(turn / 256.0) as bigint) as part, piece, count(*) as n_turns, copies,
       string_agg('<|' || role || '|>' || chr(10) || text, chr(10) order by turn, role, text) as text
from e join m using (conv_id) group by 1, 2, 3, 5
"""
