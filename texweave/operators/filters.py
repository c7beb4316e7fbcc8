"""Reason-coded filters, caps and dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.storage import checkpoint

MOST_BROADCAST = 100_000  # rows of a side whose count is known


def drop_reason(latex: Column, aspect: Column, readable: Column | None = None) -> Column:
    """Why a sample goes, the first that holds; null if it stays. An undecodable image only shows last."""
    reason = F.when(F.length(T.stripped(latex)) < 5, "short").when(~T.braces_balanced(latex), "unbal_brace").when(aspect > 20, "extreme_aspect")
    return reason if readable is None else reason.when(~readable, "decode_error")


def length_reason(latex: Column, least: int = 3, most: int = 400) -> Column:
    size = F.length(T.stripped(latex))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "blank").when(size < least, "short").when(size > most, "long")


def all_issues(latex: Column, aspect: Column) -> Column:
    """Every independent issue of a sample as an array."""
    found = F.array(F.when(F.length(T.stripped(latex)) < 5, "short_latex"), F.when(aspect > 20, "extreme_aspect"))
    return F.array_compact(found)


def score_class(score: Column) -> Column:
    return F.when(score == 0, "easy").when(score <= 0.1, "medium").otherwise("hard")


def cap_per_key(rows: DataFrame, key: str | Column, order: list[str], most: int = 3) -> DataFrame:
    """At most ``most`` rows of each key, the first in order. Spark prunes each partition to them before the exchange."""
    key = F.col(key) if isinstance(key, str) else key
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def _ranged(rows: DataFrame, by: list[str], part: str, at: str) -> DataFrame:
    """``rows`` in range partitions of their order, with the partition's number and the row's within it.

    The ranges come from a sample, so the rows are materialized once: counts and rows see the same ranges.
    """
    last = f"{at}_last"  # the row's own number at last, so that rows that agree spread over ranges
    ranged = rows.withColumn(last, F.monotonically_increasing_id()).repartitionByRange(*by, last).sortWithinPartitions(*by, last)
    ranged = ranged.withColumn(last, F.monotonically_increasing_id())
    return checkpoint(ranged.withColumn(part, F.shiftright(last, 33)).withColumn(at, F.col(last).bitwiseAND(F.lit((1 << 33) - 1))).drop(last))


def dense_index(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``rows`` with 0, 1, 2, ... in order; rows that agree in ``order`` are numbered in any order.

    Rows are range-partitioned by the order, numbered inside each partition, and lifted by the
    counts of the partitions before; no partition holds more than its range. Building the plan runs
    the job that ranges the rows.
    """
    at, part, base_ = f"_{name}_at", f"_{name}_part", f"_{name}_base"
    ranged = _ranged(rows, order, part, at)
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    base = F.broadcast(sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base_)))
    return ranged.join(base, part).withColumn(name, F.col(base_) + F.col(at)).drop(at, part, base_)


def number_within(rows: DataFrame, groups: list[str], order: list[str], name: str, sums: dict[str, str] | None = None, how: str = "sum") -> DataFrame:
    """``rows`` with 0, 1, 2, ... in order within their group, and ``name``_n, the group's rows.

    With ``sums`` (new name to column) also the column's sum over the rows before in the group, or with
    ``how`` its min or max (null without rows before).
    All rows are ranged by group and order. A group's rows in one range are a stretch; each stretch
    is lifted by the group's stretches before, and meets its rows by range and group: a group with a
    third of the rows is as many keys as the ranges it spans, and never meets in one task.
    """
    sums, at, part = sums or {}, f"_{name}_at", f"_{name}_part"
    fold, start = {"sum": F.sum, "min": F.min, "max": F.max}[how], F.lit(0 if how == "sum" else None)
    both = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[how]
    ranged = _ranged(rows, [*groups, *order], part, at)
    past = {c: f"_{name}_{k}_past" for k, c in enumerate(sums)}
    if sums:  # run up within the stretch; ranges are sorted already, and stretches are as long as a range at most
        run = W.partitionBy(part, *groups).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        ranged = ranged.withColumns({past[c]: F.coalesce(fold(v).over(run), start) for c, v in sums.items()})
    totals = [fold(v).alias(f"{past[c]}_in") for c, v in sums.items()]
    held = ranged.groupBy(part, *groups).agg(F.min(at).alias("_first"), F.count("*").alias("_n"), *totals)
    of_group = W.partitionBy(*groups).orderBy(part)
    before = of_group.rowsBetween(W.unboundedPreceding, -1)
    lifted = [F.coalesce(fold(f"{past[c]}_in").over(before), start).alias(f"{past[c]}_base") for c in sums]
    held = checkpoint(held.select(
        F.col(part).alias("_in_part"), *(F.col(g).alias(f"_of_{g}") for g in groups), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_lift"),
        F.sum("_n").over(W.partitionBy(*groups)).alias(f"{name}_n"), *lifted,
    ))
    same = [F.col(part) == F.col("_in_part"), *(F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups)]
    few = held.count() <= MOST_BROADCAST  # one row a range and group
    out = ranged.join(F.broadcast(held) if few else held, same).withColumn(name, F.col(at) + F.col("_lift"))
    out = out.withColumns({c: both(F.col(past[c]), F.col(f"{past[c]}_base")) for c in sums})
    return out.drop(at, part, "_in_part", "_lift", *(f"_of_{g}" for g in groups), *past.values(), *(f"{c}_base" for c in past.values()))


def shard_number(index: Column, rows_per_shard: int = 50_000) -> Column:
    return F.floor(index / rows_per_shard)


def worker_slice(index: Column, workers: int, rank: int) -> Column:
    return F.pmod(index, F.lit(workers)) == rank


def reason_rollup(rows: DataFrame, group: str, reason: str) -> DataFrame:
    """Counts by group and reason (null: kept), by group, and in all."""
    return rows.rollup(group, reason).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
