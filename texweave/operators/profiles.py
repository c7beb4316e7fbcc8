"""Profiles of a corpus: counts, summaries, duplicates, histograms, frequencies, grades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.storage import checkpoint
from .filters import MOST_BROADCAST


CELLS = 4096  # parts into which a round cuts an interval
FEW = 10_000  # values of an interval that one task sorts


def _melted(rows: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """groups, m (the column's place) and v of all values but null and NaN, as doubles."""
    each = F.array(*(F.struct(F.lit(k).alias("m"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    return rows.select(*groups, F.inline(each)).where("v is not null and not isnan(v)")


def _scaled(x: Column, wide: Column) -> Column:
    """x on the scale of logarithms, where wide, else halved, so that no difference overflows."""
    return F.when(wide, F.signum(x) * (F.coalesce(F.ln(F.abs(x)), F.lit(0.0)) + 750)).otherwise(x / 2)


def _ruler(lo: Column, hi: Column) -> Column:
    """An interval and its scale: lo, hi, wide, and start and length on that scale."""
    low, high = (F.greatest(F.least(c, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)) for c in (lo, hi))
    wide = (low * F.signum(high) <= 0) | (F.greatest(F.abs(low), F.abs(high)) / 4 > F.least(F.abs(low), F.abs(high)))
    start = _scaled(low, wide)
    return F.struct(lo.alias("lo"), hi.alias("hi"), wide.alias("wide"), start.alias("start"), (_scaled(high, wide) - start).alias("length"))


def order_statistics(rows: DataFrame, groups: list[str], columns: list[str], places: Callable[[Column], dict[str, Column]], most_groups: int = MOST_BROADCAST) -> DataFrame:
    """groups, m, name, n and value: of n values of each column and group those at given places of their ascending order, without a sort.

    ``places`` takes the number of values and names places from 0. Each place has an interval that
    holds its value, and how many values lie below. Round after round intervals of over ``FEW`` values are
    cut in ``CELLS`` parts, whose counts, smallest and largest values are found in one aggregation over all
    columns, groups and places; an interval shrinks to the extremes of the part that holds its place. Intervals
    of fewer values are sorted at last, each by itself, unless their extremes are equal. Parts are equally wide on the scale of logarithms where an interval spans zero or more
    than a factor of four, else on that of the values: six rounds are the most for any doubles. Infinite values
    are parts of their own.
    """
    by = groups or ["_all"]
    keys = [*by, "m"]
    values = checkpoint(_melted(rows if groups else rows.withColumn("_all", F.lit(0)), by, columns))
    n = F.col("n")
    spots = F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("place")) for name, at in places(n).items()))
    state = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = checkpoint(state.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), F.inline(spots)))
    renamed = {k: f"_of_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    still = F.col("lo") < F.col("hi")
    rows_of_state, most = state.agg(F.count("*"), F.max(F.when(still, F.col("held")))).first()
    few = rows_of_state <= most_groups  # groups times columns times places

    def held_by(wanted: Column) -> DataFrame:
        """keys, v and s, the interval of the wanted ones that holds v."""
        spans = state.where(wanted).select(*(F.col(k).alias(r) for k, r in renamed.items()), _ruler(F.col("lo"), F.col("hi")).alias("s")).distinct()
        inside = F.col("v").between(F.col("s.lo"), F.col("s.hi"))  # intervals of a key have no value in common
        return values.join(F.broadcast(spans) if few else spans, [*same, inside]).select(*keys, "v", "s")

    def with_parts(wanted: Column, parts: DataFrame) -> DataFrame:
        """The wanted intervals beside what was found in them."""
        parts = parts.withColumnsRenamed(renamed).withColumns({"_lo": F.col("s.lo"), "_hi": F.col("s.hi")}).drop("s")
        return state.where(wanted).join(parts, [*same, F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi")])

    while (most or 0) > FEW:
        large = still & (F.col("held") > FEW)
        share = (_scaled(F.col("v"), F.col("s.wide")) - F.col("s.start")) / F.col("s.length")
        cell = F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), CELLS).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        cells = held_by(large).groupBy(*keys, "s", cell.cast("int").alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        ahead = W.partitionBy(*keys, "s").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # CELLS rows and two
        cells = cells.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
        inside = F.col("place").between(F.col("below") + F.col("before"), F.col("below") + F.col("before") + F.col("c") - 1)
        found = with_parts(large, cells).where(inside)
        found = found.select(*keys, "n", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("held"), "name", "place")
        state = checkpoint(state.where(~large).unionByName(found))
        most = state.agg(F.max(F.when(still, F.col("held")))).first()[0]
    done = state.where(~still).select(*groups, "m", "name", "n", F.col("lo").alias("value"))
    if most is None:
        return done
    ordered = held_by(still).groupBy(*keys, "s").agg(F.sort_array(F.collect_list("v")).alias("_ordered"))  # FEW values at most
    found = with_parts(still, ordered).withColumn("value", F.get("_ordered", (F.col("place") - F.col("below")).cast("int")))
    return done.unionByName(found.select(*groups, "m", "name", "n", "value"))


def quantiles(rows: DataFrame, groups: list[str], columns: list[str], shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of columns by group, as {column}_{name}; exact at any size."""

    def around(n: Column) -> dict[str, Column]:
        return {f"{end}{name}": f((n - 1) * share) for name, share in shares.items() for end, f in (("<", F.floor), (">", F.ceil))}

    found = order_statistics(rows, groups, columns, around)
    picked = [F.max(F.when((F.col("m") == k) & (F.col("name") == f"{end}{name}"), F.col("value"))).alias(f"{end}{k}{name}") for k in range(len(columns)) for name in shares for end in "<>"]
    both = found.groupBy(*groups).agg(*picked, *(F.max(F.when(F.col("m") == k, F.col("n"))).alias(f"_n{k}") for k in range(len(columns))))

    def between(k: int, name: str, share: float) -> Column:
        low, high, at = F.col(f"<{k}{name}"), F.col(f">{k}{name}"), (F.col(f"_n{k}") - 1) * share
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(f"{columns[k]}_{name}")

    return both.select(*groups, *(between(k, name, share) for k in range(len(columns)) for name, share in shares.items()))


def describe(rows: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (interpolated) and max of each column, all columns at once. NaN counts as missing."""
    found = []
    for c in columns:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        given = F.when(v.isNotNull(), F.col(c))
        found += [F.count(v).alias(f"{c}_count"), F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"), F.min(given).alias(f"{c}_min"), F.max(given).alias(f"{c}_max")]
    out = rows.groupBy(*groups).agg(*found)
    quartiles = quantiles(rows, groups, columns, {f"p{p}": p / 100 for p in (25, 50, 75)})
    names = [f"{c}_p{p}" for c in columns for p in (25, 50, 75)]
    quartiles = quartiles.select(*(F.col(g).alias(f"_of_{g}") for g in groups), *names)
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups] or F.lit(True)
    return out.join(quartiles, same, "left").drop(*(f"_of_{g}" for g in groups))


def count_flags(rows: DataFrame, groups: list[str], flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))


def duplicates(rows: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows beyond the first of each value; nulls are one value."""
    count = lambda c: (F.count("*") - F.count_distinct(c) - F.max(c.isNull().cast("int"))).cast("long")
    return rows.groupBy(*groups).agg(*(count(c).alias(k) for k, c in values.items()))


def distinct_sketches(rows: DataFrame, groups: list[str], column: str, bits: int = 12) -> DataFrame:
    """groups and {column}_sketch, from which distinct values can be estimated: some kilobytes a group, mergeable over subsets, days and runs; nulls don't count."""
    return rows.groupBy(*groups).agg(F.hll_sketch_agg(column, F.lit(bits)).alias(f"{column}_sketch"))


def united(sketches: DataFrame, groups: list[str], column: str) -> DataFrame:
    """groups and {column}_distinct: the estimated number of distinct values over all sketches of each group."""
    return sketches.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg(f"{column}_sketch")).alias(f"{column}_distinct"))


def histogram(rows: DataFrame, column: str, bins: int = 60, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """bin, n and density after values are cut to two quantiles."""
    edges = quantiles(rows, [], [column], {"lo": low, "hi": high}).select(F.col(f"{column}_lo").alias("lo"), F.col(f"{column}_hi").alias("hi"))
    cut = rows.select(F.col(column).alias("v")).where("v is not null").join(F.broadcast(edges))  # one row
    value = F.greatest(F.col("lo"), F.least(F.col("v"), F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((value - F.col("lo")) / width), F.lit(bins - 1))
    out = cut.groupBy(F.when(width > 0, at).otherwise(0).alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # as many rows as bins
    return out.select("bin", "n", (F.col("n") / total / F.col("width")).alias("density"))


def buckets(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts and percent of half-open buckets between edges; values outside have none."""
    value = F.col(column)
    at = F.when(value >= edges[-1], None)
    for k in reversed(range(len(edges) - 1)):
        at = at.when((value >= edges[k]) & (value < edges[k + 1]), k)
    counted = rows.withColumn("bucket", at).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))  # as many rows as buckets


def top_k(rows: DataFrame, column: str | Column, k: int, name: str = "value") -> DataFrame:
    column = F.col(column) if isinstance(column, str) else column
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def top_commands(rows: DataFrame, latex: str, k: int = 15, per_row: int | None = None) -> DataFrame:
    """The k most frequent commands; with ``per_row``, summed over each row's most frequent ones only."""
    found = T.commands(F.col(latex))
    if per_row is None:
        counted = rows.select(F.explode(found).alias("cmd")).groupBy("cmd").agg(F.count("*").alias("n"))
    else:
        each = rows.select(F.explode(T.most_common(found, per_row)).alias("c"))
        counted = each.groupBy(F.col("c.item").alias("cmd")).agg(F.sum("c.n").alias("n"))
    return counted.orderBy(F.desc("n"), "cmd").limit(k)


def issue_grades(counts: DataFrame, issues: list[str], total: str = "n") -> DataFrame:
    """Issues in percent of rows and their grade. A row with two issues counts twice."""
    rate = T.percent(sum((F.col(c) for c in issues[1:]), F.col(issues[0])), F.col(total))
    return counts.withColumn("issue_rate", rate).withColumn("grade", T.grade(rate))


def nearest_rank(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """name and value of the element at int(n * share) of the sorted values."""
    at = lambda n: {f"p{round(s * 100)}": F.least(F.floor(n * s), n - 1) for s in shares}
    return order_statistics(rows, [], [column], at).select("name", F.col("value").cast(rows.schema[column].dataType).alias("value"))


def length_summary(rows: DataFrame, ids: str, unknown: int) -> DataFrame:
    """One row on encoded texts: n, shortest, mean and longest, p50, p95 and p99 by nearest rank, and the rate of unknown ids."""
    sized = checkpoint(rows.select(F.size(ids).cast("long").alias("_size"), F.size(F.filter(ids, lambda i: i == unknown)).alias("_unknown")))  # two numbers a text
    ranks = nearest_rank(sized, "_size", [0.5, 0.95, 0.99]).groupBy().agg(*(F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in ("p50", "p95", "p99")))
    whole = sized.agg(F.count("*").alias("n"), F.min("_size").alias("shortest"), F.avg("_size").alias("mean"), F.max("_size").alias("longest"), (F.sum("_unknown") / F.sum("_size")).alias("unk_rate"))
    return whole.join(ranks)  # one row each
