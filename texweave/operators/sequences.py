"""Token sequences: packing, padding, shifting, neighbours, nucleus cuts, schedules of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpoint
from .filters import number_within, shard_number


BLOCK_ROWS = 8192  # sequences whose packing one row describes


def _firsts(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a stretch of sizes the sums up to each, and for a bin that begins at each: how many bins begin from there on, and the fill of the last."""
    sums = np.cumsum(sizes)
    after = np.searchsorted(sums, sums - sizes + most, "right")  # what does not fit any more begins the next bin
    bins, fill = np.ones(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        if (to := after[k]) < len(sizes):
            bins[k], fill[k] = bins[to] + 1, fill[to]
        else:
            fill[k] = sums[-1] - sums[k] + sizes[k]
    return sums, bins, fill


def _block_steps(most: int) -> Callable:
    """A block of sizes as a function of the fill that it meets: where its first new bin begins, by sums, and what follows from there."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sizes in batch.column("_sizes"):
                sums, bins, fill = _firsts(sizes.values.to_numpy(), most)
                reached = int(np.searchsorted(sums, most, "right")) + 1  # later ones are never first
                out.append((sums[:reached], bins[:reached], fill[:reached], int(sums[-1])))
            columns = [pa.array(list(c), pa.list_(pa.int64())) for c in list(zip(*out, strict=True))[:3]] if out else [pa.array([], pa.list_(pa.int64()))] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array([o[3] for o in out], pa.int64())], [*batch.schema.names[:-1], "_sums", "_bins", "_fill", "_all"])

    return steps


def _block_starts(n_groups: int, most: int) -> Callable:
    """For blocks in order the fill and the bin that each meets."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fill, bin_ = None, 0, 0
        for batch in batches:
            found = []
            names = zip(*(c.to_pylist() for c in batch.columns[:n_groups]), strict=True)
            for now, sums, bins, fills, whole in zip(names, *batch.columns[n_groups + 1 :], strict=True):
                if now != group:
                    group, fill, bin_ = now, 0, 0
                found.append((fill, bin_))
                sums = sums.values.to_numpy()
                first = int(np.searchsorted(sums, most - fill, "right"))
                if fill + whole.as_py() <= most:
                    fill += whole.as_py()
                else:
                    fill, bin_ = fills[first].as_py(), bin_ + bins[first].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_groups + 1], *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], [*batch.schema.names[: n_groups + 1], "_met", "_base"])

    return starts


def _block_bins(most: int) -> Callable:
    def placed(sizes: pd.Series, met: pd.Series, base: pd.Series) -> pd.Series:
        out = []
        for s, fill, bin_ in zip(sizes, met, base, strict=True):
            sums, found = np.cumsum(s), np.empty(len(s), np.int64)
            at = 0
            while at < len(s):
                end = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most - fill, "right"))
                found[at:end] = bin_
                at, fill, bin_ = end, 0, bin_ + 1
            out.append(found)
        return pd.Series(out)

    return F.pandas_udf(placed, "array<long>")


def pack_greedy(rows: DataFrame, group: str, order: list[str], size: str, most: int = 200, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """group, order, packed_size and bin: sequences of a group in order, a new bin where the next does not fit; longer ones count as ``most``, empty ones have none.

    Bins are those of one pass over the whole group. Sequences are numbered within their group and cut into
    blocks. What a block does to the fill of the bin that it meets is a step function with as many steps as
    sequences fit into a bin; the functions of a group, one row a block, are run through in order, which
    gives each block its fill and its first bin, and blocks then are packed on their own. A task holds a block,
    or runs through the rows of a group's blocks.
    """
    sized = rows.where(F.col(size) > 0).select(group, *order, F.least(F.col(size), F.lit(most)).cast("long").alias("_s"))
    placed = number_within(sized, [group], order, "_k").withColumn("_block", shard_number(F.col("_k"), block_rows))
    items = placed.groupBy(group, "_block").agg(F.array_sort(F.collect_list(F.struct("_k", *order, "_s"))).alias("_items"))
    blocks = checkpoint(items.withColumn("_sizes", F.transform("_items", lambda x: x["_s"])))
    key = f"`{group}` {rows.schema[group].dataType.simpleString()}, _block long"
    steps = blocks.select(group, "_block", "_sizes").mapInArrow(_block_steps(most), f"{key}, _sums array<long>, _bins array<long>, _fill array<long>, _all long")
    run = steps.repartition(group).sortWithinPartitions(group, "_block").mapInArrow(_block_starts(1, most), f"{key}, _met long, _base long")
    run = run.select(F.col(group).alias("_of"), F.col("_block").alias("_at"), "_met", "_base")
    met = blocks.join(run, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    packed = met.select(group, "_items", _block_bins(most)("_sizes", "_met", "_base").alias("_bins"))
    each = packed.select(group, F.explode(F.arrays_zip("_items", "_bins")).alias("_z"))
    return each.select(group, *(F.col(f"_z._items.{c}").alias(c) for c in order), F.col("_z._items._s").alias("packed_size"), F.col("_z._bins").alias("bin"))


def padded(ids: Column, most: int, pad: int = 0, ignored: int = -100) -> dict[str, Column]:
    """input_ids, attention_mask and labels of fixed length; a long sequence loses its end."""
    cut = F.slice(ids, 1, most)
    fill = lambda value: F.array_repeat(F.lit(value), most - F.size(cut))
    return {
        "input_ids": F.concat(cut, fill(pad)), "attention_mask": F.concat(F.transform(cut, lambda x: F.lit(1)), fill(0)),
        "labels": F.concat(cut, fill(ignored)),
    }


def shifted(labels: Column, ignored: int = -100, pad: int = 0) -> Column:
    """(position, target) pairs: each place predicts the next, padding left out."""
    pairs = F.transform(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("position"), x.alias("target")))
    return F.filter(pairs, lambda p: (p["target"] != ignored) & (p["target"] != pad))


def neighbours(items: Column) -> Column:
    """(a, b) of each two neighbours."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, n), F.slice(items, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def shares(rows: DataFrame, group: str, weight: str, name: str) -> DataFrame:
    """``rows`` with each weight's share of its group."""
    total = rows.groupBy(F.col(group).alias("_of")).agg(F.sum(weight).alias("_total"))
    return rows.join(total, F.col(group).eqNullSafe(F.col("_of"))).withColumn(name, F.col(weight) / F.col("_total")).drop("_of", "_total")


def nucleus(rows: DataFrame, group: str, item: str, p: str, top_p: float) -> DataFrame:
    """The likeliest items of each group whose likelier ones sum to at most top_p, renormalized. Sums run over ranges: a group with all rows is many tasks."""
    ordered = number_within(rows.withColumn("_down", -F.col(p)), [group], ["_down", item], "_k", {"_before": p})
    kept = ordered.where(F.col("_before") <= top_p).select(*rows.columns)
    return shares(kept, group, p, "p_kept")


def patience(rows: DataFrame, run: str, step: str, score: str) -> DataFrame:
    """best so far and the steps since it, by run. Bests and places are lifted from range to range: a run with all rows is many tasks."""
    met = number_within(rows, [run], [step], "_k", {"_low": score}, "min")
    better = F.col("_low").isNull() | (F.col(score) < F.col("_low"))
    marked = met.select(*rows.columns, F.least("_low", score).alias("best"), "_k", F.when(better, F.col("_k")).alias("_won"))
    last = number_within(marked, [run], ["_k"], "_j", {"_past": "_won"}, "max")
    return last.select(*rows.columns, "best", (F.col("_k") - F.coalesce("_won", "_past")).alias("waited"))


def latest(files: DataFrame, path: str, number: Column) -> DataFrame:
    """The path with the largest number."""
    return files.agg(F.max_by(path, number).alias(path), F.max(number).alias("step"))


def beyond_last(files: DataFrame, path: str, number: Column, keep: int) -> DataFrame:
    """What a keep-the-last-n policy deletes from a listing: all but the ``keep`` largest, ties by path."""
    listed = files.withColumn("step", number)
    kept = listed.orderBy(F.desc("step"), path).limit(keep).select(F.col(path).alias("_path"))
    return listed.join(F.broadcast(kept), F.col(path) == F.col("_path"), "left_anti")  # ``keep`` rows
