"""Distances and schedules as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def char_edit_ratio(guess: Column, truth: Column) -> Column:
    """Character edits over the truth's length; may pass 1."""
    return F.when(guess == truth, 0.0).otherwise(F.levenshtein(guess, truth) / F.greatest(F.length(truth), F.lit(1)))


BITS = 4096  # rows of the table of distances that are one integer


def edits(a: list, b: list) -> int:
    """Edits between two lists, whose items are hashable.

    The table of distances is filled column by column. Bits of two integers say where a column's distance is one more or
    one less than that of the row above, so that a step does ``BITS`` rows at once (Myers 1999, Hyyrö 2003). ``rise`` and
    ``fall`` say the same of each column and the one before it, in the last row that is done.
    """
    if len(a) < len(b):
        a, b = b, a
    rise, fall = [1] * len(b), [0] * len(b)
    total = len(b)
    for start in range(0, len(a), BITS):
        block, places, bit = a[start : start + BITS], {}, 1
        for item in block:
            places[item] = places.get(item, 0) | bit
            bit <<= 1
        full, more = bit - 1, start + BITS < len(a)
        up, down = full, 0
        for k, (item, r, f) in enumerate(zip(b, rise, fall, strict=True)):
            x = places.get(item, 0) | down | f
            even = ((x & up) + up ^ up) | x  # where the distance is that of the row and column before
            right, left = down | full ^ (up | even), up & even
            if more:
                rise[k], fall[k] = right >> BITS - 1 & 1, left >> BITS - 1 & 1
            right = right << 1 | r
            up, down = (left << 1 | f | full ^ (right | even)) & full, right & even & full
        total += up.bit_count() - down.bit_count()
    return total


def _numbered(a: pa.ListScalar, b: pa.ListScalar) -> tuple[list[int], list[int]]:
    """The items of two lists as numbers, the same for equal ones: Arrow numbers them before any is a Python value."""
    numbers = pa.concat_arrays([a.values, b.values]).dictionary_encode("encode").indices.to_numpy().tolist()
    return numbers[: len(a.values)], numbers[len(a.values) :]


@F.arrow_udf(T.IntegerType())
def _token_edits(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in pairs:
        yield pa.array([edits(*_numbered(a, b)) if a.is_valid and b.is_valid else None for a, b in zip(*batch, strict=True)], pa.int32())


def token_edit_distance(a: Column, b: Column) -> Column:
    """Edits between arrays of tokens; in Python, as ``levenshtein`` takes a step for each pair of characters."""
    return F.when(a == b, 0).otherwise(_token_edits(a, b))


def normalized_token_distance(a: Column, b: Column) -> Column:
    return token_edit_distance(a, b) / F.greatest(F.size(a), F.size(b), F.lit(1))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours, joined by a control character."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), "\x01"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then cosine down to ``floor`` of the peak."""
    done = F.least((step - warmup) / F.lit(max(total - warmup, 1)), F.lit(1.0))
    decay = floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, peak * step / max(warmup, 1)).otherwise(peak * decay)
