"""Corpus metrics: BLEU, exact match, edit distance, accuracy, perplexity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


def clipped_matches(most: int) -> Callable[[Column, Column], Column]:
    """For a pair of token arrays, the clipped n-gram matches of each order up to ``most``, as an array."""

    def each(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for guesses, truths in columns:
            made = []
            for guess, truth in zip(guesses, truths, strict=True):
                g, t = guess.as_py() or [], truth.as_py() or []
                grams = lambda x, n: Counter(zip(*(x[k:] for k in range(n)), strict=False))
                made.append([(grams(g, n) & grams(t, n)).total() for n in range(1, most + 1)])
            yield pa.array(made, pa.list_(pa.int64()))

    return F.arrow_udf(each, "array<long>")


def bleu(pairs: DataFrame, guess: str, truth: str, most: int = 4, smoothing: float = 0.1) -> DataFrame:
    """One row: bleu. Clipped matches are summed over the corpus; an order without a match counts as ``smoothing``."""
    orders = range(1, most + 1)
    found = pairs.select(F.size(guess).alias("h"), F.size(truth).alias("r"), clipped_matches(most)(F.col(guess), F.col(truth)).alias("hits"))
    sums = found.agg(
        F.sum("h").alias("h"), F.sum("r").alias("r"), *(F.sum(F.col("hits")[n - 1]).alias(f"hit{n}") for n in orders),
        *(F.sum(F.greatest(F.col("h") - (n - 1), F.lit(0))).alias(f"of{n}") for n in orders),
    )
    smooth = lambda n: F.when(F.col(f"hit{n}") == 0, F.lit(smoothing)).otherwise(F.col(f"hit{n}")) / F.greatest(f"of{n}", F.lit(1))
    mean = sum((F.log(smooth(n)) for n in orders), F.lit(0.0)) / most
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return sums.select(F.when(F.col("hit1") == 0, 0.0).otherwise(F.exp(mean) * brevity).alias("bleu"))


def match_scores(pairs: DataFrame, guess: str, truth: str) -> DataFrame:
    """One row: n, exact (share of equal token lists) and edit (mean token edits over the longer list)."""
    distance = M.normalized_token_distance(F.col(guess), F.col(truth))
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col(guess) == F.col(truth)).cast("int")).alias("exact"), F.avg(distance).alias("edit"))


def token_accuracy(rows: DataFrame, groups: list[str], right: str, counted: str) -> DataFrame:
    return rows.groupBy(*groups).agg((F.sum(right) / F.sum(counted)).alias("token_acc"))


def loss_summary(rows: DataFrame, groups: list[str], loss: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.avg(loss).alias("loss"), M.perplexity(F.avg(loss)).alias("ppl"))


def selection_score(summary: DataFrame, group: str, excluded: list[str]) -> DataFrame:
    """Mean perplexity over the groups that count."""
    return summary.where(~F.col(group).isin(excluded)).agg(F.avg("ppl").alias("selection"))


def scored_or_failed(score: str, failed: float = 1.0):
    """A missing score counts as a failure."""
    return F.coalesce(F.col(score), F.lit(failed))
