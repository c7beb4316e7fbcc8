"""Models over batches of pictures, and the inputs of models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.image import decode_png
from ..functions import markup
from .filters import dense_index


def _said(model: Callable[[list[np.ndarray]], list[str]], pictures: list[np.ndarray | None]) -> list[str | None]:
    try:
        if any(p is None for p in pictures):
            raise ValueError("a picture can't be read")
        found = list(model(pictures))
        if len(found) != len(pictures):
            raise ValueError("not one answer a picture")
        return found
    except Exception:  # whatever a model raises costs its batch only
        return [None] * len(pictures)


def predicted(model: Callable[[list[np.ndarray]], list[str]], batch_rows: int = 32) -> Callable[[Column], Column]:
    """A column function of pictures: what ``model`` says of each, called on ``batch_rows`` pictures at a time.

    A batch fails as a whole, with nulls, if the model raises, says too little, or a picture can't be read.
    """

    def each(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = (column[at : at + batch_rows] for at in range(0, len(column), batch_rows))
            yield pa.array([x for part in parts for x in _said(model, [decode_png(p.as_py()) for p in part])], pa.string())

    return F.arrow_udf(each, "string")


_LOADED: dict[str, Callable] = {}  # models of this worker, by the token of their column


def batched(rows: DataFrame, order: list[str], image: str, load: Callable[[], Callable[[list[np.ndarray]], list[str]]], size: int = 32) -> DataFrame:
    """order and said: what a model says of the pictures, in batches of ``size`` consecutive rows in order.

    ``load`` makes the model; each worker process calls it once, however many tasks it runs, so a model
    of gigabytes is read once a worker. Batches are those of one pass over all rows, whatever the partitions; one
    fails as a whole, as ``predicted`` says.
    """
    token = uuid.uuid4().hex

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _LOADED:
            _LOADED.clear()  # one model at a time
            _LOADED[token] = load()
        for batch in batches:
            yield pa.array([_said(_LOADED[token], [decode_png(p) for p in pictures]) for pictures in batch.to_pylist()], pa.list_(pa.string()))

    placed = dense_index(rows.select(*order, image), order, "_i")
    groups = placed.groupBy(F.floor(F.col("_i") / size).alias("_batch")).agg(F.array_sort(F.collect_list(F.struct("_i", *order, image))).alias("_rows"))
    said = F.arrow_udf(each, "array<string>")(F.transform("_rows", lambda r: r[image]))
    found = groups.select("_rows", said.alias("_said")).select(F.explode(F.arrays_zip("_rows", "_said")).alias("_z"))
    return found.select(*(F.col(f"_z._rows.{c}").alias(c) for c in order), F.col("_z._said").alias("said"))


def inputs(image: Column | None = None, text: Column | None = None) -> dict[str, Column]:
    """Model inputs by name: the picture as it is, the tokens of the text, or both; an error if there is neither."""
    if image is None and text is None:
        raise ValueError("an image or a text is needed")
    return ({} if image is None else {"image": image}) | ({} if text is None else {"tokens": markup.lexed(text)})
