"""Quality rules: base counts of a text, and lines that too many documents of a host share.

Lines are hashed in normal form (lower case, white space as one space, digits as 0). For each
host the distinct documents with a line are counted, distinct by text: exact copies are one
document, for the duplicate stage to judge. A line of so many documents is boilerplate in a small
host as in a large one; a document that loses too many of its words with such lines is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, utf8

LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
WINDOW = 8
LINE_DOCS = 5  # a line of at least so many distinct documents of a host is boilerplate, however large the host
LEAST_LEFT = 0.5  # share of a document's words that boilerplate must leave
BROADCAST_LINES = 200_000  # two longs each; beyond it the join is by exchange, but for the commonest lines
HOT_ROWS = 10_000  # a line on more rows, and on more than a BROADCAST_LINES-th of all, never goes through an exchange
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGIT = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGIT).split())


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more. Exact: ranks of windows double from 1 to 8 words."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pair = rank[:-width] * (len(words) + 1) + rank[width:]
        values, rank = np.unique(pair, return_inverse=True)
        width *= 2
        if len(values) == len(pair):
            return 0  # no stretch of this width repeats
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base counts of each text, and its lines as hashes (with the host) and word counts."""
    digest = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
    for batch in batches:
        made = []
        for doc_id, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body, name = utf8(text), b"\x00" if host is None else b"\x01" + utf8(host)
            words = body.split()
            seen, copies, lines = set(), 0, {}
            for line in body.split(b"\n"):
                n = len(line.split())
                if not n:
                    continue
                copies += line in seen
                seen.add(line)
                key = digest(name + b"\n" + normal(line))
                lines[key] = lines.get(key, 0) + n
            chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
            counts = (len(words), chars, len(_SYMBOLS.findall(text or "")), copies, _repeated_words(words))
            made.append((doc_id, digest(name), digest(body), *counts, list(lines), list(lines.values())))
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
        arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, _LINE_NAMES)


_LINE_NAMES = ["doc_id", "host", "body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"]
_LINE_SCHEMA = ", ".join(f"{n} {'array<long>' if n in ('lines', 'sizes') else 'long'}" for n in _LINE_NAMES)


def _line_counts(base: DataFrame) -> DataFrame:
    """line, n (distinct texts of its host with it) and n_rows."""
    each = base.select("body", F.explode("lines").alias("line"))
    return each.groupBy("line", "body").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("n"), F.sum("n").alias("n_rows"))


def boilerplate(base: DataFrame) -> DataFrame:
    """line (hash with the host) of every line over the limit."""
    return _line_counts(base).where(F.col("n") >= LINE_DOCS).select("line")


def _measured(docs: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string"), F.col("text").cast("string"))
    base = map_batches(rows, _line_batches, _LINE_SCHEMA).withColumn("_id", F.monotonically_increasing_id())
    base = checkpoint(base)
    return base, checkpoint(boilerplate(base))


def _in_boilerplate(each: DataFrame, base: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of ``each`` whose ``line`` is boilerplate.

    Few lines are broadcast. Of many, those on the most rows are (they number BROADCAST_LINES at most,
    since rows are finite), boilerplate or not, and only the others meet by exchange, so that no key is hot.
    """
    if lines.count() <= BROADCAST_LINES:
        return each.join(F.broadcast(lines), "line")
    total = base.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    hot = checkpoint(_line_counts(base).where(F.col("n_rows") > max(HOT_ROWS, total // BROADCAST_LINES)))
    common = F.broadcast(hot.where(F.col("n") >= LINE_DOCS).select("line"))
    rest = each.join(F.broadcast(hot.select("line")), "line", "left_anti")
    return each.join(common, "line").unionByName(rest.join(lines, "line"))


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and boiler_words (words in boilerplate lines) of every row.

    Null texts have no words and fail. A null host is a host. Repeated rows repeat; they count as
    one document of their lines. An empty table gives an empty result.
    """
    base, lines = _measured(docs, host)
    each = base.select("_id", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("_id", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    lost = _in_boilerplate(each, base, lines).groupBy("_id").agg(F.sum("size").alias("boiler_words"))
    out = base.drop("lines", "sizes").join(lost, "_id", "left").withColumn("boiler_words", F.coalesce("boiler_words", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("boiler_words") >= LEAST_LEFT * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & left).alias("kept"), "boiler_words",
    )


def without_boilerplate(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id and text, less its boilerplate lines, of every row of ``docs``."""
    base, lines = _measured(docs, host)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("_host"), F.col("text").cast("string"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name = b"\x00" if host is None else b"\x01" + utf8(host)
                found.append([xxhash.xxh64_intdigest(name + b"\n" + normal(x)) - (1 << 63) if x.split() else None for x in utf8(text).split(b"\n")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "keys"])

    keyed = checkpoint(map_batches(rows, keys, "doc_id long, text string, keys array<long>").withColumn("_id", F.monotonically_increasing_id()))
    each = _in_boilerplate(keyed.select("_id", F.explode("keys").alias("line")), base, lines).groupBy("_id").agg(F.collect_set("line").alias("bad"))
    parts = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("bad", F.get("keys", i)), F.lit(False)))
    return keyed.join(each, "_id", "left").select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(parts, "\n")).alias("text"))
