"""Benchmark decontamination with an FM-index for each training shard.

A shard is the texts that a task has gathered up to a number of words. Its words are mapped
to the alphabet of the benchmark phrases; any other word is a boundary, and stretches
between boundaries that are shorter than the shortest phrase are left out, since nothing
can occur there. What remains gets a full suffix array (prefix doubling over unresolved
groups), its Burrows-Wheeler transform as a wavelet matrix with popcount ranks, and a
sample of suffix positions. All phrases are searched backwards at once; occurrences are
located by walking to the next sampled position, and their word ranges are merged into
removal spans.

The benchmark is a stated query set: it travels to the tasks in blocks of bounded size. One
block is the rule; each further block is a pass over the corpus of its own, whose findings are
checkpointed, so that a worker holds one block at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, own, unused, utf8

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000  # benchmark words that travel to the tasks at once
SAMPLE_EVERY = 16
_LOCATE_AT_ONCE = 1 << 20
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of digits, letters a-z and characters beyond ASCII."""
    return utf8(text).lower().translate(_SPLIT).split()


def _first_of_groups(values: np.ndarray) -> np.ndarray:
    """For sorted values, the index at which each one's run of equals begins."""
    new = np.concatenate([[True], values[1:] != values[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol has to be unique, as each boundary is."""
    order = np.argsort(symbols, kind="stable")
    first = _first_of_groups(symbols[order])
    rank = np.empty(len(symbols), np.int64)
    rank[order] = first
    width = 1
    while True:
        size = np.bincount(first, minlength=len(first))[first]
        open_at = np.flatnonzero(size > 1)  # places in the order that are not settled
        if not len(open_at):
            return order
        at = order[open_at]
        key = rank[at] * (len(symbols) + 1) + rank[np.minimum(at + width, len(symbols) - 1)]
        by = np.argsort(key, kind="stable")
        order[open_at] = at[by]
        first = first.copy()
        first[open_at] = open_at[_first_of_groups(key[by])]
        rank[order[open_at]] = first[open_at]
        width *= 2


class WaveletMatrix:
    """Access and rank over a sequence of symbols, all queries of a call at once."""

    def __init__(self, symbols: np.ndarray):
        self.size, self.levels = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[level][word] & ((np.uint64(1) << shift) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(at), at
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, end)
            start = np.where(bit, self.zeros[level] + a, start - a)
            end = np.where(bit, self.zeros[level] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = self._ones(level, at + 1) > ones
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbol


class FMIndex:
    """Backward search and location of phrases in a sequence whose symbol 0 is a boundary."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        boundary = symbols == 0
        unique = np.where(boundary, np.cumsum(boundary) - 1, symbols + int(boundary.sum()))
        order = suffix_array(unique)
        self.bwt = WaveletMatrix(symbols[order - 1])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols))])  # symbols smaller than each
        sampled = (np.arange(n) % SAMPLE_EVERY == 0) | boundary
        sampled[1:] |= boundary[:-1]  # so that no walk crosses a boundary
        self.is_sampled = sampled[order]
        self.sample_rank = np.cumsum(self.is_sampled) - 1
        self.samples = order[self.is_sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the range of suffixes that begin with it."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.bwt.size, np.int64)
        for column in phrases.T[::-1]:
            known = column < len(self.less) - 1
            symbol = np.where(known, column, 0)
            low = np.where(known, self.less[symbol] + self.bwt.rank(symbol, low), 0)
            high = np.where(known, self.less[symbol] + self.bwt.rank(symbol, high), 0)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place, steps, left = rows.copy(), np.zeros_like(rows), np.arange(len(rows))
        while True:
            left = left[~self.is_sampled[place[left]]]
            if not len(left):
                return self.samples[self.sample_rank[place]] + steps
            symbol = self.bwt.access(place[left])
            place[left] = self.less[symbol] + self.bwt.rank(symbol, place[left])
            steps[left] += 1


@dataclass
class Phrases:
    """Distinct windows of benchmark items, by length, and the items of each."""

    words: list[bytes] = field(default_factory=list)  # symbol k + 1 is word k
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # length: rows of symbols
    items: dict[int, list[list[str]]] = field(default_factory=dict)


def phrases_of(items: list[tuple[str, str | None]], window: int) -> Phrases:
    out, ids, found = Phrases(), {}, {}
    for item, text in items:
        symbols = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        size = min(window, len(symbols))
        for at in range(len(symbols) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(symbols[at : at + size]), {})[item] = None
    out.words = list(ids)
    out.windows = {n: np.array(list(rows), np.int64) for n, rows in found.items()}
    out.items = {n: [list(x) for x in rows.values()] for n, rows in found.items()}
    return out


def merge(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    spans: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[list[int]], list[str]]]:
    """For each text, as symbols with 0 for other words, the merged word spans of all occurrences and their items."""
    out: list[tuple[list[list[int]], list[str]]] = [([], []) for _ in docs]
    if not phrases.windows or not docs:
        return out
    shortest = min(phrases.windows)
    whole = np.concatenate([np.append(d, 0) for d in docs])
    document = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    edge = np.flatnonzero(whole == 0)
    size = np.diff(np.concatenate([[-1], edge]))  # of each stretch with the boundary after it
    kept = np.flatnonzero(np.repeat(size > shortest, size))
    if not len(kept):
        return out
    index = FMIndex(whole[kept])
    at_doc, at_start, at_end, at_item = [], [], [], {}
    for length, rows in phrases.windows.items():
        low, high = index.search(rows)
        count = high - low
        upto = np.cumsum(count)
        for first in range(0, int(upto[-1]), _LOCATE_AT_ONCE):
            nth = np.arange(first, min(first + _LOCATE_AT_ONCE, int(upto[-1])))
            which = np.searchsorted(upto, nth, side="right")
            place = kept[index.locate(low[which] + nth - (upto[which] - count[which]))]
            doc = document[place]
            at_doc.append(doc)
            at_start.append(place - begin[doc])
            at_end.append(place - begin[doc] + length)
            pairs = np.unique(doc * len(rows) + which)
            for pair in pairs.tolist():
                at_item.setdefault(pair // len(rows), {}).update(dict.fromkeys(phrases.items[length][pair % len(rows)]))
    if not at_doc:
        return out
    doc, start, end = map(np.concatenate, (at_doc, at_start, at_end))
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        out[int(doc[a])] = (merge(start[a:b], end[a:b]), sorted(at_item[int(doc[a])]))
    return out


_FOUND_SQL = "struct<spans: array<array<bigint>>, items: array<string>>"
_FOUND = pa.struct([("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_DIGEST_SQL = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, spans: array<array<bigint>>>"
_DIGEST = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    items, words = [], 0
    for item, text in rows.toLocalIterator():  # one partition of the query set at a time
        if words >= BLOCK_WORDS:
            yield phrases_of(items, window)
            items, words = [], 0
        items.append((item, text))
        words += len(text or "") // 2 + 1
    yield phrases_of(items, window)


def _search(phrases: Phrases, finish: Callable, kind: pa.DataType, sql: str, docs: DataFrame) -> Callable[[Column, Column], Column]:
    """A column function of a text and what earlier blocks found in it: ``finish`` of the text, its number of words, and all spans and items."""
    shared = docs.sparkSession.sparkContext.broadcast((phrases.words, phrases.windows, phrases.items))  # about BLOCK_WORDS at most
    bounded_batches(docs.sparkSession)

    def each(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        phrases = Phrases(*shared.value)
        symbol = {w: k + 1 for k, w in enumerate(phrases.words)}.get
        texts, earlier, held, words = [], [], [], 0

        def searched() -> pa.Array:
            made = []
            for text, before, symbols, (spans, items) in zip(texts, earlier, held, search_shard(held, phrases), strict=True):
                if before:
                    spans = merge(*np.array(before["spans"] + spans, np.int64).reshape(-1, 2).T)
                    items = sorted({*before["items"], *items})
                made.append(finish(text, len(symbols), spans, items))
            for x in (texts, earlier, held):
                x.clear()
            return pa.array(made, kind)

        for body, before in columns:
            for text, found in zip(body.to_pylist(), before.to_pylist(), strict=True):
                spelled = words_of(text)
                texts.append(text)
                earlier.append(found)
                held.append(np.fromiter(map(symbol, spelled, repeat(0)), np.int64, len(spelled)))
                words += len(spelled)
                if words >= SHARD_WORDS:
                    yield searched()
                    words = 0
        if held:
            yield searched()

    return F.arrow_udf(each, sql)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, finish: Callable, kind: pa.DataType, sql: str) -> tuple[DataFrame, Column]:
    """``docs``, with a column of what all blocks but the last found, and the column of what ``finish`` makes of each row."""
    text, name, earlier = F.col("text").cast("string"), unused(docs, "_found"), F.lit(None).cast(_FOUND_SQL)
    blocks = _blocks(benchmark, window)
    block = next(blocks)
    for later in blocks:
        found = _search(block, lambda text, n, spans, items: {"spans": spans, "items": items}, _FOUND, _FOUND_SQL, docs)
        docs = checkpoint(docs.withColumn(name, found(text, earlier)))
        block, earlier = later, F.col(name)
    return docs, _search(block, finish, kind, sql, docs)(text, earlier)


def _digest(text: str | None, n_words: int, spans: list[list[int]], items: list[str]) -> dict:
    n_hit = sum(b - a for a, b in spans)
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "spans": spans}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of every row of ``docs``.

    spans are merged half-open ranges of word indexes. Null and empty texts have no words; a long
    text is searched whole. Items without words have no window; a null item_id counts as "null".
    Repeated rows repeat, other columns of ``docs`` stay out, and an empty table gives an empty
    result. An empty benchmark leaves every document clean.
    """
    rows, found = _searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, _digest, _DIGEST, _DIGEST_SQL)
    out = rows.select("doc_id", found.alias("found")).select("doc_id", "found.*")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _cut(text: str | None, n_words: int, spans: list[list[int]], items: list[str]) -> str | None:
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every removal span cut from its text, and n_chars counted anew where there is such a column.

    A span runs from the first letter of its first word to the last of its last. All rows and
    columns stay, whatever the columns' names; null and empty texts stay as they are, repeated
    rows repeat, and an empty table or benchmark changes nothing.
    """
    rows, text = _searched(docs, benchmark, window, _cut, pa.string(), "string")
    out = rows.withColumn("text", text)
    out = out.select(own(out)[: len(docs.columns)])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
