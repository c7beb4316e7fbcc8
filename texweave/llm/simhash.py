"""SimHash near-duplicate groups by tiled exact comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its 3-word
shingles. Distinct fingerprints are dealt into tiles whose members share the population
counts of their four 16-bit parts. Two fingerprints at Hamming distance d have population
counts whose differences sum to at most d, so tile pairs with a larger sum are skipped,
and each remaining tile pair is compared exactly with numpy exclusive-or and bit counts.
Linked fingerprints become components by alternating large-star and small-star rounds.

The work on tiles grows with the square of the number of distinct fingerprints, divided
by about 20 from the population counts; it is the price of exact, recall-1 comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, own, unused, utf8

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
TILE_ROWS = 2048
EDGES_PER_TASK = 20_000  # when components are sought
HUB_EDGES = 500  # a node with more edges, and with over a thousandth of all, is a hub: its edges never meet in one task
_PARTS = 4
_BASE = 32  # over 16 + radius, so a count outside 0..16 never meets a valid key
_CHUNK = 1 << 16
_LOW_BITS = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    counts = np.zeros((8, 8), np.int64)  # by bit within the byte, by byte
    pad = -len(hashes) % 255
    rows = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LOW_BITS).sum(axis=1, dtype=np.uint64)
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.T.reshape(64)


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 if it has no words."""
    words = utf8(text).lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        spans = zip(first[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += _bit_counts(hashes)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > len(first)))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null texts count as empty."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprint_batches, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links a-b, at most one a value."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found_a, found_b = [], []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            a = left.values.to_numpy(zero_copy_only=False)
            b = right.values.to_numpy(zero_copy_only=False)
            near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= RADIUS
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            different = i != j
            if different.any():
                i, j = _forest(i[different], j[different])
                found_a.append(i)
                found_b.append(j)
        if found_a:
            arrays = [pa.array(np.concatenate(x), pa.int64()) for x in (found_a, found_b)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def _tile_offsets() -> list[int]:
    """Differences between the keys of tiles to compare, one of each opposite pair, 0 first."""
    near = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=_PARTS) if sum(map(abs, d)) <= RADIUS]
    return sorted({key for d in near if (key := sum(x * _BASE**k for k, x in enumerate(d))) >= 0})


def links(nodes: DataFrame) -> DataFrame:
    """Pairs a, b that connect the fingerprints ``fp`` of ``nodes`` as all links within the radius do."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    key = sum((part(k) * _BASE**k for k in range(1, _PARTS)), part(0)).cast("int")
    keyed = nodes.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE_ROWS).alias("n_tiles"))
    tiles = (
        keyed.join(sizes, "key")
        .groupBy("key", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).alias("tile"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = checkpoint(tiles)
    offsets = F.array(*map(F.lit, _tile_offsets()))
    left = tiles.select(
        F.col("key").alias("key_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"),
        F.explode(F.transform(offsets, lambda d: d + F.col("key"))).alias("key"),
    )
    pairs = left.join(tiles, "key").where((F.col("key") != F.col("key_a")) | (F.col("tile") >= F.col("tile_a")))
    return map_batches(pairs.select("fps_a", "fps"), _compare_batches, "a long, b long")


def _with_least(pairs: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``pairs`` with the m of their a in ``least``. The hubs of ``least``, some thousands at most, come by broadcast."""
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("hub_m")))
    tagged = pairs.join(hubs, "a", "left")
    usual = tagged.where("hub_m is null").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return usual.unionByName(tagged.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")))


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of the edges a, b; a root is listed only if linked.

    Alternates large-star and small-star rounds; each is checkpointed, and rounds end when
    an exact digest of the edges stays as it was.
    """
    ordered = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    edges = checkpoint(edges.where(F.col("a") != F.col("b")).select(*ordered("a", "b")).distinct())
    digest, n_edges = None, edges.count()
    while True:
        hub, tasks = max(HUB_EDGES, n_edges // 1000), 1 + n_edges // EDGES_PER_TASK
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where(F.col("b") > F.col("a")), least, hub)
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hub)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        # Few edges need few files. Edges never become more by a round than they were twice over.
        edges = checkpoint(small.where("a != b").select(*ordered("a", "b")).distinct().coalesce(tasks))
        halves = [F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b", F.lit(k)), F.lit(1 << 31))), F.lit(0)) for k in (1, 2)]
        now = tuple(edges.agg(F.count("*"), *halves).first())
        if now == digest:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        digest, n_edges = now, now[0]


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` with root: a fingerprint that all of its component share."""
    roots = connected(links(nodes)).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row of ``docs``.

    Texts without words and null texts have fingerprint zero and link like any other. Rows with
    a null doc_id keep their row and still link others; a component of such rows only has a null
    component_id. Repeated rows repeat in the result. An empty table gives an empty result.
    """
    prints = checkpoint(fingerprints(docs))
    rooted = _rooted(checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low"))))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    members = rooted.join(low, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(members, "fp").select("doc_id", text, "component_id")


def _row_keys(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id, a hash of the text, and one of all columns (maps left out) and their nulls."""
    given = [c for c, f in zip(own(docs), docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    row = F.xxhash64(*given, *(c.isNull() for c in given))
    return [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), row]


_KEYS = ["id", "body", "row"]


def _keyed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t.as_py()) for t in batch.column(3)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.int64())], [*_KEYS, "fp"])


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest doc_id, nulls last.

    Rows are told apart by all their columns, not by doc_id alone: of rows of a group with the same
    doc_id the one with the smallest hash stays, and of wholly equal rows one. Texts without words
    and null texts are one group. All columns pass unchanged, whatever their names; an empty table
    gives an empty result.
    """
    keys = _row_keys(docs)
    rows = docs.select(*(c.alias(k) for k, c in zip(_KEYS, keys, strict=True)), F.col("text").cast("string").alias("text"))
    prints = checkpoint(map_batches(rows, _keyed_batches, "id long, body long, row long, fp long"))
    each = prints.groupBy("fp", *_KEYS).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), *_KEYS, "n"))
    rooted = _rooted(checkpoint(each.groupBy("fp").agg(first.alias("low"))))
    tag = unused(docs, "_kept")
    keep = checkpoint(rooted.groupBy("root").agg(F.min("low").alias("low")).select(*(F.col(f"low.{k}").alias(f"{tag}_{k}") for k in _KEYS), F.col("low.n").alias(f"{tag}_n")))
    repeated = keep.where(F.col(f"{tag}_n") > 1).limit(1).count()
    same = [c.eqNullSafe(F.col(f"{tag}_{k}")) for k, c in zip(_KEYS, keys, strict=True)]
    kept = docs.join(keep.drop(f"{tag}_n"), same, "left_semi")
    if not repeated:
        return kept
    names = [f"{tag}_{k}" for k in _KEYS]
    once = kept.withColumns(dict(zip(names, _row_keys(kept), strict=True))).dropDuplicates(names)
    return once.select(own(once)[: len(docs.columns)])
