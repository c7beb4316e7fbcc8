"""Sharding by histogram sort, in DataFrame operations only.

Every row has a 64-bit key: 40 bits of its text's md5 and 24 bits of its doc_id's, so that
equal texts are neighbours in key order and yet no key is heavy. Round after round, the
bytes below candidate boundaries (multiples of a power of two inside the intervals that
still hold a splitter) are counted exactly over all partitions, until each splitter is known
to the tolerance. A splitter inside a text's rows moves to their nearer edge, so that equal texts
share a shard; only a text that alone passes a shard's share is split. Then rows are exchanged
once: each goes to the task of its shard's sub-range of the keys, whose rows are counted
beforehand, and is numbered there. ``sharded`` does so with the documents and all their columns,
``assign`` with a digest of a few numbers.

A round sends at most ``2 ** STEP_BITS`` sums for each splitter to the driver, and ``MOST_SENT`` in all: with
more intervals open a round refines them by fewer bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own, unused

SHARDS = 40
ROW_BYTES = 16  # what a row costs besides its text
STEP_BITS = 12
MOST_SENT = 200_000  # sums that a round sends to the driver; splitters are shards times MOST_RANGES at most
KEY_BITS = 63  # keys are non-negative longs
ID_BITS = 24  # of a key, the bits that tell rows of one text apart
RANGE_BYTES = 1 << 26  # bytes of a shard that one task takes, about
MOST_RANGES = 256  # sub-ranges of a shard; beyond them a task takes more bytes, and its sort spills


def _bits(value: Column, bits: int) -> Column:
    """The first bits of md5 as a non-negative long."""
    return F.shiftrightunsigned(F.conv(F.substring(F.md5(value), 1, 10), 16, 10).cast("long"), 40 - bits)


def shard_key(text: Column, doc_id: Column) -> Column:
    first = _bits(F.coalesce(text, F.lit("")).cast("binary"), 39)
    second = _bits(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), ID_BITS)
    return F.shiftleft(first, ID_BITS).bitwiseOR(second)


def splitters(keys: DataFrame, shards: int, tolerance: int = 0) -> list[int]:
    """Keys at which the second to the last shard begin: shard i begins at the first key with i/shards of the bytes or more below it.

    ``keys`` has _key and size. With a tolerance a splitter may be off by so many bytes.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    aims = {i: -(-total * i // shards) for i in range(1, shards)}
    # Of each open interval: its first key, the bytes below it, and the splitters it holds.
    open_, known, bits = {0: (0, list(aims))}, {}, KEY_BITS
    while open_ and total:
        step = max(1, min(STEP_BITS, bits, (MOST_SENT // len(open_)).bit_length() - 1))
        inside = keys if bits == KEY_BITS else keys.where(F.shiftrightunsigned("_key", bits).isin([k >> bits for k in open_]))
        cell = F.shiftrightunsigned("_key", bits - step)
        found = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("b"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
        bits -= step
        cells: dict[int, list] = {}
        for row in sorted(found):
            cells.setdefault(row.cell >> step, []).append(row)
        later: dict[int, tuple[int, list[int]]] = {}
        for first, (below, held) in open_.items():
            waiting = sorted(held)
            for row in cells.get(first >> (bits + step), []):
                while waiting and aims[waiting[0]] <= below:
                    known[waiting.pop(0)] = row.low
                inner = [i for i in waiting if aims[i] < below + row.b]
                if inner and row.low < row.high and row.b > tolerance:
                    later[row.cell << bits] = (below, inner)
                    waiting = [i for i in waiting if i not in inner]
                below += row.b
            for i in waiting:  # nothing of this interval is left above it: it begins with what follows
                known[i] = first + (1 << (bits + step))
        open_ = later
    return [min(known.get(i, 0), (1 << KEY_BITS) - 1) for i in range(1, shards)]


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def _at_or_below(values: list[int], key: Column) -> Column:
    return F.size(F.filter(_longs(values), lambda e: e <= key)) if values else F.lit(0)


def snapped(keys: DataFrame, starts: list[int], shards: int) -> list[int]:
    """``starts``, those inside the rows of one text moved to the nearer edge of them, unless the text passes a shard's share."""
    last = (1 << KEY_BITS) - 1
    texts = sorted({s >> ID_BITS for s in starts if s < last})
    total = keys.agg(F.sum("size")).first()[0] or 0
    inside = keys.select(F.shiftrightunsigned("_key", ID_BITS).alias("text"), _at_or_below(starts, F.col("_key")).alias("shard"), "size")
    held = inside.where(F.col("text").isin(texts)).groupBy("text", "shard").agg(F.sum("size").alias("b")).collect()  # some rows a splitter
    out = []
    for i, start in enumerate(starts, 1):
        text = start >> ID_BITS
        every, before = (sum(r.b for r in held if r.text == text and r.shard < k) for k in (shards, i))
        if start < last and every * shards <= total:
            start = (text if 2 * before <= every else text + 1) << ID_BITS
        out.append(min(start, last))
    return out


def _dealt(rows: DataFrame, keys: DataFrame, order: list[str], shards: int, tolerance: int, range_bytes: int) -> tuple[DataFrame, Column, Column]:
    """``rows`` exchanged once to the sub-ranges of their shards and sorted there by ``order``, whose first is the key; shard and slot."""
    starts = snapped(keys, splitters(keys, shards, tolerance), shards)
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = min(-(-total // (shards * range_bytes)), MOST_RANGES) or 1
    # Where a shard's sub-ranges begin: only shards have exact bounds, these may be off by a quarter.
    finer = splitters(keys, shards * ranges, total // (shards * ranges * 4)) if ranges > 1 else []
    low, high = [0, *starts], [*starts, 1 << KEY_BITS]
    inner = [sorted({e for e in finer if a < e < b}) for a, b in zip(low, high, strict=True)]
    first = [sum(len(x) + 1 for x in inner[:k]) for k in range(shards)]  # the first partition of each shard

    def placed(key: Column) -> tuple[Column, Column]:
        shard = _at_or_below(starts, key)
        within = F.size(F.filter(F.element_at(F.array(*map(_longs, inner)), shard + 1), lambda e: e <= key)) if ranges > 1 else F.lit(0)
        return shard, (F.element_at(_longs(first), shard + 1) + within).cast("int")

    held = {r.part: r.n for r in keys.groupBy(placed(F.col("_key"))[1].alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a sub-range
    base = []
    for x in inner:
        for k in range(len(x) + 1):
            base.append(base[-1] + held.get(len(base) - 1, 0) if k else 0)
    shard, part = placed(F.col(order[0]))
    at = f"{order[0]}_at"
    sorted_ = rows.repartitionById(len(base), part).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id() % (1 << 33))
    return sorted_, shard, F.element_at(_longs(base), part + 1) + F.col(at)


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``; the law is bytes.

    Shards are stretches of the key order. Equal texts share a shard, unless together they pass a
    shard's share of the bytes. Null and empty texts are one text; they have no bytes, crc32 0, and
    cost 16 like any row. Repeated rows repeat, with slots of their own. Other columns of ``docs``
    stay out. An empty table gives an empty result.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(body) + ROW_BYTES).cast("long").alias("size")
    key = shard_key(F.col("text").cast("string"), F.col("doc_id").cast("long")).alias("_key")
    rows = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, F.crc32(body).alias("text_crc32"), key))
    out, shard, slot = _dealt(rows, rows, ["_key", "doc_id", "size", "text_crc32"], shards, tolerance, range_bytes)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with all columns, and the shard and slot (within its shard, from 0) of every row, as ``assign`` gives them.

    Rows lie by shard and slot: a partition holds a stretch of one shard, about ``range_bytes`` of it.
    The documents are exchanged once. Only rows that repeat doc_id and text have to share a task.
    Null and empty texts and repeated rows are dealt as by ``assign``. Where ``docs`` has a column
    shard or slot, it stays, and the new one gets an underscore after its name. An empty table
    gives an empty result.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key, tag = shard_key(F.col("text").cast("string"), F.col("doc_id").cast("long")), unused(docs, "_shard")
    keys = checkpoint(docs.select(key.alias("_key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size")))
    order = {f"{tag}_key": key, f"{tag}_id": F.col("doc_id").cast("long"), f"{tag}_size": F.octet_length(body), f"{tag}_crc": F.crc32(body)}
    out, shard, slot = _dealt(docs.withColumns(order), keys, list(order), shards, 0, range_bytes)
    taken, names = [c.lower() for c in docs.columns], []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        names.append(name)
    return out.select(*own(out)[: len(docs.columns)], shard.alias(names[0]), slot.alias(names[1]))
