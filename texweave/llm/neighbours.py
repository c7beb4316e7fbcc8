"""Near-duplicate embeddings by NN-descent over balls of near copies.

Copies come first. In the order of a random-hyperplane signature, blocks of neighbours are
searched for balls: a centre and members at angles of at most half the threshold's angle from it,
so that members are linked for certain. Balls of balls follow until few merge, so that a group
with a third of all rows ends as a few balls, not as all its pairs.

Balls are the nodes of a neighbour graph. Two are the nearer the smaller the angle that their
closest members can have (angle of the centres less both radii). Lists start from blocks of
several signature orders and are refined through neighbours of neighbours: all neighbours of a
node, and those that have it for one, are compared with each other. A list is saturated if all it
holds may be linked; it is doubled. Rounds end when they find no more links and no list is saturated
and a brute-force audit of some nodes against all finds enough; else further orders begin anew.

Of the balls that may be linked, those whose members all are need no further look; the others'
members are compared in tiles, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, map_batches
from .simhash import connected

THRESHOLD = 0.9
NEAREST = 10  # of a list at first
ORDERS = 5  # that lists start from; an audit that fails adds as many
MOST_ORDERS = 20
BLOCK = 512  # consecutive nodes of an order that are compared with each other, with those of half a block before
BALL_BLOCK = 1024
AUDITED = 500  # nodes compared with all
LEAST_RECALL = 0.98  # of the audit
SIGNATURE_BITS = 62
TILE_ROWS = 512
SLACK = 0.01  # radians that angles of half-precision vectors may be off
SURE = 1e-6  # radians that angles of double-precision ones may be off
_BALL_SQL = "bid long, into long, unit binary, dim int, radius double, weight long, low long, sigs array<long>"


def _signatures(units: np.ndarray, orders: range) -> list[list[int]]:
    """Of each vector its sides of random hyperplanes, as a number for each order."""
    out = np.empty((len(units), len(orders)), np.int64)
    for k, order in enumerate(orders):
        planes = np.random.default_rng([order, units.shape[1]]).standard_normal((units.shape[1], SIGNATURE_BITS))
        out[:, k] = (units @ planes > 0) @ (np.int64(1) << np.arange(SIGNATURE_BITS - 1, -1, -1))
    return out.tolist()


def _stack(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _angles(a: np.ndarray, b: np.ndarray, dim_a: np.ndarray, dim_b: np.ndarray) -> np.ndarray:
    """Angles of each two; vectors with different numbers of components are opposite."""
    found = np.arccos(np.clip(a @ b.T, -1, 1))
    return np.where(dim_a[:, None] == dim_b[None, :], found, math.pi) if (dim_a != dim_a[0]).any() or (dim_b != dim_a[0]).any() else found


def _blocks(batches: Iterator[pa.RecordBatch], size: int, before: int = 0) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Stretches of ``size`` rows, each after ``before`` of the rows that come before it, and how many these are."""
    held, old = None, 0
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        while held.num_rows - old >= size:
            yield held.slice(0, old + size), old
            keep = min(before, old + size)
            held, old = held.slice(old + size - keep), keep
    if held is not None and held.num_rows > old:
        yield held, old


def _unit_batches(size: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nid, vec_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit = None
                if value and None not in value:
                    given = np.array(value, np.float64)
                    top = np.abs(given).max()
                    if np.isfinite(top) and top > 0:
                        given = given / top  # else squares of large or small components leave the range of doubles
                        unit = np.zeros(size)
                        unit[: len(given)] = given / np.sqrt((given * given).sum())
                rows.append((nid, nid, unit if unit is None else unit.tobytes(), len(value or []), 0.0, 1, vec_id))
            good = [k for k, r in enumerate(rows) if r[2] is not None]
            sigs: list = [None] * len(rows)
            if good:
                for k, s in zip(good, _signatures(np.stack([np.frombuffer(rows[k][2]) for k in good]), range(ORDERS)), strict=True):
                    sigs[k] = s
            yield _ball_batch([(*r, s) for r, s in zip(rows, sigs, strict=True)])

    return units


_BALL = pa.schema([
    ("bid", pa.int64()), ("into", pa.int64()), ("unit", pa.binary()), ("dim", pa.int32()), ("radius", pa.float64()), ("weight", pa.int64()), ("low", pa.int64()),
    ("sigs", pa.list_(pa.int64())),
])


def _ball_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_BALL)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _BALL, strict=True)], schema=_BALL)


def _merge_batches(most: float):
    """Balls of neighbouring balls: every ball with the one that it goes ``into``, of which the first has the data."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches, BALL_BLOCK):
            units = _stack(block.column("unit"), np.float64)
            bid, dim, radius, weight = (block.column(c).to_numpy(zero_copy_only=False) for c in ("bid", "dim", "radius", "weight"))
            low = block.column("low").to_pylist()
            near = _angles(units, units, dim, dim) + radius[None, :] <= most
            np.fill_diagonal(near, False)
            into, new = np.arange(len(bid)), {}
            free = np.ones(len(bid), bool)
            for k in np.argsort(-(near @ weight), kind="stable"):
                members = np.flatnonzero(near[k] & free)
                if not free[k] or not len(members):
                    continue
                members = np.append(members, k)
                centre = weight[members] @ units[members]
                centre /= np.sqrt(centre @ centre)
                reach = np.arccos(np.clip(units[members] @ centre, -1, 1)) + radius[members]
                members, reach = members[reach <= most], reach[reach <= most]
                if len(members) > 1:
                    free[members] = False
                    into[members] = members[0]
                    new[members[0]] = centre, reach.max(), weight[members].sum(), min((low[m] for m in members if low[m] is not None), default=None)
            sigs = _signatures(np.stack([new[k][0] for k in new]), range(ORDERS)) if new else []
            fresh = dict(zip(new, sigs, strict=True))
            old = block.column("sigs").to_pylist()
            rows = []
            for k, to in enumerate(into):
                if k in new:
                    rows.append((bid[k], bid[k], new[k][0].tobytes(), dim[k], new[k][1], new[k][2], new[k][3], fresh[k]))
                elif to == k:
                    rows.append((bid[k], bid[k], units[k].tobytes(), dim[k], radius[k], weight[k], low[k], old[k]))
                else:
                    rows.append((bid[k], bid[to], None, dim[k], radius[k], weight[k], low[k], None))
            yield _ball_batch(rows)

    return merged


def _sorted(nodes: DataFrame, sig: Column) -> DataFrame:
    return nodes.withColumn("_sig", sig).repartitionByRange("_sig", "bid").sortWithinPartitions("_sig", "bid").drop("_sig")


def _balls(rows: DataFrame, angle: float) -> list[DataFrame]:
    """Levels of merging: each has the balls of the one before with the ball that each goes into; those that go into themselves are the next."""
    levels, balls = [], rows.where("unit is not null")
    before = balls.count()
    while True:
        level = checkpoint(map_batches(_sorted(balls, F.get("sigs", F.lit(len(levels) % ORDERS))), _merge_batches(angle / 2 - SURE), _BALL_SQL))
        levels.append(level)
        balls = level.where("bid = into")
        now = balls.count()
        if now >= 0.95 * before:  # few merge, or there are none
            return levels
        before = now


def _close_batches(size: int, orders: range | None, k: int):
    """a, b and gap of the nearest of each node among its block; with ``orders`` only signs nodes anew."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = _signatures(_stack(batch.column("vec"), np.float16).astype(np.float32), orders) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.list_(pa.int64()))], [*batch.schema.names, "sigs"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, old in _blocks(batches, size, size // 2):
            units = _stack(block.column("vec"), np.float16).astype(np.float32)
            bid, dim, radius = (block.column(c).to_numpy(zero_copy_only=False) for c in ("bid", "dim", "radius"))
            gaps = _angles(units, units, dim, dim) - radius[:, None] - radius[None, :]
            np.fill_diagonal(gaps, np.inf)
            gaps[:old, :old] = np.inf  # met in the block before
            most = min(k, len(bid))
            near = np.argpartition(gaps, most - 1, axis=1)[:, :most]
            a, b = np.repeat(np.arange(len(bid)), most), near.ravel()
            found = np.isfinite(gaps[a, b])
            a, b = a[found], b[found]
            yield pa.RecordBatch.from_arrays([pa.array(bid[a]), pa.array(bid[b]), pa.array(gaps[a, b].astype(np.float64))], ["a", "b", "gap"])

    return close if orders is None else signed


def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and gap of the pairs of each node's neighbours of which one is fresh, where b is nearer than all that a has."""
    for batch in batches:
        out = []
        for met in batch.column(0):
            held = met.values
            bid, dim, radius, bound, fresh = (held.field(c).to_numpy(zero_copy_only=False) for c in ("bid", "dim", "radius", "bound", "fresh"))
            units = _stack(held.field("vec"), np.float16).astype(np.float32)
            gaps = _angles(units, units, dim, dim) - radius[:, None] - radius[None, :]
            good = (gaps < bound[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(good, False)
            a, b = np.nonzero(good)
            out.append((bid[a], bid[b], gaps[a, b].astype(np.float64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "gap"])


def _lists(known: DataFrame | None, found: DataFrame, angle: float) -> DataFrame:
    """The nearest of each node: a, b, gap, fresh (not known before), k (how many a's list may have), bound and saturated (of a's list)."""
    new = found.select("a", "b", "gap", F.lit(True).alias("fresh"), F.lit(NEAREST).alias("k"))
    if known is not None:
        new = known.select("a", "b", "gap", F.lit(False).alias("fresh"), F.when(F.col("saturated"), 2 * F.col("k")).otherwise(F.col("k")).alias("k")).unionByName(new)
    each = new.groupBy("a", "b").agg(F.min("gap").alias("gap"), F.bool_and("fresh").alias("fresh"), F.max("k").alias("k"))
    of_a = W.partitionBy("a")
    ranked = each.withColumn("k", F.max("k").over(of_a)).withColumn("rank", F.row_number().over(of_a.orderBy("gap", "b"))).where("rank <= k")
    full = F.count("*").over(of_a) >= F.col("k")
    last = F.max("gap").over(of_a)
    bound = F.when(full & (last > angle), last).otherwise(F.lit(float("inf")))
    return checkpoint(ranked.select("a", "b", "gap", "fresh", "k", bound.alias("bound"), (full & (last <= angle)).alias("saturated")))


def _neighbours_met(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and gap of new pairs among the neighbours of each node, and among those that have it in their lists (of these as many as its own list may have, by hash)."""
    ahead = lists.select(F.col("a").alias("x"), F.col("b").alias("y"), "fresh", "k", F.lit(0).alias("back"))
    behind = lists.select(F.col("b").alias("x"), F.col("a").alias("y"), "fresh", F.lit(None).cast("int").alias("k"), F.lit(1).alias("back"))
    both = ahead.unionByName(behind).groupBy("x", "y").agg(F.max("fresh").alias("fresh"), F.max("k").alias("k"), F.min("back").alias("back"))
    of_x = W.partitionBy("x")
    both = both.withColumn("k", F.coalesce(F.max("k").over(of_x), F.lit(NEAREST)))
    both = both.withColumn("rank", F.row_number().over(W.partitionBy("x", "back").orderBy(F.desc("fresh"), F.xxhash64("x", "y")))).where("rank <= k")
    bounds = lists.groupBy("a").agg(F.max("bound").alias("bound"))
    held = nodes.join(bounds, nodes["bid"] == bounds["a"], "left").select("bid", "vec", "dim", "radius", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    sent = both.select("x", F.col("y").alias("bid"), "fresh").join(held, "bid")
    met = sent.groupBy("x").agg(F.collect_list(F.struct("bid", "vec", "dim", "radius", "bound", "fresh")).alias("met"), F.max("fresh").alias("any"))
    return map_batches(met.where("any").select("met"), _meet_batches, "a long, b long, gap double").groupBy("a", "b").agg(F.min("gap").alias("gap"))


def _audit_batches(units: np.ndarray, bid: np.ndarray, dim: np.ndarray, radius: np.ndarray, angle: float):
    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, others, dims, radii = _stack(batch.column("vec"), np.float16).astype(np.float32), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bid", "dim", "radius"))
            if not len(others):
                continue
            gaps = _angles(units, other, dim, dims) - radius[:, None] - radii[None, :]
            a, b = np.nonzero((gaps <= angle) & (bid[:, None] != others[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(bid[a]), pa.array(others[b]), pa.array(gaps[a, b].astype(np.float64))], ["a", "b", "gap"])

    return audited


def audit(nodes: DataFrame, lists: DataFrame, angle: float, most: int = AUDITED) -> tuple[float, DataFrame]:
    """The share of the true near neighbours of ``most`` nodes that their lists hold, and these neighbours: found by comparing the nodes with all, in blocks."""
    picked = nodes.orderBy(F.xxhash64("bid"), "bid").limit(most).collect()  # at most ``most`` vectors
    if not picked:
        return 1.0, lists.select("a", "b", "gap").limit(0)
    units = np.stack([np.frombuffer(bytes(r.vec), np.float16) for r in picked]).astype(np.float32)
    sides = (np.array([r[c] for r in picked]) for c in ("bid", "dim", "radius"))
    true = checkpoint(map_batches(nodes, _audit_batches(units, *sides, angle), "a long, b long, gap double"))
    n = true.count()
    return (true.join(lists, ["a", "b"], "left_semi").count() / n if n else 1.0), true


def neighbour_lists(nodes: DataFrame, angle: float) -> tuple[DataFrame, float]:
    """a, b and gap: of each node (bid, vec in half precision, dim, radius, sigs) the nearest others, all with a gap of at most ``angle`` among them as far as the audited share says."""
    lists, orders = None, range(ORDERS)
    while True:
        signed = nodes if orders.start == 0 else checkpoint(map_batches(nodes.drop("sigs"), _close_batches(BLOCK, orders, NEAREST), "bid long, vec binary, dim int, radius double, sigs array<long>"))
        found = None
        for k in range(len(orders)):
            close = map_batches(_sorted(signed, F.get("sigs", F.lit(k))), _close_batches(BLOCK, None, NEAREST), "a long, b long, gap double")
            found = close if found is None else found.unionByName(close)
        lists, rounds = _lists(lists, found, angle), 0
        while True:
            lists, rounds = _lists(lists, _neighbours_met(lists, nodes), angle), rounds + 1
            near, new, saturated = lists.agg(F.count_if(F.col("gap") <= angle), F.count_if((F.col("gap") <= angle) & F.col("fresh")), F.count_if("saturated")).first()
            if rounds > 1 and 1000 * new <= near and not saturated:
                break
        recall, true = audit(nodes, lists, angle)
        if recall >= LEAST_RECALL or orders.stop >= MOST_ORDERS:
            return lists.unionByName(true, allowMissingColumns=True), recall
        orders = range(orders.stop, orders.stop + ORDERS)


def _judge_batches(angle: float, cosine: float):
    """a, b and whether all their members are linked; pairs with none linked go."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_stack(batch.column(c), np.float64) for c in ("unit_a", "unit_b"))
            r = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            single = (batch.column("weight_a").to_numpy() == 1) & (batch.column("weight_b").to_numpy() == 1)
            cos = (x * y).sum(axis=1)
            between = np.arccos(np.clip(cos, -1, 1))
            whole = np.where(single, cos >= cosine, between + r <= angle - SURE)
            keep = whole | (~single & (between - r <= angle + SURE))
            keep &= batch.column("dim_a").to_numpy() == batch.column("dim_b").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(whole[keep])], ["a", "b", "whole"])

    return judged


def _tile_batches(cosine: float):
    """a, b, nid and n: how many of the other ball's tile each member is linked with, if any."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, of_a, of_b in zip(*batch.columns, strict=True):
                (x, nid_a), (y, nid_b) = ((_stack(t.values.field("unit"), np.float64), t.values.field("nid").to_numpy()) for t in (of_a, of_b))
                near = x @ y.T >= cosine
                for ids, n in ((nid_a, near.sum(axis=1)), (nid_b, near.sum(axis=0))):
                    some = np.flatnonzero(n)
                    out.append((np.full(len(some), a.as_py()), np.full(len(some), b.as_py()), ids[some], n[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["a", "b", "nid", "n"])

    return tiles


def _down(levels: list[DataFrame], table: DataFrame) -> DataFrame:
    """``table`` by the balls of the last level, as a table by the rows: each ball hands its values to at most ``BALL_BLOCK`` of the level before."""
    for level in reversed(levels):
        table = level.select(F.col("bid").alias("from"), F.col("into").alias("bid")).join(table, "bid").drop("bid").withColumnRenamed("from", "bid")
    return table


def near_duplicate_embeddings(vectors: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows with a cosine of at least ``cosine``, component_id is the smallest
    vec_id reachable by links. Links are verified in double precision: none is below the threshold;
    which are found is up to the neighbour lists, whose recall is audited.

    Null and zero vectors and those with null or non-finite components are linked with nothing, nor
    are vectors with different numbers of components. Rows that repeat are vectors of their own that
    link each other. Rows with a null vec_id stay and link others; a component of such rows only has a
    null component_id, and they are not kept. Other columns stay out; an empty table gives an empty result.
    """
    angle = math.acos(cosine)
    given = vectors.select(F.monotonically_increasing_id().alias("nid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = checkpoint(map_batches(given, _unit_batches(max(size, 1)), _BALL_SQL))
    levels = _balls(rows, angle)
    balls = levels[-1].where("bid = into").select("bid", "unit", "dim", "radius", "weight", "low", "sigs")
    nodes = checkpoint(map_batches(balls.select("bid", "unit", "dim", "radius", "sigs"), _halved, "bid long, vec binary, dim int, radius double, sigs array<long>"))
    lists, _ = neighbour_lists(nodes, angle + SLACK)

    near = lists.where(F.col("gap") <= angle + SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: balls.select(F.col("bid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("unit", "dim", "radius", "weight")))
    judged = checkpoint(map_batches(near.join(side("a"), "a").join(side("b"), "b"), _judge_batches(angle, cosine), "a long, b long, whole boolean"))
    parted = judged.where("not whole").select("a", "b")
    looked = parted.select(F.col("a").alias("bid")).union(parted.select("b")).distinct().join(balls.select("bid", F.ceil(F.col("weight") / TILE_ROWS).alias("tiles")), "bid")
    members = _down(levels, looked.select("bid", F.col("bid").alias("ball"), "tiles")).join(rows.select("bid", "unit"), "bid")
    tiles = members.groupBy("ball", F.pmod(F.xxhash64("bid"), F.col("tiles")).alias("tile")).agg(F.collect_list(F.struct(F.col("bid").alias("nid"), "unit")).alias("held"))
    tiles = checkpoint(tiles)
    met = parted.join(tiles.select(F.col("ball").alias("a"), F.col("held").alias("of_a")), "a").join(tiles.select(F.col("ball").alias("b"), F.col("held").alias("of_b")), "b")
    counted = checkpoint(map_batches(met.select("a", "b", "of_a", "of_b"), _tile_batches(cosine), "a long, b long, nid long, n long").groupBy("a", "b", "nid").agg(F.sum("n").alias("n")))

    whole = judged.where("whole").select("a", "b")
    weights = balls.select(F.col("bid").alias("b"), "weight")
    around = whole.union(whole.select("b", "a")).toDF("a", "b").join(weights, "b").groupBy(F.col("a").alias("bid")).agg(F.sum("weight").alias("around"))
    roots = connected(whole.union(counted.select("a", "b").distinct()))
    rooted = balls.select("bid", "weight", "low").join(roots.withColumnRenamed("node", "bid"), "bid", "left").withColumn("root", F.coalesce("root", "bid"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(lows, "root").join(around, "bid", "left").select("bid", (F.col("weight") - 1 + F.coalesce("around", F.lit(0))).alias("sure"), "component_id")
    more = counted.groupBy(F.col("nid").alias("bid")).agg(F.sum("n").alias("more"))
    out = rows.select("bid", F.col("low").alias("vec_id"), F.col("unit").isNull().alias("alone")).join(_down(levels, known), "bid", "left").join(more, "bid", "left")
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    n_links = F.coalesce("sure", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = [np.frombuffer(u, np.float64).astype(np.float16).tobytes() for u in batch.column("unit").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("bid"), pa.array(vec, pa.binary()), batch.column("dim"), batch.column("radius"), batch.column("sigs")], ["bid", "vec", "dim", "radius", "sigs"])
