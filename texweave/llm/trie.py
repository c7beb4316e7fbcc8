"""Prefix trie of conversations: what their turns share, node by node.

Turns are encoded by a dictionary of their distinct (role, text), so that a conversation is an
array of ids; texts never leave the scan. Equal conversations collapse to one sequence with the
number of its members. Buckets of sequences with a common prefix are dealt by their next turn,
round by round (most significant digit first), while they are too large for a task; buckets that
fit are exchanged once and finished by multikey quicksort, whose recursion emits the nodes. Nodes
above the buckets are summed from the roots of what is below them.

A conversation is one row of its turn ids and sizes, 16 bytes a turn. A round takes one turn of
those prefixes that over ``bucket_rows`` different sequences share; rounds end with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches

HEAD_TURNS = 8  # the most turns that a conversation takes from its base
PIECE_IDS = 4096  # consecutive conv_ids that are joined to one piece before a group's pieces are hashed in order
LEAST_BUCKET, MOST_BUCKET = 1_000, 20_000  # sequences that one task finishes: a thousandth of all, within these bounds
BUCKET_TURNS = 1_000_000  # turns beyond which a bucket of over LEAST_BUCKET sequences is dealt, too
MOST_BROADCAST = 500_000  # keys of large buckets; there are at most as many as sequences over MOST_BUCKET, or a thousand
NODES_OUT = 20_000
_NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("up", pa.binary()),
])
_NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary"
COLUMNS = [f.name for f in _NODE][:-1]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (16 bytes that stand for role and text) and size (UTF-8 bytes of the text) of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    return turns.where("conv_id is not null")


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and sizes of every conversation: its turns in order, by the ids of a dictionary of distinct turns."""
    turns = checkpoint(_turns(conversations))
    counts = turns.groupBy("key").agg(F.count("*").alias("n"))
    words = checkpoint(counts.withColumn("id", F.monotonically_increasing_id()))
    # Turns that stand in a thousandth of the rows or more, a thousand at most, come by broadcast; the others have few rows each.
    most = max(1_000, turns.count() // 1_000)
    common = F.broadcast(words.where(F.col("n") > most).select("key", F.col("id").alias("hot")))
    tagged = turns.join(common, "key", "left")
    usual = tagged.where("hot is null").drop("hot").join(words.where(F.col("n") <= most).select("key", "id"), "key")
    rows = usual.unionByName(tagged.where("hot is not null").withColumnRenamed("hot", "id"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "id", "size"))).alias("t"))
    return each.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(encoded_: DataFrame, family: int = 5, heads: int = HEAD_TURNS) -> DataFrame:
    """conv_id, ids and sizes of conversations whose first h turns are those of conv_id - conv_id % family; h = crc32(conv_id) % (heads + 1)."""
    own = encoded_.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (heads + 1)).cast("int"))
    first = encoded_.select(F.col("conv_id").alias("base"), F.slice("ids", 1, heads).alias("head_ids"), F.slice("sizes", 1, heads).alias("head_sizes"))

    def joined(c: str) -> Column:
        head = F.slice(F.coalesce(f"head_{c}", F.array().cast("array<long>")), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return own.join(first, "base", "left").select("conv_id", joined("ids"), joined("sizes"))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """least conv_id, number and SHA-256 of the joined conv_ids of each key, from pieces sorted by key; a piece at a time is held."""
    key = first = n = digest = None
    for batch in batches:
        out = []
        for k, low, size, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == key:
                n += size
                digest.update(b"," + piece.encode())
            else:
                if key is not None:
                    out.append((first, n, digest.hexdigest()))
                key, first, n, digest = k, low, size, hashlib.sha256(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv_id", "n", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first, n, digest.hexdigest())], ["conv_id", "n", "ends"])


def _sequences(whole: DataFrame) -> DataFrame:
    """The distinct sequences: conv_id (the smallest), n, ends (of all that are equal), ids and sizes."""
    key = F.unhex(F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")))
    pieces = whole.select(key.alias("key"), "conv_id").groupBy("key", F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("c"))
    pieces = pieces.select("key", "piece", F.get("c", F.lit(0)).alias("low"), F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda i: i.cast("string")), ",").alias("joined"))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "piece").drop("piece")
    return map_batches(dealt, _digest_batches, "conv_id long, n long, ends string").join(whole, "conv_id")


def _bucket_nodes(depth: int, size: int, rows: list[tuple]) -> list[list]:
    """Nodes of a bucket, its root first, as lists by column; rows have conv_id, n, ends, ids and sizes after the root's prefix.

    A frame of the multikey quicksort holds sequences that share a node; those that go on are
    parted by their next turn into smaller, equal and greater ones, and the equal ones are a child.
    """
    convs, depths, parents, counts, children, leaves, saved, ends = [], [], [], [], [], [], [], []

    def node(members: list[int], at: int, above: int, last: int) -> int:
        n = sum(rows[m][1] for m in members)
        convs.append(min(rows[m][0] for m in members))
        depths.append(depth + at)
        parents.append(above)
        counts.append(n)
        children.append(0)
        leaves.append(0)
        saved.append((n - 1) * last)
        ends.append(NO_ENDS)
        if above >= 0:
            children[above] += 1
        return len(convs) - 1

    every = list(range(len(rows)))
    stack = [(node(every, 0, -1, size), every, 0)]
    while stack:
        above, members, at = stack.pop()
        on = []
        for m in members:
            if len(rows[m][3]) == at:
                ends[above] = rows[m][2]
            else:
                on.append(m)
        if len(on) == 1:  # nothing to part: a chain to the sequence's end
            _, _, end, ids, sizes = rows[on[0]]
            for k in range(at, len(ids)):
                above = node(on, k + 1, above, sizes[k])
            ends[above] = end
        elif on:
            pivot = rows[on[len(on) // 2]][3][at]
            parted = [[], [], []]
            for m in on:
                turn = rows[m][3][at]
                parted[(turn >= pivot) + (turn > pivot)].append(m)
            less, equal, more = parted
            stack += [(above, x, at) for x in (less, more) if x]
            stack.append((node(equal, at + 1, above, rows[equal[0]][4][at]), equal, at + 1))
    for k in range(len(convs) - 1, -1, -1):  # a child comes after its parent
        leaves[k] = leaves[k] or 1
        if k:
            leaves[parents[k]] += leaves[k]
            saved[parents[k]] += saved[k]
    return [convs, depths, [None if p < 0 else convs[p] for p in parents], counts, children, leaves, saved, ends]


def _trie_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of buckets whose rows follow each other: bucket, up, depth, size, conv_id, n, ends, ids, sizes."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out = [[] for _ in _NODE]
    for (_, up, depth, size), held in groupby(rows, key=lambda r: r[:4]):
        found = _bucket_nodes(depth, size, [r[4:] for r in held])
        for column, values in zip(out, [*found, [up] + [None] * (len(found[0]) - 1)], strict=True):
            column.extend(values)
        if len(out[0]) > NODES_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODE, strict=True)], schema=_NODE)
            out = [[] for _ in _NODE]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODE, strict=True)], schema=_NODE)


def _few(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def _dealt(sequences: DataFrame, bucket_rows: int, bucket_turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """The buckets that fit a task, and by depth the sequences of those that do not.

    Rows have bucket and up (keys of the prefix and of the one a turn shorter), depth, size (of the
    prefix's last turn), and the sequences, whole.
    """
    start = sequences.select(F.lit(b"").alias("bucket"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "*")
    if sequences.count() <= bucket_rows:
        return start, []
    fitting, large, active = None, [], start
    while True:
        large.append(active)
        on = active.where(F.size("ids") > F.col("depth"))
        at = (F.col("depth") + 1).cast("int")
        turn = F.element_at("ids", at)
        key = F.unhex(F.md5(F.concat("bucket", F.encode(turn.cast("string"), "utf-8"))))
        dealt = on.select(key.alias("bucket"), F.col("bucket").alias("up"), (F.col("depth") + 1).alias("depth"), F.element_at("sizes", at).alias("size"), *sequences.columns)
        sizes = dealt.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("depth")).alias("turns"))
        over = checkpoint(sizes.where((F.col("rows") > bucket_rows) | ((F.col("rows") > LEAST_BUCKET) & (F.col("turns") > bucket_turns))).select("bucket"))
        n = over.count()
        held = dealt.join(_few(over, n), "bucket", "left_anti") if n else dealt
        fitting = held if fitting is None else fitting.unionByName(held)
        if not n:
            return fitting, large
        active = checkpoint(dealt.join(_few(over, n), "bucket", "left_semi"))


def prefix_trie(sequences: DataFrame, bucket_rows: int | None = None, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, ids, sizes), as ``conversation_trie`` lists them."""
    distinct = checkpoint(_sequences(sequences))
    bucket_rows = bucket_rows or min(max(LEAST_BUCKET, distinct.count() // 1_000), MOST_BUCKET)
    fitting, large = _dealt(distinct, bucket_rows, bucket_turns)
    after = lambda c: F.slice(c, F.col("depth").cast("int") + 1, F.greatest(F.size(c) - F.col("depth").cast("int"), F.lit(0))).alias(c)
    local = fitting.select("bucket", "up", "depth", "size", "conv_id", "n", "ends", after("ids"), after("sizes"))
    # A null ``up`` tells nodes inside a bucket from its root; only the root of all has neither.
    nodes = checkpoint(map_batches(local.repartition("bucket").sortWithinPartitions("bucket"), _trie_batches, _NODE_SQL))
    tops, below = None, nodes.where("up is not null")
    for rows in reversed(large):
        held = rows.groupBy("bucket").agg(F.max("up").alias("above"), F.max("depth").alias("depth"), F.max("size").alias("size"))
        ended = rows.where(F.size("ids") == F.col("depth")).select("bucket", "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "ends")
        inner = below.select(F.col("up").alias("bucket"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
        sums = inner.union(ended).groupBy("bucket").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))
        saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")
        level = held.join(sums, "bucket").select("bucket", F.col("above").alias("up"), "depth", "conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
        level = checkpoint(level)
        tops = level if tops is None else tops.unionByName(level)
        # Buckets of the next level up are prefixes of these and of the fitting ones one turn longer than they.
        below = nodes.where("up is not null").unionByName(level.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*nodes.columns))
    if tops is None:
        return nodes.select(COLUMNS)
    named = tops.select(F.col("bucket").alias("up"), F.col("conv_id").alias("above"))
    roots = nodes.where("up is not null").select(*COLUMNS, "up").unionByName(tops.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COLUMNS, "up"))
    roots = roots.join(_few(named, named.count()), "up", "left").withColumn("parent_conv_id", F.col("above"))
    return nodes.where("up is null").select(COLUMNS).unionByName(roots.select(COLUMNS))


def conversation_trie(conversations: DataFrame, bucket_rows: int | None = None, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    A node is a distinct sequence of the first turns of a rebuilt conversation (``rebuilt``), the root
    the empty one. It is named by its smallest member and its depth. saved_tokens are the UTF-8 bytes
    of last texts that the members of a node and of those below it need not repeat.

    Null roles and texts are empty. Turns follow by number, null first; rows with one number by the
    md5 of role and text, and rows that repeat are turns of their own. Rows without a conv_id go.
    Long texts count whole, other columns stay out; an empty table has no node, not even a root.
    """
    return prefix_trie(checkpoint(rebuilt(checkpoint(encoded(conversations)))), bucket_rows, bucket_turns)


ORACLE_SQL = r"""
with recursive step(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
tab as (select list(c order by i) as z from step where k = 8),
r as (select conv_id, turn, strlen(coalesce(text, '')) as size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key
      from conversations where conv_id is not null),
o as (select conv_id, list(key order by turn nulls first, key) as keys, list(size order by turn nulls first, key) as sizes from r group by 1),
h as (select o.*, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
                   lambda a, b: xor(a >> 8, tab.z[(xor(a, b) & 255) + 1]))) % 9 as h from o, tab),
w as (select h.conv_id, list_concat(coalesce(b.keys[1:h], []), h.keys[h + 1:]) as keys, list_concat(coalesce(b.sizes[1:h], []), h.sizes[h + 1:]) as sizes
      from h left join o b on b.conv_id = h.conv_id - h.conv_id % 5),
p as (select conv_id, keys, sizes, unnest(range(0, len(keys) + 1)) as depth from w),
q as (select *, array_to_string(keys[1:depth], ',') as node, array_to_string(keys[1:depth - 1], ',') as above from p),
n as (select depth, node, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(any_value(sizes[depth]), 0) as own,
             any_value(keys[1:depth]) as keys, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(keys) = depth), '')) as ends
      from q group by depth, node),
c as (select depth - 1 as depth, above as node, count(*) as n_children from n where depth > 0 group by 1, 2),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (depth, node)),
s as (select depth, node, sum(own) as saved, sum(cast(n_children = 0 as bigint)) as leaves
      from (select own, n_children, keys, unnest(range(0, depth + 1)) as depth, array_to_string(keys[1:unnest(range(0, depth + 1))], ',') as node from m) group by 1, 2)
select m.conv_id, m.depth, t.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, m.ends as ends_sha256
from m join s using (depth, node) left join m t on t.depth = m.depth - 1 and t.node = m.above
"""
