"""Mixing sources to target weights, in DataFrame operations only.

The words of each source lie end to end in a fixed order and are cut into blocks of
``BLOCK_WORDS``. The mix is a row of slots, one block each, cut into output shards. Each
slot draws a source by a keyed hash, which makes the counts of a shard multinomial; what
the draws of all shards give a source beyond its quota of slots goes to sources below
theirs, so that the totals meet the quotas. Slot j of a source with n blocks takes block
P(j mod n), P being a keyed swap-or-not permutation of 0..n-1, and meets it by a join on
the index. No document is taken more often than its source is passed over, 3 times at most.

The driver collects one row for each source and nothing else: a source is something that
somebody gave a weight, and ``MOST_SOURCES`` bounds their number. Spark's size estimates do
not see that explode makes rows, so it would broadcast slots and pieces, which grow with the
corpus, through the driver: joins on them broadcast the sources or are hinted to merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, checkpoint, own, sums_before, unused, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 1024
BUCKET_ROWS = 512  # documents whose places are summed in one window, about
MOST_SOURCES = 100_000
SLOTS_PER_TASK = 16_384
_ROUNDS = 24
_UNIT = float(1 << 53)


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    quota: int


def targets(sizes: list[int], weights: list[float], passes: float = MOST_PASSES) -> list[float]:
    """Shares of the summed sizes by weight; no target passes ``passes`` times its size, the excess is shared anew."""
    left, weight, out = float(sum(sizes)), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: passes * sizes[k] / weights[k])
    for k in order:  # those that fill up first come first
        out[k] = min(float(passes * sizes[k]), left * weights[k] / weight)
        left, weight = left - out[k], weight - weights[k]
    return out


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> list[Source]:
    """The sources of ``sizes`` (source, size) by code point, null last, with targets and quotas of slots."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: weights are meant for sources that are few and known")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    given = [weights[k % len(weights)] for k in range(len(found))]
    aims = targets([r.size for r in found], given)
    out = []
    for k, (r, aim) in enumerate(zip(found, aims, strict=True)):
        blocks = -(-r.size // block_words)
        quota = min(MOST_PASSES * blocks, round(aim * blocks / r.size)) if r.size else 0
        out.append(Source(k, r.source, r.size, aim, blocks, quota))
    return out


def _table(df: DataFrame, sources: list[Source]) -> DataFrame:
    rows = [(s.number, s.name, s.size, s.target, s.blocks, s.quota) for s in sources]
    schema = "s int, source string, source_size long, target double, blocks long, quota long"
    return df.sparkSession.createDataFrame(rows, schema)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where a keyed permutation of 0..n-1 sends x: swap-or-not, for any n."""

    def swap(at: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, turn), n) - at, n)
        return F.when(F.xxhash64(key, turn, F.greatest(at, other)) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x, swap)


def pieces(sizes: DataFrame, sources: list[Source], block_words: int = BLOCK_WORDS) -> DataFrame:
    """s, block, _row, from and words: what each block has of each document of ``sizes`` (s, size, _row).

    Places are summed in buckets of documents and across the buckets of a source, so that no
    source has to pass through one task.
    """
    total = sum(s.size > 0 for s in sources) and sizes.count()
    buckets = max(16, -(-total // BUCKET_ROWS) if total else 16)
    rows = sizes.where("size > 0").withColumn("_bucket", F.pmod(F.col("_row._key"), F.lit(buckets)))
    per = rows.groupBy("s", "_bucket").agg(F.sum("size").alias("_in"))
    per = sums_before(per, ["s"], "_bucket", "_in", "_base", buckets).drop("_in")
    inside = W.partitionBy("s", "_bucket").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per, ["s", "_bucket"])
    placed = placed.withColumn("_start", F.col("_start") + F.col("_base")).withColumn("_end", F.col("_start") + F.col("size"))
    size = F.lit(block_words)
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest("_start", F.col("block") * size), F.least("_end", (F.col("block") + 1) * size)
    return cut.select("s", "block", "_row", (low - F.col("_start")).alias("from"), (high - low).alias("words"))


def slots(df: DataFrame, sources: list[Source], seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, s, j (the source's own number of the slot) and block for every slot of the mix."""
    spark, use = df.sparkSession, [s for s in sources if s.quota]
    count, weight = sum(s.quota for s in use), sum(s.target for s in use)
    empty = spark.createDataFrame([], "shard long, s int, j long, block long")
    if not count:
        return empty
    edges, upto = [], 0.0
    for s in use[:-1]:
        upto += s.target / weight
        edges.append(upto)
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(_UNIT)
    # The sources' cumulative shares are cut points of the unit range; the draw falls between two of them.
    picked = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= draw)) if edges else F.lit(0)
    picked = F.element_at(F.array(*(F.lit(s.number) for s in use)), picked + 1)
    drawn = spark.range(count).select(F.floor(F.col("id") / shard_slots).alias("shard"), picked.alias("s"))
    drawn = checkpoint(drawn.groupBy("shard", "s").agg(F.count("*").alias("n")))
    shards = -(-count // shard_slots)
    drawn = sums_before(drawn, ["s"], "shard", "n", "c", shards)
    known = F.broadcast(_table(df, sources).select("s", "blocks", "quota"))  # MOST_SOURCES rows at most
    drawn = drawn.join(known, "s").withColumn("kept", F.least(F.col("c") + F.col("n"), "quota") - F.least("c", "quota"))
    drawn = checkpoint(drawn)
    kept = drawn.where("kept > 0").select("shard", "s", F.col("c").alias("first"), F.col("kept").alias("n"))
    # Draws beyond a quota, shard after shard, fill what other sources lack, source after source.
    over = drawn.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("u")).where("u > 0")
    over = sums_before(over, [], "shard", "u", "a", shards)
    total = {r.s: r.n for r in drawn.groupBy("s").agg(F.sum("kept").alias("n")).collect()}  # one row a source
    lacking, at = [], 0
    for s in use:
        if (lack := s.quota - total.get(s.number, 0)) > 0:
            lacking.append(F.struct(F.lit(s.number).alias("s"), F.lit(at).cast("long").alias("x"), F.lit(lack).cast("long").alias("d"), F.lit(s.quota - lack).cast("long").alias("t")))
            at += lack
    if lacking:
        fill = over.withColumn("to", F.explode(F.array(*lacking)))
        low = F.greatest(F.col("a"), F.col("to.x"))
        high = F.least(F.col("a") + F.col("u"), F.col("to.x") + F.col("to.d"))
        fill = fill.where(high > low).select("shard", F.col("to.s").alias("s"), (F.col("to.t") + low - F.col("to.x")).alias("first"), (high - low).alias("n"))
        kept = kept.union(fill)
    # Few short rows become many: without a number of partitions they would meet in a few tasks.
    kept = kept.repartition(max(1, -(-count // SLOTS_PER_TASK)), "shard", "s")
    each = kept.withColumn("j", F.explode(F.expr("sequence(first, first + n - 1)"))).join(known, "s")
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.xxhash64("s", F.lit(seed)))
    return each.select("shard", "s", "j", block.alias("block"))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """What the mix needs of every row: its size and a place in the order of its source. Only equal rows are told apart by _id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    hashed = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash"))
    key = F.xxhash64("doc_id", "_hash", F.lit(seed))
    return checkpoint(hashed.select("*", key.alias("_key"), F.monotonically_increasing_id().alias("_id")))


def _taken(rows: DataFrame, seed: int, block_words: int) -> DataFrame:
    """``rows`` with source_size, target and taken."""
    sources = plan(rows, block_words=block_words)
    known = _table(rows, sources).select("s", F.col("source").alias("_source"), "source_size", "target")
    numbered = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))  # MOST_SOURCES rows at most
    row = F.struct("_key", "doc_id", "_hash", "_id")
    cut = pieces(numbered.select("s", "size", row.alias("_row")), sources, block_words)
    times = slots(rows, sources, seed).groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = cut.join(times.hint("merge"), ["s", "block"]).groupBy(F.col("_row._id").alias("_id")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = numbered.join(taken, "_id", "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mix_counts(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row of ``docs``.

    Null and empty texts have size 0 and give nothing; a source without words has target 0. A
    null source is a source, the last. Rows that repeat are documents of their own. An empty
    table gives an empty result. The same rows give the same result on every run.
    """
    out = _taken(_rows(docs, seed), seed, block_words)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_blocks(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: shard, slot (within its shard, from 0), source, n_words and text of every block taken, repeats included.

    Null texts and texts without words give nothing, a null source is a source, rows that repeat
    are documents of their own, other columns of ``docs`` stay out, and an empty table gives none.
    """
    rows = _rows(docs, seed)
    sources = plan(rows, block_words=block_words)
    known = F.broadcast(_table(rows, sources).select("s", F.col("source").alias("_source")))  # MOST_SOURCES rows at most
    numbered = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
    cut = pieces(numbered.select("s", "size", F.struct("_key", "doc_id", "_hash", "_id").alias("_row")), sources, block_words)
    held = cut.groupBy("_row").agg(F.collect_list(F.struct("s", "block", "from", "words")).alias("pieces"))  # of one document, as many as its blocks
    held = held.select("_row", "pieces", F.col("_row.doc_id").alias("_doc"), F.col("_row._hash").alias("_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.col("text").cast("string").alias("_text"))
    texts = texts.dropDuplicates(["_doc", "_hash"])
    same = (held["_hash"] == texts["_hash"]) & held["_doc"].eqNullSafe(texts["_doc"])

    def cut_up(words: Column) -> Column:
        piece = lambda p: F.array_join(F.slice(words, p["from"].cast("int") + 1, p["words"].cast("int")), " ")
        return F.transform("pieces", lambda p: F.struct(p["s"].alias("s"), p["block"].alias("block"), piece(p).alias("text"), p["words"].alias("words")))

    once = F.transform(F.array(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))), cut_up)[0]  # a text's words are found once
    parts = held.hint("merge").join(texts, same).select("_row", F.explode(once).alias("x")).select("x.s", "x.block", F.struct("_row", "x.text", "x.words").alias("part"))
    blocks = parts.groupBy("s", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # BLOCK_WORDS words at most
    taken = slots(rows, sources, seed).hint("merge").join(blocks, ["s", "block"])
    taken = taken.join(F.broadcast(_table(rows, sources).select("s", "source")), "s")
    order = W.partitionBy("shard").orderBy(F.xxhash64("s", "j", F.lit(seed)), "s", "j")
    text = F.array_join("parts.text", " ").alias("text")
    n = F.aggregate("parts.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("n_words")
    return taken.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", n, text)


def mixed_documents(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the mix takes its words, to a whole number by a keyed draw.

    A row taken 1.3 times comes twice with probability 0.3, else once, so that sources keep their
    targets whatever the length of their documents. All columns pass unchanged, whatever their
    names. Rows that the mix leaves out go, and so do null texts and texts without words, of which
    it takes none. Rows equal in doc_id, source and text share one number of times. A null source
    is a source. An empty table gives an empty result.
    """
    key = ["doc_id", "source", "_hash"]
    counts = _taken(_rows(docs, seed), seed, block_words).where("size > 0")
    counts = counts.groupBy(*key).agg((F.sum("taken") / F.sum("size")).alias("times"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "_hash", F.lit(seed), F.lit("whole")), 11) / F.lit(_UNIT)
    times = F.least(F.floor(F.col("times") + draw), F.lit(MOST_PASSES)).cast("int")
    tag = unused(docs, "_mix")
    counts = counts.select(*(F.col(c).alias(f"{tag}_{c}") for c in key), times.alias(f"{tag}_times")).where(F.col(f"{tag}_times") > 0)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{tag}_doc_id")) & F.col("source").cast("string").eqNullSafe(F.col(f"{tag}_source"))
    same &= F.xxhash64(F.col("text").cast("string")) == F.col(f"{tag}__hash")
    out = docs.join(counts, same).withColumn(f"{tag}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{tag}_times"))))
    return out.select(own(out)[: len(docs.columns)])
