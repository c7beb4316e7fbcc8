"""Subword vocabularies: corpus statistics, merges, encoding, decoding.

Heavy work (lexing, counting zones and pairs) is distributed. The corpus is counted once; merges
are learned from its distinct zones, of which a step reads those that it can change.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import markup
from ..functions.text import PRE_TOKEN, stripped, tokens
from ..sources.storage import checkpoint, checkpoint_folder, remove
from .sequences import neighbours

SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD, UNK, BOS, EOS = range(4)
_COMMAND = re.compile(r"\\[a-zA-Z]+")
PAIRS_AT_ONCE = 64  # best pairs that the driver sees at a time
PIECES_KEPT = 100_000  # encoded runs that a task remembers
CHARACTERS_AT_ONCE = 1 << 18  # characters of texts whose parts are Python values at the same time, beside one longer text
ROWS_AT_ONCE = 64  # rows of a batch that are Python values at the same time


@dataclass
class Vocabulary:
    tokens: list[str]
    merges: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.tokens)}

    def rows(self) -> list[tuple[str, int]]:
        return [(t, k) for k, t in enumerate(self.tokens)]


def base_tokens(commands: list[str], environments: list[str] = markup.ENVIRONMENTS) -> list[str]:
    """Fixed tokens in order: specials, commands, environments, symbols, printable ASCII and Greek."""
    characters = [chr(c) for c in range(32, 127)] + [chr(c) for r in ((0x391, 0x3AA), (0x3B1, 0x3CA)) for c in range(*r) if c != 0x3A2]
    return list(dict.fromkeys([*SPECIAL, *commands, *environments, *markup.SYMBOLS, *characters]))


def token_counts(typed: DataFrame) -> DataFrame:
    """token, ttype and n: one pass over the corpus for all that vocabularies need of single tokens."""
    return typed.groupBy("token", "ttype").agg(F.count("*").alias("n"))


def corpus_counts(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``token_counts`` and ``zone_counts`` of the texts, which are lexed once for both; the counts are checkpointed."""
    lexed = rows.select(markup.typed(F.col(text)).alias("_t"))
    token = F.transform("_t", lambda t: F.struct(t["token"].alias("token"), t["ttype"].alias("ttype"), F.lit(None).cast("string").alias("zone")))
    zone = F.transform(markup.zone_texts(F.col("_t")), lambda z: F.struct(F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("ttype"), z.alias("zone")))
    each = lexed.select(F.explode(F.concat(token, zone)).alias("x")).select("x.*")
    counted = checkpoint(each.groupBy("token", "ttype", "zone").agg(F.count("*").alias("n")))
    return counted.where("zone is null").drop("zone"), counted.where("zone is not null").select(F.split("zone", " ").alias("units"), F.col("n").alias("freq"))


def frequent_commands(counted: DataFrame, least: int = 2, most: int = 512) -> DataFrame:
    """token and n of the most frequent commands among counted tokens."""
    found = counted.where("ttype in ('COMMAND', 'ESCAPED', 'LINEBREAK')").groupBy("token").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most)


def number_slots(counted: DataFrame, merges: int, least: int = 2) -> DataFrame:
    """Numbers that get a token of their own: frequent ones, at most a quarter of the merges and 512."""
    found = counted.where("ttype = 'NUMBER'").select("token", "n")
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(min(512, merges // 4))


def zone_counts(zones: DataFrame) -> DataFrame:
    return zones.groupBy("units").agg(F.count("*").alias("freq"))


def pair_counts(counted: DataFrame) -> DataFrame:
    """a, b and n: neighbours, weighted by the frequency of their zones."""
    each = counted.select("freq", F.explode(neighbours(F.col("units"))).alias("p"))
    return each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("freq").alias("n"))


def _sure_merges(best: list, made: set[str], least: int) -> list[tuple[str, str]]:
    """How the first of the ranked pairs will be merged one after the other, as far as that is certain.

    A merge changes counts of pairs that share a unit with it only, and a pair that it brings about is no more frequent
    than one of those was. So pairs apart from each other keep their order as long as they are more frequent than the
    first pair in the ranking that is not apart. A pair of equal units brings about pairs as frequent as itself, and a
    joined unit that is there already gains: such a pair ends the list, or is merged alone.
    """
    sure, used, bound = [], set(), 0
    for row in best:
        apart = row.a != row.b and row.a not in used and row.b not in used and row.a + row.b not in made | used
        if row.n < least or not apart:
            bound = row.n
            break
        sure.append(row)
        used |= {row.a, row.b, row.a + row.b}
    else:
        bound = best[-1].n if len(best) == PAIRS_AT_ONCE else 0
    later = [(r.a, r.b) for r in sure[1:] if r.n > bound]
    return [(best[0].a, best[0].b), *later] if best and best[0].n >= least else []


def replay(units: list[str], ranks: dict[tuple[str, str], list[int]], since: int = 0) -> list[str]:
    """Units after all merges in their order, from number ``since`` on; ``ranks`` has the numbers of each pair, as a pair can be merged again."""
    units, at = list(units), since
    while len(units) > 1:
        later = [(found[k], pair) for pair in set(zip(units, units[1:], strict=False)) if (found := ranks.get(pair)) and (k := bisect_left(found, at)) < len(found)]
        if not later:
            break
        at, (a, b) = min(later)
        joined, k = [], 0
        while k < len(units):
            if k + 1 < len(units) and units[k] == a and units[k + 1] == b:
                joined.append(a + b)
                k += 2
            else:
                joined.append(units[k])
                k += 1
        units, at = joined, at + 1
    return units


def _changes(ranks: dict[tuple[str, str], list[int]], since: int, joints: set[tuple[str, str]]) -> Callable:
    """What the merges from number ``since`` on do to the counts of pairs, from the zones that the index names."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {p: early for p, r in ranks.items() if (early := [k for k in r if k < since])}
        for batch in batches:
            sums: Counter = Counter()
            for x, y, units, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A zone stands under each of its pairs; the first that is asked for speaks for it.
                if (x, y) != next(p for p in zip(units, units[1:], strict=False) if p in joints):
                    continue
                old = replay(units, before)
                new = replay(old, ranks, since)
                if len(new) < len(old):
                    for k, found in ((-freq, old), (freq, new)):
                        for pair in zip(found, found[1:], strict=False):
                            sums[pair] += k
            rows = [(*pair, n) for pair, n in sums.items() if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["a", "b", "n"])

    return changed


def learn_merges(counted: DataFrame, n: int, least: int = 2, least_zone: int = 2) -> list[tuple[str, str]]:
    """Merge rules in order; ties by code point. Rarer pairs and zones don't count. Units are single characters at first.

    Pairs are counted once; from then on a step changes counts by what its merges do to their zones. An
    inverted index, written to the checkpoint folder by hash of the pair, leads from each two neighbouring
    characters to the zones that have them. Two units can be neighbours only where the last character of one
    and the first of the other are, so the index never changes: a step reads the parts of the characters
    where its merges join, and replays earlier merges on these zones. The driver sees the best pairs, and settles
    all merges that are certain by then.
    """
    spark = counted.sparkSession
    folder = f"{checkpoint_folder(spark)}/merge-index-{uuid.uuid4().hex}"
    zones = counted.where((F.col("freq") >= least_zone) & (F.size("units") > 1)).select("units", "freq")
    each = zones.select(F.explode(F.array_distinct(neighbours(F.col("units")))).alias("p"), "units", "freq").select(F.col("p.a").alias("x"), F.col("p.b").alias("y"), "units", "freq")
    each.withColumn("part", _index_part(F.col("x"), F.col("y"))).repartition("part", F.pmod(F.xxhash64("units"), F.lit(8))).write.partitionBy("part").parquet(folder)
    index, merges, ranks = spark.read.schema("x string, y string, units array<string>, freq long, part int").parquet(folder), [], {}
    counts = checkpoint(pair_counts(zones))
    made: set[str] = set()
    try:
        while len(merges) < n:
            best = counts.where(F.col("n") > 0).orderBy(F.desc("n"), "a", "b").limit(PAIRS_AT_ONCE).collect()
            sure = _sure_merges(best, made, least)[: n - len(merges)]
            if not sure:
                break
            for k, pair in enumerate(sure, len(merges)):
                ranks.setdefault(pair, []).append(k)
            joints = {(a[-1], b[0]) for a, b in sure}
            asked = {zlib.crc32((x + y).encode()) % INDEX_PARTS for x, y in joints}
            among = F.struct("x", "y").isin([F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in sorted(joints)])
            touched = index.where(F.col("part").isin(sorted(asked)) & among).select("x", "y", "units", "freq")
            changes = touched.mapInArrow(_changes(ranks, len(merges), joints), "a string, b string, n long")
            counts = counts.unionByName(changes).groupBy("a", "b").agg(F.sum("n").alias("n"))
            counts = checkpoint(counts.where("n > 0"))
            merges += sure
            made |= {a + b for a, b in sure}
    finally:
        remove(spark, folder)
    return merges


INDEX_PARTS = 64


def _index_part(x: Column, y: Column) -> Column:
    return (F.crc32(F.concat(x, y).cast("binary")) % INDEX_PARTS).cast("int")


def apply_merges(units: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Units after merging the pair of lowest rank, leftmost first, until none has a rank."""
    units = list(units)
    while len(units) > 1:
        rank, at = min((ranks.get((a, b), len(ranks)), k) for k, (a, b) in enumerate(zip(units, units[1:], strict=False)))
        if rank == len(ranks):
            break
        units[at : at + 2] = [units[at] + units[at + 1]]
    return units


def extend(base: list[str], numbers: list[str], merges: list[tuple[str, str]], size: int) -> Vocabulary:
    """The fixed tokens, then numbers, then merged units, until the size is reached."""
    tokens = list(dict.fromkeys([*base, *numbers]))[:size]
    known = set(tokens)
    used = []
    for a, b in merges:
        if a + b not in known and len(tokens) >= size:
            continue
        used.append((a, b))
        if a + b not in known:
            known.add(a + b)
            tokens.append(a + b)
    return Vocabulary(tokens, used)


def _run_encoder(ids: dict[str, int], ranks: dict[tuple[str, str], int]) -> Callable[[tuple[str, ...]], list[int]]:
    """Ids of a run of units after its merges; runs seen before are remembered, ``PIECES_KEPT`` at most."""
    known: dict[tuple[str, ...], list[int]] = {}

    def found(run: tuple[str, ...]) -> list[int]:
        if run not in known:
            if len(known) >= PIECES_KEPT:
                known.clear()
            known[run] = [ids.get(u, UNK) for u in apply_merges(list(run), ranks)]
        return known[run]

    return found


def _stretches(columns: tuple[pa.Array, ...]) -> Iterator[list[list]]:
    """The columns of a batch as lists of Python values, ``ROWS_AT_ONCE`` rows at a time."""
    for at in range(0, len(columns[0]) or 1, ROWS_AT_ONCE):
        yield [c.slice(at, ROWS_AT_ONCE).to_pylist() for c in columns]


def encode(rows: DataFrame, key: str, text: str, vocabulary: Vocabulary, most: int | None = None, special: bool = True) -> DataFrame:
    """key and ids of each text. A cut at ``most`` may lose the end mark. Texts are lexed in place; nothing is exchanged."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.ids, {pair: k for k, pair in enumerate(vocabulary.merges)}))  # a vocabulary

    def encoded(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids, ranks = shared.value
        units = _run_encoder(ids, ranks)

        def one(tokens: list[str], frozen: list[bool], kinds: list[str]) -> list[int]:
            out, run = [BOS] * special, []
            for token, fixed, kind in zip(tokens, frozen, kinds, strict=True):
                if not fixed:
                    run.append(token)
                    continue
                out += units(tuple(run)) if run else []
                run = []
                out += [ids.get(c, UNK) for c in token] if kind == "NUMBER" and token not in ids else [ids.get(token, UNK)]
            out += units(tuple(run)) if run else []
            return (out + [EOS] * special)[:most]

        for batch in batches:
            for columns in _stretches(batch):
                yield pa.array([one(*(x or [] for x in row)) for row in zip(*columns, strict=True)], pa.list_(pa.int32()))

    lexed = rows.select(key, markup.typed(F.col(text)).alias("_t"))
    return lexed.select(key, F.arrow_udf(encoded, "array<int>")(F.col("_t.token"), F.col("_t.frozen"), F.col("_t.ttype")).alias("ids"))


def piece_counts(rows: DataFrame, text: str) -> DataFrame:
    """units (the characters) and freq of each distinct token of the texts, for merges inside tokens."""
    each = rows.select(F.explode(tokens(stripped(F.col(text)), PRE_TOKEN)).alias("t")).groupBy("t").agg(F.count("*").alias("freq"))
    return each.select(F.filter(F.split("t", ""), lambda c: c != "").alias("units"), "freq")


def piece_vocabulary(counted: DataFrame, size: int = 8192) -> Vocabulary:
    """Specials, printable ASCII, all other characters of the corpus by code point, then merges until the size is reached."""
    ascii_chars = [chr(c) for c in range(32, 127)]
    seen = [r.c for r in counted.select(F.explode("units").alias("c")).distinct().orderBy("c").limit(size).collect()]  # characters
    alphabet = list(dict.fromkeys([*SPECIAL, *ascii_chars, *seen]))
    return extend(alphabet, [], learn_merges(counted, size - len(alphabet), least_zone=1), size)


def encode_pieces(rows: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """key and ids of each text between start and end marks; merges stay inside tokens. Nothing is exchanged."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.ids, {pair: k for k, pair in enumerate(vocabulary.merges)}))  # a vocabulary

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        units = _run_encoder(*shared.value)
        for batch in batches:
            for (texts,) in _stretches((batch,)):
                found = ([i for t in x or [] for i in units(tuple(t))] for x in texts)
                yield pa.array([[BOS, *ids, EOS] for ids in found], pa.list_(pa.int32()))

    return rows.select(key, F.arrow_udf(encoded, "array<int>")(tokens(stripped(F.col(text)), PRE_TOKEN)).alias("ids"))


def decode(ids: Column, vocabulary: Vocabulary, skip_special: bool = True, unknown: str | None = None) -> Column:
    """Text of ids: pad and end never show, start only if asked; unknown ids drop out or show as ``unknown``."""
    tokens = F.array(*map(F.lit, vocabulary.tokens))
    skip = [PAD, EOS] + [BOS] * skip_special
    shown = F.transform(F.filter(ids, lambda i: ~i.isin(skip)), lambda i: F.coalesce(F.get(tokens, i), F.lit(unknown)))
    return F.array_join(shown, "")


def _trie(tokens: list[str], widest: int) -> dict:
    """Nested dictionaries by character; an empty string marks where a token ends."""
    root: dict = {}
    for token in tokens:
        if 0 < len(token) <= widest:
            node = root
            for c in token:
                node = node.setdefault(c, {})
            node[""] = True
    return root


def _walk(text: str, root: dict) -> list[str]:
    out, at = [], 0
    while at < len(text):
        node, end, best = root, at, at + 1
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                best = end
        out.append(text[at:best])
        at = best
    return out


def longest_match(text: Column, tokens: list[str], widest: int = 20) -> Column:
    """Greedy longest tokens from the left; a character that no token covers stands for itself. Null stays null.

    Texts walk a trie, built once a task: what a character costs does not grow with the vocabulary. A batch's parts
    leave it every ``CHARACTERS_AT_ONCE``, or after a longer text: Python never holds those of a whole batch.
    """

    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        root = _trie(tokens, widest)
        for batch in batches:
            out, size = [], 0
            for x in batch:
                text = x.as_py()
                out.append(None if text is None else _walk(text, root))
                size += len(text or "")
                if size >= CHARACTERS_AT_ONCE:
                    yield pa.array(out, pa.list_(pa.string()))
                    out, size = [], 0
            if out:
                yield pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(matched, "array<string>")(text)


def _spans(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Each command of a text with the parts that overlap it. Parts and text follow the same characters."""
    kind = pa.list_(pa.struct([("cmd", pa.string()), ("parts", pa.list_(pa.string()))]))
    for batch in texts:
        for columns in _stretches(batch):
            out = []
            for text, parts in zip(*columns, strict=True):
                found, ends = [], list(accumulate(map(len, parts or [])))
                for m in _COMMAND.finditer(text or ""):
                    first, last = bisect_right(ends, m.start()), bisect_left(ends, m.end())
                    found.append({"cmd": m[0], "parts": parts[first : last + 1]})
                out.append(found)
            yield pa.array(out, kind)


def command_fragments(rows: DataFrame, text: str, parts: str, most: int = 10) -> DataFrame:
    """cmd, n, intact and fragments: how often a tokenization keeps a command as one part, and into which parts it breaks it otherwise.

    Commands and parts are aligned by their places: a part belongs to a command if they overlap, so a part
    that holds the command and more does not keep it intact. ``fragments`` are the ``most`` most frequent
    breaks (parts joined by a space and a bar) with their counts, ties by code point.
    """
    each = rows.select(F.explode(F.arrow_udf(_spans, "array<struct<cmd string, parts array<string>>>")(F.col(text), F.col(parts))).alias("c"))
    whole = (F.size("c.parts") == 1) & (F.get("c.parts", F.lit(0)) == F.col("c.cmd"))
    counted = each.groupBy(F.col("c.cmd").alias("cmd"), F.when(~whole, F.array_join("c.parts", " |")).alias("broken")).agg(F.count("*").alias("k"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("cmd").orderBy(F.col("broken").isNull(), F.desc("k"), "broken")))
    top = F.array_sort(F.collect_list(F.when(F.col("broken").isNotNull() & (F.col("r") <= most), F.struct("r", "broken", "k"))))
    shown = F.transform(top, lambda x: F.concat(x["broken"], F.lit(": "), x["k"].cast("string")))
    kept = F.sum(F.when(F.col("broken").isNull(), F.col("k")).otherwise(0))
    return ranked.groupBy("cmd").agg(F.sum("k").alias("n"), (kept / F.sum("k")).alias("intact"), shown.alias("fragments"))


def compression(rows: DataFrame, text: str, ids: str) -> DataFrame:
    """Mean, sample deviation and median of characters a token, the rate of unknown tokens, and tokens a text."""
    size = F.size(ids)
    ratio = F.length(text) / F.greatest(size, F.lit(1))
    unknown = F.size(F.filter(ids, lambda i: i == UNK))
    return rows.agg(
        F.avg(ratio).alias("ratio_mean"), F.stddev_samp(ratio).alias("ratio_std"), F.percentile(ratio, F.lit(0.5)).alias("ratio_median"),
        (F.sum(unknown) / F.sum(size)).alias("unk_rate"), F.avg((unknown > 0).cast("int")).alias("unk_share"), F.avg(size).alias("tokens_per_text"),
    )


def intact_rates(rows: DataFrame, commands: str, parts: str) -> DataFrame:
    """cmd, n and intact: the share of a command's occurrences that a tokenization keeps as one part."""
    each = rows.select(F.explode(F.array_distinct(commands)).alias("cmd"), commands, parts)
    times = lambda items: F.size(F.filter(items, lambda x: x == F.col("cmd")))
    counted = each.select("cmd", times(commands).alias("n"), times(parts).alias("kept"))
    return counted.groupBy("cmd").agg(F.sum("n").alias("n"), (F.sum(F.least("n", "kept")) / F.sum("n")).alias("intact"))
