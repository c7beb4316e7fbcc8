"""Edge cases and properties that the tables don't show."""

import collections
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texweave.functions import image, markup, metrics
from texweave.functions import text as T
from texweave.operators import filters, profiles, sequences, subwords
from texweave.sources import readers, writers
from texweave.streaming import samples as streaming


def test_reasons_in_order(spark):
    rows = [("abcd", 1.0), ("abcde", 20.0), ("abcde", 20.01), ("{abcd", 30.0), ("{a", 1.0)]
    got = spark.createDataFrame(rows, "t string, a double").select(filters.drop_reason(F.col("t"), F.col("a")).alias("r"))
    assert [r.r for r in got.collect()] == ["short", None, "extreme_aspect", "unbal_brace", "short"]


def test_length_band(spark):
    rows = [(None,), ("  ",), ("ab",), ("abc",), ("x" * 400,), ("x" * 401,)]
    got = spark.createDataFrame(rows, "t string").select(filters.length_reason(F.col("t")).alias("r"))
    assert [r.r for r in got.collect()] == ["blank", "blank", "short", None, None, "long"]


def test_score_classes(spark):
    got = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,)], "s double").select(filters.score_class(F.col("s")).alias("c"))
    assert [r.c for r in got.collect()] == ["easy", "medium", "hard"]


def test_most_common_ties_by_first_appearance(spark):
    row = spark.createDataFrame([(["b", "a", "a", "c", "b"],)], "x array<string>").select(T.most_common(F.col("x"), 2).alias("m")).first()
    assert [tuple(m) for m in row.m] == [("b", 2), ("a", 2)]


def test_grades():
    counts = {"heavy": (154258, 1389527), "light": (297318, 1389527), "raw": (458761, 1428735), "screenshot": (4003, 253522)}
    assert [round(100 * a / b, 2) for a, b in counts.values()] == [11.10, 21.40, 32.11, 1.58]


def test_lexer_types(spark):
    text = r"\begin{align*} 3.14 \times 10^{-9} α \\ \begin{unknown} \%"
    rows = markup.token_rows(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("pos").collect()
    kinds = [(r.token, r.ttype) for r in rows if r.token != " "]
    assert kinds[:4] == [("\\begin", "COMMAND"), ("{", "LBRACE"), ("align*", "ENV_NAME"), ("}", "RBRACE")]
    assert ("3.14", "NUMBER") in kinds and ("α", "GREEK_LC") in kinds and ("\\\\", "LINEBREAK") in kinds and ("\\%", "ESCAPED") in kinds
    assert ("u", "LETTER") in kinds and ("unknown", "ENV_NAME") not in kinds


def test_merges_and_round_trip(spark):
    zones = spark.createDataFrame([(list("abab"), 5), (list("abc"), 3), (["x"], 9)], "units array<string>, freq long")
    merges = subwords.learn_merges(zones, 3)
    assert merges[:2] == [("a", "b"), ("ab", "ab")]
    assert subwords.apply_merges(list("ababc"), {m: k for k, m in enumerate(merges)}) == ["abab", "c"]
    texts = [(1, r"\frac{dy}{dt} + 3.14"), (2, r"x_i^2"), (3, "")]
    rows = spark.createDataFrame(texts, "k int, t string")
    vocabulary = subwords.extend(subwords.base_tokens(["\\frac"]), [], [("d", "y")], 2048)
    back = subwords.encode(rows, "k", "t", vocabulary).select("k", subwords.decode(F.col("ids"), vocabulary).alias("b")).collect()
    assert {r.k: r.b for r in back} == dict(texts)


def test_packing_edges(spark):
    rows = [("a", k, s) for k, s in enumerate([200, 250, 100, 100, 1, 0])]
    got = sequences.pack_greedy(spark.createDataFrame(rows, "g string, k int, s int"), "g", ["k"], "s").orderBy("k").collect()
    assert [(r.k, r.packed_size, r.bin) for r in got] == [(0, 200, 0), (1, 200, 1), (2, 100, 2), (3, 100, 2), (4, 1, 3)]


def test_dense_index_is_dense_for_any_partitioning(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("k"))
    got = filters.dense_index(rows, ["k"]).orderBy("k").collect()
    assert [r.idx for r in got] == list(range(1000))


def test_dense_index_of_wide_rows_once_written(spark, tmp_path):
    """Counts and rows see the same ranges, whatever columns each of them needs."""
    rows = spark.range(400_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 40).alias("wide"), F.col("id").alias("other"))
    filters.dense_index(rows.repartition(13), ["k"]).write.parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    found = back.agg(F.count_distinct("idx").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    assert tuple(found) == (400_000, 0, 399_999)
    assert back.join(back.select((F.col("idx") + 1).alias("idx"), F.col("k").alias("before")), "idx").where("before > k").count() == 0


def test_number_within_groups(spark):
    rows = [("a", k) for k in range(50)] + [(None, k) for k in range(7)] + [("b", 1)] * 3
    got = filters.number_within(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "i").collect()
    assert sorted((r.g or "", r.i, r.i_n) for r in got) == sorted([("a", k, 50) for k in range(50)] + [("", k, 7) for k in range(7)] + [("b", k, 3) for k in range(3)])
    assert all(r.i == r.v for r in got if r.g != "b")


def test_number_within_a_hot_group(spark):
    """Half of the rows are one group; rows and stretches meet by range and group, never by group alone, and sums run up with the numbers."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"), "id", (F.col("id") % 5).alias("v"))
    got = filters.number_within(rows.repartition(5), ["g"], ["id"], "i", {"below": "v"})
    assert "hashpartitioning(g#" not in got._jdf.queryExecution().toString()
    window = W.partitionBy("g").orderBy("id")
    want = rows.select("g", "id", (F.row_number().over(window) - 1).alias("i"), F.coalesce(F.sum("v").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    assert got.select("g", "id", "i", "below").exceptAll(want).count() == 0 and got.count() == 20_000


def fold(sizes, most):
    """Bins of one pass."""
    out, fill, bin_ = [], 0, 0
    for s in sizes:
        if fill + s > most:
            fill, bin_ = 0, bin_ + 1
        fill += s
        out.append(bin_)
    return out


@pytest.mark.parametrize("block_rows", [1, 4, 7, 1000])
def test_packing_is_one_pass_whatever_the_blocks(spark, block_rows):
    """Bins reach over blocks, and over several blocks."""
    draw = random.Random(block_rows)
    groups = {"a": [60] * 10, "b": [draw.randint(1, 200) for _ in range(60)], "c": [1] * 50, None: [draw.choice([1, 1, 1, 150, 200, 400]) for _ in range(60)]}
    rows = [(g, k, s) for g, sizes in groups.items() for k, s in enumerate(sizes)]
    got = sequences.pack_greedy(spark.createDataFrame(rows, "g string, k int, s int"), "g", ["k"], "s", 200, block_rows).collect()
    for g, sizes in groups.items():
        assert [r.bin for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == fold([min(s, 200) for s in sizes], 200)


def test_quantiles_interpolate(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8)] + [("b", 5.0), ("b", None)], "g string, v double")
    got = {r.g: (r.v_q25, r.v_q50) for r in profiles.quantiles(rows, ["g"], ["v"], {"q25": 0.25, "q50": 0.5}).collect()}
    assert got == {"a": (1.75, 3.0), "b": (5.0, 5.0)}


@pytest.mark.parametrize("few", [1, 40, 10_000])
def test_quantiles_by_refinement(spark, monkeypatch, few):
    """All columns and groups at once against numpy: ties, wide and narrow ranges, tiny differences, infinities, nulls and NaN."""
    monkeypatch.setattr(profiles, "CELLS", 8)
    monkeypatch.setattr(profiles, "FEW", few)
    rng, inf = np.random.default_rng(1), float("inf")
    columns = {
        "wide": np.exp(rng.normal(0, 40, 300)), "ties": rng.integers(0, 4, 300).astype(float), "near": 1 + np.arange(300) % 7 * 2.0**-52, "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 3.0], 300),
        "ends": np.concatenate([[-inf] * 80, rng.normal(0, 1, 140), [inf] * 80]), "one": np.full(300, 2.5),
    }
    rows = [("g" if k % 3 else None, *(float(v[k]) for v in columns.values()), None if k % 2 else float("nan") if k % 5 == 0 else float(k)) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, wide double, ties double, near double, huge double, ends double, one double, holes double")
    shares = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q97": 0.97, "q100": 1.0}
    got = {r.g: r for r in profiles.quantiles(frame, ["g"], frame.columns[1:], shares).collect()}
    for g in ("g", None):
        for at, c in enumerate(frame.columns[1:], 1):
            values = sorted(r[at] for r in rows if r[0] == g and r[at] is not None and r[at] == r[at])
            for name, share in shares.items():
                place = (len(values) - 1) * share
                low, high = values[int(place // 1)], values[int(-(-place // 1))]
                want = low if low == high else low + (high - low) * (place - place // 1)
                assert got[g][f"{c}_{name}"] == pytest.approx(want, rel=1e-15, nan_ok=True), (g, c, name)
    plan = profiles.quantiles(frame, ["g"], ["wide", "ties"], {"q50": 0.5})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_order_statistics_of_nothing(spark):
    empty = spark.createDataFrame([(None, None)], "g string, v double")
    assert profiles.nearest_rank(empty, "v", [0.5]).count() == 0 and profiles.quantiles(empty, [], ["v"], {"q": 0.5}).where("v_q is not null").count() == 0
    assert profiles.describe(empty, ["g"], ["v"]).first().v_count == 0


def test_lines_of_a_file_in_blocks(spark, tmp_path):
    """Numbers are those of a reader of the whole file, over many blocks, long lines, and all kinds of line ends."""
    texts = [f"{'x' * (k % 97)}{k}" if k % 11 else "" for k in range(3000)] + ["long " * 3000, "last"]
    with open(f"{tmp_path}/a.txt", "w", newline="") as f:
        f.write("".join(t + ("\r\n" if k % 5 == 0 else "\n") for k, t in enumerate(texts)))
    with open(f"{tmp_path}/a.txt") as f:
        want = [(k, t.rstrip("\n")) for k, t in enumerate(f)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        found = readers.lines(spark, f"{tmp_path}/a.txt")
        assert found.rdd.getNumPartitions() > 10 and sorted((r.line_no, r.line) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    open(f"{tmp_path}/none.txt", "w").close()
    assert readers.lines(spark, f"{tmp_path}/none.txt").count() == 0


def test_stages_resume(spark, tmp_path):
    """A stage runs again if its inputs, its version or a stage before it changed, and never else."""
    from texweave.sources import stages

    plan = lambda version: [("a", "1", lambda s, r: r.where("id > 1")), ("b", version, lambda s, r: r.where("id < 9")), ("c", "1", lambda s, r: r.withColumn("x", F.col("id") * 2))]
    run = lambda inputs, version: stages.resume(spark, spark.range(12), str(tmp_path), inputs, plan(version))
    out, ran = run("v1", "1")
    assert ran == ["a", "b", "c"] and out.count() == 7
    assert run("v1", "1")[1] == [] and run("v1", "2")[1] == ["b", "c"] and run("v2", "1")[1] == ["a", "b", "c"]
    last = next(d for d in sorted(os.listdir(tmp_path)) if d.startswith("02-c"))
    os.remove(f"{tmp_path}/{last}/_SUCCESS")
    assert sum(len(run(v, n)[1]) for v, n in (("v1", "1"), ("v1", "2"), ("v2", "1"))) == 1


def test_a_worker_loads_a_model_once(spark, tmp_path):
    from texweave.operators import inference

    def load():
        open(f"{tmp_path}/{os.getpid()}-{time.time_ns()}", "w").close()
        return lambda pictures: [str(len(pictures))] * len(pictures)

    good = bytearray(image.encode_png(np.zeros((2, 2), np.uint8)))
    rows = spark.createDataFrame([(k, good if k != 17 else None) for k in range(101)], "k int, i binary").repartition(9)
    said = {r.k: r.said for r in inference.batched(rows, ["k"], "i", load, 10).collect()}
    assert said == {k: None if k // 10 == 1 else "1" if k == 100 else "10" for k in range(101)}
    loads = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert len(loads) == len(set(loads))


def test_readers_and_writers_of_small_files(spark, tmp_path):
    """files, skip_corrupt, text_lines, report and latest."""
    rows = spark.createDataFrame([(k, f"x{k}") for k in range(1500)], "idx long, latex string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/p")
    with open(f"{tmp_path}/p/broken.parquet", "wb") as f:
        f.write(b"PAR1 no file")
    assert readers.samples(spark, f"{tmp_path}/p", ["idx"], skip_corrupt=True).count() == 1500
    writers.text_lines(rows.where("idx < 3"), ["idx", "latex"], f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["0\tx0", "1\tx1", "2\tx2"]
    text = writers.report(rows, "Title").split("\n")
    assert text[:2] == ["Title", "====="] and len(text) == 1503 and text[-1].split() == ["1,499", "x1499"]
    for k in (2, 10, 9):
        os.makedirs(f"{tmp_path}/run", exist_ok=True)
        with open(f"{tmp_path}/run/step-{k}.bin", "wb") as f:
            f.write(b"ab")
    found = readers.files(spark, f"{tmp_path}/run", "*.bin")
    assert sorted((r.stem, r.length) for r in found.select("stem", "length").collect()) == [("step-10", 2), ("step-2", 2), ("step-9", 2)]
    newest = sequences.latest(found, "stem", F.regexp_extract("stem", r"(\d+)$", 1).cast("int")).first()
    assert (newest.stem, newest.step) == ("step-10", 10)


def test_rounding_is_half_even_on_the_binary_value(spark):
    values = [0.125, 0.135, 2.675, 2.5, -0.5, 1e300, None, float("inf"), 1.005]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r.k: r.r for r in rows.select("k", T.rounded(F.col("v"), 2).alias("r")).collect()}
    assert got == {k: None if v is None else round(v, 2) for k, v in enumerate(values)} and got[2] == 2.67 and got[0] == 0.12


def test_row_counts_read_no_column(spark):
    counted = readers.row_counts(spark, "/root/testdata/sf0.001/documents.parquet")
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().toString() and counted.first().n == 200
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_longest_match_takes_no_longer_with_more_tokens():
    text = "the quick brown fox " * 2000
    took = []
    for tokens in (["the", "quick"], [f"{a}{b}{c}{d}" for a in "thequick" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdefgh"]):
        root, began = subwords._trie(tokens, 20), time.perf_counter()
        assert "".join(subwords._walk(text, root)) == text
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.1
    assert subwords._walk("aabab", subwords._trie(["a", "aab", "aa"], 20)) == ["aab", "a", "b"] and subwords._walk("", {}) == []


def test_numbered_files(spark, tmp_path, monkeypatch):
    """Names, rows and numbers of shards; rows that agree stay together; a stopped writer starts anew, a finished folder stays."""
    monkeypatch.setattr(writers, "BOUNDS_AT_ONCE", 3)
    rows = spark.range(100).repartition(7).select((F.col("id") % 90).alias("k"), F.lit("x").alias("_shard"), (F.col("id") * 2).alias("other"))
    path = f"{tmp_path}/a"
    os.makedirs(f"{path}/_writing")
    assert writers.numbered_shards(rows, path, ["k"], 10, "train") == 10
    assert sorted(f for f in os.listdir(path) if not f.startswith((".", "_"))) == [f"train-{k:05d}-of-00010.parquet" for k in range(10)]
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("f")).orderBy("idx").collect()
    assert [r.idx for r in back] == list(range(100)) and [r.k for r in back] == sorted(r.k for r in back) and {r._shard for r in back} == {"x"}
    assert all(len({r.f for r in back if r.k == k}) == 1 for k in range(90))
    assert writers.numbered_shards(rows.limit(1), path, ["k"], 10, "other") == 10
    assert writers.numbered_shards(rows.limit(0), f"{tmp_path}/none", ["k"], 10) == 1 and spark.read.parquet(f"{tmp_path}/none").count() == 0


def plain_merges(zones, n):
    """Merge after merge, counting anew each time."""
    merges, words = [], {z: k for z, k in zones.items() if k >= 2}
    for _ in range(n):
        pairs = collections.Counter()
        for z, k in words.items():
            for pair in zip(z, z[1:], strict=False):
                pairs[pair] += k
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        merges.append(best)
        merged = collections.Counter()
        for z, k in words.items():
            out, at = [], 0
            while at < len(z):
                step = 2 if z[at : at + 2] == best else 1
                out.append("".join(z[at : at + step]))
                at += step
            merged[tuple(out)] += k
        words = merged
    return merges


def test_merges_that_meet_or_tie(spark):
    draw = random.Random(1)
    for letters, widest in (("ab", 9), ("abcd", 6), ("abcdefghijkl", 5)):
        zones = collections.Counter(tuple(draw.choices(letters, k=draw.randint(1, widest))) for _ in range(60))
        rows = spark.createDataFrame([(list(z), k + 1) for z, k in zones.items()], "units array<string>, freq long").coalesce(1)
        assert subwords.learn_merges(rows, 15) == plain_merges({z: k + 1 for z, k in zones.items()}, 15)


def test_pieces(spark):
    texts = [(1, " \\alpha + \\alpha \\ab "), (2, "\\alpha 12"), (3, ""), (4, None), (5, "\u00e9")]
    rows = spark.createDataFrame(texts, "k int, t string")
    vocabulary = subwords.piece_vocabulary(subwords.piece_counts(rows, "t"))
    assert vocabulary.tokens[:5] == ["<pad>", "<unk>", "<bos>", "<eos>", " "] and vocabulary.tokens[99] == "\u00e9"
    got = {r.k: [vocabulary.tokens[i] for i in r.ids] for r in subwords.encode_pieces(rows, "k", "t", vocabulary).collect()}
    assert got[1] == ["<bos>", "\\alpha", "+", "\\alpha", "\\a", "b", "<eos>"]
    assert got[2] == ["<bos>", "\\alpha", "1", "2", "<eos>"] and got[3] == got[4] == ["<bos>", "<eos>"]


def test_merges_against_a_plain_trainer(spark):
    """Merges learned from the benchmark's words, and ids of its markup, as plain Python learns and finds them."""
    from texweave.plans import markup_queries, views

    DIR = "/root/testdata/sf0.001"
    want = plain_merges({tuple(r.units): r.freq for r in markup_queries._word_zones(spark, DIR).collect()}, 64)
    assert [(r.a, r.b) for r in markup_queries.bpe_merges(spark, DIR).orderBy("rank").collect()] == want
    rows, vocabulary = markup_queries._vocabulary(spark, DIR)
    ids, ranks = vocabulary.ids, {m: k for k, m in enumerate(vocabulary.merges)}
    tokens = collections.defaultdict(list)
    for r in markup.token_rows(rows, "idx", "latex").orderBy("idx", "pos").collect():
        tokens[r.idx].append(r)
    for r in subwords.encode(views.latex(spark, DIR), "idx", "latex", vocabulary).collect():
        out, run = [2], []
        for t in [*tokens[r.idx], None]:
            if t is not None and not t.frozen:
                run.append(t.token)
                continue
            out += [ids.get(u, 1) for u in subwords.apply_merges(run, ranks)] if run else []
            run = []
            if t is not None:
                out += [ids.get(c, 1) for c in t.token] if t.ttype == "NUMBER" and t.token not in ids else [ids.get(t.token, 1)]
        assert r.ids == [*out, 3]


def test_environment_names_between_spaces(spark):
    texts = [(1, r"\begin {align} x"), (2, r"\end{ pmatrix }"), (3, r"\begin{alignx}"), (4, r"\frac{align}")]
    got = {}
    for r in markup.token_rows(spark.createDataFrame(texts, "k int, t string"), "k", "t").where("ttype = 'ENV_NAME'").collect():
        got[r.k] = r.token
    assert got == {1: "align", 2: "pmatrix"}


def test_distance_over_many_distinct_tokens(spark):
    a = [f"t{k}" for k in range(60_000)]
    rows = spark.createDataFrame([(["x", *a[1:3]], a[:3]), (a[:1] + a[56_000:56_010], a[:1] + a[56_001:56_010])], "a array<string>, b array<string>")
    assert [r.d for r in rows.select(metrics.token_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 1]


def test_nearest_rank_is_not_interpolated(spark):
    rows = spark.createDataFrame([(v,) for v in [1, 2, 3, 4]], "v int")
    assert {r.name: r.value for r in profiles.nearest_rank(rows, "v", [0.5, 0.99]).collect()} == {"p50": 3, "p99": 4}


def test_token_distance(spark):
    rows = spark.createDataFrame([(["\\a", "b", "c"], ["b", "c", "d"]), ([], ["x"]), (["é"], ["e"]), ([], [])], "a array<string>, b array<string>")
    assert [r.d for r in rows.select(metrics.token_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 1, 1, 0]


def test_png_round_trip_and_failure(spark):
    import numpy as np

    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = image.encode_png(pixels)
    assert (image.decode_png(data)[:, :, 0] == pixels).all()
    assert image.decode_png(data[:20]) is None and image.decode_png(None) is None
    row = spark.createDataFrame([(bytearray(data),)], "i binary").select(*(c.alias(k) for k, c in image.png_header(F.col("i")).items())).first()
    assert (row.width, row.height, row.color_type, row.file_bytes) == (4, 3, 0, len(data))


def test_png_filters_undone():
    """Rows under all five filters, made by a plain encoder, come back."""
    import struct
    import zlib

    import numpy as np

    rng = np.random.default_rng(1)
    for n, color in ((1, 0), (3, 2), (4, 6)):
        pixels = rng.integers(0, 256, (10, 7, n)).astype(np.uint8)
        flat, body = pixels.reshape(10, -1).astype(int), b""
        for y, row in enumerate(flat):
            up = flat[y - 1] if y else np.zeros_like(row)
            left, corner = (np.concatenate([np.zeros(n, int), x[:-n]]) for x in (row, up))
            paeth = [min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2] for a, b, c in zip(left, up, corner, strict=True)]
            kind = y % 5
            body += bytes([kind]) + ((row - [0 * row, left, up, (left + up) // 2, np.array(paeth)][kind]) & 255).astype(np.uint8).tobytes()
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
        assert (image.decode_png(data) == pixels).all()


def test_batches_fail_as_a_whole(spark):
    import numpy as np
    import pytest

    from texweave.operators import inference

    good = bytearray(image.encode_png(np.zeros((2, 2), np.uint8)))
    rows = spark.createDataFrame([(k, None if k == 5 else good) for k in range(12)], "k int, i binary").coalesce(1)
    said = rows.select("k", inference.predicted(lambda pictures: ["x"] * len(pictures), 4)("i").alias("s")).collect()
    assert [r.k for r in said if r.s is None] == [4, 5, 6, 7]
    assert set(inference.inputs(F.col("i"))) == {"image"} and set(inference.inputs(text=F.col("t"))) == {"tokens"}
    with pytest.raises(ValueError):
        inference.inputs()


def test_line_files_and_annotations(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("1\n2\n3\n")
    paired = readers.paired_lines(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", strict=False).orderBy("line_no").collect()
    assert [(r.left, r.right) for r in paired] == [("one", "1"), ("two", "2")]
    xml = ['<annotation type="truth"><math>x</math></annotation><annotation type="truth">$a &lt; b$</annotation>', "<ink/>"]
    got = spark.createDataFrame([(x,) for x in xml], "x string").select(readers.truth_annotation(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["a < b", None]


def test_shards_subsets_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"x{k:03d}", "s") for k in range(10)], "id int, latex string, source string")
    assert writers.numbered_shards(rows, f"{tmp_path}/train/raw", ["id"], 4) == 3
    back = readers.subsets(spark, f"{tmp_path}/train", ["raw", "absent"])
    assert back.count() == 10 and set(back.columns) >= {"idx", "image", "latex", "source", "file", "subset"}
    assert readers.resolve(spark, str(tmp_path), "train/raw", "raw").endswith("train/raw")
    stream = streaming.running_counts(streaming.sample_stream(spark, f"{tmp_path}/train/raw", rows.schema), "latex", "source")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 10
