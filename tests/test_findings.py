"""Queries on rows that the tables don't show, against their SQL."""

import duckdb
import numpy as np
import pytest

from test_queries import plain
from texweave.plans.registry import ORACLES, QUERIES


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert mine == sorted(tuple(map(plain, r)) for r in found.fetchall())


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    """Lopsided, constant, overlong, short, empty and null vectors, and some with null or non-finite components."""
    vectors = [[x] * 64 for x in (-1.0, -0.5, 0.0, 0.5, 1.0)] + [[100.0, -100.0] * 32, [float("nan")] * 64, [float("inf"), None] * 32, [0.1] * 70, [0.1], [], None]
    vectors += [(np.random.default_rng(k).random(64) - 0.8).tolist() for k in range(3)]
    folder = tmp_path_factory.mktemp("odd")
    rows = [(4 * k + kind, v) for k, v in enumerate(vectors) for kind in range(4)] + [(-5, [0.2] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_batch_failures_on_odd_vectors(spark, odd_vectors):
    same_as_sql(spark, "batch_failures", odd_vectors, ["embeddings"])


def test_batch_scores_on_odd_vectors(spark, odd_vectors):
    same_as_sql(spark, "batch_scores", odd_vectors, ["embeddings"])


def test_tokens_and_zones_are_counted_at_once(spark):
    from texweave.functions import markup
    from texweave.operators import subwords

    texts = [r"\\begin{pmatrix} ab & \alpha αβΓ\\ c", r"\begin { pmatrix } xy \end{pmatrix}", "a b  c\nd\x00e", "x", "", None, "12.5 . 3", "😀é x1y", " ab ", r"\x \frac{ab}{ab}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "idx int, latex string")
    tokens, zones = subwords.corpus_counts(rows, "latex")
    kept = lambda df, *cols: sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert kept(tokens, "token", "ttype", "n") == kept(subwords.token_counts(markup.token_rows(rows, "idx", "latex")), "token", "ttype", "n")
    assert kept(zones, "units", "freq") == kept(subwords.zone_counts(markup.zones(rows, "idx", "latex")), "units", "freq")


@pytest.mark.parametrize("name", ["encode_ids", "decode_roundtrip", "piece_ids", "lexer_tokens", "longest_match"])
def test_one_small_file_is_work_for_all_cores(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parts_leave_a_batch_in_small_arrays(spark, monkeypatch):
    import pyarrow as pa

    from pyspark.sql import functions as F

    from texweave.operators import subwords

    made = []
    with monkeypatch.context() as m:
        m.setattr(F, "arrow_udf", lambda f, _: lambda *columns: made.append(f))
        subwords.longest_match(F.col("t"), ["ab", "abc"])
    texts = ["abcab" * 20_000, None, "", *["xabc"] * 200_000]
    arrays = list(made[0](iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(sum(len(p) for p in x if p is not None) for x in (a.to_pylist() for a in arrays)) <= 2 * subwords.CHARACTERS_AT_ONCE
    got = [x for a in arrays for x in a.to_pylist()]
    assert len(got) == len(texts) and got[:4] == [["abc", "ab"] * 20_000, None, [], ["x", "abc"]] and len(arrays) > 3
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:1000])], "k int, t string").coalesce(1)
    back = rows.select("k", "t", subwords.longest_match(F.col("t"), ["ab", "abc"]).alias("p"))
    assert back.where(~F.array_join("p", "").eqNullSafe(F.col("t"))).count() == 0 and back.count() == 1000


def test_a_large_key_is_written_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from texweave.sources import writers

    rows = spark.range(0, 40_000, 1, 8).select("id", (F.col("id") % 2).alias("part"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "512k")
        writers.by_shard(rows, f"{tmp_path}/out", ["part"])
    finally:
        spark.conf.set(name, before)
    files = spark.read.parquet(f"{tmp_path}/out").groupBy("part", F.col("_metadata.file_name")).count().groupBy("part").agg(F.count("*").alias("files"), F.sum("count").alias("n")).collect()
    assert len(files) == 2 and all(1 < r.files <= 8 and r.n == 20_000 for r in files)


def plain_edits(a, b):
    """The table of distances, a cell at a time."""
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        before, row = row, [k]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bits", [1, 2, 7, 4096])
def test_edits_against_the_plain_table(monkeypatch, bits):
    import random

    from texweave.functions import metrics

    monkeypatch.setattr(metrics, "BITS", bits)
    draw = random.Random(bits)
    lists = lambda: draw.choices(["a", "b", "\\alpha", "é", "😀", None], k=draw.randrange(24))
    for a, b in [([], []), (["a"], []), (["a"] * 9, ["a"] * 9), *((lists(), lists()) for _ in range(400))]:
        assert metrics.edits(a, b) == metrics.edits(b, a) == plain_edits(a, b)
    if bits == 4096:
        far = [str(k) for k in range(6000)]
        assert metrics.edits(far, far[1:]) == 1 and metrics.edits(far, ["x", *far[:5000], "y", *far[5000:]]) == 2


def test_token_distances_of_odd_rows_without_a_step_for_each_pair_of_characters(spark):
    from pyspark.sql import functions as F

    from texweave.functions import metrics
    from texweave.operators import evaluation

    pairs = [(None, ["a"]), (["a"], None), (None, None), ([], []), ([], ["x", "y"]), ([None, "a"], [None, "a"]), ([None], ["a"]), (["😀", "\\frac", "b"], ["\\frac", "b", "c"])]
    pairs = [*pairs, *pairs, (["a", "b"] * 3000, ["b", "a"] * 2999)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    found = rows.select("k", metrics.token_edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in found.orderBy("k").collect()] == [None, None, None, 0, 2, 0, 1, 2] * 2 + [2]
    scores = evaluation.match_scores(rows, "a", "b")
    got = scores.first()
    assert (got.n, got.exact) == (17, 4 / 11) and abs(got.edit - (2 * (0 + 1 + 0 + 1 + 2 / 3) + 2 / 6000) / 11) < 1e-12
    for df in (found, scores):
        assert "levenshtein" not in df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_a_batch_are_python_values_a_pair_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from texweave.functions import metrics

    a, b = ["\\alpha", "é", None, "x"] * 50, ["é", "\\beta", None] * 50
    lists = [pa.array([[], *[x] * 1000, None, [], ["x"]], pa.list_(pa.string())) for x in (a, b)]
    sliced = [x.slice(1) for x in lists]
    tracemalloc.start()
    try:
        (got,) = metrics._token_edits.func(iter([tuple(sliced)]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [plain_edits(a, b)] * 1000 + [None, 0, 0] and got.type == pa.int32()
    assert peak < 2_000_000


@pytest.mark.parametrize("name", ["number_freq", "lexer_tokens", "token_type_counts"])
def test_texts_are_lexed_once_and_only_where_they_are_spread(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lexing = [k for k, line in enumerate(plan) if "regexp_extract_all" in line]
    (spreading,) = [k for k, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert len(lexing) == 1 and lexing[0] < spreading  # a plan is written from its result down


def test_token_rows_of_odd_rows(spark):
    from texweave.functions import markup

    rows = spark.createDataFrame([(1, "a 1"), (1, "a 1"), (None, "2"), (2, None), (3, ""), (4, " \n")], "k int, t string")
    found = markup.token_rows(rows, "k", "t")
    assert found.columns == ["k", "pos", "token", "ttype", "frozen"]
    one = [(1, 0, "a", "LETTER", False), (1, 1, " ", "SPACE", True), (1, 2, "1", "NUMBER", True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([*one, *one, (None, 0, "2", "NUMBER", True), (4, 0, " ", "SPACE", True)], key=repr)
