"""Operators 11 to 13 against SQL and brute force on odd rows, in small buckets and blocks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from texweave.llm import divergence, neighbours, trie


def by_sql(view, frame, sql):
    con = duckdb.connect()
    con.register(view, frame.toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, sorted(str(r) for r in found.fetchall())


def same(got, names, want):
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == want


@pytest.fixture(scope="module")
def talks(spark):
    """Copies, shared beginnings, ties, repeats, nulls, a long conversation, negative ids, and columns with the operator's own names."""
    rows = [(5 * k, t, "user", f"turn {t}") for k in range(40) for t in range(k % 7)]  # many copies, each a prefix of others
    rows += [(5 * k + 1, t, "assistant" if t % 2 else "user", f"w{(k * t) % 3}") for k in range(30) for t in range(5)]
    rows += [(7, None, "user", "none"), (7, 0, None, None), (7, 0, "a", "tie"), (7, 0, "b", "tie"), (7, 0, "b", "tie"), (None, 1, "user", "lost"), (-3, 1, "ü", "日本" * 3)]
    rows += [(1000, t, "user", "same") for t in range(12)] + [(1005, t, "user", "same") for t in range(10)] + [(1002, 9, "late", "only")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "bucket", "up", "size", "n", "base", "ids")})


@pytest.mark.parametrize("bucket_rows,bucket_turns", [(None, 10**6), (5, 3)])
def test_trie(spark, talks, monkeypatch, bucket_rows, bucket_turns):
    monkeypatch.setattr(trie, "LEAST_BUCKET", 3)
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    monkeypatch.setattr(trie, "NODES_OUT", 50)
    got = trie.conversation_trie(talks, bucket_rows, bucket_turns)
    same(got, *by_sql("conversations", talks, trie.ORACLE_SQL))
    assert got.columns == trie.COLUMNS


def test_trie_by_hand(spark):
    rows = [(0, 0, "u", "a"), (0, 1, "u", "bé"), (5, 0, "u", "a"), (5, 1, "u", "bé"), (10, 0, "u", "a")]
    nodes = {(r.conv_id, r.depth): r for r in trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(nodes) == {(0, 0), (0, 1), (0, 2)}
    assert [nodes[0, d].n_convs for d in range(3)] == [3, 3, 2] and [nodes[0, d].n_children for d in range(3)] == [1, 1, 0]
    assert [nodes[0, d].saved_tokens for d in range(3)] == [2 * 1 + 1 * 3, 2 * 1 + 1 * 3, 3] and nodes[0, 0].parent_conv_id is None


def test_empty_tables(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert divergence.divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
    assert neighbours.near_duplicate_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_divergence_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH_WORDS", 40)
    texts = ["The cat SAT on the mat", "the Cat, the dog; the ünïcode ÜNÏ", None, "", "1234 __ !!", "x " * 3000, "zu zu ZU Zu"]
    rows = [(k, texts[k % 7], [None, "", "en", "de", "en"][k % 5], [None, "a", "b", "ä", "a", "c"][k % 6]) for k in range(90)] + [(3, texts[0], "en", "a")] * 3
    rows += [(99, "lonely language", "xx", "a"), (None, "more lonely words", "yy", None), (100, None, "yy", "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "docs", "p", "q", "value")})
    got = divergence.divergence(docs)
    names, want = by_sql("documents", docs, divergence.ORACLE_SQL)
    same(got, names, want)
    assert got.where("lang = 'yy'").count() == 2 and got.where("lang = 'yy' and value != 0").count() == 0 and got.where("lang = 'xx'").count() == 0


def test_divergence_of_large_counts(spark):
    """Shares are exact where 10^9 times the count leaves the range of a long."""
    n, total, kept = 10**13, 3 * 10**13, 7
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + (10**9 * (n + 1)) // (total + kept)


def brute(ids, vectors, cosine=0.9):
    """n_links, component and kept by comparing all."""
    n, valid = len(ids), [v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for v in vectors]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None for v, ok in zip(vectors, valid, strict=True)]
    near = [[j for j in range(n) if j != i and valid[i] and valid[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    least = {r: min((ids[i] for i in range(n) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    return sorted(str((ids[i], len(near[i]), least[root[i]], ids[i] is not None and ids[i] == least[root[i]])) for i in range(n))


def planted(rng, n=600, dim=16, copies=(2, 3, 40, 120), spread=0.08):
    """Loose vectors, groups of near copies, and chains of pairs just above and below the threshold."""
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    found = list(base)
    for size in copies:
        found += [base[size] + spread * rng.standard_normal(dim) / np.sqrt(dim) * 4 for _ in range(size)]
    for k in range(60):
        other = rng.standard_normal(dim)
        other -= (other @ base[k]) * base[k]
        other /= np.linalg.norm(other)
        c = rng.uniform(0.88, 0.95)
        found.append(c * base[k] + np.sqrt(1 - c * c) * other)
    return np.array(found, np.float32)


@pytest.mark.parametrize("spread", [0.02, 0.08, 0.13])
def test_neighbours_against_brute_force(spark, monkeypatch, spread):
    """Balls that are linked for certain, balls whose members have to be compared, lists that saturate."""
    for name, small in (("BLOCK", 64), ("BALL_BLOCK", 64), ("NEAREST", 4), ("TILE_ROWS", 7)):
        monkeypatch.setattr(neighbours, name, small)
    vectors = planted(np.random.default_rng(3), spread=spread)
    rows = [(int(k) * 3 % 2503, v.tolist()) for k, v in enumerate(vectors)]
    got = {r.vec_id: r for r in neighbours.near_duplicate_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    links = np.array([got[i].n_links for i, _ in rows])
    assert len(got) == len(rows) and (links <= true).all()  # none below the threshold
    assert links.sum() >= 0.97 * true.sum()


def test_neighbours_of_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -1.0, 0.5, 2.0]
    rows = [(1, a), (2, a), (2, a), (3, b), (4, [x * 1e-30 for x in b]), (5, None), (6, []), (7, [0.0] * 4), (8, [1.0, None, 2.0, 3.0]), (9, [float("nan")] * 4)]
    rows += [(10, [float("inf"), 0.0, 0.0, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.0, 0.0]), (None, b), (None, [9.0, -9.0, 1.0, 0.0]), (13, [x * 1e30 for x in a])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("nid", "bid", "into", "unit", "label", "low")})
    got = sorted(str(tuple(r)) for r in neighbours.near_duplicate_embeddings(vectors).collect())
    assert got == brute([r[0] for r in rows], [r[1] for r in rows])


def test_neighbours_all_alike(spark):
    """A table that is one group of copies needs no pairs."""
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(8) + 0.02 * rng.standard_normal(8)).tolist()) for k in range(3000)]
    got = neighbours.near_duplicate_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)} and sum(r.kept for r in got) == 1
