"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows: in how many toxic and other texts each word and each stem
(prefix of 4 to 7 bytes, for languages that inflect) occurs, hashed into a fixed
number of bins, give log-odds under a Dirichlet prior that holds no association. Log-odds shrink by their standard error or a least effect, a word takes the strongest of its
forms, and every word pays a small toll, so that a clean text drifts downwards. A linear scan finds
all maximal segments; extreme-value statistics (lambda from the score distribution, K from
clean calibration texts) turn a segment's score into an expected number of chance hits, and
a logistic curve fitted on calibration texts turns the document's hits into a probability.

The model is at most ``BINS`` scores and six numbers, whatever the corpus size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, fold_of, map_batches, utf8

BINS = 1 << 20
SAMPLE_ROWS = 50_000  # labelled rows that the fit takes at most, those with the smallest hash of doc_id
PRIOR_TEXTS = 1.0  # strength of the Dirichlet prior, in texts that have the word
CAUTION = 2.5  # standard errors by which log-odds shrink towards none
EFFECT = 1.0  # log-odds that count as none however sure: frequent words differ a little between any two sets of texts
TOLL = 0.05  # what each word costs a segment at least
SIGNIFICANT = 0.05  # expected chance hits in the text below which a passage counts
_FOLDS_COUNT, _FOLD_CALIBRATE = (1, 2, 3), 4
# Bytes that separate words: everything in ASCII but letters and digits.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_STEMS = (4, 5, 6, 7)
_REMEMBERED = 200_000  # words whose scores a worker keeps at hand
_WORDS_AT_ONCE = 50_000


@dataclass(frozen=True)
class Model:
    bins: np.ndarray  # those with a score
    scores: np.ndarray  # their scores, without the toll
    toll: float
    lam: float
    log_k: float
    weights: tuple[float, ...]  # intercept, log surprise of the best passage, log of significant passages


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().translate(_SPLIT).split()


def forms(word: bytes) -> list[int]:
    """The bins of a word and of its stems."""
    stems = [zlib.crc32(word[:k] + b"*") & (BINS - 1) for k in _STEMS if k < len(word)]
    return [zlib.crc32(word) & (BINS - 1), *stems]


class Scorer:
    """Scores of words under a model, remembered for words met before."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros(BINS)
        self.table[model.bins] = model.scores

    def _learn(self, new: list[bytes]) -> None:
        at = list(map(forms, new))
        values = self.table[np.fromiter(chain.from_iterable(at), np.int64)]
        first = np.cumsum([0, *map(len, at[:-1])])
        low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        self.known.update(zip(new, np.where(-low > high, low, high).tolist(), strict=True))

    def _scores(self, words: list[bytes]) -> np.ndarray:
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        if len(words) > 1:  # a word said over and over is said once
            scores[1:][np.fromiter(map(eq, words[1:], words), bool, len(words) - 1)] = 0.0
        return scores - self.model.toll

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The scores of the words of each text; new words are looked up some texts at a time."""
        held, n = [], 0
        for at, text in enumerate(texts, 1):
            held.append(words_of(text.as_py()))
            n += len(held[-1])
            if n >= _WORDS_AT_ONCE or at == len(texts):
                words = set().union(*held)
                if len(self.known) > _REMEMBERED:
                    self.known.clear()
                if new := list(words.difference(self.known)):
                    self._learn(new)
                yield from map(self._scores, held)
                held, n = [], 0


def best_segment(scores: np.ndarray) -> float:
    """The largest sum over a run of neighbours; 0 for none."""
    if not len(scores):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return float((sums - np.minimum.accumulate(sums)).max())


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) with a score of at least ``least``, in order.

    One pass over runs of equal sign. The stack holds candidates with the sums left and
    right of them; a new one swallows candidates back to the nearest with a lower left sum
    as long as its right sum is higher. A heap-free search back is linear overall because
    swallowed candidates never return, and skipped ones are linked past.
    """
    if best_segment(scores) < least or not len(scores):
        return []
    edge = np.flatnonzero(np.diff(scores > 0)) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(scores)]])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, nearest with a lower left
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if scores[a] <= 0:
            continue
        start, left, right = a, sums[a], sums[b]
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                break
            start, left = stack[at][0], stack[at][2]
            link = stack[at][4]
            del stack[at:]
            at = link
        stack.append((start, b, left, right, at))
    return [(s, e, float(r - x)) for s, e, x, r, _ in stack if r - x >= least]


def _features(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Surprise (-ln of the chance probability) of the best passage, and the significant passages."""
    space = model.log_k + math.log(max(len(scores), 1))
    best = model.lam * best_segment(scores) - space  # -ln of expected chance hits
    hits = math.exp(min(-best, 50.0))
    surprise = -math.log(max(-math.expm1(-hits), 1e-20)) if best < 40 else best
    least = (space - math.log(SIGNIFICANT)) / model.lam
    return min(surprise, 60.0), segments(scores, max(least, 1e-9))


def _probability(model: Model, surprise: float, n: int) -> float:
    z = model.weights[0] + model.weights[1] * math.log1p(surprise) + model.weights[2] * math.log1p(n)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bin, and how many of the task's other and toxic texts have it."""
    counts = np.zeros((2, BINS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            # Once a text: repetition is no evidence.
            counts[toxic, list({at for word in set(words_of(text.as_py())) for at in forms(word)})] += 1
    at = np.flatnonzero(counts.any(axis=0))
    arrays = [pa.array(x, pa.int64()) for x in (at, counts[0, at], counts[1, at])]
    yield pa.RecordBatch.from_arrays(arrays, ["bin", "other", "toxic"])


def _log_odds(other: str, toxic: str, texts: dict[int, int]) -> Column:
    """Log-odds of a bin between the two kinds of text, shrunk by their standard error.

    The Dirichlet prior gives each bin ``PRIOR_TEXTS`` texts, dealt to the kinds by their size: no association.
    """
    n = texts[0] + texts[1]
    seen = [F.col(c) + PRIOR_TEXTS * texts[k] / n for k, c in ((0, other), (1, toxic))]
    rest = [F.greatest(texts[k] + PRIOR_TEXTS - seen[k], F.lit(0.5)) for k in (0, 1)]
    delta = F.log(seen[1]) - F.log(rest[1]) - F.log(seen[0]) + F.log(rest[0])
    error = F.sqrt(1 / seen[0] + 1 / seen[1])
    return F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - F.greatest(F.lit(EFFECT), CAUTION * error))


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of the mean of exp(lambda * score) = 1, at most 5."""
    use = weights > 0
    scores, weights = scores[use], weights[use] / weights[use].sum()
    low, high = 0.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.exp(np.minimum(mid * scores, 600))).sum() < 1 else (low, mid)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve(hessian, x.T @ (y - p) - np.r_[0, ridge * w[1:]])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside fold 0; of these, the ``SAMPLE_ROWS`` with the smallest hash of doc_id.

    A null label or id is no label; of several labels of a document the larger counts. Texts
    that repeat count once. Without labels of both kinds every text gets the smoothed share.
    """
    fold = fold_of(F.col("doc_id"))
    label = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    label = label.agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    chosen = label.where(fold_of(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most SAMPLE_ROWS pairs of numbers: a bounded broadcast.
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic", fold.alias("fold"))
    once = sample.groupBy(F.xxhash64("text").alias("_hash")).agg(F.min("doc_id").alias("_first"))
    sample = checkpoint(sample)
    once = checkpoint(once).select("_first").distinct()  # no more rows than the sample
    sample = sample.join(F.broadcast(once), F.col("doc_id") == F.col("_first"), "left_semi")
    counted = sample.where(F.col("fold").isin(*_FOLDS_COUNT)).select("text", "_toxic")
    texts = dict(map(tuple, counted.groupBy("_toxic").count().collect()))
    kinds = dict(map(tuple, sample.groupBy("_toxic").count().collect()))
    n, toxic = sum(kinds.values()), kinds.get(1, 0)
    share = (toxic + 0.5) / (n + 2)
    flat = (math.log(share / (1 - share)), 0.0, 0.0)
    none = np.zeros(0)
    if len(texts) < 2:
        return Model(none.astype(np.int64), none, TOLL, 1.0, 0.0, flat)
    bins = map_batches(counted, _count_batches, "bin long, other long, toxic long").groupBy("bin").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    bins = checkpoint(bins.withColumn("score", _log_odds("other", "toxic", texts)))
    every = bins.agg(F.sum("other")).first()[0] or 1
    found = bins.where("score <> 0").orderBy("bin").toArrow()  # at most BINS rows, in fact the few with evidence
    raw, clean = found["score"].to_numpy(), found["other"].to_numpy() / every
    toll = max(TOLL, 2 * float((clean * raw).sum()))
    weights = np.append(clean, 1 - clean.sum())
    first = Model(found["bin"].to_numpy(), raw, toll, _lambda(np.append(raw, 0.0) - toll, weights), 0.0, (0.0, 0.0, 0.0))

    def measured(model: Model):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # at most BINS scores

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model := Model(*shared.value))
            for batch in batches:
                made = []
                for scores in scorer(batch.column(0)):
                    surprise, found = _features(model, scores)
                    best = model.lam * best_segment(scores) - math.log(max(len(scores), 1))
                    made.append((surprise, len(found), best))
                columns = [pa.array([m[k] for m in made], pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["toxic", "surprise", "n", "best"])

        held = sample.where(F.col("fold") == _FOLD_CALIBRATE).select("text", "_toxic")
        return map_batches(held, each, "toxic int, surprise double, n double, best double").toArrow().to_pandas()  # 4 numbers a sampled row

    calm = measured(first)
    if calm["toxic"].nunique() < 2:
        return replace(first, weights=flat)
    # The median of a Gumbel law lies -ln(ln 2) above its place; unlike the mean, it bears a few mislabelled texts.
    log_k = float(calm.loc[calm["toxic"] == 0, "best"].median()) + math.log(math.log(2))
    model = replace(first, log_k=log_k)
    held = measured(model).sort_values(["surprise", "n", "toxic"])
    x = np.column_stack([np.ones(len(held)), np.log1p(held["surprise"]), np.log1p(held["n"])])
    return replace(model, weights=tuple(_logistic(x, held["toxic"].to_numpy(float)).tolist()))


PASSAGES = "array<struct<start: int, end: int, score: double>>"


def toxicity_of(text: Column, model: Model) -> Column:
    """A struct of score (0 to 1) and passages of a text: only texts travel to Python, and in bounded batches.

    Passages are half-open ranges of word indexes, words being runs of letters, digits and
    characters beyond ASCII. Null and empty texts have no passages and still get a score.
    """
    spark = SparkSession.active()
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(tuple(vars(model).values()))  # at most BINS scores
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))])

    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model := Model(*shared.value))
        for batch in texts:
            made = []
            for scores in scorer(batch):
                surprise, found = _features(model, scores)
                passages = [{"start": a, "end": b, "score": s} for a, b, s in found]
                made.append({"score": _probability(model, surprise, len(found)), "passages": passages})
            yield pa.array(made, kind)

    return F.arrow_udf(each, f"struct<score: double, passages: {PASSAGES}>")(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages of every row of ``docs``.

    Null and empty texts have no passages and get the score of a text without any; a long text is
    scored whole. Repeated rows repeat. A null doc_id is not held out. Other columns of ``docs``
    stay out. An empty table gives an empty result; what labels count says ``fit``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity_of(F.col("text"), fit(docs, labels)).alias("found"))
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
        F.size("found.passages").alias("n_passages"), F.col("found.passages").alias("passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5: all columns unchanged, whatever their names.

    Null and empty texts stay unless texts without passages are likelier toxic than not; repeated
    rows share their fate. Without labels of both kinds, rows stay if the smoothed share of toxic
    labels is under a half.
    """
    return docs.where(toxicity_of(F.col("text"), fit(docs, labels))["score"] < 0.5)
