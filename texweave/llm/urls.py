"""URL verdicts: host and path rules, and gradient-boosted trees for urls that no rule fits.

The trees are trained on urls that rules have labelled. Features are lexical only: lengths,
depth, shares of digits and other characters, entropy, counts of parameters, and statistics
of the host's suffix and of the first path segment among the labelled urls; a url that trains takes these
from the other folds, so that its own label is no feature of it. Features are SQL expressions; the trees are
Spark's own, fitted and applied by Spark.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_ROWS = 100_000  # labelled urls that the fit takes at most, those with the smallest hash
SUFFIX_BINS = 1024  # suffixes are hashed to so many bins
FOLDS = 5  # of the urls that train, by url
_TREES, _DEPTH = 20, 4
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _LOWER.upper(), _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, and the path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _share(pattern: str, text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    count = lambda pattern, text: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")
    length = lambda text: F.length(text).cast("double")
    return {
        "f_length": length(url), "f_host_length": length(host), "f_path_length": length(path),
        "f_depth": count("/[^/]", path), "f_labels": count(r"\.", host), "f_hyphens": count("-", host),
        "f_digits": _share("[0-9]", url), "f_host_digits": _share("[0-9]", host), "f_other": _share("[^0-9A-Za-z]", url),
        "f_entropy": _entropy(host), "f_parameters": count("[?&][^=&#]+=", url),
        "f_fragment": F.contains(url, F.lit("#")).cast("double"), "f_escapes": count("%[0-9A-Fa-f]{2}", url),
        "f_first_segment": length(F.regexp_extract(path, "^/([^/]*)", 1)), "f_trailing": F.endswith(path, F.lit("/")).cast("double"),
        "f_extension": length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), "f_https": F.startswith(url, F.lit("https")).cast("double"),
    }


def statistics(labelled: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """f_{key}_seen and f_{key}_blocked of each key over all labelled rows; and of each key and fold over the other folds' rows.

    seen is ln(1 + rows), for the other folds as if they were all of them; blocked is the share of
    label 1 drawn towards ``share`` by five rows.
    """
    folds = labelled.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    folds = checkpoint(folds.withColumns({f"all_{c}": F.sum(c).over(W.partitionBy(key)) for c in ("n", "b")}))  # SUFFIX_BINS times FOLDS rows at most
    told = lambda n, b, scale: [F.log1p(n * scale).alias(f"f_{key}_seen"), ((b + 5 * share) / (n + 5)).alias(f"f_{key}_blocked")]
    n, b, all_n, all_b = (F.col(c) for c in ("n", "b", "all_n", "all_b"))
    return folds.select(key, *told(all_n, all_b, 1.0)).distinct(), folds.select(key, "fold", *told(all_n - n, all_b - b, FOLDS / (FOLDS - 1)))


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, judge_all: bool = False, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of blocking, by the trees; null under a rule) of every row of ``pages``.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by its
    characters; a long one is judged whole. Without labelled urls of both kinds, urls under no rule
    get the labels' majority, allow if there are none. Repeated rows repeat, other columns of
    ``pages`` stay out, and an empty table gives an empty result. ``judge_all`` scores urls under
    rules too; ``learn``, a condition on url, keeps others from training, to measure on them.
    """
    spark, url = pages.sparkSession, F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocks = [rule for rule, kind in rules if kind == "block"]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks).cast("double"))
    bins = lambda text: F.pmod(F.xxhash64(text), F.lit(SUFFIX_BINS))
    suffix, segment = bins(F.substring_index("host", ".", -1)), bins(F.regexp_extract("path", "^/([^/]*)", 1))
    lexical = features(F.col("url"), F.col("host"), F.col("path"))
    ruled = ruled.select("*", label.alias("label"), suffix.alias("suffix"), segment.alias("segment"))
    known = ruled.where("label is not null")
    chosen = (known if learn is None else known.where(learn)).orderBy(F.xxhash64("url", "page_id"), "page_id").limit(SAMPLE_ROWS)
    chosen = checkpoint(chosen)
    counts = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(counts) < 2:
        block = F.lit(1.0 if counts.get(1.0, 0) else 0.0)
        judged = ruled.withColumn("score", block)
    else:
        share = counts[1.0] / sum(counts.values())
        fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
        totals, others = {}, {}
        for key in ("suffix", "segment"):
            totals[key], others[key] = (F.broadcast(found) for found in statistics(chosen.select("*", fold), key, share))

        def described(rows: DataFrame, stats: dict[str, DataFrame], *by: str) -> DataFrame:
            for key, found in stats.items():
                rows = rows.join(found, [key, *by], "left").fillna({f"f_{key}_seen": 0.0, f"f_{key}_blocked": share})
            return rows.select("*", *(c.alias(k) for k, c in lexical.items()))

        names = [*lexical, *(f"f_{key}_{what}" for key in totals for what in ("seen", "blocked"))]
        assemble = VectorAssembler(inputCols=names, outputCol="features")
        trees = GBTClassifier(maxIter=_TREES, maxDepth=_DEPTH, seed=7, featuresCol="features", labelCol="label")
        tasks = min(16, spark.sparkContext.defaultParallelism)  # the limit has left one partition
        train = checkpoint(assemble.transform(described(chosen.withColumn("fold", fold), others, "fold")).select("features", "label").repartition(tasks))
        model = trees.fit(train)
        scored = model.transform(assemble.transform(described(ruled, totals)))
        judged = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("label").isNotNull(), F.when(F.col("label") == 1, "block").otherwise("allow"))
    verdict = F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    score = F.col("score") if judge_all else F.when(F.col("label").isNull(), F.col("score"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
