"""Text as columns. All run inside code generation; none needs Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COMMAND = r"\\[a-zA-Z]+"
ENVIRONMENT = r"\\begin\{([^}]+)\}"
WORD_TOKEN = r"\\[a-zA-Z]+|[^\s]"  # evaluation tokens: commands and single characters
PRE_TOKEN = r"\\[a-zA-Z]+|\\.|\d|[a-zA-Z]|[^\s]"  # units before subword merges


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def commands(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(COMMAND), F.lit(0))


def environments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENVIRONMENT), F.lit(1))


def tokens(text: Column, pattern: str = WORD_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_spaces(text: Column) -> Column:
    """Markup whose tokens were joined by spaces, put together again."""
    return F.replace(text, F.lit(" "), F.lit(""))


def without_dollars(text: Column) -> Column:
    return stripped(F.btrim(text, F.lit("$")))


def braces_balanced(text: Column) -> Column:
    return _count(text, r"\{") == _count(text, r"\}")


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def label(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, else an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates), F.lit(""))


def most_common(items: Column, k: int) -> Column:
    """Structs (item, n) of the k most frequent items, ties by first appearance."""
    counted = F.transform(F.array_distinct(items), lambda x, i: F.struct(
        (-F.size(F.filter(items, lambda y: y == x))).alias("neg"), i.alias("at"), x.alias("item")))
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda s: F.struct(s["item"].alias("item"), (-s["neg"]).alias("n")))


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of one markup string, by name."""
    found = commands(text)
    return {
        "length": F.length(text), "n_commands": F.size(found), "n_unique_cmds": F.size(F.array_distinct(found)),
        "n_envs": F.size(environments(text)), "n_fracs": _count(text, r"\\frac"), "n_sup_sub": _count(text, r"[\^_]"),
        "has_numbers": F.rlike(text, F.lit(r"(?U)\d")), "brace_balanced": braces_balanced(text),
        "is_empty": F.rlike(text, F.lit(r"(?U)^\s*$")),
        "has_newline": F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\\\\")),
    }


def rounded(value: Column, digits: int) -> Column:
    """Rounded half to even on the exact binary value, as Python does: 0.125 to 0.12, 2.675 to 2.67. Spark's own rounds on the decimal form."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else round(x, digits) for x in batch.to_pylist()], pa.float64())

    return F.arrow_udf(each, "double")(value.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def grade(rate: Column) -> Column:
    return F.when(rate < 1, "GOOD").when(rate < 5, "WARN").otherwise("BAD")


def counted_share(n: Column, total: Column) -> Column:
    """A count with separated thousands, two spaces, and its percentage of a total; of nothing, 0 percent."""
    return F.format_string("%,d  (%.2f%%)", n, percent(n, total))
