"""Token similarity by longest common subsequence (normalised indel distance), 0 to 100.

``lcs`` is a plain expression, for checks and few rows.  ``score_names`` scores distinct pairs of
names once with a bit-parallel LCS (Hyyro, 2004) over Arrow batches and joins the scores back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a row of the dynamic programme for each character of ``a``."""
    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def row(old: Column, c: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            same = F.substr(b, j, F.lit(1)) == c
            return F.concat(new, F.array(F.when(same, F.element_at(old, j) + 1).otherwise(F.greatest(F.element_at(old, j + 1), F.element_at(new, j)))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(chars(a), zeros, row), -1))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word (or a long integer) at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 100.0 * (2 * common(a, b)) / total


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    shared, l, r = len(" ".join(both)), " ".join(left), " ".join(right)  # noqa: E741
    gap = 1 if shared else 0
    total = 2 * shared + 2 * gap + len(l) + len(r)
    best = 100.0 * (total - (len(l) + len(r) - 2 * common(l, r))) / total if total else 100.0
    if shared:
        for part in (l, r):
            whole = 2 * shared + gap + len(part)
            best = max(best, 100.0 * (whole - gap - len(part)) / whole)
    return best


def name_score(a: str | None, b: str | None) -> float:
    """0 if either is empty; the token-sort ratio if 95 or more, else the larger of it and the token-set ratio."""
    if not a or not b:
        return 0.0
    s = token_sort(a, b)
    return s if s >= 95 else max(s, token_set(a, b))


@F.pandas_udf(T.DoubleType())
def name_score_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([name_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_sort_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([token_sort(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def ratio_int_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Plain ratio, truncated; 0 if either is empty."""
    for a, b in batches:
        yield pd.Series([int(ratio(x, y)) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def score_pairs(pairs: DataFrame, left: str, right: str, to: str, udf=name_score_udf, of: DataFrame | None = None) -> DataFrame:
    """Add column ``to``: the score of two text columns.

    ``of``: a frame with the same pairs of texts that costs less to read once more.

    Equal non-empty texts score 100 without leaving the JVM; of the others each distinct pair is
    scored once, whichever way round, and joined back.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    marked = pairs.withColumn("_low", low).withColumn("_high", high)
    plain = F.when((F.col("_low") == "") | F.col("_low").isNull(), F.lit(0)).when(F.col("_low") == F.col("_high"), F.lit(100))
    todo = (marked if of is None else of.select(low.alias("_low"), high.alias("_high"))).where((F.col("_low") != "") & (F.col("_low") != F.col("_high"))).select("_low", "_high").distinct()
    scores = todo.withColumn("_score", udf("_low", "_high"))
    kind = "int" if udf is ratio_int_udf else "double"
    return marked.join(scores, ["_low", "_high"], "left").withColumn(to, F.coalesce("_score", plain, F.lit(0)).cast(kind)).drop("_low", "_high", "_score")
