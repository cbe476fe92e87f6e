"""Ordered computations that never put one whole group into one task.

A running sum, rank, lag or quantile over a group is split into *chunks*: a
monotone function of the order key.  Each chunk is summarised by a map-side
combined aggregate, the (few) summaries are scanned per group, and the rows are
then finished with a window partitioned by (group, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_chunk(value, per_octave: int = 16) -> Column:
    """Monotone chunk number of a number: equal widths on a log scale."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * per_octave)).cast("bigint")


def time_chunk(value, width: int) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / F.lit(width)).cast("bigint")


def hash_chunk(value, hex_digits: int = 2) -> Column:
    """Prefix of a hex digest: equally full chunks for hash-ordered ranks."""
    v = F.col(value) if isinstance(value, str) else value
    return F.substring(v, 1, hex_digits)


def join_null_safe(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join in which null keys match null keys.

    The keys travel as one struct: structs compare their null fields as equal,
    and unlike `<=>` the join can still be satisfied by an ordinary hash
    partitioning of that one column.
    """
    right = other.select(F.struct(*cols).alias("__rk"), *[c for c in other.columns if c not in cols])
    return df.join(right, F.struct(*cols) == F.col("__rk"), "left").drop("__rk")


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima per group, exact across chunks.

    `totals` names columns for the whole group's value of a running sum.
    """
    totals = totals or {}
    sums, maxes = sums or {}, maxes or {}
    base = df.withColumn("__chunk", chunk)
    for name, c in {**sums, **maxes}.items():
        base = base.withColumn(f"__v_{name}", c)
    cols = [*keys, "__chunk"]
    summary = base.groupBy(*cols).agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__s_{n}") for n in maxes],
    )
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = summary.select(
        *cols,
        *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in sums],
        *[F.max(f"__s_{n}").over(before).alias(f"__b_{n}") for n in maxes],
        *[F.sum(f"__s_{n}").over(whole).alias(t) for n, t in totals.items()],
    )
    local = W.partitionBy(*cols).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = join_null_safe(base, offsets, cols)
    for n in sums:
        inner = F.sum(f"__v_{n}").over(local)
        out = out.withColumn(n, F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.coalesce(inner, F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.col(f"__b_{n}"), F.max(f"__v_{n}").over(local)))
    drop = ["__chunk"] + [f"__v_{n}" for n in (*sums, *maxes)] + [f"__b_{n}" for n in (*sums, *maxes)]
    return out.drop(*drop)


def rank_by(df: DataFrame, keys, chunk: Column, order, name: str = "rank") -> DataFrame:
    """Exact row number within a group of any size (the order must be total)."""
    return running(df, keys, chunk, order, sums={name: F.lit(1).cast("bigint")})


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: str | Column,
    *,
    prev: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """lag/lead of columns per group, exact across chunk borders.

    `order` is one column (a struct for several order keys).
    """
    prev, following = prev or {}, following or {}
    base = df.withColumn("__chunk", chunk).withColumn(
        "__ord", F.col(order) if isinstance(order, str) else order
    )
    cols = [*keys, "__chunk"]
    summary = base.groupBy(*cols).agg(
        *[F.max_by(c, "__ord").alias(f"__l_{n}") for n, c in prev.items()],
        *[F.min_by(c, "__ord").alias(f"__f_{n}") for n, c in following.items()],
    )
    across = W.partitionBy(*keys).orderBy("__chunk")
    offsets = summary.select(
        *cols,
        *[F.lag(f"__l_{n}").over(across).alias(f"__b_{n}") for n in prev],
        *[F.lead(f"__f_{n}").over(across).alias(f"__b_{n}") for n in following],
    )
    local = W.partitionBy(*cols).orderBy("__ord")
    first = F.row_number().over(local) == 1
    last = F.lead(F.lit(1)).over(local).isNull()
    out = join_null_safe(base, offsets, cols)
    out = out.withColumn("__first", first).withColumn("__last", last)
    for n, c in prev.items():
        out = out.withColumn(n, F.when(F.col("__first"), F.col(f"__b_{n}")).otherwise(F.lag(c).over(local)))
    for n, c in following.items():
        out = out.withColumn(n, F.when(F.col("__last"), F.col(f"__b_{n}")).otherwise(F.lead(c).over(local)))
    return out.drop("__chunk", "__ord", "__first", "__last", *[f"__b_{n}" for n in (*prev, *following)])


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with the rank range [first, last] they occupy."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running(
        counted, keys, log_chunk("__value"), [F.col("__value")], sums={"__last_rank": F.col("__n")}, totals={"__last_rank": "n"}
    )
    return ranked.withColumn("__first_rank", F.col("__last_rank") - F.col("__n") + 1)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    nearest: bool = False,
    stats: bool = False,
) -> DataFrame:
    """Exact quantiles per group without buffering a group in one task.

    Linear interpolation at p*(n-1), or with `nearest` the element at index
    min(n-1, floor(p*n)).  `stats` adds n, min and max columns.
    """
    picked = _ranked_values(df, keys, value)
    low, high = {}, {}
    for name, p in probs.items():
        if nearest:
            pos = F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))) + 1
            low[name] = high[name] = pos
        else:
            x = F.lit(p) * (F.col("n") - 1)
            low[name], high[name] = F.floor(x) + 1, F.ceil(x) + 1
    at = lambda pos: F.max(
        F.when((F.col("__first_rank") <= pos) & (pos <= F.col("__last_rank")), F.col("__value"))
    )
    aggs = []
    for name in probs:
        aggs += [at(low[name]).alias(f"__lo_{name}"), at(high[name]).alias(f"__hi_{name}")]
    got = picked.groupBy(*keys).agg(F.first("n").alias("n"), F.min("__value").alias("min"), F.max("__value").alias("max"), *aggs)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        if nearest:
            out.append(lo.alias(name))
        else:
            x = F.lit(p) * (F.col("n") - 1)
            out.append((lo + (hi - lo) * (x - F.floor(x))).cast("double").alias(name))
    extra = [F.col("n"), F.col("min"), F.col("max")] if stats else []
    return got.select(*keys, *extra, *out)


def take_top(df: DataFrame, keys: Sequence[str], score: str, key: str, n: Column) -> DataFrame:
    """The `n` rows per group with the highest score (ties: smallest key), for groups of any size.

    Scores lie in [-1, 1] and are counted first, so a score shared by very many
    rows is one row of the scan; only the rows tied at the cut are ranked by key.
    """
    counted = df.groupBy(*keys, F.col(score).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    descending = (-F.floor((F.col("__value") + 1.0) * 512)).cast("bigint")
    scanned = running(counted, keys, descending, [F.col("__value").desc()], sums={"__upto": F.col("__n")})
    cut = scanned.filter((F.col("__upto") >= n) & (F.col("__upto") - F.col("__n") < n)).select(
        *keys, F.col("__value").alias("__cut"), (n - F.col("__upto") + F.col("__n")).alias("__room")
    )
    marked = join_null_safe(df, cut, keys)
    above = marked.filter(F.col("__cut").isNull() | (F.col(score) > F.col("__cut")))
    ties = marked.filter(F.col(score) == F.col("__cut"))
    ties = rank_by(ties, keys, time_chunk(key, 1 << 16), [F.col(key)], name="__tie")
    ties = ties.filter(F.col("__tie") <= F.col("__room")).drop("__tie")
    return above.unionByName(ties).drop("__cut", "__room")
