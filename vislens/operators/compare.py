"""Comparison of arms, blocks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislens.functions.stats import count_if, ratio
from vislens.operators.ordered import neighbours, quantiles, running, time_chunk


def by_arm(df: DataFrame, keys: list[str], arm: str, arms: tuple[str, ...], measures: list[str], agg=F.sum) -> DataFrame:
    """One row per pair key with each measure once per arm, in a single pass."""
    cols = [agg(F.when(F.col(arm) == a, F.col(m))).alias(f"{m}_{a}") for m in measures for a in arms]
    return df.groupBy(*keys).agg(*[count_if(F.col(arm) == a).alias(f"n_{a}") for a in arms], *cols)


def availability(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    return (
        F.when(left & right, "both").when(left, f"{left_name}_only").when(right, f"{right_name}_only").otherwise("neither")
    )


def run_summary(long: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Median, min and max over runs; undefined runs are counted but skipped."""
    q = quantiles(long, keys, value, {"p50": 0.5}, stats=True)
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count(value).alias("defined"))
    return n.join(q.drop("n"), keys, "left")


def tier(move: Column, quiet: float = 1.18, moderate: float = 1.5) -> Column:
    return F.when(move <= quiet, "quiet").when(move <= moderate, "moderate").otherwise("excursion")


def both_ways(a: Column, b: Column) -> Column:
    """How far a ratio moved, whichever direction."""
    return F.greatest(ratio(a, b), ratio(b, a))


def band_runs(df: DataFrame, keys: list[str], t: str, key: str, in_band: Column, width: int, need: int = 2) -> DataFrame:
    """Runs of consecutive in-band readings per series of any length.

    A run is named by the number of out-of-band readings before it.
    """
    d = df.withColumn("__in", in_band)
    order = [F.col(t), F.col(key)]
    r = running(d, keys, time_chunk(t, width), order, sums={"__out": F.when(F.col("__in"), 0).otherwise(1), "__n": F.when(F.col("__in"), 1).otherwise(0)})
    runs = r.filter("__in").groupBy(*keys, "__out").agg(
        F.count(F.lit(1)).alias("len"), F.min("__n").alias("__first"), F.min(t).alias("start")
    )
    ready = r.filter("__in").join(runs.select(*keys, "__out", "__first"), [*keys, "__out"])
    ready = ready.filter(F.col("__n") - F.col("__first") + 1 == need).groupBy(*keys).agg(F.min(t).alias("ready_at"))
    agg = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("readings")).join(agg, keys, "left").join(ready, keys, "left")


def stale_probes(df: DataFrame, keys: list[str], start: str, end: str, hit: str, width: int) -> DataFrame:
    """Per item: probes before the first miss, the bracket around it, and re-appearances."""
    d = neighbours(df, keys, time_chunk(start, width), F.struct(start, end), prev={"__prev": hit})
    miss, seen = ~F.col(hit), F.col(hit)
    firsts = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probes"), F.min(F.when(miss, F.struct(start, end))).alias("__m"),
        F.min_by(hit, F.struct(start, end)).alias("first_hit"), count_if(seen & (F.col("__prev") == F.lit(False))).alias("reappearances"),
    )
    j = df.join(firsts.select(*keys, "__m"), keys).filter(F.col(hit) & (F.col("__m").isNull() | (F.struct(start, end) < F.col("__m"))))
    before = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("__stale"), F.max(start).alias("__last"))
    out = firsts.join(before, keys, "left")
    return out.select(
        *keys, "probes", F.coalesce("__stale", F.lit(0)).alias("stale_probes"), "reappearances", (~F.col("first_hit")).alias("first_probe_hidden"),
        (F.col(f"__m.{end}") - F.coalesce("__last", F.col(f"__m.{start}"))).alias("censor_width"), F.col("__m").isNotNull().alias("has_miss"),
    )


def observation_class() -> Column:
    return (
        F.when(F.col("reappearances") > 0, "OSCILLATION")
        .when(F.col("first_probe_hidden"), "FIRST_PROBE_HIDDEN")
        .when(F.col("has_miss") & (F.col("stale_probes") > 0), "STALE_WINDOW")
        .otherwise("UNRESOLVED")
    )


def bracket(before: Column, after: Column, effect: float) -> Column:
    """TIGHT / MILD / DRIFTED by absolute and relative drift between two control readings."""
    drift, rel = F.abs(after - before), F.abs(ratio(after, before) - 1)
    return F.when((drift <= 0.5 * effect) & (rel <= 0.05), "TIGHT").when((drift <= 2 * effect) & (rel <= 0.10), "MILD").otherwise("DRIFTED")


def resolvable(sd: Column, n: Column) -> Column:
    """Effect resolvable with n blocks (80 % power, 5 % two-sided)."""
    return F.sqrt(F.lit(7.849) * sd * sd / n)


def severity(worst: Column) -> Column:
    return F.when(worst >= 2, "unavailable").when(worst == 1, "constrained").otherwise("admissible")
