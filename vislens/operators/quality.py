"""Result records, regression differences and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The evidence tiers a result record may carry.
EVIDENCE_LEVELS = ("simulation", "exact_in_memory", "milvus_lite_flat", "milvus_standalone")


def emit_records(wide: DataFrame, keys: list[str], metrics: list[str], evidence_level: str, digits: int = 6) -> DataFrame:
    """Long result records; NaN and missing values become null with a status."""
    if evidence_level not in EVIDENCE_LEVELS:
        raise ValueError(f"unknown evidence level {evidence_level!r}")
    long = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "raw")
    value = F.when(~F.isnan("raw"), F.round("raw", digits))
    return long.select(
        *keys,
        F.lit(evidence_level).alias("evidence_level"),
        "metric",
        value.alias("value"),
        F.when(value.isNull(), "undefined").otherwise("observed").alias("status"),
    )


def broken_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Long violations table: one row per record and rule whose condition is true."""
    found = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return df.select(*keys, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def gates(summary: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per gate of a one-row summary: gate, ok, detail."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("bigint").alias("detail"))
            for n, (ok, detail) in checks.items()
        ]
    )
    return summary.select(F.explode(rows).alias("g")).select("g.*")


def field_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form of both records side by side: keys, field, left, right, moved."""
    def long(df, name):
        d = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
        return d.unpivot(keys, fields, "field", name)

    j = long(left, "left_value").join(long(right, "right_value"), [*keys, "field"], "full_outer")
    return j.withColumn("moved", ~F.col("left_value").eqNullSafe(F.col("right_value")))


def within_tolerance(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Equal within an absolute tolerance; null matches only null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tol)


def identity_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule, how many records were checked and how many break it."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(~F.coalesce(ok, F.lit(True)), 1)).alias(r) for r, ok in rules.items()])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col("n").alias("records"), F.col(r).alias("violations")) for r in rules])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side missing on the other, with multiplicity."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def recompute_report(published: dict[str, DataFrame], recomputed: dict[str, DataFrame], keys: dict[str, list[str]], tol: float = 1e-6) -> DataFrame:
    """Published summaries against what the observations give now: section, key, field, published, recomputed, same.

    Sections must be the same on both sides. Every numeric field is compared
    within the tolerance; rows and fields of one side only are reported with a
    null on the other and are not the same unless both are null.
    """
    if set(published) != set(recomputed):
        raise ValueError(f"sections differ: {sorted(set(published) ^ set(recomputed))}")
    out = None
    for name, old in published.items():
        new, own = recomputed[name], keys[name]
        fields = sorted((set(old.columns) | set(new.columns)) - set(own))
        both = []
        for df in (old, new):
            both.append(df.select(*own, *[F.col(f).cast("double").alias(f) if f in df.columns else F.lit(None).cast("double").alias(f) for f in fields], F.lit(True).alias("__there")))
        diff = field_diff(both[0].drop("__there"), both[1].drop("__there"), own, fields)
        rows = both[0].select(*own, "__there").join(both[1].select(*own, F.col("__there").alias("__also")), own, "full_outer")
        part = diff.join(rows, own).select(
            F.lit(name).alias("section"), F.concat_ws("/", *[F.col(k).cast("string") for k in own]).alias("key"), "field",
            F.col("left_value").alias("published"), F.col("right_value").alias("recomputed"),
            (within_tolerance(F.col("left_value"), F.col("right_value"), tol) & F.col("__there").isNotNull() & F.col("__also").isNotNull()).alias("same"),
        )
        out = part if out is None else out.unionByName(part)
    return out
