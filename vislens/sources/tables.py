"""Strict readers, create-only writers and the base relations of the workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vislens.functions.text import decode_latin1

MICROS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by `key` over as many tasks as the session shuffles to.

    For row-wise text work that costs far more than moving the rows, so that its
    parallelism does not hang on how the files happen to be cut.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def read_strict(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with an exact schema; extra or missing fields and non-finite numbers are errors."""
    found = spark.read.format(fmt).load(path).schema
    want, have = {f.name for f in schema}, {f.name for f in found}
    if want != have:
        raise ValueError(f"fields differ: missing {sorted(want - have)}, extra {sorted(have - want)}")
    df = spark.read.format(fmt).schema(schema).option("mode", "FAILFAST").load(path)
    return require_finite(df)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def float_array_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType))
    ]


def not_finite(c: Column) -> Column:
    return F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(False))


def non_finite_row(df: DataFrame) -> Column:
    """True for a row holding NaN or an infinity in any numeric column."""
    bad = F.lit(False)
    for c in float_columns(df):
        bad = bad | not_finite(F.col(c))
    for c in float_array_columns(df):
        bad = bad | F.coalesce(F.exists(c, not_finite), F.lit(False))
    return bad


def require_finite(df: DataFrame) -> DataFrame:
    """Rows pass through unchanged; a non-finite number fails the job."""
    ok = F.assert_true(~non_finite_row(df), F.lit("non-finite number in input"))
    return df.filter(ok.isNull())


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Create-only sink: refuses to overwrite."""
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts from files laid out as <topic>/<filename>, with their bytes and the text that these spell in Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return raw.select(
        F.element_at(parts, -2).alias("topic"), F.element_at(parts, -1).alias("filename"), F.col("content").alias("raw"), decode_latin1("content").alias("text")
    )


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        c = F.col(name)
        seconds = F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * MICROS + (F.extract(F.lit("SECOND"), c) * MICROS).cast("bigint")
    return F.unix_micros(name)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector items with topic, source and batch lineage."""
    e = table(spark, sf_dir, "embeddings")
    src, batch = F.col("vec_id") % 20, F.floor(F.col("vec_id") / 20) % 10
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("topic"),
        src.alias("src"),
        batch.alias("batch"),
        ((src == 0) & (batch < 3) & (F.floor(F.col("vec_id") / 200) % 2 == 0)).alias("poisoned"),
        (F.col("vec_id") % 25).alias("slot"),
    )


def queries(items_df: DataFrame, slot: int = 0) -> DataFrame:
    return items_df.filter(F.col("slot") == slot).select(
        F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.col("topic").alias("qtopic")
    )


def corpus(items_df: DataFrame) -> DataFrame:
    return items_df.filter(~F.col("slot").isin(0, 1))
