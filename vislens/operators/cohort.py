"""Cohort building: duplicate groups, strata, quotas and leak joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.operators.ordered import hash_chunk, rank_by

MODEL_REVISION = "rev-1"
FORBIDDEN = frozenset(
    # Names that may not reach a scorer.
    "label labels is_poison poison poison_id attack_family attack_variant query target_query template "
    "template_name target_document_id result_path stratum topic source_id".split()
)


def duplicate_groups(posts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per normalised text; the canonical member is min(topic, source_id, raw_sha).

    Only combinable aggregates are used, so one text held by very many posts is
    reduced map-side; `carry` columns of the canonical member travel along, so
    texts themselves are never shuffled.  Member lists stay long (`duplicate_log`).
    """
    by_source = posts.groupBy("gid", "source_id").agg(
        F.min(F.struct("topic", "source_id", "raw_sha", "doc_id", *carry)).alias("first"), F.count(F.lit(1)).alias("n")
    )
    return by_source.groupBy("gid").agg(
        F.min("first").alias("c"), F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_aliases")
    ).select("gid", "c.*", "n_members", "n_aliases")


def duplicate_log(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Every non-canonical member with a pointer to its canonical one."""
    canon = groups.filter("n_members > 1").select(
        "gid", F.col("topic").alias("canonical_topic"), F.col("source_id").alias("canonical_source_id"), F.col("doc_id").alias("__c")
    )
    return posts.join(canon, "gid").filter(F.col("doc_id") != F.col("__c")).select(
        F.lit("duplicate_noncanonical").alias("reason"), "gid", "topic", "source_id", "raw_sha", "canonical_topic", "canonical_source_id"
    )


def hash_ordered_take(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """First n rows per key in hash order; Spark keeps only n per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def repair_quotas(available: DataFrame, nominal: int) -> DataFrame:
    """Capacity-limited per-topic quotas; a shortfall is dealt one by one in topic order.

    available: topic, capacity (one row per topic).  The deal is a ranking of the
    spare slots by (round, topic); no topic can need more rounds than the shortfall.
    """
    enough = F.col("capacity") >= 2 * nominal
    base = available.select(
        "topic",
        "capacity",
        F.when(enough, nominal).otherwise(F.floor((F.col("capacity") + 1) / 2)).cast("bigint").alias("calibration"),
        F.when(enough, nominal).otherwise(F.floor(F.col("capacity") / 2)).cast("bigint").alias("test"),
    )
    everything = W.partitionBy(F.lit(0))  # one row per topic
    for split in ("calibration", "test"):
        base = base.withColumn("__missing", F.count(F.lit(1)).over(everything) * nominal - F.sum(split).over(everything))
        spare = F.least(F.col("capacity") - F.col("calibration") - F.col("test"), F.col("__missing")).cast("int")
        slots = base.select("*", F.explode_outer(F.when(spare > 0, F.sequence(F.lit(1), spare))).alias("turn"))
        turn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("turn").asc_nulls_last(), "topic"))
        dealt = slots.withColumn("__won", F.col("turn").isNotNull() & (turn <= F.col("__missing")))
        base = dealt.groupBy("topic").agg(
            *[F.first(c).alias(c) for c in ("capacity", "calibration", "test")], F.count(F.when(F.col("__won"), 1)).alias("__extra")
        )
        base = base.withColumn(split, F.col(split) + F.col("__extra")).drop("__extra")
    return base


def allocate(groups: DataFrame, quotas: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Disjoint strata per topic.

    groups: gid, topic, order_key (hash), hard (bool).  quotas: topic, calibration, test.
    Reference first in allocation order; then hard negatives in group-hash order
    and ordinary items in allocation order; what is left fills the recipe, cover
    and control strata.  Ranks are exact for topics of any size.
    """
    r = rank_by(groups, ["topic"], hash_chunk("order_key"), [F.col("order_key"), F.col("gid")], "r1")
    n_ref = counts["reference"]
    ref = r.filter(F.col("r1") <= n_ref)
    rest = r.filter(F.col("r1") > n_ref).withColumn("__k", F.when(F.col("hard"), F.col("gid")).otherwise(F.col("order_key")))
    rest = rank_by(rest, ["topic", "hard"], hash_chunk("__k"), [F.col("__k"), F.col("gid")], "r2").join(
        quotas.select("topic", F.col("calibration").alias("qc"), F.col("test").alias("qt")), "topic"
    )
    ch, th = counts["calibration_hard"], counts["test_hard"]
    clean = (
        F.when(F.col("hard") & (F.col("r2") <= ch), "calibration_hard")
        .when(F.col("hard") & (F.col("r2") <= ch + th), "test_hard")
        .when(~F.col("hard") & (F.col("r2") <= F.col("qc")), "calibration_ordinary")
        .when(~F.col("hard") & (F.col("r2") <= F.col("qc") + F.col("qt")), "test_ordinary")
    )
    rest = rest.withColumn("stratum", clean)
    left = rank_by(
        rest.filter(F.col("stratum").isNull()).drop("stratum"), ["topic"], hash_chunk("order_key"), [F.col("order_key"), F.col("gid")], "r3"
    )
    upto, stratum = 0, F.lit(None).cast("string")
    steps = []
    for name in [n for n in counts if n not in ("reference", "calibration_hard", "test_hard")]:
        upto += counts[name]
        steps.append((upto, name))
    for end, name in reversed(steps):
        stratum = F.when(F.col("r3") <= end, name).otherwise(stratum)
    cols = ["gid", "topic", "stratum"]
    return (
        ref.select("gid", "topic", F.lit("reference").alias("stratum"))
        .unionByName(rest.filter(F.col("stratum").isNotNull()).select(*cols))
        .unionByName(left.withColumn("stratum", stratum).filter(F.col("stratum").isNotNull()).select(*cols))
    )


def source_evidence(kind) -> list:
    """Credential, provenance and revision implied by a control kind."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return [
        (~F.coalesce(k.isin("invalid_signature", "unknown_source"), F.lit(False))).alias("credential_valid"),
        (~F.coalesce(k == "provenance_conflict", F.lit(False))).alias("provenance_consistent"),
        F.lit(MODEL_REVISION).alias("embedding_model_revision"),
    ]


def forbidden_columns(df: DataFrame) -> list[str]:
    """Names in the schema, nested ones included, that would leak truth to a scorer."""
    found = []

    def walk(dt, path):
        for f in getattr(dt, "fields", []):
            here = f"{path}{f.name}"
            if f.name in FORBIDDEN:
                found.append(here)
            inner = f.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            walk(inner, here + ".")

    walk(df.schema, "")
    return found


def safe_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.select(*columns)
    leaked = forbidden_columns(out)
    if leaked:
        raise ValueError(f"forbidden columns in a safe projection: {leaked}")
    return out


def shared_runs(left: DataFrame, right: DataFrame, n: int = 6) -> DataFrame:
    """(left_id, right_id, longest common token run) of every pair sharing n tokens in a row.

    left: left_id, text.  right: right_id, text.  What meets in the equi-join are
    two 64-bit hashes of n tokens, no strings. Neighbouring matches on one
    diagonal form a run.
    """
    def grams(df, key):
        g = df.select(key, F.explode(tx.shingle_hashes(tx.tokens("text"), n)).alias("s"))
        return g.select(key, F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.pos").alias(f"pos_{key}"))

    hits = grams(left, "left_id").join(grams(right, "right_id"), ["a", "b"])
    hits = hits.withColumn("diag", F.col("pos_left_id") - F.col("pos_right_id"))
    w = W.partitionBy("left_id", "right_id", "diag").orderBy("pos_left_id")
    runs = hits.withColumn("island", F.col("pos_left_id") - F.row_number().over(w))
    sized = runs.groupBy("left_id", "right_id", "diag", "island").agg(F.count(F.lit(1)).alias("k"))
    return sized.groupBy("left_id", "right_id").agg((F.max("k") + (n - 1)).alias("longest_run"))
