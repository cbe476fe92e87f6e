"""Two-family detector: content novelty against a reference plus source evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.functions.vectors import cosine
from vislens.operators.similarity import topk
from vislens.session import cut_lineage

MIN_STD = 1e-12


def hashed_embedder(df: DataFrame, text: str, out: str, dim: int = 256) -> DataFrame:
    """Default embedder: hashed bag of words scaled to unit norm (Spark ML)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    d = df.withColumn("__w", tx.tokens(text))
    d = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim).transform(d)
    d = Normalizer(inputCol="__tf", outputCol="__n").transform(d)
    return d.withColumn(out, vector_to_array("__n")).drop("__w", "__tf", "__n")


def udf_embedder(udf: Callable[[Column], Column]) -> Callable:
    """Wrap a user's text -> ARRAY<FLOAT> Arrow UDF as an embedder."""
    return lambda df, text, out: df.withColumn(out, udf(F.col(text)))


def rep_score_embedded(posts: DataFrame, embedder: Callable = hashed_embedder) -> DataFrame:
    """Cosine of the embeddings of both word halves; posts: doc_id, norm."""
    a, b = tx.word_halves("norm")
    d = posts.select("doc_id", a.alias("a"), b.alias("b")).filter((F.col("a") != "") & (F.col("b") != ""))
    d = embedder(embedder(d, "a", "va"), "b", "vb")
    return d.select("doc_id", cosine("va", "vb").alias("rep"))


def rep_score_words(posts: DataFrame) -> DataFrame:
    """The same score with un-hashed word counts: long (doc, word) counts, combined map-side."""
    w = posts.select("doc_id", tx.words(F.lower("norm")).alias("w")).filter(F.size("w") >= 2)
    cut = F.floor(F.size("w") / 2)
    long = w.select("doc_id", cut.alias("cut"), F.posexplode("w").alias("pos", "word"))
    counts = long.groupBy("doc_id", "word").agg(
        F.count(F.when(F.col("pos") < F.col("cut"), 1)).alias("c1"), F.count(F.when(F.col("pos") >= F.col("cut"), 1)).alias("c2")
    )
    norms = F.sqrt(F.sum(F.col("c1") * F.col("c1"))) * F.sqrt(F.sum(F.col("c2") * F.col("c2")))
    return counts.groupBy("doc_id").agg((F.sum(F.col("c1") * F.col("c2")) / norms).alias("rep"))


def knn_novelty(items: DataFrame, reference: DataFrame, k: int = 10) -> DataFrame:
    """1 - mean cosine of the k nearest references outside the item's own source group.

    Fewer than k eligible references fails the job.
    """
    q = items.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.col("source_group").alias("qg"))
    near = topk(q, reference, k, query_group="qg", item_group="source_group")
    out = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.lit(1.0) - F.avg("score")).alias("knn"))
    enough = F.assert_true(F.col("n") >= k, F.lit("too few eligible references"))
    return out.filter(enough.isNull()).select(F.col("query_id").alias("id"), "knn")


def text_features(posts: DataFrame, embedder: Callable = hashed_embedder, k: int = 10) -> DataFrame:
    """rep and knn of every post with two non-empty word halves; posts: id, norm, source_group, is_ref, and what else is to be kept.

    The vectors are made once per text: for the whole and for both halves.
    """
    a, b = tx.word_halves("norm")
    d = posts.withColumns({"__a": a, "__b": b}).filter((F.col("__a") != "") & (F.col("__b") != ""))
    for text, vector in (("norm", "vector"), ("__a", "__va"), ("__b", "__vb")):
        d = embedder(d, text, vector)
    d = cut_lineage(d.withColumn("rep", cosine("__va", "__vb")).drop("norm", "__a", "__b", "__va", "__vb"))
    near = knn_novelty(d, d.filter("is_ref"), k)
    return d.drop("vector").join(near, "id")


def z_statistics(features: DataFrame) -> DataFrame:
    """One row: population mean and standard deviation of rep and knn over the reference."""
    z = features.agg(
        F.avg("rep").alias("rep_mean"), F.stddev_pop("rep").alias("rep_std"), F.avg("knn").alias("knn_mean"), F.stddev_pop("knn").alias("knn_std")
    )
    ok = F.assert_true((F.col("rep_std") >= MIN_STD) & (F.col("knn_std") >= MIN_STD), F.lit("reference std below minimum"))
    return z.filter(ok.isNull())


def content_score(features: DataFrame, z: DataFrame) -> DataFrame:
    """z(rep) + z(knn) with the one-row statistics as a scalar subquery."""
    d = features.withColumn("__z", z.select(F.struct("*")).scalar())
    score = (F.col("rep") - F.col("__z.rep_mean")) / F.col("__z.rep_std") + (F.col("knn") - F.col("__z.knn_mean")) / F.col("__z.knn_std")
    return d.withColumn("c_score", score).drop("__z")


def source_affirms(pinned: str, credential="credential_valid", provenance="provenance_consistent", revision="embedding_model_revision", model="model_revision") -> Column:
    return F.col(credential) & F.col(provenance) & (F.col(revision) == pinned) & (F.col(model) == pinned)


def promote(threshold: Column | float, score: str = "c_score", affirms: str = "family_s_affirms") -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.col(affirms) & (F.col(score) < t)


def score_job(scored: DataFrame, phase: str, threshold: float | None) -> DataFrame:
    """Score records of one phase in label-blind hash order; calibration may not see a threshold."""
    if phase == "calibration" and threshold is not None:
        raise ValueError("calibration may not use a threshold")
    if phase != "calibration" and threshold is None:
        raise ValueError(f"{phase} needs a threshold")
    decided = F.lit(None).cast("boolean") if threshold is None else promote(threshold)
    return scored.filter(F.col("phase") == phase).select(
        "phase", tx.domain_hash("vislens-item", "id").alias("item_key"), "family_s_affirms", "c_score", decided.alias("promote"), "service_ns"
    )
