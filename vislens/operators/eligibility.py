"""Hidden-set workloads, their evaluation, and containment by lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.functions.stats import count_if, ratio
from vislens.operators.ordered import hash_chunk, quantiles, rank_by, take_top
from vislens.operators.similarity import max_similarity, topk


def hide_count(items: DataFrame, fraction: float) -> DataFrame:
    return items.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint").alias("n"))


def seeded_hash(seed, key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("|", s.cast("string"), k.cast("string")), 256)


def hide_random(items: DataFrame, fraction: float, seeds: tuple[int, ...]) -> DataFrame:
    """(seed, id): the first n ids of each seed's hash order."""
    hashed = items.select("id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    hashed = hashed.withColumn("h", seeded_hash(F.col("seed"), "id"))
    ranked = rank_by(hashed, ["seed"], hash_chunk("h", 3), [F.col("h"), F.col("id")])
    return ranked.filter(F.col("rank") <= hide_count(items, fraction).scalar()).select("seed", "id")


def hide_near(items: DataFrame, anchors: DataFrame, fraction: float) -> DataFrame:
    """(tag, id): per anchor tag, the given fraction of items closest to any anchor.

    anchors: tag, vector.  All tags are scored in one pass over the items.
    """
    scored = max_similarity(items, anchors, anchor_tag="tag")
    return take_top(scored, ["tag"], "score", "id", hide_count(items, fraction).scalar()).select("tag", "id")


def anchors_of(queries: DataFrame, tag: str) -> DataFrame:
    return queries.select(F.lit(tag).alias("tag"), F.col("qvec").alias("vector"))


def cluster_anchors(items: DataFrame, seeds: tuple[int, ...], n: int = 5, prefix: str = "") -> DataFrame:
    """`n` seed vectors per seed, the first in hash order."""
    out = None
    for s in seeds:
        one = items.orderBy(seeded_hash(s, "id"), "id").limit(n).select(F.lit(f"{prefix}{s}").alias("tag"), "vector")
        out = one if out is None else out.unionByName(one)
    return out


def hidden_tags(hidden: DataFrame, tag: str) -> DataFrame:
    """(id, gone): the tags that hide an item, as one array bounded by their number."""
    return hidden.groupBy("id").agg(F.collect_set(tag).alias("gone"))


def evaluate(
    queries: DataFrame, items: DataFrame, hidden: DataFrame, tags: list[str], k: int, over_fetch: tuple[int, ...]
) -> DataFrame:
    """Per (tag, over_fetch): under-fill, pool occupancy and recalls.

    hidden: (tag, id).  Search runs once at the largest pool; smaller pools are
    prefixes of it.
    """
    raw = topk(queries, items, k * max(over_fetch)).select("query_id", "id", "score", "rank")
    tag_list = F.array(*[F.lit(t) for t in tags])
    marked = items.select("id", "vector").join(hidden_tags(hidden, "tag"), "id", "left")
    truth = topk(queries, marked, k, hidden="gone", hidden_tags=tags).select("tag", "query_id", "id").withColumn("in_truth", F.lit(1))
    raw_tagged = raw.withColumn("tag", F.explode(tag_list))
    flagged = raw_tagged.join(hidden.withColumn("hid", F.lit(1)), ["tag", "id"], "left").join(
        truth, ["tag", "query_id", "id"], "left"
    )
    pools = flagged.withColumn("over_fetch", F.explode(F.array(*[F.lit(o) for o in over_fetch]))).filter(
        F.col("rank") <= F.col("over_fetch") * k
    )
    # Eligible rank inside the pool: at most k*over_fetch rows per query.
    w = W.partitionBy("tag", "over_fetch", "query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    pools = pools.withColumn("elig_rank", F.when(F.col("hid").isNull(), F.sum(F.when(F.col("hid").isNull(), 1).otherwise(0)).over(w)))
    kept = F.col("elig_rank") <= k
    per_query = pools.groupBy("tag", "over_fetch", "query_id").agg(
        F.count(F.lit(1)).alias("pool"),
        count_if(F.col("hid").isNotNull()).alias("n_hidden"),
        count_if(kept).alias("n_kept"),
        count_if(kept & F.col("in_truth").isNotNull()).alias("n_correct"),
    )
    n_truth = truth.groupBy("tag", "query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    return per_query.join(n_truth, ["tag", "query_id"], "left").select(
        "tag",
        "over_fetch",
        "query_id",
        "n_kept",
        "n_correct",
        F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
        F.round(ratio(F.col("n_hidden"), F.greatest(F.col("pool"), F.lit(1))), 9).alias("h"),
        (F.col("n_hidden") * F.col("over_fetch") > F.col("pool") * (F.col("over_fetch") - 1)).alias("exceed"),
    )


def eligibility_metrics(per_query: DataFrame, k: int) -> DataFrame:
    keys = ["tag", "over_fetch"]
    full = F.col("n_kept") == k
    tail = quantiles(per_query, keys, "h", {"hm50": 0.50, "hm90": 0.90, "hm95": 0.95}, nearest=True)
    n = F.count(F.lit(1))
    agg = per_query.groupBy(*keys).agg(
        n.alias("n_queries"),
        ratio(count_if(F.col("n_kept") < k), n).alias("underfill"),
        ratio(count_if(F.col("exceed")), n).alias("exceed"),
        ratio(F.sum("n_kept"), n * k).alias("fill"),
        ratio(F.sum("n_correct"), n * k).alias("pf_recall"),
        ratio(F.sum(F.when(full, F.col("n_correct"))), count_if(full) * k).alias("cond_recall"),
        F.coalesce(F.sum(F.when(full, F.col("n_correct"))), F.lit(0)).alias("cond_correct"),
        count_if(full).alias("full_k"),
        ratio(F.sum("n_truth"), n * k).alias("if_recall"),
    )
    return agg.join(tail, keys)


def revoked_sets(items: DataFrame) -> DataFrame:
    """(granularity, id) for source-, batch- and item-level revocation of poisoned lineage."""
    bad = items.filter("poisoned")
    source = items.join(bad.select("src").distinct(), "src", "left_semi")
    batch = items.join(bad.select("src", "batch").distinct(), ["src", "batch"], "left_semi")
    tag = lambda df, g: df.select(F.lit(g).alias("granularity"), "id")
    return tag(source, "source").unionByName(tag(batch, "batch")).unionByName(tag(bad, "lineage"))


def containment_cost(items: DataFrame, revoked: DataFrame) -> DataFrame:
    n_poison = items.agg(count_if(F.col("poisoned"))).scalar()
    agg = revoked.join(items.select("id", "poisoned"), "id").groupBy("granularity").agg(
        F.count(F.lit(1)).alias("n_revoked"), count_if(F.col("poisoned")).alias("n_caught")
    )
    return agg.select(
        "granularity",
        "n_revoked",
        "n_caught",
        (F.col("n_caught") / F.greatest(n_poison, F.lit(1))).alias("caught"),
        ((F.col("n_revoked") - F.col("n_caught")) / F.greatest(F.col("n_revoked"), F.lit(1))).alias("collateral"),
    )


def residual_exposure(items: DataFrame, revoked: DataFrame, k: int, over_fetch: int = 2, applied: DataFrame | None = None) -> DataFrame:
    """Revoked items still returned to their own vector as query, per granularity.

    `applied` holds the revocations that the index has carried out, by default all.
    """
    applied = revoked if applied is None else applied
    probes = items.join(revoked.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("query_id"), F.col("vector").alias("qvec")
    )
    raw = topk(probes, items, k * over_fetch).select("query_id", "id", "rank")
    own_raw = raw.filter((F.col("id") == F.col("query_id")) & (F.col("rank") <= k)).select(F.col("id"), F.lit(1).alias("raw_hit"))
    names = ("source", "batch", "lineage")
    grains = F.array(*[F.lit(g) for g in names])
    visible = items.select("id", "vector").join(hidden_tags(applied, "granularity"), "id", "left")
    inf = topk(probes, visible, k, hidden="gone", hidden_tags=names).filter(F.col("id") == F.col("query_id")).select(
        F.col("tag").alias("granularity"), "id", F.lit(1).alias("if_hit")
    )
    survivors = raw.withColumn("granularity", F.explode(grains)).join(applied, ["granularity", "id"], "left_anti")
    pf = survivors.filter(F.col("id") == F.col("query_id")).select("granularity", "id", F.lit(1).alias("pf_hit"))
    return (
        revoked.join(own_raw, "id", "left")
        .join(inf, ["granularity", "id"], "left")
        .join(pf, ["granularity", "id"], "left")
        .groupBy("granularity")
        .agg(
            F.count(F.lit(1)).alias("probes"),
            F.count("raw_hit").alias("raw_hits"),
            ratio(F.count("pf_hit"), F.count(F.lit(1))).alias("res_pf"),
            ratio(F.count("if_hit"), F.count(F.lit(1))).alias("res_if"),
        )
    )
