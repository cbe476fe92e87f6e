"""Registered queries: experiment planning tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.functions.text import domain_hash
from vislens.operators import design as de
from vislens.operators.cohort import hash_ordered_take
from vislens.operators.eligibility import seeded_hash
from vislens.operators.lifecycle import CELL, DAY_US
from vislens.operators.ordered import hash_chunk, rank_by, time_chunk
from vislens.plans import workload as wl
from vislens.plans.registry import cte, query
from vislens.sources import tables as src

C = "backlog, baseline, arm"


@query(
    "round_robin_select",
    """SELECT id, topic, variant, slot FROM (SELECT id, topic, variant, ((rn - 1) * 2 + variant) * (SELECT count(DISTINCT topic) FROM w_items) + topic AS slot FROM (
  SELECT id, topic, id % 2 AS variant, row_number() OVER (PARTITION BY topic, id % 2 ORDER BY sha256('rr|' || id), id) AS rn FROM w_items)) WHERE slot < (SELECT count(*) // 5 FROM w_items)""",
)
def round_robin_select(spark, d):
    it = src.items(spark, d)
    base = it.select("id", "topic", (F.col("id") % 2).alias("variant"), domain_hash("rr", "id").alias("h"))
    n_topics = it.agg(F.count_distinct("topic")).scalar()
    want = it.agg(F.floor(F.count(F.lit(1)) / 5)).scalar()
    rr = de.round_robin(base, "topic", n_topics, "variant", 2, "h", "id")
    return rr.filter(F.col("slot") < want).select("id", "topic", "variant", "slot")


@query(
    "interleave_strata",
    """SELECT topic, id, hard, CASE WHEN rn <= least(a, b) THEN 2 * rn - 1 + hard::INT ELSE least(a, b) + rn END AS position FROM (SELECT topic, id, src < 6 AS hard, row_number() OVER (PARTITION BY topic, src < 6 ORDER BY sha256('il|' || id), id) AS rn,
  count(*) FILTER (WHERE src >= 6) OVER (PARTITION BY topic) AS a, count(*) FILTER (WHERE src < 6) OVER (PARTITION BY topic) AS b FROM w_items)""",
)
def interleave_strata(spark, d):
    it = src.items(spark, d).select("topic", "id", (F.col("src") < 6).alias("hard"), domain_hash("il", "id").alias("h"))
    return de.interleave(it, ["topic"], "hard", "h", "id").select("topic", "id", "hard", "position")


@query(
    "assign_donors",
    """SELECT o.id AS owner, o.id AS own, h.id AS heldout, n.id AS next_topic FROM w_items o
LEFT JOIN (SELECT a.id AS oid, b.id, row_number() OVER (PARTITION BY a.id ORDER BY sha256('heldout|' || a.id || '|' || b.id), b.id) AS rn FROM w_items a JOIN w_items b ON a.topic = b.topic AND a.slot = 0 AND b.slot = 1) h ON h.oid = o.id AND h.rn = 1
LEFT JOIN (SELECT a.id AS oid, b.id, row_number() OVER (PARTITION BY a.id ORDER BY sha256('next|' || a.id || '|' || b.id), b.id) AS rn FROM w_items a JOIN w_items b ON b.topic = (a.topic + 1) % (SELECT count(DISTINCT topic) FROM w_items) AND a.slot = 0 AND b.slot = 1) n ON n.oid = o.id AND n.rn = 1 WHERE o.slot = 0""",
)
def assign_donors(spark, d):
    """Own, held-out and next-topic donor of every owner: of all candidates the one whose hash with the owner is smallest."""
    it = src.items(spark, d)
    n = it.agg(F.count_distinct("topic")).scalar()
    owners = it.filter("slot = 0").select(F.col("id").alias("owner"), F.col("topic").alias("group"), ((F.col("topic") + 1) % n).alias("next"))
    donors = it.filter("slot = 1").select(F.col("id").alias("donor"), F.col("topic").alias("group"))
    held = de.smallest_pair_hash(owners, donors, "heldout").withColumnRenamed("donor", "heldout")
    nxt = de.smallest_pair_hash(owners, donors, "next", owner_group="next").withColumnRenamed("donor", "next_topic")
    return owners.select("owner", F.col("owner").alias("own")).join(held, "owner", "left").join(nxt, "owner", "left")


cte("w_grid", f"SELECT seed, attack, {C}, count(*) AS items, count(*) FILTER (WHERE poison) AS poison FROM w_plan GROUP BY ALL")


def grid(spark, d):
    return wl.plan(spark, d).groupBy("seed", "attack", *CELL).agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("poison"), 1)).alias("poison"))


@query("runtime_grid", f"SELECT seed, attack, {C}, items, poison FROM w_grid")
def runtime_grid(spark, d):
    """Seeds x attacks x loads x (policy, arm): 20 units of 7 arms, with the items of each cell."""
    return grid(spark, d)


@query("execution_order", f"SELECT seed, attack, {C}, row_number() OVER (PARTITION BY seed ORDER BY sha256('order|' || seed || '|' || attack || '|' || backlog || '|' || baseline || '|' || arm)) AS position FROM w_grid")
def execution_order(spark, d):
    g = grid(spark, d).withColumn("h", domain_hash("order", "seed", "attack", *CELL))
    return rank_by(g, ["seed"], hash_chunk("h", 1), [F.col("h")], "position").select("seed", "attack", *CELL, "position")


@query(
    "injection_sequence",
    "SELECT seed, attack, item_id, role, row_number() OVER (PARTITION BY seed, attack ORDER BY CASE role WHEN 'filler' THEN 0 WHEN 'poison' THEN 1 ELSE 2 END, arrival_us, item_id) AS ordinal FROM w_adm",
)
def injection_sequence(spark, d):
    a = wl.admissions(spark, d).select("seed", "attack", "item_id", "role", "arrival_us")
    order = F.when(F.col("role") == "filler", 0).when(F.col("role") == "poison", 1).otherwise(2).cast("bigint")
    return de.ordered_injection(a, ["seed", "attack"], order, "arrival_us", "item_id", DAY_US).select("seed", "attack", "item_id", "role", "ordinal")


@query("nested_promotions", "SELECT seed, k.k, item_id, rn AS position FROM (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY sha256('70' || '|' || item_id), item_id) AS rn FROM w_adm WHERE poison) JOIN (VALUES (1), (2), (3)) k(k) ON rn <= k.k")
def nested_promotions(spark, d):
    """One hash permutation of the poison items per seed; the set for k is its first k."""
    a = wl.admissions(spark, d).filter("poison").withColumn("h", F.struct(seeded_hash(70, "item_id"), "item_id"))
    top = hash_ordered_take(a, ["seed"], "h", 3)
    return top.select("seed", F.explode(F.sequence(F.col("rank"), F.lit(3))).alias("k"), "item_id", F.col("rank").alias("position"))


@query(
    "query_schedule",
    "SELECT user_id, item_id, i, CAST(round(i * (1000000.0 / 24)) AS BIGINT) AS target_us, CASE i % 3 WHEN 0 THEN 'attack_associated' WHEN 1 THEN 'heldout_same_topic' ELSE 'negative_other_topic' END AS role, (i // 3) % 8 AS query_ordinal FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY arrival_us, item_id) - 1 AS i FROM w_adm WHERE event_type = 'view')",
)
def query_schedule(spark, d):
    v = wl.admissions(spark, d).filter("event_type = 'view'").select("user_id", "item_id", "arrival_us")
    r = rank_by(v, ["user_id"], time_chunk("arrival_us", DAY_US), [F.col("arrival_us"), F.col("item_id")], "r").withColumn("i", F.col("r") - 1)
    s = de.schedule(r, "i", 24.0, ("attack_associated", "heldout_same_topic", "negative_other_topic"), 8)
    return s.select("user_id", "item_id", "i", "target_us", "role", "query_ordinal")


@query(
    "landing_plan",
    "SELECT p.id AS item_key, 'F' || (p.id % 3) AS attack_family, p.id - 1 AS query_item_key, (SELECT count(*) FROM w_items WHERE slot >= 3) AS background, row_number() OVER (ORDER BY sha256('landing|' || p.id)) AS position FROM w_items p JOIN w_items q ON q.id = p.id - 1 AND q.slot = 1 WHERE p.slot = 2",
)
def landing_plan(spark, d):
    it = src.items(spark, d)
    own = it.filter("slot = 1").select((F.col("id") + 1).alias("item_key"), F.col("id").alias("query_item_key"))
    p = it.filter("slot = 2").select(F.col("id").alias("item_key")).join(own, "item_key").withColumn("h", domain_hash("landing", "item_key"))
    n = it.agg(F.count(F.when(F.col("slot") >= 3, 1))).scalar()
    r = rank_by(p, [], hash_chunk("h"), [F.col("h")], "position")
    return r.select("item_key", F.concat(F.lit("F"), F.col("item_key") % 3).alias("attack_family"), "query_item_key", n.alias("background"), "position")


cte("w_exec", f"SELECT seed, attack, {C}, items, poison, row_number() OVER (PARTITION BY seed ORDER BY sha256('order|' || seed || '|' || attack || '|' || backlog || '|' || baseline || '|' || arm)) AS position FROM w_grid")


@query(
    "plan_violations",
    """SELECT scope, rule FROM (SELECT 'seed ' || seed AS scope, unnest(list_filter([CASE WHEN count(*) <> 28 THEN 'cells' END, CASE WHEN min(position) <> 1 OR max(position) <> 28 OR count(DISTINCT position) <> count(*) THEN 'positions' END, CASE WHEN count(DISTINCT items) > 2 THEN 'unequal_items' END,
  CASE WHEN sum(poison) % 14 <> 0 THEN 'poison_not_shared' END, CASE WHEN min(poison) < 200 THEN 'few_poison' END], lambda r: r IS NOT NULL)) AS rule FROM w_exec GROUP BY seed)""",
)
def plan_violations(spark, d):
    """28 cells and positions 1..28 per seed, the same items in every arm of a unit, enough poison."""
    g = grid(spark, d).withColumn("h", domain_hash("order", "seed", "attack", *CELL))
    p = rank_by(g, ["seed"], hash_chunk("h", 1), [F.col("h")], "position")
    agg = p.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("np"), F.count_distinct("items").alias("ni"),
        F.sum("poison").alias("sp"), F.min("poison").alias("mp"),
    )
    from vislens.operators.quality import broken_rules

    rules = {
        "cells": F.col("n") != 28, "positions": (F.col("lo") != 1) | (F.col("hi") != 28) | (F.col("np") != F.col("n")), "unequal_items": F.col("ni") > 2,
        "poison_not_shared": F.col("sp") % 14 != 0, "few_poison": F.col("mp") < 200,
    }
    return broken_rules(agg.withColumn("scope", F.concat(F.lit("seed "), "seed")), ["scope"], rules)
