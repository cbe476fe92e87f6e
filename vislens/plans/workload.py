"""Lifecycle workload derived from `events`: admissions, verifier queue, policy cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.operators import lifecycle as lc
from vislens.plans.registry import cte
from vislens.sources import tables as src

TP_US = 600_000_000
LOADS = {"normal": 4, "heavy": 20}

cte(
    "w_adm",
    """SELECT event_id AS item_id, epoch_us(ts) AS arrival_us, user_id // 20 AS lane, CAST(round(value * 1e6) AS BIGINT) AS val_us, user_id % 17 <> 0 AS source_ok,
  event_type = 'error' AS poison, CASE WHEN event_type = 'purchase' AND user_id % 10 = 0 THEN epoch_us(ts) + 3600000000 END AS revoke_us,
  CASE WHEN event_type = 'error' THEN 'poison' WHEN event_type = 'signup' THEN 'filler' ELSE 'clean' END AS role, event_id % 3 = 0 AS landed,
  CASE WHEN event_id % 2 = 0 THEN 'recipe' ELSE 'cover' END AS attack, CAST(event_id % 5 AS INTEGER) AS seed,
  CASE WHEN event_type = 'error' THEN (event_id * 7919) % 256 < 64 ELSE (event_id * 7919) % 256 >= 32 END AS detector_promote, user_id, event_type FROM events""",
)
cte("w_hor", "SELECT max(epoch_us(ts)) AS horizon_us, min(epoch_us(ts)) AS start_us FROM events")
cte(
    "w_fifo",
    """SELECT *, s + max(arrival_us - (s - service_us)) OVER (PARTITION BY backlog, lane ORDER BY arrival_us, item_id) AS commit_us FROM (
  SELECT a.*, b.backlog, val_us * b.mult AS service_us, sum(val_us * b.mult) OVER (PARTITION BY b.backlog, lane ORDER BY arrival_us, item_id) AS s
  FROM w_adm a CROSS JOIN (VALUES ('normal', 4), ('heavy', 20)) b(backlog, mult) WHERE source_ok)""",
)
cte(
    "w_plan",
    """SELECT a.item_id, a.arrival_us, a.lane, a.source_ok, a.poison, a.revoke_us, a.role, a.landed, a.attack, a.seed, a.detector_promote, b.backlog, c.baseline, c.arm,
  c.baseline <> 'B1' AS verify, c.baseline = 'B2' AS sync, CASE WHEN c.arm = 'oracle' THEN NOT a.poison ELSE a.detector_promote END AS passes,
  f.commit_us::BIGINT AS commit_us, (f.commit_us - f.service_us)::BIGINT AS vstart_us, f.service_us, CASE WHEN c.baseline = 'B4' AND a.source_ok THEN a.arrival_us + 600000000 END AS deadline_us, h.horizon_us
  FROM w_adm a CROSS JOIN (VALUES ('normal'), ('heavy')) b(backlog) CROSS JOIN (VALUES ('B1', 'oracle'), ('B2', 'oracle'), ('B2', 'detector'), ('B3', 'oracle'), ('B3', 'detector'), ('B4', 'oracle'), ('B4', 'detector')) c(baseline, arm)
  CROSS JOIN w_hor h LEFT JOIN w_fifo f ON f.backlog = b.backlog AND f.item_id = a.item_id""",
)
cte(
    "w_tr_all",
    """SELECT *, row_number() OVER (PARTITION BY backlog, baseline, arm, item_id ORDER BY ord) - 1 AS seq FROM (
  SELECT backlog, baseline, arm, item_id, 0 AS ord, arrival_us AS t_us, NULL::VARCHAR AS old_state, 'QUARANTINED' AS new_state FROM w_plan WHERE NOT source_ok
  UNION ALL SELECT backlog, baseline, arm, item_id, 1, arrival_us, NULL, 'PROVISIONAL' FROM w_plan WHERE source_ok AND NOT sync
  UNION ALL SELECT backlog, baseline, arm, item_id, 2, deadline_us, 'PROVISIONAL', 'HIDDEN' FROM w_plan WHERE source_ok AND verify AND commit_us > deadline_us
  UNION ALL SELECT backlog, baseline, arm, item_id, 3, commit_us, CASE WHEN sync THEN NULL WHEN commit_us > deadline_us THEN 'HIDDEN' ELSE 'PROVISIONAL' END,
    CASE WHEN passes THEN 'TRUSTED' ELSE 'QUARANTINED' END FROM w_plan WHERE source_ok AND verify
  UNION ALL SELECT backlog, baseline, arm, item_id, 4, revoke_us, 'TRUSTED', 'REVOKED' FROM w_plan WHERE source_ok AND verify AND passes AND revoke_us >= commit_us)""",
)
cte(
    "w_span",
    """SELECT t.*, coalesce(lead(t_us) OVER (PARTITION BY backlog, baseline, arm, item_id ORDER BY seq), horizon_us) AS end_us,
  new_state IN ('PROVISIONAL', 'TRUSTED') AS vis, coalesce(old_state IN ('PROVISIONAL', 'TRUSTED'), false) AS was_vis, horizon_us FROM w_tr_all t CROSS JOIN w_hor WHERE t_us <= horizon_us""",
)
cte(
    "w_facts",
    """SELECT p.*, f.* EXCLUDE (backlog, baseline, arm, item_id), coalesce(f.vu, 0)::BIGINT AS visible_us FROM w_plan p LEFT JOIN (
  SELECT backlog, baseline, arm, item_id, arg_max(new_state, seq) AS state_end, min(t_us) FILTER (WHERE vis) AS first_visible_us, count(*) FILTER (WHERE vis AND NOT was_vis) AS visible_entries,
    min(t_us) FILTER (WHERE was_vis AND NOT vis) AS contain_us, max(t_us) FILTER (WHERE was_vis AND NOT vis) AS last_withdraw_us, min(t_us) FILTER (WHERE new_state = 'HIDDEN') AS hide_at_us,
    min(t_us) FILTER (WHERE new_state = 'TRUSTED') AS trusted_us, min(t_us) FILTER (WHERE new_state = 'QUARANTINED') AS quarantine_us,
    min(t_us) FILTER (WHERE vis AND NOT was_vis AND old_state IS NOT NULL) AS readmit_us, min(t_us) FILTER (WHERE new_state = 'PROVISIONAL') AS prov_start_us,
    min(t_us) FILTER (WHERE old_state = 'PROVISIONAL') AS prov_end_us, count(*) FILTER (WHERE new_state = 'PROVISIONAL') AS prov_entries, sum(end_us - t_us) FILTER (WHERE vis) AS vu
  FROM w_span GROUP BY ALL) f ON f.backlog = p.backlog AND f.baseline = p.baseline AND f.arm = p.arm AND f.item_id = p.item_id""",
)
cte(
    "w_life",
    """SELECT *, coalesce(state_end IN ('PROVISIONAL', 'TRUSTED'), false) AS vis_end, horizon_us - arrival_us - visible_us AS unavailable_us,
  CASE WHEN first_visible_us IS NULL THEN 'NOT_STARTED' WHEN state_end IN ('PROVISIONAL', 'TRUSTED') THEN 'RIGHT_CENSORED' ELSE 'COMPLETED' END AS exposure_status,
  CASE WHEN prov_start_us IS NULL THEN 'NOT_STARTED' WHEN prov_end_us IS NOT NULL THEN 'COMPLETED' ELSE 'RIGHT_CENSORED' END AS unvetted_status,
  coalesce(prov_end_us, horizon_us) - prov_start_us AS unvetted_us,
  CASE WHEN NOT coalesce(state_end IN ('PROVISIONAL', 'TRUSTED'), false) THEN 'RIGHT_CENSORED' WHEN horizon_us - arrival_us - visible_us > 0 THEN 'COMPLETED' ELSE 'NOT_STARTED' END AS unavailable_status,
  CASE WHEN state_end = 'QUARANTINED' THEN 'RIGHT_CENSORED' WHEN quarantine_us IS NOT NULL THEN 'COMPLETED' ELSE 'NOT_STARTED' END AS quarantine_status FROM w_facts""",
)


def admissions(spark, d):
    e = src.table(spark, d, "events")
    t = src.micros(e, "ts")
    bucket = F.col("event_id") * 7919 % 256
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("item_id"),
        t.alias("arrival_us"),
        F.floor(F.col("user_id") / 20).alias("lane"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("val_us"),
        (F.col("user_id") % 17 != 0).alias("source_ok"),
        bad.alias("poison"),
        F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 10 == 0), t + 3_600_000_000).alias("revoke_us"),
        F.when(bad, "poison").when(F.col("event_type") == "signup", "filler").otherwise("clean").alias("role"),
        (F.col("event_id") % 3 == 0).alias("landed"),
        F.when(F.col("event_id") % 2 == 0, "recipe").otherwise("cover").alias("attack"),
        (F.col("event_id") % 5).cast("int").alias("seed"),
        F.when(bad, bucket < 64).otherwise(bucket >= 32).alias("detector_promote"),
        "user_id",
        "event_type",
    )


def horizon(spark, d):
    e = src.table(spark, d, "events")
    return e.agg(F.max(src.micros(e, "ts"))).scalar()


def start(spark, d):
    e = src.table(spark, d, "events")
    return e.agg(F.min(src.micros(e, "ts"))).scalar()


def queued(spark, d):
    """Verifier queue of every admissible item under both loads."""
    loads = F.array(*[F.struct(F.lit(n).alias("backlog"), F.lit(m).alias("mult")) for n, m in LOADS.items()])
    a = admissions(spark, d).withColumn("__l", F.explode(loads)).select("*", "__l.*").drop("__l")
    # A refused item takes no service and its arrival cannot delay a later one.
    a = a.withColumn("service_us", F.when(F.col("source_ok"), F.col("val_us") * F.col("mult")).otherwise(0)).drop("mult")
    q = lc.fifo_queue(a, ["backlog", "lane"])
    return q.withColumns({c: F.when(F.col("source_ok"), F.col(c)) for c in ("service_us", "start_us", "commit_us")})


ARMS = {"oracle": lambda: ~F.col("poison"), "detector": lambda: F.col("detector_promote")}


def plan(spark, d, baselines=None, only=None, probes=None):
    """Every item under every policy cell; with `only` (item_id), these items alone, after the queue they all share.

    With `probes` (item_id and more), a row for each probe of an item: rows meet before they are put under the cells, of which there are many.
    """
    q = queued(spark, d)
    if only is not None:
        q = q.join(only, "item_id", "left_semi")
    if probes is not None:
        q = q.join(probes, "item_id")
    p = lc.policy_cells(q, {n: passes() for n, passes in ARMS.items()})
    if baselines:
        p = p.filter(F.col("baseline").isin(*baselines))
    return p.withColumn("horizon_us", horizon(spark, d))


def ledger(spark, d, baselines=None, only=None, probes=None):
    return lc.ledger(plan(spark, d, baselines, only, probes), TP_US)


def facts(spark, d, baselines=None, only=None):
    return lc.with_facts(ledger(spark, d, baselines, only))


def cells(baselines=None) -> list[tuple[str, str, str]]:
    """(backlog, baseline, arm) of every policy cell of the plan."""
    return [(load, b, arm) for load in LOADS for b, arm in lc.policy_arms(ARMS) if not baselines or b in baselines]
