"""Registered queries that drain a stream over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.plans.registry import query
from vislens.plans.workload import TP_US
from vislens.sources import tables as src
from vislens.streaming import log_streams as ls
from vislens.streaming.lifecycle_stream import lifecycle_stream as run_lifecycle


def lifecycle_events(e):
    """admit, verdict and revoke rows of every event, with an unqueued verifier."""
    t = src.micros(e, "ts")
    base = e.select(
        F.col("event_id").alias("item_id"), t.alias("arrival_us"), (F.col("user_id") % 17 != 0).alias("source_ok"), (F.col("event_type") != "error").alias("passes"),
        (t + F.round(F.col("value") * 1e6).cast("bigint") * 20).alias("commit_us"),
        F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 10 == 0), t + 3_600_000_000).alias("revoke_us"),
    )
    step = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("t_us"))
    steps = F.array(
        step("admit", F.col("arrival_us")), F.when(F.col("source_ok"), step("verdict", F.col("commit_us"))), F.when(F.col("revoke_us").isNotNull(), step("revoke", F.col("revoke_us")))
    )
    x = base.select("item_id", "source_ok", "passes", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("item_id", "source_ok", "passes", "s.*")
    return x.withColumn("ts", F.timestamp_micros("t_us"))


@query(
    "lifecycle_stream",
    """SELECT item_id, t_us, old_state, new_state FROM (
  SELECT item_id, arrival_us AS t_us, NULL::VARCHAR AS old_state, CASE WHEN source_ok THEN 'PROVISIONAL' ELSE 'QUARANTINED' END AS new_state FROM w_adm
  UNION ALL SELECT item_id, arrival_us + 600000000, 'PROVISIONAL', 'HIDDEN' FROM w_adm WHERE source_ok AND val_us * 20 > 600000000
  UNION ALL SELECT item_id, arrival_us + val_us * 20, CASE WHEN val_us * 20 > 600000000 THEN 'HIDDEN' ELSE 'PROVISIONAL' END, CASE WHEN poison THEN 'QUARANTINED' ELSE 'TRUSTED' END FROM w_adm WHERE source_ok
  UNION ALL SELECT item_id, revoke_us, 'TRUSTED', 'REVOKED' FROM w_adm WHERE source_ok AND NOT poison AND revoke_us >= arrival_us + val_us * 20)""",
)
def lifecycle_stream(spark, d):
    return ls.run_to_table(run_lifecycle(lifecycle_events(ls.read_table_stream(spark, d, "events")), TP_US))


@query(
    "prr_stream",
    "SELECT CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS day, count(*) AS n, count(*) FILTER (WHERE value > 50) AS hits FROM events WHERE event_type = 'view' GROUP BY 1",
)
def prr_stream(spark, d):
    e = ls.read_table_stream(spark, d, "events").filter("event_type = 'view'")
    log = e.select(F.timestamp_micros(src.micros(e, "ts")).alias("ts"), (F.col("value") > 50).alias("hit"))
    out = ls.run_to_table(ls.prr_stream(log, "1 day"), keys=["start"])
    return out.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", "hits")


@query(
    "stale_read_stream",
    """WITH ch AS (SELECT item_id, arrival_us AS t_us, event_type = 'error' AS gone FROM w_adm WHERE event_type IN ('error', 'signup')
  UNION ALL SELECT item_id, arrival_us + 3600000000, false FROM w_adm WHERE event_type = 'error' AND item_id % 3 = 0),
r AS (SELECT item_id AS probe, item_id - 10 AS item_id, arrival_us AS t_us FROM w_adm WHERE event_type = 'view' UNION ALL SELECT item_id, item_id - 10, arrival_us + 172800000000 FROM w_adm WHERE event_type = 'view' AND item_id % 5 = 0)
SELECT probe, item_id, t_us, withdrawn_us FROM (SELECT r.*, ch.t_us AS withdrawn_us, ch.gone, row_number() OVER (PARTITION BY r.probe, r.item_id, r.t_us ORDER BY ch.t_us DESC, ch.gone DESC) AS n FROM r JOIN ch ON ch.item_id = r.item_id AND ch.t_us <= r.t_us) WHERE n = 1 AND gone""",
)
def stale_read_stream(spark, d):
    """Every view returns the tenth item before it, every fifth view again two days later.

    Error items are withdrawn at their own time; every third comes back after an
    hour. No return is too long after its withdrawal to be found.
    """
    e = ls.read_table_stream(spark, d, "events")
    t = src.micros(e, "ts")
    step = lambda cond, kind, item, at: F.when(cond, F.struct(F.lit(kind).alias("kind"), item.alias("item_id"), at.alias("t_us")))
    own, error, view = F.col("event_id"), F.col("event_type") == "error", F.col("event_type") == "view"
    steps = F.array(
        step(error, "withdraw", own, t), step(F.col("event_type") == "signup", "readmit", own, t), step(error & (own % 3 == 0), "readmit", own, t + 3_600_000_000),
        step(view, "return", own - 10, t), step(view & (own % 5 == 0), "return", own - 10, t + 172_800_000_000),
    )
    rows = e.select(own.alias("probe"), F.explode(F.array_compact(steps)).alias("s")).select("probe", "s.*").withColumn("ts", F.timestamp_micros("t_us"))
    return ls.standing(ls.run_to_table(ls.stale_read_stream(rows))).select("probe", "item_id", "t_us", "withdrawn_us")


@query("current_state_table", "SELECT user_id AS id, arg_max(event_type <> 'error', event_id) AS visible, max(event_id) AS seq FROM events GROUP BY 1")
def current_state_table(spark, d):
    e = ls.read_table_stream(spark, d, "events")
    updates = e.select(F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("visible"), F.col("event_id").alias("seq"))
    return ls.run_to_table(updates, keys=["id"], order="seq")
