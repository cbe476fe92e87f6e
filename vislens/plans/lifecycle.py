"""Registered queries: verifier queue, policies, transition log and lifecycle metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.functions.stats import count_if, rate_columns, ratio, whole_sum
from vislens.operators import lifecycle as lc
from vislens.operators.lifecycle import CELL, is_visible
from vislens.operators.ordered import quantiles
from vislens.plans import workload as wl
from vislens.plans.registry import cte, query
from vislens.plans.retrieval import wilson_sql
from vislens.session import cut_lineage

DAY = lc.DAY_US
C = "backlog, baseline, arm"


def quantile_table(df, keys, value, prefix, probs=((50, 0.5),), with_max=True, nearest=False):
    """n, p.. and max columns named with a prefix."""
    q = quantiles(df, keys, value, {f"{prefix}_p{n}": p for n, p in probs}, stats=True, nearest=nearest)
    cols = [F.col("n").alias(f"{prefix}_n")] + [F.round(f"{prefix}_p{n}", 3).alias(f"{prefix}_p{n}") for n, _ in probs]
    if with_max:
        cols.append(F.col("max").alias(f"{prefix}_max"))
    return q.select(*keys, *cols)


# ---- admission and transitions


@query("admission_gate", f"SELECT {C}, coalesce(CASE WHEN NOT source_ok THEN 'QUARANTINED' WHEN sync THEN NULL ELSE 'PROVISIONAL' END, 'NONE') AS state, count(*) AS n FROM w_plan GROUP BY ALL")
def admission_gate(spark, d):
    g = lc.admission_gate(wl.plan(spark, d))
    return g.groupBy(*CELL, F.coalesce("admitted_state", F.lit("NONE")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "policy_transitions",
    f"SELECT {C}, coalesce(old_state, '-') AS old_state, new_state, count(*) AS n, CAST(sum(t_us % 1000000007) % 1000000007 AS BIGINT) AS t_check FROM w_tr_all GROUP BY ALL",
)
def policy_transitions(spark, d):
    log = lc.to_log(wl.ledger(spark, d), CELL + ["item_id"])
    return log.groupBy(*CELL, F.coalesce("old_state", F.lit("-")).alias("old_state"), "new_state").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("t_us") % 1000000007) % 1000000007).alias("t_check")
    )


@query("deadline_hide", "SELECT backlog, arm, item_id, t_us, t_us - arrival_us AS age_us FROM w_tr_all t JOIN w_adm USING (item_id) WHERE baseline = 'B4' AND new_state = 'HIDDEN'")
def deadline_hide(spark, d):
    log = lc.to_log(wl.ledger(spark, d, ["B4"]), ["backlog", "arm", "item_id", "arrival_us"])
    return log.filter(F.col("new_state") == "HIDDEN").select("backlog", "arm", "item_id", "t_us", (F.col("t_us") - F.col("arrival_us")).alias("age_us"))


@query(
    "commit_verdict",
    "SELECT backlog, arm, item_id, CASE WHEN commit_us <= deadline_us THEN 'direct' ELSE 'through_hidden' END || CASE WHEN passes THEN '_pass' ELSE '_fail' END AS route, commit_us - deadline_us AS lateness_us FROM w_plan WHERE baseline = 'B4' AND source_ok",
)
def commit_verdict(spark, d):
    led = wl.ledger(spark, d, ["B4"]).filter("source_ok")
    hidden = F.exists("trans", lambda x: x["new_state"] == "HIDDEN")
    final = F.filter("trans", lambda x: x["new_state"].isin("TRUSTED", "QUARANTINED"))
    route = F.concat(F.when(hidden, "through_hidden").otherwise("direct"), F.when(F.get(final, 0)["new_state"] == "TRUSTED", "_pass").otherwise("_fail"))
    return led.select("backlog", "arm", "item_id", route.alias("route"), (F.col("commit_us") - F.col("deadline_us")).alias("lateness_us"))


@query(
    "verdict_arms",
    """SELECT source, poison, count(*) AS n, count(*) FILTER (WHERE passes) AS promoted FROM (
  SELECT s.source, poison, CASE s.source WHEN 'oracle' THEN NOT poison WHEN 'detector' THEN detector_promote ELSE NOT poison OR fr <= 10 END AS passes
  FROM (SELECT *, row_number() OVER (PARTITION BY poison ORDER BY sha256('7001|' || item_id), item_id) AS fr FROM w_adm) CROSS JOIN (VALUES ('oracle'), ('detector'), ('forced')) s(source)) GROUP BY ALL""",
)
def verdict_arms(spark, d):
    """Oracle truth, detector decision, or oracle with a forced falsely promoted set."""
    from vislens.operators.eligibility import seeded_hash

    a = wl.admissions(spark, d)
    forced = a.filter("poison").orderBy(seeded_hash(7001, "item_id"), "item_id").limit(10).select("item_id", F.lit(True).alias("forced"))
    arms = F.array(
        F.struct(F.lit("oracle").alias("source"), (~F.col("poison")).alias("passes")),
        F.struct(F.lit("detector").alias("source"), F.col("detector_promote").alias("passes")),
        F.struct(F.lit("forced").alias("source"), (~F.col("poison") | F.col("forced").isNotNull()).alias("passes")),
    )
    return a.join(forced, "item_id", "left").select("poison", F.explode(arms).alias("a")).groupBy("a.source", "poison").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("a.passes")).alias("promoted")
    )


@query("revoke", f"SELECT {C}, item_id, t_us FROM w_tr_all WHERE new_state = 'REVOKED'")
def revoke(spark, d):
    log = lc.to_log(wl.ledger(spark, d), CELL + ["item_id"])
    return log.filter(F.col("new_state") == "REVOKED").select(*CELL, "item_id", "t_us")


@query("transition_log", "SELECT backlog, arm, item_id, CAST(seq AS INTEGER) AS seq, t_us, old_state, new_state FROM w_tr_all WHERE baseline = 'B4'")
def transition_log(spark, d):
    return lc.to_log(wl.ledger(spark, d, ["B4"]), ["backlog", "arm", "item_id"])


@query(
    "state_as_of",
    f"""SELECT {C}, g.day, coalesce(state, 'NONE') AS state, count(*) AS n FROM (SELECT p.backlog, p.baseline, p.arm, p.item_id, g.day, arg_max(t.new_state, t.seq) AS state
  FROM w_plan p CROSS JOIN (VALUES (7), (14), (21), (30)) g(day) CROSS JOIN w_hor h LEFT JOIN w_tr_all t ON t.backlog = p.backlog AND t.baseline = p.baseline AND t.arm = p.arm AND t.item_id = p.item_id AND t.t_us <= h.start_us + g.day * 86400000000 GROUP BY ALL) g GROUP BY ALL""",
)
def state_as_of(spark, d):
    led = wl.ledger(spark, d).withColumn("from_us", wl.start(spark, d))
    led = led.withColumn("day", F.explode(F.array(*[F.lit(x) for x in (7, 14, 21, 30)])))
    at = led.withColumn("as_of_us", F.col("from_us") + F.col("day") * DAY)
    state = lc.state_at(F.col("trans"), F.col("as_of_us"))
    return at.groupBy(*CELL, "day", F.coalesce(state, F.lit("NONE")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("visibility_intervals", "SELECT backlog, arm, item_id, t_us AS start_us, end_us, new_state AS state, vis AS visible FROM w_span WHERE baseline = 'B4'")
def visibility_intervals(spark, d):
    led = wl.ledger(spark, d, ["B4"]).withColumn("trans", lc.upto()).withColumn("spans", lc.spans())
    return led.select("backlog", "arm", "item_id", F.explode("spans").alias("s")).select(
        "backlog", "arm", "item_id", "s.start_us", "s.end_us", "s.state", "s.visible"
    )


@query("fifo_queue", "SELECT backlog, lane, item_id, arrival_us, (commit_us - service_us)::BIGINT AS start_us, commit_us::BIGINT AS commit_us FROM w_fifo")
def fifo_queue(spark, d):
    return wl.queued(spark, d).filter("source_ok").select("backlog", "lane", "item_id", "arrival_us", "start_us", "commit_us")


cte(
    "w_depth",
    """SELECT backlog, lane, item_id, max(waiting - 1) FILTER (WHERE kind = 0)::BIGINT AS depth_at_enqueue, max(waiting) FILTER (WHERE kind = 1)::BIGINT AS depth_at_start FROM (
  SELECT *, sum(step) OVER (PARTITION BY backlog, lane ORDER BY t, kind, item_id) AS waiting FROM (
    SELECT backlog, lane, item_id, arrival_us AS t, 0 AS kind, 1 AS step FROM w_fifo UNION ALL SELECT backlog, lane, item_id, commit_us - service_us, 1, -1 FROM w_fifo)) GROUP BY ALL""",
)


@query("queue_depth", "SELECT * FROM w_depth")
def queue_depth(spark, d):
    return lc.queue_depth(wl.queued(spark, d).filter("source_ok"), ["backlog", "lane"])


def coupled(spark, d):
    """B4 items verified after their deadline, with the instant a queued hide would run."""
    p = wl.plan(spark, d, ["B4"]).filter("source_ok AND arm = 'oracle'").withColumn("deadline_us", F.col("arrival_us") + wl.TP_US)
    points = p.select("backlog", "lane", "item_id", "arrival_us", "commit_us", "deadline_us", F.col("deadline_us").alias("t_us"))
    served = p.select("backlog", "lane", F.col("arrival_us").alias("t_us"), F.col("commit_us").alias("busy_until"))
    got = lc.last_before(points, served, ["backlog", "lane"], "busy_until")
    return got.filter(F.col("commit_us") > F.col("deadline_us")).withColumn("hide_us", F.greatest("deadline_us", "busy_until"))


@query(
    "coupled_hide",
    """SELECT backlog, p.item_id, deadline_us - arrival_us AS decoupled_us, greatest(deadline_us, (SELECT max(f.commit_us) FROM w_fifo f WHERE f.backlog = p.backlog AND f.lane = p.lane AND f.arrival_us <= p.deadline_us))::BIGINT - arrival_us AS coupled_us
  FROM w_plan p WHERE baseline = 'B4' AND arm = 'oracle' AND source_ok AND commit_us > deadline_us""",
)
def coupled_hide(spark, d):
    return coupled(spark, d).select(
        "backlog", "item_id", (F.col("deadline_us") - F.col("arrival_us")).alias("decoupled_us"), (F.col("hide_us") - F.col("arrival_us")).alias("coupled_us")
    )


cte(
    "w_userlog",
    """SELECT user_id, event_id, t_us, st AS new_state, CASE WHEN event_id % 7 = 0 THEN 'TRUSTED' ELSE lag(st) OVER (PARTITION BY user_id ORDER BY t_us, event_id) END AS old_state,
    lag(st) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS prev_new, count(*) FILTER (WHERE st = 'PROVISIONAL') OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS provs
  FROM (SELECT user_id, event_id, epoch_us(ts) AS t_us, CASE event_type WHEN 'signup' THEN 'PROVISIONAL' WHEN 'view' THEN 'TRUSTED' WHEN 'click' THEN 'HIDDEN' WHEN 'error' THEN 'QUARANTINED' ELSE 'REVOKED' END AS st FROM events)""",
)
_EDGES = ", ".join(f"'{a}>{b}'" for a, b in lc.LEGAL_EDGES)


@query(
    "illegal_transitions",
    f"""SELECT user_id, event_id, edge, rule FROM (SELECT user_id, event_id, coalesce(old_state, '-') || '>' || new_state AS edge, unnest(list_filter([
    CASE WHEN coalesce(old_state, '-') || '>' || new_state NOT IN ({_EDGES}) THEN 'illegal_edge' END, CASE WHEN old_state IS DISTINCT FROM prev_new THEN 'broken_chain' END,
    CASE WHEN new_state = 'PROVISIONAL' AND provs > 1 THEN 'provisional_again' END], lambda x: x IS NOT NULL)) AS rule FROM w_userlog)""",
)
def illegal_transitions(spark, d):
    """A recorded log read from the event stream of each user, checked edge by edge."""
    a = wl.admissions(spark, d)
    states = {"signup": "PROVISIONAL", "view": "TRUSTED", "click": "HIDDEN", "error": "QUARANTINED"}
    st = F.lit("REVOKED")
    for k, v in states.items():
        st = F.when(F.col("event_type") == k, v).otherwise(st)
    raw = a.select("user_id", F.col("item_id").alias("event_id"), F.col("arrival_us").alias("t_us"), st.alias("new_state"))
    seen = lc.neighbours(raw, ["user_id"], lc.time_chunk("t_us", DAY), F.struct("t_us", "event_id"), prev={"old_state": "new_state"})
    log = seen.withColumn("old_state", F.when(F.col("event_id") % 7 == 0, "TRUSTED").otherwise(F.col("old_state")))
    return lc.transition_violations(log, ["user_id"]).select("user_id", "event_id", "edge", "rule")


@query(
    "lifecycle_invariants",
    f"""SELECT {C}, count(*) AS items, count(*) FILTER (WHERE prov_entries > 1) AS provisional_again,
  count(*) FILTER (WHERE baseline = 'B4' AND trusted_us = prov_end_us AND commit_us > deadline_us) AS expiry_promotions, count(*) FILTER (WHERE baseline = 'B2' AND prov_start_us IS NOT NULL) AS b2_unvetted,
  count(*) FILTER (WHERE baseline IN ('B1', 'B3') AND hide_at_us IS NOT NULL) AS hidden_without_deadline, count(*) FILTER (WHERE NOT source_ok AND first_visible_us IS NOT NULL) AS bad_source_visible,
  count(*) FILTER (WHERE baseline = 'B1' AND source_ok AND state_end <> 'PROVISIONAL') AS b1_moved, count(*) FILTER (WHERE quarantine_us IS NOT NULL AND state_end <> 'QUARANTINED') AS left_quarantine FROM w_facts GROUP BY ALL""",
)
def lifecycle_invariants(spark, d):
    b = F.col("baseline")
    return wl.facts(spark, d).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("items"),
        count_if(F.col("prov_entries") > 1).alias("provisional_again"),
        count_if((b == "B4") & (F.col("trusted_us") == F.col("prov_end_us")) & (F.col("commit_us") > F.col("deadline_us"))).alias("expiry_promotions"),
        count_if((b == "B2") & F.col("prov_start_us").isNotNull()).alias("b2_unvetted"),
        count_if(b.isin("B1", "B3") & F.col("hide_at_us").isNotNull()).alias("hidden_without_deadline"),
        count_if(~F.col("source_ok") & F.col("first_visible_us").isNotNull()).alias("bad_source_visible"),
        count_if((b == "B1") & F.col("source_ok") & (F.col("state_end") != "PROVISIONAL")).alias("b1_moved"),
        count_if(F.col("quarantine_us").isNotNull() & (F.col("state_end") != "QUARANTINED")).alias("left_quarantine"),
    )


cte(
    "w_ver",
    """SELECT backlog, item_id, poison, CASE WHEN commit_us <= horizon_us THEN 'COMMITTED' WHEN vstart <= horizon_us THEN 'RUNNING' WHEN arrival_us <= horizon_us THEN 'QUEUED' ELSE 'CANCELLED' END AS status,
    arrival_us AS enter_us, CASE WHEN vstart <= horizon_us THEN vstart END AS start_us, CASE WHEN commit_us <= horizon_us THEN commit_us END AS commit_us, service_us,
    CASE WHEN vstart <= horizon_us THEN vstart - arrival_us + CASE WHEN item_id % 97 = 0 THEN 5000000 ELSE 0 END END AS wait_us, CASE WHEN commit_us <= horizon_us THEN commit_us - arrival_us END AS integrated_us,
    CASE WHEN commit_us <= horizon_us THEN CASE WHEN item_id % 89 = 0 THEN NOT detector_promote ELSE detector_promote END END AS passes, detector_promote
  FROM (SELECT *, (commit_us - service_us)::BIGINT AS vstart FROM w_fifo CROSS JOIN w_hor)""",
)


def verifier_records(spark, d):
    """Verifier records as they would be read at the horizon, with planted recording faults."""
    q = wl.queued(spark, d).filter("source_ok").withColumn("h", wl.horizon(spark, d))
    started, done = F.col("start_us") <= F.col("h"), F.col("commit_us") <= F.col("h")
    fault = F.when(F.col("item_id") % 97 == 0, 5_000_000).otherwise(0)
    flip = F.col("item_id") % 89 == 0
    return q.select(
        "backlog", "item_id", "poison", "detector_promote", "service_us",
        F.when(done, "COMMITTED").when(started, "RUNNING").when(F.col("arrival_us") <= F.col("h"), "QUEUED").otherwise("CANCELLED").alias("status"),
        F.col("arrival_us").alias("enter_us"), F.when(started, F.col("start_us")).alias("start_us"), F.when(done, F.col("commit_us")).alias("commit_us"),
        F.when(started, F.col("start_us") - F.col("arrival_us") + fault).alias("wait_us"), F.when(done, F.col("commit_us") - F.col("arrival_us")).alias("integrated_us"),
        F.when(done, F.col("detector_promote") != flip).alias("passes"),
    )


@query(
    "verifier_closure",
    """SELECT backlog, item_id, unnest(list_filter([CASE WHEN abs(wait_us - (start_us - enter_us)) > 1000 THEN 'wait' END, CASE WHEN passes <> detector_promote THEN 'decision' END,
  CASE WHEN abs(commit_us - start_us - service_us) > 1000 THEN 'service' END, CASE WHEN abs(integrated_us - (commit_us - enter_us)) > 1000 THEN 'integrated' END, CASE WHEN (status = 'COMMITTED') <> (commit_us IS NOT NULL) THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM w_ver""",
)
def verifier_closure(spark, d):
    from vislens.operators.quality import broken_rules

    off = lambda a, b: F.abs(a - b) > 1000
    c = F.col
    return broken_rules(
        verifier_records(spark, d),
        ["backlog", "item_id"],
        {
            "wait": off(c("wait_us"), c("start_us") - c("enter_us")),
            "decision": c("passes") != c("detector_promote"),
            "service": off(c("commit_us") - c("start_us"), c("service_us")),
            "integrated": off(c("integrated_us"), c("commit_us") - c("enter_us")),
            "status": (c("status") == "COMMITTED") != c("commit_us").isNotNull(),
        },
    )


@query(
    "verifier_key_violations",
    "SELECT backlog, item_id, count(*) AS records FROM (SELECT backlog, item_id FROM w_ver UNION ALL SELECT backlog, item_id FROM w_ver WHERE item_id % 83 = 0) GROUP BY ALL HAVING count(*) > 1",
)
def verifier_key_violations(spark, d):
    """Items with more than one record under a load; records of every 83rd item are planted twice."""
    v = verifier_records(spark, d).select("backlog", "item_id")
    twice = v.withColumn("i", F.explode(F.array_repeat(F.lit(0), F.when(F.col("item_id") % 83 == 0, 2).otherwise(1))))
    return twice.groupBy("backlog", "item_id").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


@query(
    "visible_during_query",
    f"""SELECT backlog, baseline, arm, lag_n, count(*) AS probes, count(*) FILTER (WHERE v) AS visible FROM (SELECT p.backlog, p.baseline, p.arm, g.lag_n, q.item_id AS probe, p.item_id,
    coalesce(bool_or(s.vis AND s.t_us <= q.arrival_us AND s.end_us > q.arrival_us - 60000000), false) AS v
  FROM w_adm q CROSS JOIN (VALUES (1), (10), (50)) g(lag_n) JOIN w_plan p ON p.item_id = q.item_id - g.lag_n LEFT JOIN w_span s ON s.backlog = p.backlog AND s.baseline = p.baseline AND s.arm = p.arm AND s.item_id = p.item_id
  WHERE q.event_type = 'view' GROUP BY ALL) GROUP BY ALL""",
)
def visible_during_query(spark, d):
    """Each view event returns three earlier items; were they visible while it ran?"""
    v = wl.admissions(spark, d).filter("event_type = 'view'")
    lags = F.explode(F.array(*[F.lit(n) for n in (1, 10, 50)]))
    probes = v.select(F.col("arrival_us").alias("q_end_us"), (F.col("arrival_us") - 60_000_000).alias("q_start_us"), F.col("item_id").alias("probe"), lags.alias("lag_n"))
    probes = probes.withColumn("item_id", F.col("probe") - F.col("lag_n"))
    led = wl.ledger(spark, d, probes=probes).withColumn("trans", lc.upto()).withColumn("spans", lc.spans()).select(*CELL, "lag_n", "q_start_us", "q_end_us", "spans")
    hit = F.exists("spans", lambda s: s["visible"] & (s["start_us"] <= F.col("q_end_us")) & (s["end_us"] > F.col("q_start_us")))
    return led.groupBy(*CELL, "lag_n").agg(F.count(F.lit(1)).alias("probes"), count_if(hit).alias("visible"))


# ---- lifecycle metrics


@query(
    "exposure_unvetted",
    f"""SELECT {C}, count(*) FILTER (WHERE unvetted_status = 'NOT_STARTED') AS not_started, count(*) FILTER (WHERE unvetted_status = 'COMPLETED') AS completed, count(*) FILTER (WHERE unvetted_status = 'RIGHT_CENSORED') AS right_censored,
  coalesce(sum(unvetted_us), 0)::BIGINT AS at_risk_us, max(unvetted_us) FILTER (WHERE unvetted_status = 'RIGHT_CENSORED') AS open_max_us,
  round(quantile_cont(unvetted_us, 0.5) FILTER (WHERE unvetted_status = 'COMPLETED'), 3) AS eu_p50, max(unvetted_us) FILTER (WHERE unvetted_status = 'COMPLETED') AS eu_max FROM w_life WHERE poison GROUP BY ALL""",
)
def exposure_unvetted(spark, d):
    f = cut_lineage(wl.facts(spark, d).filter("poison").select(*CELL, lc.unvetted_status().alias("status"), lc.unvetted_us().alias("us")))
    done = F.col("status") == "COMPLETED"
    agg = f.groupBy(*CELL).agg(
        count_if(F.col("status") == "NOT_STARTED").alias("not_started"), count_if(done).alias("completed"), count_if(F.col("status") == "RIGHT_CENSORED").alias("right_censored"),
        F.coalesce(F.sum("us"), F.lit(0)).alias("at_risk_us"), F.max(F.when(F.col("status") == "RIGHT_CENSORED", F.col("us"))).alias("open_max_us"),
    )
    q = quantile_table(f.filter(done), CELL, "us", "eu").drop("eu_n")
    return agg.join(q, CELL, "left")


@query(
    "exposure_poison",
    f"""SELECT {C}, count(*) FILTER (WHERE first_visible_us IS NULL) AS never_visible, count(*) FILTER (WHERE contain_us IS NOT NULL AND vis_end) AS readmitted, count(*) FILTER (WHERE first_visible_us IS NOT NULL AND state_end = 'HIDDEN') AS pending,
  count(*) FILTER (WHERE vis_end) AS visible_at_end, count(*) FILTER (WHERE contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED')) AS ep_n,
  count(*) FILTER (WHERE first_visible_us IS NOT NULL AND NOT (contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED'))) AS censored,
  round(quantile_cont(contain_us - first_visible_us, 0.5) FILTER (WHERE contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED')), 3) AS ep_p50,
  max(contain_us - first_visible_us) FILTER (WHERE contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED')) AS ep_max FROM w_life WHERE poison GROUP BY ALL""",
)
def exposure_poison(spark, d):
    f = cut_lineage(wl.facts(spark, d).filter("poison").select(*CELL, "state_end", "first_visible_us", "contain_us"))
    vis_end, seen = is_visible(F.col("state_end")), F.col("first_visible_us").isNotNull()
    settled = F.col("contain_us").isNotNull() & F.coalesce(F.col("state_end").isin(*lc.TERMINAL), F.lit(False))
    agg = f.groupBy(*CELL).agg(
        count_if(~seen).alias("never_visible"), count_if(F.col("contain_us").isNotNull() & vis_end).alias("readmitted"),
        count_if(seen & (F.col("state_end") == lc.HIDDEN)).alias("pending"), count_if(vis_end).alias("visible_at_end"),
        count_if(settled).alias("ep_n"), count_if(seen & ~settled).alias("censored"),
    )
    ep = f.filter(settled).select(*CELL, (F.col("contain_us") - F.col("first_visible_us")).alias("us"))
    return agg.join(quantile_table(ep, CELL, "us", "ep").drop("ep_n"), CELL, "left")


cte(
    "w_fresh",
    f"""SELECT {C}, item_id, arrival_us, first_visible_us - arrival_us AS first_us, CASE WHEN first_visible_us IS NULL THEN NULL WHEN last_withdraw_us IS NULL THEN first_visible_us - arrival_us WHEN readmit_us >= last_withdraw_us AND vis_end THEN readmit_us - arrival_us END AS durable_us,
  hide_at_us IS NOT NULL AS expired, CASE WHEN hide_at_us IS NOT NULL AND trusted_us IS NOT NULL AND vis_end THEN trusted_us - hide_at_us END AS gap_us FROM w_life WHERE NOT poison""",
)


@query(
    "freshness",
    f"""SELECT {C}, count(first_us) AS first_n, round(quantile_cont(first_us, 0.5), 3) AS first_p50, max(first_us) AS first_max, count(*) - count(first_us) AS first_censored, count(durable_us) AS durable_n,
  round(quantile_cont(durable_us, 0.5), 3) AS durable_p50, max(durable_us) AS durable_max, count(*) - count(durable_us) AS durable_censored, count(*) FILTER (WHERE expired) AS expired, count(gap_us) AS gap_n, round(quantile_cont(gap_us, 0.5), 3) AS gap_p50,
  max(gap_us) AS gap_max, count(*) FILTER (WHERE expired AND gap_us IS NULL) AS gap_censored FROM w_fresh GROUP BY ALL""",
)
def freshness(spark, d):
    f = wl.facts(spark, d).filter(~F.col("poison"))
    vis_end = is_visible(F.col("state_end"))
    first = F.col("first_visible_us") - F.col("arrival_us")
    durable = F.when(F.col("last_withdraw_us").isNull(), first).when((F.col("readmit_us") >= F.col("last_withdraw_us")) & vis_end, F.col("readmit_us") - F.col("arrival_us"))
    gap = F.when(F.col("hide_at_us").isNotNull() & F.col("trusted_us").isNotNull() & vis_end, F.col("trusted_us") - F.col("hide_at_us"))
    f = cut_lineage(f.select(*CELL, first.alias("first"), durable.alias("durable"), gap.alias("gap"), F.col("hide_at_us").isNotNull().alias("expired")))
    agg = f.groupBy(*CELL).agg(
        count_if(F.col("first").isNull()).alias("first_censored"), count_if(F.col("durable").isNull()).alias("durable_censored"),
        count_if(F.col("expired")).alias("expired"), count_if(F.col("expired") & F.col("gap").isNull()).alias("gap_censored"),
    )
    long = f.select(*CELL, F.expr("stack(3, 'first', first, 'durable', durable, 'gap', gap) AS (m, us)"))
    q = quantiles(long, CELL + ["m"], "us", {"p50": 0.5}, stats=True)
    wide = q.groupBy(*CELL).pivot("m", ["first", "durable", "gap"]).agg(F.first("n").alias("n"), F.round(F.first("p50"), 3).alias("p50"), F.first("max").alias("max"))
    return agg.join(wide, CELL, "left").fillna(0, [f"{m}_n" for m in ("first", "durable", "gap")])


cte(
    "w_epi",
    f"""SELECT {C}, item_id, kind, start_us, end_us, horizon_us FROM (SELECT s.backlog, s.baseline, s.arm, s.item_id, s.horizon_us, k.kind, s.t_us AS start_us,
    (SELECT min(n.t_us) FROM w_span n WHERE n.backlog = s.backlog AND n.baseline = s.baseline AND n.arm = s.arm AND n.item_id = s.item_id AND n.seq > s.seq AND n.vis) AS end_us
  FROM w_span s JOIN w_plan p ON p.backlog = s.backlog AND p.baseline = s.baseline AND p.arm = s.arm AND p.item_id = s.item_id CROSS JOIN (VALUES ('withdrawal'), ('quarantine')) k(kind)
  WHERE NOT p.poison AND CASE k.kind WHEN 'withdrawal' THEN s.was_vis AND NOT s.vis ELSE s.new_state = 'QUARANTINED' END)""",
)


@query(
    "episodes",
    f"""SELECT {C}, kind, count(*) AS started, count(end_us) AS completed, count(*) - count(end_us) AS censored, round(quantile_cont(end_us - start_us, 0.5), 3) AS done_p50, max(end_us - start_us) AS done_max,
  max(CASE WHEN end_us IS NULL THEN horizon_us - start_us END) AS open_max FROM w_epi GROUP BY ALL""",
)
def episodes(spark, d):
    keys = CELL + ["kind"]
    e = cut_lineage(lc.episodes(wl.facts(spark, d).filter(~F.col("poison")), CELL))
    agg = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("started"), F.count("end_us").alias("completed"), count_if(F.col("end_us").isNull()).alias("censored"), F.max("open_us").alias("open_max")
    )
    return agg.join(quantile_table(e, keys, "done_us", "done").drop("done_n"), keys, "left")


@query(
    "restricted_time",
    f"SELECT {C}, role, count(*) AS items, sum(visible_us)::BIGINT AS visible_us, sum(unavailable_us)::BIGINT AS unavailable_us, count(*) FILTER (WHERE visible_us < 0 OR unavailable_us < 0) AS unbalanced FROM w_life GROUP BY ALL",
)
def restricted_time(spark, d):
    un = F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us")
    return wl.facts(spark, d).groupBy(*CELL, "role").agg(
        F.count(F.lit(1)).alias("items"), F.sum("visible_us").alias("visible_us"), F.sum(un).alias("unavailable_us"), count_if((F.col("visible_us") < 0) | (un < 0)).alias("unbalanced")
    )


@query(
    "lifecycle_record",
    f"""SELECT {C}, item_id, role, state_end AS state_at_horizon, first_visible_us IS NOT NULL AS ever_visible, vis_end AS visible_at_horizon, first_visible_us - arrival_us AS first_visible_delay_us, greatest(coalesce(visible_entries, 0) - 1, 0) AS readmissions,
  visible_us AS restricted_visible_us, unavailable_us AS restricted_unavailable_us, exposure_status, unvetted_status, unavailable_status, quarantine_status FROM w_life""",
)
def lifecycle_record(spark, d):
    return lc.lifecycle_record(wl.facts(spark, d), CELL + ["item_id"])


@query(
    "window_exposure",
    f"""SELECT {C}, role, sum(greatest(0, end_us - greatest(t_us, start_us + 432000000000)))::BIGINT AS exposure_us, count(DISTINCT item_id) AS exposed_items FROM w_span JOIN w_adm USING (item_id) CROSS JOIN (SELECT start_us FROM w_hor)
  WHERE vis AND end_us > greatest(t_us, start_us + 432000000000) GROUP BY ALL""",
)
def window_exposure(spark, d):
    """Sums beyond the range of bigint, which are an error of the SQL, make `exposure_us` a decimal(38, 0)."""
    f = wl.facts(spark, d).withColumn("from_us", wl.start(spark, d) + 5 * DAY).withColumn("us", lc.visible_since("from_us"))
    # counted, not filtered: the filter would compute the time once more for every row
    out = f.groupBy(*CELL, "role").agg(whole_sum(F.col("us")).alias("exposure_us"), count_if(F.col("us") > 0).alias("exposed_items")).filter("exposed_items > 0")
    out = cut_lineage(out)
    fits = out.agg(F.max("exposure_us")).first()[0] or 0
    return out.withColumn("exposure_us", F.col("exposure_us").cast("bigint")) if fits < 1 << 63 else out


@query(
    "hide_delay",
    """SELECT backlog, arm, item_id, hide_at_us - deadline_us AS control_us, CASE WHEN nxt < coalesce(back, horizon_us + 1) THEN nxt - deadline_us END AS query_us FROM (
  SELECT f.*, (SELECT min(v.arrival_us) FROM w_adm v WHERE v.event_type = 'view' AND v.lane = f.lane AND v.arrival_us >= f.hide_at_us) AS nxt, coalesce(readmit_us, quarantine_us) AS back FROM w_facts f WHERE baseline = 'B4' AND hide_at_us IS NOT NULL)""",
)
def hide_delay(spark, d):
    """From the deadline to the hide itself and to the first probe of the lane that observes it."""
    f = wl.facts(spark, d, ["B4"]).filter(F.col("hide_at_us").isNotNull())
    points = f.select("lane", "backlog", "arm", "item_id", "deadline_us", "hide_at_us", "horizon_us", F.coalesce("readmit_us", "quarantine_us").alias("back"), F.col("hide_at_us").alias("t_us"))
    probes = wl.admissions(spark, d).filter("event_type = 'view'").select("lane", F.col("arrival_us").alias("t_us"))
    got = lc.first_after(points, probes, ["lane"], "nxt")
    seen = F.col("nxt") < F.coalesce("back", F.col("horizon_us") + 1)
    return got.select("backlog", "arm", "item_id", (F.col("hide_at_us") - F.col("deadline_us")).alias("control_us"), F.when(seen, F.col("nxt") - F.col("deadline_us")).alias("query_us"))


GRID_TP = (60, 150, 600, 3600)


@query(
    "freshness_exposure_sweep",
    """SELECT backlog, tp_s, count(*) AS items, round(avg(eu), 3) AS mean_eu_us, list_sort(list(eu))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)]::BIGINT AS p95_eu_us, round(avg(vis / 61.0), 6) AS availability, round(avg(CASE WHEN expired THEN 1.0 ELSE 0 END), 6) AS expiry_rate FROM (
  SELECT backlog, tp_s, item_id, least(commit_us, arrival_us + tp_s * 1000000) - arrival_us AS eu, commit_us > arrival_us + tp_s * 1000000 AS expired,
    count(*) FILTER (WHERE NOT (arrival_us + g.i * 60000000 >= arrival_us + tp_s * 1000000 AND commit_us > arrival_us + tp_s * 1000000 AND (poison OR arrival_us + g.i * 60000000 < commit_us)) AND NOT (poison AND arrival_us + g.i * 60000000 >= commit_us)) AS vis
  FROM w_fifo CROSS JOIN (VALUES (60::BIGINT), (150), (600), (3600)) t(tp_s) CROSS JOIN range(0, 61) g(i) GROUP BY backlog, tp_s, item_id, commit_us, arrival_us) GROUP BY ALL""",
)
def freshness_exposure_sweep(spark, d):
    """Availability and unvetted exposure over the deadline grid; probe grids are counted, not enumerated."""
    q = wl.queued(spark, d).filter("source_ok").withColumn("passes", ~F.col("poison"))
    q = q.withColumn("tp_s", F.explode(F.array(*[F.lit(t).cast("bigint") for t in GRID_TP])))
    q = q.withColumn("deadline_us", F.col("arrival_us") + F.col("tp_s") * 1_000_000)
    late = F.col("commit_us") > F.col("deadline_us")
    hidden = F.when(late, lc.hidden_grid_points(60_000_000, 3_600_000_000)).otherwise(0)
    rejected = F.when(~F.col("passes") & ~late, 61 - F.least(F.ceil((F.col("commit_us") - F.col("arrival_us")) / 60_000_000), F.lit(61))).otherwise(0)
    q = q.withColumn("eu", F.least("commit_us", "deadline_us") - F.col("arrival_us")).withColumn("vis", 61 - hidden - rejected).withColumn("late", late)
    keys = ["backlog", "tp_s"]
    q = cut_lineage(q.select(*keys, "eu", "vis", "late"))
    agg = q.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("eu"), 3).alias("mean_eu_us"), F.round(F.avg(F.col("vis") / 61.0), 6).alias("availability"),
        F.round(ratio(count_if(F.col("late")), F.count(F.lit(1))), 6).alias("expiry_rate"),
    )
    return agg.join(quantiles(q, keys, "eu", {"p95_eu_us": 0.95}, nearest=True), keys)


STATUS = ("NOT_STARTED", "COMPLETED", "RIGHT_CENSORED", "NOT_APPLICABLE")
KINDS = ("exposure", "unvetted", "unavailable", "quarantine")


@query(
    "status_partition",
    f"""SELECT baseline, arm, backlog, kind, st AS status, {wilson_sql('n', 'd')} FROM (SELECT {C}, k.kind, s.st, count(*) FILTER (WHERE CASE k.kind WHEN 'exposure' THEN exposure_status WHEN 'unvetted' THEN unvetted_status WHEN 'unavailable' THEN unavailable_status ELSE quarantine_status END = s.st) AS n, count(*) AS d
  FROM w_life CROSS JOIN (VALUES ('exposure'), ('unvetted'), ('unavailable'), ('quarantine')) k(kind) CROSS JOIN (VALUES ('NOT_STARTED'), ('COMPLETED'), ('RIGHT_CENSORED'), ('NOT_APPLICABLE')) s(st) GROUP BY ALL)""",
)
def status_partition(spark, d):
    """All status values appear, also with count zero: one wide aggregate, then unpivoted."""
    st = lc.statuses()
    f = wl.facts(spark, d).select(*CELL, *[st[f"{k}_status"].alias(k) for k in KINDS])
    agg = f.groupBy(*CELL).agg(F.count(F.lit(1)).alias("d"), *[count_if(F.col(k) == s).alias(f"{k}|{s}") for k in KINDS for s in STATUS])
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("status"), F.col(f"{k}|{s}").alias("n")) for k in KINDS for s in STATUS])
    long = agg.select(*CELL, "d", F.explode(cells).alias("c")).select(*CELL, "d", "c.*")
    return long.select(*CELL, "kind", "status", *rate_columns(F.col("n"), F.col("d")))


def populations(df):
    """Overall and landed-only copies of each row."""
    pops = F.when(F.col("landed"), F.array(F.lit("overall"), F.lit("landed_only"))).otherwise(F.array(F.lit("overall")))
    return df.withColumn("population", F.explode(pops))


_POP = "FROM w_life CROSS JOIN (VALUES ('overall'), ('landed_only')) s(population) WHERE (population = 'overall' OR landed)"


@query(
    "poison_summary",
    f"""SELECT attack, {C}, population, count(*) AS episodes, count(*) FILTER (WHERE passes) AS false_promotions, count(first_visible_us) AS started, count(*) FILTER (WHERE exposure_status = 'RIGHT_CENSORED') AS right_censored,
  coalesce(sum(visible_us) FILTER (WHERE first_visible_us IS NOT NULL), 0)::BIGINT AS exposure_total_us, round(sum(visible_us) FILTER (WHERE first_visible_us IS NOT NULL) / nullif(count(first_visible_us), 0)::DOUBLE, 3) AS exposure_per_started_us,
  count(*) FILTER (WHERE state_end = 'QUARANTINED') AS quarantined, count(*) FILTER (WHERE state_end = 'HIDDEN') AS hidden, count(*) FILTER (WHERE state_end = 'TRUSTED') AS trusted {_POP} AND poison GROUP BY ALL""",
)
def poison_summary(spark, d):
    seen = F.col("first_visible_us").isNotNull()
    f = populations(wl.facts(spark, d).filter("poison"))
    total = F.sum(F.when(seen, F.col("visible_us")))
    return f.groupBy("attack", *CELL, "population").agg(
        F.count(F.lit(1)).alias("episodes"), count_if(F.col("passes")).alias("false_promotions"), count_if(seen).alias("started"),
        count_if(lc.statuses()["exposure_status"] == "RIGHT_CENSORED").alias("right_censored"),
        F.coalesce(total, F.lit(0)).alias("exposure_total_us"), F.round(ratio(total, count_if(seen)), 3).alias("exposure_per_started_us"),
        *[count_if(F.col("state_end") == s).alias(s.lower()) for s in ("QUARANTINED", "HIDDEN", "TRUSTED")],
    )


@query(
    "clean_summary",
    f"""SELECT attack, {C}, count(*) AS episodes, count(*) FILTER (WHERE NOT passes) AS misquarantine, count(*) - count(first_visible_us) AS never_visible, count(first_visible_us) AS first_visible, count(*) FILTER (WHERE vis_end) AS durable_visible,
  sum(unavailable_us)::BIGINT AS unavailable_total_us, round(sum(unavailable_us) / count(*)::DOUBLE, 3) AS unavailable_per_item_us, count(*) FILTER (WHERE state_end = 'QUARANTINED') AS quarantine_censored FROM w_life WHERE role = 'clean' GROUP BY ALL""",
)
def clean_summary(spark, d):
    f = wl.facts(spark, d).filter("role = 'clean'")
    un = F.sum(F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us"))
    return f.groupBy("attack", *CELL).agg(
        F.count(F.lit(1)).alias("episodes"), count_if(~F.col("passes")).alias("misquarantine"), count_if(F.col("first_visible_us").isNull()).alias("never_visible"),
        count_if(F.col("first_visible_us").isNotNull()).alias("first_visible"), count_if(is_visible(F.col("state_end"))).alias("durable_visible"),
        un.alias("unavailable_total_us"), F.round(ratio(un, F.count(F.lit(1))), 3).alias("unavailable_per_item_us"), count_if(F.col("state_end") == "QUARANTINED").alias("quarantine_censored"),
    )


@query(
    "eu_bound",
    f"""SELECT {C}, population, CASE baseline WHEN 'B2' THEN 'must_not_start' WHEN 'B4' THEN 'deadline_and_completed' ELSE 'not_applicable' END AS bound, count(prov_start_us) AS started, CASE any_value(baseline) WHEN 'B2' THEN count(*) WHEN 'B4' THEN count(prov_start_us) ELSE 0 END AS bound_denominator,
  CASE any_value(baseline) WHEN 'B2' THEN count(prov_start_us) WHEN 'B4' THEN count(*) FILTER (WHERE prov_start_us IS NOT NULL AND (unvetted_status <> 'COMPLETED' OR unvetted_us > 612000000)) ELSE 0 END AS violations, coalesce(sum(unvetted_us), 0)::BIGINT AS at_risk_us, max(unvetted_us) AS max_us {_POP} AND poison GROUP BY backlog, baseline, arm, population""",
)
def eu_bound(spark, d):
    """The synchronous policy may not start an unvetted episode; the deadline policy must end it within 2 % of T_p."""
    f = populations(wl.facts(spark, d).filter("poison")).withColumn("us", lc.unvetted_us())
    started = F.col("prov_start_us").isNotNull()
    over = started & ((lc.unvetted_status() != "COMPLETED") | (F.col("us") > int(wl.TP_US * 1.02)))
    agg = f.groupBy(*CELL, "population").agg(
        F.count(F.lit(1)).alias("n"), count_if(started).alias("started"), count_if(over).alias("over"), F.coalesce(F.sum("us"), F.lit(0)).alias("at_risk_us"), F.max("us").alias("max_us")
    )
    pick = lambda b2, b4, other: F.when(F.col("baseline") == "B2", b2).when(F.col("baseline") == "B4", b4).otherwise(other)
    return agg.select(
        *CELL, "population", pick(F.lit("must_not_start"), F.lit("deadline_and_completed"), F.lit("not_applicable")).alias("bound"), "started",
        pick(F.col("n"), F.col("started"), F.lit(0)).alias("bound_denominator"), pick(F.col("started"), F.col("over"), F.lit(0)).alias("violations"), "at_risk_us", "max_us",
    )


@query(
    "commit_transition_latency",
    f"""SELECT {C}, count(*) AS committed, count(*) FILTER (WHERE n_final <> 1) AS not_exactly_one, count(*) FILTER (WHERE (final = 'TRUSTED') <> passes) AS disagreements, round(quantile_cont(lat, 0.5), 3) AS lat_p50, max(lat) AS lat_max FROM (
  SELECT p.backlog, p.baseline, p.arm, p.item_id, p.passes, count(t.t_us) AS n_final, min(t.new_state) AS final, min(t.t_us) - any_value(p.commit_us) AS lat FROM w_plan p LEFT JOIN w_span t ON t.backlog = p.backlog AND t.baseline = p.baseline AND t.arm = p.arm AND t.item_id = p.item_id AND t.new_state IN ('TRUSTED', 'QUARANTINED')
  WHERE p.source_ok AND p.verify AND p.commit_us <= p.horizon_us GROUP BY p.backlog, p.baseline, p.arm, p.item_id, p.passes) GROUP BY ALL""",
)
def commit_transition_latency(spark, d):
    f = wl.ledger(spark, d).filter(F.col("source_ok") & F.col("verify") & (F.col("commit_us") <= F.col("horizon_us"))).withColumn("trans", lc.upto())
    finals = F.filter("trans", lambda x: x["new_state"].isin("TRUSTED", "QUARANTINED"))
    f = f.withColumn("finals", finals).withColumn("lat", F.get("finals", 0)["t_us"] - F.col("commit_us"))
    f = cut_lineage(f.select(*CELL, "finals", "lat", "passes"))
    agg = f.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("committed"), count_if(F.size("finals") != 1).alias("not_exactly_one"),
        count_if((F.get("finals", 0)["new_state"] == "TRUSTED") != F.col("passes")).alias("disagreements"),
    )
    return agg.join(quantile_table(f, CELL, "lat", "lat").drop("lat_n"), CELL, "left")


def _q3(col):
    return ", ".join(f"round(quantile_cont({col}, {p}), 3) AS {col.split('_')[0]}_p{n}" for n, p in ((50, 0.5), (95, 0.95), (99, 0.99)))


@query(
    "queue_summary",
    f"""SELECT backlog, count(*) AS requested, count(start_us) AS started, count(commit_us) AS committed, count(*) FILTER (WHERE status <> 'COMMITTED') AS open_at_end, round(count(commit_us) / count(*)::DOUBLE, 6) AS committed_rate,
  {_q3('wait_us')}, {_q3('service_us')}, {_q3('integrated_us')} FROM w_ver GROUP BY 1""",
)
def queue_summary(spark, d):
    v = cut_lineage(verifier_records(spark, d))
    agg = v.groupBy("backlog").agg(
        F.count(F.lit(1)).alias("requested"), F.count("start_us").alias("started"), F.count("commit_us").alias("committed"), count_if(F.col("status") != "COMMITTED").alias("open_at_end"),
        F.round(ratio(F.count("commit_us"), F.count(F.lit(1))), 6).alias("committed_rate"),
    )
    long = v.select("backlog", F.expr("stack(3, 'wait', wait_us, 'service', service_us, 'integrated', integrated_us) AS (m, us)"))
    q = quantiles(long, ["backlog", "m"], "us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    wide = q.groupBy("backlog").pivot("m", ["wait", "service", "integrated"]).agg(*[F.round(F.first(p), 3).alias(p) for p in ("p50", "p95", "p99")])
    return agg.join(wide, "backlog")


@query(
    "live_outcomes",
    f"""SELECT {C}, tag, count(*) AS denominator, count(first_visible_us) AS ever_visible, count(*) FILTER (WHERE vis_end) AS at_end, round(quantile_cont(visible_us, 0.5), 3) AS vis_p50, round(quantile_cont(visible_us, 0.95), 3) AS vis_p95, max(visible_us) AS vis_max FROM w_life CROSS JOIN (SELECT start_us FROM w_hor)
  CROSS JOIN (VALUES ('poison'), ('clean'), ('false_promotion'), ('false_refusal')) t(tag) WHERE arrival_us < start_us + 864000000000 AND CASE tag WHEN 'poison' THEN poison WHEN 'clean' THEN NOT poison WHEN 'false_promotion' THEN poison AND detector_promote ELSE NOT poison AND NOT detector_promote END GROUP BY ALL""",
)
def live_outcomes(spark, d):
    f = wl.facts(spark, d).withColumn("from_us", wl.start(spark, d)).filter(F.col("arrival_us") < F.col("from_us") + 10 * DAY)
    p, dp = F.col("poison"), F.col("detector_promote")
    tags = F.array(F.when(p, "poison").otherwise("clean"), F.when(p & dp, "false_promotion").when(~p & ~dp, "false_refusal"))
    f = f.withColumn("tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    keys = CELL + ["tag"]
    f = cut_lineage(f.select(*keys, "first_visible_us", "state_end", "visible_us"))
    agg = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("denominator"), F.count("first_visible_us").alias("ever_visible"), count_if(is_visible(F.col("state_end"))).alias("at_end"))
    return agg.join(quantile_table(f, keys, "visible_us", "vis", ((50, 0.5), (95, 0.95))).drop("vis_n"), keys)
