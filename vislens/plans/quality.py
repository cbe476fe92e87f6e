"""Registered queries: gates, identities and regression differences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vislens.functions.stats import count_if
from vislens.operators import cohort as co
from vislens.operators import eligibility as elig
from vislens.operators import lifecycle as lc
from vislens.operators import quality as qa
from vislens.operators.cohort import hash_ordered_take
from vislens.operators.lifecycle import CELL
from vislens.plans import workload as wl
from vislens.plans.cohort import posts
from vislens.plans.compare import block_cells
from vislens.plans.registry import cte, query
from vislens.plans.retrieval import landing
from vislens.plans.retrieval_log import log
from vislens.session import cut_lineage
from vislens.sources import tables as src

C = "backlog, baseline, arm"

cte(
    "w_cellsum",
    f"""SELECT {C}, count(*) AS items, count(*) FILTER (WHERE poison) AS poison, count(prov_start_us) FILTER (WHERE poison) AS eu_started, count(*) FILTER (WHERE poison AND unvetted_status = 'COMPLETED') AS eu_completed, count(*) FILTER (WHERE poison AND unvetted_status = 'RIGHT_CENSORED') AS eu_censored,
  max(unvetted_us) FILTER (WHERE poison AND unvetted_status = 'COMPLETED') AS eu_max, coalesce(sum(unvetted_us) FILTER (WHERE poison), 0)::BIGINT AS eu_risk, count(contain_us) FILTER (WHERE poison) AS contained, count(*) FILTER (WHERE prov_entries > 1) AS prov_again,
  count(*) FILTER (WHERE baseline = 'B4' AND trusted_us = prov_end_us AND commit_us > deadline_us) AS expiry_promoted, count(*) FILTER (WHERE NOT poison AND hide_at_us IS NOT NULL) AS expired, count(*) FILTER (WHERE NOT poison AND hide_at_us IS NOT NULL AND trusted_us IS NOT NULL AND vis_end) AS gap_done,
  count(*) FILTER (WHERE NOT poison AND hide_at_us IS NOT NULL AND NOT coalesce(trusted_us IS NOT NULL AND vis_end, false)) AS gap_censored, count(*) FILTER (WHERE poison AND contain_us IS NOT NULL AND vis_end) AS readmitted, sum(visible_us) FILTER (WHERE poison)::BIGINT AS poison_visible_us,
  sum(visible_us)::BIGINT AS visible_us, count(first_visible_us) AS started, count(*) FILTER (WHERE commit_us <= horizon_us) AS committed, count(*) FILTER (WHERE state_end = 'QUARANTINED' AND source_ok) AS quarantined, count(hide_at_us) AS hidden FROM w_life GROUP BY ALL""",
)


def cell_summary(spark, d):
    f = wl.facts(spark, d)
    p, st = F.col("poison"), lc.unvetted_status()
    vis_end, hid = lc.is_visible(F.col("state_end")), F.col("hide_at_us").isNotNull()
    back = F.coalesce(F.col("trusted_us").isNotNull() & vis_end, F.lit(False))
    return f.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("items"), count_if(p).alias("poison"), F.count(F.when(p, F.col("prov_start_us"))).alias("eu_started"), count_if(p & (st == "COMPLETED")).alias("eu_completed"),
        count_if(p & (st == "RIGHT_CENSORED")).alias("eu_censored"), F.max(F.when(p & (st == "COMPLETED"), lc.unvetted_us())).alias("eu_max"), F.coalesce(F.sum(F.when(p, lc.unvetted_us())), F.lit(0)).alias("eu_risk"),
        F.count(F.when(p, F.col("contain_us"))).alias("contained"), count_if(F.col("prov_entries") > 1).alias("prov_again"),
        count_if((F.col("baseline") == "B4") & (F.col("trusted_us") == F.col("prov_end_us")) & (F.col("commit_us") > F.col("deadline_us"))).alias("expiry_promoted"),
        count_if(~p & hid).alias("expired"), count_if(~p & hid & back).alias("gap_done"), count_if(~p & hid & ~back).alias("gap_censored"), count_if(p & F.col("contain_us").isNotNull() & vis_end).alias("readmitted"),
        F.sum(F.when(p, F.col("visible_us"))).alias("poison_visible_us"), F.sum("visible_us").alias("visible_us"), F.count("first_visible_us").alias("started"), count_if(F.col("commit_us") <= F.col("horizon_us")).alias("committed"),
        count_if((F.col("state_end") == lc.QUARANTINED) & F.col("source_ok")).alias("quarantined"), F.count("hide_at_us").alias("hidden"),
    )


cte("w_hits", "SELECT backlog, baseline, role, count(*) FILTER (WHERE hit) AS np FROM w_ret WHERE arm = 'oracle' GROUP BY ALL")


@query(
    "admissibility_gates",
    """SELECT gate, coalesce(ok, false) AS ok, detail::BIGINT AS detail FROM (SELECT '1_attack_reaches_top_k' AS gate, (SELECT min(np) > 0 FROM w_hits WHERE baseline = 'B1' AND role = 'attack_associated') AS ok, (SELECT min(np) FROM w_hits WHERE baseline = 'B1' AND role = 'attack_associated') AS detail
  UNION ALL SELECT '2_sync_shows_nothing_unvetted', sum(eu_started) FILTER (WHERE baseline = 'B2') = 0, sum(eu_started) FILTER (WHERE baseline = 'B2') FROM w_cellsum
  UNION ALL SELECT '2_undefended_contains_nothing', sum(contained) FILTER (WHERE baseline = 'B1') = 0, sum(contained) FILTER (WHERE baseline = 'B1') FROM w_cellsum
  UNION ALL SELECT '2_deadline_bounds_exposure', max(eu_max) FILTER (WHERE baseline = 'B4') <= 612000000, max(eu_max) FILTER (WHERE baseline = 'B4') FROM w_cellsum
  UNION ALL SELECT '3_provisional_once_and_no_expiry_promotion', sum(prov_again + expiry_promoted) = 0, sum(prov_again + expiry_promoted) FROM w_cellsum
  UNION ALL SELECT '4_order_B1_B3_B4_B2', count(*) = 0, count(*) FROM (SELECT backlog FROM w_hits WHERE role = 'heldout_same_topic' GROUP BY 1 HAVING NOT (max(np) FILTER (WHERE baseline = 'B1') >= max(np) FILTER (WHERE baseline = 'B3') AND max(np) FILTER (WHERE baseline = 'B3') >= max(np) FILTER (WHERE baseline = 'B4') AND max(np) FILTER (WHERE baseline = 'B4') >= max(np) FILTER (WHERE baseline = 'B2')))
  UNION ALL SELECT '5_nothing_left_running', count(*) = 0, count(*) FROM w_plan WHERE verify AND source_ok AND commit_us > horizon_us)""",
)
def admissibility_gates(spark, d):
    b = F.col("baseline")
    at = lambda base, c, f=F.sum: f(F.when(b == base, F.col(c)))
    cells = cell_summary(spark, d).agg(
        at("B2", "eu_started").alias("b2"), at("B1", "contained").alias("b1"), at("B4", "eu_max", F.max).alias("b4"), F.sum(F.col("prov_again") + F.col("expiry_promoted")).alias("inv")
    )
    hits = log(spark, d).filter("arm = 'oracle'").groupBy("backlog", "role").pivot("baseline", ["B1", "B2", "B3", "B4"]).agg(count_if(F.col("hit")))
    role = F.col("role")
    ordered = (F.col("B1") >= F.col("B3")) & (F.col("B3") >= F.col("B4")) & (F.col("B4") >= F.col("B2"))
    h = hits.agg(
        F.min(F.when(role == "attack_associated", F.col("B1"))).alias("reach"), count_if((role == "heldout_same_topic") & ~ordered).alias("disorder"),
    )
    # verdicts that are still to come when a cell is summed up
    running = wl.plan(spark, d).agg(count_if(F.col("verify") & F.col("source_ok") & (F.col("commit_us") > F.col("horizon_us"))).alias("running")).scalar()
    one = cells.withColumn("h", h.select(F.struct("*")).scalar()).select("*", "h.*").withColumn("running", running)
    c = F.col
    return qa.gates(
        one,
        {
            "1_attack_reaches_top_k": (c("reach") > 0, c("reach")), "2_sync_shows_nothing_unvetted": (c("b2") == 0, c("b2")), "2_undefended_contains_nothing": (c("b1") == 0, c("b1")),
            "2_deadline_bounds_exposure": (c("b4") <= int(wl.TP_US * 1.02), c("b4")), "3_provisional_once_and_no_expiry_promotion": (c("inv") == 0, c("inv")),
            "4_order_B1_B3_B4_B2": (c("disorder") == 0, c("disorder")), "5_nothing_left_running": (c("running") == 0, c("running")),
        },
    )


# Records that break one rule each, made from the deadline cells; the SQL writes them and the rules once more.
cte(
    "w_cellbad",
    """SELECT * FROM w_cellsum UNION ALL SELECT * REPLACE (eu_started + 1 AS eu_started) FROM w_cellsum WHERE baseline = 'B3' UNION ALL SELECT * REPLACE (NULL AS eu_max) FROM w_cellsum WHERE baseline = 'B4'
  UNION ALL SELECT * REPLACE (1 AS eu_censored, eu_completed - 1 AS eu_completed, 0 AS eu_risk) FROM w_cellsum WHERE baseline = 'B4' UNION ALL SELECT * REPLACE (gap_done + 1 AS gap_done) FROM w_cellsum WHERE baseline = 'B4' UNION ALL SELECT * REPLACE (0 AS started) FROM w_cellsum WHERE baseline = 'B2'""",
)


def with_planted(cells):
    b = F.col("baseline")
    big = lambda x: F.lit(x).cast("bigint")
    planted = [
        (b == "B3", {"eu_started": F.col("eu_started") + 1}), (b == "B4", {"eu_max": big(None)}), (b == "B4", {"eu_censored": big(1), "eu_completed": F.col("eu_completed") - 1, "eu_risk": big(0)}),
        (b == "B4", {"gap_done": F.col("gap_done") + 1}), (b == "B2", {"started": big(0)}),
    ]
    out = cells
    for where, change in planted:
        out = out.unionByName(cells.filter(where).withColumns(change))
    return out


@query(
    "bookkeeping_identities",
    """SELECT rule, count(*) AS records, count(*) FILTER (WHERE bad) AS violations FROM (SELECT unnest([{'rule': 'started_is_completed_plus_censored', 'bad': eu_completed + eu_censored - eu_started <> 0},
  {'rule': 'no_completed_gives_null', 'bad': CASE WHEN eu_completed > 0 THEN eu_max IS NULL ELSE eu_max IS NOT NULL END}, {'rule': 'censored_contributes_age', 'bad': eu_censored > 0 AND eu_risk <= 0}, {'rule': 'expiry_is_gap_done_or_censored', 'bad': gap_done <> expired - gap_censored},
  {'rule': 'deadline_cells_close_everything', 'bad': baseline = 'B4' AND eu_censored > 0}, {'rule': 'visible_needs_started', 'bad': visible_us > 0 AND started = 0}], recursive := true) FROM w_cellbad) GROUP BY 1""",
)
def bookkeeping_identities(spark, d):
    c, b4 = F.col, F.col("baseline") == "B4"
    rules = {
        "started_is_completed_plus_censored": c("eu_started") == c("eu_completed") + c("eu_censored"), "no_completed_gives_null": (c("eu_completed") == 0) == c("eu_max").isNull(),
        "censored_contributes_age": (c("eu_censored") == 0) | (c("eu_risk") > 0), "expiry_is_gap_done_or_censored": c("expired") == c("gap_done") + c("gap_censored"),
        "deadline_cells_close_everything": ~b4 | (c("eu_censored") == 0), "visible_needs_started": (c("started") > 0) | (c("visible_us") == 0),
    }
    return qa.identity_counts(with_planted(cut_lineage(cell_summary(spark, d))), rules)


@query(
    "row_vs_gate",
    f"""SELECT a.backlog, a.baseline, a.arm, stored_np, rows_np::BIGINT AS rows_np, stored_n, rows_n::BIGINT AS rows_n, stored_np = rows_np AND stored_n = rows_n AS agree, queries_seen FROM (SELECT {C}, count(*) FILTER (WHERE hit) AS stored_np, count(*) AS stored_n FROM w_ret GROUP BY ALL) a JOIN (SELECT {C}, sum(hits) AS rows_np, sum(n) AS rows_n, count(*) AS queries_seen FROM w_pq GROUP BY ALL) b ON a.backlog = b.backlog AND a.baseline = b.baseline AND a.arm = b.arm""",
)
def row_vs_gate(spark, d):
    l = cut_lineage(log(spark, d).select(*CELL, "query_id", "hit"))
    stored = l.groupBy(*CELL).agg(count_if(F.col("hit")).alias("stored_np"), F.count(F.lit(1)).alias("stored_n"))
    rows = l.groupBy(*CELL, "query_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("hit")).alias("h"))
    again = rows.groupBy(*CELL).agg(F.sum("h").alias("rows_np"), F.sum("n").alias("rows_n"), F.count(F.lit(1)).alias("queries_seen"))
    agree = (F.col("stored_np") == F.col("rows_np")) & (F.col("stored_n") == F.col("rows_n"))
    return stored.join(again, CELL).select(*CELL, "stored_np", "rows_np", "stored_n", "rows_n", agree.alias("agree"), "queries_seen")


@query(
    "row_grid_violations",
    """WITH k AS (SELECT * FROM w_pq WHERE NOT (baseline = 'B3' AND backlog = 'normal' AND qid % 3 = 0) AND NOT (baseline = 'B2' AND arm = 'detector' AND backlog = 'heavy')),
    g AS (SELECT * FROM (VALUES ('normal'), ('heavy')) b(backlog) CROSS JOIN (VALUES ('B1', 'oracle'), ('B2', 'oracle'), ('B2', 'detector'), ('B3', 'oracle'), ('B3', 'detector'), ('B4', 'oracle'), ('B4', 'detector')) c(baseline, arm)),
    x AS (SELECT g.backlog, g.baseline, g.arm, count(DISTINCT k.qid) AS seen FROM g LEFT JOIN k ON k.backlog = g.backlog AND k.baseline = g.baseline AND k.arm = g.arm GROUP BY ALL)
    SELECT backlog, baseline, arm, CASE WHEN seen = 0 THEN 'cell' ELSE 'query_set' END AS rule, (SELECT count(DISTINCT qid) FROM k) - seen AS missing FROM x WHERE seen < (SELECT count(DISTINCT qid) FROM k)""",
)
def row_grid_violations(spark, d):
    """Cells without rows, and cells whose queries are not those of all others; one fault of each kind is planted."""
    rows = log(spark, d).select(*CELL, "query_id").distinct()
    b, load = F.col("baseline"), F.col("backlog")
    rows = rows.filter(~((b == "B3") & (load == "normal") & (F.col("query_id") % 3 == 0)) & ~((b == "B2") & (F.col("arm") == "detector") & (load == "heavy")))
    rows = cut_lineage(rows)
    want = spark.createDataFrame(wl.cells(), "backlog string, baseline string, arm string").crossJoin(rows.select("query_id").distinct())
    have = want.join(rows.withColumn("seen", F.lit(1)), [*CELL, "query_id"], "left").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count("seen").alias("seen"))
    rule = F.when(F.col("seen") == 0, "cell").otherwise("query_set").alias("rule")
    return have.filter("seen < n").select(*CELL, rule, (F.col("n") - F.col("seen")).alias("missing"))


cte(
    "w_sweep0",
    """SELECT p.seed, p.item_id, r.rn, CASE WHEN p.source_ok THEN least(least(p.commit_us, p.deadline_us), p.horizon_us) - p.arrival_us ELSE 0 END AS v_fail,
    CASE WHEN NOT p.source_ok THEN 0 WHEN p.commit_us <= p.deadline_us THEN p.horizon_us - p.arrival_us ELSE least(p.deadline_us, p.horizon_us) - p.arrival_us + greatest(0, p.horizon_us - p.commit_us) END AS v_pass, coalesce(p.source_ok AND p.commit_us > p.deadline_us AND p.commit_us <= p.horizon_us, false) AS late
  FROM w_plan p JOIN (SELECT item_id, row_number() OVER (PARTITION BY seed ORDER BY sha256('70' || '|' || item_id), item_id) AS rn FROM w_adm WHERE poison) r ON r.item_id = p.item_id WHERE p.baseline = 'B4' AND p.arm = 'oracle' AND p.backlog = 'heavy' AND p.poison""",
)


@query(
    "sweep_gates",
    """SELECT seed, k, promoted, exposure_us, readmitted, coalesce(exposure_us >= lag(exposure_us) OVER (PARTITION BY seed ORDER BY k), true) AS nondecreasing FROM (SELECT seed, k.k, count(*) FILTER (WHERE rn <= k.k) AS promoted, sum(CASE WHEN rn <= k.k THEN v_pass ELSE v_fail END)::BIGINT AS exposure_us, count(*) FILTER (WHERE rn <= k.k AND late) AS readmitted FROM w_sweep0 CROSS JOIN (VALUES (0), (1), (2), (3)) k(k) GROUP BY ALL)""",
)
def sweep_gates(spark, d):
    """Poison exposure when the first k items of a nested set are wrongly promoted."""
    a = wl.admissions(spark, d).filter("poison").withColumn("h", F.struct(elig.seeded_hash(70, "item_id"), "item_id"))
    top = hash_ordered_take(a, ["seed"], "h", 3).select("item_id", "rank")
    base = wl.plan(spark, d, ["B4"]).filter("arm = 'oracle' AND backlog = 'heavy' AND poison")
    both = base.drop("passes").withColumn("passes", F.explode(F.array(F.lit(True), F.lit(False))))
    f = lc.with_facts(lc.ledger(both, wl.TP_US)).select("seed", "item_id", "passes", "visible_us", (F.size("trans") > 2).alias("late"))
    per = f.groupBy("seed", "item_id").agg(
        F.max(F.when(F.col("passes"), F.col("visible_us"))).alias("v_pass"), F.max(F.when(~F.col("passes"), F.col("visible_us"))).alias("v_fail"), F.max(F.col("passes") & F.col("late")).alias("late")
    )
    per = per.join(top, "item_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    chosen = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    g = per.groupBy("seed", "k").agg(
        count_if(chosen).alias("promoted"), F.sum(F.when(chosen, F.col("v_pass")).otherwise(F.col("v_fail"))).alias("exposure_us"), count_if(chosen & F.col("late")).alias("readmitted")
    )
    w = W.partitionBy("seed").orderBy("k")  # four rows per seed
    return g.withColumn("nondecreasing", F.coalesce(F.col("exposure_us") >= F.lag("exposure_us").over(w), F.lit(True)))


_PARAMS = {"max_quantity": "max(l_quantity)", "min_quantity": "min(l_quantity)", "max_discount": "max(l_discount)", "max_tax": "max(l_tax)", "max_price": "max(l_extendedprice)", "lines": "count(*)::DOUBLE"}


@query(
    "config_drift",
    "SELECT a.parameter, a.v AS left_value, b.v AS right_value, a.v IS DISTINCT FROM b.v AS moved, a.parameter IN ('lines', 'max_price') AS allowed, a.v IS DISTINCT FROM b.v AND a.parameter NOT IN ('lines', 'max_price') AS drift FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS parameter, {e} AS v FROM lineitem WHERE l_returnflag = 'A'" for n, e in _PARAMS.items())
    + ") a JOIN ("
    + " UNION ALL ".join(f"SELECT '{n}' AS parameter, {e} AS v FROM lineitem WHERE l_returnflag = 'R'" for n, e in _PARAMS.items())
    + ") b ON a.parameter = b.parameter",
)
def config_drift(spark, d):
    """Parameter-by-parameter difference of two runs with an allow-list."""
    l = src.table(spark, d, "lineitem")
    aggs = [F.expr(e.replace("::DOUBLE", "")).cast("double").alias(n) for n, e in _PARAMS.items()]
    side = lambda flag: l.filter(F.col("l_returnflag") == flag).agg(*aggs).withColumn("run", F.lit(1))
    diff = qa.field_diff(side("A"), side("R"), ["run"], list(_PARAMS)).drop("run").withColumnRenamed("field", "parameter")
    allowed = F.col("parameter").isin("lines", "max_price")
    return diff.withColumns({"allowed": allowed, "drift": F.col("moved") & ~allowed})


@query(
    "cross_tier_order",
    "SELECT baseline, rn AS rank_normal, rh AS rank_heavy, rn = rh AS same FROM (SELECT baseline, rank() OVER (ORDER BY n DESC) AS rn, rank() OVER (ORDER BY h DESC) AS rh FROM (SELECT baseline, max(poison_visible_us) FILTER (WHERE backlog = 'normal') AS n, max(poison_visible_us) FILTER (WHERE backlog = 'heavy') AS h FROM w_cellsum WHERE arm = 'oracle' GROUP BY 1))",
)
def cross_tier_order(spark, d):
    """Are the policies ranked the same under both loads?"""
    c = cell_summary(spark, d).filter("arm = 'oracle'").groupBy("baseline").pivot("backlog", ["normal", "heavy"]).agg(F.max("poison_visible_us"))
    rank = lambda col: F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.col(col).desc()))  # noqa: E731  four rows
    return c.select("baseline", rank("normal").alias("rank_normal"), rank("heavy").alias("rank_heavy")).withColumn("same", F.col("rank_normal") == F.col("rank_heavy"))


FROZEN = ("items", "poison", "committed", "eu_started")
_FD = " UNION ALL ".join(f"SELECT o.backlog, o.baseline, '{f}' AS field, o.{f}::DOUBLE AS left_value, d.{f}::DOUBLE AS right_value, o.{f} IS DISTINCT FROM d.{f} AS moved FROM o JOIN d ON d.backlog = o.backlog AND d.baseline = o.baseline" for f in (*FROZEN, "visible_us", "quarantined"))


@query("frozen_field_diff", "WITH o AS (SELECT * FROM w_cellsum WHERE arm = 'oracle' AND baseline <> 'B1'), d AS (SELECT * FROM w_cellsum WHERE arm = 'detector') SELECT *, field IN ('items', 'poison', 'committed', 'eu_started') AS frozen FROM (" + _FD + ")")
def frozen_field_diff(spark, d):
    """Fields that may not depend on the verdict source, and the ones that may."""
    c = cut_lineage(cell_summary(spark, d))
    diff = qa.field_diff(c.filter("arm = 'oracle' AND baseline <> 'B1'"), c.filter("arm = 'detector'"), ["backlog", "baseline"], [*FROZEN, "visible_us", "quarantined"])
    return diff.withColumn("frozen", F.col("field").isin(*FROZEN))


_RD = " UNION ALL ".join(
    f"SELECT o_orderpriority AS cell, '{n}' AS field, {e} FILTER (WHERE o_orderkey % 5 = 0) AS left_value, {e} FILTER (WHERE o_orderkey % 5 = 1) AS right_value FROM orders GROUP BY 1" for n, e in (("n", "count(*)"), ("max_price", "max(o_totalprice)"), ("min_price", "min(o_totalprice)"), ("statuses", "count(DISTINCT o_orderstatus)"))
)


@query("run_diff", f"SELECT cell, field, left_value::DOUBLE AS left_value, right_value::DOUBLE AS right_value FROM ({_RD}) WHERE left_value IS DISTINCT FROM right_value")
def run_diff(spark, d):
    o = src.table(spark, d, "orders").withColumn("cell", F.col("o_orderpriority"))
    side = lambda r: o.filter(F.col("o_orderkey") % 5 == r).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"), F.count_distinct("o_orderstatus").alias("statuses"))
    return qa.field_diff(side(0), side(1), ["cell"], ["n", "max_price", "min_price", "statuses"]).filter("moved").drop("moved")


@query(
    "golden_compare",
    "SELECT event_type AS metric, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a - b) <= 1e-6 END AS ok FROM (SELECT event_type, avg(value) FILTER (WHERE event_type <> 'view') AS a, sum(value) FILTER (WHERE event_type <> 'view') / count(*) + CASE WHEN event_type = 'click' THEN 0.001 ELSE 0 END AS b FROM events GROUP BY 1)",
)
def golden_compare(spark, d):
    """Recomputed values against stored ones: tolerance 1e-6, null matches null."""
    e = src.table(spark, d, "events")
    v = F.when(F.col("event_type") != "view", F.col("value"))
    g = e.groupBy("event_type").agg(F.avg(v).alias("a"), (F.sum(v) / F.count(F.lit(1))).alias("b"))
    stored = F.col("b") + F.when(F.col("event_type") == "click", 0.001).otherwise(0.0)
    return g.select(F.col("event_type").alias("metric"), qa.within_tolerance(F.col("a"), stored).alias("ok"))


@query(
    "validity_gates",
    """SELECT gate, ok, detail::BIGINT AS detail FROM (SELECT 'unique_ids' AS gate, count(DISTINCT event_id) = count(*) AS ok, count(*) AS detail FROM events UNION ALL SELECT 'cells_complete', count(*) = 14, count(*) FROM w_cellsum UNION ALL SELECT 'items_in_every_cell', min(items) = max(items), max(items) FROM w_cellsum
  UNION ALL SELECT 'accounting', sum(items) = 14 * (SELECT count(*) FROM events), sum(items) FROM w_cellsum UNION ALL SELECT 'policy_sync', sum(eu_started) FILTER (WHERE baseline = 'B2') = 0, sum(eu_started) FILTER (WHERE baseline = 'B2') FROM w_cellsum UNION ALL SELECT 'policy_deadline', max(eu_max) FILTER (WHERE baseline = 'B4') <= 600000000, max(eu_max) FILTER (WHERE baseline = 'B4') FROM w_cellsum
  UNION ALL SELECT 'no_hide_without_deadline', sum(hidden) FILTER (WHERE baseline <> 'B4') = 0, sum(hidden) FILTER (WHERE baseline <> 'B4') FROM w_cellsum UNION ALL SELECT 'undefended_never_quarantines', sum(quarantined) FILTER (WHERE baseline = 'B1') = 0, sum(quarantined) FILTER (WHERE baseline = 'B1') FROM w_cellsum
  UNION ALL SELECT 'provisional_once', sum(prov_again) = 0, sum(prov_again) FROM w_cellsum UNION ALL SELECT 'no_expiry_promotion', sum(expiry_promoted) = 0, sum(expiry_promoted) FROM w_cellsum UNION ALL SELECT 'oracle_never_readmits_poison', sum(readmitted) FILTER (WHERE arm = 'oracle') = 0, sum(readmitted) FILTER (WHERE arm = 'oracle') FROM w_cellsum UNION ALL SELECT 'values_finite', count(*) = 0, count(*) FROM events WHERE isnan(value) OR value IS NULL)""",
)
def validity_gates(spark, d):
    e = src.table(spark, d, "events")
    ids = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.isnan("value") | F.col("value").isNull()).alias("bad"))
    ids = ids.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct"), F.sum("bad").alias("bad"))
    b = F.col("baseline")
    when = lambda cond, c, f=F.sum: f(F.when(cond, F.col(c)))
    s = cell_summary(spark, d).agg(
        F.count(F.lit(1)).alias("cells"), F.min("items").alias("lo"), F.max("items").alias("hi"), F.sum("items").alias("all"), when(b == "B2", "eu_started").alias("sync"), when(b == "B4", "eu_max", F.max).alias("eu"),
        when(b != "B4", "hidden").alias("hid"), when(b == "B1", "quarantined").alias("quar"), F.sum("prov_again").alias("again"), F.sum("expiry_promoted").alias("exp"), when(F.col("arm") == "oracle", "readmitted").alias("back"),
    )
    one = s.withColumn("i", ids.select(F.struct("*")).scalar()).select("*", "i.*")
    c = F.col
    zero = lambda n: (c(n) == 0, c(n))
    return qa.gates(
        one,
        {
            "unique_ids": (c("distinct") == c("events"), c("events")), "cells_complete": (c("cells") == 14, c("cells")), "items_in_every_cell": (c("lo") == c("hi"), c("hi")), "accounting": (c("all") == 14 * c("events"), c("all")),
            "policy_sync": zero("sync"), "policy_deadline": (c("eu") <= wl.TP_US, c("eu")), "no_hide_without_deadline": zero("hid"), "undefended_never_quarantines": zero("quar"), "provisional_once": zero("again"),
            "no_expiry_promotion": zero("exp"), "oracle_never_readmits_poison": zero("back"), "values_finite": zero("bad"),
        },
    )


@query(
    "truth_separation",
    "SELECT * FROM (SELECT 'scoring_input' AS projection, count(*) AS n_rows, '' AS forbidden FROM documents UNION ALL SELECT 'lifecycle_input', count(*), '' FROM events UNION ALL SELECT 'cohort_rows', count(*), 'source_id,topic' FROM documents UNION ALL SELECT 'detector_scores', count(*), 'poison,stratum' FROM documents JOIN labels USING (doc_id))",
)
def truth_separation(spark, d):
    """Which projections carry columns a scorer or the lifecycle may not see."""
    from vislens.plans.cohort import safe_projection
    from vislens.plans.detector import scores

    frames = {
        "scoring_input": safe_projection(spark, d), "lifecycle_input": wl.admissions(spark, d).select("item_id", "arrival_us", "lane", "val_us", "source_ok", "revoke_us"),
        "cohort_rows": posts(spark, d), "detector_scores": scores(spark, d),
    }
    out = None
    for name, df in frames.items():
        found = ",".join(sorted(co.forbidden_columns(df)))
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("projection"), "n_rows", F.lit(found).alias("forbidden"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "numeric_projection_diff",
    """SELECT side, path, value FROM (SELECT 'left' AS side, path, value FROM (SELECT 'customer/' || c_custkey || '/acctbal' AS path, c_acctbal AS value FROM customer WHERE c_custkey % 50 <> 1 EXCEPT ALL SELECT 'customer/' || c_custkey || '/acctbal', c_acctbal + CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END FROM customer WHERE c_custkey % 50 <> 1)
  UNION ALL SELECT 'right', path, value FROM (SELECT 'customer/' || c_custkey || '/acctbal' AS path, c_acctbal + CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END AS value FROM customer WHERE c_custkey % 50 <> 1 EXCEPT ALL SELECT 'customer/' || c_custkey || '/acctbal', c_acctbal FROM customer WHERE c_custkey % 50 <> 1))""",
)
def numeric_projection_diff(spark, d):
    """Numeric leaves of two artifacts, outside a listed exclusion, that do not agree."""
    c = src.table(spark, d, "customer").filter("c_custkey % 50 <> 1")
    path = F.concat_ws("/", F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("acctbal")).alias("path")
    moved = F.when(F.col("c_custkey") % 100 == 0, 1).otherwise(0)
    left, right = c.select(path, F.col("c_acctbal").alias("value")), c.select(path, (F.col("c_acctbal") + moved).alias("value"))
    return qa.multiset_difference(left, right).select("side", "path", "value")


@query(
    "landing_violations",
    """SELECT item_key, unnest(list_filter([CASE WHEN (rank <= 5) <> stored THEN 'rank_vs_landed' END, CASE WHEN list_contains(string_split(top_keys, ','), item_key::VARCHAR) <> stored THEN 'membership' END, CASE WHEN len(string_split(top_keys, ',')) <> 5 THEN 'top5_size' END], lambda r: r IS NOT NULL)) AS rule
  FROM (SELECT item_key, rank, top_keys, CASE WHEN item_key % 75 = 2 THEN NOT rank <= 5 ELSE rank <= 5 END AS stored FROM w_landing JOIN w_landing_top USING (item_key))""",
)
def landing_violations(spark, d):
    l = landing(spark, d).withColumn("stored", F.col("landed") != (F.col("item_key") % 75 == 2))
    return qa.broken_rules(
        l, ["item_key"],
        {"rank_vs_landed": F.col("landed") != F.col("stored"), "membership": F.array_contains("top_keys", F.col("item_key")) != F.col("stored"), "top5_size": F.size("top_keys") != 5},
    )


@query(
    "run_record_violations",
    "SELECT block, baseline, unnest(list_filter([CASE WHEN q50 > p95 OR p95 > p99 THEN 'percentiles_not_monotone' END, CASE WHEN abs(throughput * 45 - n) > 1e-6 THEN 'throughput' END, CASE WHEN n < 300 THEN 'few_samples' END], lambda r: r IS NOT NULL)) AS rule FROM (SELECT *, CASE WHEN block = 3 THEN p99 + 1 ELSE p50 END AS q50 FROM w_cells8)",
)
def run_record_violations(spark, d):
    """Per-cell records checked for internal balance; one block's median is planted wrong."""
    c = block_cells(spark, d).withColumn("q50", F.when(F.col("block") == 3, F.col("p99") + 1).otherwise(F.col("p50")))
    rules = {
        "percentiles_not_monotone": (F.col("q50") > F.col("p95")) | (F.col("p95") > F.col("p99")), "throughput": F.abs(F.col("throughput") * 45 - F.col("n")) > 1e-6, "few_samples": F.col("n") < 300,
    }
    return qa.broken_rules(c, ["block", "baseline"], rules)


_ATTR = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query("record_set_checks", " UNION ALL ".join(f"SELECT '{a}' AS attribute, count(DISTINCT {a}) AS distinct_values, count(DISTINCT {a}) = 1 AS single, count(*) - count({a}) AS missing FROM orders" for a in _ATTR))
def record_set_checks(spark, d):
    """How many values each attribute of a record set takes: distinct (attribute, value) first, then counts."""
    o = src.table(spark, d, "orders").select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("v")) for a in _ATTR])).alias("r")).select("r.*")
    per = o.groupBy("attribute", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("attribute").agg(F.count("v").alias("distinct_values"), (F.count("v") == 1).alias("single"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


cte(
    "w_cellold",
    """SELECT * FROM w_cellsum UNION ALL SELECT * REPLACE (1 AS contained, 1 AS quarantined) FROM w_cellsum WHERE baseline = 'B1' UNION ALL SELECT * REPLACE (1 AS eu_started) FROM w_cellsum WHERE baseline = 'B2'
  UNION ALL SELECT * REPLACE (2 AS hidden) FROM w_cellsum WHERE baseline = 'B3' UNION ALL SELECT * REPLACE (1 AS eu_censored, 0 AS readmitted) FROM w_cellsum WHERE baseline = 'B4'""",
)


@query(
    "legacy_invariants",
    """SELECT rule, count(*) AS records, count(*) FILTER (WHERE bad) AS violations FROM (SELECT unnest([{'rule': 'b1_contains', 'bad': baseline = 'B1' AND contained > 0}, {'rule': 'b1_quarantines', 'bad': baseline = 'B1' AND quarantined > 0}, {'rule': 'b2_unvetted', 'bad': baseline = 'B2' AND eu_started > 0},
  {'rule': 'b3_hides', 'bad': baseline = 'B3' AND hidden > 0}, {'rule': 'b4_open_episode', 'bad': baseline = 'B4' AND eu_censored > 0}, {'rule': 'detector_readmits_some', 'bad': baseline = 'B4' AND arm = 'detector' AND readmitted = 0}], recursive := true) FROM w_cellold) GROUP BY 1""",
)
def legacy_invariants(spark, d):
    """Older rules per policy, over the cells and over cells that break them on purpose."""
    cells = cut_lineage(cell_summary(spark, d))
    one, b = F.lit(1).cast("bigint"), F.col("baseline")
    changes = {"B1": {"contained": one, "quarantined": one}, "B2": {"eu_started": one}, "B3": {"hidden": one + 1}, "B4": {"eu_censored": one, "readmitted": one - 1}}
    rows = cells
    for name, change in changes.items():
        rows = rows.unionByName(cells.filter(b == name).withColumns(change))
    zero = lambda name, field: (b != name) | (F.col(field) == 0)
    return qa.identity_counts(
        rows,
        {
            "b1_contains": zero("B1", "contained"), "b1_quarantines": zero("B1", "quarantined"), "b2_unvetted": zero("B2", "eu_started"), "b3_hides": zero("B3", "hidden"),
            "b4_open_episode": zero("B4", "eu_censored"), "detector_readmits_some": (b != "B4") | (F.col("arm") != "detector") | (F.col("readmitted") > 0),
        },
    )
