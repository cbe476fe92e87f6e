"""Registered queries: rules recomputed over stored records, each with faults planted by a rule of its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vislens.functions.stats import count_if, ratio
from vislens.operators import calibration as cal
from vislens.operators import compare as cm
from vislens.operators import design as de
from vislens.operators import detector as det
from vislens.operators import eligibility as elig
from vislens.operators import lifecycle as lc
from vislens.operators import quality as qa
from vislens.operators.cohort import hash_ordered_take
from vislens.operators.lifecycle import CELL, DAY_US
from vislens.operators.ordered import neighbours, quantiles, rank_by, time_chunk
from vislens.plans import workload as wl
from vislens.plans.cohort import allocated, groups
from vislens.plans.compare import block_cells
from vislens.plans.detector import scored_items
from vislens.plans.registry import cte, query
from vislens.plans.retrieval import landing
from vislens.plans.retrieval_log import ROLES, log
from vislens.session import cut_lineage
from vislens.sources import tables as src

# ---- H15: the query log against its schedule and against when keys were inserted

cte(
    "w_storedlog",
    """SELECT r.probe, r.t_us, a.user_id, CASE WHEN r.probe % 83 = 0 THEN horizon_us + 1 WHEN r.probe % 89 = 0 THEN r.t_us - 864000000000 ELSE r.t_us END AS st, start_us, horizon_us,
    CASE WHEN r.probe % 97 = 0 THEN 'other' ELSE r.role END AS srole, CASE (r.probe % (SELECT count(*) FROM w_queries)) % 3 WHEN 0 THEN 'attack_associated' WHEN 1 THEN 'heldout_same_topic' ELSE 'negative_other_topic' END AS wanted,
    CASE WHEN r.probe % 79 = 0 THEN list_append(returned, (SELECT item_id FROM w_adm WHERE item_id % 3 <> 0 ORDER BY arrival_us DESC, item_id DESC LIMIT 1)) ELSE returned END AS keys
  FROM w_ret r JOIN w_adm a ON a.item_id = r.probe CROSS JOIN w_hor WHERE r.backlog = 'normal' AND r.baseline = 'B1'""",
)


@query(
    "retrieval_event_violations",
    """WITH o AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY t_us, probe) AS prev FROM w_storedlog)
SELECT probe, 'schedule' AS rule FROM o WHERE srole <> wanted UNION ALL SELECT probe, 'event_order' FROM o WHERE st < prev UNION ALL SELECT probe, 'window' FROM o WHERE st NOT BETWEEN start_us AND horizon_us
UNION ALL SELECT DISTINCT o.probe, 'future_key' FROM (SELECT probe, st, unnest(keys) AS id FROM o) o JOIN w_adm a ON a.item_id = o.id WHERE o.id % 3 <> 0 AND a.arrival_us > o.st""",
)
def retrieval_event_violations(spark, d):
    """Roles off the schedule, times out of order or outside the run, and returned keys that were not inserted yet."""
    a = wl.admissions(spark, d)
    last = a.filter("item_id % 3 <> 0").agg(F.max(F.struct("arrival_us", "item_id"))["item_id"].alias("id")).scalar()
    n = src.queries(src.items(spark, d)).agg(F.count(F.lit(1))).scalar()
    p, t = F.col("probe"), F.col("t_us")
    l = log(spark, d, ["B1"]).filter("backlog = 'normal'").select("probe", "t_us", "role", "returned").join(a.select(F.col("item_id").alias("probe"), "user_id"), "probe")
    l = l.withColumns({"horizon_us": wl.horizon(spark, d), "start_us": wl.start(spark, d), "last": last, "n": n})
    l = cut_lineage(
        l.select(
            "probe", "t_us", "user_id", "start_us", "horizon_us", F.when(p % 83 == 0, F.col("horizon_us") + 1).when(p % 89 == 0, t - 10 * DAY_US).otherwise(t).alias("st"),
            F.when(p % 97 == 0, "other").otherwise(F.col("role")).alias("srole"), F.element_at(F.array(*[F.lit(r) for r in ROLES]), (p % F.col("n") % 3 + 1).cast("int")).alias("wanted"),
            F.when(p % 79 == 0, F.concat("returned", F.array("last"))).otherwise(F.col("returned")).alias("keys"),
        )
    )
    o = neighbours(l.drop("keys"), ["user_id"], time_chunk("t_us", DAY_US), F.struct("t_us", "probe"), prev={"prev": "st"})
    rules = {"schedule": F.col("srole") != F.col("wanted"), "event_order": F.col("st") < F.col("prev"), "window": ~F.col("st").between(F.col("start_us"), F.col("horizon_us"))}
    keys = l.select("probe", "st", F.explode("keys").alias("item_id")).filter("item_id % 3 <> 0")
    future = keys.join(a.select("item_id", "arrival_us"), "item_id").filter("arrival_us > st").select("probe").distinct()
    return qa.broken_rules(o, ["probe"], rules).unionByName(future.withColumn("rule", F.lit("future_key")))


# ---- K3, M17: donors by the smallest hash of a pair, and a stored plan against them

cte(
    "w_pairdonor",
    """SELECT owner, topic, donor FROM (SELECT o.id AS owner, o.topic, c.id AS donor, row_number() OVER (PARTITION BY o.id ORDER BY sha256('pair|' || o.id || '|' || c.id), c.id) AS rn FROM w_items o JOIN w_items c ON c.topic = o.topic AND o.slot = 0 AND c.slot = 1) WHERE rn = 1""",
)


def pair_donors(spark, d):
    it = src.items(spark, d)
    owners, donors = it.filter("slot = 0").select(F.col("id").alias("owner"), "topic"), it.filter("slot = 1").select(F.col("id").alias("donor"), "topic")
    return owners.join(de.smallest_pair_hash(owners, donors, "pair", owner_group="topic", donor_group="topic"), "owner")


@query("pairwise_donors", "SELECT owner, topic, donor FROM w_pairdonor")
def pairwise_donors(spark, d):
    """The donor of every owner within its topic: the smallest hash of owner and candidate together."""
    return pair_donors(spark, d).select("owner", "topic", "donor")


@query(
    "donor_plan_violations",
    """WITH s AS (SELECT owner, topic, donor AS wanted, CASE WHEN owner % 7 = 3 THEN donor + 25 WHEN owner % 11 = 4 THEN owner ELSE donor END AS donor FROM w_pairdonor),
j AS (SELECT s.*, i.slot, i.topic AS donor_topic, count(*) OVER (PARTITION BY s.donor) AS used FROM s LEFT JOIN w_items i ON i.id = s.donor)
SELECT owner, unnest(list_filter([CASE WHEN donor <> wanted THEN 'donor' END, CASE WHEN slot IS DISTINCT FROM 1 THEN 'selection' END, CASE WHEN slot = 1 AND donor_topic <> topic THEN 'topic' END, CASE WHEN used > 3 THEN 'reuse' END], lambda r: r IS NOT NULL)) AS rule FROM j""",
)
def donor_plan_violations(spark, d):
    """A stored plan with wrong donors planted: another donor than the rule gives, one that is none, of another topic, or used too often."""
    it = src.items(spark, d).select(F.col("id").alias("donor"), "slot", F.col("topic").alias("donor_topic"))
    o = F.col("owner")
    s = pair_donors(spark, d).withColumnRenamed("donor", "wanted")
    s = cut_lineage(s.withColumn("donor", F.when(o % 7 == 3, F.col("wanted") + 25).when(o % 11 == 4, o).otherwise(F.col("wanted"))))
    used = s.groupBy("donor").agg(F.count(F.lit(1)).alias("used"))
    j = s.join(used, "donor").join(it, "donor", "left")
    slot = F.col("slot")
    rules = {
        "donor": F.col("donor") != F.col("wanted"), "selection": ~slot.eqNullSafe(F.lit(1)), "topic": (slot == 1) & (F.col("donor_topic") != F.col("topic")), "reuse": F.col("used") > 3,
    }
    return qa.broken_rules(j, ["owner"], rules)


# ---- M4, M6: sweeps over wrongly promoted items and over the deadline

cte("w_base", "SELECT seed, sum(visible_us)::BIGINT AS base_us FROM w_facts WHERE baseline = 'B4' AND arm = 'oracle' AND backlog = 'heavy' AND poison GROUP BY 1")
cte(
    "w_storedsweep",
    """SELECT seed, k, list_sort(list(item_id) FILTER (WHERE rn <= k AND NOT (seed = 2 AND k = 3 AND rn = 1))) AS chosen, (sum(CASE WHEN rn <= k THEN v_pass ELSE v_fail END) + CASE WHEN seed = 1 AND k = 0 THEN 1 ELSE 0 END)::BIGINT AS exposure_us,
    count(*) FILTER (WHERE rn <= k AND late) + CASE WHEN seed = 3 AND k = 3 THEN 1 ELSE 0 END AS readmitted, count(*) FILTER (WHERE rn <= k AND late) AS late FROM w_sweep0 CROSS JOIN (VALUES (0), (1), (2), (3)) k(k) GROUP BY seed, k""",
)


@query(
    "sweep_violations",
    """SELECT seed, k, rule FROM (SELECT s.seed, s.k, unnest(list_filter([CASE WHEN s.k = 0 AND exposure_us <> base_us THEN 'k0_is_the_base_run' END, CASE WHEN prev IS NOT NULL AND len(list_filter(prev, lambda x: NOT list_contains(coalesce(chosen, []), x))) > 0 THEN 'nested' END,
  CASE WHEN readmitted <> late THEN 'readmitted' END, CASE WHEN before > exposure_us THEN 'monotone' END], lambda r: r IS NOT NULL)) AS rule FROM (SELECT *, lag(chosen) OVER w AS prev, lag(exposure_us) OVER w AS before FROM w_storedsweep WINDOW w AS (PARTITION BY seed ORDER BY k)) s JOIN w_base b ON b.seed = s.seed)
UNION ALL SELECT seed, NULL, 'undefended_run_moves' FROM (SELECT seed, count(*) FILTER (WHERE CASE WHEN source_ok THEN horizon_us - arrival_us ELSE 0 END <> visible_us) AS n FROM w_facts WHERE baseline = 'B1' AND arm = 'oracle' AND backlog = 'heavy' AND poison GROUP BY 1) WHERE n > 0""",
)
def sweep_violations(spark, d):
    """A stored sweep against the run it starts from: k = 0 is that run, sets are nested, what comes back is what was promoted late."""
    a = wl.admissions(spark, d).filter("poison").withColumn("h", F.struct(elig.seeded_hash(70, "item_id"), "item_id"))
    top = hash_ordered_take(a, ["seed"], "h", 3).select("item_id", "rank")
    plan = cut_lineage(wl.plan(spark, d, ["B1", "B4"]).filter("arm = 'oracle' AND backlog = 'heavy' AND poison"))
    base = lc.with_facts(lc.ledger(plan, wl.TP_US)).select("baseline", "seed", "visible_us")
    # verdicts turned round: of the undefended run nothing may move
    both = plan.withColumn("passes", F.explode(F.array(F.lit(True), F.lit(False))))
    f = lc.with_facts(lc.ledger(both, wl.TP_US)).select("baseline", "seed", "item_id", "passes", "visible_us", (F.size("trans") > 2).alias("late"))
    per = cut_lineage(
        f.groupBy("baseline", "seed", "item_id").agg(
            F.max(F.when(F.col("passes"), F.col("visible_us"))).alias("v_pass"), F.max(F.when(~F.col("passes"), F.col("visible_us"))).alias("v_fail"), F.max(F.col("passes") & F.col("late")).alias("late")
        )
    )
    moved = per.filter("baseline = 'B1' AND v_pass <> v_fail").select("seed").distinct().select("seed", F.lit(None).cast("int").alias("k"), F.lit("undefended_run_moves").alias("rule"))
    rows = per.filter("baseline = 'B4'").join(top, "item_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    picked = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    kept = picked & ~((F.col("seed") == 2) & (F.col("k") == 3) & (F.col("rank") == 1))
    s = rows.groupBy("seed", "k").agg(
        F.collect_set(F.when(kept, F.col("item_id"))).alias("chosen"),  # three at most
        F.sum(F.when(picked, F.col("v_pass")).otherwise(F.col("v_fail"))).alias("exposure_us"), count_if(picked & F.col("late")).alias("late"),
    )
    s = s.withColumns(
        {
            "readmitted": F.col("late") + F.when((F.col("seed") == 3) & (F.col("k") == 3), 1).otherwise(0),
            "exposure_us": F.col("exposure_us") + F.when((F.col("seed") == 1) & (F.col("k") == 0), 1).otherwise(0),
        }
    )
    w = W.partitionBy("seed").orderBy("k")  # four rows per seed
    s = s.withColumns({"prev": F.lag("chosen").over(w), "before": F.lag("exposure_us").over(w)})
    s = s.join(base.filter("baseline = 'B4'").groupBy("seed").agg(F.sum("visible_us").alias("base_us")), "seed")
    rules = {
        "k0_is_the_base_run": (F.col("k") == 0) & (F.col("exposure_us") != F.col("base_us")), "nested": F.size(F.array_except("prev", "chosen")) > 0,
        "readmitted": F.col("readmitted") != F.col("late"), "monotone": F.col("before") > F.col("exposure_us"),
    }
    return qa.broken_rules(s, ["seed", "k"], rules).unionByName(moved)


TP_GRID = (60, 150, 600, 3600)


@query(
    "deadline_exposure",
    f"""SELECT tp_s, exposure_us, stored_us, coalesce(stored_us >= lag(stored_us) OVER (ORDER BY tp_s), true) AS nondecreasing, stored_us = exposure_us AS same FROM (SELECT tp_s, e AS exposure_us, CASE WHEN tp_s = 600 THEN e // 100 ELSE e END AS stored_us FROM (
  SELECT g.tp_s, sum(CASE WHEN source_ok THEN least(least(commit_us, arrival_us + g.tp_s::BIGINT * 1000000), horizon_us) - arrival_us ELSE 0 END)::BIGINT AS e FROM w_plan CROSS JOIN (VALUES {", ".join(f"({t})" for t in TP_GRID)}) g(tp_s) WHERE baseline = 'B4' AND arm = 'oracle' AND backlog = 'heavy' AND poison GROUP BY 1))""",
)
def deadline_exposure(spark, d):
    """Poison exposure under growing deadlines, recomputed and as stored; one stored value is planted too small."""
    p = wl.plan(spark, d, ["B4"]).filter("arm = 'oracle' AND backlog = 'heavy' AND poison").withColumn("tp_s", F.explode(F.array(*[F.lit(t) for t in TP_GRID])))
    f = lc.with_facts(lc.ledger(p, F.col("tp_s").cast("bigint") * 1_000_000))
    e = f.groupBy("tp_s").agg(F.sum("visible_us").alias("exposure_us"))
    e = e.withColumn("stored_us", F.when(F.col("tp_s") == 600, F.floor(F.col("exposure_us") / 100)).otherwise(F.col("exposure_us")))
    w = W.partitionBy(F.lit(0)).orderBy("tp_s")  # a row for each deadline
    return e.select("tp_s", "exposure_us", "stored_us", F.coalesce(F.col("stored_us") >= F.lag("stored_us").over(w), F.lit(True)).alias("nondecreasing"), (F.col("stored_us") == F.col("exposure_us")).alias("same"))


# ---- M13, M16, M18, M19: stored summaries against what the observations give


@query(
    "recomputed_summaries",
    """WITH p AS (SELECT block, baseline, n::DOUBLE AS n, p50, CASE WHEN block = 3 THEN p95 + 1 ELSE p95 END AS p95, p99, throughput FROM w_cells8 WHERE NOT (block = 5 AND baseline = 'B1')),
b AS (SELECT w.block || '/' || w.baseline AS key, p.n AS pn, w.n::DOUBLE AS n, p.p50 AS pp50, w.p50 AS p50, p.p95 AS pp95, w.p95 AS p95, p.p99 AS pp99, w.p99 AS p99, p.throughput AS pt, w.throughput AS t, p.n IS NOT NULL AS there FROM w_cells8 w LEFT JOIN p ON p.block = w.block AND p.baseline = w.baseline),
e AS (SELECT event_type AS key, count(*)::DOUBLE AS n, count(*) FILTER (WHERE value > 50)::DOUBLE AS hits FROM events GROUP BY 1)
SELECT section, key, field, published, recomputed, there AND abs(published - recomputed) <= 1e-6 AS same FROM (
  SELECT 'cells' AS section, key, 'n' AS field, pn AS published, n AS recomputed, there FROM b UNION ALL SELECT 'cells', key, 'p50', pp50, p50, there FROM b UNION ALL SELECT 'cells', key, 'p95', pp95, p95, there FROM b UNION ALL SELECT 'cells', key, 'p99', pp99, p99, there FROM b UNION ALL SELECT 'cells', key, 'throughput', pt, t, there FROM b
  UNION ALL SELECT 'events', key, 'n', n, n, true FROM e UNION ALL SELECT 'events', key, 'hits', hits + CASE WHEN key = 'click' THEN 1 ELSE 0 END, hits, true FROM e)""",
)
def recomputed_summaries(spark, d):
    """Published cell and event summaries, with one wrong percentile, one wrong count and one lost cell, against the raw rows."""
    cells = cut_lineage(block_cells(spark, d).select("block", "baseline", "n", "p50", "p95", "p99", "throughput"))
    published = cells.filter("NOT (block = 5 AND baseline = 'B1')").withColumn("p95", F.when(F.col("block") == 3, F.col("p95") + 1).otherwise(F.col("p95")))
    e = src.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("value") > 50).alias("hits"))
    stored = e.withColumn("hits", F.col("hits") + F.when(F.col("event_type") == "click", 1).otherwise(0))
    out = qa.recompute_report({"cells": published, "events": stored}, {"cells": cells, "events": e}, {"cells": ["block", "baseline"], "events": ["event_type"]})
    return out.withColumn("same", F.coalesce("same", F.lit(False)))


@query(
    "landing_completeness",
    """WITH s AS (SELECT item_key, family, rank <= 5 AS landed FROM w_landing WHERE item_key % 125 <> 2 UNION ALL SELECT item_key, family, rank <= 5 FROM w_landing WHERE item_key % 250 = 27),
e AS (SELECT 'F' || (p.id % 3) AS family, count(*) AS expected FROM w_items p JOIN w_attack c ON c.qid = p.id - 1 WHERE p.slot = 2 GROUP BY 1), f AS (SELECT family, count(*) AS found, count(DISTINCT item_key) AS keys, count(*) FILTER (WHERE landed) AS landed FROM s GROUP BY 1)
SELECT e.family, expected, coalesce(found, 0) AS found, expected - coalesce(keys, 0) AS missing, coalesce(found - keys, 0) AS repeated, round(landed / found::DOUBLE, 6) AS rate, round(CASE WHEN e.family = 'F1' THEN (landed + 1) / found::DOUBLE ELSE landed / found::DOUBLE END, 6) AS stored_rate, e.family <> 'F1' AS rate_same FROM e LEFT JOIN f USING (family)""",
)
def landing_completeness(spark, d):
    """Per family: landing rows that are lost or repeated (both planted), and the stored rate against the recomputed one."""
    it = src.items(spark, d)
    l = landing(spark, d).select("item_key", "family", "landed")
    stored = l.withColumn("n", F.when(F.col("item_key") % 125 == 2, 0).when(F.col("item_key") % 250 == 27, 2).otherwise(1))
    stored = stored.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    own = it.filter("slot = 2").select(F.col("id").alias("item_key")).join(src.queries(it, 1).select((F.col("query_id") + 1).alias("item_key")), "item_key")
    want = own.groupBy(F.concat(F.lit("F"), F.col("item_key") % 3).alias("family")).agg(F.count(F.lit(1)).alias("expected"))
    per = stored.groupBy("family", "item_key").agg(F.count(F.lit(1)).alias("n"), F.max("landed").alias("landed"))
    have = per.groupBy("family").agg(F.sum("n").alias("found"), F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("landed"), F.col("n")).otherwise(0)).alias("landed"))
    j = want.join(have, "family", "left")
    rate = F.round(ratio(F.col("landed"), F.col("found")), 6)
    shown = F.round(ratio(F.col("landed") + F.when(F.col("family") == "F1", 1).otherwise(0), F.col("found")), 6)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "family", "expected", zero(F.col("found")).alias("found"), (F.col("expected") - zero(F.col("keys"))).alias("missing"), zero(F.col("found") - F.col("keys")).alias("repeated"),
        rate.alias("rate"), shown.alias("stored_rate"), (shown == rate).alias("rate_same"),
    )


@query(
    "run_total_violations",
    """SELECT backlog, baseline, arm, unnest(list_filter([CASE WHEN wrong > 0 THEN 'recall' END, CASE WHEN stored_total <> total THEN 'totals' END, CASE WHEN stored_live <> live THEN 'live_groups' END], lambda r: r IS NOT NULL)) AS rule, wrong FROM (
  SELECT backlog, baseline, arm, count(*) AS total, count(*) + CASE WHEN baseline = 'B3' THEN 1 ELSE 0 END AS stored_total, count(DISTINCT qid) AS live, count(DISTINCT qid) - CASE WHEN baseline = 'B2' THEN 1 ELSE 0 END AS stored_live,
    count(*) FILTER (WHERE recall IS NOT NULL AND baseline <> 'B1' AND probe % 61 = 0) AS wrong FROM w_ret GROUP BY backlog, baseline, arm)""",
)
def run_total_violations(spark, d):
    """Stored recalls, probe totals and live query groups of every cell against the lists themselves; each is planted wrong somewhere."""
    l = log(spark, d).select(*CELL, "probe", "query_id", "returned", "eligible", "recall")
    planted = (F.col("baseline") != "B1") & (F.col("probe") % 61 == 0)
    l = l.withColumn("stored", F.when(planted, F.col("recall") - 0.2).otherwise(F.col("recall")))
    again = ratio(F.size(F.array_intersect("returned", "eligible")), F.size("eligible"))
    per = l.groupBy(*CELL, "query_id").agg(F.count(F.lit(1)).alias("n"), count_if(~qa.within_tolerance(F.col("stored"), again, 1e-9)).alias("wrong"))
    s = per.groupBy(*CELL).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("live"), F.sum("wrong").alias("wrong"))
    b = F.col("baseline")
    s = s.withColumns({"stored_total": F.col("total") + F.when(b == "B3", 1).otherwise(0), "stored_live": F.col("live") - F.when(b == "B2", 1).otherwise(0)})
    return qa.broken_rules(s, [*CELL, "wrong"], {"recall": F.col("wrong") > 0, "totals": F.col("stored_total") != F.col("total"), "live_groups": F.col("stored_live") != F.col("live")}).select(*CELL, "rule", "wrong")


#: A declared profile: the tier that all records must have, and the families that must be there.
PROFILE = {"tier": "F", "families": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-DECLARED")}


@query(
    "profile_violations",
    """SELECT rule, value, n FROM (SELECT 'undeclared_tier' AS rule, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2 UNION ALL SELECT 'absent_family', f.f, 0 FROM (VALUES """
    + ", ".join(f"('{f}')" for f in PROFILE["families"])
    + """) f(f) WHERE f.f NOT IN (SELECT o_orderpriority FROM orders) UNION ALL SELECT 'undeclared_family', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ("""
    + ", ".join(f"'{f}'" for f in PROFILE["families"])
    + """) GROUP BY 2 UNION ALL SELECT 'repeated_record', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders HAVING count(*) > count(DISTINCT o_orderkey))""",
)
def profile_violations(spark, d):
    """Records outside the declared profile, and families that are declared and absent."""
    o = src.table(spark, d, "orders")
    tier = o.filter(F.col("o_orderstatus") != PROFILE["tier"]).groupBy(F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("undeclared_tier"))
    seen = cut_lineage(o.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    declared = spark.createDataFrame([(f,) for f in PROFILE["families"]], "value string")
    absent = declared.join(seen, "value", "left_anti").select("value", F.lit(0).cast("bigint").alias("n"), F.lit("absent_family").alias("rule"))
    other = seen.join(declared, "value", "left_anti").withColumn("rule", F.lit("undeclared_family"))
    again = o.groupBy("o_orderkey").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit("o_orderkey").alias("value"), "n", F.lit("repeated_record").alias("rule"))
    return tier.unionByName(absent).unionByName(other).unionByName(again).select("rule", "value", "n")


@query(
    "cohort_recompute_violations",
    """WITH s AS (SELECT CASE WHEN gid[1] = '1' THEN 'x' || gid ELSE gid END AS gid, CASE WHEN gid[1] = '2' THEN topic || '?' ELSE topic END AS topic, split, stratum FROM w_alloc UNION ALL SELECT gid, topic, 'calibration', 'calibration_ordinary' FROM w_alloc WHERE stratum = 'test_ordinary' AND gid[1] IN ('0', '4'))
SELECT gid, 'disjoint_splits' AS rule FROM s GROUP BY gid HAVING count(DISTINCT split) > 1 UNION ALL SELECT gid, 'one_row_a_group' FROM s GROUP BY gid HAVING count(*) > 1
UNION ALL SELECT gid, 'unknown_group' FROM s ANTI JOIN w_groups USING (gid) UNION ALL SELECT s.gid, 'topic' FROM s JOIN w_groups g ON g.gid = s.gid WHERE g.topic <> s.topic""",
)
def cohort_recompute_violations(spark, d):
    """A frozen cohort with faults planted, against duplicate groups recomputed from the texts: splits, one row a group, known groups, topics."""
    a = allocated(spark, d).select("gid", "topic", "split", "stratum")
    first = F.substring("gid", 1, 1)
    twice = a.filter((F.col("stratum") == "test_ordinary") & first.isin("0", "4")).withColumns({"split": F.lit("calibration"), "stratum": F.lit("calibration_ordinary")})
    s = a.withColumns({"topic": F.when(first == "2", F.concat("topic", F.lit("?"))).otherwise(F.col("topic")), "gid": F.when(first == "1", F.concat(F.lit("x"), "gid")).otherwise(F.col("gid"))})
    s = cut_lineage(s.unionByName(twice))
    again = cut_lineage(groups(spark, d).select("gid", F.col("topic").alias("own")))
    per = s.groupBy("gid").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n"))
    lost = s.join(again, "gid", "left_anti").select("gid", F.lit("unknown_group").alias("rule"))
    moved = s.join(again, "gid").filter("own <> topic").select("gid", F.lit("topic").alias("rule"))
    return qa.broken_rules(per, ["gid"], {"disjoint_splits": F.col("splits") > 1, "one_row_a_group": F.col("n") > 1}).unionByName(lost).unionByName(moved)


# ---- I6, I7: decisions at the threshold that calibration selects

cte("w_vscore", "SELECT c.id, c.phase, round(c.c_score, 6) AS c_score, c.s_affirms, c.service_ns, i.topic % 3 = 0 AS poison FROM w_cscore c JOIN w_items i ON i.id = c.id")
cte("w_vsteps", "SELECT s, lead(s) OVER (ORDER BY s) AS nx, lag(s) OVER (ORDER BY s) AS pv, sum(n) OVER (ORDER BY s) AS nu, sum(p) OVER (ORDER BY s) AS pu FROM (SELECT c_score AS s, count(*) AS n, count(*) FILTER (WHERE poison) AS p FROM w_vscore WHERE phase = 'calibration' GROUP BY 1)")
cte(
    "w_vthr",
    """SELECT threshold FROM (SELECT threshold, coalesce(2 * (p - pb) / nullif((2 * (p - pb) + n - nb - (p - pb) + pb)::DOUBLE, 0), 0) AS f1 FROM (
  SELECT coalesce(s + (nx - s) * 0.5, nextafter(s, 'inf'::DOUBLE)) AS threshold, nu AS nb, pu AS pb FROM w_vsteps UNION ALL SELECT nextafter(s, '-inf'::DOUBLE), 0, 0 FROM w_vsteps WHERE pv IS NULL)
  CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (WHERE poison) AS p FROM w_vscore WHERE phase = 'calibration')) ORDER BY f1 DESC, threshold DESC LIMIT 1""",
)


@query(
    "calibrated_job",
    "SELECT sha256('vislens-item|' || id) AS item_key, s_affirms AS family_s_affirms, c_score, round(threshold, 6) AS threshold, s_affirms AND c_score < threshold AS promote, service_ns FROM w_vscore CROSS JOIN w_vthr WHERE phase = 'test'",
)
def calibrated_job(spark, d):
    """The test phase of the scoring job at the threshold of largest F1 over the calibration phase; the topic stands in for the label."""
    label = src.items(spark, d).select("id", (F.col("topic") % 3 == 0).alias("poison"))
    s = cut_lineage(scored_items(spark, d).withColumn("c_score", F.round("c_score", 6)).join(label, "id"))
    best = cal.select_threshold(cal.threshold_candidates(s.filter("phase = 'calibration'"), "c_score", "poison"))
    job = det.score_job(s, "test", best.select("threshold").scalar())
    return job.select("item_key", "family_s_affirms", "c_score", "promote", "service_ns").crossJoin(F.broadcast(best.select(F.round("threshold", 6).alias("threshold"))))


# ---- L7, L10, L13, L16, L19


@query(
    "query_latency",
    "SELECT event_type, count(*) AS completed, round(quantile_cont(val_us * 40, 0.5), 3) AS latency_p50, round(quantile_cont(val_us * 40, 0.95), 3) AS latency_p95, round(quantile_cont(val_us * 40, 0.99), 3) AS latency_p99, max(val_us * 40) AS latency_max FROM w_adm WHERE source_ok GROUP BY 1",
)
def query_latency(spark, d):
    """Latency of completed queries beside their throughput."""
    a = wl.admissions(spark, d).filter("source_ok").select("event_type", (F.col("val_us") * 40).alias("latency"))
    q = quantiles(a, ["event_type"], "latency", {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99})
    agg = a.groupBy("event_type").agg(F.count(F.lit(1)).alias("completed"), F.max("latency").alias("latency_max"))
    return agg.join(q.select("event_type", *[F.round(c, 3).alias(c) for c in ("latency_p50", "latency_p95", "latency_p99")]), "event_type")


@query(
    "design_expected",
    """SELECT kind, first, second, n, round(sum(n) OVER (PARTITION BY kind, CASE WHEN kind = 'position' THEN second END) / CASE kind WHEN 'position' THEN 4.0::DOUBLE ELSE 16.0::DOUBLE END, 6) AS expected FROM (
  SELECT 'position' AS kind, baseline AS first, position::VARCHAR AS second, count(*) AS n FROM w_seq GROUP BY ALL UNION ALL SELECT 'carry_over', baseline, following, count(*) FROM w_seq WHERE following IS NOT NULL GROUP BY ALL)""",
)
def design_expected(spark, d):
    """Position and carry-over counts beside what a balanced design would give: a quarter of each position, a sixteenth of all transitions."""
    from vislens.plans.compare import design_balance

    c = design_balance(spark, d)  # some dozen rows
    own = W.partitionBy("kind", F.when(F.col("kind") == "position", F.col("second")))
    share = F.when(F.col("kind") == "position", 4.0).otherwise(16.0)
    return c.withColumn("expected", F.round(F.sum("n").over(own) / share, 6))


@query(
    "schedule_drift",
    """SELECT user_id, count(*) AS queries, round(quantile_cont(drift, 0.5), 3) AS drift_p50, max(abs(drift)) AS worst, max(abs(drift)) > 864000000000 AS excluded FROM (
  SELECT user_id, arrival_us - min(arrival_us) OVER (PARTITION BY user_id) - CAST(round(i * (1000000.0 / 24)) AS BIGINT) AS drift FROM (SELECT user_id, arrival_us, row_number() OVER (PARTITION BY user_id ORDER BY arrival_us, item_id) - 1 AS i FROM w_adm WHERE event_type = 'view')) GROUP BY 1""",
)
def schedule_drift(spark, d):
    """How far queries run behind their schedule, and users whose drift excludes them."""
    v = wl.admissions(spark, d).filter("event_type = 'view'").select("user_id", "item_id", "arrival_us")
    r = rank_by(v, ["user_id"], time_chunk("arrival_us", DAY_US), [F.col("arrival_us"), F.col("item_id")], "r").withColumn("i", F.col("r") - 1)
    s = de.schedule(r, "i", 24.0, ("a",), 1)
    first = v.groupBy("user_id").agg(F.min("arrival_us").alias("first_us"))
    s = cut_lineage(s.join(first, "user_id").select("user_id", (F.col("arrival_us") - F.col("first_us") - F.col("target_us")).alias("drift")))
    agg = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("queries"), F.max(F.abs("drift")).alias("worst"))
    q = quantiles(s, ["user_id"], "drift", {"drift_p50": 0.5}).select("user_id", F.round("drift_p50", 3).alias("drift_p50"))
    return agg.join(q, "user_id").withColumn("excluded", F.col("worst") > 10 * DAY_US)


_GRADE = "CASE WHEN abs(a - b) <= 1000 AND abs(a / b - 1) <= 0.05 THEN 0 WHEN abs(a - b) <= 4000 AND abs(a / b - 1) <= 0.10 THEN 1 ELSE 2 END"


@query(
    "claim_grades",
    f"""WITH s AS (SELECT l_suppkey % 8 AS block, 'B' || (l_partkey % 4 + 1) AS baseline, avg(l_extendedprice) FILTER (WHERE l_linenumber <= 3) AS b, avg(l_extendedprice) FILTER (WHERE l_linenumber > 3) AS a FROM lineitem GROUP BY ALL), g AS (SELECT block, baseline, {_GRADE} AS g FROM s)
SELECT 'B4_vs_' || o.baseline AS claim, count(*) AS blocks, count(*) FILTER (WHERE greatest(x.g, o.g) = 0) AS tight, count(*) FILTER (WHERE greatest(x.g, o.g) = 2) AS drifted, list_extract(['TIGHT', 'MILD', 'DRIFTED'], 1 + max(greatest(x.g, o.g))) AS grade FROM g x JOIN g o ON o.block = x.block AND o.baseline <> 'B4' WHERE x.baseline = 'B4' GROUP BY 1""",
)
def claim_grades(spark, d):
    """The grade of a claim is the worst control bracket of its two arms over all blocks."""
    l = src.table(spark, d, "lineitem")
    early, price = F.col("l_linenumber") <= 3, F.col("l_extendedprice")
    s = l.groupBy((F.col("l_suppkey") % 8).alias("block"), F.concat(F.lit("B"), F.col("l_partkey") % 4 + 1).alias("baseline")).agg(F.avg(F.when(early, price)).alias("before"), F.avg(F.when(~early, price)).alias("after"))
    names = ("TIGHT", "MILD", "DRIFTED")
    level = F.array_position(F.array(*[F.lit(n) for n in names]), cm.bracket(F.col("before"), F.col("after"), 2000.0)).cast("int")
    g = cut_lineage(s.select("block", "baseline", level.alias("g")))
    both = g.filter("baseline = 'B4'").select("block", F.col("g").alias("x")).join(g.filter("baseline <> 'B4'"), "block").withColumn("worst", F.greatest("x", "g"))
    return both.groupBy(F.concat(F.lit("B4_vs_"), "baseline").alias("claim")).agg(
        F.count(F.lit(1)).alias("blocks"), count_if(F.col("worst") == 1).alias("tight"), count_if(F.col("worst") == 3).alias("drifted"), F.element_at(F.array(*[F.lit(n) for n in names]), F.max("worst")).alias("grade")
    )


@query(
    "axis_levels",
    """SELECT axis, configured, count(*) AS sent, count(*) FILTER (WHERE configured <> got) AS off_level, round(avg(p) FILTER (WHERE probed) / avg(p) FILTER (WHERE NOT probed), 6) AS probe_overhead, avg(p) FILTER (WHERE probed) / avg(p) FILTER (WHERE NOT probed) > 1.2 AS too_much FROM (
  SELECT 'returnflag' AS axis, l_returnflag AS configured, CASE WHEN l_orderkey % 40 = 1 THEN 'X' ELSE l_returnflag END AS got, l_orderkey % 2 = 0 AS probed, l_quantity * CASE WHEN l_returnflag = 'R' AND l_orderkey % 2 = 0 THEN 1.5 ELSE 1 END AS p FROM lineitem
  UNION ALL SELECT 'linestatus', l_linestatus, l_linestatus, l_orderkey % 2 = 0, l_quantity FROM lineitem) GROUP BY ALL""",
)
def axis_levels(spark, d):
    """Levels that were sent against those configured, and what probing costs; a wrong level and a costly probe are planted."""
    l = src.table(spark, d, "lineitem")
    flag, odd, even, q = F.col("l_returnflag"), F.col("l_orderkey") % 40 == 1, F.col("l_orderkey") % 2 == 0, F.col("l_quantity").cast("double")
    one = lambda axis, configured, got, p: F.struct(F.lit(axis).alias("axis"), configured.alias("configured"), got.alias("got"), p.alias("p"))
    slow = q * F.when((flag == "R") & even, 1.5).otherwise(1.0)
    rows = l.select(even.alias("probed"), F.explode(F.array(one("returnflag", flag, F.when(odd, "X").otherwise(flag), slow), one("linestatus", F.col("l_linestatus"), F.col("l_linestatus"), q))).alias("r")).select("probed", "r.*")
    cost = F.avg(F.when(F.col("probed"), F.col("p"))) / F.avg(F.when(~F.col("probed"), F.col("p")))
    return rows.groupBy("axis", "configured").agg(F.count(F.lit(1)).alias("sent"), count_if(F.col("configured") != F.col("got")).alias("off_level"), F.round(cost, 6).alias("probe_overhead"), (cost > 1.2).alias("too_much"))
