"""Registered queries: comparison of arms, blocks and runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.functions.stats import count_if, ratio
from vislens.operators import compare as cm
from vislens.operators import lifecycle as lc
from vislens.operators.lifecycle import DAY_US
from vislens.operators.ordered import quantiles
from vislens.plans import lifecycle as pl
from vislens.plans import workload as wl
from vislens.plans.registry import cte, query
from vislens.plans.retrieval_log import log
from vislens.session import cut_lineage
from vislens.sources import tables as src

C = "backlog, baseline, arm"
BASES = ("B1", "B2", "B3", "B4")


@query(
    "runtime_rollup",
    f"""SELECT attack, arm, baseline, backlog, coalesce(seed, -1) AS seed, count(*) AS items, count(*) FILTER (WHERE poison) AS poison, count(first_visible_us) FILTER (WHERE poison) AS started, coalesce(sum(visible_us) FILTER (WHERE poison), 0)::BIGINT AS exposure_us,
  coalesce(sum(unavailable_us) FILTER (WHERE NOT poison), 0)::BIGINT AS unavailable_us, count(*) FILTER (WHERE vis_end) AS visible_at_end FROM w_life GROUP BY GROUPING SETS ((attack, arm, baseline, backlog, seed), (attack, arm, baseline, backlog))""",
)
def runtime_rollup(spark, d):
    f = wl.facts(spark, d)
    k4 = ["attack", "arm", "baseline", "backlog"]
    un = F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us")
    p = F.col("poison")
    g = f.groupingSets([[*k4, "seed"], k4], *k4, "seed").agg(
        F.count(F.lit(1)).alias("items"), count_if(p).alias("poison"), F.count(F.when(p, F.col("first_visible_us"))).alias("started"),
        F.coalesce(F.sum(F.when(p, F.col("visible_us"))), F.lit(0)).alias("exposure_us"), F.coalesce(F.sum(F.when(~p, un)), F.lit(0)).alias("unavailable_us"),
        count_if(lc.is_visible(F.col("state_end"))).alias("visible_at_end"),
    )
    return g.withColumn("seed", F.coalesce("seed", F.lit(-1)))


@query(
    "paired_contrast",
    """WITH f AS (SELECT * FROM w_life WHERE baseline <> 'B1' AND NOT (arm = 'detector' AND item_id % 97 = 5) AND NOT (arm = 'oracle' AND item_id % 89 = 7)),
j AS (SELECT coalesce(o.attack, d.attack) AS attack, coalesce(o.baseline, d.baseline) AS baseline, coalesce(o.backlog, d.backlog) AS backlog, coalesce(o.seed, d.seed) AS seed, o.item_id IS NOT NULL AND d.item_id IS NOT NULL AS paired, o.poison,
  d.visible_us - o.visible_us AS vis, d.unavailable_us - o.unavailable_us AS un, coalesce(d.unvetted_us, 0) - coalesce(o.unvetted_us, 0) AS unv, d.commit_us <= d.horizon_us AS done, d.passes,
  CASE WHEN d.commit_us <= d.horizon_us AND o.commit_us <= o.horizon_us THEN (d.commit_us - d.arrival_us) - (o.commit_us - o.arrival_us) END AS lat
  FROM (SELECT * FROM f WHERE arm = 'oracle') o FULL OUTER JOIN (SELECT * FROM f WHERE arm = 'detector') d ON d.item_id = o.item_id AND d.backlog = o.backlog AND d.baseline = o.baseline)
SELECT attack, baseline, backlog, seed, count(*) FILTER (WHERE paired) AS pairs, count(*) FILTER (WHERE NOT paired) AS unpaired, sum(vis) FILTER (WHERE paired AND poison)::BIGINT AS exposure_diff_us, sum(un) FILTER (WHERE paired AND NOT poison)::BIGINT AS unavailable_diff_us,
  sum(unv) FILTER (WHERE paired)::BIGINT AS unvetted_diff_us, round(avg(lat) FILTER (WHERE paired), 3) AS latency_diff_us, count(*) FILTER (WHERE paired AND poison AND done) AS committed_poison, count(*) FILTER (WHERE paired AND NOT poison AND done) AS committed_clean,
  count(*) FILTER (WHERE paired AND poison AND done AND passes) AS false_negatives, count(*) FILTER (WHERE paired AND NOT poison AND done AND NOT passes) AS false_positives FROM j GROUP BY ALL""",
)
def paired_contrast(spark, d):
    """Detector minus oracle on the same item; items that one arm lacks are counted and left out of every difference.

    A few records of either arm are lost on purpose. Both arms meet in one aggregation per item, no self join.
    """
    f = wl.facts(spark, d, ["B2", "B3", "B4"])
    det = F.col("arm") == "detector"
    f = f.filter(~(det & (F.col("item_id") % 97 == 5)) & ~(~det & (F.col("item_id") % 89 == 7)))
    done = F.coalesce(F.col("commit_us") <= F.col("horizon_us"), F.lit(False))
    values = {
        "vis": F.col("visible_us"), "un": F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us"), "unv": F.coalesce(lc.unvetted_us(), F.lit(0)),
        "lat": F.when(done, F.col("commit_us") - F.col("arrival_us")),
    }
    keys = ["attack", "baseline", "backlog", "seed"]
    of = lambda cond, c: F.max(F.when(cond, c))  # noqa: E731  one row per item and arm
    items = f.groupBy(*keys, "item_id").agg(
        of(det, F.lit(1)).alias("d"), of(~det, F.lit(1)).alias("o"), F.max("poison").alias("poison"), F.coalesce(of(det, done), F.lit(False)).alias("done"), of(det, F.col("passes")).alias("passes"),
        *[(of(det, c) - of(~det, c)).alias(n) for n, c in values.items()],
    )
    both = F.col("d").isNotNull() & F.col("o").isNotNull()
    p, settled = F.col("poison"), both & F.col("done")
    return items.groupBy(*keys).agg(
        count_if(both).alias("pairs"), count_if(~both).alias("unpaired"), F.sum(F.when(both & p, F.col("vis"))).alias("exposure_diff_us"), F.sum(F.when(both & ~p, F.col("un"))).alias("unavailable_diff_us"),
        F.sum(F.when(both, F.col("unv"))).alias("unvetted_diff_us"), F.round(F.avg(F.when(both, F.col("lat"))), 3).alias("latency_diff_us"), count_if(settled & p).alias("committed_poison"), count_if(settled & ~p).alias("committed_clean"),
        count_if(settled & p & F.col("passes")).alias("false_negatives"), count_if(settled & ~p & ~F.col("passes")).alias("false_positives"),
    )


@query(
    "paired_retrieval",
    """SELECT backlog, baseline, role, count(*) FILTER (WHERE hit AND arm = 'detector') - count(*) FILTER (WHERE hit AND arm = 'oracle') AS hit_delta, round(5 * (coalesce(sum(displacement) FILTER (WHERE arm = 'detector'), 0) - coalesce(sum(displacement) FILTER (WHERE arm = 'oracle'), 0)), 6) AS displacement_delta FROM w_ret WHERE baseline <> 'B1' GROUP BY ALL""",
)
def paired_retrieval(spark, d):
    l = log(spark, d, ["B2", "B3", "B4"]).withColumn("h", F.col("hit").cast("int"))
    a = cm.by_arm(l, ["backlog", "baseline", "role"], "arm", ("detector", "oracle"), ["h", "displacement"])
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.select(
        "backlog", "baseline", "role", (z("h_detector") - z("h_oracle")).alias("hit_delta"), F.round(5 * (z("displacement_detector") - z("displacement_oracle")), 6).alias("displacement_delta")
    )


@query(
    "pair_availability",
    "SELECT attack, availability, count(*) AS n FROM (SELECT a.attack, CASE WHEN n AND h THEN 'both' WHEN n THEN 'normal_only' WHEN h THEN 'heavy_only' ELSE 'neither' END AS availability FROM (SELECT item_id, any_value(attack) AS attack, bool_or(backlog = 'normal' AND commit_us <= arrival_us + 600000000) AS n, bool_or(backlog = 'heavy' AND commit_us <= arrival_us + 600000000) AS h FROM w_fifo GROUP BY 1) a) GROUP BY ALL",
)
def pair_availability(spark, d):
    """Items committed in time under either load."""
    q = wl.queued(spark, d).filter("source_ok")
    done = F.col("commit_us") <= F.col("arrival_us") + wl.TP_US
    per = q.groupBy("item_id", "attack").agg(*[F.max((F.col("backlog") == b) & done).alias(b) for b in ("normal", "heavy")])
    return per.groupBy("attack", cm.availability(F.col("normal"), F.col("heavy"), "normal", "heavy").alias("availability")).agg(F.count(F.lit(1)).alias("n"))


cte("w_runs", "SELECT o_orderkey % 5 + 1 AS run_number, o_orderpriority AS metric, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 5 = 2 THEN NULL ELSE avg(o_totalprice) END AS value, count(*) AS n FROM orders GROUP BY 1, 2, o_orderkey % 5")


def runs(spark, d):
    o = src.table(spark, d, "orders").select((F.col("o_orderkey") % 5 + 1).alias("run_number"), F.col("o_orderpriority").alias("metric"), "o_totalprice")
    g = o.groupBy("run_number", "metric").agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    undefined = (F.col("metric") == "5-LOW") & (F.col("run_number") == 3)
    return g.select("run_number", "metric", F.when(~undefined, F.col("v")).alias("value"), "n")


@query("run_summary", "SELECT metric, count(*) AS runs, count(value) AS defined, round(quantile_cont(value, 0.5), 2) AS p50, round(min(value), 2) AS min, round(max(value), 2) AS max FROM w_runs GROUP BY 1")
def run_summary(spark, d):
    r = cm.run_summary(runs(spark, d), ["metric"], "run_number", "value")
    return r.select("metric", "runs", "defined", *[F.round(c, 2).alias(c) for c in ("p50", "min", "max")])


@query(
    "admission_rates",
    "SELECT backlog, count(*) AS offered, count(*) FILTER (WHERE a.source_ok) AS accepted, count(*) FILTER (WHERE NOT a.source_ok) AS failed, count(*) FILTER (WHERE a.source_ok AND a.arrival_us < start_us + 1728000000000) AS accepted_in_window, round(count(*) FILTER (WHERE a.source_ok AND a.arrival_us < start_us + 1728000000000) / 1728000.0, 6) AS achieved_rate, round(quantile_cont(vstart_us - a.arrival_us, 0.5), 3) AS lag_p50, round(quantile_cont(vstart_us - a.arrival_us, 0.95), 3) AS lag_p95 FROM w_plan a CROSS JOIN (SELECT start_us FROM w_hor) WHERE baseline = 'B1' GROUP BY 1",
)
def admission_rates(spark, d):
    q = wl.queued(spark, d).withColumn("from_us", wl.start(spark, d)).withColumn("lag", F.col("start_us") - F.col("arrival_us"))
    q = cut_lineage(q.select("backlog", "source_ok", "arrival_us", "from_us", "lag"))
    inside = F.col("source_ok") & (F.col("arrival_us") < F.col("from_us") + 20 * DAY_US)
    agg = q.groupBy("backlog").agg(
        F.count(F.lit(1)).alias("offered"), count_if(F.col("source_ok")).alias("accepted"), count_if(~F.col("source_ok")).alias("failed"), count_if(inside).alias("accepted_in_window"), F.round(count_if(inside) / 1728000.0, 6).alias("achieved_rate")
    )
    lag = quantiles(q, ["backlog"], "lag", {"lag_p50": 0.5, "lag_p95": 0.95})
    return agg.join(lag.select("backlog", *[F.round(c, 3).alias(c) for c in ("lag_p50", "lag_p95")]), "backlog")


@query(
    "query_throughput",
    """SELECT event_type, count(*) AS attempts, count(*) FILTER (WHERE source_ok AND arrival_us + val_us * 40 <= start_us + 1728000000000) AS completed_in_window, count(*) FILTER (WHERE source_ok AND arrival_us + val_us * 40 > start_us + 1728000000000) AS completed_after, count(*) FILTER (WHERE NOT source_ok) AS errors,
  round(count(*) FILTER (WHERE source_ok AND arrival_us + val_us * 40 <= start_us + 1728000000000) / 1728000.0, 6) AS qps, any_value(m.mx)::BIGINT AS max_in_flight FROM w_adm CROSS JOIN (SELECT start_us FROM w_hor) JOIN (SELECT et, max(o) AS mx FROM (SELECT et, sum(s) OVER (PARTITION BY et ORDER BY t) AS o FROM (SELECT et, t, sum(s) AS s FROM (
    SELECT event_type AS et, arrival_us AS t, 1 AS s FROM w_adm UNION ALL SELECT event_type, arrival_us + val_us * 40, -1 FROM w_adm) GROUP BY ALL)) GROUP BY 1) m ON m.et = event_type GROUP BY 1""",
)
def query_throughput(spark, d):
    a = wl.admissions(spark, d).withColumn("end_us", F.col("arrival_us") + F.col("val_us") * 40).withColumn("from_us", wl.start(spark, d))
    inside = F.col("end_us") <= F.col("from_us") + 20 * DAY_US
    ok = F.col("source_ok")
    agg = a.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("attempts"), count_if(ok & inside).alias("completed_in_window"), count_if(ok & ~inside).alias("completed_after"), count_if(~ok).alias("errors"), F.round(count_if(ok & inside) / 1728000.0, 6).alias("qps")
    )
    return agg.join(lc.max_in_flight(a, ["event_type"], "arrival_us", "end_us"), "event_type")


cte("w_blocks", "SELECT l_orderkey % 8 AS block, 'B' || (l_linenumber % 4 + 1) AS baseline, l_extendedprice AS latency, l_quantity, l_shipdate < TIMESTAMP '1999-01-01' AS inside, l_returnflag FROM lineitem")
_PCT = ", ".join(f"xs[least(n, CAST(floor({p} * n) AS BIGINT) + 1)] AS p{q}" for q, p in ((50, 0.5), (95, 0.95), (99, 0.99)))
cte("w_cells8", f"SELECT block, baseline, n, n / 45.0::DOUBLE AS throughput, {_PCT} FROM (SELECT block, baseline, count(*) AS n, list_sort(list(latency)) AS xs FROM w_blocks WHERE inside GROUP BY ALL)")


def blocks(spark, d):
    l = src.table(spark, d, "lineitem")
    inside = F.to_date("l_shipdate") < F.lit("1999-01-01").cast("date")
    return l.select(
        (F.col("l_orderkey") % 8).alias("block"), F.concat(F.lit("B"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("baseline"), F.col("l_extendedprice").alias("latency"), "l_quantity", inside.alias("inside"), "l_returnflag"
    )


def block_cells(spark, d):
    b = blocks(spark, d).filter("inside")
    q = quantiles(b, ["block", "baseline"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, nearest=True, stats=True)
    return q.withColumn("throughput", F.col("n") / 45.0).drop("min", "max")


@query("window_tail_latency", "SELECT block, baseline, n, round(throughput, 6) AS throughput, p50, p95, p99 FROM w_cells8")
def window_tail_latency(spark, d):
    return block_cells(spark, d).select("block", "baseline", "n", F.round("throughput", 6).alias("throughput"), "p50", "p95", "p99")


cte("w_ratio", "SELECT a.block, o.baseline AS other, a.throughput / o.throughput AS r, a.p99 - o.p99 AS dp99 FROM w_cells8 a JOIN w_cells8 o ON o.block = a.block AND o.baseline <> 'B4' WHERE a.baseline = 'B4'")


def block_ratios(spark, d):
    w = cm.by_arm(block_cells(spark, d), ["block"], "baseline", BASES, ["throughput", "p99"])
    out = F.array(*[F.struct(F.lit(b).alias("other"), ratio(F.col("throughput_B4"), F.col(f"throughput_{b}")).alias("r"), (F.col("p99_B4") - F.col(f"p99_{b}")).alias("dp99")) for b in BASES[:3]])
    return w.select("block", F.explode(out).alias("o")).select("block", "o.*")


@query(
    "paired_block_ratio",
    "SELECT other, count(*) AS blocks, round(quantile_cont(r, 0.5), 6) AS ratio_p50, round(min(r), 6) AS ratio_min, round(max(r), 6) AS ratio_max, round(quantile_cont(dp99, 0.5), 4) AS p99_delta_p50, greatest(count(*) FILTER (WHERE r > 1), count(*) FILTER (WHERE r < 1)) AS same_direction FROM w_ratio GROUP BY 1",
)
def paired_block_ratio(spark, d):
    r = block_ratios(spark, d)
    agg = r.groupBy("other").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(F.min("r"), 6).alias("ratio_min"), F.round(F.max("r"), 6).alias("ratio_max"), F.greatest(count_if(F.col("r") > 1), count_if(F.col("r") < 1)).alias("same_direction")
    )
    long = r.select("other", F.expr("stack(2, 'ratio_p50', r, 'p99_delta_p50', dp99) AS (m, x)"))
    q = quantiles(long, ["other", "m"], "x", {"p": 0.5}).groupBy("other").pivot("m", ["ratio_p50", "p99_delta_p50"]).agg(F.first("p"))
    return agg.join(q, "other").withColumns({"ratio_p50": F.round("ratio_p50", 6), "p99_delta_p50": F.round("p99_delta_p50", 4)})


cte(
    "w_seq",
    "SELECT block, baseline, row_number() OVER w AS position, lead(baseline) OVER w AS following FROM (SELECT l_orderkey AS block, 'B' || (l_partkey % 4 + 1) AS baseline, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem) WINDOW w AS (PARTITION BY block ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)",
)


@query("design_balance", "SELECT 'position' AS kind, baseline AS first, position::VARCHAR AS second, count(*) AS n FROM w_seq GROUP BY ALL UNION ALL SELECT 'carry_over', baseline, following, count(*) FROM w_seq WHERE following IS NOT NULL GROUP BY ALL")
def design_balance(spark, d):
    """How often each arm sits in each position and follows each other arm; every order is a block."""
    l = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("B"), F.col("l_partkey") % 4 + 1).alias("baseline"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("o"))
    w = W.partitionBy("block").orderBy("o")  # the few lines of one order
    s = l.withColumns({"following": F.lead("baseline").over(w), "position": F.row_number().over(w)})
    pos = s.groupBy(F.lit("position").alias("kind"), F.col("baseline").alias("first"), F.col("position").cast("string").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    carry = s.filter(F.col("following").isNotNull()).groupBy(F.lit("carry_over").alias("kind"), F.col("baseline").alias("first"), F.col("following").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return pos.unionByName(carry)


cte("w_sent", "SELECT l_suppkey AS block, avg(l_extendedprice) FILTER (WHERE l_linenumber <= 3) AS before, avg(l_extendedprice) FILTER (WHERE l_linenumber > 3) AS after FROM lineitem GROUP BY 1")


def sentinels(spark, d):
    l = src.table(spark, d, "lineitem")
    early = F.col("l_linenumber") <= 3
    return l.groupBy(F.col("l_suppkey").alias("block")).agg(F.avg(F.when(early, F.col("l_extendedprice"))).alias("before"), F.avg(F.when(~early, F.col("l_extendedprice"))).alias("after"))


@query(
    "environment_tier",
    "SELECT tier, count(*) AS blocks, round(max(move), 6) AS worst, any_value(span_ok) AS span_ok FROM (SELECT *, CASE WHEN move <= 1.18 THEN 'quiet' WHEN move <= 1.5 THEN 'moderate' ELSE 'excursion' END AS tier, (SELECT max(before) / min(before) <= 1.5 FROM w_sent) AS span_ok FROM (SELECT block, greatest(before / after, after / before) AS move FROM w_sent)) GROUP BY 1",
)
def environment_tier(spark, d):
    s = sentinels(spark, d)
    ok = s.agg(F.max("before") / F.min("before") <= 1.5).scalar()
    m = s.withColumn("move", cm.both_ways(F.col("before"), F.col("after")))
    return m.groupBy(cm.tier(F.col("move")).alias("tier")).agg(F.count(F.lit(1)).alias("blocks"), F.round(F.max("move"), 6).alias("worst")).withColumn("span_ok", ok)


cte(
    "w_band",
    "SELECT user_id, item_id, arrival_us, b, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY arrival_us, item_id) AS grp, b AND lag(b) OVER (PARTITION BY user_id ORDER BY arrival_us, item_id) AS ready FROM (SELECT user_id, item_id, arrival_us, val_us BETWEEN 10000000 AND 60000000 AS b FROM w_adm)",
)


@query(
    "in_band_runs",
    "SELECT u.user_id, u.readings, r.runs, r.longest, u.ready_at FROM (SELECT user_id, count(*) AS readings, min(arrival_us) FILTER (WHERE ready) AS ready_at FROM w_band GROUP BY 1) u LEFT JOIN (SELECT user_id, count(*) AS runs, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM w_band WHERE b GROUP BY ALL) GROUP BY 1) r ON r.user_id = u.user_id",
)
def in_band_runs(spark, d):
    a = wl.admissions(spark, d).select("user_id", "item_id", "arrival_us", "val_us")
    return cm.band_runs(a, ["user_id"], "arrival_us", "item_id", F.col("val_us").between(10_000_000, 60_000_000), DAY_US)


@query(
    "boundary_exclusion",
    "SELECT backlog, offered, dropped, done, open, offered - dropped - done - open AS lost, round(open / offered::DOUBLE, 6) AS open_share, CASE WHEN open / offered::DOUBLE > 0.10 THEN 'error' WHEN open / offered::DOUBLE > 0.02 THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT backlog, count(*) AS offered, count(*) FILTER (WHERE status = 'CANCELLED') AS dropped, count(*) FILTER (WHERE status = 'COMMITTED') AS done, count(*) FILTER (WHERE status IN ('RUNNING', 'QUEUED')) AS open FROM w_ver GROUP BY 1)",
)
def boundary_exclusion(spark, d):
    st = F.col("status")
    g = pl.verifier_records(spark, d).groupBy("backlog").agg(F.count(F.lit(1)).alias("offered"), count_if(st == "CANCELLED").alias("dropped"), count_if(st == "COMMITTED").alias("done"), count_if(st.isin("RUNNING", "QUEUED")).alias("open"))
    share = F.col("open") / F.col("offered")
    return g.select("*", (F.col("offered") - F.col("dropped") - F.col("done") - F.col("open")).alias("lost"), F.round(share, 6).alias("open_share"), F.when(share > 0.10, "error").when(share > 0.02, "warning").otherwise("ok").alias("verdict"))


cte(
    "w_stale0",
    "SELECT user_id, arrival_us AS s, arrival_us + val_us AS e, event_type <> 'error' AND val_us < 80000000 AS hit, lag(event_type <> 'error' AND val_us < 80000000) OVER (PARTITION BY user_id ORDER BY arrival_us, arrival_us + val_us) AS prev FROM w_adm",
)
cte(
    "w_stale",
    """SELECT f.user_id, f.probes, coalesce(b.stale, 0) AS stale_probes, f.reappearances, NOT f.first_hit AS first_probe_hidden, f.me - coalesce(b.last_s, f.ms) AS censor_width, f.ms IS NOT NULL AS has_miss FROM (SELECT user_id, count(*) AS probes, min(s) FILTER (WHERE NOT hit) AS ms, arg_min(e, s) FILTER (WHERE NOT hit) AS me, arg_min(hit, s) AS first_hit, count(*) FILTER (WHERE hit AND NOT prev) AS reappearances FROM w_stale0 GROUP BY 1) f
  LEFT JOIN (SELECT t.user_id, count(*) AS stale, max(t.s) AS last_s FROM w_stale0 t JOIN (SELECT user_id, min(s) FILTER (WHERE NOT hit) AS ms FROM w_stale0 GROUP BY 1) m ON m.user_id = t.user_id WHERE t.hit AND (m.ms IS NULL OR t.s < m.ms) GROUP BY 1) b ON b.user_id = f.user_id""",
)


def stale(spark, d):
    a = wl.admissions(spark, d).select("user_id", F.col("arrival_us").alias("s"), (F.col("arrival_us") + F.col("val_us")).alias("e"), ((F.col("event_type") != "error") & (F.col("val_us") < 80_000_000)).alias("hit"))
    return cm.stale_probes(a, ["user_id"], "s", "e", "hit", DAY_US)


@query("stale_probe_summary", "SELECT user_id, probes, stale_probes, reappearances, first_probe_hidden, censor_width FROM w_stale")
def stale_probe_summary(spark, d):
    return stale(spark, d).drop("has_miss")


@query("observation_class", "SELECT CASE WHEN reappearances > 0 THEN 'OSCILLATION' WHEN first_probe_hidden THEN 'FIRST_PROBE_HIDDEN' WHEN has_miss AND stale_probes > 0 THEN 'STALE_WINDOW' ELSE 'UNRESOLVED' END AS class, count(*) AS items FROM w_stale GROUP BY 1")
def observation_class(spark, d):
    return stale(spark, d).groupBy(cm.observation_class().alias("class")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "control_bracket",
    "SELECT grade, count(*) AS blocks, round(max(abs(after - before)), 4) AS worst_drift FROM (SELECT *, CASE WHEN abs(after - before) <= 1000 AND abs(after / before - 1) <= 0.05 THEN 'TIGHT' WHEN abs(after - before) <= 4000 AND abs(after / before - 1) <= 0.10 THEN 'MILD' ELSE 'DRIFTED' END AS grade FROM w_sent) GROUP BY 1",
)
def control_bracket(spark, d):
    s = sentinels(spark, d)
    grade = cm.bracket(F.col("before"), F.col("after"), 2000.0)
    return s.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("blocks"), F.round(F.max(F.abs(F.col("after") - F.col("before"))), 4).alias("worst_drift"))


@query(
    "resolution_plan",
    "SELECT other, count(*) AS blocks, round(stddev_samp(r), 6) AS sd, round(sqrt(7.849 * stddev_samp(r) ** 2 / count(*)), 6) AS resolvable, CAST(ceil(7.849 * stddev_samp(r) ** 2 / 0.0025) AS BIGINT) AS blocks_for_5_percent FROM w_ratio GROUP BY 1",
)
def resolution_plan(spark, d):
    sd = F.stddev_samp("r")
    return block_ratios(spark, d).groupBy("other").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(sd, 6).alias("sd"), F.round(cm.resolvable(sd, F.count(F.lit(1))), 6).alias("resolvable"), F.ceil(F.lit(7.849) * sd * sd / 0.0025).alias("blocks_for_5_percent")
    )


cte("w_issue", "SELECT baseline, max(CASE WHEN n < 200 THEN 2 WHEN p99 > 100000 THEN 1 WHEN p95 > 95000 THEN 1 ELSE 0 END) AS worst FROM w_cells8 GROUP BY 1")


@query(
    "claim_table",
    "SELECT 'B4_vs_' || o.baseline AS claim, CASE greatest(a.worst, o.worst) WHEN 2 THEN 'unavailable' WHEN 1 THEN 'constrained' ELSE 'admissible' END AS verdict FROM w_issue a JOIN w_issue o ON o.baseline <> 'B4' WHERE a.baseline = 'B4'",
)
def claim_table(spark, d):
    level = F.when(F.col("n") < 200, 2).when(F.col("p99") > 100000, 1).when(F.col("p95") > 95000, 1).otherwise(0)
    worst = block_cells(spark, d).select("baseline", level.alias("l")).groupBy(F.lit(1).alias("one")).pivot("baseline", list(BASES)).agg(F.max("l"))
    rows = F.array(*[F.struct(F.concat(F.lit("B4_vs_"), F.lit(b)).alias("claim"), cm.severity(F.greatest("B4", b)).alias("verdict")) for b in BASES[:3]])
    return worst.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "axis_wiring",
    """SELECT axis, count(*) AS levels, count(DISTINCT v) AS distinct_values, count(*) > 1 AND count(DISTINCT v) = 1 AS unwired FROM (SELECT 'returnflag' AS axis, l_returnflag AS level, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY ALL UNION ALL SELECT 'linestatus', l_linestatus, round(avg(l_extendedprice), 4) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'constant', l_returnflag, 1.0 FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def axis_wiring(spark, d):
    """A swept axis whose levels all give the same number was probably never connected."""
    l = src.table(spark, d, "lineitem").select("l_extendedprice", F.array(F.struct(F.lit("returnflag").alias("axis"), F.col("l_returnflag").alias("level")), F.struct(F.lit("linestatus").alias("axis"), F.col("l_linestatus").alias("level")), F.struct(F.lit("constant").alias("axis"), F.col("l_returnflag").alias("level"))).alias("a"))
    per = l.select("l_extendedprice", F.explode("a").alias("a")).groupBy("a.axis", "a.level").agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    per = per.withColumn("v", F.when(F.col("axis") == "constant", 1.0).otherwise(F.col("v")))
    n, k = F.count(F.lit(1)), F.count_distinct("v")
    return per.groupBy("axis").agg(n.alias("levels"), k.alias("distinct_values"), ((n > 1) & (k == 1)).alias("unwired"))


@query("report_tables", "SELECT baseline, " + ", ".join(f"round(max(CASE WHEN block = {b} THEN throughput END), 6) AS block_{b}" for b in range(8)) + " FROM w_cells8 GROUP BY 1")
def report_tables(spark, d):
    p = block_cells(spark, d).groupBy("baseline").pivot("block", list(range(8))).agg(F.round(F.max("throughput"), 6))
    return p.select("baseline", *[F.col(str(b)).alias(f"block_{b}") for b in range(8)])
