"""Registered queries: query-log metrics and the transfer check against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.functions.stats import count_if, rate_columns, ratio
from vislens.operators import lifecycle as lc
from vislens.operators import retrieval as ret
from vislens.operators import retrieval_log as rl
from vislens.operators.lifecycle import CELL
from vislens.operators.ordered import quantiles
from vislens.operators.similarity import max_similarity
from vislens.plans import workload as wl
from vislens.plans.lifecycle import DAY
from vislens.plans.registry import cte, query
from vislens.plans.retrieval import wilson_sql
from vislens.session import cut_lineage
from vislens.sources import tables as src

K = 5
C = "backlog, baseline, arm"
ROLES = ("attack_associated", "heldout_same_topic", "negative_other_topic")

cte("w_qrole", "SELECT qid, qid // 25 AS qidx, CASE (qid // 25) % 3 WHEN 0 THEN 'attack_associated' WHEN 1 THEN 'heldout_same_topic' ELSE 'negative_other_topic' END AS role FROM w_queries")
cte("w_static10", "SELECT qid, id, score, rk FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM w_pairs WHERE id % 3 = 0) WHERE rk <= 10")
cte(
    "w_cands",
    "SELECT qid, id, score, true AS st FROM w_static10 UNION ALL SELECT p.qid, p.id, p.score, false FROM w_pairs p JOIN (SELECT qid, min(score) AS cut FROM w_static10 GROUP BY 1) c ON c.qid = p.qid WHERE p.id % 3 <> 0 AND p.score >= c.cut",
)
cte("w_probes", "SELECT a.item_id AS probe, a.arrival_us AS t_us, q.qid, q.role FROM w_adm a JOIN w_qrole q ON q.qidx = a.item_id % (SELECT count(*) FROM w_queries) WHERE a.event_type = 'view'")
cte("w_cell", "SELECT DISTINCT backlog, baseline, arm FROM w_plan")
cte(
    "w_rows",
    """SELECT p.probe, p.t_us, p.qid, p.role, c.id, c.score, l.backlog, l.baseline, l.arm, false AS poison, false AS landed, true AS visible FROM w_probes p JOIN w_cands c ON c.qid = p.qid AND c.st CROSS JOIN w_cell l
  UNION ALL SELECT p.probe, p.t_us, p.qid, p.role, c.id, c.score, f.backlog, f.baseline, f.arm, f.poison, f.landed, EXISTS (SELECT 1 FROM w_span s WHERE s.backlog = f.backlog AND s.baseline = f.baseline AND s.arm = f.arm AND s.item_id = f.item_id AND s.vis AND s.t_us <= p.t_us AND s.end_us > p.t_us)
  FROM w_probes p JOIN w_cands c ON c.qid = p.qid AND NOT c.st JOIN w_facts f ON f.item_id = c.id WHERE f.first_visible_us <= p.t_us""",
)
cte(
    "w_ranked",
    """SELECT *, row_number() OVER w AS raw, sum(visible::INT) OVER w AS nv, sum((visible AND NOT poison)::INT) OVER w AS nc FROM w_rows WINDOW w AS (PARTITION BY backlog, baseline, arm, probe ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
cte(
    "w_ret",
    """SELECT *, np > 0 AS hit, nl > 0 AS hit_landed, len(list_intersect(returned, eligible)) / nullif(len(eligible)::DOUBLE, 0) AS recall, len(list_filter(poisonfree, lambda x: NOT list_contains(returned, x))) / nullif(len(poisonfree)::DOUBLE, 0) AS displacement FROM (
  SELECT backlog, baseline, arm, probe, t_us, qid, role, coalesce(list(id) FILTER (WHERE visible AND raw <= 10 AND nv <= 5), []) AS returned, coalesce(list(id) FILTER (WHERE visible AND nv <= 5), []) AS eligible, coalesce(list(id) FILTER (WHERE visible AND NOT poison AND nc <= 5), []) AS poisonfree,
    count(*) FILTER (WHERE visible AND raw <= 10 AND nv <= 5 AND poison) AS np, count(*) FILTER (WHERE visible AND raw <= 10 AND nv <= 5 AND poison AND landed) AS nl FROM w_ranked WHERE visible AND (nv <= 5 OR nc <= 5) GROUP BY ALL)""",
)


def query_roles(q):
    i = F.floor(F.col("query_id") / 25)
    return q.withColumns({"qidx": i, "role": F.element_at(F.array(*[F.lit(r) for r in ROLES]), (i % 3 + 1).cast("int"))})


def candidates(spark, d):
    it = src.items(spark, d)
    corpus, q = src.corpus(it), src.queries(it)
    static, dynamic = corpus.filter("id % 3 = 0"), corpus.filter("id % 3 <> 0")
    pre, cand = ret.dynamic_candidates(q, static, dynamic, 2 * K)
    return pre.select("query_id", "id", "score", F.lit(True).alias("static")).unionByName(cand.select("query_id", "id", "score", F.lit(False).alias("static")))


def probes(spark, d):
    q = query_roles(src.queries(src.items(spark, d))).select("query_id", "qidx", "role")
    n = src.items(spark, d).agg(count_if(F.col("slot") == 0)).scalar()
    v = wl.admissions(spark, d).filter("event_type = 'view'").select(F.col("item_id").alias("probe"), F.col("arrival_us").alias("t_us"))
    return v.withColumn("qidx", F.col("probe") % n).join(q, "qidx").drop("qidx")


def log(spark, d, baselines=None):
    """The query log of every policy cell."""
    # Only items that are also vectors can be returned.
    vec = src.corpus(src.items(spark, d)).filter("id % 3 <> 0").select(F.col("id").alias("item_id"))
    facts = wl.facts(spark, d, baselines, vec)
    return rl.probe_results(probes(spark, d), candidates(spark, d), facts, CELL, wl.cells(baselines), K, 2)


@query("poisoned_rate", f"SELECT {C}, role, count(*) AS queries, count(*) FILTER (WHERE hit) AS np, round(avg(hit::INT), 6) AS prr, min(t_us) FILTER (WHERE hit) AS obs_first_us, max(t_us) FILTER (WHERE hit) AS obs_last_us FROM w_ret GROUP BY ALL")
def poisoned_rate(spark, d):
    return rl.poisoned_rate(log(spark, d), CELL + ["role"]).withColumn("prr", F.round("prr", 6))


cte("w_series", f"SELECT {C}, role, (t_us - start_us) // 86400000000 AS bin, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM w_ret CROSS JOIN w_hor GROUP BY ALL")


def series(spark, d):
    return rl.prr_series(log(spark, d), CELL + ["role"], wl.start(spark, d), DAY)


@query("prr_series", f"SELECT {C}, role, bin, n, hits, round(hits / n::DOUBLE, 6) AS prr FROM w_series")
def prr_series(spark, d):
    return series(spark, d).withColumn("prr", F.round(ratio(F.col("hits"), F.col("n")), 6))


@query("prr_auc", f"SELECT {C}, role, round(sum(hits / n::DOUBLE * 86400), 3) AS auc_query_seconds, count(*) AS bins FROM w_series GROUP BY ALL")
def prr_auc(spark, d):
    return series(spark, d).groupBy(*CELL, "role").agg(F.round(F.sum(ratio(F.col("hits"), F.col("n")) * 86400), 3).alias("auc_query_seconds"), F.count(F.lit(1)).alias("bins"))


@query("rebin_curve", "SELECT backlog, baseline, bin // 5 AS bin, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits, round(sum(hits) / sum(n)::DOUBLE, 6) AS rate FROM w_series GROUP BY backlog, baseline, bin // 5")
def rebin_curve(spark, d):
    """Daily bins pooled over arms and roles into five-day bins."""
    return rl.rebin(series(spark, d), ["backlog", "baseline"], 5).withColumn("rate", F.round("rate", 6))


@query("per_query_hits", f"SELECT {C}, qid AS query_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM w_ret GROUP BY ALL")
def per_query_hits(spark, d):
    return log(spark, d).groupBy(*CELL, "query_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("hit")).alias("hits"))


@query("eligible_recall", f"SELECT {C}, role, count(recall) AS scored, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall FROM w_ret GROUP BY ALL")
def eligible_recall(spark, d):
    return log(spark, d).groupBy(*CELL, "role").agg(F.count("recall").alias("scored"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("recall"), 6).alias("min_recall"))


@query("displacement", f"SELECT {C}, role, count(displacement) AS scored, round(avg(displacement), 6) AS mean_displacement, round(max(displacement), 6) AS max_displacement FROM w_ret GROUP BY ALL")
def displacement(spark, d):
    return log(spark, d).groupBy(*CELL, "role").agg(
        F.count("displacement").alias("scored"), F.round(F.avg("displacement"), 6).alias("mean_displacement"), F.round(F.max("displacement"), 6).alias("max_displacement")
    )


@query("cum_displacement", f"SELECT {C}, role, round(sum(displacement) * 5, 3) AS positions, count(displacement) AS queries_scored FROM w_ret CROSS JOIN w_hor WHERE t_us >= start_us + 86400000000 GROUP BY ALL")
def cum_displacement(spark, d):
    l = log(spark, d).filter(F.col("t_us") >= wl.start(spark, d) + DAY)
    return l.groupBy(*CELL, "role").agg(F.round(F.sum("displacement") * K, 3).alias("positions"), F.count("displacement").alias("queries_scored"))


cte(
    "w_pois",
    f"""SELECT {C}, count(first_visible_us) > 0 AS exposed, quantile_cont(contain_us, 0.5) FILTER (WHERE contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED')) AS c_med, max(contain_us) FILTER (WHERE contain_us IS NOT NULL AND state_end IN ('QUARANTINED', 'REVOKED')) AS c_last,
  count(*) FILTER (WHERE contain_us IS NOT NULL AND vis_end) AS readmitted, count(*) FILTER (WHERE first_visible_us IS NOT NULL AND state_end = 'HIDDEN') AS pending, min(trusted_us) FILTER (WHERE contain_us IS NOT NULL AND trusted_us IS NOT NULL AND vis_end) AS t_readmit FROM w_life WHERE poison GROUP BY ALL""",
)
cte(
    "w_phased",
    f"SELECT r.*, CASE WHEN NOT exposed THEN 'after' WHEN c_med IS NULL THEN 'during' WHEN t_us <= c_med THEN 'during' ELSE 'after' END AS phase FROM w_ret r JOIN w_pois USING (backlog, baseline, arm)",
)


def poison_cells(spark, d):
    """Per cell: whether poison was ever visible, and its containment and re-admission instants."""
    f = wl.facts(spark, d).filter("poison")
    vis_end = lc.is_visible(F.col("state_end"))
    settled = F.col("contain_us").isNotNull() & F.coalesce(F.col("state_end").isin(*lc.TERMINAL), F.lit(False))
    back = F.col("contain_us").isNotNull() & F.col("trusted_us").isNotNull() & vis_end
    f = f.withColumn("settled_us", F.when(settled, F.col("contain_us")))
    f = cut_lineage(f.select(*CELL, "first_visible_us", "contain_us", "trusted_us", "state_end", "settled_us"))
    agg = f.groupBy(*CELL).agg(
        (F.count("first_visible_us") > 0).alias("exposed"), F.max("settled_us").alias("c_last"), count_if(F.col("contain_us").isNotNull() & vis_end).alias("readmitted"),
        count_if(F.col("first_visible_us").isNotNull() & (F.col("state_end") == lc.HIDDEN)).alias("pending"), F.min(F.when(back, F.col("trusted_us"))).alias("t_readmit"),
    )
    return agg.join(quantiles(f, CELL, "settled_us", {"c_med": 0.5}), CELL, "left")


@query(
    "phase_split",
    f"SELECT {C}, role, phase, count(*) AS queries, round(quantile_cont(recall, 0.5), 6) AS recall_p50, round(quantile_cont(displacement, 0.5), 6) AS displacement_p50, round(max(displacement), 6) AS displacement_max FROM w_phased GROUP BY ALL",
)
def phase_split(spark, d):
    # Aggregated twice below, so the log is materialised once.
    l = cut_lineage(log(spark, d)).join(poison_cells(spark, d), CELL)
    phase = F.when(~F.col("exposed"), "after").when(F.col("c_med").isNull() | (F.col("t_us") <= F.col("c_med")), "during").otherwise("after")
    keys = CELL + ["role", "phase"]
    l = l.withColumn("phase", phase).select(*keys, "recall", "displacement")
    agg = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), F.round(F.max("displacement"), 6).alias("displacement_max"))
    long = l.select(*keys, F.expr("stack(2, 'recall', recall, 'displacement', displacement) AS (m, x)"))
    q = quantiles(long, keys + ["m"], "x", {"p50": 0.5}).groupBy(*keys).pivot("m", ["recall", "displacement"]).agg(F.round(F.first("p50"), 6))
    return agg.join(q, keys).withColumnsRenamed({"recall": "recall_p50", "displacement": "displacement_p50"})


cte("w_pq", f"SELECT {C}, role, qid, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM w_ret GROUP BY ALL")


@query(
    "conditional_effect",
    f"""SELECT p.backlog, p.baseline, p.arm, p.role, count(*) FILTER (WHERE q.hits > 0) AS qualified, round(count(*) FILTER (WHERE q.hits > 0) / count(*)::DOUBLE, 6) AS coverage, coalesce(sum(p.n) FILTER (WHERE q.hits > 0), 0)::BIGINT AS queries, coalesce(sum(p.hits) FILTER (WHERE q.hits > 0), 0)::BIGINT AS np,
  round(sum(p.hits) FILTER (WHERE q.hits > 0) / sum(p.n) FILTER (WHERE q.hits > 0)::DOUBLE, 6) AS prr FROM w_pq p JOIN w_pq q ON q.baseline = 'B1' AND q.backlog = p.backlog AND q.qid = p.qid GROUP BY ALL""",
)
def conditional_effect(spark, d):
    """Every cell judged on the queries the undefended baseline was hit on."""
    pq = log(spark, d).groupBy(*CELL, "role", "query_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("hit")).alias("hits"))
    b1 = pq.filter("baseline = 'B1'").select("backlog", "query_id", (F.col("hits") > 0).alias("q"))
    j = pq.join(b1, ["backlog", "query_id"])
    n, h = F.sum(F.when(F.col("q"), F.col("n"))), F.sum(F.when(F.col("q"), F.col("hits")))
    return j.groupBy(*CELL, "role").agg(
        count_if(F.col("q")).alias("qualified"), F.round(ratio(count_if(F.col("q")), F.count(F.lit(1))), 6).alias("coverage"),
        F.coalesce(n, F.lit(0)).alias("queries"), F.coalesce(h, F.lit(0)).alias("np"), F.round(ratio(h, n), 6).alias("prr"),
    )


@query(
    "seed_rollup",
    f"SELECT {C}, count(*) AS seeds, round(quantile_cont(prr, 0.5), 6) AS prr_p50, round(min(prr), 6) AS prr_min, round(max(prr), 6) AS prr_max, round(quantile_cont(np, 0.5), 6) AS np_p50, min(np) AS np_min, max(np) AS np_max FROM (SELECT {C}, probe % 5 AS seed, avg(hit::INT) AS prr, count(*) FILTER (WHERE hit) AS np FROM w_ret GROUP BY ALL) GROUP BY ALL",
)
def seed_rollup(spark, d):
    per = cut_lineage(rl.poisoned_rate(log(spark, d).withColumn("seed", F.col("probe") % 5), CELL + ["seed"]))
    agg = per.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("seeds"), F.round(F.min("prr"), 6).alias("prr_min"), F.round(F.max("prr"), 6).alias("prr_max"), F.min("np").alias("np_min"), F.max("np").alias("np_max")
    )
    long = per.select(*CELL, F.expr("stack(2, 'prr_p50', prr, 'np_p50', cast(np AS double)) AS (m, x)"))
    q = quantiles(long, CELL + ["m"], "x", {"p50": 0.5}).groupBy(*CELL).pivot("m", ["prr_p50", "np_p50"]).agg(F.round(F.first("p50"), 6))
    return agg.join(q, CELL)


@query(
    "role_summary",
    f"SELECT {C}, role, population, {wilson_sql('h', 'n')}, returns::BIGINT AS item_returns, round(disp * 5, 3) AS displaced_positions FROM (SELECT {C}, role, population, count(*) AS n, count(*) FILTER (WHERE CASE population WHEN 'overall' THEN hit ELSE hit_landed END) AS h, sum(CASE population WHEN 'overall' THEN np ELSE nl END) AS returns, sum(displacement) AS disp FROM w_ret CROSS JOIN (VALUES ('overall'), ('landed_only')) s(population) GROUP BY ALL)",
)
def role_summary(spark, d):
    pops = F.array(
        F.struct(F.lit("overall").alias("population"), F.col("hit").alias("h"), F.col("n_poison").alias("r")),
        F.struct(F.lit("landed_only").alias("population"), F.col("hit_landed").alias("h"), F.col("n_landed").alias("r")),
    )
    l = log(spark, d).select(*CELL, "role", "displacement", F.explode(pops).alias("p"))
    g = l.groupBy(*CELL, "role", "p.population").agg(count_if(F.col("p.h")).alias("h"), F.count(F.lit(1)).alias("n"), F.sum("p.r").alias("item_returns"), F.round(F.sum("displacement") * K, 3).alias("displaced_positions"))
    return g.select(*CELL, "role", "population", *rate_columns(F.col("h"), F.col("n")), "item_returns", "displaced_positions")


@query("post_readmission_hits", f"SELECT {C}, any_value(t_readmit) AS first_readmission_us, count(*) FILTER (WHERE hit AND t_us >= t_readmit) AS hits_after FROM w_ret JOIN w_pois USING (backlog, baseline, arm) GROUP BY ALL")
def post_readmission_hits(spark, d):
    l = log(spark, d).join(poison_cells(spark, d).select(*CELL, "t_readmit"), CELL)
    return l.groupBy(*CELL).agg(F.max("t_readmit").alias("first_readmission_us"), count_if(F.col("hit") & (F.col("t_us") >= F.col("t_readmit"))).alias("hits_after"))


@query(
    "containment_gap",
    f"SELECT {C}, CASE WHEN any_value(readmitted) = 0 AND any_value(pending) = 0 THEN any_value(c_last) - max(t_us) FILTER (WHERE hit AND role = 'attack_associated') END AS gap_us FROM w_ret JOIN w_pois USING (backlog, baseline, arm) GROUP BY ALL",
)
def containment_gap(spark, d):
    last = log(spark, d).groupBy(*CELL).agg(F.max(F.when(F.col("hit") & (F.col("role") == ROLES[0]), F.col("t_us"))).alias("last_hit"))
    j = last.join(poison_cells(spark, d), CELL)
    return j.select(*CELL, F.when((F.col("readmitted") == 0) & (F.col("pending") == 0), F.col("c_last") - F.col("last_hit")).alias("gap_us"))


@query(
    "attack_breadth",
    "SELECT backlog, count(*) FILTER (WHERE hitq > 0) AS seeds_reached, count(*) AS seeds, round(min(hitq / nq::DOUBLE), 6) AS coverage_min, round(max(hitq / nq::DOUBLE), 6) AS coverage_max FROM (SELECT backlog, qid // 25 % 4 AS seed, count(*) AS nq, count(*) FILTER (WHERE hits > 0) AS hitq FROM w_pq WHERE baseline = 'B1' GROUP BY ALL) GROUP BY 1",
)
def attack_breadth(spark, d):
    pq = log(spark, d, ["B1"]).groupBy("backlog", "query_id").agg(F.max("hit").alias("hit"))
    per = pq.groupBy("backlog", (F.floor(F.col("query_id") / 25) % 4).alias("seed")).agg(F.count(F.lit(1)).alias("nq"), count_if(F.col("hit")).alias("hitq"))
    cov = F.col("hitq") / F.col("nq")
    return per.groupBy("backlog").agg(count_if(F.col("hitq") > 0).alias("seeds_reached"), F.count(F.lit(1)).alias("seeds"), F.round(F.min(cov), 6).alias("coverage_min"), F.round(F.max(cov), 6).alias("coverage_max"))


@query(
    "retrieval_violations",
    f"""SELECT {C}, probe, unnest(list_filter([CASE WHEN hit <> (probe % 101 = 0) IS DISTINCT FROM hit THEN 'hit_flag' END, CASE WHEN len(returned) <> len(list_distinct(returned)) THEN 'duplicate_key' END, CASE WHEN len(returned) < 5 THEN 'underfilled' END,
  CASE WHEN len(list_filter(returned, lambda x: NOT list_contains(eligible, x))) > 0 THEN 'ineligible_key' END, CASE WHEN len(poisonfree) < 5 THEN 'short_reference' END], lambda r: r IS NOT NULL)) AS rule FROM w_ret""",
)
def retrieval_violations(spark, d):
    """Stored flags (some planted wrong) and lists checked against each other."""
    from vislens.operators.quality import broken_rules

    l = log(spark, d).withColumn("stored", F.col("hit") != (F.col("probe") % 101 == 0))
    return broken_rules(
        l, CELL + ["probe"],
        {
            "hit_flag": F.col("stored") != F.col("hit"), "duplicate_key": F.size("returned") != F.size(F.array_distinct("returned")), "underfilled": F.size("returned") < K,
            "ineligible_key": F.size(F.array_except("returned", "eligible")) > 0, "short_reference": F.size("poisonfree") < K,
        },
    )


cte(
    "w_pred",
    """SELECT v.variant, q.qid, (SELECT list_sort(list(p.score), 'DESC')[5] FROM w_pairs p JOIN w_adm a ON a.item_id = p.id WHERE p.qid = q.qid AND (p.id % 3 = 0 OR (v.variant = 'query_time' AND a.source_ok AND NOT a.poison))) AS cutoff,
  (SELECT max(p.score) FROM w_pairs p JOIN w_adm a ON a.item_id = p.id WHERE p.qid = q.qid AND p.id % 3 <> 0 AND a.source_ok AND a.poison) AS best FROM w_queries q CROSS JOIN (VALUES ('corpus_only'), ('query_time')) v(variant)""",
)


@query(
    "transfer_consistency",
    """SELECT variant, count(*) FILTER (WHERE n > 0 AND (best > cutoff + 1e-9) = (hits > 0)) AS agree, count(*) FILTER (WHERE n > 0 AND (best > cutoff + 1e-9) <> (hits > 0)) AS mismatch, count(*) FILTER (WHERE n IS NULL) AS no_opportunity
  FROM w_pred p LEFT JOIN (SELECT qid, sum(n) AS n, sum(hits) AS hits FROM w_pq WHERE baseline = 'B1' AND backlog = 'heavy' GROUP BY 1) o ON o.qid = p.qid GROUP BY 1""",
)
def transfer_consistency(spark, d):
    """Predicted from geometry against what the undefended baseline actually returned.

    The corpus-only cutoff is kept as a negative control.
    """
    it = src.items(spark, d)
    corpus, q = src.corpus(it), src.queries(it)
    adm = wl.admissions(spark, d).select(F.col("item_id").alias("id"), "source_ok", "poison")
    pool = corpus.join(adm, "id").withColumn("static", F.col("id") % 3 == 0)
    clean = pool.filter("static OR (source_ok AND NOT poison)")
    best = max_similarity(q.select(F.col("query_id").alias("id"), F.col("qvec").alias("vector")), pool.filter("NOT static AND source_ok AND poison"))
    best = best.select(F.col("id").alias("query_id"), F.col("score").alias("best"))
    cut = ret.kth_cutoff(q, pool.filter("static"), K).withColumn("variant", F.lit("corpus_only")).unionByName(ret.kth_cutoff(q, clean, K).withColumn("variant", F.lit("query_time")))
    seen = log(spark, d, ["B1"]).filter("backlog = 'heavy'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("hit")).alias("hits"))
    j = cut.join(best, "query_id").join(seen, "query_id", "left")
    same = (F.col("best") > F.col("cutoff") + 1e-9) == (F.col("hits") > 0)
    return j.groupBy("variant").agg(
        count_if(F.col("n").isNotNull() & same).alias("agree"), count_if(F.col("n").isNotNull() & ~same).alias("mismatch"), count_if(F.col("n").isNull()).alias("no_opportunity")
    )
