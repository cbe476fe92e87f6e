"""Registered queries: detector scoring, calibration, quality and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.functions.stats import count_if, rate_columns
from vislens.functions.vectors import cosine
from vislens.operators import calibration as cal
from vislens.operators import cohort as co
from vislens.operators import detector as det
from vislens.operators.ordered import hash_chunk, quantiles, rank_by
from vislens.plans import workload as wl
from vislens.plans.cohort import control_kind, posts
from vislens.plans.registry import cte, query
from vislens.plans.retrieval import wilson_sql
from vislens.session import cut_lineage
from vislens.sources import tables as src

THRESHOLD = 1.0

cte("w_det", "SELECT id, v, nrm, src, batch, id // 8 AS grp, id % 4 = 0 AS is_ref, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-12) AS rep FROM (SELECT *, v[1:len(v) // 2] AS a, v[len(v) // 2 + 1:len(v) // 2 * 2] AS b FROM w_items)")
cte(
    "w_knn",
    """SELECT id, 1.0::DOUBLE - avg(s) AS knn FROM (SELECT a.id, round(list_dot_product(a.v, r.v) / (a.nrm * r.nrm + 1e-12), 9) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, r.v) / (a.nrm * r.nrm + 1e-12), 9) DESC, r.id) AS rn
  FROM w_det a JOIN w_det r ON r.is_ref AND r.grp <> a.grp) WHERE rn <= 10 GROUP BY 1""",
)
cte("w_z", "SELECT avg(rep) AS rep_mean, stddev_pop(rep) AS rep_std, avg(knn) AS knn_mean, stddev_pop(knn) AS knn_std FROM w_det JOIN w_knn USING (id) WHERE is_ref")
cte(
    "w_cscore",
    """SELECT id, is_ref, (rep - rep_mean) / rep_std + (knn - knn_mean) / knn_std AS c_score, src <> 3 AND batch <> 5 AND id % 13 <> 0 AS s_affirms,
  CASE WHEN id % 4 = 1 THEN 'calibration' WHEN id % 4 = 0 THEN 'control' ELSE 'test' END AS phase, (id * 7919) % 40000000 AS service_ns FROM w_det JOIN w_knn USING (id) CROSS JOIN w_z""",
)
cte(
    "w_score",
    """SELECT d.doc_id, round(d.n_chars / 1000.0::DOUBLE, 6) AS c_score, l.toxic = 1 AS poison, 'q' || l.quality AS stratum, CASE WHEN d.doc_id % 2 = 0 THEN 'recipe' ELSE 'cover' END AS attack,
  CASE WHEN d.doc_id % 4 < 2 THEN 'calibration' ELSE 'test' END AS split, d.doc_id % 11 <> 0 AS s_affirms, (d.doc_id * 7919) % 40000 AS service_us, w.gid FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN w_docs w ON w.doc_id = d.doc_id""",
)
cte("w_steps", "SELECT s, n, p, lead(s) OVER (ORDER BY s) AS nx, lag(s) OVER (ORDER BY s) AS pv, sum(n) OVER (ORDER BY s) AS nu, sum(p) OVER (ORDER BY s) AS pu FROM (SELECT c_score AS s, count(*) AS n, count(*) FILTER (WHERE poison) AS p FROM w_score WHERE split = 'calibration' GROUP BY 1)")
cte(
    "w_cand",
    """SELECT threshold, tp, n - nb - tp AS fp, nb - pb AS tn, pb AS fn, coalesce(2 * tp / nullif((2 * tp + n - nb - tp + pb)::DOUBLE, 0), 0) AS f1 FROM (SELECT threshold, nb, pb, n, p - pb AS tp FROM (
  SELECT coalesce(s + (nx - s) * 0.5, nextafter(s, 'inf'::DOUBLE)) AS threshold, nu AS nb, pu AS pb FROM w_steps UNION ALL SELECT nextafter(s, '-inf'::DOUBLE), 0, 0 FROM w_steps WHERE pv IS NULL)
  CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (WHERE poison) AS p FROM w_score WHERE split = 'calibration'))""",
)
cte("w_thr", "SELECT threshold, f1, tp, fp, tn, fn FROM w_cand ORDER BY f1 DESC, threshold DESC LIMIT 1")
cte("w_test", "SELECT *, NOT (s_affirms AND c_score < (SELECT threshold FROM w_thr)) AS flagged FROM w_score WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY gid ORDER BY doc_id) = 1")


# ---- scoring


def vector_features(spark, d):
    """rep and knn of every vector item; halves of the vector stand in for halves of a text."""
    it = src.items(spark, d).withColumn("source_group", F.floor(F.col("id") / 8))
    half = F.floor(F.size("vector") / 2).cast("int")
    rep = it.select(
        "id", "src", "batch", cosine(F.slice("vector", F.lit(1), half), F.slice("vector", half + 1, half)).alias("rep"), (F.col("id") % 4 == 0).alias("is_ref")
    )
    return rep.join(det.knn_novelty(it, it.filter("id % 4 = 0")), "id")


def scored_items(spark, d):
    f = cut_lineage(vector_features(spark, d))
    s = det.content_score(f, det.z_statistics(f.filter("is_ref")))
    s = s.withColumns(
        {
            "credential_valid": F.col("src") != 3,
            "provenance_consistent": F.col("batch") != 5,
            "embedding_model_revision": F.when(F.col("id") % 13 == 0, "rev-0").otherwise("rev-1"),
            "model_revision": F.lit("rev-1"),
            "phase": F.when(F.col("id") % 4 == 1, "calibration").when(F.col("id") % 4 == 0, "control").otherwise("test"),
            "service_ns": F.col("id") * 7919 % 40_000_000,
        }
    )
    return s.withColumn("family_s_affirms", det.source_affirms("rev-1"))


@query("rep_score", """SELECT doc_id, round(sum(c1 * c2) / (sqrt(sum(c1 * c1)) * sqrt(sum(c2 * c2))), 6) AS rep FROM (SELECT doc_id, w, count(*) FILTER (WHERE i <= n // 2) AS c1, count(*) FILTER (WHERE i > n // 2) AS c2 FROM (
  SELECT doc_id, len(ws) AS n, unnest(string_split(lower(norm), ' ')) AS w, generate_subscripts(ws, 1) AS i FROM w_docs WHERE len(ws) >= 2) GROUP BY ALL) GROUP BY 1""")
def rep_score(spark, d):
    return det.rep_score_words(posts(spark, d)).select("doc_id", F.round("rep", 6).alias("rep"))


@query("knn_novelty", "SELECT id, round(knn, 6) AS knn FROM w_knn")
def knn_novelty(spark, d):
    it = src.items(spark, d).withColumn("source_group", F.floor(F.col("id") / 8))
    return det.knn_novelty(it, it.filter("id % 4 = 0")).select("id", F.round("knn", 6).alias("knn"))


@query("reference_z", "SELECT round(rep_mean, 6) AS rep_mean, round(rep_std, 6) AS rep_std, round(knn_mean, 6) AS knn_mean, round(knn_std, 6) AS knn_std FROM w_z")
def reference_z(spark, d):
    z = det.z_statistics(vector_features(spark, d).filter("is_ref"))
    return z.select(*[F.round(c, 6).alias(c) for c in z.columns])


@query("content_score", "SELECT id, round(c_score, 6) AS c_score FROM w_cscore WHERE NOT is_ref")
def content_score(spark, d):
    return scored_items(spark, d).filter(~F.col("is_ref")).select("id", F.round("c_score", 6).alias("c_score"))


@query("source_affirms", "SELECT vec_id AS id, vec_id % 20 <> 3 AND (vec_id // 20) % 10 <> 5 AND vec_id % 13 <> 0 AS affirms FROM embeddings")
def source_affirms(spark, d):
    it = src.items(spark, d)
    s = it.withColumns(
        {
            "credential_valid": F.col("src") != 3, "provenance_consistent": F.col("batch") != 5,
            "embedding_model_revision": F.when(F.col("id") % 13 == 0, "rev-0").otherwise("rev-1"), "model_revision": F.lit("rev-1"),
        }
    )
    return s.select("id", det.source_affirms("rev-1").alias("affirms"))


@query("promote", "SELECT id, s_affirms AND c_score < 1.0 AS promote FROM w_cscore")
def promote(spark, d):
    return scored_items(spark, d).select("id", det.promote(THRESHOLD).alias("promote"))


@query(
    "score_job",
    """SELECT phase, item_key, row_number() OVER (PARTITION BY phase ORDER BY item_key) AS position, family_s_affirms, c_score, promote, service_ns FROM (SELECT phase, sha256('vislens-item|' || id) AS item_key, s_affirms AS family_s_affirms, round(c_score, 6) AS c_score,
  CASE WHEN phase <> 'calibration' THEN s_affirms AND c_score < 1.0 END AS promote, service_ns FROM w_cscore)""",
)
def score_job(spark, d):
    s = scored_items(spark, d)
    out = None
    for phase in ("calibration", "test", "control"):
        one = det.score_job(s, phase, None if phase == "calibration" else THRESHOLD)
        out = one if out is None else out.unionByName(one)
    ranked = rank_by(out, ["phase"], hash_chunk("item_key"), [F.col("item_key")], "position")
    return ranked.select("phase", "item_key", "position", "family_s_affirms", F.round("c_score", 6).alias("c_score"), "promote", "service_ns")


def text_scores(spark, d):
    """Every labelled document scored from its text alone; the reference is clean, one document per group of equal texts."""
    labels = src.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("poison"))
    p = posts(spark, d, labels).select(F.col("doc_id").alias("id"), "norm", F.col("gid").alias("source_group"), "poison")
    n = F.col("id") % 4
    p = p.groupBy("source_group").agg(F.min_by(F.struct("id", "norm", "poison"), "id").alias("r")).select("source_group", "r.*")
    p = p.withColumns(
        {
            "is_ref": (n == 0) & ~F.col("poison"), "phase": F.when(n == 0, "reference").when(n == 1, "calibration").otherwise("test"),
            "credential_valid": F.col("id") % 8 != 1, "provenance_consistent": F.col("id") % 8 != 2,
            "embedding_model_revision": F.lit("rev-1"), "model_revision": F.lit("rev-1"), "service_ns": F.lit(0).cast("bigint"),
        }
    )
    f = cut_lineage(det.text_features(p))
    return det.content_score(f, det.z_statistics(f.filter("is_ref"))).withColumn("family_s_affirms", det.source_affirms("rev-1"))


def text_decisions(spark, d):
    """Decisions of the test phase at the threshold that the calibration phase selects."""
    s = cut_lineage(text_scores(spark, d))
    t = cal.select_threshold(cal.threshold_candidates(s.filter("phase = 'calibration'"), "c_score", "poison")).select("threshold").scalar()
    return s.filter("phase = 'test'").withColumns({"threshold": t, "promote": det.promote(t)})


@query("text_detector")
def text_detector(spark, d):
    """From texts and labels to the confusion table: embed, rep and knn, z, threshold, decision.

    No SQL: the embedder hashes words with Spark's own hash. The test compares the chain with numpy on the same vectors.
    """
    c = text_decisions(spark, d)
    t = cal.confusion(c, ["threshold"], ~F.col("promote"), F.col("poison"))
    return t.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", *cal.confusion_rates())


# ---- calibration and quality


def scores(spark, d):
    labels = src.table(spark, d, "labels")
    p = src.table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(tx.normalize_text("text"), 256).alias("gid"))
    even = F.col("doc_id") % 2 == 0
    return p.join(labels, "doc_id").select(
        "doc_id", "gid", F.round(F.col("n_chars") / 1000.0, 6).alias("c_score"), (F.col("toxic") == 1).alias("poison"), F.concat(F.lit("q"), "quality").alias("stratum"),
        F.when(even, "recipe").otherwise("cover").alias("attack"), F.when(F.col("doc_id") % 4 < 2, "calibration").otherwise("test").alias("split"),
        (F.col("doc_id") % 11 != 0).alias("family_s_affirms"), (F.col("doc_id") * 7919 % 40000).alias("service_us"),
    )


def candidates(spark, d):
    return cal.threshold_candidates(scores(spark, d).filter("split = 'calibration'"), "c_score", "poison")


def test_rows(spark, d):
    """One row per source group, with the decision at the calibrated threshold."""
    s = scores(spark, d)
    t = cal.select_threshold(cal.threshold_candidates(s.filter("split = 'calibration'"), "c_score", "poison")).select("threshold").scalar()
    cols = [c for c in s.columns if c != "gid"]
    one = s.filter("split = 'test'").groupBy("gid").agg(F.min_by(F.struct(*cols), "doc_id").alias("r")).select("gid", "r.*")
    return one.withColumn("flagged", ~det.promote(t))


@query("threshold_candidates", "SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(f1, 6) AS f1 FROM w_cand")
def threshold_candidates(spark, d):
    return candidates(spark, d).select("threshold", "tp", "fp", "tn", "fn", F.round("f1", 6).alias("f1"))


@query("select_threshold", "SELECT threshold, round(f1, 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, (SELECT count(*) FROM w_cand) AS candidates FROM w_thr")
def select_threshold(spark, d):
    b = cal.select_threshold(candidates(spark, d))
    return b.select("threshold", F.round("f1", 6).alias("f1"), "tp", "fp", "tn", "fn", "candidates")


@query(
    "key_mismatch",
    """SELECT coalesce(s.doc_id, l.doc_id)::VARCHAR AS key, CASE WHEN s.doc_id IS NULL THEN 'missing_score' ELSE 'missing_label' END AS problem FROM (SELECT doc_id FROM documents WHERE source <> 'src7') s FULL OUTER JOIN labels l ON l.doc_id = s.doc_id WHERE s.doc_id IS NULL OR l.doc_id IS NULL
UNION ALL SELECT w.gid, 'repeated_group' FROM w_docs w JOIN documents d ON d.doc_id = w.doc_id WHERE d.source <> 'src7' GROUP BY w.gid HAVING count(*) > 1""",
)
def key_mismatch(spark, d):
    """Documents of one source were not scored; not every document has a label."""
    docs = src.table(spark, d, "documents").filter("source <> 'src7'").select("doc_id", F.sha2(tx.normalize_text("text"), 256).alias("gid"))
    return cal.key_mismatch(docs, src.table(spark, d, "labels"), "doc_id", "gid")


_CONF = "count(*) FILTER (WHERE flagged AND poison) AS tp, count(*) FILTER (WHERE flagged AND NOT poison) AS fp, count(*) FILTER (WHERE NOT flagged AND NOT poison) AS tn, count(*) FILTER (WHERE NOT flagged AND poison) AS fn"


@query(
    "confusion",
    f"""SELECT tp, fp, tn, fn, round(tp / nullif((tp + fp)::DOUBLE, 0), 6) AS precision, round(tp / nullif((tp + fn)::DOUBLE, 0), 6) AS recall, round(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 6) AS f1, round(fp / nullif((fp + tn)::DOUBLE, 0), 6) AS fpr, round(fn / nullif((fn + tp)::DOUBLE, 0), 6) AS fnr FROM (SELECT {_CONF} FROM w_test)""",
)
def confusion(spark, d):
    c = cal.confusion(test_rows(spark, d), [], F.col("flagged"), F.col("poison"))
    return c.select("tp", "fp", "tn", "fn", *cal.confusion_rates())


@query("rate_wilson", f"SELECT user_id, {wilson_sql('n', 'd')} FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n, count(*) FILTER (WHERE value > 20) AS d0, count(*) AS d FROM events GROUP BY 1)")
def rate_wilson(spark, d):
    e = src.table(spark, d, "events").groupBy("user_id").agg(count_if(F.col("event_type") == "error").alias("n"), F.count(F.lit(1)).alias("d"))
    return e.select("user_id", *rate_columns(F.col("n"), F.col("d")))


_LAT = ", ".join(f"round(quantile_cont(service_us, {p}), 3) AS p{n}" for n, p in ((50, 0.5), (95, 0.95), (99, 0.99)))


@query("recall_by_attack", f"SELECT attack, {wilson_sql('n', 'd')}, {_LAT} FROM (SELECT attack, count(*) FILTER (WHERE flagged) AS n, count(*) AS d, list(service_us) AS xs FROM w_test WHERE poison GROUP BY 1) JOIN (SELECT attack AS a2, service_us FROM w_test WHERE poison) ON a2 = attack GROUP BY attack, n, d")
def recall_by_attack(spark, d):
    t = test_rows(spark, d).filter("poison")
    r = t.groupBy("attack").agg(count_if(F.col("flagged")).alias("n"), F.count(F.lit(1)).alias("d"))
    q = quantiles(t, ["attack"], "service_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return r.join(q, "attack").select("attack", *rate_columns(F.col("n"), F.col("d")), *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


@query("fpr_by_stratum", f"SELECT stratum, {wilson_sql('n', 'd')}, round(1 - n / d::DOUBLE, 6) AS specificity FROM (SELECT stratum, count(*) FILTER (WHERE flagged) AS n, count(*) AS d FROM w_test WHERE NOT poison GROUP BY 1)")
def fpr_by_stratum(spark, d):
    r = test_rows(spark, d).filter(~F.col("poison")).groupBy("stratum").agg(count_if(F.col("flagged")).alias("n"), F.count(F.lit(1)).alias("d"))
    return r.select("stratum", *rate_columns(F.col("n"), F.col("d")), F.round(1 - F.col("n") / F.col("d"), 6).alias("specificity"))


@query(
    "latency_summary",
    "SELECT event_type, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT event_type, CASE WHEN event_type <> 'signup' THEN value END AS v FROM events) GROUP BY 1",
)
def latency_summary(spark, d):
    """Groups without any value keep a row of nulls."""
    e = src.table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "signup", F.col("value")).alias("v"))
    q = quantiles(e, ["event_type"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, stats=True)
    out = e.groupBy("event_type").agg(F.count("v").alias("cnt")).join(q.drop("n"), "event_type", "left")
    return out.select("event_type", F.col("cnt").alias("n"), *[F.round(c, 6).alias(c) for c in ("min", "max", "p50", "p95", "p99")])


@query(
    "quantile_nearest_rank",
    ("SELECT event_type, " + ", ".join(f"xs[least(n, CAST(floor({p} * n) AS BIGINT) + 1)] AS {c}" for c, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))) + " FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS xs FROM events GROUP BY 1)"),
)
def quantile_nearest_rank(spark, d):
    e = src.table(spark, d, "events")
    return quantiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, nearest=True)


@query(
    "control_gate",
    "SELECT kind, count(*) AS n, count(*) FILTER (WHERE aff) AS affirmed, count(*) FILTER (WHERE aff AND n_text < 3000) AS promoted, count(*) >= 8 AND count(*) FILTER (WHERE aff) = 0 AS passed FROM (SELECT kind, n_text, kind NOT IN ('invalid_signature', 'unknown_source') AND kind <> 'provenance_conflict' AS aff FROM w_kind WHERE kind IS NOT NULL) GROUP BY 1",
)
def control_gate(spark, d):
    p = posts(spark, d).withColumn("kind", control_kind()).filter(F.col("kind").isNotNull())
    p = p.select("kind", F.char_length("norm").alias("c_score"), *co.source_evidence("kind"), F.lit(co.MODEL_REVISION).alias("model_revision"))
    p = p.withColumn("family_s_affirms", det.source_affirms(co.MODEL_REVISION))
    return p.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("family_s_affirms")).alias("affirmed"), count_if(det.promote(3000.0)).alias("promoted"),
        # a kind needs as many controls as were planned, eight, for its gate to say anything
        ((F.count(F.lit(1)) >= 8) & (count_if(F.col("family_s_affirms")) == 0)).alias("passed"),
    )


@query(
    "decision_mix",
    "SELECT attack, count(*) FILTER (WHERE p) AS promote, count(*) FILTER (WHERE NOT p) AS refuse, count(*) FILTER (WHERE p AND NOT poison) AS correct_promotion, count(*) FILTER (WHERE p AND poison) AS false_promotion, count(*) FILTER (WHERE NOT p AND poison) AS correct_refusal, count(*) FILTER (WHERE NOT p AND NOT poison) AS false_refusal FROM (SELECT attack, poison, detector_promote AS p FROM w_adm WHERE source_ok) GROUP BY 1",
)
def decision_mix(spark, d):
    a = wl.admissions(spark, d).filter("source_ok")
    p, bad = F.col("detector_promote"), F.col("poison")
    return a.groupBy("attack").agg(
        count_if(p).alias("promote"), count_if(~p).alias("refuse"), count_if(p & ~bad).alias("correct_promotion"), count_if(p & bad).alias("false_promotion"),
        count_if(~p & bad).alias("correct_refusal"), count_if(~p & ~bad).alias("false_refusal"),
    )


_UC = "SELECT user_id, count(*) FILTER (WHERE value > 34) AS k, count(*) FILTER (WHERE value <> 34) AS n, count(*) FILTER (WHERE event_type = 'error' AND value > 100) AS losses, count(*) AS total FROM events GROUP BY 1"


def user_counts(spark, d):
    e = src.table(spark, d, "events")
    return e.groupBy("user_id").agg(
        count_if(F.col("value") > 34).alias("k"), count_if(F.col("value") != 34).alias("n"), count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("losses"), F.count(F.lit(1)).alias("total")
    )


@query(
    "sign_test",
    f"SELECT user_id, k, n, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) FROM range(0, least(k, n - k) + 1) r(i))), 6) AS p_value FROM ({_UC})",
)
def sign_test(spark, d):
    return cal.sign_test(user_counts(spark, d).select("user_id", "k", "n")).withColumn("p_value", F.round("p_value", 6))


@query("reporting_strength", f"SELECT strength, count(*) AS users FROM (SELECT CASE WHEN total >= 1000 THEN 'p99' WHEN total >= 200 THEN 'p95' WHEN total >= 30 THEN 'median' ELSE 'none' END AS strength FROM ({_UC})) GROUP BY 1")
def reporting_strength(spark, d):
    return user_counts(spark, d).groupBy(cal.reporting_strength(F.col("total")).alias("strength")).agg(F.count(F.lit(1)).alias("users"))


@query("rule_of_three", f"SELECT user_id, total AS n, losses, round(CASE WHEN losses = 0 THEN 3.0 / total END, 6) AS upper_bound FROM ({_UC})")
def rule_of_three(spark, d):
    u = user_counts(spark, d)
    return u.select("user_id", F.col("total").alias("n"), "losses", F.round(cal.rule_of_three(F.col("losses"), F.col("total")), 6).alias("upper_bound"))


@query(
    "median_mad_band",
    "SELECT event_type, round(m, 6) AS median, round(mad, 6) AS mad, round(m - greatest(3 * mad, 0.18 * m), 6) AS band_lo, round(m + greatest(3 * mad, 0.18 * m), 6) AS band_hi FROM (SELECT e.event_type, any_value(m) AS m, quantile_cont(abs(value - m), 0.5) AS mad FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) q ON q.event_type = e.event_type GROUP BY 1)",
)
def median_mad_band(spark, d):
    b = cal.median_mad_band(src.table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")
    return b.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "mad", "band_lo", "band_hi")])


@query(
    "detector_violations",
    """SELECT item, rule FROM (SELECT 'q' || doc_id AS item, unnest(list_filter([CASE WHEN stored <> (s_affirms AND c_score < t) THEN 'promote' END, CASE WHEN isnan(c_score) THEN 'finite' END], lambda r: r IS NOT NULL)) AS rule FROM (
  SELECT s.*, (SELECT threshold FROM w_thr) AS t, CASE WHEN doc_id % 53 = 0 THEN NOT (s_affirms AND c_score < (SELECT threshold FROM w_thr)) ELSE s_affirms AND c_score < (SELECT threshold FROM w_thr) END AS stored FROM w_score s WHERE split = 'test'))
UNION ALL SELECT 'threshold/' || stratum, 'lineage' FROM (SELECT stratum, (SELECT threshold FROM w_thr) + CASE WHEN stratum = 'q1' THEN 0.001 ELSE 0 END AS stored FROM w_score GROUP BY 1) WHERE stored <> (SELECT threshold FROM w_thr)""",
)
def detector_violations(spark, d):
    """Stored decisions (some planted wrong) against decisions recomputed from score and threshold."""
    from vislens.operators.quality import broken_rules

    s = scores(spark, d)
    best = cal.select_threshold(cal.threshold_candidates(s.filter("split = 'calibration'"), "c_score", "poison"))
    t = s.filter("split = 'test'").withColumn("again", det.promote(best.select("threshold").scalar()))
    t = t.withColumn("stored", F.col("again") != (F.col("doc_id") % 53 == 0)).withColumn("item", F.concat(F.lit("q"), "doc_id"))
    rows = broken_rules(t, ["item"], {"promote": F.col("stored") != F.col("again"), "finite": F.isnan("c_score")})
    # the threshold that each stratum has stored must be the one that calibration gives again; one is planted wrong
    again = best.select("threshold").scalar()
    stored = s.groupBy("stratum").agg(F.lit(None).alias("_")).select("stratum", (again + F.when(F.col("stratum") == "q1", 0.001).otherwise(0.0)).alias("stored"), again.alias("again"))
    lineage = stored.filter("stored <> again").select(F.concat(F.lit("threshold/"), "stratum").alias("item"), F.lit("lineage").alias("rule"))
    return rows.unionByName(lineage)
