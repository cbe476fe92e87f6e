"""Registered queries: text rules, duplicate groups, strata and leak checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.functions.stats import count_if
from vislens.operators import cohort as co
from vislens.operators.similarity import max_similarity, mean_vector
from vislens.plans.registry import cte, query
from vislens.session import cut_lineage
from vislens.sources import tables as src

COUNTS = {
    "reference": 12, "calibration_hard": 2, "test_hard": 3, "calibration_recipe_T0": 2, "calibration_recipe_T1": 2, "calibration_recipe_T2": 2,
    "test_recipe_T3": 2, "test_recipe_T4": 2, "test_cover": 2, "control_invalid_signature": 1, "control_provenance_conflict": 1, "control_unknown_source": 1,
}
NOMINAL = 16

_WORDS = "CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END"
cte(
    "w_docs",
    f"""SELECT *, {_WORDS} AS ws, sha256(norm) AS gid FROM (SELECT doc_id, lang AS topic, source || '/' || doc_id AS source_id, text, sha256(text) AS raw_sha,
  trim(regexp_replace(nfc_normalize(text), '{tx.SPACE}', ' ', 'g')) AS norm FROM documents)""",
)
cte(
    "w_groups",
    """SELECT *, sha256('vislens-order|' || topic || '|' || gid) AS order_key FROM (SELECT gid, first.topic AS topic, first.source_id AS source_id, first.raw_sha AS raw_sha, first.doc_id AS doc_id, n_members, n_aliases FROM (
  SELECT gid, min({'topic': topic, 'source_id': source_id, 'raw_sha': raw_sha, 'doc_id': doc_id}) AS first, count(*) AS n_members, count(DISTINCT source_id) AS n_aliases FROM w_docs GROUP BY gid))""",
)
cte(
    "w_rules",
    f"""SELECT doc_id, list_filter([CASE WHEN len(regexp_extract_all(text, '(?m)^>')) >= 2 THEN 'quoted_reply_lines' END,
  CASE WHEN regexp_matches(text, '(?i)writes:') OR regexp_matches(text, '(?im)^Subject:\\s*Re:') THEN 'reply_attribution_or_re_subject' END, CASE WHEN regexp_matches(text, '(?m)^--[ ]?$') THEN 'signature_footer_separator' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])faq($|[^\\pL\\pN_])') OR regexp_matches(text, '(?i)frequently asked') OR regexp_matches(text, '(?i)(^|[^\\pL\\pN_])contents($|[^\\pL\\pN_])')
    OR len(list_filter(range(1, len(ls) - 1), lambda i: ls[i] = ls[i + 2])) > 0 THEN 'faq_boilerplate_or_repeated_lines' END,
  CASE WHEN regexp_matches(text, '(?im)^Newsgroups:\\s*[^,\\n]*[^,\\s][^,\\n]*,[,\\s]*[^,\\s]') THEN 'cross_post_header' END], lambda r: r IS NOT NULL) AS rules FROM (
  SELECT doc_id, text, list_sort(list_filter(list_transform(string_split_regex(text, '{tx.LINE_BREAK}'), lambda x: lower(trim(regexp_replace(x, '{tx.SPACE}', ' ', 'g')))), lambda x: x <> '')) AS ls FROM documents)""",
)
cte(
    "w_elig",
    """SELECT d.doc_id, d.topic, d.gid, list_filter([CASE WHEN length(norm) < 300 THEN 'normalized_length_below_300' END, CASE WHEN length(norm) > 2000 THEN 'normalized_length_above_2000' END, CASE WHEN len(ws) < 30 THEN 'fewer_than_30_words' END,
  CASE WHEN len(ws) < 2 THEN 'first_word_half_empty' END, CASE WHEN len(ws) < 1 THEN 'second_word_half_empty' END], lambda r: r IS NOT NULL) AS reasons, g.order_key FROM w_groups g JOIN w_docs d ON d.doc_id = g.doc_id""",
)
cte("w_pool", "SELECT e.gid, e.topic, e.doc_id, e.order_key, len(r.rules) > 0 AS hard, r.rules FROM w_elig e JOIN w_rules r ON r.doc_id = e.doc_id WHERE len(e.reasons) = 0")
cte("w_rank1", "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY order_key, gid) AS r1 FROM w_pool")
cte("w_capacity", "SELECT topic, count(*) FILTER (WHERE r1 > 12 AND NOT hard) AS capacity FROM w_rank1 GROUP BY 1")
cte("w_quota0", f"SELECT topic, capacity, CASE WHEN capacity >= {2 * NOMINAL} THEN {NOMINAL} ELSE (capacity + 1) // 2 END AS cal, CASE WHEN capacity >= {2 * NOMINAL} THEN {NOMINAL} ELSE capacity // 2 END AS tst FROM w_capacity")
cte(
    "w_quota1",
    f"""SELECT q.topic, capacity, cal + coalesce(x, 0) AS cal, tst FROM w_quota0 q LEFT JOIN (SELECT topic, count(*) AS x FROM (SELECT topic, row_number() OVER (ORDER BY s.turn, topic) AS rn FROM w_quota0 JOIN range(1, 100000) s(turn) ON s.turn <= capacity - cal - tst)
  WHERE rn <= (SELECT count(*) * {NOMINAL} - sum(cal) FROM w_quota0) GROUP BY 1) e ON e.topic = q.topic""",
)
cte(
    "w_quota",
    f"""SELECT q.topic, capacity, cal, tst + coalesce(x, 0) AS tst FROM w_quota1 q LEFT JOIN (SELECT topic, count(*) AS x FROM (SELECT topic, row_number() OVER (ORDER BY s.turn, topic) AS rn FROM w_quota1 JOIN range(1, 100000) s(turn) ON s.turn <= capacity - cal - tst)
  WHERE rn <= (SELECT count(*) * {NOMINAL} - sum(tst) FROM w_quota1) GROUP BY 1) e ON e.topic = q.topic""",
)
cte(
    "w_rank2",
    """SELECT r.*, q.cal, q.tst, CASE WHEN hard AND r2 <= 2 THEN 'calibration_hard' WHEN hard AND r2 <= 5 THEN 'test_hard' WHEN NOT hard AND r2 <= cal THEN 'calibration_ordinary' WHEN NOT hard AND r2 <= cal + tst THEN 'test_ordinary' END AS st FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, hard ORDER BY CASE WHEN hard THEN gid ELSE order_key END, gid) AS r2 FROM w_rank1 WHERE r1 > 12) r JOIN w_quota q ON q.topic = r.topic""",
)
_STEPS = [(n, c) for n, c in COUNTS.items() if n not in ("reference", "calibration_hard", "test_hard")]


def _case():
    upto, out = 0, []
    for n, c in _STEPS:
        upto += c
        out.append(f"WHEN r3 <= {upto} THEN '{n}'")
    return "CASE " + " ".join(out) + " END"


cte(
    "w_alloc",
    f"""SELECT *, CASE WHEN stratum = 'reference' THEN 'reference' ELSE split_part(stratum, '_', 1) END AS split FROM (SELECT gid, topic, 'reference' AS stratum FROM w_rank1 WHERE r1 <= 12 UNION ALL SELECT gid, topic, st FROM w_rank2 WHERE st IS NOT NULL
  UNION ALL SELECT gid, topic, {_case()} FROM (SELECT gid, topic, row_number() OVER (PARTITION BY topic ORDER BY order_key, gid) AS r3 FROM w_rank2 WHERE st IS NULL)) WHERE stratum IS NOT NULL""",
)


def posts(spark, d, only=None):
    """Every document with its normalised text; with `only` (doc_id and more), these alone, with its columns.

    They meet as they are dealt: after normalisation, a join would move all texts once more.
    """
    t = src.dealt(src.table(spark, d, "documents"), "doc_id")
    if only is not None:
        t = t.join(only, "doc_id")
    p = t.select(
        "doc_id", F.col("lang").alias("topic"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_id"), "text",
        tx.normalize_text("text").alias("norm"), *([c for c in only.columns if c != "doc_id"] if only is not None else []),
    )
    return p.withColumn("gid", F.sha2("norm", 256)).withColumn("raw_sha", F.sha2("text", 256))


def groups(spark, d):
    return co.duplicate_groups(posts(spark, d).select("gid", "topic", "source_id", "raw_sha", "doc_id"))


def canonical(spark, d):
    """One row per group with what its canonical post's text says; the text itself stays behind."""
    p = posts(spark, d).withColumns({"reasons": tx.eligibility_reasons("norm"), "rules": tx.hard_negative_rules("text")})
    g = co.duplicate_groups(p, carry=("reasons", "rules"))
    return g.withColumn("order_key", tx.domain_hash("vislens-order", "topic", "gid"))


def pool(spark, d):
    c = canonical(spark, d).filter(F.size("reasons") == 0)
    return c.select("gid", "topic", "doc_id", "order_key", "rules", (F.size("rules") > 0).alias("hard"))


def quotas(p):
    """Per-topic quotas from the ordinary items left after the reference has been taken."""
    ref = co.hash_ordered_take(p.select("topic", "hard", F.struct("order_key", "gid").alias("o")), ["topic"], "o", COUNTS["reference"])
    left = p.select("topic", "hard", F.lit(1).alias("n")).unionByName(ref.select("topic", "hard", F.lit(-1).alias("n")))
    cap = left.groupBy("topic").agg(F.coalesce(F.sum(F.when(~F.col("hard"), F.col("n"))), F.lit(0)).alias("capacity"))
    return co.repair_quotas(cap, NOMINAL)


def frozen_pool(spark, d):
    """The eligible pool, materialised because allocation reads it several times."""
    return cut_lineage(pool(spark, d))


def allocated(spark, d, p=None):
    p = frozen_pool(spark, d) if p is None else p
    a = co.allocate(p.drop("rules"), quotas(p), COUNTS)
    return a.withColumn("split", F.split("stratum", "_")[0])


@query("normalize_text", "SELECT doc_id, length(norm) AS n, sha256(norm) AS sha FROM w_docs")
def normalize_text(spark, d):
    return posts(spark, d).select("doc_id", F.char_length("norm").alias("n"), F.col("gid").alias("sha"))


@query("content_key", "SELECT doc_id, gid AS source_group, sha256('vislens-item|' || gid) AS item_key, sha256('vislens-order|' || topic || '|' || gid) AS order_key FROM w_docs")
def content_key(spark, d):
    return posts(spark, d).select(
        "doc_id", F.col("gid").alias("source_group"), tx.domain_hash("vislens-item", "gid").alias("item_key"), tx.domain_hash("vislens-order", "topic", "gid").alias("order_key")
    )


@query("dedup_groups", "SELECT gid, topic, source_id, raw_sha, n_members, n_aliases FROM w_groups")
def dedup_groups(spark, d):
    return groups(spark, d).drop("doc_id")


@query(
    "dup_exclusions",
    "SELECT 'duplicate_noncanonical' AS reason, d.gid, d.topic, d.source_id, d.raw_sha, g.topic AS canonical_topic, g.source_id AS canonical_source_id FROM w_docs d JOIN w_groups g ON g.gid = d.gid WHERE d.doc_id <> g.doc_id",
)
def dup_exclusions(spark, d):
    p = posts(spark, d).select("gid", "topic", "source_id", "raw_sha", "doc_id")
    return co.duplicate_log(p, co.duplicate_groups(p))


@query("eligibility_reasons", "SELECT doc_id, gid, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM w_elig")
def eligibility_reasons(spark, d):
    p = posts(spark, d).withColumn("reasons", tx.eligibility_reasons("norm"))
    g = co.duplicate_groups(p, carry=("reasons",))
    return g.select("doc_id", "gid", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "word_halves",
    "SELECT doc_id, len(ws) // 2 AS n_first, len(ws) - len(ws) // 2 AS n_second, sha256(array_to_string(ws[1:len(ws) // 2], ' ')) AS first_sha, sha256(array_to_string(ws[len(ws) // 2 + 1:], ' ')) AS second_sha FROM w_docs",
)
def word_halves(spark, d):
    a, b = tx.word_halves("norm")
    n = F.size(tx.words("norm"))
    return posts(spark, d).select(
        "doc_id", F.floor(n / 2).alias("n_first"), (n - F.floor(n / 2)).alias("n_second"), F.sha2(a, 256).alias("first_sha"), F.sha2(b, 256).alias("second_sha")
    )


@query("query_prefix", "SELECT doc_id, array_to_string(ws[1:30], ' ') AS query FROM w_docs")
def query_prefix(spark, d):
    return posts(spark, d).select("doc_id", tx.query_prefix("norm").alias("query"))


@query("hard_negative_rules", "SELECT doc_id, array_to_string(rules, ',') AS rules FROM w_rules")
def hard_negative_rules(spark, d):
    t = src.dealt(src.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return t.select("doc_id", F.array_join(tx.hard_negative_rules("text"), ",").alias("rules"))


cte("w_tc", "SELECT topic, p, m / sqrt(sum(m * m) OVER (PARTITION BY topic)) AS x FROM (SELECT label AS topic, p, avg(embedding[p]::DOUBLE) AS m FROM embeddings CROSS JOIN range(1, 65) r(p) WHERE vec_id % 4 = 0 GROUP BY ALL)")


def centroids(spark, d):
    from vislens.functions.vectors import norm, unit

    e = src.items(spark, d).filter("id % 4 = 0")
    c = mean_vector(e, ["topic"], "vector")
    degenerate = F.assert_true(norm("centroid") > 1e-12, F.lit("degenerate centroid"))
    return c.filter(degenerate.isNull()).select("topic", unit("centroid").alias("centroid"))


@query("topic_centroids", "SELECT topic, CAST(p - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM w_tc")
def topic_centroids(spark, d):
    return centroids(spark, d).select("topic", F.posexplode("centroid").alias("pos", "x")).select("topic", "pos", F.round("x", 6).alias("x"))


@query(
    "centroid_mismatch",
    """SELECT id, topic, nearest, nearest <> topic AS mismatch FROM (SELECT e.id, e.topic, c.topic AS nearest, row_number() OVER (PARTITION BY e.id ORDER BY round(s, 9) DESC, c.topic DESC) AS rn FROM w_items e JOIN (
  SELECT e.vec_id, c.topic, sum(e.embedding[c.p]::DOUBLE * c.x) AS s FROM embeddings e CROSS JOIN w_tc c GROUP BY ALL) c ON c.vec_id = e.id) WHERE rn = 1""",
)
def centroid_mismatch(spark, d):
    it = src.items(spark, d)
    c = centroids(spark, d).withColumnRenamed("topic", "nearest")
    best = max_similarity(it, c, anchor_key="nearest", anchor_vec="centroid")
    return it.select("id", "topic").join(best, "id").select("id", "topic", "nearest", (F.col("nearest") != F.col("topic")).alias("mismatch"))


@query("hash_take", "SELECT topic, gid, rank FROM (SELECT topic, gid, row_number() OVER (PARTITION BY topic ORDER BY order_key) AS rank FROM w_groups) WHERE rank <= 50")
def hash_take(spark, d):
    g = groups(spark, d).withColumn("order_key", tx.domain_hash("vislens-order", "topic", "gid"))
    return co.hash_ordered_take(g, ["topic"], "order_key", 50).select("topic", "gid", "rank")


@query("quota_repair", "SELECT topic, capacity, cal::BIGINT AS calibration, tst::BIGINT AS test FROM w_quota")
def quota_repair(spark, d):
    return quotas(pool(spark, d))


@query("allocate_strata", "SELECT gid, topic, split, stratum FROM w_alloc")
def allocate_strata(spark, d):
    return allocated(spark, d).select("gid", "topic", "split", "stratum")


_TPL = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(tx.TEMPLATES))


@query("render_template", f"SELECT doc_id, trim(replace(CASE doc_id % 5 {_TPL} END, '{{q}}', array_to_string(ws[1:30], ' '))) AS rendered FROM w_docs")
def render_template(spark, d):
    return posts(spark, d).select("doc_id", tx.render_template(F.col("doc_id") % 5, tx.query_prefix("norm")).alias("rendered"))


@query("append_suffix", f"SELECT doc_id, sha256(trim(norm || ' {tx.COVER_SUFFIX}')) AS sha FROM w_docs")
def append_suffix(spark, d):
    return posts(spark, d).select("doc_id", F.sha2(tx.append_suffix("norm"), 256).alias("sha"))


cte(
    "w_grams",
    """SELECT side, id, i AS pos, array_to_string(ts[i:i + 5], ' ') AS gram FROM (SELECT side, id, ts, unnest(range(1, len(ts) - 4)) AS i FROM (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+') AS ts FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+') FROM benchmark))""",
)


@query(
    "shared_6gram",
    """SELECT left_id AS doc_id, right_id AS item_id, max(k) + 5 AS longest_run FROM (SELECT left_id, right_id, diag, island, count(*) AS k FROM (SELECT *, lp - row_number() OVER (PARTITION BY left_id, right_id, diag ORDER BY lp) AS island FROM (
  SELECT a.id AS left_id, b.id AS right_id, a.pos AS lp, a.pos - b.pos AS diag FROM w_grams a JOIN w_grams b ON a.gram = b.gram WHERE a.side = 'd' AND b.side = 'b')) GROUP BY ALL) GROUP BY ALL""",
)
def shared_6gram(spark, d):
    docs = src.dealt(src.table(spark, d, "documents").select(F.col("doc_id").alias("left_id"), "text"), "left_id")
    bench = src.table(spark, d, "benchmark").select(F.col("item_id").alias("right_id"), "text")
    return co.shared_runs(docs, bench).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "longest_run")


cte("w_kind", "SELECT doc_id, gid, CASE doc_id % 8 WHEN 1 THEN 'invalid_signature' WHEN 2 THEN 'provenance_conflict' WHEN 3 THEN 'unknown_source' END AS kind, length(norm) AS n_text, doc_id % 4 = 0 AS reference FROM w_docs")


def control_kind():
    k = F.col("doc_id") % 8
    return F.when(k == 1, "invalid_signature").when(k == 2, "provenance_conflict").when(k == 3, "unknown_source")


@query("source_evidence", "SELECT doc_id, kind, coalesce(kind NOT IN ('invalid_signature', 'unknown_source'), true) AS credential_valid, coalesce(kind <> 'provenance_conflict', true) AS provenance_consistent, 'rev-1' AS embedding_model_revision FROM w_kind")
def source_evidence(spark, d):
    t = src.table(spark, d, "documents").select("doc_id", control_kind().alias("kind"))
    return t.select("doc_id", "kind", *co.source_evidence("kind"))


@query("alloc_cube", "SELECT coalesce(topic, '*') AS topic, coalesce(split, '*') AS split, coalesce(stratum, '*') AS stratum, count(*) AS n FROM w_alloc GROUP BY CUBE (topic, split, stratum)")
def alloc_cube(spark, d):
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return allocated(spark, d).cube("topic", "split", "stratum").agg(F.count(F.lit(1)).alias("n")).select(star("topic"), star("split"), star("stratum"), "n")


@query("rule_histogram", "SELECT split, rule, count(*) AS n FROM (SELECT a.split, unnest(p.rules) AS rule FROM w_alloc a JOIN w_pool p ON p.gid = a.gid) GROUP BY ALL")
def rule_histogram(spark, d):
    p = frozen_pool(spark, d)
    a = allocated(spark, d, p).select("gid", "split").join(p.select("gid", "rules"), "gid")
    return a.select("split", F.explode("rules").alias("rule")).groupBy("split", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_projection",
    "SELECT sha256('vislens-item|' || gid) AS item_key, n_text, coalesce(kind NOT IN ('invalid_signature', 'unknown_source'), true) AS credential_valid, coalesce(kind <> 'provenance_conflict', true) AS provenance_consistent, gid AS source_group, reference, 'rev-1' AS model_revision FROM w_kind",
)
def safe_projection(spark, d):
    p = posts(spark, d).withColumn("kind", control_kind())
    wide = p.select(
        "*", tx.domain_hash("vislens-item", "gid").alias("item_key"), F.char_length("norm").alias("n_text"), *co.source_evidence("kind"), F.col("gid").alias("source_group"),
        (F.col("doc_id") % 4 == 0).alias("reference"), F.lit(co.MODEL_REVISION).alias("model_revision"),
    )
    return co.safe_projection(wide, ["item_key", "n_text", "credential_valid", "provenance_consistent", "source_group", "reference", "model_revision"])


@query("topic_pool", "SELECT topic, doc_id, rank FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rank FROM w_docs WHERE length(norm) BETWEEN 300 AND 2000) WHERE rank <= 40")
def topic_pool(spark, d):
    p = posts(spark, d).filter(F.char_length("norm").between(tx.MIN_CHARS, tx.MAX_CHARS))
    return co.hash_ordered_take(p, ["topic"], "doc_id", 40).select("topic", "doc_id", "rank")


@query(
    "seeded_split",
    """SELECT seed, topic, doc_id, CASE WHEN rk <= 10 THEN 'corpus' WHEN rk <= 14 THEN 'craft' WHEN rk <= 20 THEN 'target' WHEN rk <= 24 THEN 'clean' WHEN rk <= 28 THEN 'negative' ELSE 'filler' END AS slice FROM (
  SELECT s.seed, topic, doc_id, row_number() OVER (PARTITION BY s.seed, topic ORDER BY sha256(s.seed || '|' || doc_id), doc_id) AS rk FROM w_docs CROSS JOIN (VALUES (1), (2), (3)) s(seed)) WHERE rk <= 32""",
)
def seeded_split(spark, d):
    from vislens.operators.eligibility import seeded_hash

    t = src.table(spark, d, "documents").select(F.col("lang").alias("topic"), "doc_id", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])).alias("seed"))
    t = t.withColumn("h", F.struct(seeded_hash(F.col("seed"), "doc_id"), "doc_id"))
    cut = F.lit("filler")
    for end, name in ((28, "negative"), (24, "clean"), (20, "target"), (14, "craft"), (10, "corpus")):
        cut = F.when(F.col("rank") <= end, name).otherwise(cut)
    return co.hash_ordered_take(t, ["seed", "topic"], "h", 32).select("seed", "topic", "doc_id", cut.alias("slice"))


@query(
    "phase_manifest",
    "SELECT split AS phase, count(*) AS n, count(DISTINCT a.gid) AS n_keys, count(DISTINCT topic) AS n_topics, count(*) FILTER (WHERE x.k > 1) AS shared_with_other_phase FROM w_alloc a JOIN (SELECT gid, count(DISTINCT split) AS k FROM w_alloc GROUP BY 1) x ON x.gid = a.gid GROUP BY 1",
)
def phase_manifest(spark, d):
    a = allocated(spark, d)
    per_key = a.groupBy("gid", "split", "topic").agg(F.count(F.lit(1)).alias("n"))
    # A key has at most one row per phase and topic, so its window is small.
    phases = per_key.withColumn("k", F.size(F.collect_set("split").over(W.partitionBy("gid"))))
    return phases.groupBy(F.col("split").alias("phase")).agg(
        F.sum("n").alias("n"), F.count_distinct("gid").alias("n_keys"), F.count_distinct("topic").alias("n_topics"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("shared_with_other_phase")
    )


@query(
    "reference_index",
    "SELECT vec_id AS id, vec_id // 8 AS source_group, coalesce(n_ref, 0) AS excluded, (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 0) - coalesce(n_ref, 0) AS usable FROM embeddings LEFT JOIN (SELECT vec_id // 8 AS g, count(*) AS n_ref FROM embeddings WHERE vec_id % 4 = 0 GROUP BY 1) r ON r.g = vec_id // 8 WHERE vec_id % 4 <> 0",
)
def reference_index(spark, d):
    e = src.items(spark, d).select("id", F.floor(F.col("id") / 8).alias("source_group"))
    ref = e.filter("id % 4 = 0")
    total = ref.agg(F.count(F.lit(1))).scalar()
    own = ref.groupBy("source_group").agg(F.count(F.lit(1)).alias("excluded"))
    out = e.filter("id % 4 <> 0").join(own, "source_group", "left")
    n = F.coalesce("excluded", F.lit(0))
    return out.select("id", "source_group", n.alias("excluded"), (total - n).alias("usable"))


@query(
    "cohort_freeze_violations",
    """SELECT topic, stratum, expected, coalesce(n, 0) AS found, coalesce(n, 0) - expected AS off FROM (SELECT topic, s.stratum, CASE s.stratum WHEN 'calibration_ordinary' THEN q.cal WHEN 'test_ordinary' THEN q.tst ELSE s.expected END::BIGINT AS expected FROM w_quota q CROSS JOIN (VALUES """
    + ", ".join(f"('{n}', {c})" for n, c in {**COUNTS, "calibration_ordinary": 0, "test_ordinary": 0}.items())
    + """) s(stratum, expected)) e LEFT JOIN (SELECT topic, stratum, count(DISTINCT gid) AS n FROM w_alloc GROUP BY ALL) a USING (topic, stratum) WHERE coalesce(n, 0) <> expected""",
)
def cohort_freeze_violations(spark, d):
    """Strata whose recomputed size differs from the frozen quota."""
    p = frozen_pool(spark, d)
    q = quotas(p)
    fixed = F.array(*[F.struct(F.lit(n).alias("stratum"), F.lit(c).cast("bigint").alias("expected")) for n, c in COUNTS.items()])
    split = F.array(
        F.struct(F.lit("calibration_ordinary").alias("stratum"), F.col("calibration").alias("expected")), F.struct(F.lit("test_ordinary").alias("stratum"), F.col("test").alias("expected"))
    )
    want = q.select("topic", F.explode(F.concat(fixed, split)).alias("e")).select("topic", "e.*")
    have = co.allocate(p.drop("rules"), q, COUNTS).groupBy("topic", "stratum").agg(F.count_distinct("gid").alias("n"))
    n = F.coalesce("n", F.lit(0))
    out = want.join(have, ["topic", "stratum"], "left").select("topic", "stratum", "expected", n.alias("found"), (n - F.col("expected")).alias("off"))
    return out.filter("off <> 0")
