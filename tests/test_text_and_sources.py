import math
import unicodedata

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vislens.functions import text as tx
from vislens.functions.stats import rate_columns
from vislens.operators import calibration as cal
from vislens.operators import cohort as co
from vislens.operators import detector as det
from vislens.sources import tables as src


def test_normalisation_matches_python(spark):
    texts = ["  a b\n\tc ", "éa", " x　", "", "plain text", "näive \u0085 y"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize_text("t")).collect()]
    assert got == [" ".join(unicodedata.normalize("NFC", t).split()) for t in texts]


def test_rules(spark):
    cases = {
        "> a\n> b\nc": "quoted_reply_lines", "X WRITES: y": "reply_attribution_or_re_subject", "a\n-- \nme": "signature_footer_separator",
        "see the FAQ now": "faq_boilerplate_or_repeated_lines", "Aa  b\nx\naa b\ny\n AA B": "faq_boilerplate_or_repeated_lines", "Newsgroups: a.b, c.d\nx": "cross_post_header", "faqs writes --": "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(F.array_join(tx.hard_negative_rules("t"), ","))
    assert [r[0] for r in df.collect()] == list(cases.values())


def test_duplicates_and_shared_runs(spark):
    posts = spark.createDataFrame([("g", "b", "s2", "h2", 2), ("g", "a", "s9", "h1", 9), ("h", "a", "s1", "h3", 1)], "gid string, topic string, source_id string, raw_sha string, doc_id long")
    g = {r["gid"]: r for r in co.duplicate_groups(posts).collect()}
    assert (g["g"]["topic"], g["g"]["source_id"], g["g"]["n_members"]) == ("a", "s9", 2)
    assert [r["source_id"] for r in co.duplicate_log(posts, co.duplicate_groups(posts)).collect()] == ["s2"]
    left = spark.createDataFrame([(1, "x a b c d e f g y a b c"), (2, "a b c d e z f g h")], "left_id long, text string")
    right = spark.createDataFrame([(7, "Q A B C D E F G")], "right_id long, text string")
    assert [tuple(r) for r in co.shared_runs(left, right).collect()] == [(1, 7, 7)]


def test_quota_repair_deals_in_topic_order(spark):
    cap = spark.createDataFrame([("a", 30), ("b", 3), ("c", 9)], "topic string, capacity long")
    got = {r["topic"]: (r["calibration"], r["test"]) for r in co.repair_quotas(cap, 5).collect()}
    assert got == {"a": (8, 10), "b": (2, 1), "c": (5, 4)}


def test_calibration_contracts(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.7, True), (0.9, False)]
    c = cal.threshold_candidates(spark.createDataFrame(rows, "s double, p boolean"), "s", "p")
    got = {r["threshold"]: r for r in c.collect()}
    assert math.nextafter(0.1, -math.inf) in got and math.nextafter(0.9, math.inf) in got and len(got) == 5
    def f1(t):
        tp, fp, fn = (sum(1 for s, p in rows if cond(s >= t, p)) for cond in (lambda h, p: h and p, lambda h, p: h and not p, lambda h, p: not h and p))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    assert all(abs(r["f1"] - f1(t)) < 1e-12 for t, r in got.items())
    best = cal.select_threshold(c).first()
    assert best["threshold"] == max(t for t in got if got[t]["f1"] == max(r["f1"] for r in got.values()))
    k = spark.createDataFrame([(0, 5), (3, 10), (5, 10), (40, 100), (0, 0)], "k long, n long")
    for r in cal.sign_test(k).collect():
        want = None if r["n"] == 0 else min(1.0, 2 * sum(math.comb(r["n"], i) for i in range(min(r["k"], r["n"] - r["k"]) + 1)) / 2 ** r["n"])
        assert (r["p_value"] is None) if want is None else abs(r["p_value"] - want) < 1e-9
    r = spark.range(1).select(*rate_columns(F.lit(0), F.lit(0))).first()
    assert r["rate"] is None and r["lo"] is None and r["defined"] is False


def test_detector_guards_and_embedders(spark):
    with pytest.raises(ValueError):
        det.score_job(spark.range(1), "calibration", 1.0)
    posts = spark.createDataFrame([(1, "a b c a b c"), (2, "a b c x y z")], "doc_id long, norm string")
    got = {r["doc_id"]: r["rep"] for r in det.rep_score_embedded(posts).collect()}
    assert abs(got[1] - 1) < 1e-9 and abs(got[2]) < 1e-9
    with pytest.raises(ValueError):
        co.safe_projection(posts.withColumn("topic", F.lit("t")), ["doc_id", "topic"])


def test_strict_read_and_create_only(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("x", T.DoubleType())])
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    src.write_new(spark.createDataFrame([(1, 0.5)], schema), good)
    assert src.read_strict(spark, good, schema).count() == 1
    with pytest.raises(AnalysisException):
        src.write_new(spark.createDataFrame([(1, 0.5)], schema), good)
    src.write_new(spark.createDataFrame([(1, float("nan"))], schema), bad)
    with pytest.raises(Exception, match="non-finite"):
        src.read_strict(spark, bad, schema).collect()
    with pytest.raises(ValueError):
        src.read_strict(spark, good, T.StructType(schema.fields[:1]))
