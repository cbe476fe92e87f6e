"""The text chain against numpy, and thresholds to the last bit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vislens.operators import calibration as cal
from vislens.operators import detector as det

TINY = 5e-324


def thresholds(spark, scores):
    df = spark.createDataFrame([(float(s), i % 2 == 0) for i, s in enumerate(scores)], "s double, poison boolean")
    return [r["threshold"] for r in cal.threshold_candidates(df, "s", "poison").orderBy("threshold").collect()]


@pytest.mark.parametrize("scores", [[0.0], [1.0], [-1.0], [0.5, 2.0], [-4.0, 8.0], [2.0**-30], [TINY], [-TINY, TINY], [2.2250738585072014e-308], [0.1, 0.9, 0.9, 0.3], [1 - 2**-53], [-1e308, 1e308], [1.7e308, 1.6e308]])
def test_candidates_are_the_neighbouring_doubles(spark, scores):
    d = sorted(set(scores))
    mid = [a + (b - a) * 0.5 if math.isfinite(b - a) else a * 0.5 + b * 0.5 for a, b in zip(d, d[1:])]
    assert thresholds(spark, scores) == [math.nextafter(d[0], -math.inf), *mid, math.nextafter(d[-1], math.inf)]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None, 1.7976931348623157e308])
def test_scores_without_finite_neighbours_fail(spark, bad):
    df = spark.createDataFrame([(0.5, True), (bad, False)], "s double, poison boolean")
    with pytest.raises(Exception, match="finite"):
        cal.threshold_candidates(df, "s", "poison").collect()


def test_text_chain_equals_numpy_on_the_same_vectors(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(4, 40))), f"g{i // 2}", i % 3 == 0) for i in range(120)] + [(500, "one", "g900", False), (501, "", "g901", False)]
    posts = spark.createDataFrame(rows, "id long, norm string, source_group string, is_ref boolean")
    got = {r["id"]: (r["rep"], r["knn"]) for r in det.text_features(posts, k=5).collect()}
    halves = [(i, " ".join(t.split()[: len(t.split()) // 2]), " ".join(t.split()[len(t.split()) // 2 :]), t) for i, t, _, _ in rows if len(t.split()) > 1]
    frame = spark.createDataFrame(halves, "id long, a string, b string, t string")
    for c in "abt":
        frame = det.hashed_embedder(frame, c, f"v{c}")
    vec = {r["id"]: [np.array(r[f"v{c}"]) for c in "abt"] for r in frame.collect()}
    assert set(got) == set(vec)
    group, ref = {r[0]: r[2] for r in rows}, [r[0] for r in rows if r[3] and r[0] in vec]
    for i, (a, b, t) in vec.items():
        assert got[i][0] == pytest.approx(a @ b, abs=1e-9)
        near = sorted((round(float(t @ vec[j][2]), 9) for j in ref if group[j] != group[i]), reverse=True)[:5]
        assert got[i][1] == pytest.approx(1 - np.mean(near), abs=1e-8)


def test_knn_ships_the_smaller_side(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), f"g{i}") for i in range(60)]
    items = spark.createDataFrame(rows, "id long, vector array<double>, source_group string")
    got = {r["id"]: r["knn"] for r in det.knn_novelty(items, items.filter(F.col("id") < 20), 3).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    for i in range(60):
        near = sorted((v[i] @ v[j] for j in range(20) if j != i), reverse=True)[:3]
        assert got[i] == pytest.approx(1 - np.mean(near), abs=1e-8)


def test_labels_meet_texts_before_these_are_normalised(spark, tmp_path, monkeypatch):
    """A join after normalisation would move every text once more, those without a label too."""
    from vislens.plans import detector as plans

    spark.createDataFrame([(i, f"some  text {i // 2}", "en", "src1", 11) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 60, 3)] + [(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    monkeypatch.setattr(plans, "cut_lineage", lambda df: df)
    monkeypatch.setattr(plans.det, "text_features", lambda p: seen.append(p) or p.selectExpr("*", "id * 1.0D AS rep", "id * id * 1.0D AS knn"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plans.text_scores(spark, str(tmp_path))
        plan = seen[0]._jdf.queryExecution().executedPlan().toString().splitlines()
        rows = {r["id"]: (r["norm"], r["poison"]) for r in seen[0].collect()}
    finally:
        spark.conf.set(key, before)
    at = lambda word: next(i for i, line in enumerate(plan) if word in line)
    assert at("ArrowEvalPython") < at("SortMergeJoin")
    assert rows == {i: (f"some text {i // 2}", True) for i in (0, *range(3, 40, 3))}
