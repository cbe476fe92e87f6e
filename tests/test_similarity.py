import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vislens.operators import retrieval as ret
from vislens.operators import similarity as sim


def vectors(spark, n, seed, dup=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8)).astype("float32")
    v[n - dup :] = v[0]
    rows = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(n)]
    return v.astype("float64"), spark.createDataFrame(rows, "id long, vector array<float>, grp int")


def brute(q, c, k, ids, descending=False, ok=None):
    s = np.round((q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :] + 1e-12), 9)
    out = {}
    for i in range(len(q)):
        pool = [j for j in range(len(c)) if ok is None or ok(i, j)]
        out[i] = [ids[j] for j in sorted(pool, key=lambda j: (-s[i, j], -ids[j] if descending else ids[j]))[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("descending", [False, True])
def test_topk_shipped_and_grid_equal_brute_force(spark, descending):
    qv, q = vectors(spark, 12, 1)
    cv, c = vectors(spark, 200, 2, dup=40)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    want = brute(qv, cv, 6, list(range(200)), descending)
    assert lists(sim.topk(q, c, 6, descending_ties=descending)) == want
    assert lists(sim.topk(q, c, 6, descending_ties=descending, max_shipped=5, block_rows=60)) == want


def test_group_exclusion_and_tags(spark):
    qv, q = vectors(spark, 9, 3)
    cv, c = vectors(spark, 60, 4)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.col("grp").alias("qg"))
    want = brute(qv, cv, 4, list(range(60)), ok=lambda i, j: i % 3 != j % 3)
    assert lists(sim.topk(q, c, 4, query_group="qg", item_group="grp")) == want
    tagged = sim.topk(q, c, 4, tag="grp")
    for t in range(3):
        assert lists(tagged.filter(F.col("grp") == t)) == brute(qv, cv, 4, list(range(60)), ok=lambda i, j, t=t: j % 3 == t)


def test_merge_is_the_full_scan(spark):
    qv, q = vectors(spark, 6, 5)
    cv, c = vectors(spark, 80, 6)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    pre, cand = ret.dynamic_candidates(q, c.filter("id % 2 = 0"), c.filter("id % 2 = 1"), 5)
    assert lists(ret.merge_topk(pre, cand, 5)) == brute(qv, cv, 5, list(range(80)))


def test_probing_every_cell_is_exact_even_when_cells_are_split(spark):
    qv, q = vectors(spark, 6, 7)
    cv, c = vectors(spark, 90, 8)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    cells = sim.mean_vector(c, ["grp"], "vector").select(F.col("grp").alias("cell"), "centroid")
    found = ret.cell_candidates(q, c, cells, 3, 5, block_rows=7)
    assert lists(ret.rerank(found, 5)) == brute(qv, cv, 5, list(range(90)))


def test_max_similarity_and_rank(spark):
    qv, q = vectors(spark, 5, 9)
    cv, c = vectors(spark, 50, 10)
    s = np.round((cv @ qv.T) / (np.linalg.norm(cv, axis=1)[:, None] * np.linalg.norm(qv, axis=1)[None, :] + 1e-12), 9)
    for shipped in (100, 2):
        got = {r["id"]: r["score"] for r in sim.max_similarity(c, q, max_shipped=shipped).collect()}
        assert got == {i: s[i].max() for i in range(50)}
    probes = q.select(F.col("id").alias("probe_id"), F.col("vector").alias("qvec"), F.lit(0.3).alias("score"), F.lit(10).cast("long").alias("item_key"))
    n = {r["probe_id"]: r["n_above"] for r in sim.beats(probes, c, item_key="id").collect()}
    assert n == {i: int((s[:, i] > 0.3).sum()) for i in range(5)}


def no_rows(spark):
    return spark.createDataFrame([], "id long, vector array<float>, grp int")


@pytest.mark.parametrize("shipped", [100, 3, 0])
def test_an_empty_side_gives_no_rows_whichever_way_is_taken(spark, shipped):
    _, few = vectors(spark, 5, 11)
    for a, b in ((few, no_rows(spark)), (no_rows(spark), few), (no_rows(spark), no_rows(spark))):
        q = a.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
        assert sim.topk(q, b, 3, max_shipped=shipped).count() == 0
        assert sim.max_similarity(b, a, max_shipped=shipped).count() == 0
        probes = q.select(F.col("query_id").alias("probe_id"), "qvec", F.lit(0.3).alias("score"), F.lit(1).cast("long").alias("item_key"))
        assert sim.beats(probes, b, item_key="id", max_shipped=shipped).count() == 0
        assert sim.above_cutoff(q.withColumn("cutoff", F.lit(0.0)), b, max_shipped=shipped).count() == 0


@pytest.mark.parametrize("shipped", [100, 12, 4])
def test_either_side_may_be_the_small_one(spark, shipped):
    qv, q = vectors(spark, 40, 12)
    cv, c = vectors(spark, 10, 13)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    assert lists(sim.topk(q, c, 3, max_shipped=shipped, block_rows=9)) == brute(qv, cv, 3, list(range(10)))
    s = np.round((cv @ qv.T) / (np.linalg.norm(cv, axis=1)[:, None] * np.linalg.norm(qv, axis=1)[None, :] + 1e-12), 9)
    got = {r["id"]: (r["score"], r["query_id"]) for r in sim.max_similarity(c, q, anchor_key="query_id", anchor_vec="qvec", max_shipped=shipped).collect()}
    assert got == {i: (s[i].max(), int(np.flatnonzero(s[i] == s[i].max()).max())) for i in range(10)}
    cut = q.withColumn("cutoff", F.lit(0.25))
    assert {(r["query_id"], r["id"]) for r in sim.above_cutoff(cut, c, max_shipped=shipped).collect()} == {(j, i) for i in range(10) for j in range(40) if s[i, j] >= 0.25}


def test_hidden_tags_are_masks_over_one_search(spark):
    qv, q = vectors(spark, 7, 14)
    cv, c = vectors(spark, 80, 15)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    gone = {"a": {i for i in range(80) if i % 3 == 0}, "b": {i for i in range(80) if i > 10}, "c": set()}
    marks = [(i, [t for t in gone if i in gone[t]] or None) for i in range(80)]
    marked = c.join(spark.createDataFrame(marks, "id long, gone array<string>"), "id")
    for shipped in (100, 5, 2):
        got = sim.topk(q, marked, 4, hidden="gone", hidden_tags=list(gone), max_shipped=shipped, block_rows=30)
        for t, hid in gone.items():
            assert lists(got.filter(F.col("tag") == t)) == brute(qv, cv, 4, list(range(80)), ok=lambda i, j, hid=hid: j not in hid)


def test_blocks_of_full_size(spark):
    """Two blocks on either side at the sizes that a cluster uses."""
    n, m = sim.BLOCK_ROWS + 300, sim.MAX_SHIPPED_ROWS + 200
    rng = np.random.default_rng(16)
    cv, qv = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
    frame = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = frame(qv).select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    got = lists(sim.topk(q, frame(cv), 2).filter("query_id % 200 = 0"))
    u = cv / np.linalg.norm(cv, axis=1)[:, None]
    assert len(got) == len(range(0, m, 200))
    for i, ids in got.items():
        s = np.round(u @ (qv[i] / np.linalg.norm(qv[i])), 9)
        assert sorted(s[ids])[::-1] == sorted(s)[::-1][:2]


def clustered(spark, n, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, 8)) * 3
    v = (middle[rng.integers(0, centres, n)] + rng.normal(size=(n, 8))).astype("float32")
    return v.astype("float64"), spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "id long, vector array<float>")


def test_trained_cells_are_an_inverted_file_that_is_read_in_part(spark, tmp_path):
    qv, q = clustered(spark, 40, 21)
    cv, c = clustered(spark, 900, 22)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    cells = ret.train_cells(c, 16, seed=3).cache()
    ret.write_cells(c, cells, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 900 and stored.select("cell").distinct().count() <= 16
    want = brute(qv, cv, 5, list(range(900)))
    share = {}
    for n_probe in (1, 4, 16):
        found = lists(ret.rerank(ret.search_cells(q, str(tmp_path / "cells"), cells, n_probe, 5, block_rows=70, block_queries=7), 5))
        share[n_probe] = np.mean([len(set(found.get(i, [])) & set(want[i])) / 5 for i in want])
        scored = ret.cell_effort(ret.probe_cells(q, cells, n_probe), stored, ["query_id"]).agg(F.sum("vectors_scored")).first()[0]
        assert (scored == 40 * 900) == (n_probe == 16)
    assert share[1] <= share[4] <= share[16] == 1 and share[4] >= 0.9
    one = q.filter("query_id = 0")
    plan = ret.search_cells(one, str(tmp_path / "cells"), cells, 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_other_seeds_train_other_cells(spark):
    _, c = clustered(spark, 300, 23)
    centres = [sorted(tuple(round(x, 4) for x in r["centroid"]) for r in ret.train_cells(c, 8, seed).collect()) for seed in (1, 1, 2)]
    assert centres[0] == centres[1] != centres[2]


def test_many_cells_are_trained_in_blocks_and_not_on_the_driver(spark, monkeypatch):
    from pyspark.ml import clustering

    monkeypatch.setattr(clustering, "KMeans", lambda **_: pytest.fail("seeding on the driver"))
    v, c = clustered(spark, 900, 24)
    centres = {seed: np.array([r["centroid"] for r in ret.train_cells(c, 300, seed).orderBy("cell").collect()]) for seed in (1, 2)}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert centres[1].shape == (300, 8) and not np.allclose(centres[1], centres[2])
    s = u @ centres[1].T
    home = s.argmax(axis=1)
    assert np.allclose(np.linalg.norm(centres[1], axis=1), 1) and len(np.unique(home)) > 250
    mean = np.array([m / np.linalg.norm(m) for m in (u[home == k].sum(axis=0) for k in np.unique(home))])
    assert (mean * centres[1][np.unique(home)]).sum(axis=1).mean() > 0.999  # a centre is the mean of its vectors
    started = (u @ u[np.random.default_rng(1).permutation(900)[:300]].T).max(axis=1)
    assert s.max(axis=1).mean() > np.sort(started)[:600].mean()
    # 20 different vectors cannot make 300 cells
    few = spark.createDataFrame([(i, v[i % 20].tolist()) for i in range(400)], "id long, vector array<double>")
    assert sorted(tuple(np.round(r["centroid"], 6)) for r in ret.train_cells(few, 300).collect()) == sorted(map(tuple, np.round(u[:20], 6)))


@pytest.mark.parametrize("search", ["topk", "max_similarity", "beats", "above_cutoff"])
def test_scores_of_a_long_block_are_held_in_small_tiles(spark, monkeypatch, search):
    held = {}

    def grab(big, other, kernel, schema, **_):
        held["kernel"] = kernel
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(sim, "block_join", grab)
    v = "array(1.0F, 2.0F)"
    items = spark.sql(f"SELECT 1L AS id, 1L AS item_key, {v} AS vector")
    asked = spark.sql(f"SELECT 1L AS query_id, 1L AS probe_id, 1L AS item_key, {v} AS qvec, {v} AS vector, 0.5D AS score, 2.0D AS cutoff")
    calls = {"topk": lambda: sim.topk(asked, items, 5), "max_similarity": lambda: sim.max_similarity(items, asked, anchor_key="query_id")}
    calls |= {"beats": lambda: sim.beats(asked, items), "above_cutoff": lambda: sim.above_cutoff(asked, items)}
    calls[search]()
    rng = np.random.default_rng(21)
    n, m = 50_000, 300

    def table(rows, **more):
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=rows * 4).astype("float32")), 4).cast(pa.list_(pa.float32()))
        ids, nothing = pa.array(np.arange(rows)), pa.array([""] * rows)
        return pa.table({"id": ids, "k": ids, "v": vectors, "tag": nothing, "g": nothing, "qid": ids, "q": ids, "p": ids, "pk": ids, "s": pa.array(np.full(rows, 0.5)), "c": pa.array(np.full(rows, 2.0))})

    big, other = table(n), table(m)
    tracemalloc.start()
    out = held["kernel"](big, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == {"topk": 5 * m, "max_similarity": n, "beats": m, "above_cutoff": 0}[search]
    assert peak < 64 << 20


def test_blocks_of_long_vectors_have_fewer_rows(spark, monkeypatch):
    qv, q = vectors(spark, 9, 22)
    cv, c = vectors(spark, 70, 23)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    seen = []
    sequence = F.sequence
    monkeypatch.setattr(sim.F, "sequence", lambda a, b: seen.append(b._jc.toString()) or sequence(a, b))
    monkeypatch.setattr(sim, "BLOCK_BYTES", 600, raising=False)
    assert lists(sim.topk(q, c, 4, max_shipped=4)) == brute(qv, cv, 4, list(range(70)))
    assert int(seen[1]) > 0  # the items are cut, though they are fewer than BLOCK_ROWS


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_blocks_of_two_large_sides_are_not_copied_through_a_shuffle(spark, monkeypatch, held):
    """Beyond a bound, copies for all pairs of blocks would fill disks with the product of both sides."""
    monkeypatch.setattr(sim, "COPIED_BYTES", 1000, raising=False)
    monkeypatch.setattr(sim, "HELD_ROWS", held, raising=False)
    monkeypatch.setattr(sim, "STREAMED_BLOCKS", 2, raising=False)
    monkeypatch.setattr(sim, "BLOCK_BYTES", 1200)
    qv, q = vectors(spark, 40, 24, dup=6)
    cv, c = vectors(spark, 130, 25, dup=30)
    q = q.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.col("grp").cast("string").alias("qg"))
    c = c.withColumn("g", F.when(F.col("grp") > 0, F.col("grp").cast("string")))
    got = sim.topk(q, c, 5, query_group="qg", item_group="g", max_shipped=6)
    assert lists(got) == brute(qv, cv, 5, list(range(130)), ok=lambda i, j: j % 3 == 0 or i % 3 != j % 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "CartesianProduct" in plan
    s = np.round((cv @ qv.T) / (np.linalg.norm(cv, axis=1)[:, None] * np.linalg.norm(qv, axis=1)[None, :] + 1e-12), 9)
    best = {r["id"]: (r["score"], r["query_id"]) for r in sim.max_similarity(c, q, anchor_key="query_id", anchor_vec="qvec", max_shipped=6).collect()}
    assert best == {i: (s[i].max(), int(np.flatnonzero(s[i] == s[i].max()).max())) for i in range(130)}
    probes = q.select(F.col("query_id").alias("probe_id"), "qvec", F.lit(0.3).alias("score"), F.lit(-1).cast("long").alias("item_key"))
    assert {r["probe_id"]: r["n_above"] for r in sim.beats(probes, c, item_key="id", max_shipped=6).collect()} == {i: int((s[:, i] > 0.3).sum()) for i in range(40)}
    cut = q.withColumn("cutoff", F.lit(0.25))
    assert {(r["query_id"], r["id"]) for r in sim.above_cutoff(cut, c, max_shipped=6).collect()} == {(j, i) for i in range(130) for j in range(40) if s[i, j] >= 0.25}


def test_the_bound_of_a_row_loses_none_of_its_best(spark):
    rng = np.random.default_rng(26)
    for trial in range(400):
        k, levels = int(rng.integers(1, 6)), int(rng.integers(1, 300))
        s = rng.integers(0, levels, size=(6, int(rng.integers(1, 400)))).astype(float)
        for odd, every, share in ((-np.inf, 2, 0.3), (np.nan, 5, 0.01), (np.inf, 7, 0.01)):
            if trial % every == 0:
                s[rng.random(s.shape) < share] = odd
        found = list(zip(*sim._best_places(s, k)))
        assert len(found) == len(set(found)) and set(found) == set(zip(*np.nonzero(sim._keep_topk(s, k))))
