import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vislens.operators import ordered as o
from vislens.operators.lifecycle import fifo_queue, max_in_flight


def frame(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    g = rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1])
    return spark.createDataFrame([(x, int(t), int(i), int(v)) for x, t, i, v in zip(g, rng.integers(0, 300, n), range(n), rng.integers(-5, 50, n))], "g string, t long, id long, v long")


def test_running_sum_and_max_equal_pandas(spark):
    df = frame(spark)
    got = o.running(df, ["g"], o.time_chunk("t", 20), [F.col("t"), F.col("id")], sums={"s": F.col("v")}, maxes={"m": F.col("v")}, totals={"s": "all"}).toPandas()
    p = df.toPandas().sort_values(["t", "id"])
    p["g"] = p["g"].fillna("-")
    p["s"], p["m"], p["all"] = p.groupby("g")["v"].cumsum(), p.groupby("g")["v"].cummax(), p.groupby("g")["v"].transform("sum")
    both = p.merge(got, on="id")
    assert len(both) == len(p)
    assert (both.s_x == both.s_y).all() and (both.m_x == both.m_y).all() and (both.all_x == both.all_y).all()


def test_neighbours_cross_chunks(spark):
    df = frame(spark)
    got = o.neighbours(df, ["g"], o.time_chunk("t", 7), F.struct("t", "id"), prev={"p": "id"}, following={"n": "id"}).toPandas()
    p = df.toPandas().sort_values(["t", "id"])
    p["g"] = p["g"].fillna("-")
    p["p"], p["n"] = p.groupby("g")["id"].shift(1), p.groupby("g")["id"].shift(-1)
    both = p.merge(got, on="id")
    assert both.p_x.equals(both.p_y.astype(float)) and both.n_x.equals(both.n_y.astype(float))


def test_quantiles_linear_and_nearest(spark):
    df = frame(spark, 3).filter("g is not null")
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    lin = {r["g"]: r for r in o.quantiles(df, ["g"], "v", probs, stats=True).collect()}
    near = {r["g"]: r for r in o.quantiles(df, ["g"], "v", probs, nearest=True).collect()}
    for g, part in df.toPandas().groupby("g"):
        xs = np.sort(part.v.to_numpy())
        assert lin[g]["n"] == len(xs) and lin[g]["min"] == xs[0] and lin[g]["max"] == xs[-1]
        for name, p in probs.items():
            assert abs(lin[g][name] - np.quantile(xs, p)) < 1e-9
            assert near[g][name] == xs[min(len(xs) - 1, int(p * len(xs)))]


def test_take_top_splits_a_heavy_tie(spark):
    rows = [("t", i, 0.5 if i % 3 else 0.25) for i in range(90)] + [("t", 100, 0.9)]
    df = spark.createDataFrame(rows, "tag string, id long, score double")
    got = sorted(r["id"] for r in o.take_top(df, ["tag"], "score", "id", F.lit(21)).collect())
    want = sorted(pd.DataFrame(rows, columns=["tag", "id", "s"]).sort_values(["s", "id"], ascending=[False, True]).head(21).id)
    assert got == want


def test_fifo_equals_the_recurrence_for_any_chunk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(l), int(a), int(s)) for i, (l, a, s) in enumerate(zip(rng.integers(0, 2, 300), np.sort(rng.integers(0, 2000, 300)), rng.integers(0, 30, 300)))]
    df = spark.createDataFrame(rows, "item_id long, lane long, arrival_us long, service_us long")
    busy, want = {}, {}
    for i, lane, a, s in sorted(rows, key=lambda r: (r[2], r[0])):
        busy[lane] = max(a, busy.get(lane, -1)) + s
        want[i] = busy[lane]
    for chunk in (10, 150, 10**6):
        got = {r["item_id"]: r["commit_us"] for r in fifo_queue(df, ["lane"], chunk_us=chunk).collect()}
        assert got == want


def test_max_in_flight(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 7), ("a", 7, 20), ("b", 1, 2)], "k string, s long, e long")
    assert {r["k"]: r["max_in_flight"] for r in max_in_flight(df, ["k"], "s", "e", 3).collect()} == {"a": 2, "b": 1}
