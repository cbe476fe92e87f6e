from pyspark.sql import functions as F

from vislens.operators import lifecycle as lc

S = 1_000_000


def run(spark, rows, tp, horizon=10**9):
    """rows: (item_id, arrival, source_ok, passes, commit, revoke, baseline)."""
    df = spark.createDataFrame(rows, "item_id long, arrival_us long, source_ok boolean, passes boolean, commit_us long, revoke_us long, baseline string")
    flags = {n: F.lit(None).cast("boolean") for n in ("verify", "sync", "use_deadline")}
    for b, values in lc.POLICIES.items():
        for n, v in zip(flags, values):
            flags[n] = F.when(F.col("baseline") == b, v).otherwise(flags[n])
    return lc.ledger(df.withColumns(flags), tp).withColumn("horizon_us", F.lit(horizon).cast("long"))


def path(row):
    return [(t["t_us"], t["old_state"], t["new_state"]) for t in row["trans"]]


def test_commit_time_rule_and_gate(spark):
    rows = [
        (1, 0, True, True, 2 * S, None, "B4"), (2, 0, True, True, S // 2, None, "B4"), (3, 0, True, False, S // 2, None, "B4"),
        (4, 0, False, True, S // 2, None, "B4"), (5, 0, True, True, S, None, "B4"), (6, 0, True, True, S // 2, 3 * S, "B4"), (7, 0, True, True, 2 * S, S, "B4"),
    ]
    got = {r["item_id"]: path(r) for r in run(spark, rows, S).collect()}
    assert [x[2] for x in got[1]] == ["PROVISIONAL", "HIDDEN", "TRUSTED"] and got[1][1][0] == S
    assert [x[2] for x in got[2]] == ["PROVISIONAL", "TRUSTED"]
    assert [x[2] for x in got[3]] == ["PROVISIONAL", "QUARANTINED"]
    assert got[4] == [(0, None, "QUARANTINED")]
    assert [x[2] for x in got[5]] == ["PROVISIONAL", "TRUSTED"]  # exactly at the deadline
    assert [x[2] for x in got[6]] == ["PROVISIONAL", "TRUSTED", "REVOKED"]
    assert "REVOKED" not in [x[2] for x in got[7]]  # alert before trust is ignored


def test_censoring_is_never_zero(spark):
    rows = [(1, 0, True, True, 5 * S, None, "B1"), (2, 0, True, True, 5 * S, None, "B2"), (3, 0, True, False, 5 * S, None, "B4"), (4, 0, True, False, 50 * S, None, "B4")]
    f = lc.with_facts(run(spark, rows, S, horizon=10 * S))
    out = {r["item_id"]: r for r in f.select("item_id", "state_end", "visible_us", lc.unvetted_status().alias("u"), lc.unvetted_us().alias("us"), *[c.alias(n) for n, c in lc.statuses().items()]).collect()}
    assert (out[1]["u"], out[1]["us"]) == ("RIGHT_CENSORED", 10 * S)
    assert (out[2]["u"], out[2]["us"], out[2]["visible_us"]) == ("NOT_STARTED", None, 5 * S)
    assert (out[3]["u"], out[3]["us"], out[3]["state_end"]) == ("COMPLETED", S, "QUARANTINED")
    assert out[4]["state_end"] == "HIDDEN" and out[4]["exposure_status"] == "COMPLETED" and out[4]["unavailable_status"] == "RIGHT_CENSORED"


def test_coupled_hiding_waits_for_the_backlog(spark):
    df = spark.createDataFrame([(i, 0, 0, S) for i in range(50)], "item_id long, lane long, arrival_us long, service_us long")
    q = lc.fifo_queue(df, ["lane"]).withColumn("t_us", F.lit(S).cast("long"))
    served = q.select("lane", F.col("arrival_us").alias("t_us"), F.col("commit_us").alias("busy"))
    hide = lc.last_before(q.select("lane", "item_id", "t_us"), served, ["lane"], "busy")
    assert min(r["busy"] for r in hide.collect()) == 50 * S


def test_log_round_trip_and_visible_at(spark):
    rows = [(i, 10 * i, True, i % 3 != 0, 10 * i + (1 + i % 4) * S, 10 * i + 5 * S if i % 5 == 0 else None, "B4") for i in range(40)]
    led = run(spark, rows, 2 * S, 20 * S)
    back = lc.from_log(lc.to_log(led, ["item_id"]), ["item_id"])
    a = {r["item_id"]: path(r) for r in led.collect()}
    assert a == {r["item_id"]: path(r) for r in back.collect()}
    at = 3 * S + 15
    f = lc.with_facts(led).withColumn("direct", F.exists("spans", lambda s: s["visible"] & (s["start_us"] <= at) & (s["end_us"] > at)))
    assert all(r["direct"] == r["v"] for r in f.select("direct", lc.visible_at(F.lit(at)).alias("v")).collect())


def test_illegal_logs_are_reported(spark):
    rows = [("x", 1, 1, None, "PROVISIONAL"), ("x", 2, 2, "PROVISIONAL", "TRUSTED"), ("x", 3, 3, "HIDDEN", "TRUSTED"), ("x", 4, 4, "TRUSTED", "PROVISIONAL")]
    log = spark.createDataFrame(rows, "k string, event_id long, t_us long, old_state string, new_state string")
    for chunk in (1, 100):
        got = sorted((r["event_id"], r["rule"]) for r in lc.transition_violations(log, ["k"], chunk).collect())
        assert got == [(3, "broken_chain"), (4, "illegal_edge"), (4, "provisional_again")]


def test_probes_meet_items_before_the_policy_cells(spark, tmp_path):
    """What is shuffled to join probes with items is a row for each load, not a ledger row for each policy cell."""
    import re

    from vislens.plans.catalog import QUERIES

    kinds = ("view", "error", "purchase", "signup")
    rows = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_micros(1700000000000000 + id * 30000000) AS ts", "id % 90 AS user_id",
        f"element_at(array{kinds}, int(id % 4) + 1) AS event_type", "double(id % 37) AS value", "'' AS props",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = QUERIES["visible_during_query"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # probes of items 0 and up, at lags 1, 10 and 50 of every fourth event
        assert {r["lag_n"]: r["probes"] for r in out.filter("backlog = 'heavy' AND baseline = 'B1'").collect()} == {1: 99, 10: 97, 50: 87}
    finally:
        spark.conf.set(key, before)
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if re.search(r"Join Inner.*item_id", line))
    assert any("Generate" in line for line in lines[:join])


def test_exposure_is_exact_beyond_bigint(spark, tmp_path):
    """Forty items over ten thousand years: the sum of their microseconds exceeds a bigint."""
    from datetime import datetime, timedelta

    from vislens.plans.catalog import QUERIES

    first, last = datetime(1, 1, 2), datetime(9999, 12, 30)
    each = (last - first - timedelta(days=5)) // timedelta(microseconds=1)
    for n, kind in ((40, "decimal(38,0)"), (20, "bigint")):
        rows = [(i, first, 1 + 20 * i, "view", 1.0) for i in range(n)] + [(n, last, 1, "view", 1.0)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/{n}/events.parquet")
        out = QUERIES["window_exposure"](spark, f"{tmp_path}/{n}")
        refused = sum((1 + 20 * i) % 17 == 0 for i in range(n))
        got = out.filter("baseline = 'B1' AND backlog = 'normal'").first()
        assert out.schema["exposure_us"].dataType.simpleString() == kind
        assert (int(got["exposure_us"]), got["exposed_items"]) == ((n - refused) * each, n - refused)
