"""Admission lifecycle as relational expressions: verifier queue, policies, transition ledger.

An item has one admission, at most one verdict, one deadline and at most one
revocation, so its whole trajectory is a short array computed from its own row:
no shuffle is needed after the verifier queue has been resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.operators.ordered import join_null_safe, neighbours, running, time_chunk

PROVISIONAL, TRUSTED, QUARANTINED, HIDDEN, REVOKED = "PROVISIONAL", "TRUSTED", "QUARANTINED", "HIDDEN", "REVOKED"
VISIBLE = (PROVISIONAL, TRUSTED)
TERMINAL = (QUARANTINED, REVOKED)
LEGAL_EDGES = (
    ("-", PROVISIONAL), ("-", TRUSTED), ("-", QUARANTINED),
    (PROVISIONAL, TRUSTED), (PROVISIONAL, QUARANTINED), (PROVISIONAL, HIDDEN),
    (HIDDEN, TRUSTED), (HIDDEN, QUARANTINED), (TRUSTED, REVOKED),
)
# (verify, sync, deadline) switches of the four admission policies.
POLICIES = {
    "B1": (False, False, False),
    "B2": (True, True, False),
    "B3": (True, False, False),
    "B4": (True, False, True),
}
DAY_US = 86_400_000_000
CELL = ["backlog", "baseline", "arm"]


def is_visible(state: Column) -> Column:
    return F.coalesce(state.isin(*VISIBLE), F.lit(False))


def fifo_queue(
    df: DataFrame,
    lanes: list[str],
    *,
    arrival: str = "arrival_us",
    service: str = "service_us",
    key: str = "item_id",
    chunk_us: int = DAY_US,
) -> DataFrame:
    """Single-server FIFO per lane: start = max(arrival, previous finish).

    Closed form: finish_i = S_i + max_{j<=i}(a_j - S_{j-1}) with S the running
    service.  Lanes are cut into time chunks, so a busy lane is many tasks: each
    chunk is solved as if it started idle and hands on (its total service, its
    idle-start finish); the finish before a chunk is the same closed form over
    those pairs.
    """
    c = df.withColumn("__chunk", time_chunk(arrival, chunk_us))
    ck = [*lanes, "__chunk"]
    w = W.partitionBy(*ck).orderBy(arrival, key).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.withColumn("__s", F.sum(service).over(w))
    c = c.withColumn("__local", F.col("__s") + F.max(F.col(arrival) - F.col("__s") + F.col(service)).over(w))
    chunks = c.groupBy(*ck).agg(F.sum(service).alias("__t"), F.max("__local").alias("__out"))
    across = W.partitionBy(*lanes).orderBy("__chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    chunks = chunks.withColumn("__bt", F.sum("__t").over(across))
    chunks = chunks.withColumn("__busy", F.col("__bt") + F.max(F.col("__out") - F.col("__bt")).over(across))
    before = F.lag("__busy").over(W.partitionBy(*lanes).orderBy("__chunk"))
    c = join_null_safe(c, chunks.select(*ck, before.alias("__before")), ck)
    commit = F.greatest(F.col("__local"), F.col("__before") + F.col("__s")).cast("bigint")
    out = c.withColumn("commit_us", commit).drop("__s", "__local", "__before", "__chunk")
    return out.withColumn("start_us", F.col("commit_us") - F.col(service))


def last_before(points: DataFrame, facts: DataFrame, lanes: list[str], value: str, t: str = "t_us", chunk_us: int = DAY_US) -> DataFrame:
    """As-of: for every point the largest `value` among facts of its lane with time <= t."""
    f = facts.select(*lanes, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    extra = [c for c in points.columns if c not in lanes]
    p = points.select(*lanes, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.struct(*extra).alias("__row"))
    both = f.unionByName(p, allowMissingColumns=True)
    got = running(both, lanes, time_chunk("__t", chunk_us), [F.col("__t"), F.col("__side")], maxes={value: F.col("__v")})
    return got.filter("__side = 1").select(*lanes, "__row.*", value)


def first_after(points: DataFrame, probes: DataFrame, lanes: list[str], name: str, t: str = "t_us", chunk_us: int = DAY_US) -> DataFrame:
    """As-of forward: for every point the earliest probe time >= t in its lane."""
    f = probes.select(*lanes, (-F.col(t)).alias("__t"), F.lit(0).alias("__side"), (-F.col(t)).alias("__v"))
    extra = [c for c in points.columns if c not in lanes]
    p = points.select(*lanes, (-F.col(t)).alias("__t"), F.lit(1).alias("__side"), F.struct(*extra).alias("__row"))
    both = f.unionByName(p, allowMissingColumns=True)
    got = running(both, lanes, time_chunk("__t", chunk_us), [F.col("__t"), F.col("__side")], maxes={"__n": F.col("__v")})
    return got.filter("__side = 1").select(*lanes, "__row.*", (-F.col("__n")).alias(name))


def policy_arms(arms) -> list[tuple[str, str]]:
    """(baseline, arm) of every cell; the unverified baseline needs a single arm."""
    return [(b, arm) for b, (verify, _, _) in POLICIES.items() for arm in (arms if verify else list(arms)[:1])]


def policy_cells(df: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """One row per (baseline, arm)."""
    cells = []
    for b, arm in policy_arms(arms):
        verify, sync, deadline = POLICIES[b]
        cells.append(
            F.struct(
                F.lit(b).alias("baseline"), F.lit(arm).alias("arm"), F.lit(verify).alias("verify"),
                F.lit(sync).alias("sync"), F.lit(deadline).alias("use_deadline"), arms[arm].alias("passes"),
            )
        )
    return df.withColumn("__c", F.explode(F.array(*cells))).select("*", "__c.*").drop("__c")


def admission_gate(df: DataFrame) -> DataFrame:
    """State right after admission: a bad source is quarantined and never visible."""
    state = (
        F.when(~F.col("source_ok"), QUARANTINED).when(F.col("sync"), F.lit(None).cast("string")).otherwise(PROVISIONAL)
    )
    return df.withColumn("admitted_state", state)


def ledger(df: DataFrame, tp_us: Column | int, hide_us: Column | None = None) -> DataFrame:
    """Adds `deadline_us` and `trans`, the ordered state transitions of each row.

    Needs arrival_us, source_ok, passes, commit_us, revoke_us and the policy
    switches.  A verdict promotes directly only if it commits by the deadline;
    `hide_us` delays the hiding itself (coupled enforcement).
    """
    tp = tp_us if isinstance(tp_us, Column) else F.lit(tp_us)
    df = df.withColumn("deadline_us", F.when(F.col("use_deadline") & F.col("source_ok"), F.col("arrival_us") + tp))
    ok, verified = F.col("source_ok"), F.col("source_ok") & F.col("verify")
    late = verified & F.coalesce(F.col("commit_us") > F.col("deadline_us"), F.lit(False))
    null = F.lit(None).cast("string")

    def edge(cond, t, old, new):
        return F.when(
            cond, F.struct(t.cast("bigint").alias("t_us"), old.alias("old_state"), new.alias("new_state"))
        )

    verdict_old = F.when(F.col("sync"), null).when(late, F.lit(HIDDEN)).otherwise(F.lit(PROVISIONAL))
    verdict_new = F.when(F.col("passes"), TRUSTED).otherwise(QUARANTINED)
    hide = F.col("deadline_us") if hide_us is None else hide_us
    settle = F.col("commit_us") if hide_us is None else F.when(late, F.greatest(F.col("commit_us"), hide)).otherwise(F.col("commit_us"))
    trans = F.array(
        edge(~ok, F.col("arrival_us"), null, F.lit(QUARANTINED)),
        edge(ok & ~F.col("sync"), F.col("arrival_us"), null, F.lit(PROVISIONAL)),
        edge(late, hide, F.lit(PROVISIONAL), F.lit(HIDDEN)),
        edge(verified, settle, verdict_old, verdict_new),
        edge(verified & F.col("passes") & (F.col("revoke_us") >= F.col("commit_us")), F.col("revoke_us"), F.lit(TRUSTED), F.lit(REVOKED)),
    )
    return df.withColumn("trans", F.filter(trans, lambda x: x.isNotNull()))


def to_log(led: DataFrame, keep: list[str]) -> DataFrame:
    """Ledger rows to one row per transition."""
    return led.select(*keep, F.posexplode("trans").alias("seq", "__x")).select(*keep, "seq", "__x.*")


def from_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """Transition log back to one row per item.

    Each edge is first reduced to its earliest time, so what is gathered per
    item is bounded by the number of state pairs.
    """
    edges = log.groupBy(*keys, "old_state", "new_state").agg(F.min("t_us").alias("t_us"), F.min("seq").alias("seq"))
    packed = edges.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("t_us", "seq", "old_state", "new_state"))).alias("trans")
    )
    return packed.withColumn("trans", F.transform("trans", lambda x: F.struct(x["t_us"], x["old_state"], x["new_state"])))


def upto(horizon: str = "horizon_us", trans: str = "trans") -> Column:
    return F.filter(trans, lambda x: x["t_us"] <= F.col(horizon))


def state_at(trans: Column, t: Column) -> Column:
    """State after the last transition at or before t."""
    return F.get(F.filter(trans, lambda x: x["t_us"] <= t), F.size(F.filter(trans, lambda x: x["t_us"] <= t)) - 1)["new_state"]


def spans(trans: str = "trans", horizon: str = "horizon_us") -> Column:
    """[start, end) of every state, the last one clipped at the horizon."""
    return F.transform(
        F.col(trans),
        lambda x, i: F.struct(
            x["t_us"].alias("start_us"),
            F.coalesce(F.get(F.col(trans), i + 1)["t_us"], F.col(horizon)).alias("end_us"),
            x["old_state"].alias("old_state"),
            x["new_state"].alias("state"),
            is_visible(x["new_state"]).alias("visible"),
        ),
    )


def with_facts(led: DataFrame, width: int = 5) -> DataFrame:
    """Per-item instants and totals used by every lifecycle metric (horizon applied).

    `width` is the number of transitions a row can have; `ledger` gives five at
    most. The places of the array are written out as SQL, so that all of this is
    compiled instead of interpreted lambda by lambda.
    """
    places = range(width)
    t, old, new = ([f"get(trans, {i}).{f}" for i in places] for f in ("t_us", "old_state", "new_state"))
    seen = lambda x: f"coalesce({x} IN ('{PROVISIONAL}', '{TRUSTED}'), false)"
    now = [seen(x) for x in new]
    leaves = [f"({seen(a)} AND NOT {b})" for a, b in zip(old, now)]
    enters = [f"(NOT {seen(a)} AND {b})" for a, b in zip(old, now)]
    is_new = lambda state: [f"{x} = '{state}'" for x in new]
    times = lambda conds: ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in zip(conds, t))
    first = lambda conds: f"least(CAST(NULL AS BIGINT), {times(conds)})"
    last = lambda conds: f"greatest(CAST(NULL AS BIGINT), {times(conds)})"
    # a place that is not there has null states and neither leaves nor enters
    number = lambda conds: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conds)
    ends = [f"coalesce({t[i + 1]}, horizon_us)" if i + 1 < width else "horizon_us" for i in places]
    visible = " + ".join(f"CASE WHEN {v} THEN {e} - {x} ELSE 0 END" for v, e, x in zip(now, ends, t))
    columns = {
        "state_end": "get(trans, size(trans) - 1).new_state",
        "first_visible_us": first(now),
        "visible_entries": number(enters),
        "contain_us": first(leaves),
        "last_withdraw_us": last(leaves),
        "withdrawals": number(leaves),
        "hide_at_us": first(is_new(HIDDEN)),
        "trusted_us": first(is_new(TRUSTED)),
        "quarantine_us": first(is_new(QUARANTINED)),
        "readmit_us": first([f"{c} AND {x} IS NOT NULL" for c, x in zip(enters, old)]),
        "prov_start_us": first(is_new(PROVISIONAL)),
        "prov_end_us": first([f"{x} = '{PROVISIONAL}'" for x in old]),
        "prov_entries": number(is_new(PROVISIONAL)),
        "visible_us": f"CAST({visible} AS BIGINT)",
    }
    d = led.withColumn("trans", upto()).withColumn("spans", spans())
    return d.selectExpr("*", *[f"{e} AS {n}" for n, e in columns.items()])


def visible_since(since: str, width: int = 5) -> Column:
    """How long a row is visible from the column `since` on, after `with_facts`; its places are written out in the same way."""
    parts = []
    for i in range(width):
        t = f"get(trans, {i}).t_us"
        end = f"coalesce(get(trans, {i + 1}).t_us, horizon_us)" if i + 1 < width else "horizon_us"
        parts.append(f"CASE WHEN get(trans, {i}).new_state IN ('{PROVISIONAL}', '{TRUSTED}') THEN greatest(0, {end} - greatest({t}, {since})) ELSE 0 END")
    return F.expr(f"CAST({' + '.join(parts)} AS BIGINT)")


def visible_at(t: Column) -> Column:
    """Visible at time t, from facts: a legal trajectory has at most two visible stretches."""
    first = (F.col("first_visible_us") <= t) & (F.col("contain_us").isNull() | (t < F.col("contain_us")))
    again = (F.col("readmit_us") <= t) & ((F.col("last_withdraw_us") <= F.col("readmit_us")) | (t < F.col("last_withdraw_us")))
    return F.coalesce(first, F.lit(False)) | F.coalesce(again, F.lit(False))


def queue_depth(df: DataFrame, lanes: list[str], *, enter: str = "arrival_us", start: str = "start_us", key: str = "item_id", chunk_us: int = DAY_US) -> DataFrame:
    """Number of other items waiting when an item enters the queue and when it starts."""
    moves = F.array(
        F.struct(F.col(enter).alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.col(start).alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("step")),
    )
    ev = df.select(*lanes, key, F.explode(moves).alias("m")).select(*lanes, key, "m.*")
    run = running(ev, lanes, time_chunk("t", chunk_us), [F.col("t"), F.col("kind"), F.col(key)], sums={"waiting": F.col("step")})
    return run.groupBy(*lanes, key).agg(
        F.max(F.when(F.col("kind") == 0, F.col("waiting") - 1)).alias("depth_at_enqueue"),
        F.max(F.when(F.col("kind") == 1, F.col("waiting"))).alias("depth_at_start"),
    )


def transition_violations(log: DataFrame, keys: list[str], chunk_us: int = DAY_US) -> DataFrame:
    """One row per broken rule: illegal edge, broken chain, repeated provisional entry.

    log: keys, event_id (order among equal times), t_us, old_state, new_state.
    """
    order = F.struct("t_us", "event_id")
    seq = neighbours(log, keys, time_chunk("t_us", chunk_us), order, prev={"prev_new": "new_state"})
    prov = running(
        seq, keys, time_chunk("t_us", chunk_us), [F.col("t_us"), F.col("event_id")],
        sums={"provs": (F.col("new_state") == PROVISIONAL).cast("int")},
    )
    edge = F.concat_ws(">", F.coalesce("old_state", F.lit("-")), "new_state")
    legal = edge.isin(*[f"{a}>{b}" for a, b in LEGAL_EDGES])
    rules = F.array(
        F.when(~legal, F.lit("illegal_edge")),
        F.when(~F.col("old_state").eqNullSafe(F.col("prev_new")), F.lit("broken_chain")),
        F.when((F.col("new_state") == PROVISIONAL) & (F.col("provs") > 1), F.lit("provisional_again")),
    )
    return prov.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull()))).select(
        *keys, "event_id", "t_us", edge.alias("edge"), "rule"
    )


def visible_during(probes: DataFrame, led: DataFrame, keys: list[str]) -> DataFrame:
    """Per probe row: was the item visible at some instant of [q_start_us, q_end_us]?

    The item's spans travel as one bounded array, so this is a plain equi-join.
    """
    spans_of = led.withColumn("spans", spans()).select(*keys, "spans")
    hit = F.exists(
        "spans", lambda s: s["visible"] & (s["start_us"] <= F.col("q_end_us")) & (s["end_us"] > F.col("q_start_us"))
    )
    return probes.join(spans_of, keys, "left").withColumn("was_visible", F.coalesce(hit, F.lit(False))).drop("spans")


def episodes(facts: DataFrame, keep: list[str]) -> DataFrame:
    """Withdrawal and quarantine episodes, paired with the first later return to visibility."""
    later = lambda i: F.filter(
        F.slice("spans", i + 1, F.greatest(F.size("spans") - i, F.lit(1))), lambda s: s["visible"]
    )

    def of(kind, starts):
        return F.filter(
            F.transform(
                "spans",
                lambda s, i: F.when(
                    starts(s),
                    F.struct(F.lit(kind).alias("kind"), s["start_us"].alias("start_us"), F.get(later(i), 0)["start_us"].alias("end_us")),
                ),
            ),
            lambda e: e.isNotNull(),
        )

    withdraw = of("withdrawal", lambda s: is_visible(s["old_state"]) & ~s["visible"])
    quarantine = of("quarantine", lambda s: s["state"] == QUARANTINED)
    out = facts.select(*keep, "horizon_us", F.explode(F.concat(withdraw, quarantine)).alias("e")).select(*keep, "horizon_us", "e.*")
    return out.withColumn("done_us", F.col("end_us") - F.col("start_us")).withColumn(
        "open_us", F.when(F.col("end_us").isNull(), F.greatest(F.col("horizon_us") - F.col("start_us"), F.lit(0)))
    )


def unvetted_status() -> Column:
    return (
        F.when(F.col("prov_start_us").isNull(), "NOT_STARTED")
        .when(F.col("prov_end_us").isNotNull(), "COMPLETED")
        .otherwise("RIGHT_CENSORED")
    )


def unvetted_us() -> Column:
    return F.coalesce(F.col("prov_end_us"), F.col("horizon_us")) - F.col("prov_start_us")


def statuses() -> dict[str, Column]:
    """The four episode statuses of an item at the horizon."""
    vis = is_visible(F.col("state_end"))
    unavailable = F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us")
    return {
        "exposure_status": F.when(F.col("first_visible_us").isNull(), "NOT_STARTED").when(vis, "RIGHT_CENSORED").otherwise("COMPLETED"),
        "unvetted_status": unvetted_status(),
        "unavailable_status": F.when(~vis, "RIGHT_CENSORED").when(unavailable > 0, "COMPLETED").otherwise("NOT_STARTED"),
        "quarantine_status": F.when(F.col("state_end") == QUARANTINED, "RIGHT_CENSORED")
        .when(F.col("quarantine_us").isNotNull(), "COMPLETED")
        .otherwise("NOT_STARTED"),
    }


def lifecycle_record(facts: DataFrame, keep: list[str]) -> DataFrame:
    vis = is_visible(F.col("state_end"))
    return facts.select(
        *keep,
        "role",
        F.col("state_end").alias("state_at_horizon"),
        F.col("first_visible_us").isNotNull().alias("ever_visible"),
        vis.alias("visible_at_horizon"),
        (F.col("first_visible_us") - F.col("arrival_us")).alias("first_visible_delay_us"),
        F.greatest(F.col("visible_entries") - 1, F.lit(0)).alias("readmissions"),
        F.col("visible_us").alias("restricted_visible_us"),
        (F.col("horizon_us") - F.col("arrival_us") - F.col("visible_us")).alias("restricted_unavailable_us"),
        *[c.alias(n) for n, c in statuses().items()],
    )


def hidden_grid_points(step_us: int, window_us: int) -> Column:
    """Probes arrival + i*step in [0, window] that fall into the hidden gap [deadline, commit).

    An item that never returns stays hidden to the end of the window.
    """
    n = F.lit(window_us // step_us + 1)
    from_us = F.least(F.ceil((F.col("deadline_us") - F.col("arrival_us")) / step_us), n)
    back = F.when(F.col("passes"), F.least(F.ceil((F.col("commit_us") - F.col("arrival_us")) / step_us), n)).otherwise(n)
    return back - from_us


def max_in_flight(df: DataFrame, keys: list[str], start: str, end: str, chunk_us: int = DAY_US) -> DataFrame:
    """Largest number of intervals open at once, by a running sum of +1/-1 steps."""
    steps = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("s")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("s")))
    ev = df.filter(F.col(end).isNotNull()).select(*keys, F.explode(steps).alias("e")).select(*keys, "e.*")
    net = ev.groupBy(*keys, "t").agg(F.sum("s").alias("s"))
    run = running(net, keys, time_chunk("t", chunk_us), [F.col("t")], sums={"open": F.col("s")})
    return run.groupBy(*keys).agg(F.max("open").alias("max_in_flight"))


def edge_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys, "old_state", "new_state").agg(F.count(F.lit(1)).alias("n"))


