"""Event-time lifecycle as a keyed state machine with deadline timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vislens.operators.lifecycle import HIDDEN, POLICIES, PROVISIONAL, QUARANTINED, REVOKED, TRUSTED

#: Admitted by its verdict only, which is still to come.
PENDING = "PENDING"
#: States by number; 0 is an item that is not admitted.
NAMES = (None, PROVISIONAL, HIDDEN, PENDING, TRUSTED, QUARANTINED, REVOKED)
_P, _H, _W, _T, _Q, _R = range(1, len(NAMES))
KINDS = ("admit", "verdict", "revoke")
#: Groups that the items are dealt over; those without an id are a group of their own.
GROUPS, NO_ID = 1024, -1
#: A time that is not known, and one that never comes.
NONE, NEVER = np.iinfo("i8").min, np.iinfo("i8").max
ITEM = np.dtype([("item", "i8"), ("deadline", "i8"), ("verdict", "i8"), ("revoke", "i8"), ("state", "i1"), ("passes", "?")])
ROW = np.dtype([("item", "i8"), ("t", "i8"), ("kind", "i1"), ("source_ok", "?"), ("passes", "?")])
_STATE = "items binary, timer_ms long"
_OUTPUT = "grp int, item_id long, t_us long, old_state int, new_state int"


def first_rows(rows: np.ndarray) -> np.ndarray:
    """Of each item and kind the row of the smallest time; rows without a time come last."""
    rows = rows[np.lexsort((rows["t"], rows["t"] == NONE, rows["kind"], rows["item"]))]
    return rows[np.r_[True, (rows["item"][1:] != rows["item"][:-1]) | (rows["kind"][1:] != rows["kind"][:-1])]] if len(rows) else rows


class LifecycleProcessor(StatefulProcessor):
    """admit / verdict / revoke rows of a group of items to their transitions.

    A call of the state server takes about a millisecond, so the state is that of
    all items of a group, one array that is read and written once a batch, and a
    group has one timer, for the first item that is due.

    A timer and a late verdict can reach the item in either order, so the verdict
    compares its commit time with the stored deadline and itself emits the hide
    that must come first.  Rows that overtake the admission wait in the state.

    An item that is quarantined or revoked can never change again: once the
    watermark has passed `keep_us` after that, it leaves the state, and so do
    rows that have waited for an admission as long. A trusted item keeps its
    state, since it may be revoked at any time.

    `policy` is one of the admission policies of the batch ledger: without
    verification verdicts are ignored, with sync an item is admitted by its
    verdict alone, and only with a deadline is it hidden meanwhile.
    """

    def __init__(self, tp_us: int, policy: str = "B4", keep_us: int = 3_600_000_000):
        self.tp_us, self.keep_us = tp_us, keep_us
        self.verify, self.sync, self.deadline = POLICIES[policy]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", _STATE)

    def _load(self) -> tuple[np.ndarray, int | None]:
        got = self.group.get()
        return (np.zeros(0, ITEM), None) if got is None else (np.frombuffer(bytes(got[0]), ITEM).copy(), got[1])

    def _keep(self, s: np.ndarray, timer: int | None) -> None:
        """Stores the items with the timer that they need."""
        due = self._due(s).min(initial=NEVER)
        due = None if due == NEVER else int(due)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if len(s):
            self.group.update((s.tobytes(), due))
        else:
            self.group.clear()

    def _forgets(self, s: np.ndarray) -> np.ndarray:
        return np.isin(s["state"], (0, _Q, _R))

    def _due(self, s: np.ndarray) -> np.ndarray:
        """Milliseconds at which an item is hidden, or at which it is forgotten."""
        last = np.maximum(np.maximum(s["deadline"], s["verdict"]), np.maximum(s["revoke"], 0))
        at = np.where(self._forgets(s), last + self.keep_us, s["deadline"])
        waits = self._forgets(s) | ((s["state"] == _P) & (s["deadline"] != NONE))
        return np.where(waits, -(-at // 1000), NEVER)

    def _apply(self, s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list]:
        """The items after the first rows of each kind, and their transitions (items, times, old, new)."""
        out = []

        def turn(which: np.ndarray, t: np.ndarray, new) -> None:
            new = np.broadcast_to(np.asarray(new, "i1"), which.shape)
            out.append((now["item"][which], t, now["state"][which], new))
            now["state"][which] = new

        ids = np.union1d(s["item"], rows["item"])
        now = np.zeros(len(ids), ITEM)
        now["item"] = ids
        for name in ("deadline", "verdict", "revoke"):
            now[name] = NONE
        now[np.searchsorted(ids, s["item"])] = s
        admits, verdicts, revokes = (rows[rows["kind"] == k] for k in range(len(KINDS)))
        if self.verify:
            at = np.searchsorted(ids, verdicts["item"])
            open_ = now["verdict"][at] == NONE
            now["verdict"][at[open_]], now["passes"][at[open_]] = verdicts["t"][open_], verdicts["passes"][open_]
        at = np.searchsorted(ids, revokes["item"])
        open_ = now["revoke"][at] == NONE
        now["revoke"][at[open_]] = revokes["t"][open_]

        at = np.searchsorted(ids, admits["item"])
        open_ = now["state"][at] == 0
        at, t, ok = at[open_], admits["t"][open_], admits["source_ok"][open_]
        now["deadline"][at[~ok]] = t[~ok]
        turn(at[~ok], t[~ok], _Q)
        if self.sync:
            now["state"][at[ok]] = _W
        else:
            if self.deadline:
                now["deadline"][at[ok]] = np.where(t[ok] == NONE, NONE, t[ok] + self.tp_us)
            turn(at[ok], t[ok], _P)

        known = now["verdict"] != NONE
        late = np.flatnonzero(known & (now["state"] == _P) & (now["deadline"] != NONE) & (now["verdict"] > now["deadline"]))
        turn(late, now["deadline"][late], _H)
        judged = np.flatnonzero(known & np.isin(now["state"], (_P, _H, _W)))
        now["state"][judged[now["state"][judged] == _W]] = 0
        turn(judged, now["verdict"][judged], np.where(now["passes"][judged], _T, _Q))
        gone = np.flatnonzero((now["state"] == _T) & (now["revoke"] != NONE) & (now["revoke"] >= now["verdict"]))
        turn(gone, now["revoke"][gone], _R)
        return now, out

    def _told(self, key, out: list) -> Iterator[pd.DataFrame]:
        item, t, old, new = (np.concatenate(c) for c in zip(*out))
        if not len(item):
            return iter([])
        return iter([pd.DataFrame({"grp": np.full(len(item), key[0], "i4"), "item_id": item, "t_us": t, "old_state": old.astype("i4"), "new_state": new.astype("i4")})])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, fresh = np.zeros(0, ROW), []
        for chunk in rows:
            r = np.empty(len(chunk), ROW)
            for name in ROW.names:
                r[name] = chunk[name].to_numpy()
            fresh.append(r)
            if sum(map(len, fresh)) > max(len(first), 100_000):
                first, fresh = first_rows(np.concatenate([first, *fresh])), []
        s, timer = self._load()
        s, out = self._apply(s, first_rows(np.concatenate([first, *fresh])))
        self._keep(s, timer)
        return self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, _ = self._load()
        due = self._due(s)
        due = (due < timerValues.getCurrentWatermarkInMs()) | (due <= expiredTimerInfo.getExpiryTimeInMs())
        hidden = np.flatnonzero(due & (s["state"] == _P))
        out = [(s["item"][hidden], s["deadline"][hidden], s["state"][hidden], np.full(len(hidden), _H, "i1"))]
        s["state"][hidden] = _H
        self._keep(s[~(due & self._forgets(s))], None)
        return self._told(key, out)

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, tp_us: int, lateness: str = "1 hour", policy: str = "B4") -> DataFrame:
    """events: item_id, ts, t_us, kind (admit|verdict|revoke), source_ok, passes.  Transitions: item_id, t_us, old_state, new_state."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    group = F.when(F.col("item_id").isNotNull(), F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(GROUPS)).cast("int")).otherwise(NO_ID)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kind = F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))))).cast("int")
    rows = events.withWatermark("ts", lateness).select(
        group.alias("grp"), "ts", F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item"), F.coalesce(F.col("t_us").cast("long"), F.lit(int(NONE))).alias("t"),
        kind.alias("kind"), flag("source_ok"), flag("passes"),
    )
    out = rows.groupBy("grp").transformWithStateInPandas(LifecycleProcessor(tp_us, policy), _OUTPUT, "Append", "EventTime")
    name = lambda c: F.get(F.array(*map(F.lit, NAMES)), F.col(c)).alias(c)
    return out.select(
        F.when(F.col("grp") != NO_ID, F.col("item_id")).alias("item_id"), F.when(F.col("t_us") != int(NONE), F.col("t_us")).alias("t_us"), name("old_state"), name("new_state")
    )
