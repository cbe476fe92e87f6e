"""Query log against the visibility ledger: returned lists and the metrics built on them.

The lists of a query change only when one of its candidates is inserted, shown or
withdrawn. So a query's candidates are turned into such events, one sweep in time
keeps the ranked lists, and each probe takes the lists of its instant: the work is
events plus probes, not their product. Probes of a busy query are dealt over blocks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislens.functions.stats import count_if, ratio

#: Probes of one query that are swept together.
BLOCK_PROBES = 8192
INSTANTS = ("first_visible_us", "contain_us", "readmit_us", "last_withdraw_us")
#: Sorts of events: an item joins the raw pool, is shown, is withdrawn.
INSERT, SHOW, WITHDRAW = range(3)


def item_events(items: list[tuple]) -> list[tuple[int, int, int]]:
    """(instant, sort, place) of items in rank order, each given by its four instants: at most two visible stretches."""
    out = []
    for place, (first, contain, readmit, last) in enumerate(items):
        if first is None:
            continue
        out += [(first, INSERT, place), (first, SHOW, place)]
        if contain is not None:
            out.append((max(first, contain), WITHDRAW, place))
        if readmit is not None and last is not None:
            out.append((max(first, readmit), SHOW, place))
            if last > readmit:
                out.append((max(first, last), WITHDRAW, place))
    return sorted(out)


def sweep(events: list[tuple[int, int, int]], poison: list[bool], times: list[int], k: int, raw_k: int) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """(number of times served, returned, eligible, poison-free) as places, for ascending times; the lists hold at that many times in a row."""
    raw: list[int] = []
    shown: list[int] = []
    clean: list[int] = []
    times_shown = [0] * len(poison)  # stretches may touch or overlap

    def lists():
        top = shown[:k]
        return [i for i in top if len(raw) < raw_k or i <= raw[-1]], top, clean[:k]

    at, served, now = 0, 0, lists()
    for t in times:
        moved = False
        while at < len(events) and events[at][0] <= t:
            _, sort, i = events[at]
            at += 1
            moved = True
            if sort == INSERT:
                insort(raw, i)
                del raw[raw_k:]
                continue
            before = times_shown[i]
            times_shown[i] += 1 if sort == SHOW else -1
            if (before > 0) != (times_shown[i] > 0):
                for rows in (shown, clean) if not poison[i] else (shown,):
                    if before:
                        del rows[bisect_left(rows, i)]
                    else:
                        insort(rows, i)
        if moved:
            new = lists()
            if new != now:
                if served:
                    yield served, *now
                served, now = 0, new
        served += 1
    if served:
        yield served, *now


def probe_results(
    probes: DataFrame, candidates: DataFrame, facts: DataFrame, cell: list[str], cells: list[tuple], k: int, over_fetch: int, block_probes: int = BLOCK_PROBES
) -> DataFrame:
    """Per (cell, probe): post-filtered, eligible and poison-free top-k lists.

    probes: probe, t_us, query_id, role.  candidates: query_id, id, score, static
    (every item that can reach a top k*over_fetch).  facts: cell, item_id, poison,
    landed and the visibility instants.  `cells` lists the policy cells, a handful
    of settings.  The raw pool holds everything already inserted, whatever its
    current state.  A probe without any list to show has no row.
    """
    kinds = {c: facts.schema[c].dataType.simpleString() for c in cell}
    id_kind = candidates.schema["id"].dataType.simpleString()
    cols = ["query_id", "id", "score", *cell, "poison", "landed", *INSTANTS]
    moving = candidates.filter(~F.col("static")).join(facts.select(*cell, F.col("item_id").alias("id"), "poison", "landed", *INSTANTS), "id").select(cols)
    # without a cell: a static item is in all of them, from the beginning
    nothing = {**{c: F.lit(None).cast(t) for c, t in kinds.items()}, **{c: F.lit(None).cast("bigint") for c in INSTANTS[1:]}}
    fixed = candidates.filter("static").withColumns({**nothing, "poison": F.lit(False), "landed": F.lit(False), INSTANTS[0]: F.lit(0).cast("bigint")})
    blocks = probes.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / block_probes).cast("int").alias("blocks"))
    pool = fixed.select(cols).unionByName(moving).join(blocks, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = probes.join(blocks, "query_id").withColumn("block", F.pmod(F.xxhash64("probe"), F.col("blocks")).cast("int")).select("query_id", "block", "probe", "t_us", "role")

    lists = {c: f"array<{id_kind}>" for c in ("returned", "eligible", "poisonfree")}
    shape = {**kinds, **{c: asked.schema[c].dataType.simpleString() for c in ("probe", "t_us", "query_id", "role")}, **lists, "n_poison": "bigint", "n_landed": "bigint"}

    def run(key, asked: pa.Table, pool: pa.Table) -> pa.Table:
        asked = asked.sort_by("t_us")
        times = asked["t_us"].to_pylist()
        pool = pool.sort_by([("score", "descending"), ("id", "ascending")])
        rows = list(zip(*(pool[c].to_pylist() for c in ("poison", "landed", *INSTANTS))))
        owner = list(zip(*(pool[c].to_pylist() for c in cell)))
        places: dict[tuple, list[int]] = {c: [] for c in cells}
        for r, o in enumerate(owner):
            for held in places.values() if o[0] is None else [places[o]] if o in places else []:
                held.append(r)
        parts = []
        for c, held in places.items():
            own = [rows[r] for r in held]
            found = list(sweep(item_events([x[2:] for x in own]), [x[0] for x in own], times, k, k * over_fetch))
            if not found:
                continue
            turn = np.repeat(np.arange(len(found)), [f[0] for f in found])
            some = np.array([bool(f[2] or f[3]) for f in found])[turn]
            part, turn = asked.filter(pa.array(some)), pa.array(turn[some])
            columns = {n: pa.array([v] * len(turn), asked["role"].type) for n, v in zip(cell, c)}
            columns |= {n: part[n] for n in ("probe", "t_us", "query_id", "role")}
            for n, which in (("returned", 1), ("eligible", 2), ("poisonfree", 3)):
                ends = np.cumsum([0, *(len(f[which]) for f in found)])
                ids = pool["id"].combine_chunks().take(pa.array([held[i] for f in found for i in f[which]], pa.int64()))
                columns[n] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids).take(turn)
            bad = [[own[i] for i in f[1] if own[i][0]] for f in found]
            columns["n_poison"] = pa.array([len(b) for b in bad], pa.int64()).take(turn)
            columns["n_landed"] = pa.array([sum(x[1] for x in b) for b in bad], pa.int64()).take(turn)
            parts.append(pa.table({n: columns[n] for n in shape}))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in empty.items()})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    empty = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(", ".join(f"{n} {t}" for n, t in shape.items())).fields}
    out = asked.groupBy("query_id", "block").cogroup(pool.groupBy("query_id", "block")).applyInArrow(run, ", ".join(f"{n} {t}" for n, t in shape.items()))
    return out.withColumns(
        {
            "hit": F.col("n_poison") > 0,
            "hit_landed": F.col("n_landed") > 0,
            "recall": ratio(F.size(F.array_intersect("returned", "eligible")), F.size("eligible")),
            "displacement": ratio(F.size(F.array_except("poisonfree", "returned")), F.size("poisonfree")),
        }
    )


def poisoned_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.col("hit")
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), count_if(hit).alias("np"), (count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("prr"),
        F.min(F.when(hit, F.col("t_us"))).alias("obs_first_us"), F.max(F.when(hit, F.col("t_us"))).alias("obs_last_us"),
    )


def prr_series(log: DataFrame, keys: list[str], origin: Column, width_us: int) -> DataFrame:
    b = F.floor((F.col("t_us") - origin) / F.lit(width_us)).alias("bin")
    return log.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("hit")).alias("hits"))


def rebin(series: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Pool hits and counts of `factor` neighbouring bins (rates are weighted by their counts)."""
    g = series.groupBy(*keys, F.floor(F.col("bin") / factor).alias("bin")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return g.withColumn("rate", ratio(F.col("hits"), F.col("n")))
