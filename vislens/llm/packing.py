"""Best-fit packing of documents into sequences under conflicts.

Two documents conflict if they have the same source or belong to the same
cluster of copies. Documents longer than a sequence are cut: full pieces fill
sequences of their own, the rest is packed. Rests are dealt by hash into shards
of bounded total length, so no task grows with the corpus, and each shard is
packed by best-fit decreasing: open bins are ordered by what is left in them and
carry a bitmap of their sources and one of their clusters; the search starts at
the bins that the piece fills exactly and goes on to the next larger rest until a
bin is compatible. Bins of one rest and one pair of bitmaps are tested once.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislens.llm.rows import placed
from vislens.session import cut_lineage

#: Units of length in a shard: some thousand documents of usual size.
SHARD = 16 << 20


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, packed in the order given; sources and clusters are small bit numbers or -1."""
    bins: list[int] = []
    starts: list[int] = []
    rests: list[int] = []  # sorted rests that open bins have
    open_: dict[int, dict[tuple[int, int], list[int]]] = {}  # rest -> bitmaps -> bins, the oldest last
    n = 0
    for length, s, c in zip(lengths, sources, clusters):
        own = (1 << s if s >= 0 else 0, 1 << c if c >= 0 else 0)
        at = bisect_left(rests, length)
        hit = None
        while at < len(rests) and hit is None:
            rest = rests[at]
            for maps, found in open_[rest].items():
                if not (maps[0] & own[0] or maps[1] & own[1]) and (hit is None or found[-1] < hit[2][-1]):
                    hit = (rest, maps, found)
            at += 1
        if hit is None:
            rest, maps, number = capacity, (0, 0), n
            n += 1
        else:
            rest, maps, found = hit
            number = found.pop()
            if not found:
                del open_[rest][maps]
                if not open_[rest]:
                    del open_[rest]
                    del rests[bisect_left(rests, rest)]
        bins.append(number)
        starts.append(capacity - rest)
        left = rest - length
        if left:
            if left not in open_:
                open_[left] = {}
                insort(rests, left)
            group = open_[left].setdefault((maps[0] | own[0], maps[1] | own[1]), [])
            insort(group, number, key=lambda x: -x)
    return bins, starts


def _numbers(values: list, shared_only: bool) -> list[int]:
    """A bit number per value, -1 for null and, if asked, for a value that occurs once and so conflicts with nothing."""
    seen = Counter(values)
    bit = {v: i for i, v in enumerate(v for v, n in seen.items() if v is not None and (n > 1 or not shared_only))}
    return [bit.get(v, -1) for v in values]


def pack(
    docs: DataFrame,
    length_col: str,
    capacity: int,
    id_col: str = "doc_id",
    source_col: str = "source",
    cluster_col: str = "cluster",
    shard: int = SHARD,
) -> DataFrame:
    """(id_col, piece, start, length, bin_id, bin_start): where each piece of each row goes.

    Pieces are numbered from 0 and cover [0, length) of the row in order. bin_id
    names a sequence; bin_start is the piece's place in it. Bins of full pieces
    are negative. Rows without length (null, zero or less) take no place: piece,
    bin_id and bin_start are null, length is 0. A null source or cluster
    conflicts with nothing. Rows that repeat an id are rows like any other; they
    conflict through their source and cluster. Equal lengths are packed in order
    of id, cluster and piece. Rows are dealt to shards by where they lie in a
    table written first, so a shard stays bounded whatever repeats. Other columns
    are not read; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(length_col).cast("bigint"), F.lit(0))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"), F.greatest(size, F.lit(0)).alias("size"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster")
        )
    )
    full = F.floor(F.col("size") / capacity).cast("bigint")
    rest = F.col("size") % capacity
    total = rows.agg(F.sum(rest)).first()[0] or 0
    shards = max(1, math.ceil(total / shard))

    none = rows.filter("size = 0").select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("piece", "bigint"), ("start", "bigint"))], F.lit(0).cast("bigint").alias("length"), *[F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_start")])
    whole = rows.filter(full > 0).select("id", F.posexplode(F.sequence(F.lit(1), full)).alias("piece", "_"))
    # a bin of its own: numbered below zero by where the row lies
    whole = whole.select(
        "id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("length"),
        (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("bigint").alias("bin_start"),
    )
    # by the row's place in the written table: rows alike in every column are spread over the shards like any others
    rests = placed(rows).filter(rest > 0).select("id", full.alias("piece"), (full * capacity).alias("start"), rest.alias("length"), "source", "cluster", F.pmod("__place", F.lit(shards)).alias("shard"))

    def run(key, group):
        ids, sizes, names, copies, pieces = (group.column(c).to_pylist() for c in ("id", "length", "source", "cluster", "piece"))
        order = sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i] is not None, ids[i] if ids[i] is not None else 0, copies[i] or "", pieces[i]))
        pick = lambda values: [values[i] for i in order]
        bins, starts = best_fit(pick(sizes), _numbers(pick(names), False), _numbers(pick(copies), True), capacity)
        out = group.select(["id", "piece", "start", "length"]).take(pa.array(order))
        out = out.append_column("bin_id", pa.array([b + (key[0].as_py() << 32) for b in bins], pa.int64()))
        return out.append_column("bin_start", pa.array(starts, pa.int64()))

    packed = rests.groupBy("shard").applyInArrow(run, f"id {kind}, piece bigint, start bigint, length bigint, bin_id bigint, bin_start bigint")
    return none.unionByName(whole).unionByName(packed).withColumnRenamed("id", id_col)
