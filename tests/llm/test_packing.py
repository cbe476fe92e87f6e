import random

from vislens.llm import packing


def slow(lengths, sources, clusters, capacity):
    """The tightest compatible bin by a scan of all; the oldest of equals."""
    bins, where, starts = [], [], []
    for n, s, c in zip(lengths, sources, clusters):
        fit = [(b["rest"], k) for k, b in enumerate(bins) if b["rest"] >= n and s not in b["s"] and c not in b["c"]]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"rest": capacity, "s": set(), "c": set()})
        starts.append(capacity - bins[k]["rest"])
        bins[k]["rest"] -= n
        bins[k]["s"] |= {s} - {-1}
        bins[k]["c"] |= {c} - {-1}
        where.append(k)
    return where, starts


def test_best_fit_equals_a_scan():
    rng = random.Random(4)
    for _ in range(60):
        n, capacity = rng.randint(1, 120), rng.choice([10, 50])
        lengths = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=rng.random() < 0.7)
        sources = [rng.choice([-1, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([-1, -1, -1, 0, 1]) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, capacity) == slow(lengths, sources, clusters, capacity)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, size bigint, source string, cluster bigint, shard string, id string, piece string")


def check(rows, got, capacity):
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    bins = {}
    for d, size, source, cluster, *_ in rows:
        parts = sorted(by_id[d], key=lambda r: r.piece or 0)
        assert sum(r.length for r in parts) == max(0, size or 0)
        if not size or size < 0:
            assert [(r.piece, r.bin_id, r.bin_start) for r in parts] == [(None, None, None)]
            continue
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [capacity * k for k in range(len(parts))]
        for r in parts:
            bins.setdefault(r.bin_id, []).append((r.bin_start, r.length, source, cluster))
    for parts in bins.values():
        parts.sort()
        at = 0
        for start, n, *_ in parts:
            assert start == at
            at += n
        assert at <= capacity
        for k in (2, 3):
            named = [p[k] for p in parts if p[k] is not None]
            assert len(named) == len(set(named))
    return bins


def test_packing_keeps_every_rule(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0, -3, rng.randint(1, 100), rng.randint(1, 100), 100, 200, 350, 1234]), rng.choice([None, "a", "a", "b", "c", "d"]), rng.choice([None, i, 1, 2]), "x", "y", "z") for i in range(400)]
    got = packing.pack(frame(spark, rows), "size", 100).collect()
    check(rows, got, 100)
    several = packing.pack(frame(spark, rows), "size", 100, shard=2000).collect()
    bins = check(rows, several, 100)
    assert len({b >> 32 for b in bins if b >= 0}) > 3
    shared = lambda rows: {(r.doc_id, r.piece, r.bin_id, r.bin_start) for r in rows if r.bin_id is not None and r.bin_id >= 0}
    assert shared(got) == shared(packing.pack(frame(spark, rows).repartition(7), "size", 100).collect())


def test_packing_is_the_scan_within_a_shard(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 99), rng.choice("abcdefgh"), rng.choice([None, 1, 2]), "x", "y", "z") for i in range(200)]
    got = {r.doc_id: (r.bin_id, r.bin_start) for r in packing.pack(frame(spark, rows), "size", 100).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    code = {None: -1}
    c = [code.setdefault(r[3], len(code)) for r in order]
    where, starts = slow([r[1] for r in order], [r[2] for r in order], c, 100)
    assert [got[r[0]] for r in order] == list(zip(where, starts))


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(None, 10, "a", None, "x", "y", "z"), (None, 10, "a", None, "x", "y", "z"), (1, 10, "a", 5, "x", "y", "z"), (1, 10, "b", 5, "x", "y", "z")]
    got = packing.pack(frame(spark, rows), "size", 100).collect()
    assert len(got) == 4 and len({r.bin_id for r in got}) >= 3
    assert packing.pack(frame(spark, []), "size", 100).count() == 0


def test_rows_alike_in_every_column_are_spread_over_shards(spark):
    got = packing.pack(frame(spark, [(None, 10, "a", 5, "x", "y", "z")] * 2000), "size", 100, shard=1000).collect()
    per = {}
    for r in got:
        per[r.bin_id >> 32] = per.get(r.bin_id >> 32, 0) + 1
    assert len(per) > 12 and max(per.values()) < 300 and len({r.bin_id for r in got}) == 2000
