import numpy as np

from vislens.llm import vector_dedup as vd

SCHEMA = "vec_id bigint, embedding array<float>, label int, class string, v string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z") for i, v in rows], SCHEMA)


def slow(rows, cosine):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        u = np.array(v, np.float32).astype(float) if ok else None
        unit.append(u / np.linalg.norm(u) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(link[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def cloud(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + 0.45 * rng.normal(size=(n, d))
    x[::5] = x[rng.integers(0, n, len(x[::5]))] + 0.05 * rng.normal(size=(len(x[::5]), d))
    x[::11] = x[3]
    return [(1000 - i, v * rng.uniform(0.1, 9)) for i, v in enumerate(x)]


def test_groups_equal_brute_force_for_any_cells_and_tiles(spark):
    for seed, cell, tile in ((1, 4096, 2048), (2, 40, 16), (3, 10, 7)):
        rows = cloud(seed)
        want = slow(rows, 0.9)
        assert got(vd.vector_groups(frame(spark, rows), cosine=0.9, cell=cell, tile=tile)) == want
        assert 0 < sum(w[1] > 0 for w in want) < len(rows)


def test_no_link_is_lost_between_cells():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x = np.concatenate([x, x + 0.2 * rng.normal(size=x.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in (1, 2, 9, 30):
        c = vd.spherical_kmeans(x, k)
        row, cell, home = vd.places(x, c, 0.9)
        where = {}
        for r, p, h in zip(row, cell, home):
            where.setdefault(r, {})[p] = h
        u, v = np.nonzero(x @ x.T >= 0.9)
        for a, b in zip(u, v):
            if a < b:
                meet = [p for p in where[a] if p in where[b] and (where[a][p] or where[b][p])]
                assert len(meet) == 1 and (where[a][meet[0]] or where[b][meet[0]])
        assert np.bincount(row[home], minlength=len(x)).tolist() == [1] * len(x)


def test_odd_vectors_null_ids_repeats_and_dimensions(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0, 0]), (4, [1.0, None, 3.0]), (5, [float("nan"), 1, 1]), (6, [float("inf"), 1, 1]), (7, e), (7, e), (8, [2.0, 4, 6]), (9, [1.0, 2.0]), (10, [1e-30, 2e-30, 3e-30]), (11, [1e30, 2e30, 3e30]), (None, e), (None, [-1.0, 0, 0]), (12, [-0.0, 0.0, 1.0]), (13, [0.0, 0.0, 1.0])]
    assert got(vd.vector_groups(frame(spark, rows))) == slow(rows, 0.95)
    assert vd.vector_groups(frame(spark, [])).count() == 0
    only = [(1, None), (2, [0.0])]
    assert got(vd.vector_groups(frame(spark, only))) == slow(only, 0.95)
