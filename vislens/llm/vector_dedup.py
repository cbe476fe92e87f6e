"""Near-duplicate vectors by cosine, within cells of spherical k-means.

Every vector has a home cell, that of its nearest centroid. It is also a guest
of each cell whose members could be near it: a vector y of cell c is at least as
near to c's centroid as to any other, so <y, c - h> >= 0 for x's own centroid h;
if the angle of x and y is at most theta, then <x, c - h> >= -|c - h| sin(theta).
Cells that fail this for x hold nothing near it, so no link is lost, whatever the
centroids are. Links of two homes in one cell and of a guest with a home are
counted once, by the rule that the smaller cell number receives the guest.

Cells are cut into tiles of bounded size and compared tile by tile in blocks of
dot products in double precision. Tasks report counts and a spanning forest, not
pairs. Vectors of equal components are one class and are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislens.llm.graph import components
from vislens.llm.simhash import _merge
from vislens.session import cut_lineage

#: Bytes of a tile's vectors as doubles, and the number of vectors that a cell is meant to have.
TILE_BYTES, CELL = 4 << 20, 4096
#: Cells at most: 4096 centroids of 64 doubles are 2 MB. Larger inputs have more tiles in a cell instead.
MOST_CELLS = 4096
#: Vectors that the centroids are fitted on at most, and rounds of fitting. The links don't depend on them.
SAMPLE, ROUNDS = 20_000, 6
#: Rounding of a cosine of double precision, with room.
SLACK = 1e-9


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(1, keepdims=True) if len(rows) else rows
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None] if len(rows) else rows


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows, begun at evenly spaced rows; a cell that runs empty keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, home, x)
        norm = np.linalg.norm(s, axis=1)
        c = np.where((norm > 1e-12)[:, None], s / np.maximum(norm, 1e-12)[:, None], c)
    return c


def places(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of every vector: its home, and lower cells it must visit as a guest."""
    dots = x @ c.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
    sine = math.sqrt(max(0.0, 1 - cosine * cosine))
    near = dots - dots[np.arange(len(x)), home][:, None] >= -apart * sine - SLACK
    near &= np.arange(len(c))[None, :] <= home[:, None]
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row] == cell


def _tile_links(x, y, wx, wy, cosine, same, rows=256):
    """Weighted link counts on both sides and the linked pairs' spanning forest over x, then y."""
    nx = np.zeros(len(x), np.int64)
    ny = np.zeros(len(y), np.int64)
    shift = 0 if same else len(x)
    root = np.arange(len(x) if same else len(x) + len(y))
    for i in range(0, len(x), rows):
        j0 = i if same else 0
        near = x[i : i + rows] @ y[j0:].T >= cosine
        if same:  # each pair once, and no vector with itself
            near &= np.arange(len(near))[:, None] < np.arange(near.shape[1])[None, :]
        u, v = np.nonzero(near)
        if len(u):
            u, v = u + i, v + j0
            np.add.at(nx, u, wy[v])
            np.add.at(ny, v, wx[u])
            root = _merge(root, u, v + shift)
    return nx, ny, root


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, tile: int | None = None, cell: int = CELL) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row per row.

    Two rows link if the cosine of their vectors, in double precision, is at
    least `cosine`. n_links counts the other rows that a row links with;
    component_id is the smallest id reachable; kept says that it is the row's own.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing and are their own component; so are vectors of different
    dimensions to each other. Rows that repeat an id are separate rows; null ids
    never name a component that has another. Other columns are not read. `tile`
    is the number of vectors of a tile, by default as many as TILE_BYTES hold.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":  # floats travel as floats and are compared as doubles
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = rows.filter("sound").withColumn("d", F.size("v"))
    classes = good.groupBy("d", "v").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    # a class is named by its place in the written table
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    parts = []
    for (d,) in sorted(classes.select("d").distinct().collect()):  # dimensions, not vectors
        parts.append(_links(classes.filter(F.col("d") == d), cosine, tile or max(1, TILE_BYTES // (8 * d)), cell))
    found = parts[0] if parts else None
    for p in parts[1:]:
        found = found.unionByName(p)
    loose = rows.filter("not sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    if found is None:
        return _named(loose, id_col)
    found = cut_lineage(found)
    counts = found.groupBy("class").agg(F.sum("n").alias("others"))
    roots = components(found.filter("root is not null").select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("root", F.coalesce("root", "class"))
    low = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(low, "root").select("d", "v", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(named, ["d", "v"]).select("id", "n_links", "component_id")
    return _named(linked.unionByName(loose), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, cosine: float, tile: int, cell: int) -> DataFrame:
    """(class, n, root): weighted links that a class has found in a tile pair, and forest edges (root, else null)."""
    total = classes.count()
    k = min(MOST_CELLS, max(1, math.ceil(total / cell)))
    sample = classes.orderBy(F.xxhash64("v"), "low").select("v").limit(SAMPLE).toArrow()
    centroids = spherical_kmeans(unit_rows(sample.column("v").combine_chunks()), k)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, where, home = places(unit_rows(part.column(2)), centroids, cosine)
                take = pa.array(row)
                yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(where, pa.int32()), pa.array(home)], names=["class", "weight", "v", "cell", "home"])

    placed = classes.select("class", "weight", "v").mapInArrow(place, f"class bigint, weight bigint, v {classes.schema['v'].dataType.simpleString()}, cell int, home boolean")
    placed = cut_lineage(placed)
    sizes = placed.groupBy("cell", "home").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # two rows a cell
    tiles = placed.join(F.broadcast(sizes), ["cell", "home"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    tiles = tiles.groupBy("cell", "home", "part").agg(F.collect_list(F.struct("class", "weight", "v")).alias("rows"))
    tiles = cut_lineage(tiles)
    left = tiles.select("cell", "home", "part", F.col("rows").alias("x"))
    right = tiles.filter("home").select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("rows").alias("y"))
    names = tiles.select("cell", "home", "part").join(tiles.filter("home").select("cell", F.col("part").alias("part2")), "cell")
    names = names.filter("not home or part <= part2").withColumn("cell2", F.col("cell"))
    n = names.count()
    work = names.join(left, ["cell", "home", "part"]).join(right, ["cell2", "part2"])
    work = work.repartition(max(1, math.ceil(n / 4)), "cell", "home", "part", "part2")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                home, part, part2 = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                a, b = (batch.column(c)[i].values for c in (3, 4))
                same = home and part == part2
                (cx, wx, x), (cy, wy, y) = ((r.field(0).to_numpy(zero_copy_only=False), r.field(1).to_numpy(zero_copy_only=False), unit_rows(r.field(2))) for r in (a, b))
                nx, ny, root = _tile_links(x, y, wx, wy, cosine, same)
                names = cx if same else np.concatenate([cx, cy])
                counts = nx + ny if same else np.concatenate([nx, ny])
                up = names[root]
                hit = np.flatnonzero(counts)
                mask = root[hit] == hit
                yield pa.record_batch([pa.array(names[hit]), pa.array(counts[hit]), pa.array(up[hit], mask=mask)], names=["class", "n", "root"])

    return work.select("home", "part", "part2", "x", "y").mapInArrow(compare, "class bigint, n bigint, root bigint")
