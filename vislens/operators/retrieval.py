"""Eligible retrieval: filters before or after top-k, merged and reference lists, cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.operators.similarity import above_cutoff, beats, mean_vector, topk
from vislens.functions.stats import count_if
from vislens.functions.vectors import unit
from vislens.session import cut_lineage


def rerank(df: DataFrame, k: int, keys=("query_id",), tie_desc: bool = False) -> DataFrame:
    """Best k candidates per key by (score desc, id), with a new rank."""
    tie = F.col("id").desc() if tie_desc else F.col("id").asc()
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def infilter_topk(queries: DataFrame, items: DataFrame, visible: Column, k: int, **kw) -> DataFrame:
    return topk(queries, items.filter(visible), k, **kw)


def postfilter_topk(queries, items, eligible: DataFrame, k: int, over_fetch: int, **kw) -> DataFrame:
    """Top k*over_fetch first, eligibility afterwards; may return fewer than k."""
    raw = topk(queries, items, k * over_fetch, **kw)
    return rerank(raw.join(eligible.select("id"), "id", "left_semi"), k)


def merge_topk(static_topk: DataFrame, dynamic: DataFrame, k: int) -> DataFrame:
    """Exact top-k of (static corpus ∪ dynamic items) from the corpus's own top-k.

    `dynamic` has (query_id, id, score) of the currently eligible ingested items.
    """
    cols = ["query_id", "id", "score"]
    return rerank(static_topk.select(*cols).unionByName(dynamic.select(*cols)), k)


def kth_cutoff(queries: DataFrame, items: DataFrame, k: int, **kw) -> DataFrame:
    return (
        topk(queries, items, k, **kw)
        .filter(F.col("rank") == k)
        .select("query_id", F.col("score").alias("cutoff"))
    )


def dynamic_candidates(queries: DataFrame, static: DataFrame, dynamic: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Static top-k and the dynamic items that can enter it (score >= the k-th)."""
    pre = topk(queries, static, k)
    cut = pre.groupBy("query_id").agg(F.min("score").alias("cutoff"))
    return pre, above_cutoff(queries.join(cut, "query_id"), dynamic)


def fetch_diagnostics(raw: DataFrame, control: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Foreign ids in the raw pool and queries left with fewer than k results."""
    known = control.select("id", "visible", F.lit(True).alias("known"))
    per_query = (
        raw.join(known, "id", "left")
        .groupBy("query_id")
        .agg(count_if(F.col("known").isNull()).alias("foreign"), count_if(F.col("visible")).alias("eligible"))
    )
    return (
        queries.select("query_id")
        .join(per_query, "query_id", "left")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.coalesce(F.sum("foreign"), F.lit(0)).alias("foreign_candidates"),
            count_if(F.coalesce(F.col("eligible"), F.lit(0)) < k).alias("underfill"),
        )
    )


def landing_rank(candidates: DataFrame, background: DataFrame, k: int = 5) -> DataFrame:
    """Rank of each candidate when it alone joins the frozen background.

    candidates: item_key, family, query_id, qvec, score (its cosine to the query).
    """
    ahead = beats(candidates, background, probe_id="item_key", item_key="id", probe_key="item_key")
    ranked = candidates.join(ahead, "item_key", "left").select(
        "item_key", "family", "query_id", "score", (F.coalesce(F.col("n_above"), F.lit(0)) + 1).alias("rank")
    )
    pre = topk(candidates.select("query_id", "qvec").dropDuplicates(["query_id"]), background, k)
    pool = ranked.select("item_key", "query_id").join(pre.select("query_id", "id", "score"), "query_id").select(
        "item_key", "id", "score"
    ).unionByName(ranked.select("item_key", F.col("item_key").alias("id"), "score"))
    top = (
        rerank(pool, k, keys=("item_key",))
        .groupBy("item_key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("l"))
        .select("item_key", F.transform("l", lambda s: s["id"]).alias("top_keys"))
    )
    return ranked.join(top, "item_key").withColumn("landed", F.col("rank") <= k)


def mean_cosines(df: DataFrame, group: str, vec: str, left: str, right: str) -> DataFrame:
    """Mean pairwise cosine per group between two populations, without forming pairs.

    The mean of all pairwise dot products of unit vectors is the dot product of
    the two mean vectors.  `left`/`right` are boolean columns of `df`.
    """
    u = df.withColumn("__u", unit(vec)).select(group, left, right, F.posexplode("__u").alias("p", "x"))
    per = u.groupBy(group, "p").agg(
        F.avg(F.when(F.col(left), F.col("x"))).alias("a"), F.avg(F.when(F.col(right), F.col("x"))).alias("b")
    )
    return per.groupBy(group).agg(F.sum(F.col("a") * F.col("b")).alias("mean_cosine"))


def nearest_cell(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cell) of every item."""
    from vislens.operators.similarity import max_similarity

    return max_similarity(items, centroids, anchor_key="cell", anchor_vec="centroid").select("id", "cell")


def write_cells(items: DataFrame, centroids: DataFrame, path: str) -> None:
    """An inverted file: the items (id, vector), a folder for each cell, written by one task each."""
    placed = items.select("id", "vector").join(nearest_cell(items, centroids), "id").repartition("cell")
    placed.write.mode("errorifexists").partitionBy("cell").parquet(path)


def probe_cells(queries: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    """(query_id, cell, cell_rank): the nearest cells of every query."""
    found = topk(queries, centroids, n_probe, item_id="cell", item_vec="centroid")
    return found.select("query_id", "cell", F.col("rank").cast("int").alias("cell_rank"))


def search_cells(queries: DataFrame, path: str, centroids: DataFrame, n_probe: int, k: int, **sizes) -> DataFrame:
    """As `cell_candidates`, over cells that `write_cells` has written; folders of cells that no query probes are not read."""
    spark = queries.sparkSession
    probes = probe_cells(queries, centroids, n_probe)
    wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # cells, as many as were trained at most
    stored = spark.read.parquet(path).withColumn("cell", F.col("cell").cast(centroids.schema["cell"].dataType))
    return _search_placed(queries, probes, stored.filter(F.col("cell").isin(wanted)), k, **sizes)


def cell_candidates(queries: DataFrame, items: DataFrame, centroids: DataFrame, n_probe: int, k: int, **sizes) -> DataFrame:
    """Approximate search: top-k of each of the query's `n_probe` nearest cells.

    centroids: cell, centroid.  Columns: query_id, cell, cell_rank, id, score.
    """
    placed = items.select("id", "vector").join(nearest_cell(items, centroids), "id")
    return _search_placed(queries, probe_cells(queries, centroids, n_probe), placed, k, **sizes)


def cell_effort(probes: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """(*by, vectors_scored): how many products of a query with an item the probes cost."""
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return probes.join(sizes, "cell").groupBy(*by).agg(F.sum("n").alias("vectors_scored"))


def _dealt(rows: DataFrame, key: str, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a cell in blocks of about `most`, numbered `name`; (cell, how many blocks)."""
    n = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(f"{name}s"))
    return rows.join(n, "cell").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), n


def _search_placed(queries: DataFrame, probes: DataFrame, placed: DataFrame, k: int, *, block_rows: int = 50_000, block_queries: int = 8192) -> DataFrame:
    """Both sides of a crowded cell are cut: about `block_rows` items and `block_queries` queries make a group."""
    from vislens.operators.similarity import _id_type, cosine_tiles, _keep_topk, _matrix, _values
    import numpy as np
    import pyarrow as pa

    placed, blocks = _dealt(placed, "id", block_rows, "block")
    asked, turns = _dealt(probes, "query_id", block_queries, "turn")
    asked = asked.join(queries.select("query_id", "qvec"), "query_id").join(blocks, "cell")
    probed = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    schema = (
        f"query_id {_id_type(queries, 'query_id')}, cell {_id_type(probes, 'cell')}, cell_rank int, "
        f"id {_id_type(placed, 'id')}, score double"
    )

    def search(qt: pa.Table, it: pa.Table) -> pa.Table:
        out = {"query_id": [], "cell": [], "cell_rank": [], "id": [], "score": []}
        if qt.num_rows and it.num_rows:
            ids = _values(it["id"])
            order = np.argsort(ids, kind="stable")
            ids, asked = ids[order], {n: _values(qt[n]) for n in ("query_id", "cell", "cell_rank")}
            for rows, s in cosine_tiles(_matrix(qt["qvec"]), _matrix(it["vector"], order)):
                qi, ci = np.nonzero(_keep_topk(s, k))
                for name, values in asked.items():
                    out[name].append(values[rows.start + qi])
                out["id"].append(ids[ci])
                out["score"].append(s[qi, ci])
        kinds = {
            "query_id": qt.schema.field("query_id").type,
            "cell": qt.schema.field("cell").type,
            "cell_rank": pa.int32(),
            "id": it.schema.field("id").type,
            "score": pa.float64(),
        }
        return pa.table(
            {n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()}
        )

    found = (
        probed.select("cell", "block", "turn", "query_id", "qvec", F.col("cell_rank").cast("int").alias("cell_rank"))
        .groupBy("cell", "block", "turn")
        .cogroup(placed.select("cell", "block", "turn", "id", "vector").groupBy("cell", "block", "turn"))
        .applyInArrow(search, schema)
    )
    return rerank(found, k, keys=("query_id", "cell")).drop("rank")


#: Cells up to which Spark ML trains; its seeding compares several times as many candidates with each other on the driver.
ML_CELLS = 256
#: Steps of training, and the cosine distance that a centre may still move at the end; those of Spark ML.
STEPS, MOVES = 20, 1e-4


def train_cells(items: DataFrame, n_cells: int, seed: int = 7) -> DataFrame:
    """Coarse cells by k-means over cosines; the centres are as many rows as asked for.

    Few cells are trained by Spark ML, many by the same steps as products of
    blocks of vectors with all centres, from different vectors drawn by `seed`.
    """
    if n_cells > ML_CELLS:
        return _train_many(items, n_cells, seed)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = items.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine").fit(feats)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return items.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def _train_many(items: DataFrame, n_cells: int, seed: int) -> DataFrame:
    """k-means whose tasks hold the centres and their own sums; sums of a thousand cells are added up in a task."""
    import numpy as np
    import pyarrow as pa

    from vislens.operators.similarity import _matrix

    spark = items.sparkSession
    vectors = items.select(F.col("vector").cast("array<double>").alias("v"))
    units = cut_lineage(vectors.repartition(spark.sparkContext.defaultParallelism))
    centres = _drawn(units, n_cells, seed)
    for _ in range(STEPS):
        sums = units.mapInArrow(_cell_sums(centres.astype(np.float32)), "cell int, n long, v array<double>")
        got = sums.groupBy(F.floor(F.col("cell") / 1024).alias("part")).applyInArrow(_added, "cell int, v array<double>").toArrow()
        cells, new = got["cell"].to_numpy(), _matrix(got["v"])
        size = np.linalg.norm(new, axis=1)
        cells, new = cells[size > 0], new[size > 0] / size[size > 0, None]
        moved = 1 - np.einsum("ij,ij->i", centres[cells], new)
        centres[cells] = new  # a cell that no vector is nearest to stays where it is
        if not len(moved) or moved.max() <= MOVES:
            break
    flat = pa.ListArray.from_arrays(np.arange(len(centres) + 1, dtype=np.int32) * centres.shape[1], centres.ravel())
    return spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(centres)), pa.int32()), "centroid": flat}))


def _drawn(units: DataFrame, n: int, seed: int):
    """Directions of `n` different vectors, those of the smallest hashes; all, if there are fewer."""
    import numpy as np

    from vislens.operators.similarity import _matrix

    h = units.select("v", F.xxhash64(F.lit(seed), "v").alias("h"))
    some = h.filter(F.pmod("h", F.lit(units.count())) < 2 * n)
    for rows in (some, h):
        got = rows.dropDuplicates(["v"]).orderBy("h", "v").limit(n).toArrow()
        if got.num_rows == n:
            break
    m = _matrix(got["v"])
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]


def _cell_sums(centres):
    """Batches of vectors to the sums of their directions in the cell of the nearest centre."""
    import numpy as np
    import pyarrow as pa

    from vislens.operators.similarity import CELLS, _matrix

    def run(batches):
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"])
            x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
            step, low = max(1, CELLS // len(centres)), x.astype(np.float32)
            cell = np.concatenate([(low[lo : lo + step] @ centres.T).argmax(axis=1) for lo in range(0, len(low), step)])
            order = np.argsort(cell, kind="stable")
            hit, first, count = np.unique(cell[order], return_index=True, return_counts=True)
            n[hit] += count
            total[hit] += np.add.reduceat(x[order], first)
        hit = np.flatnonzero(n)
        for lo in range(0, len(hit), 8192):
            at = hit[lo : lo + 8192]
            v = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * centres.shape[1], total[at].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), v], ["cell", "n", "v"])

    return run


def _added(part):
    """The sums of each cell of a part, added up."""
    import numpy as np
    import pyarrow as pa

    from vislens.operators.similarity import _matrix

    order = np.lexsort((part["n"].to_numpy(), part["cell"].to_numpy()))
    cell, first = np.unique(part["cell"].to_numpy()[order], return_index=True)
    total = np.add.reduceat(_matrix(part["v"], order), first)
    v = pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * total.shape[1], total.ravel())
    return pa.table({"cell": pa.array(cell, pa.int32()), "v": v})


def topic_cells(items: DataFrame) -> DataFrame:
    """Cells given by the mean vector of each topic."""
    return mean_vector(items, ["topic"], "vector").select(F.col("topic").alias("cell"), "centroid")


def list_quality(exact: DataFrame, approx: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query: recall, identical ordered list, and whether landing agrees.

    queries: query_id, associated_id.  Queries without a result count as zero.
    """
    e = exact.select("query_id", "id", F.col("rank").alias("e_rank"))
    a = approx.select("query_id", "id", F.col("rank").alias("a_rank"))
    both = e.join(a, ["query_id", "id"], "full_outer").join(
        queries.select("query_id", F.col("associated_id")), "query_id"
    )
    same = F.col("e_rank").eqNullSafe(F.col("a_rank"))
    hit = F.col("id") == F.col("associated_id")
    per = both.groupBy("query_id").agg(
        count_if(F.col("e_rank").isNotNull() & F.col("a_rank").isNotNull()).alias("common"),
        F.min(same).alias("identical"),
        F.coalesce(F.max(hit & F.col("e_rank").isNotNull()), F.lit(False)).alias("exact_landed"),
        F.coalesce(F.max(hit & F.col("a_rank").isNotNull()), F.lit(False)).alias("approx_landed"),
        F.count("a_rank").alias("returned"),
    )
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("common") / F.lit(k), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("identical"), F.lit(False)).alias("identical"),
        F.coalesce((F.col("returned") > 0) & (F.col("exact_landed") == F.col("approx_landed")), F.lit(False)).alias("concordant"),
        F.coalesce(F.col("returned"), F.lit(0)).alias("returned"),
    )
