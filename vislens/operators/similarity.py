"""Blocked exact similarity: score blocks in Arrow batches, keep only reduced results.

A side that is proven small in rows and bytes is shipped to every task of the
other; otherwise both sides are cut into blocks and every (left block, right block) pair
is one group of a co-group, so no pair of rows is ever materialised as a row.
If that takes more than COPIED_BYTES of copies, blocks are written once and
tasks read them for every pair.
All ways give the same rows; without rows on either side there are none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.session import collect_bounded, cut_lineage

EPS = 1e-12
MAX_SHIPPED_ROWS = 4096
MAX_SHIPPED_BYTES = 32 << 20
BLOCK_ROWS = 50_000
SCORE_DIGITS = 9
#: Bytes of a block's rows; a block has fewer than BLOCK_ROWS rows if its vectors are long.
BLOCK_BYTES = 16 << 20
#: Bytes of rows that are shuffled so that all blocks meet; they grow with the product of both sides.
COPIED_BYTES = 256 << 20
#: Left blocks that one task takes past its right blocks, and rows of merged results that it holds.
STREAMED_BLOCKS = 16
HELD_ROWS = 1 << 20
#: Rows and cells of a score matrix that are held at once.
SLICE = 256
CELLS = 1 << 20


def _matrix(column, rows: np.ndarray | None = None) -> np.ndarray:
    """The vectors in double precision, or `rows` of them; only what is asked for is widened."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return (flat if rows is None else flat[rows]).astype(np.float64, copy=False)


def _values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def cosine_tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of `a`, their cosines to all of `b`); a tile has at most SLICE rows and about CELLS cells, however long `b` is."""
    na = np.sqrt(np.einsum("ij,ij->i", a, a))
    nb = np.sqrt(np.einsum("ij,ij->i", b, b))
    step = max(1, min(SLICE, CELLS // max(1, len(b))))
    products = np.empty((min(step, len(a)), len(b)))
    for lo in range(0, len(a), step):
        rows = slice(lo, lo + step)
        s = a[rows] @ b.T
        norms = np.multiply(na[rows, None], nb[None, :], out=products[: len(s)])
        norms += EPS
        s /= norms
        yield rows, np.round(s, SCORE_DIGITS, out=s)


def _packed(df: DataFrame, n: int, most: int) -> DataFrame:
    """The rows dealt over `n` blocks, of at most `most` rows each: `name`, and an Arrow stream as `block`. Written once, a file for each."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_pydict({"name": [uuid.uuid4().hex], "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    yield pack(held)
                    held, rows = [], 0
        if held:
            yield pack(held)

    # streams are compressed already, so sizes of files tell how many fit into a task
    return cut_lineage(df.repartition(n).mapInArrow(run, "name string, block binary"), maxRecordsPerFile=1, compression="none")


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _pairs_of_files(big: DataFrame, other: DataFrame, n_big: int, n_other: int, most_big: int, most_other: int, kernel, schema: str, merge) -> DataFrame:
    """The kernel over all pairs of blocks that tasks read from files: what is written grows with the sides, not with their product."""
    left, right = _packed(big, n_big, most_big), _packed(other, n_other, most_other)
    # few tasks pass a right block, since each hands on results of its own for it, but enough for all cores
    cores = big.sparkSession.sparkContext.defaultParallelism
    left = left.coalesce(min(n_big, max(-(-n_big // STREAMED_BLOCKS), -(-cores // n_other))))
    # the hint keeps the sides' partitions: a broadcast side would leave one task for each partition of the other
    pairs = left.select(F.col("name").alias("ln"), F.col("block").alias("l")).crossJoin(right.select(F.col("name").alias("rn"), F.col("block").alias("r")).hint("shuffle_replicate_nl"))

    def run(batches):
        held, name, lt = {}, None, None
        for batch in batches:
            for ln, left_block, rn, right_block in zip(batch["ln"].to_pylist(), batch["l"], batch["rn"].to_pylist(), batch["r"]):
                if ln != name:
                    name, lt = ln, _unpacked(left_block)
                part = kernel(lt, _unpacked(right_block))
                if merge is None:
                    yield from part.to_batches()
                    continue
                held[rn] = merge(pa.concat_tables([held[rn], part]) if rn in held else part)
                if sum(t.num_rows for t in held.values()) > HELD_ROWS:
                    for t in held.values():
                        yield from t.to_batches()
                    held = {}
        for t in held.values():
            yield from t.to_batches()

    return pairs.mapInArrow(run, schema)


def block_join(
    big: DataFrame,
    other: DataFrame,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    *,
    merge: Callable[[pa.Table], pa.Table] | None = None,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    max_shipped: int = MAX_SHIPPED_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply `kernel(big_block, other_block)` to every pair of blocks.

    `merge` compacts the results gathered so far within a task. `combine` puts
    together what a row of `big` got from several blocks of `other`; with one
    shipped block there is nothing to combine.
    """
    spark = big.sparkSession
    small = collect_bounded(other, max_shipped, MAX_SHIPPED_BYTES)
    if small is not None and small.num_rows == 0:
        return spark.createDataFrame([], schema)
    if small is not None:
        shipped = spark.sparkContext.broadcast(small)

        def run(batches):
            held = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                part = kernel(pa.Table.from_batches([batch]), shipped.value)
                if merge is None:
                    yield from part.to_batches()
                else:
                    held = part if held is None else merge(pa.concat_tables([held, part]))
            if held is not None:
                yield from merge(held).to_batches()

        return big.mapInArrow(run, schema)

    few = collect_bounded(big, max_shipped, MAX_SHIPPED_BYTES)
    if few is not None:
        if few.num_rows == 0:
            return spark.createDataFrame([], schema)
        held_big = spark.sparkContext.broadcast(few)

        def across(batches):
            for batch in batches:
                if batch.num_rows:
                    part = kernel(held_big.value, pa.Table.from_batches([batch]))
                    yield from (merge(part) if merge is not None else part).to_batches()

        out = other.mapInArrow(across, schema)
        return combine(out) if combine is not None else out

    width, other_width = (max(1, df.limit(1).toArrow().nbytes) for df in (big, other))
    rows, other_rows = big.count(), other.count()
    most = max(1, min(block_rows, BLOCK_BYTES // width))
    n_big, n_other = max(1, -(-rows // most)), max(1, -(-other_rows // max_shipped))
    if rows * width * n_other + other_rows * other_width * n_big > COPIED_BYTES:
        # a block may have twice the rows, as dealing is not quite even
        out = _pairs_of_files(big, other, n_big, n_other, 2 * most, 2 * max_shipped, kernel, schema, merge)
        return combine(out) if combine is not None else out
    left = (
        big.withColumn("__bl", F.pmod(F.xxhash64(F.col(big.columns[0])), F.lit(n_big)).cast("int"))
        .withColumn("__br", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    )
    right = (
        other.withColumn("__br", F.pmod(F.xxhash64(F.col(other.columns[0])), F.lit(n_other)).cast("int"))
        .withColumn("__bl", F.explode(F.sequence(F.lit(0), F.lit(n_big - 1))))
    )

    out_schema = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(out_schema)

    def pair(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty.empty_table()
        part = kernel(lt, rt)
        return merge(part) if merge is not None else part

    out = left.groupBy("__bl", "__br").cogroup(right.groupBy("__bl", "__br")).applyInArrow(pair, schema)
    return combine(out) if combine is not None else out


def _id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _keep_topk(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best per row; columns are in tie order, so earlier wins."""
    m = scores.shape[1]
    if m <= k:
        return np.isfinite(scores)
    thr = np.partition(scores, m - k, axis=1)[:, m - k][:, None]
    above = scores > thr
    need = k - above.sum(axis=1, keepdims=True)
    level = scores == thr
    return (above | (level & (np.cumsum(level, axis=1) <= need))) & np.isfinite(scores)


def _best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what `_keep_topk` marks; most cells are only compared with a bound.

    The kth largest of a row's stripe maxima is reached by k cells at least.
    """
    n, m = scores.shape
    stripe = min(64, m // (4 * k))
    if n == 0 or stripe < 4:
        return np.nonzero(_keep_topk(scores, k))
    stripes = m // stripe
    tops = scores[:, : stripes * stripe].reshape(n, stripe, stripes).max(axis=1)
    bound = np.partition(tops, stripes - k, axis=1)[:, stripes - k]
    keep = scores >= bound[:, None]
    top = np.maximum(tops.max(axis=1), scores[:, stripes * stripe :].max(axis=1, initial=-np.inf))
    odd = ~np.isfinite(top) | ~np.isfinite(bound) | (np.count_nonzero(keep, axis=1) > 8 * k)
    if odd.any():
        keep[odd] = _keep_topk(scores[odd], k)
    qi, ci = np.divmod(np.flatnonzero(keep), m)
    order = np.lexsort((ci, -scores[qi, ci], qi))
    qi, ci = qi[order], ci[order]
    first = np.searchsorted(qi, np.arange(n))
    best = np.arange(len(qi)) - first[qi] < k
    return qi[best], ci[best]


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in place of the values of two columns of strings: equal for equal ones, nulls included."""
    both = pa.concat_arrays([*a.chunks, *b.chunks]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    return both[: len(a)], both[len(a) :]


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "id",
    query_vec: str = "qvec",
    item_vec: str = "vector",
    tag: str | None = None,
    query_group: str | None = None,
    item_group: str | None = None,
    hidden: str | None = None,
    hidden_tags: Sequence[str] = (),
    descending_ties: bool = False,
    max_shipped: int = MAX_SHIPPED_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k items per query by cosine, optionally per corpus `tag`.

    With groups given, items of the query's own group are not eligible. With
    `hidden`, an array column of the corpus, there is a list for each of
    `hidden_tags`, without the items whose array names it; scores are computed
    once for all of them. Columns: [tag,] query_id, id, score, rank.
    """
    big = corpus.select(
        F.col(item_id).alias("id"),
        F.col(item_vec).alias("v"),
        (F.col(tag) if tag else F.lit("")).cast("string").alias("tag"),
        (F.col(item_group) if item_group else F.lit("")).cast("string").alias("g"),
        *([F.coalesce(F.col(hidden), F.array()).cast("array<string>").alias("hidden")] if hidden else []),
    )
    other = queries.select(
        F.col(query_id).alias("qid"),
        F.col(query_vec).alias("v"),
        (F.col(query_group) if query_group else F.lit(None)).cast("string").alias("g"),
    )
    grouped = query_group is not None
    schema = f"tag string, qid {_id_type(queries, query_id)}, id {_id_type(corpus, item_id)}, score double"

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        ids, tags = _values(lt["id"]), _values(lt["tag"])
        order = np.argsort(ids, kind="stable")
        if descending_ties:
            order = order[::-1]
        ids, tags = ids[order], tags[order]
        qids, qvecs = _values(rt["qid"]), _matrix(rt["v"])
        groups, qgroups = _codes(lt["g"], rt["g"])
        groups = groups[order]
        out = {"tag": [], "qid": [], "id": [], "score": []}
        masks = None
        if hidden:
            lists = lt["hidden"].combine_chunks() if isinstance(lt["hidden"], pa.ChunkedArray) else lt["hidden"]
            owner, name = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            masks = {}
            for t in hidden_tags:
                gone = np.zeros(lt.num_rows, bool)
                gone[owner[name == t]] = True
                masks[t] = gone[order]
        for t in np.unique(tags):
            sel = np.flatnonzero(tags == t)
            for rows, s in cosine_tiles(qvecs, _matrix(lt["v"], order[sel])):
                if grouped:
                    s[qgroups[rows][:, None] == groups[sel][None, :]] = -np.inf
                for name, gone in (masks or {t: None}).items():
                    shown = s if gone is None else np.where(gone[sel], -np.inf, s)
                    qi, ci = _best_places(shown, k)
                    out["qid"].append(qids[rows.start + qi])
                    out["id"].append(ids[sel[ci]])
                    out["score"].append(s[qi, ci])
                    out["tag"].append(pa.repeat(pa.scalar(name, pa.string()), len(qi)))
        return pa.table(
            {
                "tag": pa.concat_arrays(out["tag"]),
                "qid": pa.array(np.concatenate(out["qid"]), rt.schema.field("qid").type),
                "id": pa.array(np.concatenate(out["id"]), lt.schema.field("id").type),
                "score": pa.array(np.concatenate(out["score"]), pa.float64()),
            }
        )

    def merge(t: pa.Table) -> pa.Table:
        tie = "descending" if descending_ties else "ascending"
        t = t.sort_by([("tag", "ascending"), ("qid", "ascending"), ("score", "descending"), ("id", tie)])
        if t.num_rows == 0:
            return t
        tags, qids = t["tag"].combine_chunks().dictionary_encode().indices.to_numpy(), _values(t["qid"])
        start = np.ones(t.num_rows, bool)
        start[1:] = (tags[1:] != tags[:-1]) | (qids[1:] != qids[:-1])
        at = np.arange(t.num_rows)
        pos = at - np.maximum.accumulate(np.where(start, at, 0))
        return t.filter(pa.array(pos < k))

    part = block_join(big, other, kernel, schema, merge=merge, max_shipped=max_shipped, block_rows=block_rows)
    tie = F.col("id").desc() if descending_ties else F.col("id").asc()
    w = W.partitionBy("tag", "qid").orderBy(F.col("score").desc(), tie)
    out = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    cols = [F.col("tag").cast(corpus.schema[tag].dataType).alias(tag)] if tag else [F.col("tag")] if hidden else []
    return out.select(*cols, F.col("qid").alias(query_id), F.col("id").alias(item_id), "score", "rank")


def max_similarity(
    items: DataFrame,
    anchors: DataFrame,
    *,
    item_id: str = "id",
    item_vec: str = "vector",
    anchor_key: str | None = None,
    anchor_vec: str = "vector",
    anchor_tag: str | None = None,
    max_shipped: int = MAX_SHIPPED_ROWS,
) -> DataFrame:
    """Best cosine of every item to any anchor, per anchor tag if one is given.

    With `anchor_key`, also the best anchor (the largest key among equals).
    """
    big = items.select(F.col(item_id).alias("id"), F.col(item_vec).alias("v"))
    key = F.col(anchor_key) if anchor_key else F.lit(0)
    key_type = _id_type(anchors, anchor_key) if anchor_key else "int"
    tag = (F.col(anchor_tag) if anchor_tag else F.lit("")).cast("string")
    other = anchors.select(key.alias("k"), F.col(anchor_vec).alias("v"), tag.alias("tag"))

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        keys, tags = _values(rt["k"]), _values(rt["tag"])
        order = np.argsort(keys, kind="stable")[::-1]
        vecs, keys, tags = _matrix(rt["v"], order), keys[order], tags[order]
        mine = _matrix(lt["v"])
        parts = []
        for t in np.unique(tags):
            sel = np.flatnonzero(tags == t)
            top, arg = np.full(len(mine), -np.inf), np.zeros(len(mine), int)
            for rows, s in cosine_tiles(vecs[sel], mine):
                best = np.argmax(s, axis=0)
                score = s[best, np.arange(len(mine))]
                better = score > top
                top, arg = np.where(better, score, top), np.where(better, sel[rows][best], arg)
            parts.append(
                pa.table(
                    {
                        "tag": pa.array(np.full(len(mine), t, dtype=object), pa.string()),
                        "id": lt["id"],
                        "score": pa.array(top),
                        "k": pa.array(keys[arg], rt.schema.field("k").type),
                    }
                )
            )
        return pa.concat_tables(parts)

    schema = f"tag string, id {_id_type(items, item_id)}, score double, k {key_type}"
    best = lambda df: df.groupBy("tag", "id").agg(F.max(F.struct("score", "k")).alias("b")).select("tag", "id", "b.*")
    out = block_join(big, other, kernel, schema, combine=best, max_shipped=max_shipped)
    cols = [F.col("tag").cast(anchors.schema[anchor_tag].dataType).alias(anchor_tag)] if anchor_tag else []
    return out.select(*cols, F.col("id").alias(item_id), "score", *([F.col("k").alias(anchor_key)] if anchor_key else []))


def beats(
    probes: DataFrame,
    background: DataFrame,
    *,
    probe_id: str = "probe_id",
    probe_vec: str = "qvec",
    probe_score: str = "score",
    probe_key: str = "item_key",
    item_key: str = "item_key",
    item_vec: str = "vector",
    max_shipped: int = MAX_SHIPPED_ROWS,
) -> DataFrame:
    """Per probe: background items scoring above it (ties: smaller key first)."""
    big = background.select(F.col(item_key).alias("k"), F.col(item_vec).alias("v"))
    other = probes.select(
        F.col(probe_id).alias("p"), F.col(probe_vec).alias("v"), F.col(probe_score).alias("s"), F.col(probe_key).alias("pk")
    )

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        probe, item, keys = _matrix(rt["v"]), _matrix(lt["v"]), _values(lt["k"])
        own, own_key = np.round(_values(rt["s"]), SCORE_DIGITS), _values(rt["pk"])
        n = []
        for rows, s in cosine_tiles(probe, item):
            mine = own[rows, None]
            first = (keys[None, :] < own_key[rows, None]).astype(bool)
            n.append(((s > mine) | ((s == mine) & first)).sum(axis=1))
        return pa.table({"p": rt["p"], "n": pa.array(np.concatenate(n), pa.int64())})

    part = block_join(big, other, kernel, f"p {_id_type(probes, probe_id)}, n bigint", max_shipped=max_shipped)
    return part.groupBy(F.col("p").alias(probe_id)).agg(F.sum("n").alias("n_above"))


def above_cutoff(
    queries: DataFrame,
    items: DataFrame,
    *,
    query_id: str = "query_id",
    query_vec: str = "qvec",
    cutoff: str = "cutoff",
    item_id: str = "id",
    item_vec: str = "vector",
    max_shipped: int = MAX_SHIPPED_ROWS,
) -> DataFrame:
    """(query, item, score) of every item reaching the query's own cutoff."""
    big = items.select(F.col(item_id).alias("id"), F.col(item_vec).alias("v"))
    other = queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("v"), F.col(cutoff).alias("c"))

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        query, item = _matrix(rt["v"]), _matrix(lt["v"])
        ids, qids, cuts = _values(lt["id"]), _values(rt["q"]), _values(rt["c"])
        out = {"q": [], "id": [], "score": []}
        for rows, s in cosine_tiles(query, item):
            qi, ci = np.nonzero(s >= cuts[rows, None])
            out["q"].append(qids[rows.start + qi])
            out["id"].append(ids[ci])
            out["score"].append(s[qi, ci])
        kinds = {"q": rt.schema.field("q").type, "id": lt.schema.field("id").type, "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(out[c]), kinds[c]) for c in out})

    schema = f"q {_id_type(queries, query_id)}, id {_id_type(items, item_id)}, score double"
    part = block_join(big, other, kernel, schema, max_shipped=max_shipped)
    return part.select(F.col("q").alias(query_id), F.col("id").alias(item_id), "score")


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, out: str = "centroid") -> DataFrame:
    """Mean vector per group, combined map-side coordinate by coordinate."""
    cells = df.select(*keys, F.posexplode(F.col(vec)).alias("__pos", "__x"))
    means = cells.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    packed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__pos", "__m"))).alias("__a"))
    return packed.select(*keys, F.transform("__a", lambda s: s["__m"]).alias(out))
