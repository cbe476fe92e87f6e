"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Documents with equal fingerprints are one class before anything is compared, so
a third of all rows being copies of one text costs one fingerprint. Distinct
fingerprints are dealt into tiles of one population count. A fingerprint at
distance r differs by at most r in population count, so tile pairs further
apart are never formed; within a pair the same bound is applied to the upper
half of the bits. The rest is exclusive-or and bit counts in numpy.

A task reports a spanning forest of the links it finds, never the pairs: its
output is linear in the fingerprints it has read, however large a group is.

64 bits with a radius of 4 find copies that differ in a word or two. Copies that
share four fifths of their shingles differ in some 15 % of the bits, and no radius
of 64 bits tells them from chance; for them fingerprints have 128 bits, the first
half of which is compared in the tiles and the second where the first is close.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislens.llm.graph import components
from vislens.llm.rows import placed
from vislens.session import cut_lineage

SEED = 42
#: Fingerprints in a tile. A tile meets every other that is near, so the bytes moved fall as it grows; a pair takes some 5 s at most.
TILE = 1 << 16
#: Tile pairs that one task compares.
PAIRS_PER_TASK = 4


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lowered, words split at ASCII white space, repeated shingles counted.

    Fewer words than a shingle: the whole sequence is the only one. No word: 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = list(accumulate(map(len, words), lambda s, n: s + n + 1, initial=0))
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(line[i : j - 1], SEED) for i, j in zip(starts, starts[shingle:])]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        block = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """One bit for each bit position: whether over half of the rows of bytes have it."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> tuple[int, int]:
    """128-bit SimHash, as two halves, over the words and shingles of `fingerprint`, each shingle counted once."""
    words = (text or b"").lower().split()
    if not words:
        return 0, 0
    line = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda s, n: s + n + 1, initial=0))
    shingles = {line[i : j - 1] for i, j in zip(starts, starts[shingle:])} or {line}
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), np.uint8).reshape(-1, 16)
    low, high = _majority(digests).tolist()
    return low, high


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id_col, fp, fp2): one row per row, the halves as signed bigints."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            halves = np.array([wide_fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=[id_col, "fp", "fp2"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, fp bigint, fp2 bigint")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): one row per row, fp as a signed bigint; a null text counts as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, fp bigint")


def _merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the trees of u and v; every entry of root points at its tree's smallest index."""
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return root
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 32, second: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (nodes, roots) of the links within tile `a`, or between `a` and `b`, as places in a and then b; each tile has one population count.

    `second` has the second halves of a and b, and the most bits that both halves may differ by together.
    """
    half = np.uint64(32)
    ha = np.bitwise_count(a >> half).astype(np.int64)
    place_a = np.argsort(ha, kind="stable")
    a, ha = a[place_a], ha[place_a]
    if b is None:
        b, hb, apart, place, shift = a, ha, 0, place_a, 0
    else:
        hb = np.bitwise_count(b >> half).astype(np.int64)
        place_b = np.argsort(hb, kind="stable")
        b, hb = b[place_b], hb[place_b]
        apart = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0])) if len(a) and len(b) else 0
        place, shift = np.concatenate([place_a, place_b + len(a)]), len(a)
    if second:
        more = np.concatenate([second[0], second[1]] if shift else [second[0]])[place]
    root = np.arange(len(place))
    # |d| + |apart - d| <= radius for the difference d of the upper halves
    low, high = -((radius - apart) // 2), (apart + radius) // 2
    for i in range(0, len(a), rows):
        block = a[i : i + rows]
        j0 = max(np.searchsorted(hb, ha[i] + low, "left"), i if not shift else 0)
        j1 = np.searchsorted(hb, ha[min(i + rows, len(a)) - 1] + high, "right")
        if j1 <= j0:
            continue
        near = np.bitwise_count(block[:, None] ^ b[None, j0:j1]) <= radius
        hits = np.flatnonzero(near)
        if len(hits):
            u, v = np.divmod(hits, j1 - j0)
            u, v = u + i, v + j0
            if second:
                close = np.bitwise_count(a[u] ^ b[v]).astype(np.int64) + np.bitwise_count(more[u] ^ more[v + shift]) <= second[2]
                u, v = u[close], v[close]
            root = _merge(root, u, v + shift)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return place[linked], place[root[linked]]


def link_forest(fps: DataFrame, radius: int = 4, tile: int = TILE, both: int | None = None) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within `radius` bits; `fps` has distinct bigint `fp`.

    With `both`, `fps` has distinct (fp, fp2): linked are those whose first halves
    differ by `radius` bits at most and whose halves together by `both`; a and b
    are structs of the halves.
    """
    halves = ["fp", "fp2"] if both is not None else ["fp"]
    counted = fps.select(*halves, F.bit_count("fp").cast("int").alias("pop"))
    per_pop = counted.groupBy("pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # 65 rows at most
    dealt = counted.join(F.broadcast(per_pop), "pop").withColumn("part", F.pmod(F.xxhash64(*halves), F.col("parts")).cast("int"))
    tiles = cut_lineage(dealt.groupBy("pop", "part").agg(F.collect_list(F.struct(*halves)).alias("f")).select("pop", "part", *[F.col("f")[h].alias(h) for h in halves]))
    left = tiles.select("pop", "part", *[F.col(h).alias(f"a{h}") for h in halves])
    right = tiles.select(F.col("pop").alias("pop2"), F.col("part").alias("part2"), *[F.col(h).alias(f"b{h}") for h in halves])
    names = tiles.select("pop", "part")
    ahead = names.withColumn("pop2", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    pairs = ahead.join(names.select(F.col("pop").alias("pop2"), F.col("part").alias("part2")), "pop2")
    pairs = pairs.filter("pop < pop2 or part <= part2")
    n = pairs.count()
    work = pairs.join(left, ["pop", "part"]).join(right, ["pop2", "part2"])
    work = work.repartition(max(1, math.ceil(n / PAIRS_PER_TASK)), "pop", "part", "pop2", "part2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pop, part, pop2, part2 = (batch.column(k)[i].as_py() for k in range(4))
                lists = [batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in range(4, 4 + 2 * len(halves))]
                a, b = lists[: len(halves)], lists[len(halves) :]
                same = (pop, part) == (pop2, part2)
                u, v = forest(a[0], None if same else b[0], radius, second=(a[1], b[1], both) if both is not None else None)
                if len(u):
                    nodes = a if same else [np.concatenate(x) for x in zip(a, b)]
                    yield pa.record_batch([pa.array(x[at].view(np.int64)) for at in (u, v) for x in nodes], names=out)

    out = [f"{side}{h}" for side in "ab" for h in halves]
    columns = [f"{side}{h}" for side in "ab" for h in halves]
    found = work.select("pop", "part", "pop2", "part2", *columns).mapInArrow(run, ", ".join(f"{c} bigint" for c in out))
    name = lambda side: F.struct(*[F.col(f"{side}{h}").alias(h) for h in halves]) if both is not None else F.col(f"{side}fp")
    return found.select(name("a").alias("a"), name("b").alias("b"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE
) -> DataFrame:
    """(id_col, fp, component_id, group_size): one row per input row.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits, group_size the rows of the component. Null and empty texts
    have fingerprint 0 and link like any other. Null ids never become a
    component's id unless it has no other. Rows that repeat an id stay rows.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")))
    roots = components(link_forest(classes.select("fp"), radius, tile))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    totals = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size"))
    named = rooted.join(totals, "root").select("fp", "component_id", "group_size")
    return own.join(named, "fp").select(id_col, "fp", "component_id", "group_size")


#: Radius of 128-bit fingerprints, and of their first halves: at a similarity of 0.8 nineteen in twenty pairs lie within both.
WIDE_RADIUS, FIRST_RADIUS = 26, 16


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = WIDE_RADIUS, first_radius: int = FIRST_RADIUS, tile: int = TILE
) -> DataFrame:
    """One row of each group of near copies; columns and their order stay.

    Linked are texts whose 128-bit fingerprints differ in at most `radius` bits,
    `first_radius` of them in the first half. Of a group the row of smallest id
    stays, of that id the text of smallest hash, of rows that repeat both any one;
    null ids come last. Null and empty texts are copies of each other. An empty
    table gives no rows.
    """
    rows = placed(docs)
    row = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col("__place").alias("place"))
    prints = cut_lineage(wide_fingerprints(rows.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text", shingle))
    classes = cut_lineage(prints.groupBy("fp", "fp2").agg(F.min("row").alias("low")))
    roots = components(link_forest(classes.select("fp", "fp2"), first_radius, tile, radius)).select("node.*", "root")
    rooted = classes.join(roots, ["fp", "fp2"], "left").withColumn("root", F.coalesce("root", F.struct("fp", "fp2")))
    kept = rooted.groupBy("root").agg(F.min("low").alias("low")).select("low")
    return rows.join(kept, row == F.col("low"), "left_semi").select(docs.columns)
