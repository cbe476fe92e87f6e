"""Benchmark decontamination by containment MinHash, in DataFrame operations only.

A test item of some dozen words inside a document of thousands has a Jaccard
similarity near zero, so signatures of whole documents would miss it. The
signature is therefore taken from the small side alone: each item keeps its
minimum shingle hashes under a permutation that its size partition draws, and a
document is a candidate if it holds one of them. The partition's upper bound u
fixes the length of the signature, u - ceil(t * u) + 1. A document that contains
a share t of an item lacks fewer of its shingles than that, so no true pair is
missed. Candidates are then verified by counting the item's distinct shingles in
the whole document. An item shorter than a shingle has its whole sequence of words
as its only one, and documents are searched for sequences of that length too.

Items are sent to the documents in a few blocks of bounded size, so the corpus's
shingles are not shuffled. Each block is a pass over the corpus: a benchmark of
more than MOST_BLOCKS meets the shingles in a shuffle instead.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislens.session import cut_lineage

#: Rows of the items' side that are broadcast at once, at some 100 bytes each.
BLOCK_ROWS = 50_000
#: Blocks that are broadcast; each costs a pass over the corpus.
MOST_BLOCKS = 8


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def _both(words: Column, i: Column, size: int) -> Column:
    return F.struct(_hash(words, i, size).alias("h"), F.concat_ws(" ", F.slice(words, i + 1, size)).alias("s"))


def _shingles(words: str, sizes: list[int], make) -> Column:
    """make(words, i, size) at every start of a shingle of each of the sizes; no such shingle for fewer words."""
    w = F.col(words)

    def of(k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: make(w, i, k))

    return F.concat(*map(of, sizes)) if len(sizes) > 1 else of(sizes[0])


def item_shingles(items: DataFrame, item_id: str, text_col: str, size: int) -> DataFrame:
    """(item, k, h, s): the distinct shingles of each item, of k words, with their hashes."""
    words = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words_of(F.col(text_col)).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(size)))
    own = F.coalesce(*[F.when(F.col("k") == k, _shingles("w", [k], _both)) for k in range(1, size + 1)])
    return words.select("item", "k", F.explode(own).alias("x")).select("item", "k", "x.h", "x.s").distinct()


def signatures(shingles: DataFrame, share: float) -> DataFrame:
    """(item, n, need, h): the minimum hashes of each item, as many as its size partition asks for."""
    sizes = shingles.groupBy("item").agg(F.collect_list("h").alias("hs"))  # one item's own shingles
    n = F.size("hs")
    sizes = sizes.select("item", n.alias("n"), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int").alias("upper"), "hs")
    order = F.sort_array(F.transform("hs", lambda h: F.struct(F.xxhash64(h, F.col("upper")).alias("r"), h.alias("h"))))
    length = F.col("upper") - F.ceil(F.round(F.col("upper") * share, 6)) + 1
    need = F.ceil(F.round(F.col("n") * share, 6)).cast("int")
    return sizes.select("item", "n", need.alias("need"), F.explode(F.slice(order["h"], F.lit(1), F.least(length.cast("int"), F.col("n")))).alias("h"))


def _blocks(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in `n` blocks, dealt by shingle and item, so that a shingle of many items is in many blocks."""
    return [rows.filter(F.pmod(F.xxhash64("h", "item"), F.lit(n)) == k) for k in range(n)]


def _meeting(spoken: DataFrame, rows: DataFrame, on: list[str], columns: list[str], block_rows: int) -> DataFrame:
    """Distinct `columns` of documents' shingles joined with items' `rows`, which are sent in blocks or, if that takes too many, shuffled."""
    n = max(1, math.ceil(rows.count() / block_rows))
    if n > MOST_BLOCKS:
        return spoken.join(rows, on).select(columns).distinct()
    out = [spoken.join(F.broadcast(b), on).select(columns).distinct() for b in _blocks(rows, n)]
    return reduce(DataFrame.unionByName, out)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    share: float = 0.8,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): items of whose distinct shingles a document holds `share` or more.

    A shingle is `size` words, or all words of a shorter item. Null and empty texts
    have none. Rows that share an id are one item or one document, their shingles
    taken together; rows with a null id are left out. Other columns are not read,
    on either side. Without items or documents there are no rows.
    """
    shingles = cut_lineage(item_shingles(items, item_id, item_text, size))
    signed = cut_lineage(signatures(shingles, share))
    sizes = [r.k for r in shingles.select("k").distinct().collect()] or [size]  # lengths of shingles, `size` at most
    words = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), words_of(F.col(doc_text)).alias("w"))
    hashes = words.select("doc", F.explode(_shingles("w", sizes, _hash)).alias("h"))
    pairs = cut_lineage(_meeting(hashes, signed, ["h"], ["doc", "item"], block_rows).distinct())

    held = words.join(pairs.select("doc").distinct(), "doc", "left_semi")
    spoken = held.select("doc", F.explode(_shingles("w", sizes, _both)).alias("x")).select("doc", "x.h", "x.s")
    wanted = shingles.join(pairs.select("item").distinct(), "item", "left_semi")
    found = _meeting(spoken, wanted, ["h", "s"], ["doc", "item", "s"], block_rows)
    counts = found.join(pairs, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.count("*").cast("int").alias("n_found"))
    return (
        counts.join(signed.select("item", "n", "need").distinct(), "item")
        .filter("n_found >= need")
        .select(
            F.col("doc").alias(doc_id),
            F.col("item").alias(item_id),
            F.col("n").alias("n_shingles"),
            "n_found",
            (F.col("n_found") / F.col("n")).alias("containment"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """`docs` without those that contain an item; rows with a null id stay."""
    gone = contained_items(docs, items, doc_id, **how).select(doc_id).distinct()
    return docs.join(gone, doc_id, "left_anti")
