"""Ranked lexical search by a dual-tree walk.

Items and documents are vectors over the items' terms: an item has its terms'
weights times their counts, a document the damped frequency of each term. Both
sides are halved again and again along their main direction; a node keeps the
maximum of every coordinate. The product of two nodes' maxima bounds the score of
every pair below them, so if it doesn't exceed the weakest kth score of the node's
items, the whole batch of pairs is left out, exactly. What is left at the leaves is
scored by small matrix products, best bounds first. Scores are integers and are
computed as such: their sums stay below 2**53, or go through 64-bit integers.

Corpus counts (documents, terms, documents holding a term) are Spark aggregates of
one table of term frequencies, which is all that the search reads. A first share of
the documents is searched to learn a kth score for every item; the rest starts from
it, so a task hands on few rows an item however many documents there are. Every
document is in one of the two.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.session import cut_lineage

#: Bytes of item texts in one pass over the corpus. They and their terms are sent to every task.
PASS_BYTES = 1 << 20
#: Items of a block at most, and the terms at which it is closed.
BLOCK_ITEMS, BLOCK_TERMS = 256, 8192
#: Numbers in a matrix of documents.
CELLS = 1 << 24
LEAF_DOCS, LEAF_ITEMS = 64, 8
#: One part of so many is searched first.
FIRST_SHARE = 32
#: Stands for a null id, which comes last among equal scores.
NO_ID = np.iinfo(np.int64).max

# Every byte that isn't part of a term becomes a blank; bytes from 0x80 on are parts of letters.
PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damped(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """Rows of a matrix in an order that keeps near rows together, and the coordinate maxima of its nodes.

    Level l has 2**l nodes; node i covers rows edges[l][i] to edges[l][i + 1] of the order.
    """

    def __init__(self, x: np.ndarray, leaf: int, scale: np.ndarray | None = None):
        n = len(x)
        self.order = np.arange(n)
        self.edges = [np.array([0, n])]
        near = x * scale if scale is not None else x.copy()
        for _ in range(int(math.log2(n / leaf)) if n > leaf else 0):
            old = self.edges[-1]
            mid = (old[:-1] + old[1:]) // 2
            for a, m, b in zip(old[:-1], mid, old[1:]):
                pick = np.argpartition(along(near[a:b]), m - a)
                near[a:b] = near[a:b][pick]
                self.order[a:b] = self.order[a:b][pick]
            self.edges.append(np.sort(np.concatenate([old, mid])))
        self.x = x[self.order]
        self.maxima = [np.maximum.reduceat(self.x, self.edges[-1][:-1], axis=0)]
        while len(self.maxima[0]) > 1:
            self.maxima.insert(0, np.maximum(self.maxima[0][::2], self.maxima[0][1::2]))

    def lowest(self, values: np.ndarray) -> list[np.ndarray]:
        """Per level, the minimum of values (in the tree's order) of every node."""
        out = [np.minimum.reduceat(values, self.edges[-1][:-1])]
        while len(out[0]) > 1:
            out.insert(0, np.minimum(out[0][::2], out[0][1::2]))
        return out


def along(x: np.ndarray) -> np.ndarray:
    """Places of rows along the direction in which they differ most, roughly."""
    c = x - x.mean(0)
    v = c[np.argmax(np.einsum("ij,ij->i", c, c))]
    for _ in range(2):
        v = (c @ v) @ c
        v = v / max(float(np.abs(v).max()), 1e-30)
    return c @ v


class Block:
    """Items as a tree over their own terms; `columns` maps the pass's terms to the block's, -1 for others."""

    def __init__(self, numbers: np.ndarray, counts: list[dict[int, int]], weights: np.ndarray):
        own = sorted({t for c in counts for t in c})
        self.columns = np.full(len(weights), -1, np.int32)
        self.columns[own] = np.arange(len(own))
        q = np.zeros((len(counts), len(own)), np.int64)
        for i, c in enumerate(counts):
            for t, n in c.items():
                q[i, self.columns[t]] = n * int(weights[t])
        #: sums of products are whole numbers that doubles hold exactly
        self.exact = int(q.sum(1).max()) * 10**6 < 2**53
        self.tree = Tree(q.astype(np.float64 if self.exact else np.int64), LEAF_ITEMS)
        self.numbers = numbers[self.tree.order]
        self.scale = q.max(0).astype(np.float32)
        ends = self.tree.edges[-1]
        self.leaves = []
        for a, b in zip(ends[:-1], ends[1:]):
            terms = np.flatnonzero(self.tree.x[a:b].any(0))
            self.leaves.append((a, b, terms, self.tree.x[a:b][:, terms].T.copy()))
        self.tree.x = None  # the leaves have it


class Search:
    """The k best documents of every item of a pass; `limits` are kth scores and ids that something else has reached already."""

    def __init__(self, blocks: list[Block], n_items: int, k: int, limits: tuple[np.ndarray, np.ndarray] | None = None):
        self.blocks, self.k = blocks, k
        self.score, self.id = (x.copy() for x in limits) if limits else (np.zeros(n_items, np.int64), np.full(n_items, NO_ID))
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pairs = 0  # leaf pairs scored, of which there are `offered`
        self.offered = 0

    def feed(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray):
        """Documents by their terms: row numbers ids, `value` is the damped frequency of `term` there; rows ascend."""
        for block in self.blocks:
            column = block.columns[term]
            held = column >= 0
            r, c, v = row[held], column[held], value[held]
            docs, r = np.unique(r, return_inverse=True)
            width = len(block.scale)
            step = max(1, CELLS // width)
            for low in range(0, len(docs), step):
                high = min(len(docs), low + step)
                a, b = np.searchsorted(r, (low, high))
                x = np.zeros((high - low, width), np.float32)  # values up to a million are exact
                x[r[a:b] - low, c[a:b]] = v[a:b]
                self._walk(block, x, ids[docs[low:high]])

    def _walk(self, block: Block, x: np.ndarray, ids: np.ndarray):
        docs = Tree(x, LEAF_DOCS, block.scale)
        ids = ids[docs.order]
        first_id = docs.lowest(ids)
        depth = max(len(docs.maxima), len(block.tree.maxima))
        alive = np.ones((1, 1), bool)
        for level in range(depth):
            dl, il = min(level, len(docs.maxima) - 1), min(level, len(block.tree.maxima) - 1)
            if level:
                alive = np.repeat(np.repeat(alive, 2 if dl == level else 1, 0), 2 if il == level else 1, 1)
            rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                return
            bound = np.zeros(alive.shape)
            bound[np.ix_(rows, cols)] = docs.maxima[dl][rows].astype(np.float64) @ block.tree.maxima[il][cols].T.astype(np.float64)
            if not block.exact:
                bound *= 1 + 1e-9
            weakest = block.tree.lowest(self.score[block.numbers])[il]
            latest = -block.tree.lowest(-self.id[block.numbers])[il]
            alive &= self._open(bound, weakest[None, :], first_id[dl][:, None], latest[None, :])
        self.offered += alive.size
        ends = docs.edges[-1]
        at = np.argwhere(alive)
        for d, i in at[np.argsort(-bound[alive], kind="stable")]:
            a, b, terms, q = block.leaves[i]
            own = block.numbers[a:b]
            if not self._open(bound[d, i], self.score[own].min(), first_id[-1][d], self.id[own].max()):
                continue
            self.pairs += 1
            part = docs.x[ends[d] : ends[d + 1]][:, terms].astype(q.dtype)
            scores = (part @ q).astype(np.int64)
            here = ids[ends[d] : ends[d + 1], None]
            good = (scores > 0) & ((scores > self.score[own]) | ((scores == self.score[own]) & (here < self.id[own])))
            for j in np.flatnonzero(good.any(0)):
                self._take(int(own[j]), scores[good[:, j], j], here[good[:, j], 0])

    @staticmethod
    def _open(bound, weakest, first_id, latest):
        """Whether a pair under the bound could still enter: by a higher score, or by an equal one and a smaller id."""
        return (bound > 0) & ((bound > weakest) | ((bound == weakest) & (first_id < latest)))

    def _take(self, item: int, scores: np.ndarray, ids: np.ndarray):
        if item in self.best:
            s, i = self.best[item]
            scores, ids = np.concatenate([s, scores]), np.concatenate([i, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        scores, ids = scores[order], ids[order]
        self.best[item] = (scores, ids)
        if len(scores) == self.k:
            self.score[item], self.id[item] = scores[-1], ids[-1]


class Pass:
    """Items that are searched together: bounded in bytes, so they can be sent to every task."""

    def __init__(self, texts: list[bytes]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.counts = [Counter(number(t, len(self.vocabulary)) for t in terms_of(text)) for text in texts]

    def blocks(self, weights: np.ndarray) -> list[Block]:
        out, own, seen = [], [], set()
        for i, c in enumerate(self.counts):
            if own and (len(own) == BLOCK_ITEMS or len(seen | c.keys()) > BLOCK_TERMS):
                out.append(own)
                own, seen = [], set()
            if c:
                own.append(i)
                seen |= c.keys()
        return [Block(np.array(o), [self.counts[i] for i in o], weights) for o in [*out, own] if o]


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document that has a term: n counts all its terms, terms and tfs those of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = known.value.get
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                counts = Counter(map(number, words))
                counts.pop(None, None)
                n.append(len(words))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>").filter("n > 0")


def _best_of(docs: DataFrame, blocks, n_items: int, k: int, limits=None) -> DataFrame:
    """(item, doc, score): of each partition of (id, m, terms, tfs), what is among the k best of its item there and beats the limits."""
    sent = docs.sparkSession.sparkContext.broadcast((blocks, limits))

    def run(batches: Iterator[pa.RecordBatch]):
        search = None
        for batch in batches:
            if search is None:
                search = Search(sent.value[0], n_items, k, sent.value[1])
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            m, terms, tfs = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            row = terms.value_parent_indices().to_numpy()
            tf = tfs.flatten().to_numpy().astype(np.int64)
            search.feed(ids, row, terms.flatten().to_numpy(), damped(tf, m[row]))
        for item, (scores, ids) in (search.best if search else {}).items():
            yield pa.record_batch([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item", "doc", "score"])

    return docs.select("id", "m", "terms", "tfs").mapInArrow(run, "item int, doc bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_pass(docs: DataFrame, texts: list[bytes], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, doc, score, rank): item is the place in `texts`."""
    own = Pass(texts)
    table = cut_lineage(frequencies(docs, own.vocabulary, id_col, text_col))
    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not own.vocabulary:
        return None
    weights = np.full(len(own.vocabulary), weight(n_docs, 0), np.int64)
    for t, df in table.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the pass
        weights[t] = weight(n_docs, df)
    blocks = own.blocks(weights)
    length = F.expr(f"75 + cast((cast(25 as decimal(3,0)) * cast(n as decimal(15,0)) * cast({n_docs} as decimal(18,0))) div cast({n_terms} as decimal(20,0)) as bigint)")
    rows = table.filter(F.size("terms") > 0).select("id", length.alias("m"), "terms", "tfs")
    part = F.pmod(F.xxhash64("id", "m", "terms"), F.lit(FIRST_SHARE))
    first = cut_lineage(_ranked(_best_of(rows.filter(part == 0), blocks, len(texts), k), k))
    limits = (np.zeros(len(texts), np.int64), np.full(len(texts), NO_ID))
    for item, doc, score in first.filter(F.col("rank") == k).select("item", "doc", "score").toLocalIterator():  # a row an item of the pass
        limits[0][item], limits[1][item] = score, NO_ID if doc is None else doc
    rest = _best_of(rows.filter(part != 0), blocks, len(texts), k, limits)
    return _ranked(first.drop("rank").unionByName(rest), k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item by score, then by ascending id, scores above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lowered.
    `doc_id` is an integer column. Null and empty texts have no terms: such
    documents count nowhere, such items have no rows. Documents with a null id
    count and rank like others, last among equal scores; rows that repeat an id
    are documents of their own. Items with equal texts are searched once; each
    row of `items` has its own ranks, a null item_id too. Other columns are not
    read. Without documents or items there are no rows.

    The corpus is read once for `pass_bytes` of distinct item texts (a longer one
    has a pass of its own); these texts and their vectors are sent to every task.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    keyed = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.sha2(F.col(item_text).cast("binary"), 256).alias("key"))
    texts = cut_lineage(keyed.filter("text <> ''").groupBy("key").agg(F.first("text").alias("text")))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes)
    named = []
    for p in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == p).orderBy("key").toArrow()
        if not rows.num_rows:
            continue
        found = _search_pass(docs, [t.as_py().encode() for t in rows["text"]], k, doc_id, doc_text)
        if found is None:
            continue
        keys = spark.createDataFrame(list(enumerate(rows["key"].to_pylist())), "item int, key string")
        named.append(found.join(F.broadcast(keys), "item").select("key", "rank", "doc", "score"))
    if not named:
        named = [spark.createDataFrame([], "key string, rank int, doc bigint, score bigint")]
    found = named[0]
    for more in named[1:]:
        found = found.unionByName(more)
    out = keyed.select("item_id", "key").join(found, "key")
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("doc").cast(id_type).alias(doc_id), "score")
