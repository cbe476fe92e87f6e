"""Exact duplicates by sorting the contents.

Normalised bytes are put in one global order: splitters are sampled, rows are dealt
to ranges, and Spark's external sort orders each range, spilling if it must. Equal
texts are neighbours then, and whole texts of neighbours are compared. The order is
by the first bytes of a text, then by its SHA-256, then by id, so splitters are
short however long texts are, and a text that a third of all rows share is split
over as many ranges as it fills. Where it crosses from one range to the next, the
two texts at the border are compared, and only counts and identifiers of such runs
are put together. Texts move once; no table is joined by text.
"""

from __future__ import annotations

import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from vislens.session import cut_lineage

#: Bytes and rows meant for one range.
RANGE_BYTES, RANGE_ROWS = 64 << 20, 1 << 18
#: Leading bytes of a text that are part of the order.
HEAD = 64
#: Kinds of rows: of a run within a range, of a range's first or last run, and the texts at its borders.
INNER, FIRST, LAST, HEAD_TEXT, TAIL_TEXT = range(5)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


class Runs:
    """Runs of equal texts in one sorted range, fed batch by batch; only ids of the open run are held."""

    def __init__(self, part: int, kind: pa.DataType):
        self.part, self.kind = part, kind
        self.text = self.digest = None
        self.ids: list[pa.Array] = []
        self.n_runs = 0
        self.first_text = None

    def feed(self, batch: pa.RecordBatch):
        ids, texts, digests = batch.column(0), batch.column(1), batch.column(2)
        if not len(ids):
            return
        new = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)) if len(texts) > 1 else pa.array([], pa.bool_())
        starts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist())]
        for k, low in enumerate(starts):
            high = starts[k + 1] if k + 1 < len(starts) else len(ids)
            if k or self.text is None or texts[0].as_py() != self.text:
                if self.text is not None:
                    yield self.flush(False)
                self.text, self.digest = texts[low].as_py(), digests[low].as_py()
                if self.first_text is None:
                    self.first_text = self.text
            self.ids.append(ids.slice(low, high - low))

    def flush(self, last: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        kind = FIRST if self.n_runs == 0 else LAST if last else INNER
        self.n_runs += 1
        self.ids = []
        return self.rows(ids, n, kind, ids[0].as_py(), self.digest, None)

    def rows(self, ids, n, kind, keep, digest, text) -> pa.RecordBatch:
        same = lambda v, t: pa.repeat(pa.scalar(v, t), len(ids))
        lead = pa.array([True] + [False] * (len(ids) - 1), pa.bool_())
        columns = [ids, same(keep, self.kind), same(n, pa.int64()), lead, same(digest, pa.string()), same(self.part, pa.int32()), same(kind, pa.int32()), same(text, pa.binary())]
        return pa.record_batch(columns, names=NAMES)

    def close(self):
        if self.text is None:
            return
        yield self.flush(True)
        none = pa.nulls(1, self.kind)
        yield self.rows(none, self.n_runs, HEAD_TEXT, None, None, self.first_text)
        yield self.rows(none, self.n_runs, TAIL_TEXT, None, None, self.text)


NAMES = ["id", "keep", "n", "lead", "digest", "part", "kind", "text"]


def _sorted(docs: DataFrame, id_col: str, text_col: str, range_bytes: int, range_rows: int) -> DataFrame:
    """(id, text, digest) in the global order, a range to a partition."""
    plain = lower_ascii(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), plain.cast("binary").alias("text"), F.sha2(plain.cast("binary"), 256).alias("digest"))
    size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n = max(1, -(-size[0] // range_rows), -(-(size[1] or 0) // range_bytes))
    order = [F.col("head"), F.col("digest"), F.col("id").desc_nulls_last()]
    return rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text", "digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256): one row per row of `docs`.

    Texts are equal if they are identical after lowering A-Z; null counts as
    empty. The row with the largest id stays. Of rows that repeat id and text one
    stays; a null id stays only if its group has no other, and keep_id is null
    then. text_sha256 is of the lowered text in UTF-8. `id_col` may have any type
    that can be ordered. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        runs = None
        for batch in batches:
            runs = runs or Runs(TaskContext.get().partitionId(), batch.column(0).type)
            yield from runs.feed(batch)
        if runs is not None:
            yield from runs.close()

    schema = f"id {kind}, keep {kind}, n bigint, lead boolean, digest string, part int, kind int, text binary"
    found = cut_lineage(_sorted(docs, id_col, text_col, range_bytes, range_rows).mapInArrow(run, schema))
    named = _edges(found)
    own = found.filter(F.col("kind") <= LAST)
    edge = own.filter(F.col("kind") > INNER).join(F.broadcast(named), ["part", "kind"])
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    inner = own.filter(F.col("kind") == INNER).select("*", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("lead").alias("kept"))
    return inner.select(*columns).unionByName(edge.withColumn("kept", F.col("lead") & ~F.col("goes_on")).select(*columns))


def _edges(found: DataFrame) -> DataFrame:
    """(part, kind, keep_id, group_size, goes_on) of the first and last run of every range: two rows a range.

    goes_on says that the run began in an earlier range. All frames here have a
    row or two a range, and only neighbouring border texts meet each other.
    """
    heads = found.filter(F.col("kind") == HEAD_TEXT).withColumn("before", F.lag("part").over(W.orderBy("part")))
    tails = found.filter(F.col("kind") == TAIL_TEXT).select(F.col("part").alias("before"), F.col("text").alias("tail"))
    goes_on = heads.join(tails, "before").filter(F.col("text") == F.col("tail")).select("part", F.lit(FIRST).alias("kind"), F.lit(True).alias("goes_on"))
    runs = found.filter(F.col("kind").isin(FIRST, LAST) & F.col("lead")).select("part", "kind", "n", "keep")
    runs = runs.join(goes_on, ["part", "kind"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    runs = runs.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(W.orderBy("part", "kind")))
    totals = runs.groupBy("run").agg(F.sum("n").alias("group_size"), F.max("keep").alias("keep_id"))
    return runs.join(totals, "run").select("part", "kind", "keep_id", "group_size", "goes_on")
