"""Streaming forms of the log metrics, and a bounded runner for them."""

from __future__ import annotations

import contextlib
import threading
import warnings
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vislens.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LateRows(StreamingQueryListener):
    """Sums, over every update of every query, the rows dropped for lying behind a watermark."""

    def __init__(self):
        self.dropped: Counter = Counter()
        self.ended: defaultdict = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.runId)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def of(self, query, timeout: float = 60) -> int:
        """Of a finished query; its updates come in order, so all are in once its end is."""
        if not self.ended[str(query.runId)].wait(timeout):
            raise TimeoutError("the end of the query was not reported")
        return self.dropped[str(query.runId)]


@contextlib.contextmanager
def counting_late(spark: SparkSession):
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def follow(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drains what is available into `path`, a folder for each batch; the finished query. A batch that runs again replaces its own folder."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    w = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def last_writes(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str | None = None) -> DataFrame:
    """The snapshot of a table that `follow` has written: of each key the row of highest `order`, then of the latest batch."""
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(stored).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), "batch"))
    return rows.groupBy(*keys).agg(last.alias("__r")).select(*keys, "__r.*").select(schema.names)


def drain(stream: DataFrame, keys: list[str] | None = None, order: str | None = None) -> tuple[DataFrame, int]:
    """Runs what is available into a table; (table, late rows).

    Rows are appended, or with `keys` the table is a snapshot of last writes: a
    stream in update mode sends only groups that have changed, and the last write
    of a key is what counts, or that of highest `order`.
    """
    spark = stream.sparkSession
    base = shared_dir(spark)
    with rocksdb(spark), counting_late(spark) as late:
        q = follow(stream, f"{base}/out", f"{base}/ckpt", "update" if keys and not order else "append")
        dropped = late.of(q)
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")  # a stream without data writes none
    if keys:
        return last_writes(spark, f"{base}/out", stream.schema, keys, order), dropped
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(stream.columns), dropped


def run_to_table(stream: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """As `drain`; rows that came too late are told of in a warning."""
    out, late = drain(stream, keys, order)
    if late:
        warnings.warn(f"{late} rows were behind the watermark and are not in the result", stacklevel=2)
    return out


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(sf_dir)


def prr_stream(log: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    """Hits and queries per tumbling window; log: ts, hit. For update mode: closed windows leave the state."""
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
        .select(F.col("w.start").alias("start"), "n", "hits")
    )


class StaleReads(StatefulProcessor):
    """Returns of an item while it is withdrawn, as changes: +1 reports one, -1 takes a report back.

    The state of an item is its changes of visibility: those newer than the
    watermark and the last one before it, so a withdrawal counts however long ago
    it was. Returns newer than the watermark are kept too, with what was reported
    of them: a change of visibility that comes after them, but lies before them,
    can make them stale, fresh again, or stale since another instant.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("item", "changes array<struct<t_us:long,kind:int>>, returns array<struct<t_us:long,probe:long,told_us:long>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        changes = {(c[0], c[1]) for c in held[0]} if held else set()
        returns = {(r[0], r[1]): r[2] for r in held[1]} if held else {}
        for r in rows:
            if r["kind"] == "return":
                returns.setdefault((r["t_us"], r["probe"]), None)
            else:
                # at one instant the withdrawal is what counts
                changes.add((r["t_us"], 1 if r["kind"] == "withdraw" else 0))
        order, out = sorted(changes), []
        for (t, probe), told in sorted(returns.items()):
            k = bisect_right(order, (t, 1))
            since = order[k - 1][0] if k and order[k - 1][1] == 1 else None
            if since != told:
                for change, at in ((-1, told), (1, since)):
                    if at is not None:
                        out.append(Row(item_id=key[0], probe=probe, t_us=t, withdrawn_us=at, change=change))
                returns[t, probe] = since
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        old = [c for c in order if c[0] <= mark]
        kept = old[-1:] + [c for c in order if c[0] > mark]
        fresh = [(t, p, told) for (t, p), told in returns.items() if t > mark]
        if kept or fresh:
            self.state.update((kept, fresh))
        else:
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def stale_read_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """events: item_id, ts, t_us, kind (withdraw|readmit|return), probe. Changes (item_id, probe, t_us, withdrawn_us, change) of the stale returns."""
    out = "item_id long, probe long, t_us long, withdrawn_us long, change int"
    return events.withWatermark("ts", lateness).groupBy("item_id").transformWithState(StaleReads(), out, "Append", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """The reports that no later change has taken back."""
    rows = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*rows).agg(F.sum("change").alias("n")).filter("n > 0").drop("n")
