"""Structured Streaming jobs: snapshot changes, admission limits, alerts once, due stores, findings kept current."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storegrain.operators import findings as N
from storegrain.operators import history as H
from storegrain.operators.rules import KEY, small
from storegrain.sources.tables import landed


class _Changes(StatefulProcessor):
    """Emits a row when a key's hashes differ from the last ones; rows not newer than the last are passed over."""

    def __init__(self, first_sight: bool):
        self.first_sight = first_sight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, content_hash string, dom_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.last.get() if self.last.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            ts = r.ts.to_pydatetime()
            if last is not None and ts <= last[0]:
                continue
            if (self.first_sight if last is None else (r.content_hash, r.dom_hash) != (last[1], last[2])):
                out.append((*key, r.ts, "new" if last is None else "changed"))
            last = (ts, r.content_hash, r.dom_hash)
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["store_id", "url", "ts", "change"])

    def close(self) -> None:
        pass


def snapshot_changes(stream: DataFrame, first_sight: bool = True) -> DataFrame:
    """(store_id, url, ts, change) of a stream of snapshots (store_id, url, ts, content_hash, dom_hash).

    The rows of one page in one micro-batch are sorted in one task; bound the micro-batches of a stream with a hot page.
    """
    return stream.groupBy("store_id", "url").transformWithStateInPandas(_Changes(first_sight), "store_id string, url string, ts timestamp, change string", "Append", "None")


def admit(times: list, limit: int, seconds: float, accepted: list | None = None) -> tuple[list[bool], list]:
    """Whether each time in order is admitted: fewer than limit admitted ones in the seconds before it. Also the admitted times still in the window."""
    window, out = list(accepted or []), []
    for t in times:
        window = [a for a in window if t - a < seconds]
        out.append(len(window) < limit)
        if out[-1]:
            window.append(t)
    return out, window


class _Admission(StatefulProcessor):
    """With timers a key's state goes when its window has passed: the watermark is then behind all that could still count."""

    def __init__(self, limit: int, seconds: float, timers: bool):
        self.limit, self.seconds, self.timers = limit, seconds, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = [x[0] for x in self.accepted.get()] if self.accepted.exists() else []
        ok, window = admit([t.timestamp() for t in b["ts"]], self.limit, self.seconds, before)
        self.accepted.put([(t,) for t in window])
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(int((max(window) + self.seconds) * 1000) + 1)
        yield pd.DataFrame({"key": key[0], "event_id": b["event_id"].to_numpy(), "admitted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        yield pd.DataFrame({"key": [], "event_id": [], "admitted": []}).astype({"key": "int64", "event_id": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


ADMITTED = "key long, event_id long, admitted boolean"


def admissions(stream: DataFrame, limit: int, seconds: float, watermark: str | None = None) -> DataFrame:
    """(key, event_id, admitted) of a stream (key, ts, event_id): at most limit per key in a sliding window; what is rejected is not counted.

    Whether an event is admitted depends on those before it, so one key's events go through one task in order. With a
    watermark events that come later than it are dropped, and a key that is idle for longer than the window leaves no state.
    """
    stream = stream.withWatermark("ts", watermark) if watermark else stream
    return stream.groupBy("key").transformWithStateInPandas(_Admission(limit, seconds, bool(watermark)), ADMITTED, "Append", "EventTime" if watermark else "None")


def admissions_batch(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The same over a whole table. Sorted partitions are read as a stream, a key's window is all that is held, so a hot key needs no memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, []
        for b in batches:
            out = []
            for k, ts, _ in b.itertuples(index=False):
                if k != key:
                    key, window = k, []
                ok, window = admit([ts.timestamp()], limit, seconds, window)
                out += ok
            yield pd.DataFrame({"key": b["key"], "event_id": b["event_id"], "admitted": out})

    return events.select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, ADMITTED)


def alert_once(violations: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """One row per (product_id, rule); with a watermark the state is bounded and the promise holds within it."""
    key = ["product_id", "rule"]
    return violations.withWatermark(time, watermark).dropDuplicatesWithinWatermark(key) if watermark else violations.dropDuplicates(key)


def new_alerts(violations: DataFrame, alerted: DataFrame) -> DataFrame:
    """Violations of products and rules that were not alerted before, each pair once; alerted: product_id, rule."""
    key = ["product_id", "rule"]
    return violations.dropDuplicates(key).join(alerted.select(*key).distinct(), key, "left_anti")


def write_due(triggers: DataFrame, stores: DataFrame, path: str, checkpoint: str):
    """At each micro-batch the list of stores that are due, appended to path."""

    def each(batch: DataFrame, k: int) -> None:
        H.due(stores, F.current_date()).withColumn("batch", F.lit(k)).write.mode("append").parquet(path)

    return triggers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


#: Rows of a micro-batch for each file of a bucket, at most about.
FILE_ROWS = 1_000_000


def keep_current(findings: DataFrame, store: str, parts: str, counts: str, checkpoint: str, buckets: int | None = None):
    """Keeps findings and the partial aggregates of their rollups and scores: each micro-batch appends its own and reads no other.

    What a batch adds is a row for each group, page and example, and one for each kind and severity of a run, so no
    more is read or written than the batch has. `current_rollups` and `current_scores` add the parts up, `compact` makes one part
    of many. The tables are partitioned by run and batch, or, with `buckets`, by that many hashes of the run and batch: a batch of many
    runs then writes a few files a bucket, not one or more a run. A batch that is run again after a failure writes its own files anew.
    Impact columns that the scores need are added by with_impact where findings lack them.
    """
    folders = ["bucket", "batch"] if buckets else [*KEY, "batch"]

    def each(batch: DataFrame, k: int) -> None:
        def out(df: DataFrame, path: str, share: list[str]) -> None:
            df = df.withColumn("batch", F.lit(k).cast("long"))
            if buckets:
                df = df.withColumn("bucket", _bucket(buckets)).repartition("bucket", F.pmod(F.xxhash64(*share), F.lit(files)))
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)

        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            files = 1 + batch.count() // (FILE_ROWS * buckets) if buckets else 1
            out(batch, store, ["seq"])
            out(N.finding_parts(batch), parts, ["value", "page_url", "example"])
            out(N.score_counts(batch if "impact_tier" in batch.columns else N.with_impact(batch)), counts, ["kind", "severity"])
        finally:
            batch.unpersist()

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(spark: SparkSession, path: str, runs: DataFrame | None, buckets: int | None) -> DataFrame:
    """A table of keep_current, of as many buckets, without batches; of the given runs, if any, whose folders alone are read."""
    t = spark.read.parquet(path).drop("batch")
    t = t.withColumns({c: F.col(c).cast("string") for c in KEY})  # names of folders are read as what they look like
    if runs is not None:
        wanted = runs.select(*KEY).distinct()
        t = t.join(small(wanted.withColumn("bucket", _bucket(buckets)) if buckets else wanted), [*KEY, "bucket"] if buckets else KEY, "left_semi")
    return t.drop("bucket")


def current_rollups(spark: SparkSession, store: str, parts: str, runs: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """rolled_up of all findings so far, from their parts."""
    return N.rolled_from(N.merged_parts(_kept(spark, parts, runs, buckets)), _kept(spark, store, runs, buckets))


def current_scores(spark: SparkSession, counts: str, runs: DataFrame, buckets: int | None = None) -> DataFrame:
    """risk_score of all findings so far of the given runs (key, failed)."""
    return N.score_of(runs, _kept(spark, counts, runs, buckets))


def compact(spark: SparkSession, parts: str, runs: DataFrame, buckets: int | None = None) -> None:
    """Makes one batch of the parts of finished runs: the merged ones are written as batch -1, then the folders they came from are dropped.

    With buckets, the whole buckets that the runs are in become one batch.
    """
    key = ["bucket"] if buckets else KEY
    wanted = (runs.select(_bucket(buckets).alias("bucket")) if buckets else runs.select(*KEY)).distinct()
    old = spark.read.parquet(parts)
    old = old.withColumns({c: F.col(c).cast("string") for c in KEY}).join(small(wanted), key, "left_semi")
    folders = sorted({f.rpartition("/")[0] for f in old.inputFiles()} if old.limit(1).count() else ())
    touched = {tuple(map(str, r)) for r in old.select(*key).distinct().collect()}  # the runs given, or buckets
    merged = landed(N.merged_parts(old).withColumn("batch", F.lit(-1).cast("long")), "compacted")
    if buckets:
        merged = merged.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key, "batch").parquet(parts)
    for f in folders:
        names = dict(x.split("=", 1) for x in f.split("/") if "=" in x)
        if tuple(unquote(names[c]) for c in key) in touched and names["batch"] != "-1":
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_to_end(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Writes all that a stream has now as Parquet, and reads it."""
    out = prepare(stream) if prepare else stream
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
