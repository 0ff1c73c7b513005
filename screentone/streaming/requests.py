"""Edit and render requests: the same functions on a stream or on a batch of its rows.

Requests have document_id, generation, setting_key, ts, value. Rows later than the watermark are
dropped, as Spark does; nothing here reads the wall clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screentone.operators import settings
from screentone.sources import artwork

REQUEST_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_requests(spark: SparkSession, directory: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a directory as a stream of requests."""
    s = spark.readStream.schema(REQUEST_SCHEMA).option("pathGlobFilter", pattern).parquet(directory)
    return s.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("generation"), F.col("event_type").alias("setting_key"), F.col("ts").cast("timestamp").alias("ts"), "value")


def latest_requests(requests: DataFrame) -> DataFrame:
    """The request of the highest generation of each document; update or complete mode."""
    return requests.groupBy("document_id").agg(F.max("generation").alias("generation"), F.max_by("setting_key", "generation").alias("setting_key"), F.max_by("value", "generation").alias("value"))


def debounce(requests: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """The last request before each quiet gap: document_id, first_ts, last_ts, n, generation, setting_key.

    On a stream, `watermark` closes gaps; append mode emits closed ones only.
    """
    r = requests.withWatermark("ts", watermark) if watermark else requests
    at = F.struct("ts", "generation")
    s = r.groupBy("document_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("generation", at).alias("generation"), F.max_by("setting_key", at).alias("setting_key"))
    return s.drop("w")


def coalesce_edits(requests: DataFrame, gap: str) -> DataFrame:
    """Consecutive edits of one key without a gap as one edit, from the first value to the last; no-ops drop.

    A change of key ends a gesture. Batch form: islands by a running count of starts within a document.
    """
    w = Window.partitionBy("document_id").orderBy("ts", "generation")
    new = (F.col("setting_key") != F.lag("setting_key").over(w)) | (F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap}"))
    r = requests.withColumn("gesture", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct("ts", "generation")
    g = r.groupBy("document_id", "gesture").agg(F.first("setting_key").alias("setting_key"), F.min_by("value", at).alias("before"), F.max_by("value", at).alias("after"), F.count("*").alias("n"))
    return g.filter("n = 1 OR before <> after")


PENDING = "waiting_at array<long>, waiting_generation array<long>, waiting_key array<string>, waiting_value array<double>"
GESTURE_STATE = f"{PENDING}, gestures long, setting_key string, before double, after double, n long, last_at long"
GESTURES = "document_id long, gesture long, setting_key string, before double, after double, n long"


def coalesce_edits_stream(requests: DataFrame, gap: str, watermark: str) -> DataFrame:
    """The streaming form of coalesce_edits, with the same rows: a gesture ends by a change of key or a gap; append mode.

    Requests may come out of order within the watermark: each document keeps those that the watermark hasn't passed, and
    one open gesture. What is final is folded in order; a gesture is emitted when a later request has ended it or the watermark is a gap beyond it.
    """
    quiet = int(pd.Timedelta(gap.lower()).total_seconds() * 1_000_000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, gestures, edit = [], 0, None
        if state.exists:
            *columns, gestures, name, before, after, n, last = state.get
            waiting = list(zip(*(c or [] for c in columns)))
            edit = [name, before, after, n, last] if n else None
        for part in batches:
            value = [None if missing else v for v, missing in zip(part["value"], part["value"].isna())]
            waiting += zip(part["at"], part["generation"], part["setting_key"], value)
        now = state.getCurrentWatermarkMs() * 1000
        done = []

        def close() -> None:
            name, before, after, n, _ = edit
            if n == 1 or (before is not None and after is not None and before != after):
                done.append((key[0], gestures, name, before, after, n))

        waiting.sort(key=lambda r: r[:2])
        final = sum(r[0] <= now for r in waiting)
        for at, _, name, value in waiting[:final]:
            if edit and edit[0] == name and at < edit[4] + quiet:
                edit[2:] = value, edit[3] + 1, at
                continue
            if edit:
                close()
            edit, gestures = [name, value, value, 1, at], gestures + 1
        waiting = waiting[final:]
        if edit and edit[4] + quiet <= now:
            close()
            edit = None
        columns = [[kind(r[i]) if r[i] is not None else None for r in waiting] for i, kind in enumerate((int, int, str, float))]
        state.update((*columns, gestures, *(edit or [None, None, None, 0, None])))
        wake = ([waiting[0][0]] if waiting else []) + ([edit[4] + quiet] if edit else [])
        if wake:
            state.setTimeoutTimestamp(max(int(now // 1000) + 1, int(-(-min(wake) // 1000))))
        yield pd.DataFrame(done, columns=[f.split()[0] for f in GESTURES.split(", ")])

    r = requests.withWatermark("ts", watermark).select("document_id", "generation", "setting_key", "value", "ts", F.unix_micros("ts").alias("at"))
    return r.groupBy("document_id").applyInPandasWithState(fold, GESTURES, GESTURE_STATE, "append", "EventTimeTimeout")


def drop_stale(results: DataFrame, current: DataFrame, view: list[str] | None = None) -> DataFrame:
    """Results whose generation is the current one of their document; current comes from latest_requests.

    With `view`, columns of both tables, the result's view must be the current one too (null equals null).
    """
    c = current.select("document_id", "generation", *[F.col(v).alias(f"now_{i}") for i, v in enumerate(view or [])])
    same = (results["document_id"] == c["document_id"]) & (results["generation"] == c["generation"])
    for i, v in enumerate(view or []):
        same = same & results[v].eqNullSafe(c[f"now_{i}"])
    return results.join(c, same, "left_semi")


def best_preview(results: DataFrame) -> DataFrame:
    """The preview kept for each document: of the newest version, the largest (ties: the latest generation)."""
    best = F.struct("version", "max_dim", "generation")
    return results.groupBy("document_id").agg(F.max(best).alias("b")).select("document_id", "b.version", "b.max_dim", "b.generation")


def ingest(stream: DataFrame, accepted_path: str, quarantine_path: str, checkpoint: str, available_now: bool = True):
    """Documents (document_id, content) arriving as a stream: parsed, migrated, appended; the rest quarantined.

    Every batch has a partition `epoch` of its own, which a retry writes anew.
    """

    def write(rows: DataFrame, epoch: int, path: str) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    def land(batch: DataFrame, epoch: int) -> None:
        parsed = artwork.parse_documents(batch).persist()
        write(settings.migrate_documents(parsed.filter("accepted")), epoch, accepted_path)
        write(parsed.filter("NOT accepted OR version IS NULL OR version NOT BETWEEN 1 AND 5"), epoch, quarantine_path)
        parsed.unpersist()

    w = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available into a memory table, for tests and small replays."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


