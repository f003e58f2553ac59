"""The lifecycle log as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType, TimestampType

from scanloom.operators.lifecycle import ACTIVE_STAGES, STALE_MESSAGE, counter_rates, counts_by_stage, latest_state


def read_event_stream(spark: SparkSession, path: str, schema: Any, per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    )


def order_files(spark: SparkSession, path: str) -> None:
    """Give the data files of a folder rising times: those of an earlier write first, then by name.

    A stream takes files by time, and those of one write come about in any order. Only names and times pass
    through the driver, one per file. Needs a store that can set times (not an object store).
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in files.listStatus(place) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    writes = {}  # a write's files share the end of their names
    for status in found:
        writes.setdefault(status.getPath().getName().split("-", 2)[-1], []).append(status)
    ordered = sorted(writes.values(), key=lambda w: max(s.getModificationTime() for s in w))
    start = min((s.getModificationTime() for s in found), default=0) // 1000 * 1000
    at = 0
    for write in ordered:
        for status in sorted(write, key=lambda s: s.getPath().getName()):
            files.setTimes(status.getPath(), start + 1000 * at, -1)
            at += 1


def latest_state_stream(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last event per key as a running aggregate; each micro-batch combines before its shuffle."""
    return latest_state(events, key, order)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, key: str) -> DataFrame:
    """Drain what is available and return the newest row of every key.

    Every micro-batch writes only the keys that changed, into a folder of its own, so that a repeated batch
    replaces itself; ``newest`` puts them together and ``compact`` folds a long history.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    (
        stream.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return newest(spark, path, key, schema)


def newest(spark: SparkSession, path: str, key: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The last row of every key, of all micro-batches or as it was after batch ``upto``."""
    fields = [f for f in schema.fields if f.name != "batch"]
    rows = spark.read.schema(StructType([*fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    rest = [f.name for f in fields if f.name != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(key, "_last.*").select(*[f.name for f in fields])


def compact(spark: SparkSession, path: str, to: str, key: str, schema: StructType, upto: int) -> None:
    """Write the state after batch ``upto`` to ``to`` as one batch of that number, in place of its history."""
    newest(spark, path, key, schema, upto).write.parquet(f"{to}/batch={upto:012d}")


def stage_changes_stream(events: DataFrame, key: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The change log of a count by stage: rows (stage, n), -1 for the stage that a key leaves, 1 for its new one.

    State is one row per key: its last stage and place in ``order``, columns that compare as numbers or times. A
    later place wins; an event before a key's last one changes nothing, nor does one that keeps the stage. A
    null in the order comes first, a null stage is ``unknown``, and events that tie take the last stage in the alphabet.
    """
    places = [_place(events, c).alias(f"_{i}") for i, c in enumerate(order)]
    stage = F.coalesce(F.col("stage").cast("string"), F.lit("unknown")).alias("stage")
    rows = events.select(F.col(key).alias("_key"), stage, *places)
    names = [f"_{i}" for i in range(len(order))]

    def follow(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        was = last
        for batch in batches:
            for row in zip(*(batch[c] for c in names), batch["stage"]):
                *place, stage = row
                told = (*map(int, place), stage)
                last = told if last is None else max(last, told)
        state.update(last)
        if was is None:
            yield pd.DataFrame({"stage": [last[-1]], "n": [1]})
        elif was[-1] != last[-1]:
            yield pd.DataFrame({"stage": [was[-1], last[-1]], "n": [-1, 1]})

    return rows.groupBy("_key").applyInPandasWithState(
        follow, "stage string, n long", ", ".join([*(f"{c} long" for c in names), "stage string"]),
        "update", GroupStateTimeout.NoTimeout,
    )


def _place(events: DataFrame, name: str) -> Column:
    """A number or time as a long, nulls before everything."""
    kind = events.schema[name].dataType
    value = F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType)) else F.col(name).cast("long")
    return F.coalesce(value, F.lit(-(2**63)))


def stage_counts_stream(
    events: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Series per stage after the stream's newest micro-batch; ``counts_after`` tells those after earlier ones.

    A micro-batch reads its own change log, one or two rows per changed key, and the counts before it, one row
    per stage, and writes the counts after it: a repeated batch replaces itself, and no history is counted again.
    """
    spark = events.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        before = counts_after(spark, path, batch_id - 1)
        # A stage without series is gone; stages are a small vocabulary, so one file is enough.
        both = before.unionByName(batch).groupBy("stage").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
        both.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    (
        stage_changes_stream(events, key, order).writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return counts_after(spark, path)


def counts_after(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """Series per stage after ``batch``, or after the newest one; none before the first."""
    schema = "stage string, n long"
    if batch is None:
        done = _batches(spark, path)
        batch = done[-1] if done else -1
    if batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch:012d}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches that have written their folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def counts_at(spark: SparkSession, path: str, key: str, schema: StructType, batch: int) -> DataFrame:
    """Series per stage as a table of ``run_to_table`` had them after ``batch``."""
    return counts_by_stage(newest(spark, path, key, schema, batch))


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Append-only history: every event once, as Parquet."""
    return (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stale_stream(
    events: DataFrame, timeout: str = "10 minutes", lateness: str = "1 minute",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Emit a series once its active stage has been silent, in event time, for ``timeout``.

    A session of a series ends after that silence; its stage is that of the last event by ``order``. Each
    silence is emitted once, also if the series goes on later. Events later than ``lateness`` are left out.
    Columns: series_uid_hash, stage, last_seen, message.
    """
    watched = events.withWatermark("ts", lateness)
    sessions = watched.groupBy(F.session_window("ts", timeout), "series_uid_hash").agg(
        F.max_by("stage", F.struct(*order)).alias("stage"), F.max("ts").alias("last_seen")
    )
    return sessions.filter(F.col("stage").isin(*ACTIVE_STAGES)).select(
        "series_uid_hash", F.lit("interrupted").alias("stage"), "last_seen",
        F.lit(STALE_MESSAGE).alias("message"),
    )


def rates_stream(
    samples: DataFrame, counters: Sequence[str], key: str, order: Sequence[str], lateness: str = "1 hour",
) -> DataFrame:
    """Per-second change of counters since the key's sample before, by event time.

    ``order`` is the time and further whole-number columns. A sample waits in its key's state until the
    watermark, ``lateness`` behind the newest time seen, has passed it; by then all that may come before it is
    there, whatever the order of arrival. It is then given out with its rates, and the last one so given out is the
    next one's predecessor. A sample later than that is left out. A key's state is its samples of the last
    ``lateness`` and one more. A sample without a time has the rates 0 at once; the first of a key and one at the
    same time as its predecessor have 0 too.
    """
    ts, *ties = order
    rates = [f"{c}_per_second" for c in counters]
    rows = samples.withWatermark(ts, lateness).select(
        F.col(key), F.col(ts), F.unix_micros(F.col(ts)).alias("_at"), *[F.col(c).cast("long").alias(c) for c in ties],
        *[F.col(c).cast("double").alias(c) for c in counters],
    )
    kept = ["_at", *ties, *counters]
    kinds = ["long", *["long"] * len(ties), *["double"] * len(counters)]
    state_schema = ", ".join(
        [f"{c} array<{kind}>" for c, kind in zip(kept, kinds)] + [f"last_{c} double" for c in counters] + ["last__at long"]
    )
    kinds_of = dict(samples.dtypes)
    made = f"{key} {kinds_of[key]}, _at long, " + ", ".join(
        [f"{c} long" for c in ties] + [f"{c} double" for c in [*counters, *rates]]
    )

    def shaped(key_value: object, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{key: key_value})[[key, *kept, *rates]]

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, last = [[] for _ in kept], None
        if state.exists:
            held = tuple(state.get)
            columns = [list(values) for values in held[: len(kept)]]
            *values, at = held[len(kept) :]
            last = None if at is None else (at, values)
        waiting = pd.DataFrame(dict(zip(kept, columns)))
        timed_out = state.hasTimedOut
        if not timed_out:
            fresh = pd.concat([batch[kept] for batch in batches], ignore_index=True)
            untimed = fresh[fresh["_at"].isna()]
            if len(untimed):
                yield shaped(group[0], untimed.assign(**{r: 0.0 for r in rates}))
            waiting = pd.concat([waiting, fresh[fresh["_at"].notna()]]) if len(waiting) else fresh[fresh["_at"].notna()]
        waiting = waiting.astype({c: "Int64" for c in ties} | {"_at": "int64"} | {c: "float64" for c in counters})
        waiting = waiting.sort_values(["_at", *ties], kind="stable", na_position="first")
        passed = state.getCurrentWatermarkMs() * 1000
        due = waiting[waiting["_at"] <= passed] if passed > 0 else waiting[:0]
        rest = waiting[len(due) :]
        if len(due):
            at = due["_at"].to_numpy()
            elapsed = np.diff(at, prepend=at[0] if last is None else last[0]) / 1e6
            told = {}
            for i, c in enumerate(counters):
                value = due[c].to_numpy()
                change = np.diff(value, prepend=value[0] if last is None else last[1][i])
                rate = np.divide(change, elapsed, out=np.zeros(len(due)), where=elapsed > 0)
                told[f"{c}_per_second"] = np.where(np.isnan(rate), 0.0, rate)
            yield shaped(group[0], due.assign(**told))
            last = (int(at[-1]), [float(due[c].iloc[-1]) for c in counters])
        own = [rest["_at"].tolist(), *[[None if v is pd.NA else int(v) for v in rest[c]] for c in ties], *[rest[c].tolist() for c in counters]]
        state.update((*own, *(last[1] if last else [None] * len(counters)), last[0] if last else None))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["_at"].iloc[0]) // 1000, state.getCurrentWatermarkMs()) + 1)

    found = rows.groupBy(key).applyInPandasWithState(
        follow, made, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(key, F.timestamp_micros("_at").alias(ts), *ties, *counters, *rates)


def waiting_rates(
    spark: SparkSession, checkpoint: str, counters: Sequence[str], key: str, order: Sequence[str]
) -> DataFrame:
    """The samples that still wait in the state of a ``rates_stream``, with the rates they have if nothing comes before."""
    ts, *ties = order
    kept = ["_at", *ties, *counters]
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key").getField(key).alias(key), "value.groupState.*")
    waiting = held.select(key, F.inline(F.arrays_zip(*kept)))
    last = held.filter(F.col("last__at").isNotNull()).select(
        key, F.col("last__at").alias("_at"), *[F.lit(None).cast("long").alias(c) for c in ties],
        *[F.col(f"last_{c}").alias(c) for c in counters],
    )
    both = waiting.withColumn("_new", F.lit(True)).unionByName(last.withColumn("_new", F.lit(False)))
    placed = both.withColumn("_at", F.timestamp_micros("_at"))
    # The last one given out stands before all that wait, whatever its other columns were.
    rates = counter_rates(placed, counters, [key], ["_at", "_new", *ties]).filter("_new")
    return rates.select(key, F.col("_at").alias(ts), *ties, *counters, *[f"{c}_per_second" for c in counters])


def rates_to_table(
    samples: DataFrame, counters: Sequence[str], key: str, order: Sequence[str], path: str,
    checkpoint: str, lateness: str = "1 hour",
) -> DataFrame:
    """``rates_stream`` of what is available as a table: micro-batches add to it, nothing is written again.

    The table read back is completed by the samples that still wait, which a later run may yet tell otherwise.
    """
    written = drain_append(rates_stream(samples, counters, key, order, lateness), path, checkpoint)
    return written.unionByName(waiting_rates(samples.sparkSession, checkpoint, counters, key, order))


def drain_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what is available and return the table written."""
    append_stream(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
