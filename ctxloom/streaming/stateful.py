"""Streams with a state of their own for each key: expiry of records, countdown of tasks.

Both are transformWithState processors with event-time timers, so a result depends on the events' times and not on when a
batch happens to run; state lives in RocksDB under the checkpoint, and a restart goes on from there.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as transformWithState needs; the caller's settings stay."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class Expiry(StatefulProcessor):
    """Keeps the last version of each key until its time is over, and then tells its deletion.

    Input rows: key, seq, at_us and expire_us (microseconds; null: never). A version that comes after the one before it has expired tells the
    expiry too, so versions of one batch have the same result as those of many. Versions older than the kept one are ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "seq long, at_us long, expire_us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.kept.get() if self.kept.exists() else None
        last = before
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            if last is not None:
                if (r.at_us, r.seq) < (last[1], last[0]):
                    continue
                if last[2] is not None and r.at_us >= last[2]:
                    yield Row(key=key[0], seq=last[0], expire_us=last[2])
            last = (r.seq, r.at_us, r.expire_us)
        if last is before or last is None:
            return
        if before is not None and before[2] is not None:
            self.handle.deleteTimer(_timer(before[2]))
        self.kept.update(last)
        if last[2] is not None:
            self.handle.registerTimer(_timer(last[2]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.kept.exists():
            seq, _, expire = self.kept.get()
            if expire is not None and _timer(expire) <= expiredTimerInfo.getExpiryTimeInMs():
                self.kept.clear()
                yield Row(key=key[0], seq=seq, expire_us=expire)

    def close(self) -> None:
        pass


def _timer(us: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-us // 1000)


class Countdown(StatefulProcessor):
    """Tells a task once all of its parts are done.

    Input rows: key, seq, total (a registration, which replaces an earlier one) or null (one part done). Parts without a registration
    are ignored; a total of 0 or less is done at once; a task that is done is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "left long, total long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.left.get() if self.left.exists() else None
        for r in sorted(rows, key=lambda r: r.seq):
            if r.total is not None:
                held = (r.total, r.total)
            elif held is None:
                continue
            else:
                held = (held[0] - 1, held[1])
            if held[0] <= 0:
                yield Row(key=key[0], total=held[1])
                held = None
        if held is None:
            self.left.clear()
        else:
            self.left.update(held)

    def close(self) -> None:
        pass


def expirations(records: DataFrame, key: str, seq: str, at: str, expire_at: str, delay: str) -> DataFrame:
    """(key, seq, expire_at) of each version of a streamed record that expires before a newer version comes.

    records: a stream of a stateful_session(); versions may come late by `delay`, which is also how long after its time an expiry is told.
    """
    ts = F.col(at).cast("timestamp")
    rows = records.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), ts.alias("at"), F.unix_micros(ts).alias("at_us"), F.unix_micros(F.col(expire_at).cast("timestamp")).alias("expire_us"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay).groupBy("key").transformWithState(
        statefulProcessor=Expiry(), outputStructType=f"key {kind}, seq long, expire_us long", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.col("seq").alias(seq), F.timestamp_micros("expire_us").alias(expire_at))


def completions(log: DataFrame, key: str, seq: str, total: str) -> DataFrame:
    """(key, total) of each task of a streamed log (registrations have a total, parts done have null) that gets done."""
    rows = log.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(total).cast("long").alias("total"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.where("key IS NOT NULL").groupBy("key").transformWithState(
        statefulProcessor=Countdown(), outputStructType=f"key {kind}, total long", outputMode="Append", timeMode="None")
    return out.select(F.col("key").alias(key), F.col("total").alias(total))
