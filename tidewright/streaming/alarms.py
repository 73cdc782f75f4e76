"""Alarms for silent keys, raised while they are silent: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a key's state holds, in microseconds: its last reading, whether the silence behind it was
#: reported, and the readings that the watermark has not reached.
STATE = "last bigint, reported boolean, waiting array<bigint>"


class Silence:
    """The state machine of one key, without Spark: readings and a clock in, alarms out.

    A reading counts when the watermark reaches it, so readings may come in any order within the
    delay, in any batches, and the alarms are those of the sorted readings. A silence is reported
    once: when the clock or the next reading passes its limit.
    """

    def __init__(self, limit: int, last: int | None = None, reported: bool = False, waiting: list[int] | None = None):
        self.limit, self.last, self.reported, self.waiting = limit, last, reported, waiting or []

    def advance(self, readings: list[int], clock: int) -> list[int]:
        """Readings that began a silence of more than the limit."""
        alarms, waiting = [], sorted([*self.waiting, *readings])
        due = [t for t in waiting if t <= clock]
        self.waiting = waiting[len(due) :]
        for t in due:
            alarms += self._passed(t)
            if self.last is None or t > self.last:
                self.last, self.reported = t, False
        return alarms + self._passed(clock)

    def _passed(self, now: int) -> list[int]:
        """The reading behind which there is silence for more than the limit at ``now``, unless reported."""
        if self.last is None or self.reported or now <= self.last + self.limit:
            return []
        self.reported = True
        return [self.last]

    def wake(self) -> int | None:
        """When to look again without new readings."""
        times = self.waiting[:1]
        if self.last is not None and not self.reported:
            times = [*times, self.last + self.limit]
        return min(times, default=None)


def offline_alarms(readings: DataFrame, key: str, ts: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of (key, last_seen, alarm_at): one row for every silence of more than ``seconds``,
    those that never end included, as soon as the watermark passes its limit.

    The state of a key is its last reading and what lies above the watermark, so it is bounded by
    ``delay`` and not by the stream. Readings later than the watermark are dropped, as are null keys
    and times. A restart goes on from the checkpoint and reports nothing twice.
    """
    src = readings.select(F.col(key).alias("key"), F.col(ts).alias("ts")).dropna().withWatermark("ts", delay)
    kind = src.schema["key"].dataType.simpleString()
    limit = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Silence(limit, *(state.get if state.exists else ()))
        clock = state.getCurrentWatermarkMs() * 1000
        new = [] if state.hasTimedOut else [int(t) for b in batches for t in b["ts"].astype("datetime64[us]").astype("int64")]
        alarms = machine.advance([t for t in new if t > clock], clock)
        state.update((machine.last, machine.reported, machine.waiting))
        wake = machine.wake()
        if wake is not None:
            state.setTimeoutTimestamp(max(wake // 1000 + 1, clock // 1000 + 1))
        if alarms:
            last = pd.to_datetime(pd.Series(alarms), unit="us")
            yield pd.DataFrame({"key": [k[0]] * len(alarms), "last_seen": last, "alarm_at": last + pd.Timedelta(seconds=seconds)})

    out = src.groupBy("key").applyInPandasWithState(step, f"key {kind}, last_seen timestamp, alarm_at timestamp", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)


def silences(readings: DataFrame, key: str, ts: str, seconds: int, until: str | None = None) -> DataFrame:
    """The same rows from a table: silences of more than ``seconds`` that began so long before ``until``
    (the latest reading of all unless given)."""
    src = readings.select(F.col(key).alias("key"), F.col(ts).alias("ts")).dropna().distinct()
    end = F.lit(until).cast("timestamp") if until else F.lit(src.agg(F.max("ts")).first()[0])
    following = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    found = src.withColumn("alarm_at", limit).withColumn("next", following).filter((F.coalesce("next", end) > F.col("alarm_at")) & (F.col("alarm_at") < end))
    return found.select(F.col("key").alias(key), F.col("ts").alias("last_seen"), "alarm_at")
