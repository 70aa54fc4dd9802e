"""Monthly quotas as keyed state with a timer: the one event that crosses the limit, and each month's total once it is over."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.functions.uploads import month_start
from docquarry.streaming.run import drain, write_batch, written_batches

CROSSED, CLOSED = "crossed", "closed"
#: The accounts of a slot in a month: how often each has been seen, and whether it has crossed the limit.
STATE = "accounts array<string>, used array<bigint>, crossed array<boolean>"
#: Accounts are dealt out into so many slots by hash; a slot's month is one call of Python in a micro-batch.
SLOTS = 4096


def quota_crossings(
    events: DataFrame, limit: int, delay: str, account: str = "userId", moment: str = "createdAt", key: str = "id", slots: int = SLOTS,
) -> DataFrame:
    """A stream of what happens to the months of a stream of events: ``account``, ``month``, ``kind``, ``used``, ``key``, ``moment``.

    ``crossed``, as soon as it comes: the event with which the month's use goes past ``limit``, once.
    ``closed``: the month's use, when the watermark (``delay`` behind the newest event) is past its end;
    its state is removed then. Events count in order of arrival, those of a micro-batch by time and key.
    State is two numbers for each account and month that is not over, kept by slot: calls of Python grow
    with ``slots``, not with accounts, and a micro-batch rewrites the slots it meets, so a stream of small
    micro-batches over very many accounts wants more slots. A checkpoint keeps the number it began with.
    Of a busy account's events in a micro-batch at most ``limit`` + 1 are held at once, whatever their
    number. An event older than the watermark is dropped by Spark. Events without an account are one
    account; those without a time have no month that could end and are left out (``stream_quota`` counts
    them). ``key`` should not be null; ``account`` is of a type that can be cast to text and back. Months are
    those of the session's time zone.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    out = T.StructType([
        T.StructField("_account", T.StringType()), T.StructField("month", T.TimestampType()), T.StructField("kind", T.StringType()),
        T.StructField("used", T.LongType()), T.StructField("_key", kinds[key]), T.StructField("_at", T.TimestampType()),
    ])
    whole = isinstance(kinds[key], T.IntegralType)

    def told(month: pd.Timestamp, kind: str, rows: list[tuple]) -> pd.DataFrame:
        who, used, events, at = zip(*rows)
        return pd.DataFrame({
            "_account": who, "month": month, "kind": kind, "used": used,
            "_key": pd.Series(events, dtype=object),  # whole numbers beside nulls would turn into floats
            "_at": pd.to_datetime(pd.Series(at, dtype=object)),
        })

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        month = group[1]
        months = {who: _Month(*rest) for who, *rest in zip(*state.get)} if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield told(month, CLOSED, [(who, m.used, None, None) for who, m in months.items()])
            return
        for rows in batches:
            for who, at, event, keyed in zip(rows["_account"], rows["_at"], rows["_key"], rows["_keyed"]):
                who = None if pd.isna(who) else who
                if who not in months:
                    months[who] = _Month(0, False)
                months[who].add(at, event if keyed else None, limit)
        now = [(who, m.first[0]) for who, m in months.items() if not m.crossed and m.used > limit]
        state.update((list(months), [m.used for m in months.values()], [m.crossed or m.used > limit for m in months.values()]))
        end = (pd.Timestamp(month) + pd.offsets.MonthBegin(1)).tz_localize(zone)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if now:
            yield told(month, CROSSED, [(who, limit + 1, last.event, last.at) for who, last in now])

    at, who = F.col(moment).cast("timestamp"), F.col(account).cast("string")
    rows = events.where(F.col(moment).isNotNull()).select(
        F.when(who.isNull(), -1).otherwise(F.pmod(F.xxhash64(who), F.lit(slots))).alias("_slot"), who.alias("_account"),
        (F.coalesce(key, F.lit(0)) if whole else F.col(key)).alias("_key"), F.col(key).isNotNull().alias("_keyed"),
        at.alias("_at"), month_start(at).cast("timestamp").alias("month"),
    )
    found = rows.withWatermark("_at", delay).groupBy("_slot", "month").applyInPandasWithState(
        step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        F.col("_account").cast(kinds[account]).alias(account), "month", "kind", "used", F.col("_key").alias(key), F.col("_at").alias(moment),
    )


class _Month:
    """An account's month: its use before and in a micro-batch, and of that the events that may cross the limit."""

    __slots__ = ("used", "crossed", "room", "first")

    def __init__(self, used: int, crossed: bool):
        self.used, self.crossed = used, crossed
        self.room: int | None = None
        #: The earliest events that may still be within the limit, and the one that crosses it; the latest on top.
        self.first: list[_Late] = []

    def add(self, at, event, limit: int) -> None:
        if self.room is None:
            self.room = 0 if self.crossed else limit + 1 - self.used
        self.used += 1
        if len(self.first) < self.room:
            heapq.heappush(self.first, _Late(at, event))
        elif self.room and (at, event is None, event) < self.first[0].order:
            heapq.heapreplace(self.first, _Late(at, event))


class _Late:
    """An event that sorts before all earlier ones, so that a heap has the latest on top; one without a key is the last of its time."""

    __slots__ = ("order",)

    def __init__(self, at, event):
        self.order = (at, event is None, event)

    @property
    def at(self):
        return self.order[0]

    @property
    def event(self):
        return self.order[2]

    def __lt__(self, other: _Late) -> bool:
        return self.order > other.order


def stream_quota_crossings(
    events: DataFrame, limit: int, path: str, checkpoint: str, delay: str = "1 day",
    account: str = "userId", moment: str = "createdAt", key: str = "id", slots: int = SLOTS,
) -> DataFrame:
    """``quota_crossings`` run over all data present, and what it has written so far: times are without a zone, as given.

    The months that the watermark has passed are closed; the rest stay in state until it has, in a later
    run over the same checkpoint.
    """
    found = quota_crossings(events, limit, delay, account, moment, key, slots)
    plain = found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("month", moment)})
    drain(plain, lambda batch, n: write_batch(batch, path, n), checkpoint)
    return written_batches(events.sparkSession, path, plain.schema).drop("batch_id")
