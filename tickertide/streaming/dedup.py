"""Dedup of a stream of raw posts."""

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tickertide.operators.dedup import TTL_SECONDS

# A cell of state spans this many times to live.
CELL_TTLS = 64
# Keys are handled in so many groups, and stored in so many slots of a group: neither the cost of a
# group nor that of a call to the state store is paid for each key.
STATE_GROUPS, STATE_SLOTS = 1024, 4


def _thin_copies(df: DataFrame, key: str, ts: str | None = None) -> DataFrame:
    """Drop copies of a key inside each Arrow batch, before the shuffle by key.

    At most one copy of a key survives a micro-batch anyway, so the result is
    the same, but a key that makes up a third of the stream no longer sends all
    its rows to one task.  With ``ts`` the latest copy also stays, in case the
    first one is behind the watermark.  Only the key and the time reach Python.
    """

    @pandas_udf("boolean")
    def candidate(keys: pd.Series, times: pd.Series) -> pd.Series:
        first = ~keys.duplicated(keep="first")
        order = times.argsort(kind="stable")
        latest = ~keys.iloc[order].duplicated(keep="last")
        return first | latest.reindex(keys.index)

    @pandas_udf("boolean")
    def first_copy(keys: pd.Series) -> pd.Series:
        return ~keys.duplicated(keep="first")

    if ts is None:
        flag = first_copy.asNondeterministic()(F.col(key))
    else:
        flag = candidate.asNondeterministic()(F.col(key), F.unix_micros(ts))
    return df.withColumn("_candidate", flag).filter("_candidate").drop("_candidate")


def dedup_stream_watermark(
    df: DataFrame, key: str = "dedup_key", ts: str = "created_at", ttl: str = "1 hour", thin: bool = True
) -> DataFrame:
    """Keep the first row of a key for at least ``ttl`` of event time.

    Rows behind the watermark are dropped: use this where lateness is bounded.
    """
    if thin and df.isStreaming:
        df = _thin_copies(df, key, ts)
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def dedup_stream_event_time(
    df: DataFrame,
    key: str = "dedup_key",
    ts: str = "created_at",
    ids: tuple[str, ...] = ("source", "post_id"),
    ttl_seconds: float = TTL_SECONDS,
    lateness_seconds: float | None = None,
) -> DataFrame:
    """The rule of ``dedup_batch_ttl`` on a stream, in event time.

    A row is dropped if a row of its key was kept at most ``ttl_seconds`` before it. The rows of
    a micro-batch are taken in (ts, ids) order, and the instants kept so far are state, so how
    rows that arrive in order are cut into micro-batches changes nothing. No row is too
    late: one that arrives after later ones is held against the instants kept before it.

    Keys share ``STATE_GROUPS`` groups of ``STATE_SLOTS`` slots; the state of a group is a map from
    slots and cells of time to the instants that the keys of the slot kept in them. A row reads its
    own cell and, near its start, the one before, whatever was kept in others. Without
    ``lateness_seconds`` nothing is forgotten (eight bytes a kept row); with it, rows that far
    behind the latest of all are dropped, and a timer removes each cell that none can reach any more.
    Rows without a key or time are kept.

    All columns pass through the task of their group: where texts are long, send keys, times and
    ids alone and join the rest back, as ``start_enrich`` does. Needs the RocksDB state provider
    in the session (``ROCKSDB_PROVIDER``).
    """
    from pyspark.sql.streaming import StatefulProcessor

    ttl = max(1, int(ttl_seconds * 1_000_000))
    late = None if lateness_seconds is None else int(lateness_seconds * 1_000_000)
    width = ttl * CELL_TTLS
    columns, order = df.columns, ["_slot", "_key", "_us", *[i for i in ids if i in df.columns]]
    names = [*columns, "_us", "_key", "_slot", "_group"]

    class KeptInstants(StatefulProcessor):
        def init(self, handle) -> None:
            self._handle = handle
            self._cells = handle.getMapState(
                "cells",
                T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("cell", T.LongType())]),
                T.StructType([T.StructField("kept", T.StringType())]),  # JSON: instants by key
            )

        def _cell(self, number: int) -> dict[str, list[int]]:
            """The instants by key of one cell of the slot at hand."""
            if number not in self._open:
                held = self._cells.getValue((self._slot, number))
                self._open[number] = json.loads(held[0]) if held else {}
                if not held:
                    self._new.add(number)
            return self._open[number]

        def _keep(self, key: str, us: int) -> bool:
            number = us // width
            cell = self._cell(number)
            kept = cell.get(key, [])
            at = bisect_right(kept, us)
            if at:
                last = kept[at - 1]
            else:
                before = self._cell(number - 1).get(key) if us - number * width <= ttl else None
                last = before[-1] if before else None
            if last is not None and us - last <= ttl:
                return False
            kept.insert(at, us)
            cell[key] = kept
            self._changed.add(number)
            return True

        def _begin(self, slot: int | None) -> None:
            self._slot, self._open, self._changed, self._new = slot, {}, set(), set()

        def _end(self) -> None:
            for number in self._changed:
                self._cells.updateValue((self._slot, number), (json.dumps(self._open[number], separators=(",", ":")),))
            self._opened |= self._changed & self._new

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(rows)
            frame.columns = names  # names that Python can't use as attributes arrive changed
            free = frame["_key"].isna()
            if free.any():
                yield frame.loc[free, columns]
                frame = frame[~free]
            if frame.empty:
                return
            frame = frame.sort_values(order, kind="stable")
            chosen, self._opened = [], set()
            self._begin(None)
            for slot, name, us in zip(*(frame[c].tolist() for c in ("_slot", "_key", "_us"))):
                if slot != self._slot:
                    self._end()
                    self._begin(slot)
                chosen.append(self._keep(name, us))
            self._end()
            if late is not None and self._opened:
                # Past this moment the watermark is beyond the cell and a time to live after it.
                ends = {((number + 1) * width + ttl) // 1000 + 1 for number in self._opened}
                for end in ends.difference(self._handle.listTimers()):
                    self._handle.registerTimer(end)
            yield frame.loc[chosen, columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # One timer for each cell of a group; with a lateness, few cells are live.
            now = expiredTimerInfo.getExpiryTimeInMs()
            over = [(slot, cell) for slot, cell in self._cells.keys() if ((cell + 1) * width + ttl) // 1000 + 1 <= now]
            for entry in over:
                self._cells.removeKey(entry)
            yield pd.DataFrame(columns=columns)

        def close(self) -> None:
            pass

    if late is not None:
        df = df.withWatermark(ts, f"{late // 1000} milliseconds")
    ruled = F.col(key).isNotNull() & F.col(ts).isNotNull()
    name = F.when(ruled, F.col(key).cast("string"))
    # Rows that the rule leaves alone are spread by chance. An absent time must not turn the others into floats.
    spread = F.when(ruled, F.hash(F.lit("k"), name)).otherwise(F.hash(F.lit(""), *[i for i in ids if i in columns]))
    place = F.pmod(spread, F.lit(STATE_GROUPS * STATE_SLOTS))
    return (
        df.withColumns({"_us": F.coalesce(F.unix_micros(ts), F.lit(0)), "_key": name})
        .withColumn("_slot", (place / STATE_GROUPS).cast("int"))
        .withColumn("_group", F.pmod(place, F.lit(STATE_GROUPS)))
        .groupBy("_group")
        .transformWithStateInPandas(
            statefulProcessor=KeptInstants(),
            outputStructType=df.schema,
            outputMode="Append",
            timeMode="None" if late is None else "EventTime",
        )
    )


def dedup_stream_ttl(
    df: DataFrame, key: str = "dedup_key", ttl_seconds: float = TTL_SECONDS
) -> DataFrame:
    """Exact rule in processing time: a key is a duplicate while its kept row is at
    most ``ttl_seconds`` old; a duplicate does not extend that.

    Needs the RocksDB state provider in the session (``ROCKSDB_PROVIDER``).  State
    expires by itself and survives a restart.  With an ``availableNow`` trigger set
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to false, or the operator's
    wish for empty batches (to expire state) keeps the query running for ever.
    """
    from pyspark.sql.streaming import StatefulProcessor

    ttl_ms = int(ttl_seconds * 1000)

    class FirstSeen(StatefulProcessor):
        def init(self, handle) -> None:
            schema = T.StructType([T.StructField("seen_ms", T.LongType())])
            # The age test below decides; expiry only frees space, a little later.
            self._seen = handle.getValueState("seen", schema, ttl_ms + 1000)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentProcessingTimeInMs()
            old = self._seen.get() if self._seen.exists() else None
            keep = old is None or now - old[0] > ttl_ms
            for frame in rows:
                if keep and len(frame):
                    keep = False
                    self._seen.update((now,))
                    yield frame.head(1)

        def close(self) -> None:
            pass

    return (
        _thin_copies(df, key)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=FirstSeen(),
            outputStructType=df.schema,
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )
