"""Sign-in throttling as a fold over attempts, in batch and on a stream.

Five failures inside one counter lifetime block a key until the counter expires; a
success before that clears it. The counter starts at its first failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docreg.functions.prefix import running

MAX_FAILURES, DECAY_SECONDS = 5, 60.0


def throttle_key(email: Column, ip: Column) -> Column:
    return F.concat_ws("|", F.lower(email), ip)


class _Counter:
    """Failures since ``start``; two numbers are the whole state."""

    def __init__(self, start: float = 0.0, failures: int = 0):
        self.start, self.failures = start, failures

    def refuse(self, when: float, succeeded: bool, limit: int, decay: float) -> bool:
        if self.failures and when >= self.start + decay:
            self.failures = 0
        if self.failures >= limit:
            return True
        if succeeded:
            self.failures = 0
        else:
            self.start = self.start if self.failures else when
            self.failures += 1
        return False


def _prepare(attempts: DataFrame) -> DataFrame:
    return attempts.select(
        throttle_key(F.col("email"), F.col("ip")).alias("key"), "id", "ts", "succeeded",
        (F.unix_micros("ts") / 1e6).alias("_at"))


def throttle_breaches(attempts: DataFrame, limit: int = MAX_FAILURES, decay: float = DECAY_SECONDS) -> DataFrame:
    """(key, id, ts, succeeded, refused) for every attempt (email, ip, id, ts, succeeded).

    A pause of at least ``decay`` always ends a counter, so each key is cut at its pauses
    and the pieces fold independently. A piece is read batch by batch, never held whole.
    """
    keyed = _prepare(attempts)
    order, day = [F.col("_at"), F.col("id")], F.floor(F.col("_at") / 86_400)
    spaced = running(keyed, ["key"], order, day, {"_previous": ("max", "_at")}, inclusive=False)
    pause = F.col("_previous").isNull() | (F.col("_at") - F.col("_previous") >= decay)
    starts = spaced.withColumn("_start", F.when(pause, F.col("_at")))
    pieces = running(starts, ["key"], order, day, {"_piece": ("max", "_start")})
    out = T.StructType([keyed.schema["key"], keyed.schema["id"], keyed.schema["ts"], keyed.schema["succeeded"],
                        T.StructField("refused", T.BooleanType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, counter = None, _Counter()
        for frame in frames:
            refused = []
            for key, start, when, ok in zip(frame["key"], frame["_piece"], frame["_at"], frame["succeeded"]):
                if piece != (key, start):
                    piece, counter = (key, start), _Counter()
                refused.append(counter.refuse(when, ok, limit, decay))
            frame["refused"] = refused
            yield frame[["key", "id", "ts", "succeeded", "refused"]]

    # A piece lies in one partition, in time order; the fold holds two numbers at a time.
    ordered = pieces.select("key", "_piece", "_at", "id", "ts", "succeeded").repartition("key", "_piece").sortWithinPartitions(
        "key", "_piece", "_at", "id")
    return ordered.mapInPandas(fold, out)


def throttle_stream(attempts: DataFrame, limit: int = MAX_FAILURES, decay: float = DECAY_SECONDS,
                    lateness: str = "10 minutes") -> DataFrame:
    """The same fold on a stream; the state of a key is one time and one count.

    State is dropped in event time, once the watermark passes the end of the counter.
    A key's attempts are taken in time order within a batch and must reach the stream in
    order across batches, as a sign-in log does.
    """
    keyed = _prepare(attempts).withWatermark("ts", lateness)
    out = T.StructType([keyed.schema["key"], keyed.schema["id"], keyed.schema["ts"], keyed.schema["succeeded"],
                        T.StructField("refused", T.BooleanType())])
    state_type = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("failures", T.IntegerType())])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = _Counter(*state.get) if state.exists else _Counter()
        batch = pd.concat(list(frames)).sort_values(["_at", "id"], kind="stable")
        batch["refused"] = [counter.refuse(t, ok, limit, decay) for t, ok in zip(batch["_at"], batch["succeeded"])]
        expiry = int((counter.start + decay) * 1000) + 1
        if counter.failures and expiry > state.getCurrentWatermarkMs():
            state.update((float(counter.start), int(counter.failures)))
            state.setTimeoutTimestamp(expiry)
        elif state.exists:
            state.remove()
        yield batch[["key", "id", "ts", "succeeded", "refused"]]

    return keyed.groupBy("key").applyInPandasWithState(
        fold, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)
