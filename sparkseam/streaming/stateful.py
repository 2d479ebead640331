"""Keyed state with event-time expiry: approval requests and a lookup cache, an entry of state for each key.

Keys are dealt over buckets by hash, and a bucket's entries are one row of state: a call of Python, and what Spark does around it, costs
milliseconds, so there is one for each bucket of a batch and not for each key.

Rows of a key are taken in the order of (time, tie) within a batch; a stream should bring them in about that order
(rows behind the watermark are dropped). State holds one pending request or one entry for each key, so it grows with the
keys and not with the rows, and timers end requests when the watermark passes their end. Python runs here because Spark has
no built-in operator for keyed state; rows reach it in Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets that keys are dealt over. They stay the same as long as a stream's checkpoint does; very many keys want more.
BUCKETS = 256

#: What a row does to a key's pending request.
SUBMIT, APPROVE, REJECT = "submit", "approve", "reject"


def _by_key(batches: Iterator[pd.DataFrame], mark: int, keys: int) -> dict[tuple, list[tuple]]:
    """Each key's rows (time in microseconds, tie, others) in order, without those behind the watermark (in milliseconds): Spark itself would drop
    them only from the next batch on. Columns: bucket, keys, time, tie, others."""
    out: dict[tuple, list[tuple]] = {}
    for batch in batches:
        columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() if batch[c].hasnans else batch[c].tolist() for c in batch.columns[1:]]
        columns[keys] = batch.iloc[:, keys + 1].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for row in zip(*columns, strict=True):
            if mark <= 0 or row[keys] >= mark * 1000:
                out.setdefault(row[:keys], []).append(row[keys:])
    for rows in out.values():
        rows.sort(key=lambda r: r[:2])
    return out


def _bucket(keys: list[str], buckets: int) -> Column:
    """Keys with nulls have buckets of their own: beside a null, pandas holds whole numbers as floats."""
    nulls = sum((F.when(F.col(k).isNull(), 2**i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    return (F.pmod(F.xxhash64(*keys), F.lit(buckets)) + nulls * buckets).cast("int").alias("_bucket")


def _frame(rows: list[tuple], names: list[str], times: tuple[str, ...] = ()) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame({n: np.array(v, "datetime64[us]") if n in times else pd.Series(v, dtype=object) for n, v in columns.items()})


def approvals(stream: DataFrame, key: str, action: Column, below: Column, ttl: str, late: str, time: str = "ts", tie: str = "event_id",
    buckets: int = BUCKETS) -> DataFrame:
    """key, request (tie of the row that submitted it), submitted, status, decided: a row for each request that ended.

    action: submit, approve, reject, or null for rows that do nothing; below: whether a submission lies below the severity
    from which a reviewer is asked. Such a one is auto_approved at once. Another is pending until a decision (approved,
    rejected), a newer submission that isn't below (superseded), or the end of its time to live (expired, by a timer or by
    the next row of its key, whichever comes first; decided is then its end). A decision at the very end still counts. Decisions
    without a pending request do nothing. What is pending at the end of the stream has no row.
    """
    life = pd.Timedelta(ttl).value // 1000
    rows = stream.withColumn("_action", action).filter(F.col("_action").isNotNull()).select(_bucket([key], buckets), F.col(key), F.col(time).alias("_at"),
        F.col(tie).alias("_tie"), "_action", F.coalesce(below, F.lit(False)).alias("_below")).withWatermark("_at", late)
    names = [key, "request", "submitted", "status", "decided"]

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict = pickle.loads(state.get[0]) if state.exists else {}  # request, microseconds by key
        mark, out = state.getCurrentWatermarkMs(), []

        def end(who: tuple, status: str, at: int) -> None:
            request, since = waiting.pop(who)
            out.append((*who, request, since, status, at))

        for who, rows_ in ({} if state.hasTimedOut else _by_key(batches, mark, 1)).items():
            for at, tie_, what, low in rows_:
                if who in waiting and at > waiting[who][1] + life:
                    end(who, "expired", waiting[who][1] + life)
                if what == SUBMIT and low:
                    out.append((*who, tie_, at, "auto_approved", at))
                elif what == SUBMIT:
                    if who in waiting:
                        end(who, "superseded", at)
                    waiting[who] = (tie_, at)
                elif who in waiting:
                    end(who, "approved" if what == APPROVE else "rejected", at)
        for who, (_, since) in list(waiting.items()):  # whose end the watermark has passed, rows or none
            if (since + life) // 1000 < mark:
                end(who, "expired", since + life)
        if waiting:
            state.update((pickle.dumps(waiting),))
            state.setTimeoutTimestamp(max((min(since for _, since in waiting.values()) + life) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(out, names, ("submitted", "decided"))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"`{key}` {kinds[key]}, request {kinds[tie]}, submitted timestamp, status string, decided timestamp"
    return rows.groupBy("_bucket").applyInPandasWithState(step, schema, "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def lookups(stream: DataFrame, keys: list[str], ttl: str, late: str, time: str = "ts", tie: str = "event_id",
    buckets: int = BUCKETS) -> DataFrame:
    """keys, tie, outcome of every row as a lookup in a cache whose key is all of `keys`.

    miss: no entry of the key is known; hit: there is one younger than ttl; expired: there was one, at least ttl old. A miss or an
    expired entry stores a new one at the row's time. A key whose entry has expired is kept with its last time, so that
    its next lookup is told from a first one.
    """
    life = pd.Timedelta(ttl).value // 1000
    rows = stream.select(_bucket(keys, buckets), *keys, F.col(time).alias("_at"), F.col(tie)).withWatermark("_at", late)

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored: dict = pickle.loads(state.get[0]) if state.exists else {}  # microseconds by key
        out = []
        for who, rows_ in _by_key(batches, state.getCurrentWatermarkMs(), len(keys)).items():
            last = stored.get(who)
            for at, tie_ in rows_:
                if last is not None and at - last < life:
                    out.append((*who, tie_, "hit"))
                    continue
                out.append((*who, tie_, "miss" if last is None else "expired"))
                last = at
            stored[who] = last
        state.update((pickle.dumps(stored),))
        if out:
            yield _frame(out, [*keys, tie, "outcome"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, tie]) + ", outcome string"
    return rows.groupBy("_bucket").applyInPandasWithState(step, schema, "stored binary", "append", GroupStateTimeout.NoTimeout)
