"""Reads as a stream: running session totals, and files indexed as they arrive.

An extension: the reference has no streaming. Batch and stream share their
rules; the tests hold the one against the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeglass import config
from lodeglass.operators.incremental import Ledger

_GAP_MS = config.SESSION_GAP_HOURS * 3_600_000


def running_sessions(reads: DataFrame, owner: str = "owner", at: str = "read_at", tokens: str = "tokens", late: str = "1 hour") -> DataFrame:
    """(owner, session_no, started_at, last_active_at, reads, tokens), a row whenever an owner's session grows or ends.

    `reads` is a stream. A session ends when the watermark is a whole gap
    past its last read; its state goes with it, but for the session's number.
    Reads that come later than the watermark allows are dropped by Spark.
    """
    kept = reads.where(F.col(owner).isNotNull() & F.col(at).isNotNull()).select(owner, F.col(at).cast("timestamp").alias("_at"), F.col(tokens).cast("bigint").alias("_n"))
    kind = reads.schema[owner].dataType.simpleString()
    out = f"`{owner}` {kind}, session_no bigint, started_at timestamp, last_active_at timestamp, reads bigint, tokens bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, first, last, n, total = state.get if state.exists else (0, None, None, 0, 0)
        if state.hasTimedOut:
            state.update((no, None, None, 0, 0))
            return
        rows = pd.concat(list(batches)).sort_values("_at")
        done = []
        for t, value in zip(rows["_at"], rows["_n"]):
            ms = t.value // 1_000_000
            if last is None or ms - last >= _GAP_MS:
                if last is not None:
                    done.append((key[0], no, first, last, n, total))
                no, first, n, total = no + 1, ms, 0, 0
            last = max(ms, last) if n else ms
            n, total = n + 1, total + (0 if pd.isna(value) else int(value))
        state.update((no, first, last, n, total))
        state.setTimeoutTimestamp(max(last + _GAP_MS, state.getCurrentWatermarkMs() + 1))
        done.append((key[0], no, first, last, n, total))
        frame = pd.DataFrame(done, columns=[owner, "session_no", "started_at", "last_active_at", "reads", "tokens"])
        for c in ("started_at", "last_active_at"):
            frame[c] = pd.to_datetime(frame[c], unit="ms")
        yield frame

    grouped = kept.withWatermark("_at", late).groupBy(owner)
    return grouped.applyInPandasWithState(step, out, "no bigint, first bigint, last bigint, n bigint, total bigint", "update", GroupStateTimeout.EventTimeTimeout)


def index_stream(listing: DataFrame, ledger: Ledger, work: Callable[[DataFrame], DataFrame], at: str | None = None) -> DataStreamWriter:
    """A writer that indexes what each micro-batch of a stream of listings brings, once.

    The stream's identity, which its checkpoint keeps, and the micro-batch's
    number are the batch identifier: a micro-batch that is delivered again
    after a failure does nothing the second time, and a stream that begins
    anew with another checkpoint isn't taken for the old one. Of several
    versions of a key in one micro-batch the latest by the time column `at`
    counts, with all its columns; versions without checksum only where there
    is no other. Among equal times, or without `at`, the greatest checksum.
    """

    def run(batch: DataFrame, number: int) -> None:
        order = F.struct(F.col(ledger.checksum).isNotNull(), *[F.col(c) for c in (at, ledger.checksum) if c])
        latest = batch.groupBy(F.col(ledger.key).alias("_k")).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")
        identity = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "unnamed"
        ledger.run(f"stream-{identity}-{number:012d}", latest, work)

    return listing.writeStream.foreachBatch(run)
