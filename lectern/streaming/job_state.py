"""Durable jobs as keyed state of a stream: states, leases, pause and cancel.

A job's events come in any number of micro-batches; its state is one value of ``transformWithState``, kept by the state
store across restarts. The rules are those of ``operators.jobs`` over a finished log, and more that only a live job has:

* state: a state is entered only from the one before it; other requests change nothing.
* claim: a worker takes the job for ``lease`` seconds. With ``exclusive`` a claim is refused while another worker's lease runs.
* result: accepted only from the worker with the last claim, within its lease by the event's time. With ``renew`` an
  accepted result starts the lease anew.
* A processing-time timer ends a lease without any event; results of its worker are late from then on.
* pause ends the lease, and a claim takes the job up again; cancel is final: whatever comes later is refused. A job in the
  last state can't be stopped.

State that no event touches for ``keep_days`` is dropped (TTL).

Events of a job in one micro-batch are taken by time, then number, in memory, so a micro-batch bounds them. Defined
results: null times come first; an unknown kind is refused; events with equal time and number are taken in no particular order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.operators.jobs import LEASE_SECONDS, STATES

EVENTS = ["job_id", "seq", "at", "kind", "value"]
CHANGES = "job_id string, seq bigint, kind string, accepted boolean, state string, since bigint, why string"
#: step: how many states are entered; since: the number of the event that entered the last; timer: when the lease ends, in processing time.
STATE = "step int, since bigint, worker string, claimed bigint, timer bigint, mode string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobMachine(StatefulProcessor):
    def __init__(self, lease: int, order: tuple[str, ...], exclusive: bool, renew: bool, keep_days: int) -> None:
        self.lease, self.order, self.exclusive, self.renew, self.keep_days = lease, order, exclusive, renew, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE, self.keep_days * 86_400_000)

    def close(self) -> None:
        pass

    def _timed(self, job: dict, now: int | None) -> None:
        """End the running timer, and start one from ``now``, if given."""
        if job["timer"] is not None:
            self.handle.deleteTimer(job["timer"])
        job["timer"] = None if now is None else now + 1000 * self.lease
        if now is not None:
            self.handle.registerTimer(job["timer"])

    def _runs(self, job: dict, at: int | None) -> bool:
        return job["worker"] is not None and at is not None and job["claimed"] is not None and at - job["claimed"] <= 1_000_000 * self.lease

    def _take(self, job: dict, e: Row, now: int) -> tuple[bool, str | None]:
        """Whether the event counts, and why not."""
        if job["mode"] == "cancelled":
            return False, "cancelled"
        if e.kind == "state":
            if job["step"] == len(self.order) or e.value != self.order[job["step"]] or e.seq <= job["since"]:
                return False, "not the next state"
            job["step"], job["since"] = job["step"] + 1, e.seq
            return True, None
        if e.kind == "claim":
            if self.exclusive and job["worker"] != e.value and self._runs(job, e.at):
                return False, "leased"
            job["worker"], job["claimed"], job["mode"] = e.value, e.at, "running"
            self._timed(job, now)
            return True, None
        if e.kind == "result":
            if job["worker"] != e.value or not self._runs(job, e.at):
                return False, "paused" if job["mode"] == "paused" else "late"
            if self.renew:
                job["claimed"] = e.at
                self._timed(job, now)
            return True, None
        if e.kind in ("pause", "cancel"):
            if job["step"] == len(self.order):
                return False, "ready"
            job["mode"], job["worker"], job["claimed"] = ("paused" if e.kind == "pause" else "cancelled"), None, None
            self._timed(job, None)
            return True, None
        return False, "unknown kind"

    def _change(self, key: tuple, seq: int | None, kind: str, accepted: bool, job: dict, why: str | None) -> Row:
        state = self.order[job["step"] - 1] if job["step"] else None
        return Row(job_id=key[0], seq=seq, kind=kind, accepted=accepted, state=state, since=job["since"], why=why)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.job.exists()
        job = dict(zip(("step", "since", "worker", "claimed", "timer", "mode"), self.job.get() if known else (0, -1, None, None, None, "new")))
        if not known:
            yield self._change(key, None, "seen", True, job, None)
        now = timerValues.getCurrentProcessingTimeInMs()
        for e in sorted(rows, key=lambda e: (e.at is not None, e.at or 0, e.seq or 0)):
            accepted, why = self._take(job, e, now)
            yield self._change(key, e.seq, e.kind, accepted, job, why)
        self.job.update(tuple(job.values()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.job.exists():
            return
        job = dict(zip(("step", "since", "worker", "claimed", "timer", "mode"), self.job.get()))
        if job["timer"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        job["worker"], job["claimed"], job["timer"] = None, None, None
        self.job.update(tuple(job.values()))
        yield self._change(key, None, "expired", True, job, None)


@contextmanager
def started_with(spark: SparkSession, **settings: str):
    """A stream takes its settings when it starts; afterwards the session has its own again."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: ``transformWithState`` needs the RocksDB state store.
LIVE = {"spark.sql.streaming.stateStore.providerClass": STORE}
#: A run over what is at hand would wait for timers for ever, were there batches without data.
AT_HAND = LIVE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def changes(
    events: DataFrame, lease: int = LEASE_SECONDS, order: tuple[str, ...] = STATES, exclusive: bool = True, renew: bool = True, keep_days: int = 30
) -> DataFrame:
    """A row (``CHANGES``) for each event of a streaming log, for each job when it is first seen, and for each lease that ran out.

    events: (job_id, seq, at, kind, value), at in microseconds; value is the state asked for, or the worker.
    """
    own = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), "kind", F.col("value").cast("string").alias("value"))
    machine = JobMachine(lease, order, exclusive, renew, keep_days)
    return own.groupBy("job_id").transformWithState(statefulProcessor=machine, outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def start(events: DataFrame, out: str, checkpoint: str, every: str = "1 second", **rules) -> StreamingQuery:
    """Keep jobs up to date; timers fire at each trigger."""
    with started_with(events.sparkSession, **LIVE):
        writer = changes(events, **rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime=every).start()


def run(events: DataFrame, out: str, checkpoint: str, **rules) -> DataFrame:
    """Take all events at hand and write the changes to ``out``; what is there from all runs so far."""
    spark = events.sparkSession
    with started_with(spark, **AT_HAND):
        writer = changes(events, **rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(out)


def current(found: DataFrame) -> DataFrame:
    """(job_id, state, since) from all changes."""
    return found.groupBy("job_id").agg(F.max_by("state", "since").alias("state"), F.max("since").alias("since"))
