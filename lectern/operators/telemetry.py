"""Counts and times of jobs and streams, without content.

``measured`` counts a result's rows while it is stored (``DataFrame.observe``), so nothing is computed twice, ``counted`` while
it is computed and dropped, for when nothing but the counts is wanted; ``Progress``
listens to streams and keeps, for each micro-batch, its number, rows in and milliseconds.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lectern.sources.scratch import stored


def measured(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """The rows, stored, and their number, the metrics (aggregates by name) and the seconds that it took."""
    seen, start = Observation(name), time.monotonic()
    out = stored(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]), name)
    return out, seen.get | {"seconds": time.monotonic() - start}


def counted(rows: DataFrame, name: str, **metrics: Column) -> dict:
    """What ``measured`` tells of the rows, all of which are computed and none kept."""
    seen, start = Observation(name), time.monotonic()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]).write.format("noop").mode("overwrite").save()
    return seen.get | {"seconds": time.monotonic() - start}


class Progress(StreamingQueryListener):
    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
