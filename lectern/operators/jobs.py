"""Durable jobs as tables: batches of vectors, bindings, leases, states and activation.

Jobs are keyed, and every computation is a join or an aggregation by job, so jobs are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH, LEASE_SECONDS = 4, 60
STATES = ("parsing", "parsed", "indexing", "ready")


def batch_plan(windows: DataFrame, size: int = BATCH) -> DataFrame:
    """(book_id, window_no, batch, ordinal, n): batches of ``size`` in each window, numbered over the whole book.

    windows: (book_id, window_no, items).
    """
    before = Window.partitionBy("book_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = windows.withColumn("batches", F.ceil(F.col("items") / size).cast("int")).withColumn("base", F.coalesce(F.sum("batches").over(before), F.lit(0)))
    each = counted.where("batches > 0").select("book_id", "window_no", "items", "base", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))
    return each.select("book_id", "window_no", "batch", (F.col("base") + F.col("batch")).alias("ordinal"), F.least(F.lit(size), F.col("items") - F.col("batch") * size).alias("n"))


def pending(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches that are planned and not stored, or stored under another binding: what a resumed job has to do.

    plan and stored: (book_id, ordinal, binding).
    """
    return plan.join(stored, ["book_id", "ordinal", "binding"], "left_anti")


def generation_rules(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """(book_id, planned, stored, missing, foreign, valid): a generation counts as valid when both agree batch by batch; repeated rows count once."""
    keys = ["book_id", "ordinal", "binding"]
    both = plan.select(*keys).distinct().withColumn("p", F.lit(1)).join(stored.select(*keys).distinct().withColumn("s", F.lit(1)), keys, "full_outer")
    per = both.groupBy("book_id").agg(F.count("p").alias("planned"), F.count("s").alias("stored"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("p").isNull()).alias("foreign"))
    return per.withColumn("valid", (F.col("missing") == 0) & (F.col("foreign") == 0))


def fenced(events: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Results with ``accepted``: whether their worker held the job's last claim before them and came within its lease.

    events: (job_id, seq, ts, worker, kind) with kind claim or result; ``seq`` orders a job's events.
    """
    before = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    claim = F.last(F.when(F.col("kind") == "claim", F.struct("worker", "ts")), ignorenulls=True).over(before)
    held = events.withColumn("c", claim).where("kind = 'result'")
    accepted = (F.col("c.worker") == F.col("worker")) & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("c.ts").cast("timestamp")) <= seconds * 1_000_000)
    return held.select("job_id", "seq", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def states(events: DataFrame, order: tuple[str, ...] = STATES) -> DataFrame:
    """(job_id, state, since): how far each job has come; a state is entered only from the one before it.

    events: (job_id, seq, state), the states that were asked for. A pass of aggregation for each state, whatever the
    number of events of a job.
    """
    jobs = events.select("job_id").distinct().select("job_id", F.lit(None).cast("string").alias("state"), F.lit(-1).cast("long").alias("since"))
    reached = jobs.withColumn("step", F.lit(0))
    for step, state in enumerate(order):
        asked = events.where(F.col("state") == state).select("job_id", "seq")
        later = asked.join(reached.where(F.col("step") == step).select("job_id", "since"), "job_id").where("seq > since")
        first = later.groupBy("job_id").agg(F.min("seq").alias("entered"))
        reached = reached.join(first, "job_id", "left").select(
            "job_id", F.when(F.col("entered").isNotNull(), F.lit(state)).otherwise(F.col("state")).alias("state"), F.coalesce("entered", "since").alias("since"),
            F.when(F.col("entered").isNotNull(), F.lit(step + 1)).otherwise(F.col("step")).alias("step"),
        )
    return reached.select("job_id", "state", "since")


def activations(requests: DataFrame, valid: DataFrame) -> DataFrame:
    """(book_id, generation, epoch): the pointer after requests in order, each taken only if the epoch it saw is still current.

    requests: (book_id, seq, expected, generation); valid: (book_id, generation). A request names an epoch that it has
    seen, and epochs count up by one for each that is taken; so of those that saw an epoch the first one with a valid
    generation is taken, up to the first epoch that nobody moved on from.
    """
    able = requests.join(valid, ["book_id", "generation"], "left_semi")
    winner = able.groupBy("book_id", "expected").agg(F.min_by("generation", "seq").alias("generation"))
    placed = winner.withColumn("in_row", F.row_number().over(Window.partitionBy("book_id").orderBy("expected")) - 1).where("in_row = expected")
    return placed.groupBy("book_id").agg(F.max_by("generation", "expected").alias("generation"), (F.max("expected") + 1).alias("epoch"))


def next_revisions(profiles: DataFrame) -> DataFrame:
    """(profile_id, next_revision) from (profile_id, revision)."""
    return profiles.groupBy("profile_id").agg((F.max("revision") + 1).alias("next_revision"))


def same_bytes(jobs: DataFrame) -> DataFrame:
    """(job_id, same_as): jobs started on the same bytes are the first of them. jobs: (job_id, source_hash)."""
    first = jobs.groupBy("source_hash").agg(F.min("job_id").alias("same_as"))
    return jobs.join(first, "source_hash").select("job_id", "same_as")
