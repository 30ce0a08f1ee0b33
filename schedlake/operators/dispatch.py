"""Insert-if-absent, overlap guard, handler resolution, poll replay and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.operators.joins import spread_join
from schedlake.operators.occurrences import cron_occurrences, day_digests, time_hash
from schedlake.operators.views import incomplete
from schedlake.schemas import DEFAULT_POLL_INTERVAL_SECONDS

KEY = ["job_id", "scheduled_time"]


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. ``min_by`` combines copies before the shuffle, so a key that holds a
    large share of the rows reaches its task as one row per map task."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_if_absent(new: DataFrame, existing: DataFrame, order: list[str] | None = None) -> DataFrame:
    """New rows whose (job_id, scheduled_time) is neither in ``existing`` nor earlier in the batch.

    SQL uniqueness: a row without a job never conflicts, so the key of such a row includes its order columns.
    """
    order = order or ["id"]
    own = [F.when(F.col("job_id").isNull(), F.col(c)).alias(f"_own_{i}") for i, c in enumerate(order)]
    names = [f"_own_{i}" for i in range(len(order))]
    unique = first_by_key(new.select("*", *own), KEY + names, order).drop(*names)
    # The history is reduced to the wanted keys first: a small batch is broadcast against it.
    wanted = new.filter("job_id IS NOT NULL").select(*KEY).distinct()
    taken = existing.select(*KEY).join(wanted, KEY, "left_semi")
    return unique.join(taken, KEY, "left_anti").select(*new.columns)


def exists_executions(keys: DataFrame, execs: DataFrame) -> DataFrame:
    """Keys (job_id, scheduled_time) that already have an execution."""
    return keys.join(execs.filter("job_id IS NOT NULL").select(*KEY), KEY, "left_semi")


def overlap_guard(due: DataFrame, execs: DataFrame) -> DataFrame:
    """Due rows that may run: a definition without overlap must have nothing incomplete, and of several
    due ticks of such a definition only the earliest stays."""
    busy = incomplete(execs).filter("job_id IS NOT NULL").select(F.col("job_id").alias("_busy")).distinct()
    free = due.join(busy, (F.col("id") == F.col("_busy")) & ~F.col("allow_overlap"), "left_anti")
    rest = [c for c in due.columns if c != "id"]
    tick = F.when(F.col("allow_overlap"), F.col("scheduled_time")).alias("_tick")
    first = free.groupBy("id", tick).agg(F.min_by(F.struct(*rest), "scheduled_time").alias("_row"))
    return first.select(*[F.col(c) if c == "id" else F.col(f"_row.{c}").alias(c) for c in due.columns])


def resolve_handler(triggers: DataFrame, defs: DataFrame, spread_by: list[str]) -> DataFrame:
    """Adds ``resolved_id`` and ``base_params`` of the definition with the smallest id for the handler,
    for triggers that carry no job id (NULL or 0). The others are spread by ``spread_by``."""
    owners = defs.groupBy(F.col("handler_name").alias("_handler")).agg(
        F.min_by(F.struct(F.col("id"), F.col("handler_params")), "id").alias("_owner"))
    wanted = triggers.withColumn("_wanted", F.when(F.coalesce(F.col("job_id"), F.lit(0)) == 0, F.col("handler_name")))
    return spread_join(wanted, owners, "_wanted", "_handler", "left", spread_by).select(
        *triggers.columns, F.col("_owner.id").alias("resolved_id"),
        F.col("_owner.handler_params").alias("base_params"))


def due_at_polls(occurrences: DataFrame, polls: DataFrame,
                 window_seconds: int = DEFAULT_POLL_INTERVAL_SECONDS) -> DataFrame:
    """For each poll and definition the latest tick before it, at most ``window_seconds`` old.

    A bucketed as-of join: a poll can only match ticks of its own time bucket and the one before.
    """
    width = f"{window_seconds} seconds"
    ticks = occurrences.select("id", "tick", F.window("tick", width)["start"].alias("_bucket"))
    asked = polls.select("poll_ts", F.expr(f"poll_ts - interval {width}").alias("_from"),
                         F.window("poll_ts", width)["start"].alias("_last"))
    asked = asked.select("poll_ts", "_from", F.explode(F.expr(
        f"array(_last - interval {width}, _last)")).alias("_bucket"))
    near = ticks.join(asked, "_bucket").filter("tick < poll_ts AND tick >= _from")
    return near.groupBy("poll_ts", "id").agg(F.max("tick").alias("scheduled_time"))


def due_definitions_at_polls(defs: DataFrame, polls: DataFrame, start, end,
                             window_seconds: int = DEFAULT_POLL_INTERVAL_SECONDS) -> DataFrame:
    """:func:`due_at_polls` of the ticks in ``[start, end)``, of which only the polled minutes are produced."""
    first = F.date_trunc("minute", F.expr(f"poll_ts - interval {window_seconds} seconds")).cast("timestamp_ntz")
    last = F.date_trunc("minute", "poll_ts").cast("timestamp_ntz")
    minutes = polls.select(F.explode(F.sequence(first, last, F.expr("interval 1 minute"))).alias("minute")).distinct()
    return due_at_polls(cron_occurrences(defs, start, end, minutes), polls, window_seconds)


def reconcile_definitions(defs: DataFrame, execs: DataFrame, start, end) -> DataFrame:
    """Ticks of the enabled definitions in ``[start, end)`` against their executions; disabled ones expect none."""
    return reconcile(cron_occurrences(defs.filter("is_enabled"), start, end), execs)


def reconcile(occurrences: DataFrame, execs: DataFrame) -> DataFrame:
    """Expected ticks against executions: ``matched``, ``missed`` or ``unscheduled`` per (job, time)."""
    expected = occurrences.select(F.col("id").alias("e_job"), F.col("tick").alias("e_time"))
    made = execs.filter("job_id IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("executions"))
    both = expected.join(made, (F.col("e_job") == F.col("job_id")) & (F.col("e_time") == F.col("scheduled_time")),
                         "full_outer")
    outcome = F.when(F.col("job_id").isNull(), "missed").when(F.col("e_job").isNull(), "unscheduled").otherwise(
        "matched")
    return both.select(F.coalesce("e_job", "job_id").alias("job_id"),
                       F.coalesce("e_time", "scheduled_time").alias("scheduled_time"),
                       F.coalesce("executions", F.lit(0)).alias("executions"), outcome.alias("outcome"))


def differing_days(defs: DataFrame, made: DataFrame, start, end) -> DataFrame:
    """``id, day`` where the executions of a definition may differ from its ticks in ``[start, end)``.

    Both sides are compared by count and combined hash per (job, day). Days that the range cuts always count as different.
    """
    micros = "(unix_micros(cast(scheduled_time AS TIMESTAMP)) - unix_micros(cast(to_date(scheduled_time) AS TIMESTAMP)))"
    found = made.groupBy(F.col("job_id").alias("id"), F.to_date("scheduled_time").alias("day")).agg(
        F.count("*").alias("found"), F.expr(f"bit_xor({time_hash(micros)})").alias("found_digest"))
    both = day_digests(defs, start, end).join(found, ["id", "day"], "full_outer")
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    cut = (F.col("day").cast("timestamp_ntz") < first) | (F.date_add("day", 1).cast("timestamp_ntz") > last)
    same = F.col("n").eqNullSafe(F.col("found")) & F.col("digest").eqNullSafe(F.col("found_digest"))
    return both.filter(~same | cut).select("id", "day")


def reconcile_differences(defs: DataFrame, execs: DataFrame, start, end) -> DataFrame:
    """What ``reconcile_definitions`` gives, without the matched rows: only days that differ are opened."""
    enabled = defs.filter("is_enabled")
    jobs = execs.filter("job_id IS NOT NULL")
    days = differing_days(enabled, jobs.select(*KEY).distinct(), start, end)
    rows = jobs.withColumn("_day", F.to_date("scheduled_time")).join(
        days.select(F.col("id").alias("job_id"), F.col("day").alias("_day")), ["job_id", "_day"], "left_semi")
    return reconcile(cron_occurrences(enabled, start, end, days=days), rows).filter("outcome <> 'matched'")


def union_sources(cron_rows: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Both dispatchers feed one table; ``param_source`` tells the origin."""
    return cron_rows.withColumn("param_source", F.lit("cron")).unionByName(
        event_rows.withColumn("param_source", F.lit("event")), allowMissingColumns=True)
