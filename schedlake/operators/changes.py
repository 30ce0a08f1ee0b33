"""Bulk changes of both tables. Each takes the current table and returns the next one; land it as a snapshot."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.clock import elapsed_seconds
from schedlake.operators.dispatch import first_by_key
from schedlake.operators.joins import missing, spread_join
from schedlake.operators.validate import duplicate_names, validate_cron, validate_definitions
from schedlake.operators.views import not_retryable_reason, pending, terminal, with_definition
from schedlake.schemas import (
    DEFAULT_MIN_INTERVAL_SECONDS, FAILED, PENDING, RETRYABLE, RUNNING, SUCCESS, TIMEOUT, TIMEOUT_MESSAGE,
    definition_defaults, ntz)

NUMBERING_BUCKETS_HEX = 3  # 4,096 buckets


class Change(NamedTuple):
    """The table after a change and the requests that were turned down."""

    table: DataFrame
    rejected: DataFrame


def _replace(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


# Definitions

def number_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rn``, a gapless 1-based number in the order of (md5 of the keys, keys).

    Rows are numbered inside hash buckets and shifted by the sizes of the buckets before, so the
    numbering of a large batch is not done by a single task. The keys must identify a row.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    rows = df.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, NUMBERING_BUCKETS_HEX)})
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", *keys))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn("_inside", inside).join(shift, "_bucket").select(
        *df.columns, (F.col("_inside") + F.col("_before")).alias("rn"))


def assign_ids(rows: DataFrame, keys: list[str], after: Column | int) -> DataFrame:
    """Rows with ``id`` counting on from ``after``, the greatest id in use."""
    numbered = number_rows(rows.drop("id"), keys)
    after = F.lit(after) if isinstance(after, int) else after
    return numbered.withColumn("id", F.col("rn") + after).select(*rows.columns)


def insert_definitions(defs: DataFrame, new: DataFrame, now,
                       min_interval: int = DEFAULT_MIN_INTERVAL_SECONDS) -> Change:
    """Adds new definitions (no id) that pass every check, numbered after the greatest id.

    ``rejected`` holds the others with their ``errors``.
    """
    new = new.withColumn("id", F.lit(None).cast("bigint"))
    rows = validate_definitions(definition_defaults(new, now))
    clashes = duplicate_names(defs, new).select(F.col("name").alias("_clash"), F.col("reason").alias("_name_error"))
    rows = validate_cron(rows, now, min_interval).join(
        clashes.distinct(), F.col("name") == F.col("_clash"), "left")
    rows = rows.withColumn("errors", F.array_compact(F.concat(
        "errors", F.array(F.col("reason"), F.concat(F.lit("name_"), F.col("_name_error"))))))
    good = rows.filter(F.size("errors") == 0).select(*defs.columns)
    added = assign_ids(good, ["name"], defs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())
    rejected = rows.filter(F.size("errors") > 0).select("name", "cron_expression", "errors")
    return Change(defs.unionByName(added), rejected)


PATCHABLE = ["name", "description", "cron_expression", "handler_name", "handler_params", "is_enabled",
             "allow_overlap", "max_retry", "timeout_seconds"]


def update_definitions(defs: DataFrame, patches: DataFrame, now,
                       min_interval: int = DEFAULT_MIN_INTERVAL_SECONDS) -> Change:
    """Sparse patches by id, one per definition: NULL or an absent column keeps the old value.

    The patched rows pass the checks of new definitions, the cron check where the expression changes; names are
    compared with the definitions as they are and with the other patches. ``rejected`` has the id and the ``errors`` of
    patches that fail, of unknown ids and of ids with several patches.
    """
    fields = [c for c in PATCHABLE if c in patches.columns]
    right = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    single = right.groupBy("_id").agg(F.count("*").alias("_patches"), *[F.first(f"_{c}").alias(f"_{c}") for c in fields])
    known = defs.join(single, F.col("id") == F.col("_id"))
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    changed = {f"_was_{c}": F.col(c) for c in ("name", "cron_expression")}
    rows = _replace(known.withColumns(changed), values).withColumn("updated_at", ntz(now))
    rows = validate_cron(validate_definitions(rows), now, min_interval)
    renamed = rows.filter(~F.col("name").eqNullSafe(F.col("_was_name"))).select("id", "name")
    clashes = duplicate_names(defs, renamed).select(F.col("id").alias("_clash"), F.col("reason").alias("_name_error"))
    rows = rows.join(clashes.distinct(), F.col("id") == F.col("_clash"), "left")
    new_cron = ~F.col("cron_expression").eqNullSafe(F.col("_was_cron_expression"))
    rows = rows.withColumn("errors", F.array_compact(F.concat("errors", F.array(
        F.when(new_cron, F.col("reason")), F.concat(F.lit("name_"), F.col("_name_error")),
        F.when(F.col("_patches") > 1, F.lit("several_patches"))))))
    good = rows.filter(F.size("errors") == 0).select("id", F.struct(*defs.columns).alias("_new"))
    table = defs.join(good, "id", "left").select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in defs.columns])
    unknown = missing(patches.select("id").distinct(), defs, "id").select("id", F.array(F.lit("unknown_id")).alias("errors"))
    return Change(table, rows.filter(F.size("errors") > 0).select("id", "errors").unionByName(unknown))


def _flagged(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with ``_hit``: whether the row's id is among ``ids``."""
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    return df.join(wanted, F.col("id") == F.col("_id"), "left").withColumn("_hit", F.col("_id").isNotNull()).drop("_id")


def toggle_definitions(defs: DataFrame, ids: DataFrame, now) -> Change:
    flagged = _flagged(defs, ids)
    table = _replace(flagged, {
        "is_enabled": F.when(F.col("_hit"), ~F.col("is_enabled")).otherwise(F.col("is_enabled")),
        "updated_at": F.when(F.col("_hit"), ntz(now)).otherwise(F.col("updated_at"))})
    return Change(table.select(*defs.columns), missing(ids, defs, "id"))


def set_enabled(defs: DataFrame, ids: DataFrame, flag: bool, now) -> Change:
    flagged = _flagged(defs, ids)
    table = _replace(flagged, {
        "is_enabled": F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("is_enabled")),
        "updated_at": F.when(F.col("_hit"), ntz(now)).otherwise(F.col("updated_at"))})
    return Change(table.select(*defs.columns), missing(ids, defs, "id"))


def cascade_delete(execs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Executions without those of deleted definitions; rows without a job stay."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    return spread_join(execs, gone, "job_id", "_gone", "left_anti", ["id"])


class Deletion(NamedTuple):
    definitions: DataFrame
    executions: DataFrame
    missing: DataFrame


def delete_definitions(defs: DataFrame, execs: DataFrame, ids: DataFrame) -> Deletion:
    keys = ids.select("id").distinct()
    return Deletion(defs.join(keys, "id", "left_anti"), cascade_delete(execs, keys), missing(keys, defs, "id"))


# Executions

def claim(execs: DataFrame, n: int, now) -> DataFrame:
    """The n oldest PENDING rows become RUNNING."""
    first = pending(execs).select("id", "created_at").orderBy("created_at", "id").limit(n)
    return _replace(_flagged(execs, first), {
        "status": F.when(F.col("_hit"), RUNNING).otherwise(F.col("status")),
        "started_at": F.when(F.col("_hit"), ntz(now)).otherwise(F.col("started_at")),
    }).select(*execs.columns)


def apply_outcomes(execs: DataFrame, outcomes: DataFrame, defs: DataFrame, now) -> DataFrame:
    """Ends RUNNING rows by their outcome in one pass.

    ``outcomes`` has ``id``, ``kind`` (complete, fail, timeout), ``error_message`` and ``result``. A
    failure with attempts left goes back to PENDING and keeps its error message. Outcomes may be delivered
    more than once; of several for one run the first by (kind, error_message, result) counts.
    """
    once = first_by_key(outcomes.select("id", "kind", "error_message", "result"), ["id"], ["kind", "error_message", "result"])
    wanted = once.select("id", "kind", F.col("error_message").alias("_error"), F.col("result").alias("_result"))
    # Only RUNNING rows can end, so just those meet the outcomes and the definitions; the table itself
    # is joined once more with what changed.
    ending = execs.filter(F.col("status") == RUNNING).select("id", "job_id", "handler_name", "retry_count")
    ended = with_definition(ending.join(wanted, "id"), defs)
    failed = F.col("kind").isin("fail", "timeout")
    again = failed & (F.col("retry_count") + 1 < F.col("max_retry"))
    change = ended.select(
        F.col("id").alias("_id"), "kind", again.alias("_again"), failed.alias("_failed"),
        F.when(F.col("kind") == "timeout", TIMEOUT_MESSAGE).otherwise(F.col("_error")).alias("_error"), "_result")
    joined = execs.join(change, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    failed, again, done = (F.coalesce(c, F.lit(False)) for c in (
        F.col("_failed"), F.col("_again"), F.col("kind") == "complete"))
    return _replace(joined, {
        "status": F.when(again, PENDING).when(done, SUCCESS).when(F.col("kind") == "fail", FAILED).when(
            F.col("kind") == "timeout", TIMEOUT).otherwise(F.col("status")),
        "started_at": F.when(~again, F.col("started_at")),
        "finished_at": F.when(again, F.lit(None)).when(hit, ntz(now)).otherwise(F.col("finished_at")),
        "retry_count": F.col("retry_count") + F.when(failed, 1).otherwise(0),
        "error_message": F.when(failed, F.col("_error")).otherwise(F.col("error_message")),
        "result": F.when(done, F.col("_result")).otherwise(F.col("result")),
    }).select(*execs.columns)


def _no_text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def complete(execs: DataFrame, results: DataFrame, defs: DataFrame, now) -> DataFrame:
    """``results``: id and result of the runs that succeeded."""
    rows = results.select("id", F.lit("complete").alias("kind"), _no_text("error_message"), "result")
    return apply_outcomes(execs, rows, defs, now)


def fail(execs: DataFrame, failures: DataFrame, defs: DataFrame, now) -> DataFrame:
    """``failures``: id and error_message of the runs that failed."""
    rows = failures.select("id", F.lit("fail").alias("kind"), "error_message", _no_text("result"))
    return apply_outcomes(execs, rows, defs, now)


def time_out(execs: DataFrame, ids: DataFrame, defs: DataFrame, now) -> DataFrame:
    rows = ids.select("id", F.lit("timeout").alias("kind"), _no_text("error_message"), _no_text("result"))
    return apply_outcomes(execs, rows, defs, now)


def reset_to_pending(execs: DataFrame, ids: DataFrame) -> DataFrame:
    """Back to PENDING; the error message stays as history."""
    return _replace(_flagged(execs, ids), {
        "status": F.when(F.col("_hit"), PENDING).otherwise(F.col("status")),
        "started_at": F.when(~F.col("_hit"), F.col("started_at")),
        "finished_at": F.when(~F.col("_hit"), F.col("finished_at")),
    }).select(*execs.columns)


def retry(execs: DataFrame, ids: DataFrame) -> Change:
    """Failed and timed-out rows start over; the retry count stays. Others are rejected with the reason."""
    flagged = _flagged(execs, ids)
    hit = F.col("_hit") & F.col("status").isin(*RETRYABLE)
    cleared = {c: F.when(~hit, F.col(c)) for c in ("started_at", "finished_at", "error_message", "result")}
    table = _replace(flagged, {"status": F.when(hit, PENDING).otherwise(F.col("status")), **cleared})
    refused = flagged.filter(F.col("_hit")).select("id", not_retryable_reason().alias("reason")).filter(
        "reason IS NOT NULL")
    unknown = missing(ids.select("id"), execs, "id").select(
        "id", F.format_string("Job execution with id %d not found", "id").alias("reason"))
    return Change(table.select(*execs.columns), refused.unionByName(unknown))


def delete_executions(execs: DataFrame, ids: DataFrame) -> Change:
    keys = ids.select("id").distinct()
    return Change(execs.join(keys, "id", "left_anti"), missing(keys, execs, "id"))


def retain(execs: DataFrame, before) -> DataFrame:
    """Drops terminal rows created before an instant; PENDING and RUNNING rows always stay."""
    old = F.col("created_at") < ntz(before)
    return execs.filter(~(old & F.col("status").isin(SUCCESS, FAILED, TIMEOUT)))


def expired(execs: DataFrame, before) -> DataFrame:
    """What :func:`retain` drops."""
    return terminal(execs).filter(F.col("created_at") < ntz(before))


# Decisions

def retry_decision(execs: DataFrame, defs: DataFrame) -> DataFrame:
    """Per execution RETRY, EXHAUSTED or NOT_APPLICABLE and the attempts left."""
    rows = with_definition(execs, defs)
    left = F.greatest(F.col("max_retry") - F.col("retry_count"), F.lit(0))
    decision = F.when(~F.col("status").isin(*RETRYABLE), "NOT_APPLICABLE").when(
        F.col("retry_count") < F.col("max_retry"), "RETRY").otherwise("EXHAUSTED")
    return rows.select("id", "job_id", "status", "retry_count", "max_retry", decision.alias("decision"),
                       left.alias("attempts_left"))


def timeout_violations(execs: DataFrame, defs: DataFrame) -> DataFrame:
    """Finished runs that took longer than their timeout."""
    runs = execs.filter("started_at IS NOT NULL AND finished_at IS NOT NULL")
    rows = with_definition(runs, defs).withColumn("run_seconds", elapsed_seconds("started_at", "finished_at"))
    return rows.filter(F.col("run_seconds") > F.col("timeout_seconds")).select(
        "id", "job_id", "status", "run_seconds", "timeout_seconds")


def stuck(execs: DataFrame, defs: DataFrame, as_of) -> DataFrame:
    """RUNNING rows past their deadline."""
    rows = with_definition(execs.filter(F.col("status") == RUNNING), defs)
    deadline = F.timestamp_add("SECOND", F.col("timeout_seconds"), F.col("started_at"))
    return rows.withColumn("deadline", deadline).filter(F.col("deadline") < ntz(as_of)).select(
        "id", "job_id", "handler_name", "started_at", "timeout_seconds", "deadline")
