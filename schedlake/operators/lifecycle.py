"""Lifecycle analytics: state from transitions, attempts, overlapping runs.

An execution's log is folded in time order, and the fold must not need one task per execution: an
execution may hold a large share of all transitions. The log is therefore cut by (execution, hour) and,
inside an hour, into chunks of bounded length. A short chunk travels as it is. A long one travels as a
table that tells, for every state it may be entered in, the state it leaves behind; such tables compose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.clock import truncate
from schedlake.schemas import DEFAULT_MAX_RETRY, TIMEOUT_MESSAGE

CHUNK_ROWS = 4096
RAW_ROWS = 64
STRETCH = 64
ENTRY_STATUSES = "array('PENDING', 'RUNNING', 'FAILED', 'TIMEOUT', 'SUCCESS')"
LOG_TYPE = "array<struct<ts: timestamp_ntz, seq: bigint, kind: string, error_message: string, result: string>>"
STATE_TYPE = """struct<status: string, retry_count: int, started_at: timestamp_ntz, finished_at: timestamp_ntz,
    error_message: string, result: string, applied: bigint, steps: bigint,
    set_started: boolean, set_finished: boolean, set_error: boolean, set_result: boolean>"""


def _state(status: str, retry_count: str) -> str:
    """SQL state of an execution before a stretch of its log."""
    return f"""cast(named_struct('status', {status}, 'retry_count', {retry_count}, 'started_at', NULL,
        'finished_at', NULL, 'error_message', NULL, 'result', NULL, 'applied', 0, 'steps', 0,
        'set_started', false, 'set_finished', false, 'set_error', false, 'set_result', false) AS {STATE_TYPE})"""


START = _state("'PENDING'", "0")


def _legal(a: str) -> str:
    """SQL test whether transition e may happen in state a."""
    return f"""CASE {a}.status WHEN 'PENDING' THEN e.kind IN ('claim', 'delete')
        WHEN 'RUNNING' THEN e.kind IN ('complete', 'fail', 'timeout', 'delete')
        WHEN 'DELETED' THEN false WHEN 'SUCCESS' THEN e.kind = 'delete' ELSE e.kind IN ('retry', 'delete') END"""


def _after(a: str) -> str:
    """SQL state after the legal transition e in state a."""
    ended = "e.kind IN ('fail', 'timeout')"
    again = f"({ended} AND {a}.retry_count + 1 < max_retry)"
    restart = f"(e.kind = 'retry' OR {again})"
    return f"""named_struct(
        'status', CASE WHEN {restart} THEN 'PENDING' WHEN e.kind = 'claim' THEN 'RUNNING' WHEN e.kind = 'complete'
            THEN 'SUCCESS' WHEN e.kind = 'fail' THEN 'FAILED' WHEN e.kind = 'timeout' THEN 'TIMEOUT' ELSE 'DELETED' END,
        'retry_count', {a}.retry_count + IF({ended}, 1, 0),
        'started_at', CASE WHEN {restart} THEN NULL WHEN e.kind = 'claim' THEN e.ts ELSE {a}.started_at END,
        'finished_at', CASE WHEN {restart} THEN NULL WHEN e.kind IN ('complete', 'fail', 'timeout') THEN e.ts
            ELSE {a}.finished_at END,
        'error_message', CASE e.kind WHEN 'timeout' THEN '{TIMEOUT_MESSAGE}' WHEN 'fail' THEN e.error_message
            WHEN 'retry' THEN NULL ELSE {a}.error_message END,
        'result', CASE e.kind WHEN 'complete' THEN e.result WHEN 'retry' THEN NULL ELSE {a}.result END,
        'applied', {a}.applied + 1, 'steps', {a}.steps + IF(e.kind IN ('retry', 'delete'), 0, 1),
        'set_started', {a}.set_started OR e.kind = 'claim' OR {restart},
        'set_finished', {a}.set_finished OR e.kind IN ('complete', 'fail', 'timeout', 'retry'),
        'set_error', {a}.set_error OR e.kind IN ('fail', 'timeout', 'retry'),
        'set_result', {a}.set_result OR e.kind IN ('complete', 'retry'))"""


# An illegal transition hands the state on as it is, which costs next to nothing.
_STEP = f"(a, e) -> IF({_legal('a')}, {_after('a')}, a)"

# State a after a chunk whose table has one exit state per entry state; o is the exit for a.
_BUDGET = "greatest(max_retry - 1, 0)"  # retry counts beyond it behave alike
_COMPOSE = f"""transform(array(item.table[CAST((array_position({ENTRY_STATUSES}, a.status) - 1) * ({_BUDGET} + 1)
        + least(a.retry_count, {_BUDGET}) AS INT)]), o -> named_struct(
    'status', o.status, 'retry_count', a.retry_count + o.retry_count - least(a.retry_count, {_BUDGET}),
    'started_at', IF(o.set_started, o.started_at, a.started_at),
    'finished_at', IF(o.set_finished, o.finished_at, a.finished_at),
    'error_message', IF(o.set_error, o.error_message, a.error_message),
    'result', IF(o.set_result, o.result, a.result),
    'applied', a.applied + o.applied, 'steps', a.steps + o.steps,
    'set_started', a.set_started OR o.set_started, 'set_finished', a.set_finished OR o.set_finished,
    'set_error', a.set_error OR o.set_error, 'set_result', a.set_result OR o.set_result))[0]"""
# One item of a log: either a raw stretch or a table, the other being empty.
_ADVANCE = f"""aggregate(item.log, IF(size(item.table) = 0 OR a.status = 'DELETED', a, {_COMPOSE}), {_STEP})"""

_ENTRIES = f"""flatten(transform({ENTRY_STATUSES}, s -> transform(sequence(0, {_BUDGET}), r -> {_state('s', 'r')})))"""
_NO_LOG = f"cast(array() AS {LOG_TYPE})"
_NO_TABLE = f"cast(array() AS array<{STATE_TYPE}>)"


def _fold(items: str, start: str) -> str:
    return f"aggregate({items}, {start}, (a, item) -> {_ADVANCE})"


def with_limit(transitions: DataFrame, max_retry: Column | None, limit_by_id: bool = False) -> DataFrame:
    """Transitions with ``max_retry``, one for each execution: that of its first row by (ts, seq).

    A limit that follows from the execution's id (``limit_by_id``) needs no look at the first row.
    """
    if max_retry is None:
        return transitions.withColumn("max_retry", F.lit(DEFAULT_MAX_RETRY))
    limit = F.coalesce(max_retry, F.lit(DEFAULT_MAX_RETRY)).cast("int")
    if limit_by_id:
        return transitions.withColumn("max_retry", limit)
    limits = transitions.groupBy("execution_id").agg(F.min_by(limit, F.struct("ts", "seq")).alias("max_retry"))
    return transitions.drop("max_retry").join(limits, "execution_id")


def _chunks(limited: DataFrame, chunk_rows: int, slice_unit: str) -> DataFrame:
    """The log in bounded chunks: (execution_id, max_retry, hour, chunk, log). One shuffle by (execution, hour)."""
    rows = limited.select(
        "execution_id", "max_retry", truncate(slice_unit, "ts").alias("hour"),
        F.struct("ts", "seq", "kind", "error_message", "result").alias("e"))
    place = F.row_number().over(Window.partitionBy("execution_id", "max_retry", "hour").orderBy("e.ts", "e.seq"))
    rows = rows.withColumn("chunk", F.floor((place - 1) / F.lit(chunk_rows)).cast("int"))
    return rows.groupBy("execution_id", "max_retry", "hour", "chunk").agg(
        F.array_sort(F.collect_list("e")).alias("log"))


def _gathered(parts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Per key the items of its parts in the order of ``place``, and one item for them all."""
    # Only the place may order the items: entries of a table need not be comparable.
    rows = parts.groupBy(*keys).agg(F.expr(f"""array_sort(collect_list(struct({place}, item)),
        (l, r) -> CASE WHEN l.{place} < r.{place} THEN -1 WHEN l.{place} > r.{place} THEN 1 ELSE 0 END)""").alias("parts"))
    rows = rows.select(*keys, F.col(f"parts.{place}").alias("places"), F.col("parts.item").alias("items"))
    whole = f"""IF(size(items) = 1, items[0], named_struct('n', aggregate(items.n, 0L, (x, y) -> x + y),
        'log', {_NO_LOG}, 'table', transform({_ENTRIES}, x -> {_fold('items', 'x')})))"""
    return rows.withColumn("item", F.expr(whole))


def _items(chunks: DataFrame, raw_rows: int) -> DataFrame:
    """Per (execution, hour) the ordered items of its chunks and one item for the whole hour."""
    table = f"transform({_ENTRIES}, x -> aggregate(log, x, {_STEP}))"
    item = f"""IF(size(log) <= {raw_rows}, named_struct('n', cast(size(log) AS BIGINT), 'log', log, 'table', {_NO_TABLE}),
        named_struct('n', cast(size(log) AS BIGINT), 'log', {_NO_LOG}, 'table', {table}))"""
    parts = chunks.select("execution_id", "max_retry", "hour", "chunk", F.expr(item).alias("item"))
    return _gathered(parts, ["execution_id", "max_retry", "hour"], "chunk")


def _by_execution(hours: DataFrame) -> DataFrame:
    """Per execution its hour items in order; their number is bounded by the calendar."""
    return hours.groupBy("execution_id", "max_retry").agg(F.expr("""array_sort(collect_list(struct(hour, item)),
        (l, r) -> CASE WHEN l.hour < r.hour THEN -1 WHEN l.hour > r.hour THEN 1 ELSE 0 END)""").alias("hs"))


STATES_SCHEMA = f"execution_id bigint, max_retry int, state {STATE_TYPE}, n bigint, last timestamp_ntz"


def advance(states: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK_ROWS, raw_rows: int = RAW_ROWS,
            slice_unit: str = "hour") -> DataFrame:
    """``states`` after later rows of the log: the rows become items first, and each state is then taken through its
    execution's items. ``n`` counts an execution's rows, ``last`` is the slice of its last one.

    Executions without a state start anew, with the limit of their first row; those without rows keep their state.
    """
    limit = F.coalesce("max_retry", F.lit(DEFAULT_MAX_RETRY)).cast("int")
    limits = rows.groupBy("execution_id").agg(F.min_by(limit, F.struct("ts", "seq")).alias("_first"))
    known = states.select("execution_id", F.col("max_retry").alias("_known"))
    limits = limits.join(known, "execution_id", "left").select("execution_id", F.coalesce("_known", "_first").alias("max_retry"))
    hours = _by_execution(_items(_chunks(rows.drop("max_retry").join(limits, "execution_id"), chunk_rows, slice_unit), raw_rows))
    old = states.select("execution_id", F.col("max_retry").alias("_old_limit"), "state", F.col("n").alias("_n"), F.col("last").alias("_last"))
    joined = old.join(hours.withColumnRenamed("max_retry", "_new_limit"), "execution_id", "full").withColumn(
        "max_retry", F.coalesce("_old_limit", "_new_limit"))
    folded = f"IF(hs IS NULL, state, {_fold('hs.item', f'coalesce(state, {START})')})"
    return joined.select(
        "execution_id", "max_retry", F.expr(folded).alias("state"),
        F.expr("coalesce(_n, 0L) + coalesce(aggregate(hs.item.n, 0L, (x, y) -> x + y), 0L)").alias("n"),
        F.expr("coalesce(element_at(hs, -1).hour, _last)").alias("last"))


def state_columns(states: DataFrame) -> DataFrame:
    """States as ``current_state`` gives them."""
    return states.where("state.status <> 'DELETED'").select(
        "execution_id", "state.status", "state.retry_count", "state.started_at", "state.finished_at", "state.error_message",
        "state.result", "state.applied", (F.col("n") - F.col("state.applied")).alias("ignored"))


def current_state(transitions: DataFrame, max_retry: Column | None = None, chunk_rows: int = CHUNK_ROWS,
                  raw_rows: int = RAW_ROWS, slice_unit: str = "hour", limit_by_id: bool = False) -> DataFrame:
    """The state of each execution after its log, ordered by (ts, seq).

    Each starts PENDING with no retries. Illegal transitions change nothing and are counted as ``ignored``.
    ``max_retry`` is a column of ``transitions``; the first row of an execution sets it, unless it follows from the id
    anyhow (``limit_by_id``), which saves two shuffles. Deleted executions are gone. ``slice_unit`` is the time slice a
    task orders at once; a log that packs a hot execution into few hours takes ``minute``.
    """
    hours = _items(_chunks(with_limit(transitions, max_retry, limit_by_id), chunk_rows, slice_unit), raw_rows)
    # The test inside the explode folds once; a filter on the folded status would fold a second time.
    rows = "aggregate(hs.item.n, 0L, (x, y) -> x + y)"
    state = _by_execution(hours).select("execution_id", F.expr(rows).alias("rows"), F.explode(F.expr(
        f"filter(array({_fold('hs.item', START)}), s -> s.status <> 'DELETED')")).alias("s"))
    return state.select(
        "execution_id", "s.status", "s.retry_count", "s.started_at", "s.finished_at", "s.error_message", "s.result",
        "s.applied", (F.col("rows") - F.col("s.applied")).alias("ignored"))


def _seen(items: str, start: str) -> str:
    """SQL array of the states before each item."""
    return f"""aggregate({items}, named_struct('now', {start}, 'before', {_NO_TABLE}), (z, item) ->
        transform(array(z.now), a -> named_struct('now', {_ADVANCE}, 'before', concat(z.before, array(a))))[0],
        z -> z.before)"""


def _entered(parts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``keys, place, entry``: the state before each part of gathered ones, from that before their first (``entry``)."""
    return parts.select(*keys, F.explode(F.arrays_zip(F.col("places").alias("place"), F.expr(_seen("items", "entry")).alias("entry"))).alias("z")).select(
        *keys, F.col("z.place").alias(place), "z.entry")


def accepted_steps(transitions: DataFrame, max_retry: Column | None = None, chunk_rows: int = CHUNK_ROWS,
                   raw_rows: int = RAW_ROWS, slice_unit: str = "hour", limit_by_id: bool = False) -> DataFrame:
    """The accepted claims and ends of each execution as ``(execution_id, step, ts, kind, error_message)``.

    ``step`` counts from 0. The states before each day, hour and chunk are worked out from the items alone, each
    among the parts of the one above; every chunk is then replayed on its own, in stretches. So no array of states or
    steps is longer than the parts of one level, or a stretch, and the work grows with the rows.
    """
    key = ["execution_id", "max_retry"]
    chunks = _chunks(with_limit(transitions, max_retry, limit_by_id), chunk_rows, slice_unit)
    hours = _items(chunks, raw_rows)
    days = _gathered(hours.withColumn("day", F.to_date("hour")).select(*key, "day", "hour", "item"), [*key, "day"], "hour")
    whole = _gathered(days.select(*key, "day", "item"), key, "day")
    before_day = _entered(whole.withColumn("entry", F.expr(START)), key, "day")
    before_hour = _entered(days.join(before_day, [*key, "day"]), key, "hour")
    before_chunk = _entered(hours.join(before_hour, [*key, "hour"]), [*key, "hour"], "chunk")
    replay = f"""aggregate(x.part, named_struct('now', x.entry, 'steps', cast(array() AS array<struct<
        step: bigint, ts: timestamp_ntz, kind: string, error_message: string>>)), (z, e) -> IF(NOT {_legal('z.now')}, z,
            transform(array({_after('z.now')}), b -> named_struct('now', b, 'steps',
                IF(b.steps = z.now.steps, z.steps, concat(z.steps, array(named_struct('step', z.now.steps, 'ts', e.ts,
                    'kind', e.kind, 'error_message', b.error_message))))))[0]),
        z -> z.steps)"""
    cut = f"transform(sequence(0, (size(log) - 1) div {STRETCH}), i -> slice(log, cast(i * {STRETCH} + 1 AS INT), {STRETCH}))"
    entries = f"""aggregate(cut, named_struct('now', entry, 'before', {_NO_TABLE}), (z, part) -> named_struct(
        'now', aggregate(part, z.now, {_STEP}), 'before', concat(z.before, array(z.now))), z -> z.before)"""
    parts = chunks.join(before_chunk, [*key, "hour", "chunk"]).withColumn("cut", F.expr(cut)).withColumn("entries", F.expr(entries))
    zipped = F.arrays_zip(F.col("cut").alias("part"), F.col("entries").alias("entry"))
    stretches = parts.select(*key, F.explode(zipped).alias("x"))
    steps = stretches.select("execution_id", F.explode(F.expr(replay)).alias("s"))
    return steps.select("execution_id", "s.*")


def attempts(transitions: DataFrame, max_retry: Column | None = None, chunk_rows: int = CHUNK_ROWS,
             raw_rows: int = RAW_ROWS, slice_unit: str = "hour", limit_by_id: bool = False) -> DataFrame:
    """Every attempt of each execution: number, start, end, outcome (NULL while running) and error.

    Accepted claims and ends alternate, so an attempt is a pair of steps: a group of at most two rows.
    """
    steps = accepted_steps(transitions, max_retry, chunk_rows, raw_rows, slice_unit, limit_by_id)
    is_claim = F.col("kind") == "claim"
    return steps.groupBy("execution_id", F.floor(F.col("step") / 2).alias("_pair")).agg(
        F.max(F.when(is_claim, F.col("ts"))).alias("claimed_at"),
        F.max(F.when(~is_claim, F.col("ts"))).alias("ended_at"),
        F.max(F.when(~is_claim, F.col("kind"))).alias("outcome"),
        F.max(F.when(F.col("kind").isin("fail", "timeout"), F.col("error_message"))).alias("error_message"),
    ).select("execution_id", (F.col("_pair") + 1).alias("attempt"), "claimed_at", "ended_at", "outcome",
             "error_message")


def overlaps(execs: DataFrame, defs: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Runs of a definition without overlap that start before an earlier run of it ended.

    The latest end so far is taken per (job, hour) and combined with that of the hours before, so a job
    with a large share of all runs is spread over its hours. A run that never ended blocks all later ones.
    """
    exclusive = defs.filter("NOT allow_overlap").select(F.col("id").alias("job_id"))
    runs = execs.filter("started_at IS NOT NULL AND job_id IS NOT NULL").select(
        "id", "job_id", "started_at", truncate(slice_unit, "started_at").alias("hour"),
        F.coalesce("finished_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("until"))
    runs = runs.join(exclusive, "job_id", "left_semi")
    earlier = Window.partitionBy("job_id", "hour").orderBy("started_at", "id").rowsBetween(
        Window.unboundedPreceding, -1)
    hours = runs.groupBy("job_id", "hour").agg(F.max("until").alias("top"))
    before = F.max("top").over(Window.partitionBy("job_id").orderBy("hour").rowsBetween(
        Window.unboundedPreceding, -1))
    carried = hours.select("job_id", "hour", before.alias("carried"))
    out = runs.withColumn("local", F.max("until").over(earlier)).join(carried, ["job_id", "hour"])
    return out.select("id", "job_id", "started_at", F.greatest("local", "carried").alias("blocked_until")).filter(
        "blocked_until > started_at")
