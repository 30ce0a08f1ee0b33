"""Python handlers over a table of pending executions."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.functions.params import parse_params
from schedlake.schemas import DATABASE_ERROR, DEFAULT_TIMEOUT_SECONDS, HANDLER_NOT_FOUND, POOL_EXHAUSTED

# A row handler takes the parameters as a dict and returns a result dict or None.
RowHandler = Callable[[dict], dict | None]
# A batch handler takes rows as Arrow columns (id, action, name, value, extras) and returns as many result dicts, None or
# exceptions, as a list or an Arrow array.
BatchHandler = Callable[[pa.RecordBatch], Any]
# A table handler takes the pending rows of its name and the named input tables.
TableHandler = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]

OUTCOME_SCHEMA = "id long, kind string, error_message string, result string, elapsed_seconds double"


class PoolExhausted(Exception):
    """A handler found no free connection."""


class DatabaseFailure(Exception):
    """A handler's transaction or query failed."""


class Registry:
    """Handlers by name."""

    def __init__(self) -> None:
        self.rows: dict[str, RowHandler] = {}
        self.batches: dict[str, BatchHandler] = {}
        self.tables: dict[str, tuple[TableHandler, tuple[str, ...]]] = {}

    def handler(self, name: str):
        def register(fn: RowHandler) -> RowHandler:
            self.rows[name] = fn
            return fn
        return register

    def batch_handler(self, name: str):
        """A handler that is called once for many rows. It must bear to be called again for some of them: a call that
        fails or takes too long is repeated for either half of its rows, down to the row it fails for."""
        def register(fn: BatchHandler) -> BatchHandler:
            self.batches[name] = fn
            return fn
        return register

    def table_handler(self, name: str, inputs: tuple[str, ...] = ()):
        def register(fn: TableHandler) -> TableHandler:
            self.tables[name] = (fn, inputs)
            return fn
        return register

    def names(self) -> list[str]:
        return sorted({*self.rows, *self.batches, *self.tables})


def error_text(error: Exception) -> str:
    if isinstance(error, PoolExhausted):
        return f"{POOL_EXHAUSTED}{error}"
    if isinstance(error, DatabaseFailure):
        return f"{DATABASE_ERROR}{error}"
    return str(error)


RESULT_FIELDS = {"action": None, "success": True, "id": None, "count": None, "data": None, "error": None}


def result_text(result: dict | None) -> str | None:
    """JSON of a result: the known fields in order, with their defaults, then any others. It must name its action."""
    if result is None:
        return None
    text = json.dumps(RESULT_FIELDS | result, ensure_ascii=False, separators=(",", ":"))
    if not isinstance(result.get("action"), str):
        raise ValueError("result without an action")
    return text


class _Expired(BaseException):
    """Raised inside a run whose time is up; handlers that catch Exception do not stop it."""


class Watchdog:
    """Ends calls that take too long, all by one timer of the process.

    A signal stops a call where it stands, so nothing is left behind in the Python worker, which Spark uses again. Signals
    reach the main thread only; in any other a call gets a thread of its own, which goes on when it is given up.
    """

    def __init__(self) -> None:
        self.armed = False
        self.signals = hasattr(signal, "setitimer") and threading.current_thread() is threading.main_thread()

    def __enter__(self) -> Watchdog:
        if self.signals:
            self.before = signal.signal(signal.SIGALRM, self._ring)
        return self

    def __exit__(self, *_) -> None:
        if self.signals:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)

    def _ring(self, *_) -> None:
        if self.armed:
            self.armed = False
            raise _Expired

    def within(self, seconds: float, call: Callable[[], Any]) -> tuple[bool, Any]:
        """Whether a call ended in time, and its value."""
        if not self.signals:
            return _in_thread(seconds, call)
        try:
            self.armed = True
            signal.setitimer(signal.ITIMER_REAL, max(seconds, 1e-6))
            value = call()
            self.armed = False
            return True, value
        except _Expired:
            return False, None
        finally:
            self.armed = False


def _in_thread(seconds: float, call: Callable[[], Any]) -> tuple[bool, Any]:
    box: list = []

    def work() -> None:
        try:
            box.append((call(), None))
        except Exception as error:
            box.append((None, error))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        return False, None
    value, error = box[0]
    if error is not None:
        raise error
    return True, value


def _call(watchdog: Watchdog, seconds: float, call: Callable[[], Any]) -> tuple[str, Any, float]:
    """What became of a call, its value or error, and the seconds it took."""
    begin = time.monotonic()
    try:
        ended, value = watchdog.within(seconds, call)
        kind = "complete" if ended else "timeout"
    except Exception as error:  # one bad run must not fail the others
        kind, value = "fail", error
    return kind, value, time.monotonic() - begin


def _texts(results: Any, n: int) -> list[str | None | Exception]:
    """Results of a batch handler as JSON; an exception, or a result that cannot be written, is its row's failure."""
    results = results.to_pylist() if isinstance(results, (pa.Array, pa.ChunkedArray)) else list(results)
    if len(results) != n:
        raise ValueError(f"{len(results)} results for {n} rows")

    def text(result):
        if isinstance(result, Exception):
            return result
        try:
            return result_text(result)
        except Exception as error:
            return error
    return [text(r) for r in results]


class _Outcomes:
    """The outcomes of an Arrow batch of runs."""

    def __init__(self, runs: pa.RecordBatch, watchdog: Watchdog) -> None:
        self.columns = {name: runs.column(i).to_pylist() for i, name in enumerate(runs.schema.names)}
        self.runs, self.watchdog = runs, watchdog
        self.rows: list[tuple] = [()] * len(runs)

    def put(self, i: int, kind: str, value: Any, spent: float) -> None:
        text = value if kind == "complete" else None
        error = error_text(value) if isinstance(value, Exception) else value if kind == "fail" else None
        self.rows[i] = (self.columns["id"][i], kind, error, text, spent)

    def row(self, i: int, handler: RowHandler) -> None:
        c = self.columns
        params = json.loads(c["param_extras"][i] or "{}") | {
            "action": c["param_action"][i], "id": c["param_id"][i], "name": c["param_name"][i], "value": c["param_value"][i]}
        self.put(i, *_call(self.watchdog, c["timeout_seconds"][i], lambda: result_text(handler(params))))

    def batch(self, which: list[int], handler: BatchHandler) -> None:
        """One call for all rows, within the least of their timeouts; halves where it fails."""
        seconds = min(self.columns["timeout_seconds"][i] for i in which)
        rows = self.runs.take(pa.array(which, pa.int64()))
        params = pa.RecordBatch.from_arrays([rows.column(f"param_{c}") for c in PARAMETERS], names=PARAMETERS)
        kind, value, spent = _call(self.watchdog, seconds, lambda: _texts(handler(params), len(which)))
        if kind == "complete":
            for i, text in zip(which, value):
                self.put(i, "fail" if isinstance(text, Exception) else kind, text, spent / len(which))
        elif len(which) == 1:
            self.put(which[0], kind, value, spent)
        else:
            half = len(which) // 2
            self.batch(which[:half], handler)
            self.batch(which[half:], handler)

    def result(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
        columns = zip(*self.rows) if self.rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["id", "kind", "error_message", "result", "elapsed_seconds"])


PARAMETERS = ["id", "action", "name", "value", "extras"]


def _run_batches(rows: dict[str, RowHandler], batches: dict[str, BatchHandler]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            with Watchdog() as watchdog:
                out, together = _Outcomes(part, watchdog), {}
                for i, (name, bad) in enumerate(zip(out.columns["handler_name"], out.columns["params_error"])):
                    if name not in rows and name not in batches:
                        out.put(i, "fail", f"{HANDLER_NOT_FOUND}{name}", 0.0)
                    elif bad is not None:
                        out.put(i, "fail", bad, 0.0)
                    elif name in batches:
                        together.setdefault(name, []).append(i)
                    else:
                        out.row(i, rows[name])
                for name, which in together.items():
                    out.batch(which, batches[name])
            yield out.result()

    return run


def run_handlers(pending: DataFrame, registry: Registry) -> DataFrame:
    """Runs the row and batch handlers over pending rows (with ``timeout_seconds``) and returns their outcomes.

    Unknown handlers and invalid parameters fail. A run that is not done within its timeout, an hour where that is NULL,
    is a ``timeout``, and the next one starts. A name with both kinds of handlers takes that for batches. The order of the
    rows is not kept.
    """
    parsed = parse_params(pending.select("id", "handler_name", "params", "timeout_seconds"))
    runs = parsed.select(
        "id", "handler_name", F.coalesce("timeout_seconds", F.lit(DEFAULT_TIMEOUT_SECONDS)).cast("double").alias("timeout_seconds"),
        "param_action", "param_id", "param_name", "param_value", F.to_json("param_extras").alias("param_extras"),
        "params_error")
    # handlers take their time whatever the bytes of their rows, so these are not packed into partitions by size
    runs = runs.repartition(int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.mapInArrow(_run_batches(dict(registry.rows), dict(registry.batches)), OUTCOME_SCHEMA)


def run_table_handlers(pending: DataFrame, registry: Registry, tables: dict[str, DataFrame]) -> DataFrame:
    """Runs the table handlers: each gets all pending rows of its name and the tables it asked for.

    A table handler returns ``id`` and ``result``; every such row is a completed run.
    """
    done = None
    for name, (fn, inputs) in sorted(registry.tables.items()):
        rows = fn(pending.filter(F.col("handler_name") == name), {t: tables[t] for t in inputs}).select(
            "id", F.lit("complete").alias("kind"), F.lit(None).cast("string").alias("error_message"), "result",
            F.lit(0.0).alias("elapsed_seconds"))
        done = rows if done is None else done.unionByName(rows)
    if done is None:
        raise ValueError("no table handlers registered")
    return done
