"""One registered query per operator over the given tables."""

from schedlake.queries import (  # noqa: F401  (importing registers the queries)
    changes, cron, dispatching, handlers, history, lifecycle, payloads, reports, sinks, streams, validation)
from schedlake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
