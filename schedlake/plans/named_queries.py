"""A catalogue of named, parameterised SQL statements over views."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STATEMENTS = Path(__file__).with_name("statements")


class NamedQueries:
    """Statements kept one per ``.sql`` file; ``:name`` markers take arguments, ``{view}`` takes DataFrames."""

    def __init__(self, folder: str | Path = STATEMENTS):
        self._texts = {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.sql"))}

    def names(self) -> list[str]:
        return list(self._texts)

    def run(self, spark: SparkSession, name: str, views: dict[str, DataFrame], **args) -> DataFrame:
        """Runs a statement over the given DataFrames; the arguments reach Catalyst as literals."""
        return spark.sql(self._texts[name], args=args, **views)
