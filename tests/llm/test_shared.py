"""Tables that go once nothing reads them, and the pipeline over odd rows."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from schedlake.llm.shared import ARROW_ROWS, DROP_SHUFFLES, Scratch, setting, written


def test_scratch_tables_go_and_results_stay(spark):
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            first = written(spark.range(5), "first")
            second = written(first.withColumn("x", F.lit(1)), "second")
            kept = inner.outlive(second.join(first, "id"), "kept")
            folders = list(inner.folders)
        assert kept.count() == 5 and len(outer.folders) == 1 and len(folders) == 2
        assert all(spark.read.parquet(f).count() == 0 for f in folders)
        result = outer.outlive(kept, "result")
    assert result.count() == 5 and not Scratch.open
    with Scratch(spark).recording() as later:
        table = written(spark.range(3), "later")
    assert table.count() == 3
    folder = later.folders[0]
    later.drop()
    assert spark.read.parquet(folder).count() == 0


def test_settings_are_put_back(spark):
    before = spark.conf.get(ARROW_ROWS)
    try:
        with setting(spark, ARROW_ROWS, "7"):
            assert spark.conf.get(ARROW_ROWS) == "7"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(ARROW_ROWS) == before
    written(spark.range(1), "one")
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_stages_take_odd_rows_and_empty_tables(spark, small):
    rows = brute.texts()
    for docs in (brute.documents(spark, rows), brute.documents(spark, rows).limit(0)):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small), "stage")
            assert name == "best-fit packing" or docs.columns == columns
            assert docs.count() <= n or name == "best-fit packing"
        assert (docs.count() > 0) == (n > 0)
