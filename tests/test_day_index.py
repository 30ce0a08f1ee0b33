"""Stored days that are not named stay unread: their files are damaged first."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from schedlake.operators.changes import delete_executions
from schedlake.schemas import EXECUTION_SCHEMA
from schedlake.session import run_folder
from schedlake.sources import day_index as x
from schedlake.sources.tables import drop_days, read_executions

DAYS = [datetime(2024, 2, 1) + timedelta(days=i) for i in range(6)]


def stored(spark, folder):
    """Ids in order of days; job 5 runs on the third and last day only; ties within a minute and to the microsecond."""
    rows = []
    for i in range(6000):
        day = DAYS[i // 1000]
        job = None if i % 50 == 0 else 5 if i // 1000 in (2, 5) and i % 7 == 0 else 1 + i % 4
        rows.append((i, job, f"h{i % 3}", day, "FAILED" if i % 10 == 0 else "SUCCESS", day + timedelta(seconds=i % 1000 // 3)))
    df = spark.createDataFrame(rows, "id long, job_id long, handler_name string, scheduled_time timestamp_ntz, status string, created_at timestamp_ntz")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in EXECUTION_SCHEMA.fields if f.name not in df.columns]
    df = df.select("*", *others).select(*[f.name for f in EXECUTION_SCHEMA.fields])
    x.append_indexed(df.filter("id % 2 = 0"), folder)
    x.append_indexed(df.filter("id % 2 = 1"), folder)
    return df


def files(folder, day):
    return sorted(Path(folder.removeprefix("file:")).glob(f"created_date={day:%Y-%m-%d}/*.parquet"))


def damage(folder, days):
    """Headers and rows are lost, footers stay: rows can be counted but not read."""
    for day in days:
        for f in files(folder, day):
            data = bytearray(f.read_bytes())
            end = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
            data[4:end] = b"\xff" * (end - 4)
            f.write_bytes(data)
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


@pytest.fixture
def history(spark):
    folder = run_folder(spark, "history")
    return folder, stored(spark, folder)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_cascade_reads_the_days_of_the_jobs_only(spark, history):
    folder, df = history
    want = ids(df.filter("job_id IS NULL OR job_id <> 5"))
    damage(folder, [DAYS[0], DAYS[1], DAYS[3], DAYS[4]])
    before = {f: f.read_bytes() for day in DAYS for f in files(folder, day)}
    x.cascade_days(spark, folder, spark.createDataFrame([(5,), (77,)], "id long"))
    for day in (DAYS[0], DAYS[1], DAYS[3], DAYS[4]):
        assert files(folder, day) and all(before[f] == f.read_bytes() for f in files(folder, day))
    left = read_executions(spark, folder).filter(F.to_date("created_at").isin([DAYS[2].date(), DAYS[5].date()]))
    whole = spark.read.parquet(*[str(files(folder, d)[0].parent) for d in (DAYS[2], DAYS[5])])
    assert ids(whole) == [i for i in want if 2000 <= i < 3000 or i >= 5000]
    assert left.columns == [f.name for f in EXECUTION_SCHEMA.fields]


def test_changes_read_the_days_of_the_id_ranges_only(spark, history):
    folder, _ = history
    damage(folder, DAYS[4:])  # ids 2048 to 3071 are one range, so the fourth day is looked at
    gone = spark.createDataFrame([(1100,), (2900,), (10 ** 12,)], "id long")
    x.change_indexed_days(spark, folder, gone, lambda part: delete_executions(part, gone).table)
    whole = spark.read.parquet(*[str(files(folder, d)[0].parent) for d in DAYS[:3]])
    assert ids(whole) == [i for i in range(3000) if i not in (1100, 2900)]


def test_nothing_to_change(spark, history):
    folder, df = history
    none = spark.createDataFrame([], "id long")
    x.change_indexed_days(spark, folder, none, lambda part: delete_executions(part, none).table)
    x.cascade_days(spark, folder, none)
    assert read_executions(spark, folder).count() == df.count()
    x.rebuild_index(spark, folder)
    x.cascade_days(spark, folder, spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id long"))
    assert ids(read_executions(spark, folder)) == [i for i in range(6000) if i % 50 == 0]


@pytest.mark.parametrize("size, filters, test", [(100, {}, "true"), (7, {"status": "FAILED"}, "status = 'FAILED'"), (100, {"job_id": 5}, "job_id = 5")])
def test_pages(spark, history, size, filters, test):
    folder, df = history
    order = [r.id for r in df.filter(test).orderBy(F.desc("created_at"), F.desc("id")).collect()]
    n = -(-len(order) // size)
    for page in (1, 2, n // 3, n // 2, n - 1, n, n + 1, 10 ** 6):
        got = [r.id for r in x.history_page(spark, folder, page, size, **filters).collect()]
        assert got == order[(page - 1) * size:page * size]
    with pytest.raises(ValueError):
        x.history_page(spark, folder, 0)


def test_a_page_opens_its_days_only(spark, history):
    folder, df = history
    order = [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    damage(folder, [DAYS[0], DAYS[1], DAYS[4], DAYS[5]])
    got = x.history_page(spark, folder, 25, 100)  # rows 2400 to 2499 lie on the fourth day
    assert [r.id for r in got.collect()] == order[2400:2500]


def test_dropped_days_go_by_their_files_addresses(spark, history):
    folder, _ = history
    drop_days(spark, folder, [DAYS[1].date(), datetime(2030, 1, 1).date()])
    assert not files(folder, DAYS[1]) and ids(read_executions(spark, folder)) == [i for i in range(6000) if i // 1000 != 1]
