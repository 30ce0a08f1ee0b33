"""Windowed statistics: sessions split by time, late rows over a stream's life."""

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from schedlake.operators.reports import STATUS_COUNTS
from schedlake.session import run_folder
from schedlake.streaming.stats import LateRows, audit_late_rows, audited_late_rows, windowed_stats

BEGIN = datetime(2024, 1, 1)


def scanned(rows, gap, keyed):
    """Sessions, row by row."""
    out, open_ = [], {}
    for at, status, key in sorted(rows):
        key = key if keyed else None
        if key in open_ and at <= open_[key][1]:  # rows a gap apart are one session in Spark
            open_[key][1] = max(open_[key][1], at + gap)
            open_[key][2].append(status)
        else:
            if key in open_:
                out.append((key, *open_[key]))
            open_[key] = [at, at + gap, [status]]
    out += [(k, *v) for k, v in open_.items()]
    return Counter((k, a, b, len(s), *(s.count(x) for x in STATUS_COUNTS.values())) for k, a, b, s in out)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("slice_unit", ["minute", "hour", "day"])
def test_sessions_do_not_depend_on_slices(spark, no_broadcast, keyed, slice_unit):
    rng = random.Random(3)
    rows, at = [], BEGIN
    for _ in range(1500):
        at += timedelta(seconds=rng.choice([0, 0, 1, 100, 1199, 1200, 1201, 4000]))
        rows.append((at, rng.choice(list(STATUS_COUNTS.values())), "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}"))
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, status string, k string").repartition(5)
    got = windowed_stats(df, "1 hour", gap="20 minutes", keys=["k"] if keyed else None, slice_unit=slice_unit)
    columns = ["k"] if keyed else [F.lit(None).alias("k")]
    found = got.select(*columns, "window_start", "window_end", "total", *STATUS_COUNTS).collect()
    assert Counter(map(tuple, found)) == scanned(rows, timedelta(minutes=20), keyed)
    assert windowed_stats(df.limit(0), "1 hour", gap="20 minutes").count() == 0


def test_rows_of_a_key_are_many_tasks(spark):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.timestamp_add("SECOND", (F.col("id") * 30).cast("int"), F.lit(BEGIN).cast("timestamp_ntz")).alias("created_at"),
        F.lit("SUCCESS").alias("status"), F.lit("one").alias("k"))
    got = windowed_stats(rows, "1 hour", gap="20 minutes", keys=["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    first = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x][-1]
    assert "_slice" in first and got.collect()[0]["total"] == 40_000


def _batches(spark, batches):
    """A stream that takes the rows of each list as one micro-batch."""
    folder = run_folder(spark, "batches")
    spark.createDataFrame([], "created_at timestamp_ntz, status string").write.parquet(folder)
    place = folder.removeprefix("file:")
    for i, rows in enumerate(batches):
        table = pa.table({"created_at": pa.array(rows, pa.timestamp("us")), "status": ["SUCCESS"] * len(rows)})
        pq.write_table(table, f"{place}/b{i:05d}.parquet")
        os.utime(f"{place}/b{i:05d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema("created_at timestamp_ntz, status string").option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "b*.parquet").parquet(folder)


def test_all_late_rows_of_a_long_stream(spark):
    rng, batches, planted = random.Random(2), [], 0
    for i in range(300):
        late = rng.randrange(3) if i > 20 else 0
        planted += late
        batches.append([BEGIN + timedelta(minutes=30 * i)] + [BEGIN + timedelta(hours=h) for h in rng.sample(range(3), late)])
    listener, before = LateRows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.streams.addListener(listener)
    try:
        stats = windowed_stats(_batches(spark, batches), "1 hour")
        folder = run_folder(spark, "late")
        query = stats.writeStream.format("noop").outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while listener.dropped[str(query.id)] < planted and time.time() < until:
            time.sleep(0.2)
        assert listener.dropped[str(query.id)] == planted
        assert len(query.recentProgress) < 300
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("kind, per_row", [({"width": "1 hour"}, 1), ({"width": "2 hours", "slide": "1 hour"}, 2), ({"width": "", "gap": "20 minutes"}, 1)])
def test_late_rows_of_one_window_count_each(spark, kind, per_row):
    late = [BEGIN + timedelta(hours=1, minutes=m) for m in range(7)]
    batches = [[BEGIN + timedelta(hours=12)], late, [BEGIN + timedelta(hours=12, minutes=1)], late[:2] + [BEGIN + timedelta(hours=11, minutes=30)], []]
    folder, stream = run_folder(spark, "audit"), _batches(spark, batches)
    for _ in range(2):  # a restart finds nothing new
        audit_late_rows(stream, folder, f"{folder}-checkpoint", **kind).awaitTermination()
    assert audited_late_rows(spark, folder) == per_row * 9 + ("gap" in kind)  # a session of one row ends sooner
