"""Watermarked windows, late rows and the bucketed registry over streams of several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vaxframe.streaming import streams
from vaxframe.streaming.registry import Registry

SCHEMA = "id long, ts timestamp, k string"
DAY = dt.datetime(2024, 3, 1)


def at(day, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour)


BATCHES = [
    [(1, at(0, 1), "a"), (2, at(0, 5), "a"), (3, at(1, 2), "b")],
    [(4, at(5, 1), "a"), (5, at(4, 1), "b"), (6, at(1, 3), "b")],   # the watermark before this batch: day 0, 02:00
    [(7, at(0, 9), "a"), (8, at(1, 9), "b"), (9, at(4, 9), "b")],   # before this one: day 4, 01:00, so days 0 and 1 are closed
    [(10, at(9, 1), "a")],
]


def day_counts(events):
    return streams.counts(events, "ts", "1 day", None, "k").selectExpr("k", "w.start as start", "n")


@pytest.fixture
def landing(spark, tmp_path):
    folder = str(tmp_path / "landing")

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(SCHEMA).parquet(folder)

    return land


def test_windows_close_late_rows_go_aside_and_state_shrinks(spark, landing, tmp_path):
    counts = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    split = streams.LateSplit(spark, "ts", "1 day", "1 day")
    written = []
    for k, rows in enumerate(BATCHES):
        stream = landing(rows)
        split.run(stream)
        last = k == len(BATCHES) - 1
        out = streams.closed_windows(stream, "ts", "1 day", day_counts, "days", close=last, **counts)
        written.append(out.count())
    assert {r.id for r in split.late().collect()} == {7, 8}
    assert {r.id for r in split.on_time().collect()} == {1, 2, 3, 4, 5, 6, 9, 10}
    want = split.on_time().groupBy("k", F.to_date("ts").alias("day")).count()
    assert {(r.k, r.start.date(), r.n) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert written == sorted(written) and written[0] == 0 and 0 < written[1] < written[-1]  # windows are written as they close


def test_state_leaves_with_its_windows(spark, landing, tmp_path):
    sizes = []
    for rows in BATCHES:
        stream = landing(rows).withWatermark("ts", "1 day")
        handle = (day_counts(stream).writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
                  .option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).start())
        handle.awaitTermination()
        sizes.append(handle.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[1] < 4 and sizes[-1] == 1  # of five windows that were opened


def test_a_stopped_split_goes_on_at_its_watermark(spark, landing, tmp_path):
    paths = {"path": str(tmp_path / "late"), "checkpoint": str(tmp_path / "late-check")}
    for rows in BATCHES:  # a new object each time, as after a restart
        streams.LateSplit(spark, "ts", "1 day", "1 day", **paths).run(landing(rows))
    assert {r.id for r in streams.LateSplit(spark, "ts", "1 day", "1 day", **paths).late().collect()} == {7, 8}


KEYS, GROUPS = ["org", "mrn"], {"name": (["first", "last"], None), "phone": (["phone"], "phone is not null")}
ROW = "org int, mrn string, first string, last string, phone string, seq int, day date"


def made(spark, batch, n=40):
    return spark.createDataFrame(
        [(i % 3, f"m{i % 25}", f"f{batch}", f"l{i}", f"p{batch}" if (i + batch) % 4 == 0 else None, batch * 1000 + i, dt.date(2024, 1, 1) + dt.timedelta(days=batch))
         for i in range(n)], ROW)


def snapshot(df):
    return sorted(map(tuple, df.collect()))


def test_ten_batches_leave_few_files_and_equal_one(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "r"), KEYS, GROUPS, ["seq"], "day", buckets=4)
    every = None
    for batch in range(10):
        store.apply(made(spark, batch), batch)
        every = made(spark, batch) if every is None else every.unionByName(made(spark, batch))
    one = Registry(spark, str(tmp_path / "one"), KEYS, GROUPS, ["seq"], "day", buckets=4)
    one.apply(every, 0)
    assert snapshot(store.rows()) == snapshot(one.rows())
    per_bucket = {b: sum(x == b for x, _ in store.live()) for b, _ in store.live()}
    assert max(per_bucket.values()) <= store.MOST_PARTS
    on_disk = list((tmp_path / "r" / "parts").glob("part=*/bucket=*"))
    assert len(on_disk) <= 4 * (2 * store.MOST_PARTS + 1)  # the last two manifests
    assert store.batches() == [8, 9]


def test_an_update_reads_only_its_buckets(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "r"), KEYS, GROUPS, ["seq"], "day", buckets=8)
    for batch in range(3):
        store.apply(made(spark, batch), batch)
    wanted = spark.createDataFrame([(1, "m1"), (9, "unknown")], "org int, mrn string")
    found = store.lookup(wanted)
    buckets = {r[0] for r in wanted.select(store.bucket()).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in found.inputFiles()} <= buckets
    assert snapshot(found) == snapshot(store.rows().where("org = 1 and mrn = 'm1'"))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "r"), KEYS, GROUPS, ["seq"], "day", buckets=4)
    for batch in range(6):
        store.apply(made(spark, batch), batch)
    before, live = snapshot(store.rows()), store.live()
    store.apply(made(spark, 99), 5)  # done already
    assert (snapshot(store.rows()), store.live()) == (before, live)
    part = made(spark, 6)  # a batch that failed after its part, before its manifest
    store._write(part.limit(0).withColumn("bucket", store.bucket()), "batch-6")
    store._write(streams.reduce_batch(made(spark, 50), KEYS, GROUPS, ["seq"], "day").withColumn("bucket", store.bucket()), "batch-6")
    assert snapshot(store.rows()) == before
    store.apply(part, 6)
    assert {r.first for r in store.rows().collect()} == {"f6"}


def test_empty_batches(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "r"), KEYS, GROUPS, ["seq"], "day", buckets=4)
    store.apply(made(spark, 0).limit(0), 0)
    assert store.live() == []
    store.apply(made(spark, 1), 1)
    store.apply(made(spark, 0).limit(0), 2)
    assert store.rows().count() == made(spark, 1).select("org", "mrn").distinct().count()
