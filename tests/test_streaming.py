"""Streams over several batches, replays and restarts, against their batch twins."""

import datetime
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import aggregate as A
from tenderlake.operators import upsert as U
from tenderlake.sources.snapshot import Snapshot
from tenderlake.streaming import jobs as T

DAY = datetime.datetime(2026, 1, 1)
hours = lambda n: DAY + datetime.timedelta(hours=n)


class Source:
    """A folder that a stream reads, a file for each batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        Path(self.folder).mkdir(exist_ok=True)
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def table(self):
        return self.spark.read.schema(self.schema).parquet(self.folder)


def run(frame, folder, name, mode="append"):
    """Drains a stream into files that later runs add to."""
    q = frame.writeStream.format("parquet").option("path", f"{folder}/{name}_out").option("checkpointLocation", f"{folder}/{name}_cp").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}_out")


@pytest.fixture
def late(spark):
    listener = T.LateRows()
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def dropped(listener, name, most=50):
    """The listener's bus runs behind the stream."""
    for _ in range(most):
        if listener.dropped.get(name):
            break
        time.sleep(0.1)
    return listener.dropped.get(name, 0)


# Upserts by partition

TENDER = "kode_instansi string, id_lelang string, nama_paket string, tahap string, scraped_at timestamp"


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*.parquet")}


def test_upsert_touches_the_keys_of_a_batch(spark, tmp_path):
    source, snapshot = Source(spark, tmp_path / "in", TENDER), Snapshot(spark, str(tmp_path / "t"), "kode_instansi")
    start = lambda cp="cp": T.stream_upsert(source.stream(), snapshot, U.upsert_tenders, str(tmp_path / cp)).start().awaitTermination()
    assert snapshot.read() is None
    source.add(("K1", "1", "a", "x", hours(1)), ("K2", "1", "b", "x", hours(1)), (None, "9", "n", "x", hours(1)), ("001", "1", "z", "x", hours(1)))
    start()
    first = files(tmp_path / "t" / "data")
    source.add(("K2", "1", "b2", "y", hours(2)), ("K2", "2", "new", "y", hours(2)), ("A/B %", "5", "odd", "y", hours(2)))
    start()
    assert first.items() <= files(tmp_path / "t" / "data").items()  # nothing is written anew
    last = snapshot.last()
    assert last["version"] == 1 and {v: k[0] for k, v in ((at, at[1]) for at in last["folders"].values())}["K1"] == f"{0:012d}"
    source.add(("K1", "1", "a3", "z", hours(3)))
    start()
    want = {("K1", "1", "a3"), ("K2", "1", "b2"), ("K2", "2", "new"), (None, "9", "n"), ("001", "1", "z"), ("A/B %", "5", "odd")}
    rows = lambda df: {(r.kode_instansi, r.id_lelang, r.nama_paket) for r in df.collect()}
    assert rows(snapshot.read()) == want and snapshot.read().count() == len(want)
    assert rows(snapshot.read(["K2", None])) == {("K2", "1", "b2"), ("K2", "2", "new"), (None, "9", "n")}
    before = snapshot.read()  # a reader of the third version
    assert snapshot.vacuum() > 0 and rows(before) == want == rows(snapshot.read())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The stream's own record of its last batch is lost after the commit, as when it fails between the two."""
    source, snapshot = Source(spark, tmp_path / "in", TENDER), Snapshot(spark, str(tmp_path / "t"), "kode_instansi")
    calls = []

    def upsert(old, new):
        calls.append(1)
        return U.upsert_tenders(old, new)

    start = lambda cp="cp": T.stream_upsert(source.stream(), snapshot, upsert, str(tmp_path / cp)).start().awaitTermination()
    for n in range(3):
        source.add((f"K{n % 2}", str(n), f"v{n}", "x", hours(n)))
        start()
    for p in (tmp_path / "cp" / "commits").glob("*2*"):
        p.unlink()
    version, kept = snapshot.last()["version"], files(tmp_path / "t")
    start()
    assert len(calls) == 3 and snapshot.last()["version"] == version == 2 and files(tmp_path / "t") == kept
    start("other")  # all over again under another checkpoint: another stream, same rows
    assert len(calls) == 6 and sorted(r.nama_paket for r in snapshot.read().collect()) == ["v0", "v1", "v2"]


def test_half_a_commit_is_not_seen(spark, tmp_path):
    source, snapshot = Source(spark, tmp_path / "in", TENDER), Snapshot(spark, str(tmp_path / "t"), "kode_instansi")
    failing = [True]

    def upsert(old, new):
        if failing and snapshot.last()["version"] == 0:
            failing.clear()
            return U.upsert_tenders(old, new).withColumn("nama_paket", F.raise_error(F.lit("lost")))
        return U.upsert_tenders(old, new)

    start = lambda: T.stream_upsert(source.stream(), snapshot, upsert, str(tmp_path / "cp")).start().awaitTermination()
    source.add(("K1", "1", "a", "x", hours(1)))
    start()
    source.add(("K1", "1", "b", "x", hours(2)), ("K2", "1", "c", "x", hours(2)))
    with pytest.raises(Exception, match="lost"):
        start()
    assert [r.nama_paket for r in snapshot.read().collect()] == ["a"]
    start()
    assert sorted(r.nama_paket for r in snapshot.read().collect()) == ["b", "c"]


def test_stream_of_upserts_equals_one_batch(spark, tmp_path):
    r = random.Random(1)
    source, snapshot = Source(spark, tmp_path / "in", TENDER), Snapshot(spark, str(tmp_path / "t"), "kode_instansi")
    for n in range(4):
        source.add(*((f"K{r.randrange(5)}", str(r.randrange(6)), f"{n}.{k}", "x", hours(100 * n + k)) for k in range(12)))
        T.stream_upsert(source.stream(), snapshot, U.upsert_tenders, str(tmp_path / "cp")).start().awaitTermination()
    whole = U.upsert_tenders(source.table().limit(0), source.table())
    assert sorted(map(tuple, snapshot.read().collect())) == sorted(map(tuple, whole.collect()))


# Watermarks

USE = "company_id long, name string, started_at timestamp"


def test_dedup_drops_and_counts_late_rows(spark, tmp_path, late):
    source = Source(spark, tmp_path / "in", USE)
    go = lambda: sorted((r.company_id, r.name) for r in run(T.stream_dedup(source.stream(), ["company_id", "name"], "started_at", "2 hours"), tmp_path, "dedup").collect())
    source.add((1, "a", hours(1)), (1, "a", hours(1)), (1, "b", hours(2)))
    assert go() == [(1, "a"), (1, "b")]
    source.add((1, "a", hours(2)), (1, "z", hours(50)))
    assert go() == [(1, "a"), (1, "b"), (1, "z")]  # a: seen within the delay
    source.add((1, "late", hours(3)), (1, "a", hours(49)))
    assert go() == [(1, "a"), (1, "a"), (1, "b"), (1, "z")]  # a: seen before, but longer ago than the delay
    assert dropped(late, "dedup") == 1


def test_a_day_is_closed_once(spark, tmp_path, late):
    source = Source(spark, tmp_path / "in", USE)
    go = lambda: sorted((r.company_id, str(r.usage_date), r.used) for r in run(T.stream_daily_usage(source.stream(), "1 hour"), tmp_path, "usage").collect())
    source.add((1, "", hours(1)), (1, "", hours(2)), (2, "", hours(3)))
    assert go() == []  # the day isn't over
    source.add((1, "", hours(23)), (1, "", hours(26)))
    assert go() == [(1, "2026-01-01", 3), (2, "2026-01-01", 1)]
    source.add((1, "", hours(5)), (2, "", hours(60)))  # behind the watermark
    assert go() == [(1, "2026-01-01", 3), (1, "2026-01-02", 1), (2, "2026-01-01", 1)]
    assert dropped(late, "usage") == 1
    in_time = source.table().where(F.col("started_at") != hours(5))
    assert go() == sorted((r.company_id, str(r.usage_date), r.used) for r in A.daily_usage(in_time).collect() if str(r.usage_date) < "2026-01-03")


# Status changes

UPDATE = "tender_id long, company_id long, status string, updated_at timestamp, event_id long"


def twin(source, until):
    rows = A.status_changes(source.table().where(F.col("updated_at") <= until), "updated_at", "event_id").collect()
    return sorted(map(tuple, rows))


def test_status_changes_in_order_over_batches(spark, tmp_path, late):
    """Rows out of order within and across batches, each batch a restart that reads back state."""
    source, r = Source(spark, tmp_path / "in", UPDATE), random.Random(2)
    rows = [(i % 3, i % 2, r.choice("abc"), hours(i // 4), i) for i in range(120)]
    mixed = sorted(rows, key=lambda x: x[3] + datetime.timedelta(hours=r.randrange(0, 5)))  # up to five hours out of order
    go = lambda: sorted(map(tuple, run(T.stream_status_changes(source.stream(), "6 hours"), tmp_path, "changes").collect()))
    for k in range(0, 120, 30):
        source.add(*mixed[k : k + 30])
        got = go()
    source.add((9, 9, "end", hours(100), 999))
    got = go()
    assert got == twin(source, hours(50)) and len(got) > 40 and not late.dropped.get("changes")
    source.add((0, 0, "late", hours(2), 1000), (9, 9, "end", hours(110), 1001))
    assert go() == sorted([*got, (9, 9, "", "end", hours(100))]) and dropped(late, "changes") == 1


def test_a_status_is_forgotten_after_its_life(spark, tmp_path):
    source = Source(spark, tmp_path / "in", UPDATE)
    go = lambda: sorted(map(tuple, run(T.stream_status_changes(source.stream(), "1 hour", keep_days=2), tmp_path, "life").collect()))
    source.add((1, 1, "a", hours(0), 1), (2, 2, "x", hours(5), 2))
    go()
    source.add((2, 2, "x", hours(40), 3), (1, 1, "a", hours(40), 4))
    go()
    source.add((1, 1, "a", hours(200), 5), (3, 3, "y", hours(300), 6))
    assert go() == [(1, 1, "", "a", hours(0)), (1, 1, "", "a", hours(200)), (2, 2, "", "x", hours(5))]  # within two days it is no change


# Stale jobs

JOB = "id long, status string, started_at timestamp, updated_at timestamp, event_id long"


def test_stale_jobs_by_timer(spark, tmp_path):
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)
    ago = lambda m: now - datetime.timedelta(minutes=m)
    source = Source(spark, tmp_path / "in", JOB)
    frame = T.stream_recover_stale(source.stream(), 30)

    def go(done):
        """Runs by the clock until ``done`` of what is out: timers need batches, with new rows or without."""
        q = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        try:
            for _ in range(40):
                time.sleep(1)
                got = [(r.id, r.status) for r in spark.read.schema(frame.schema).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
                if done({i for i, _ in got}):
                    return sorted(got)
            raise AssertionError(got)
        finally:
            q.stop()

    source.add((1, "processing", ago(45), ago(45), 1), (2, "processing", ago(5), ago(5), 2), (3, "processing", ago(60), ago(60), 3), (4, "pending", None, ago(90), 4), (5, "completed", ago(99), ago(1), 5), (3, "completed", ago(60), ago(1), 6))
    assert go(lambda ids: 1 in ids) == [(1, "pending")]
    source.add((6, "processing", ago(31), ago(31), 7), (2, "processing", ago(4), ago(3), 8))  # a restart: job 2 is still waited for
    got = go(lambda ids: 6 in ids)
    last = source.table().groupBy("id").agg(F.max_by(F.struct("status", "started_at"), F.struct("updated_at", "event_id")).alias("s")).select("id", "s.*")
    want = sorted((r.id, r.status) for r in A.recover_stale(last, F.lit(now)).collect() if r.status == "pending" and r.started_at is None and r.id != 4)
    assert got == want and [i for i, _ in got] == [1, 6]
