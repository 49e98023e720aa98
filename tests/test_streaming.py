from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trapline.session import scratch_path
from trapline.sources import growing
from trapline.sources.growing import growing_lines
from trapline.streaming import ingest, live, retry


def sensor_file(folder, service, name, *docs):
    target = folder / f"service={service}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")


def http(i, **extra):
    return {"event_type": "http.page.visit", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "source_ip": f"8.8.8.{i}", **extra}


@pytest.fixture()
def folder(tmp_path):
    sensor_file(tmp_path, "http", "a.json", http(1), http(2), "{broken", http(3, timestamp="never"), http(4, source_ip=""))
    sensor_file(tmp_path, "ssh", "a.json", {"eventid": "cowrie.login.failed", "timestamp": "2024-01-01T00:00:09Z",
                                            "src_ip": "9.9.9.9", "session": "q"})
    return tmp_path


def run(spark, folder, out, checkpoint, **options):
    lines = ingest.sensor_line_stream(spark, str(folder), **options)
    ingest.start_ingest(lines, out, checkpoint, period=None).awaitTermination()


def test_stream_equals_batch_and_resumes(spark, folder):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "ck")
    run(spark, folder, out, checkpoint, files_per_batch=1)
    events = spark.read.parquet(f"{out}/events")
    lines = spark.read.option("recursiveFileLookup", True).text(str(folder)).select(
        "value", F.regexp_extract(F.input_file_name(), ingest.SERVICE_FOLDER, 1).alias("service"))
    batch, rejected = ingest.ingest_lines(lines)
    same = events.select(*[c for c in batch.columns if c != "payload"])
    assert same.exceptAll(batch.select(same.columns)).count() == 0
    assert events.count() == batch.count() == 3
    assert sorted(r["reject_reason"] for r in spark.read.parquet(f"{out}/rejects").collect()) == [
        "bad timestamp", "malformed line"] == sorted(r["reject_reason"] for r in rejected.collect())

    sensor_file(folder, "http", "b.json", http(7))
    run(spark, folder, out, checkpoint)
    assert spark.read.parquet(f"{out}/events").count() == 4


def test_replay_takes_repaired_lines(spark, folder):
    out = scratch_path(spark, "out")
    run(spark, folder, out, scratch_path(spark, "ck"))
    again, still = ingest.replay_rejects(spark, out)
    assert again.count() == 0
    assert sorted(r["reject_reason"] for r in still.collect()) == ["bad timestamp", "malformed line"]
    kept = [r["value"] for r in spark.read.parquet(f"{out}/rejects").filter("reject_reason = 'bad timestamp'").collect()]
    assert [json.loads(v)["event_type"] for v in kept] == ["http.page.visit"]


def test_repeated_batch_is_harmless(spark, folder):
    out = scratch_path(spark, "out")
    write = ingest._write_batch(out)
    batch = spark.createDataFrame([("http", json.dumps(http(1)))], "service string, value string")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(f"{out}/events").count() == 1


def test_old_files_can_be_skipped(spark, folder):
    from datetime import datetime, timedelta

    out = scratch_path(spark, "out")
    run(spark, folder, out, scratch_path(spark, "ck"), since=datetime.now() + timedelta(days=1))
    assert spark.read.parquet(f"{out}/events").count() == 0


def stream_of(spark, rows):
    path = scratch_path(spark, "rows")
    df = spark.createDataFrame(rows, "id long, s long, src_ip string, event_type string").withColumn(
        "ts", F.timestamp_seconds("s"))
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_repeated_events_pass_once(spark):
    rows = [(1, 10, "8.8.8.8", "a"), (1, 10, "8.8.8.8", "a"), (2, 20, "8.8.8.8", "a")]
    out = scratch_path(spark, "o")
    live.run_available(live.distinct_events(stream_of(spark, rows)), out, scratch_path(spark, "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_hours_are_emitted_once_final(spark):
    rows = [(1, 10, "a", "t"), (2, 3000, "a", "t"), (3, 3700, "a", "t"), (4, 4 * 3600, "a", "t")]
    out = scratch_path(spark, "o")
    live.run_available(live.hourly_sessions(stream_of(spark, rows)), out, scratch_path(spark, "ck"))
    got = sorted((r["hour"]["start"].hour, r["events"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (1, 1)]


def test_open_hours_are_counted(spark):
    rows = [(1, 10, "a", "t"), (2, 3000, "a", "t"), (3, 3700, "a", "t"), (4, 4 * 3600, "a", "t")]
    out = scratch_path(spark, "o")
    live.start_source_counts(live.hourly_sessions(stream_of(spark, rows)), out, scratch_path(spark, "ck"),
                             availableNow=True).awaitTermination()
    got = live.latest_counts(spark, out, "hour", "src_ip", "event_type").collect()
    assert sorted((r["hour"]["start"].hour, r["events"]) for r in got) == [(0, 2), (1, 1), (4, 1)]


def test_leaders_skip_private_sources(spark):
    rows = [(i, i, "8.8.8.8" if i % 3 else "10.0.0.1", "t") for i in range(30)] + [(99, 5, "9.9.9.9", "t")]
    out = scratch_path(spark, "o")
    live.start_source_counts(live.source_counts(stream_of(spark, rows)), out, scratch_path(spark, "ck"),
                             availableNow=True).awaitTermination()
    got = [(r["src_ip"], r["events"], r["rank"]) for r in live.live_leaders(spark, out).orderBy("rank").collect()]
    assert got == [("8.8.8.8", 20, 1), ("9.9.9.9", 1, 2)]


def append(folder, service, name, text, mode="ab"):
    target = folder / f"service={service}"
    target.mkdir(parents=True, exist_ok=True)
    with open(target / name, mode) as file:
        file.write(text)


class Tail:
    """A stream over growing files that is started and stopped for every look."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.out, self.checkpoint = scratch_path(spark, "tail"), scratch_path(spark, "ck")
        self.seen = 0

    def new(self):
        lines = growing_lines(self.spark, str(self.folder), **self.options)
        lines.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(
            availableNow=True).start().awaitTermination()
        rows = self.spark.read.schema("value string, path string, place long").parquet(self.out).orderBy("path", "place").collect()
        values = sorted(r["value"] for r in rows)
        before, self.seen = self.seen, list(values)
        for v in before or []:
            values.remove(v)
        return values


@pytest.mark.parametrize("range_bytes", [growing.RANGE_BYTES, 7, 1])
def test_appended_lines_come_once(spark, tmp_path, range_bytes):
    tail = Tail(spark, tmp_path, range_bytes=range_bytes)
    assert tail.new() == []
    append(tmp_path, "http", "a.json", b"one\ntwo\n\nthree and a long line\nhal")
    assert tail.new() == ["", "one", "three and a long line", "two"]
    assert tail.new() == []
    append(tmp_path, "http", "a.json", "f\r\nÜnï🙂\n".encode())
    append(tmp_path, "ssh", "b.json", b"other file\n")
    assert tail.new() == ["half", "other file", "Ünï🙂"]


def test_files_started_anew_are_read_from_the_beginning(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    append(tmp_path, "http", "short.json", b"a1\na2\na3\n")
    append(tmp_path, "http", "long.json", b"b1\n")
    assert tail.new() == ["a1", "a2", "a3", "b1"]
    append(tmp_path, "http", "short.json", b"a4\n", "wb")
    append(tmp_path, "http", "long.json", b"b2\nb3\nb4\n", "wb")
    assert tail.new() == ["a4", "b2", "b3", "b4"]
    (tmp_path / "service=http" / "short.json").unlink()
    assert tail.new() == []
    append(tmp_path, "http", "short.json", b"a4\n")
    assert tail.new() == ["a4"]


def test_renamed_and_copied_files_go_on(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    lines = [f"line {i} of a file that is long enough to be known again" for i in range(20)]
    append(tmp_path, "http", "log", "".join(f"{x}\n" for x in lines).encode())
    assert tail.new() == sorted(lines)
    append(tmp_path, "http", "log", b"last before the file is renamed\n")
    (tmp_path / "service=http" / "log").rename(tmp_path / "service=http" / "log.1")
    append(tmp_path, "http", "log", b"first of the next\n")
    assert tail.new() == ["first of the next", "last before the file is renamed"]


def test_hidden_and_other_files_are_left_out(spark, tmp_path):
    append(tmp_path, "http", "a.json", b"yes\n")
    append(tmp_path, "http", "a.txt", b"no\n")
    append(tmp_path, "http", ".a.json", b"no\n")
    append(tmp_path, "_tmp", "a.json", b"yes\n")
    append(tmp_path / "_hidden", "http", "a.json", b"no\n")
    assert Tail(spark, tmp_path, pattern="*.json").new() == ["yes", "yes"]


def test_first_run_can_begin_at_the_end(spark, tmp_path):
    append(tmp_path, "http", "a.json", b"old\n")
    tail = Tail(spark, tmp_path, from_end=True)
    assert tail.new() == []
    append(tmp_path, "http", "a.json", b"new\n")
    assert tail.new() == ["new"]


def test_batch_planned_before_a_file_was_started_anew(spark, tmp_path):
    """The lost lines are gone, the new ones come with the next batch."""
    append(tmp_path, "http", "a.json", b"a1\na2\n")
    reader = growing.GrowingReader(str(tmp_path), "*", False, 3)
    planned = reader.latestOffset()
    ranges = reader.partitions(reader.initialOffset(), planned)
    append(tmp_path, "http", "a.json", b"new line that is longer\n", "wb")
    assert [b for r in ranges for b in reader.read(r)] == []
    after = reader.partitions(planned, reader.latestOffset())
    assert [v for r in after for b in reader.read(r) for v in b.column("value").to_pylist()] == ["new line that is longer"]


def test_small_files_share_tasks(spark, tmp_path):
    want = []
    for i in range(600):
        append(tmp_path, "http", f"{i}.json", f"a{i}\r\n\nö{i}\n".encode())
        want += [f"a{i}", "", f"ö{i}"]
    append(tmp_path, "http", "broken.json", b"\xff\r\nok\n")
    append(tmp_path, "http", "long.json", b"x" * (growing.BLOCK + 5) + b"\nlast\n")
    reader = growing.GrowingReader(str(tmp_path), "*", False, growing.RANGE_BYTES)
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) == 3
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert sorted(r["value"] for r in rows) == sorted(want + ["\ufffd", "ok", "x" * (growing.BLOCK + 5), "last"])
    assert {r["place"] for r in rows if r["value"].startswith("ö")} == {5, 6, 7}


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 5, 8, 1000])
def test_ranges_take_every_line_once(tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(growing, "BLOCK", 4)
    lines = ["", "one", "a line over several blocks", "", "", "ü", "x\ry", "end"]
    append(tmp_path, "http", "a.json", ("\n".join(lines) + "\nrest").encode())
    reader = growing.GrowingReader(str(tmp_path), "*", False, range_bytes)
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert [r["value"] for r in rows] == lines
    places = [sum(len(x.encode()) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert [r["place"] for r in rows] == places


def test_growing_sensor_files_are_ingested(spark, tmp_path):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "ck")
    for docs in ([http(1), "{broken"], [http(2), http(3, timestamp="never")]):
        append(tmp_path, "http", "a.json", "".join((d if isinstance(d, str) else json.dumps(d)) + "\n" for d in docs).encode())
        lines = ingest.growing_line_stream(spark, str(tmp_path))
        ingest.start_ingest(lines, out, checkpoint, period=None).awaitTermination()
    assert sorted(r["src_ip"] for r in spark.read.parquet(f"{out}/events").collect()) == ["8.8.8.1", "8.8.8.2"]
    assert sorted(r["reject_reason"] for r in spark.read.parquet(f"{out}/rejects").collect()) == ["bad timestamp", "malformed line"]


def test_retry_takes_mended_lines_once_and_gives_up(spark, folder):
    out = scratch_path(spark, "out")
    run(spark, folder, out, scratch_path(spark, "ck"))
    sensor_file(folder, "http", "b.json", "{broken", "{broken")
    run(spark, folder, out + "x", scratch_path(spark, "ck"))
    rejects = spark.read.parquet(f"{out}x/rejects").select(F.sum(F.when(F.col("value") == "{broken", 1))).first()[0]
    bad = spark.read.parquet(f"{out}x/rejects").filter("reject_reason = 'bad timestamp'")
    retry.mend(spark, f"{out}x", bad.select(
        retry.line_key(F.col("service"), F.col("value")).alias("key"), F.regexp_replace("value", "never", "2024-01-01T00:00:03Z").alias("value")))
    checkpoint = scratch_path(spark, "ck")
    for _ in range(2):  # Started again, it finds nothing left to do.
        retry.settle(retry.start_retry(spark, f"{out}x", checkpoint, delay=0.5, most=2, period="0 seconds"), 120)
    assert [r["src_ip"] for r in spark.read.parquet(f"{out}x/retried").collect()] == ["8.8.8.3"]
    given_up = spark.read.parquet(f"{out}x/given_up").select("value", "attempt", "copies", "reject_reason").collect()
    assert [tuple(r) for r in given_up] == [("{broken", 2, rejects, "malformed line")] and rejects == 3


def test_retry_holds_letters_over_a_restart(spark, folder):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "ck")
    run(spark, folder, out, scratch_path(spark, "ck"))
    query = retry.start_retry(spark, out, checkpoint, delay=5, most=1, period="0 seconds")
    while not (query.lastProgress and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2):
        assert query.isActive
    query.stop()
    retry.settle(retry.start_retry(spark, out, checkpoint, delay=5, most=1, period="0 seconds"), 120)
    given_up = spark.read.parquet(f"{out}/given_up").collect()
    assert sorted(r["reject_reason"] for r in given_up) == ["bad timestamp", "malformed line"]


def test_workers_of_a_retry_take_few_lines_at_once(spark, folder, monkeypatch):
    out, seen = scratch_path(spark, "out"), []
    run(spark, folder, out, scratch_path(spark, "ck"))
    many = [{**http(1), "n": i, "timestamp": "never"} for i in range(50)]
    sensor_file(folder, "http", "many.json", *many)
    run(spark, folder, out + "x", scratch_path(spark, "ck"))
    name, write = "spark.sql.execution.arrow.maxRecordsPerBatch", retry._try
    usual = spark.conf.get(name)

    def looking(*args):
        def look(batch, batch_id):
            seen.append(batch.sparkSession.conf.get(name))
            write(*args)(batch, batch_id)
        return look

    monkeypatch.setattr(retry, "_try", looking)
    monkeypatch.setattr(retry, "LINES_AT_ONCE", 3)
    retry.settle(retry.start_retry(spark, f"{out}x", scratch_path(spark, "ck"), delay=0.2, most=1, period="0 seconds", partitions=2), 120)
    assert set(seen) == {"3"} and spark.conf.get(name) == usual
    given_up = spark.read.parquet(f"{out}x/given_up")
    assert given_up.filter("reject_reason = 'bad timestamp'").agg(F.sum("copies"), F.max("attempt")).first() == (51, 1)


def test_workers_hand_over_what_they_hold(spark):
    """States go to the store with rows only, so there have to be some while every line waits."""
    class State:
        hasTimedOut = exists = False

        def getCurrentProcessingTimeMs(self):
            return 5

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, duration):
            self.duration = duration

    import pandas as pd

    run_key = retry._hold(1000, 3)
    letter = pd.DataFrame({"kind": ["letter"], "service": ["http"], "value": ["x"], "attempt": [0], "copies": [2]})
    states = [State() for _ in range(10)]
    given = [list(run_key((f"k{i}",), iter([letter]), state)) for i, state in enumerate(states)]
    assert [[len(f) for f in frames] for frames in given] == [[], [], [4]] * 3 + [[]]
    assert all(f["key"].isna().all() for frames in given for f in frames)
    assert {(s.value, s.duration) for s in states} == {(("http", "x", None, 0, 2, 1005), 1000)}
