"""From a log folder to routed records: whole lines in order, batch equal to stream, restarts without loss."""

import io

import pytest
from pyspark.sql import functions as F

from fleetscope.sources.log_files import Split, _last_line_end, lines_of
from fleetscope.sources.logs import RECORD_START, assemble_multiline, read_logs, record_time, write_logs
from fleetscope.streaming import jobs


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\na", "one\ntwo\r\n\nthree", "é\nüü\nend\n"])
def test_splits_have_every_line_once(text, size):
    raw = text.encode()
    got = [x for low in range(0, len(raw), size) for x in lines_of(io.BytesIO(raw), Split("f", low, min(len(raw), low + size), 0, 0))]
    want, at = [], 0
    for line in raw.split(b"\n")[: None if not raw.endswith(b"\n") and raw else -1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want
    assert _last_line_end(io.BytesIO(raw), 0, len(raw)) == raw.rfind(b"\n") + 1


FIRST = [f"[2024-01-0{1 + i // 40} 00:00:{i % 60:02d}] record {i}\n  detail é {i}\n\n" for i in range(80)]


@pytest.fixture
def folder(tmp_path):
    paths = {
        "om": tmp_path / "logs/c1/10.0.0.1/archive/log/omm/bin/gs_ctl/run.log", "om2": tmp_path / "logs/c1/10.0.0.2/archive/log/omm/bin/gs_ctl/run.log",
        "sys": tmp_path / "logs/c2/10.0.0.3/archive/log/omm/pg_log/db.log", "other": tmp_path / "logs/c2/10.0.0.3/archive/log/omm/notes.txt",
    }
    for p in paths.values():
        p.parent.mkdir(parents=True, exist_ok=True)
    paths["om"].write_text("".join(FIRST))
    paths["om2"].write_text("a line that starts no record\n" + FIRST[0])
    paths["sys"].write_text("LOG:  one\nLOG:  two\nDETAIL without an end")
    paths["other"].write_text("no log\n")
    return tmp_path, paths


def records(lines):
    return assemble_multiline(lines, ["tag", "cluster", "pod_ip", "file"], "seq", "text", F.col("text").rlike(RECORD_START), 500)


def test_folder_to_records(spark, folder):
    root, paths = folder
    lines = read_logs(spark, str(root / "logs"), stream=False, splitBytes=97)
    assert lines.rdd.getNumPartitions() > 20
    assert [r.text for r in lines.where("tag = 'syslog'").orderBy("seq").collect()] == ["LOG:  one", "LOG:  two", "DETAIL without an end"]
    rows = records(lines.where("tag = 'omlog' AND pod_ip = '10.0.0.1'")).orderBy("record").collect()
    assert [r.text + "\n" for r in rows] == FIRST and [r.lines for r in rows] == [3] * 80
    timed = records(lines.where("tag = 'omlog'")).withColumn("ts", record_time(F.col("text")))
    write_logs(timed.where("ts IS NOT NULL"), "ts", str(root / "out"))
    kept = spark.read.parquet(str(root / "out"))
    assert kept.count() == 81 and {(r.tag, str(r.month)) for r in kept.select("tag", "month").distinct().collect()} == {("omlog", "2024.01")}


def test_stream_reads_on_from_its_checkpoint_and_equals_the_batch(spark, folder):
    root, paths = folder

    def go():
        df = jobs.multiline_stream(read_logs(spark, str(root / "logs"), splitBytes=2000), ["tag", "cluster", "pod_ip", "file"], "text", F.col("text").rlike(RECORD_START), silence_s=10**6)
        q = jobs.applied(df).writeStream.format("parquet").option("path", str(root / "records")).option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def lines_seen():
        df = read_logs(spark, str(root / "logs"), splitBytes=2000)
        q = df.writeStream.format("parquet").option("path", str(root / "lines")).option("checkpointLocation", str(root / "cp-lines")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    lines_seen()
    with paths["sys"].open("a") as f:
        f.write("\nLOG:  three\n")
    with paths["om2"].open("a") as f:
        f.write("more of it\nno newline yet")
    lines_seen()
    got = spark.read.parquet(str(root / "lines"))
    want = read_logs(spark, str(root / "logs"), stream=False).where("text <> 'no newline yet'")
    cols = ["file", "seq", "text", "tag", "cluster", "pod_ip"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    # records: all but the last one of each file, which the next start would end
    go()
    import os
    import time

    later = time.time() + 3600
    for name in ("om", "om2", "sys"):
        with paths[name].open("a") as f:
            f.write("\n[2024-01-09 00:00:00] last\n")
        os.utime(paths[name], (later, later))
    go()
    # with this source a run is one batch: one run moves the watermark, the next applies what it passed
    for hour in (1, 2):
        with paths["om"].open("a") as f:
            f.write("[2024-01-09 00:00:01] pushes the watermark\n")
        os.utime(paths["om"], (later + 3600 * hour, later + 3600 * hour))
        go()
    cols = ["file", "record", "first_seq", "lines", "text"]
    got = {tuple(r) for r in spark.read.parquet(str(root / "records")).select(*cols).collect()}
    want = [tuple(r) for r in records(read_logs(spark, str(root / "logs"), stream=False)).select(*cols).collect()]
    ended = {w for w in want if not w[4].startswith("[2024-01-09")}
    assert got == ended and len(ended) > 80
