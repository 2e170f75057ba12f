"""Headers by their place in a file, defaults for bad tables only, start
positions, and stream state that outlives a kill."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wardstat.operators import windows as W
from wardstat.sources import files as FS
from wardstat.sources import fixtures as fx
from wardstat.sources import gold as GS
from wardstat.streaming import vitals as V

HEADER = "patient_id,age_band,gender,region"


def _files(folder, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    return folder


def _plain(files):
    out = []
    for text in files.values():
        lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
        out += lines[1:] if lines and "patient_id" in lines[0] else lines
    return sorted(out)


FILES = {
    "a/1.csv": f"{HEADER}\nP1,x\npatient_id,y\nP2,z\n", "a/2.csv": "P3,x\npatient_id,later\n", "b/c/3.csv": f"\n{HEADER}\nP4\n",
    "b/4.csv": f"{HEADER}\n{HEADER}\n{HEADER}\nP5\n", "b/5.csv": "", "b/6.csv": f"{HEADER}\n", "b/7.csv": "P6,about patient_id\nP7\n",
    "b/8.csv": "﻿" + HEADER + "\nP8", "b/9.csv": "P9\n\n\nP9\n",
}


def test_only_first_lines_are_headers(spark, tmp_out):
    path = _files(tmp_out, FILES)
    assert sorted(r.value for r in FS.read_data_lines(spark, path).collect()) == _plain(FILES)


def test_first_lines_of_files_in_many_blocks(spark, tmp_out):
    """Only the first block of a file begins with its first line."""
    files = {f"{i}.csv": (f"{HEADER}\n" if i % 2 else "") + "".join(
        f"{'patient_id' if j % 11 == 5 else f'P{j}'},{i},{'x' * 40}\n" for j in range(400)) for i in range(4)}
    path = _files(tmp_out, files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        lines = FS.read_data_lines(spark, path)
        assert sorted(r.value for r in lines.collect()) == _plain(files)
        parsed = FS.parse_lines(lines, min_fields=3, headers=False)
        assert parsed.where("patient_id = 'patient_id'").count() == 4 * len([j for j in range(400) if j % 11 == 5])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_filters_do_not_move_headers(spark, tmp_out):
    path = _files(tmp_out, FILES)
    lines = FS.read_data_lines(spark, path)
    assert lines.where(F.col("value").startswith("patient_id")).count() == sum(x.startswith("patient_id") for x in _plain(FILES))


DEFAULT = "region string, cases long"


def _table(folder, lines):
    return _files(folder, {"part-0.json": "".join(f"{x}\n" for x in lines)})


@pytest.mark.parametrize("bad", ["{not json", '{"region": "A", "cases": "many"}', "[1, 2", '"text"'])
def test_a_bad_record_gives_the_default(spark, tmp_out, bad):
    default = spark.createDataFrame([("none", 0)], DEFAULT)
    path = _table(f"{tmp_out}/t", ['{"region": "A", "cases": 3}', bad, '{"region": "B", "cases": 4}'])
    assert GS.read_or_default(spark, path, default).collect() == default.collect()
    found = GS.read_checked(spark, path, default.schema)
    assert (found.records, found.bad, found.rows.count()) == (3, 1, 2)


def test_good_and_missing_tables(spark, tmp_out):
    default = spark.createDataFrame([("none", 0)], DEFAULT)
    path = _table(f"{tmp_out}/t", ['{"region": "A", "cases": 3}', '{"region": null}', '{"cases": 1, "more": true}'])
    got = GS.read_or_default(spark, path, default)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 3), (None, None), (None, 1)], key=str)
    assert got.columns == ["region", "cases"]
    assert GS.read_or_default(spark, f"{tmp_out}/no/such", default).collect() == default.collect()
    with pytest.raises(GS.GoldTableNotFound):
        GS.read_checked(spark, f"{tmp_out}/no/such", default.schema)


def test_other_failures_are_raised(spark, tmp_out, monkeypatch):
    """No file system for the path; a task that dies while the table is parsed."""
    default = spark.createDataFrame([("none", 0)], DEFAULT)
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        GS.read_or_default(spark, "nosuchfs://host/table", default)
    path = _table(f"{tmp_out}/t", ['{"region": "A", "cases": 3}'])
    real = GS.scratch_path
    monkeypatch.setattr(GS, "scratch_path", lambda s, n: "/proc/no-such-place/" + real(s, n).rsplit("/", 1)[1])
    with pytest.raises(Exception, match="(?i)mkdirs|proc|failed|permission"):
        GS.read_or_default(spark, path, default)


# --- streams ------------------------------------------------------------------------------

class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_latest_n_after_a_kill(spark, tmp_out, when):
    """The batch dies before its write, or between its write and the stream's
    commit; the restarted query ends with what a batch job over everything has."""
    vit = fx.vitals(spark, SF_SMALL)
    topic = V.write_vitals_files(vit.repartition(5), f"{tmp_out}/topic")
    state, ck = f"{tmp_out}/state", f"{tmp_out}/ck"
    stream = lambda: V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, max_files_per_trigger=1).drop("timestamp")
    keep = V.latest_n_writer(state, 20, tie_breakers=["event_id"])
    for victim in (1, 3):
        def dying(batch, batch_id, victim=victim):
            if when == "before" and batch_id == victim:
                raise Killed
            keep(batch, batch_id)
            if batch_id == victim:
                raise Killed
        q = V.push(stream(), dying, ck, available_now=True)
        with pytest.raises(Exception, match="Killed"):
            q.awaitTermination()
        assert V.read_latest(spark, state).count() <= 20
    V.push(stream(), keep, ck, available_now=True).awaitTermination()
    want = W.latest_n(V.decode_vitals(V.encode_vitals(vit), V.VITALS_STREAM).drop("timestamp"), "ts", 20, tie_breakers=["event_id"])
    assert sorted(map(str, V.read_latest(spark, state).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_batch_that_runs_again_replaces_its_own_rows(spark, tmp_out):
    """Its first try saw other rows: nothing of them is left."""
    batch = lambda *ids: spark.createDataFrame([(i, 1.0 * i) for i in ids], "ts long, x double")
    keep = V.latest_n_writer(f"{tmp_out}/s", 3)
    keep(batch(1, 2), 0)
    keep(batch(99), 1)
    keep(batch(5), 1)
    assert sorted(r.ts for r in V.read_latest(spark, f"{tmp_out}/s").collect()) == [1, 2, 5]


def test_an_unfinished_write_leaves_the_last_state(spark, tmp_out):
    batch = lambda *ids: spark.createDataFrame([(i, 1.0 * i) for i in ids], "ts long, x double")
    state = f"{tmp_out}/s"
    keep = V.latest_n_writer(state, 3)
    keep(batch(1, 2), 0)
    os.makedirs(f"{state}/gen_1/_temporary/0")  # killed while the next generation was written
    assert sorted(r.ts for r in V.read_latest(spark, state).collect()) == [1, 2]
    keep(batch(7), 1)
    assert sorted(r.ts for r in V.read_latest(spark, state).collect()) == [1, 2, 7]


def test_latest_n_per_key_and_of_nothing(spark, tmp_out):
    batch = lambda *ids: spark.createDataFrame([(i % 2, i, 1.0) for i in ids], "k long, ts long, x double")
    keep = V.latest_n_writer(f"{tmp_out}/s", 2, keys=["k"])
    keep(batch(), 0)
    assert V.read_latest(spark, f"{tmp_out}/s").collect() == []
    keep(batch(*range(7)), 1)
    keep(batch(8, 3), 2)
    assert sorted((r.k, r.ts) for r in V.read_latest(spark, f"{tmp_out}/s").collect()) == [(0, 6), (0, 8), (1, 3), (1, 5)]


def test_a_stream_starts_behind_the_backlog(spark, tmp_out):
    message = lambda *ids: spark.createDataFrame([(json.dumps({"patient_id": i, "heart_rate": 80.0}),) for i in ids], "value string")
    topic, log, out = f"{tmp_out}/topic", f"{tmp_out}/start", f"{tmp_out}/out"
    assert V.newest_message(spark, topic) is None
    message(1, 2).write.text(topic)
    position = V.start_position(spark, topic, log)
    time.sleep(0.05)
    message(3).write.mode("append").text(topic)

    def run(after):
        sdf = V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, after=after)
        V.write_stream_files(sdf, out, f"{tmp_out}/ck", available_now=True).awaitTermination()
        return sorted(r.patient_id for r in spark.read.parquet(out).collect())
    assert run(position) == [3]
    message(4).write.mode("append").text(topic)  # published while the consumer was down
    again = V.start_position(spark, topic, log)
    assert again == position and run(again) == [3, 4]


def test_a_stream_without_backlog_reads_all(spark, tmp_out):
    assert V.start_position(spark, f"{tmp_out}/none", f"{tmp_out}/log") is None
    assert V.start_position(spark, f"{tmp_out}/none", f"{tmp_out}/log") is None


# --- object store settings -----------------------------------------------------------------

def test_object_store_settings_reach_hadoop(tmp_out):
    """In a session of its own: settings of the file system are read when the
    context starts.  Nothing is fetched."""
    code = (
        "from wardstat.session import get_session\n"
        "s = get_session('local[1]', extra_conf={'spark.hadoop.fs.s3a.impl': 'org.apache.hadoop.fs.s3a.S3AFileSystem',"
        f" 'spark.hadoop.fs.s3a.endpoint': 'store.invalid', 'spark.checkpoint.dir': '{tmp_out}/ck'}})\n"
        "h = s.sparkContext._jsc.hadoopConfiguration()\n"
        "print('GOT', h.get('fs.s3a.impl'), h.get('fs.s3a.endpoint'), s.conf.get('spark.sql.session.timeZone'))\n"
        "s.stop()\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_out,
                          env=os.environ | {"PYTHONPATH": root})
    assert "GOT org.apache.hadoop.fs.s3a.S3AFileSystem store.invalid UTC" in done.stdout, done.stderr[-2000:]
