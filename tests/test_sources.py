"""Scans, sinks and streams on small files."""

import os
import subprocess
import sys

import pytest

from vaxframe.operators import hl7
from vaxframe.sources import files, scratch
from vaxframe.streaming import streams

from test_rules import GOOD


def test_messages_come_one_per_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"m{n}.hl7").write_text(GOOD.replace("C1", f"C{n}"), newline="")
    rows = files.read_messages(spark, str(tmp_path)).selectExpr("source as msg_id", "1 as org_id", "date '2020-01-01' as received_date", "message")
    got = {r.control_id: r.msg_type for r in hl7.parse(rows).collect()}
    assert got == {"C0": "VXU", "C1": "VXU", "C2": "VXU"}


def test_land_json_wants_exactly_one_source(spark, tmp_path):
    schema = "a int"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"a": 1}\n')
    assert files.land_json(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema).collect()[0].a == 1
    (tmp_path / "in" / "y.json").write_text('{"a": 2}\n')
    with pytest.raises(ValueError):
        files.land_json(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema)


def test_gate_fails_on_a_missing_source(spark):
    manifest = spark.createDataFrame([("a",), ("b",)], "name string")
    present = spark.createDataFrame([("a",), ("a",)], "name string")
    with pytest.raises(FileNotFoundError, match="b"):
        files.source_gate(manifest, present, "name")
    assert {(r.name, r.present) for r in files.source_gate(manifest, present, "name", strict=False).collect()} == {("a", True), ("b", False)}


class _Session:
    """Only what the folder lookup reads of a session."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_scratch_follows_the_session_setting(tmp_path):
    assert scratch.new_path(_Session(str(tmp_path), "yarn"), "x").startswith(f"{tmp_path}/vaxframe/x-")
    with pytest.raises(ValueError):
        scratch.new_path(_Session(None, "yarn"), "x")


def test_scratch_reads_the_setting_of_a_real_session(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); from pyspark.sql import SparkSession; from vaxframe.sources.scratch import stage;"
            "s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', sys.argv[2]).config('spark.ui.enabled', 'false').getOrCreate();"
            "print('rows', stage(s.range(3), 'x').count())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], capture_output=True, text=True, timeout=120)
    assert "rows 3" in out.stdout and any((tmp_path / "vaxframe").iterdir())


def test_stream_parts_merge_like_one_batch(spark, tmp_path):
    keys, groups, order = ["k"], {"g": (["v"], None), "h": (["w"], "w is not null")}, ["d", "n"]
    rows = spark.range(60).selectExpr("id % 7 as k", "id % 11 as n", "date_add(date '2020-01-01', cast(id % 5 as int)) as d",
                                      "concat('v', id) as v", "case when id % 3 = 0 then concat('w', id) end as w", "id")
    rows = rows.selectExpr("k", "n * 100 + id as n", "d", "v", "w", "id")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = lambda df: streams.reduce_batch(df, keys, groups, order, "d")
    streams.run_available(stream, "t", streams.batch_writer(str(tmp_path / "parts"), job))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    assert parts.select("batch_id").distinct().count() > 1
    got = sorted(streams.merge_parts(parts, keys, groups).collect())
    assert got == sorted(streams.merge_parts(job(rows), keys, groups).collect())
