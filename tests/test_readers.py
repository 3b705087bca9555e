"""Batch files of messages over many splits, broken messages, code files with validity dates, GeoJSON documents."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from test_rules import GOOD

from vaxframe.functions import codes as C
from vaxframe.operators import acceptance, hl7, rules
from vaxframe.sources import files

MESSAGES = [GOOD.replace("C1", f"C{k}") + ("\rOBX|1|TX|||" + "x" * (k * 37 % 400) + "\r" if k % 3 else "") for k in range(30)]


def clean(text):
    return text.strip("\r\n")


def read(spark, path, split, *args):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = files.read_messages(spark, str(path), *args)
        return rows.rdd.getNumPartitions(), sorted(r.message for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("split", [97, 512, 4096, 1 << 20])
@pytest.mark.parametrize("framing", ["msh", "mllp"])
def test_batch_files_are_cut_at_messages_across_splits(spark, tmp_path, split, framing):
    rows = spark.createDataFrame([(k % 2, clean(m)) for k, m in enumerate(MESSAGES)], "org int, message string").coalesce(1)
    files.write_messages(rows, str(tmp_path / "b"), framing, "org")
    splits, got = read(spark, tmp_path / "b", split, framing)
    assert got == sorted(map(clean, MESSAGES))
    assert splits > 10 or split > 1000


@pytest.mark.parametrize("newline", ["\r", "\n", "\r\n"])
@pytest.mark.parametrize("ending", ["\r", "\n"])
def test_envelopes_and_line_endings(spark, tmp_path, newline, ending):
    body = newline.join(newline.join(clean(m).split("\r")) for m in MESSAGES[:7])
    text = f"FHS|^~\\&|A{newline}BHS|^~\\&|B{newline}{body}{newline}BTS|7{newline}FTS|1{newline}"
    (tmp_path / "in.hl7").write_bytes(text.encode())
    _, got = read(spark, tmp_path, 300, "msh", ending)
    assert [m.replace(newline, "\r") for m in got] == sorted(map(clean, MESSAGES[:7]))


def test_a_file_without_a_header_is_one_message(spark, tmp_path):
    (tmp_path / "a.hl7").write_bytes(b"PID|1||x\rRXA|0")
    (tmp_path / "empty.hl7").write_bytes(b"")
    (tmp_path / "b.hl7").write_bytes(clean(MESSAGES[0]).encode() + b"\r")
    assert read(spark, tmp_path, 1 << 20, "msh")[1] == sorted(["PID|1||x\rRXA|0", clean(MESSAGES[0])])


def validate(spark, texts):
    """All flavors of checks over the texts, each as the message of its own number."""
    messages = spark.createDataFrame([(k, k % 3, dt.date(2020, 1, 1), m) for k, m in enumerate(texts)], "msg_id long, org_id int, received_date date, message string")
    orgs = spark.createDataFrame([(0, "ORG", []), (1, "ORG", ["CANTALOUPE", "FIG", "PEAR"]), (2, "ORG", ["SPRUCE", "QUINZE", "BLACKBERRY"])],
                                 "org_id int, org_name string, flavors array<string>")
    relations = spark.createDataFrame([], "from_set string, from_value string, to_cvx string")
    return rules.Validation(messages, orgs, C.seed_codes(spark), relations, C.seed_valid_values(spark), "date '2020-06-01'",
                            spark.createDataFrame([(0, "FAC1")], "org_id int, facility_code string"))


FAULTS = {
    None: GOOD, "empty": "\r\n", "binary": GOOD + "\x01", "no header": GOOD.split("\r", 1)[1], "nested header": GOOD + "\rOBX|1|TX|MSH|^~\\&|x\r",
    "truncated header": GOOD[:20], "broken segment": GOOD + "\rPI",
}


def test_faults(spark):
    rows = spark.createDataFrame([(str(k), 1, dt.date(2020, 1, 1), m) for k, m in FAULTS.items()] + [("null", 1, dt.date(2020, 1, 1), None)],
                                 "msg_id string, org_id int, received_date date, message string")
    got = {r.msg_id: r.fault for r in hl7.parse(rows).collect()}
    assert got == {str(k): k for k in FAULTS} | {"null": "empty"}


def test_mangled_messages_never_fail_a_batch(spark):
    rng = random.Random(2)
    mangled = []
    for k in range(250):
        text = list(GOOD)
        for _ in range(rng.choice([1, 3, 30])):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "|", "^", "~", "\r", "\x00", "é", "�", "MSH|", "RXA|", text[at] * 50])
        mangled.append("".join(text)[: rng.choice([10**6, rng.randrange(1, len(text))])])
    v = validate(spark, [*mangled, GOOD, None, "", "|" * 500, "MSH", "MSH|", "MSH|^~\\&|" + "|" * 300])
    report = v.report.collect()
    assert len(report) == 257
    broken = {r.msg_id for r in v.quarantined().collect()}
    assert broken == {r.msg_id for r in report if any(f.rule == "V59" for f in r.findings)} and 250 not in broken
    for r in report:
        if r.msg_id in broken:
            assert [f.rule for f in r.findings] == ["V59"]
    assert acceptance.build_ack(v.report).where("ack is null").count() == 0
    assert v.observations.count() >= 0 and v.doses.count() > 0


def test_codes_expire(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("codeset,value,label,status,new_value,valid_from,valid_to\n"
                                        "S,a,open,VALID,,,\nS,b,old,VALID,,1990-01-01,1999-12-31\nS,b,new,VALID,,2001-01-01,\nS,c,ended,VALID,,,1999-12-31\n"
                                        "S,d,wide,VALID,,1990-01-01,\nS,d,narrow,VALID,,1995-01-01,1996-01-01\nT,a,other,VALID,,,\n")
    codes = files.read_codes(spark, str(tmp_path))
    days = ["1989-12-31", "1995-06-01", "1999-12-31", "2000-01-01", "2001-01-01"]
    asked = spark.createDataFrame([(v, dt.date.fromisoformat(d)) for v in "abcdz" for d in days] + [("a", None), (None, dt.date(2000, 1, 1))], "v string, day date")
    rows = C.lookup_on(asked, codes, "S", "v", "x", "day", ("value", "label")).collect()
    assert len(rows) == asked.count()
    got = {(r.v, str(r.day)): r.x_label for r in rows}
    assert [got["a", d] for d in days] == ["open"] * 5
    assert [got["b", d] for d in days] == [None, "old", "old", None, "new"]
    assert [got["c", d] for d in days] == ["ended"] * 3 + [None] * 2
    assert [got["d", d] for d in days] == [None, "narrow", "wide", "wide", "wide"]
    assert [got["z", d] for d in days] == [None] * 5 and got[None, "2000-01-01"] is None


def feature(k):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [k / 2, k]}, "properties": {"id": k, "description": "", "url": f"u{k}"}}


def test_geojson_documents_lines_and_broken_files(spark, tmp_path):
    def collection(ks):
        return {"type": "FeatureCollection", "features": [feature(k) for k in ks]}

    (tmp_path / "lines.json").write_text("\n".join(json.dumps(collection([k])) for k in (1, 2)) + "\nnot json\n")
    (tmp_path / "one.json").write_text(json.dumps(collection([3, 4])))
    (tmp_path / "indented.json").write_text(json.dumps(collection([5, 6]), indent=2))
    (tmp_path / "feature_lines.json").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(json.dumps(feature(k)) for k in (7, 8)) + "\n]}")
    (tmp_path / "broken.json").write_text(json.dumps(collection([9]), indent=2)[:-30])
    (tmp_path / "two.json").write_text("\n".join(json.dumps(collection([k]), indent=2) for k in (10, 11)))
    (tmp_path / "other.json").write_text('{"type": "Topology"}')
    got = files.read_geo(spark, str(tmp_path), "geojson", "base/").collect()
    assert {(r.id, r.lon, r.lat, r.url) for r in got} == {(k, k / 2, k, f"base/u{k}") for k in range(1, 9)} and len(got) == 8
    unreadable = files.read_collections(spark, str(tmp_path))[1].collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in unreadable) == [
        ("broken.json", "no document"), ("lines.json", "no collection"), ("other.json", "no collection"), ("two.json", "several documents")]


def test_read_messages_of_files(spark, tmp_path):
    (tmp_path / "a.hl7").write_bytes(GOOD.encode())
    assert [r.message for r in files.read_messages(spark, str(tmp_path)).select(F.col("message")).collect()] == [GOOD]
    with pytest.raises(ValueError):
        files.read_messages(spark, str(tmp_path), "x")
