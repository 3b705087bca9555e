"""Inputs that the projected tables do not hold: folder tables as streams, blank ids, missing fields."""

import pytest

from vaxframe.operators import identity, respond
from vaxframe.streaming import streams


def test_stream_reads_a_folder_of_parts_and_a_single_file(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k")
    rows.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    assert streams.run_to_files(streams.read_table(spark, str(tmp_path), "many.parquet"), "many").count() == 1000
    stream = streams.read_table(spark, "/root/testdata/sf0.001", "region.parquet")
    assert streams.run_to_files(stream, "one").count() == spark.read.parquet("/root/testdata/sf0.001/region.parquet").count()


def test_blank_ids_match_nobody(spark):
    others = [f"cast(null as string) as {c}" for c in identity.PATIENT_COLUMNS if c not in ("patient_id", "org_id", "mrn")]
    patients = spark.sql("select * from values (1L, 'o', ''), (2L, 'o', 'm'), (3L, 'o', cast(null as string)) as t(patient_id, org_id, mrn)").selectExpr("*", *others)
    queries = spark.sql("select * from values ('a', 'o', ''), ('b', 'o', 'm'), ('c', 'o', cast(null as string)) as t(query_id, q_org, q_mrn)")
    got = {r.query_id: r.mrn_hit.patient_id if r.mrn_hit else None for r in identity.match_by_mrn(queries, patients).collect()}
    assert got == {"a": None, "b": 2, "c": None}


def test_missing_fields_keep_the_line(spark):
    text = respond._joined(["'PID|'", "a", "'|'", "b", "'|'"])
    assert spark.sql(f"select {text} as line from values (cast(null as string), 'x') as t(a, b)").first().line == "PID||x|"


def test_every_layer_is_ranked(spark):
    from vaxframe.operators import feeds

    layers = spark.range(900).selectExpr(
        "id as layer_id", "concat('L', lpad(id, 4, '0')) as name", "case when id % 3 > 0 then concat('shot 20', 10 + id % 9, '/01/02') end as date_text",
        "case when id % 5 > 0 then concat(id % 7, '.5 m') end as resolution_text")
    rows = feeds.imagery_rank(layers).collect()
    last = 10**9
    want = sorted(rows, key=lambda r: (-r.shot_date.toordinal() if r.shot_date else last, last if r.metres is None else r.metres, r.name))
    assert [r["rank"] for r in want] == list(range(1, 901))


def test_equal_keys_have_one_link_and_taken_links_move(spark):
    rows = spark.sql("select * from values (1, 'a'), (1, 'a'), (1, 'b') as t(org_id, mrn)")
    first = identity.assign_patient_link(rows)
    assert first.count() == 3 and first.distinct().count() == 2
    again = identity.assign_patient_link(rows, first.where("mrn = 'a'").select("patient_link"))
    assert again.count() == 3 and again.distinct().count() == 2
    assert again.join(first, ["mrn", "patient_link"], "left_semi").select("mrn").distinct().collect() == [("b",)]


def test_links_that_stay_taken_fail(spark):
    rows = spark.sql("select 1 as org_id, 'a' as mrn")
    taken = identity.assign_patient_link(rows).select("patient_link")
    with pytest.raises(ValueError):
        identity.assign_patient_link(rows, taken, tries=1)
