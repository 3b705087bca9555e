"""Batches merged into stored tables, against step-by-step simulations."""

import datetime as dt
import random

import pytest

from vaxframe.operators import identity, interchange, upsert

DAY = dt.date(2000, 1, 1)


def joined_one_by_one(reports):
    """Master of each report (place, group, lot, given), stored ones first, then one by one in order."""
    masters, seen = {}, []
    for place, group, lot, given in sorted(reports, key=lambda r: (r[3] is None, r[0])):
        match = next((p for p, g, v in seen if g == group and (v == lot or not v or not lot)), None)
        masters[place] = given or (masters[match] if match is not None else place)
        seen.append((place, group, lot))
    return masters


@pytest.mark.parametrize("seed", range(6))
def test_new_reports_join_stored_masters(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{k:03d}", rng.choice("ab"), rng.choice(["", None, "x", "y", "z"]), f"m{k % 4}" if rng.random() < 0.4 else None) for k in range(60)]
    got = identity.join_masters(spark.createDataFrame(rows, "place string, grp string, lot string, given string"), ("grp",), "lot", "place", "given")
    assert {r.place: r.master_id for r in got.collect()} == joined_one_by_one([(p, g, v or "", m) for p, g, v, m in rows])


def test_a_missing_key_makes_its_own_master(spark):
    rows = [("a", None, "x", None), ("b", None, "x", None), ("c", None, "x", "kept")]
    got = identity.join_masters(spark.createDataFrame(rows, "place string, grp string, lot string, given string"), ("grp",), "lot", "place", "given")
    assert {r.place: r.master_id for r in got.collect()} == {"a": "a", "b": "b", "c": "kept"}


def test_masters_take_the_last_changed_report(spark):
    masters = spark.createDataFrame([(1, "p", "M", "03", DAY, "a"), (1, "q", "N", "08", DAY, "z")],
                                    "org_id int, mrn string, master_id string, cvx string, administered_date date, last_report string")
    links = spark.createDataFrame([(1, "p", "a", "M"), (1, "p", "b", "M"), (1, "q", "z", "N")], "org_id int, mrn string, vr_link string, master_id string")
    later = [DAY + dt.timedelta(days=k) for k in range(5)]
    batch = spark.createDataFrame(
        [(1, "p", "b", "10", later[1], DAY, 5, 1), (1, "p", "a", "20", later[2], DAY, 4, 1), (1, "p", "b", "21", later[3], DAY, 5, 2), (1, "p", "new", "62", later[4], DAY, 6, 1)],
        "org_id int, mrn string, vr_link string, cvx string, administered_date date, received_date date, msg_id long, order_no int")
    after, linked = upsert.vaccination_masters(masters, links, batch)
    assert {(r.master_id, r.cvx, r.administered_date, r.last_report, r.created) for r in after.collect()} == {
        ("M", "21", later[3], "b", False), ("N", "08", DAY, "z", False), ("1/p/new", "62", later[4], "new", True)}
    assert {(r.vr_link, r.master_id) for r in linked.collect()} == {("a", "M"), ("b", "M"), ("z", "N"), ("new", "1/p/new")}
    again, _ = upsert.vaccination_masters(after.drop("created"), linked, batch)
    assert again.drop("created").exceptAll(after.drop("created")).count() == 0  # a batch that comes again changes nothing


def event(spark, rows):
    """(arrival, mrn, vr_link, cvx, lot, facility, zip)"""
    text = """to_json(named_struct('patient', named_struct('identifier', array(named_struct('value', mrn)), 'name', array(named_struct('family', concat('L', mrn), 'given', array('F'))), 'birthDate', date '1990-01-01'),
        'immunization', named_struct('identifier', array(named_struct('value', link)), 'occurrenceDateTime', date '2000-01-01', 'lotNumber', lot, 'primarySource', true,
        'vaccineCode', named_struct('coding', array(named_struct('code', cvx))), 'patient', named_struct('reference', mrn),
        'location', named_struct('id', place, 'address', named_struct('postalCode', zip, 'country', 'USA')))))"""
    frame = spark.createDataFrame(rows, "arrival string, mrn string, link string, cvx string, lot string, place string, zip string")
    return interchange.parse_events(frame.selectExpr("arrival as msg_id", "arrival", "1 as org_id", "date '2000-02-01' as received_date", f"{text} as event"))


def test_ingest_updates_stored_tables(spark):
    known = spark.createDataFrame([(1, "p"), (1, "q")], "org_id int, mrn string")
    first = interchange.Ingest(interchange.empty_store(spark), event(spark, [
        ("1", "p", "a", "03", "x", "FAC1", "1"), ("2", "p", "b", "03", "", "FAC1", "2"), ("3", "nobody", "c", "03", "x", "FAC9", "3")]), known).write()
    assert {(r.vr_link, r.vaccination_master) for r in first["reports"].collect()} == {("a", "1"), ("b", "1")}  # V61 leaves nothing, not even its place
    assert [(r.facility_code, r.facility_zip, r.facility_country) for r in first["locations"].collect()] == [("FAC1", "1", "USA")]
    after = interchange.Ingest(first, event(spark, [
        ("4", "p", "a", "08", "x", "FAC1", "9"), ("5", "p", "d", "08", "x", "FAC2", "5"), ("6", "q", "e", "03", "x", "", "6"), ("7", "p", "f", "10", "", "FAC2", "7")]), known).write()
    reports = {r.vr_link: r for r in after["reports"].collect()}
    # a keeps its master and its first arrival with a new code; d equals it now; e is another patient's
    assert {k: (r.cvx, r.vaccination_master, r.first_arrival) for k, r in reports.items()} == {
        "a": ("08", "1", "1"), "b": ("03", "1", "2"), "d": ("08", "1", "5"), "e": ("03", "6", "6"), "f": ("10", "7", "7")}
    assert {(r.vaccination_master, r.cvx) for r in after["vaccination_masters"].collect()} == {("1", "03"), ("6", "03"), ("7", "10")}
    assert {(r.mrn, r.patient_master) for r in after["patients"].collect()} == {("p", "1"), ("q", "6")}
    assert {(r.facility_code, r.facility_zip) for r in after["locations"].collect()} == {("FAC1", "1"), ("FAC2", "5")}


def test_ingest_of_nothing(spark):
    known = spark.createDataFrame([(1, "p")], "org_id int, mrn string")
    out = interchange.Ingest(interchange.empty_store(spark), event(spark, [("1", "", "", "", "", "", "")]), known).write()
    assert {name: rows.count() for name, rows in out.items()} == dict.fromkeys(interchange.STORE, 0)
