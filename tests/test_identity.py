"""Closed forms against step-by-step simulations on small random data."""

import datetime as dt
import random

from vaxframe.operators import history, identity, upsert


def test_link_patients_equals_one_by_one(spark):
    rnd = random.Random(7)
    for _ in range(3):
        masters = [(i, f"L{rnd.randrange(4)}", f"F{rnd.randrange(2)}", dt.date(2000, 1, 1 + rnd.randrange(3))) for i in range(6)]
        reports = [(0, f"R{i}", rnd.randrange(6)) for i in range(3)]
        batch = [(0, f"R{rnd.randrange(14)}", f"L{rnd.randrange(7)}", f"F{rnd.randrange(2)}", dt.date(2000, 1, 1 + rnd.randrange(3)), n)
                 for n in range(30)]
        known = {(o, m): master for o, m, master in sorted(reports, key=lambda r: -r[2])}
        pool, want = [(*m, None) for m in masters], {}
        for org, mrn, last, first, born, n in batch:
            if (org, mrn) in want:
                continue
            if (org, mrn) in known:
                want[org, mrn] = (known[org, mrn], None, None)
                continue
            exact = [m for m in pool if m[1:4] == (last, first, born)]
            named = [m for m in pool if m[1:3] == (last, first)]
            hit = (exact or named or [None])[0]
            if hit is None:
                pool.append((None, last, first, born, n))
                want[org, mrn] = (None, n, None)
            else:
                want[org, mrn] = (hit[0], hit[4], 2 if exact else 1)
        got = identity.link_patients(
            spark.createDataFrame(batch, "org_id int, mrn string, name_last string, name_first string, birth_date date, arrival int").repartition(5),
            spark.createDataFrame(reports, "org_id int, mrn string, master_id int"),
            spark.createDataFrame(masters, "master_id int, name_last string, name_first string, birth_date date"))
        assert {(r.org_id, r.mrn): (r.master_id, r.new_master, r.confidence) for r in got.collect()} == want


def test_dedup_equals_one_by_one(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.choice(["03", "08"]), dt.date(2000, 1, 1), "00", rnd.choice(["", "A", "B", "C"]), n) for n in range(60)]
    seen, want = [], {}
    for p, cvx, day, src, lot, n in rows:
        hit = next((m for (q, m) in seen if q[:4] == (p, cvx, day, src) and (q[4] == lot or "" in (q[4], lot))), None)
        want[n] = n if hit is None else hit
        seen.append(((p, cvx, day, src, lot), want[n]))
    df = spark.createDataFrame(rows, "patient_id int, cvx string, administered_date date, info_source string, lot string, vr_id int")
    got = {r.vr_id: r.master_id for r in identity.dedup_vaccinations(df.repartition(4)).collect()}
    assert got == want
    blank = df.selectExpr("case when vr_id % 2 = 0 then patient_id end as patient_id", "cvx", "administered_date", "info_source", "lot", "vr_id")
    kept = {r.vr_id: r.master_id for r in identity.dedup_vaccinations(blank).collect()}
    assert len(kept) == 60 and all(kept[n] == n for n in range(1, 60, 2))


def test_possible_matches_against_all_pairs(spark):
    rnd = random.Random(5)
    day = dt.date(2000, 1, 1)
    people = [(n, 1, day, f"L{rnd.randrange(6) if n > 60 else 0}", f"F{rnd.randrange(6)}") for n in range(200)]  # one name holds a third
    asked = [(n, 1, day, f"L{n % 8}", f"F{n % 7}") for n in range(40)]
    patients = spark.createDataFrame(people, "patient_id int, org_id int, birth_date date, name_last string, name_first string")
    queries = spark.createDataFrame(asked, "query_id int, q_org int, q_birth date, q_last string, q_first string")
    pairs = {(q[0], p[0]) for q in asked for p in people if q[3] == p[3] or q[4] == p[4]}
    counted = identity.possible_counts(queries, patients)
    sizes = {q[0]: sum(1 for a, _ in pairs if a == q[0]) for q in asked}
    assert {r.query_id: r.possible for r in counted.collect()} == sizes
    cap = 45
    got = {(r.query_id, r.patient_id) for r in identity.possible_matches(counted, patients, str(cap)).collect()}
    assert got == {(q, p) for q, p in pairs if sizes[q] <= cap} and got


def test_patient_links_are_unique_and_avoid_taken_ones(spark):
    rows = spark.range(3000).selectExpr("cast(id % 25 as int) as org_id", "concat('M', id) as mrn")
    first = identity.assign_patient_link(rows)
    assert first.select("patient_link").distinct().count() == 3000
    assert first.where("length(patient_link) = 12 and not patient_link rlike '[IO0]'").count() == 3000
    taken = first.where("mrn = 'M7'").select("patient_link")
    again = identity.assign_patient_link(rows, taken)
    assert again.join(taken, "patient_link", "left_semi").count() == 0
    assert again.join(first, ["org_id", "mrn", "patient_link"], "left_semi").count() == 2999


def _batch(spark, rows):
    cols = ["org_id int", "mrn string", "received_date date", "msg_id int", "has_pd1 boolean", "has_nk1 boolean"]
    dates = {"birth_date", "death_date", "publicity_date", "protection_date", "registry_date"}
    names = [*upsert.PID, *upsert.PD1, *upsert.NK1]
    schema = ", ".join(cols + [f"{n} {'date' if n in dates else 'string'}" for n in names])
    return spark.createDataFrame([(*r, *[dt.date(2000, 1, 1 + r[3] % 28) if n in dates else f"{n}{r[3]}" for n in names]) for r in rows], schema)


def test_upsert_is_idempotent_and_splits(spark):
    rnd = random.Random(11)
    rows = [(1, f"M{rnd.randrange(9) if n % 3 else 0}", dt.date(2020, 1, 1 + n // 10), n, n % 2 == 0, n % 5 == 0) for n in range(80)]
    keys = ["org_id", "mrn"]
    whole = _batch(spark, rows)
    empty = upsert.empty_registry(spark, whole, keys, upsert.PATIENT_GROUPS)
    once = upsert.upsert_patients(empty, whole)
    want = sorted(once.collect())
    assert sorted(upsert.upsert_patients(once, whole).collect()) == want
    halves = upsert.upsert_patients(upsert.upsert_patients(empty, _batch(spark, rows[:40])), _batch(spark, rows[40:]))
    assert sorted(halves.collect()) == want


def test_history_keeps_the_highest_report_of_a_hot_patient(spark):
    rows = spark.range(9000).selectExpr(
        "cast(if(id % 3 = 0, 0, id % 50) as int) as patient_id", "date_add(date '2020-01-01', cast(id % 40 as int)) as administered_date",
        "element_at(array('03', '08', ''), cast(id % 3 as int) + 1) as cvx", "id as vr_id", "concat('R', id) as vr_link")
    got = {(r.patient_id, r.administered_date, r.cvx): r.vr_link for r in history.history(rows, "vr_id", "vr_link").collect()}
    want = {}
    for r in rows.orderBy("vr_id").collect():
        if r.cvx:
            want[r.patient_id, r.administered_date, r.cvx] = r.vr_link
    assert got == want


def test_delete_keeps_a_shared_master(spark):
    reports = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "vr_link string, master_id int")
    masters = reports.select("master_id").distinct()
    wanted = spark.createDataFrame([("a",), ("c",)], "vr_link string")
    left, kept = upsert.delete_vaccinations(reports, masters, wanted)
    assert [r.vr_link for r in left.collect()] == ["b"] and [r.master_id for r in kept.collect()] == [1]
    _, kept = upsert.delete_vaccinations(reports, masters, wanted, compat=True)
    assert kept.collect() == []
