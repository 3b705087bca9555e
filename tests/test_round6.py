"""Steps whose memory or disk did not follow what the tables hold."""

from vaxframe.functions import codes as C
from vaxframe.operators import identity, respond, upsert
from vaxframe.plans import q_extracts, q_identity, q_messages, q_response
from vaxframe.plans.fixtures import FORECAST, PATIENT, Registry

DOSE = ("patient_id long, seq int, cvx string, administered_date date, expiration_date date, vr_id string, vr_link string, ndc string, lot string, amount string, "
        "info_source string, refusal_code string, completion_status string, action_code string, mvx string, body_route string, body_site string, part_id long")
PARTS = ["value", "units", "method"]


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_doses_of_an_answer_are_not_broadcast(spark, monkeypatch):
    customers = spark.range(1, 4).selectExpr("id as c_custkey", "'BUILDING' as c_mktsegment", "1 as c_nationkey")
    people = Registry.project(customers, PATIENT).selectExpr("*", "'' as mrn_authority", "'MR' as mrn_type", "'LINK' as patient_link")
    asked = spark.sql("""select * from values ('q1', 1L, array('GREEN')), ('q2', 2L, array()), ('q3', cast(null as bigint), array()) t(query_id, p, flavors)""").selectExpr(
        "query_id", "cast(flavors as array<string>) as flavors", "'Org' as org_name", "1 as q_org", "case when p is null then 'Z33' else 'Z32' end as profile_out",
        "false as forecast_wanted", "case when p is not null then named_struct('patient_id', p) end as hit", "'L' as q_last", "'F' as q_first", "'Z34' as profile",
        "false as bad_profile", "false as has_error", "'OK' as status", "'QPD|' as qpd_line")
    dose = ["10", "1.1", "", "LOT", "0.5", "00", "", "CP", "A", "MSD", "", "", 1]
    doses = spark.createDataFrame([(p, s, cvx, None, None, *dose) for p in (1, 2, 3) for s, cvx in ((1, "03"), (2, "91"))], DOSE)
    observed = spark.createDataFrame([(p, s, 10 * p + (s or 0)) for p in (1, 2, 3) for s in (1, 2, 7, None)], "patient_id long, seq int, obs_no long").selectExpr(
        "*", "'CE' as value_type", "'X' as identifier_code", "'Lbl' as identifier_label", "'LN' as identifier_table", "'F' as result_status", "date '1999-01-01' as observation_date",
        *[f"'' as {p}_{c}" for p in PARTS for c in ("code", "label", "table")])
    forecasts = Registry.project(customers.selectExpr("c_custkey", "1 as k"), FORECAST)
    candidates = spark.createDataFrame([], "query_id string, patient_id long")
    staged, keep = [], respond.stage
    monkeypatch.setattr(respond, "stage", lambda df, name: staged.append((name, plan_of(df))) or keep(df, name))
    lines = respond.response_lines(asked, candidates, people, doses, q_response.evaluations(doses), observed, forecasts, C.seed_codes(spark), q_response.AS_OF)
    counts = {(r.query_id, r.kind): r["count"] for r in lines.selectExpr("query_id", "left(line, 3) as kind").groupBy("query_id", "kind").count().collect()}
    # two evaluation lines and a report for each shown dose, one report without a dose; typhoid is hidden from q1, and no dose is numbered 7
    assert [counts.get((q, "RXA"), 0) for q in ("q1", "q2", "q3")] == [1, 2, 0]
    assert [counts.get((q, "OBX"), 0) for q in ("q1", "q2", "q3")] == [4, 7, 0]
    # Spark takes the narrow columns for a small table, whatever their number of rows
    semi = [line for _, plan in staged for line in plan.split("\n") if "LeftSemi" in line and "query_id" in line]
    assert len(semi) >= 2 and not [line for line in semi if "Broadcast" in line]
    given = next(plan for name, plan in staged if name == "given")
    assert "BroadcastExchange" not in given


def test_queries_are_parsed_once(spark, tmp_path):
    keys = [9, 19, 89, 429, 579, 579, 10, None]
    orders = spark.createDataFrame([(k, 3) for k in keys], "o_orderkey long, o_custkey long").selectExpr("*", "timestamp '1999-01-01' as o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 4).selectExpr("id as c_custkey", "'BUILDING' as c_mktsegment", "id as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = q_messages.dq_query(spark, str(tmp_path))
    assert sorted((r.msg_id, r.rule) for r in got.collect()) == [(89, "V03"), (429, "V04"), (579, "V06"), (579, "V06")]
    # a condition on a parsed column would stand below the parse with the text of the whole message in it
    assert not [f for f in got.inputFiles() if "orders" in f]


def tables(spark, path, doses):
    """customer 1..3, an order each, and ``doses`` (customer, line, part, supplier, day)."""
    spark.range(1, 4).selectExpr("id as c_custkey", "'BUILDING' as c_mktsegment", "id as c_nationkey").write.parquet(f"{path}/customer.parquet")
    spark.range(1, 4).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp '1999-01-01' as o_orderdate").write.parquet(f"{path}/orders.parquet")
    spark.range(30).selectExpr("id as p_partkey").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(doses, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, day string").selectExpr(
        "*", "1.0d as l_quantity", "1.0d as l_extendedprice", "0.0d as l_discount", "'N' as l_returnflag", "'O' as l_linestatus", "cast(day as timestamp) as l_shipdate").drop(
        "day").write.parquet(f"{path}/lineitem.parquet")


def test_reports_of_the_dedup_move_once(spark):
    rows = [(1, "a", ""), (1, "b", "X"), (1, "c", "Y"), (2, "d", "X"), (2, "e", "Y"), (2, "f", ""), (2, "g", "X"), (2, "h", "Y"), (None, "i", "X"), (None, "j", "X"), (2, "d", "X"),
            (3, "k", None), (3, None, "Z")]
    reports = spark.createDataFrame(rows, "grp int, place string, lot string").repartition(3)
    out = identity.dedup_vaccinations(reports, ("grp",), "lot", "place")
    assert plan_of(out).count("Exchange hashpartitioning") == 1
    got = sorted(((r.place or "", r.master_id) for r in out.collect()))
    assert got == [("", None), ("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("d", "d"), ("e", "e"), ("f", "d"), ("g", "d"), ("h", "e"), ("i", "i"), ("j", "j"), ("k", "k")]


def test_deletes_move_the_reports_once(spark, tmp_path):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = [("a", "m"), ("b", "m"), ("c", "n"), ("c", "n"), (None, "o"), ("d", None), ("e", None)]
        spark.createDataFrame(rows, "vr_link string, master_id string").write.parquet(str(tmp_path / "linked"))
        reports = spark.read.parquet(str(tmp_path / "linked"))
        wanted = spark.createDataFrame([("a",), ("c",), ("c",), ("d",), (None,)], "vr_link string")
        for compat, masters in ((False, {"m", "o", None}), (True, {"o", None})):
            left, kept = upsert.delete_vaccinations(reports, reports.select("master_id").distinct(), wanted, compat)
            assert sorted((r.vr_link or "", r.master_id) for r in left.collect()) == [("", "o"), ("b", "m"), ("e", None)]
            assert {r.master_id for r in kept.collect()} == masters
            both = plan_of(left.select("master_id").unionByName(kept))
            moved = [line for line in both.split("\n") if "hashpartitioning(vr_link" in line and "ReusedExchange" not in line]
            assert len(moved) == 2  # the reports and the wanted links
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_deletes_store_the_linked_reports_alone(spark, tmp_path, monkeypatch):
    tables(spark, str(tmp_path), [(1, 1, 1, 1, "1999-01-05"), (1, 1, 1, 1, "1999-01-05"), (2, 1, 1, 1, "1999-01-05"), (3, 1, 2, 1, "1999-01-05")])
    spark.range(50).selectExpr("id as event_id", "id as user_id", "'view' as event_type", "timestamp '2024-01-15 00:00:00' as ts", "1.0d as value", "'' as props").write.parquet(
        str(tmp_path / "events.parquet"))
    staged, keep = [], q_identity.stage
    monkeypatch.setattr(q_identity, "stage", lambda df, name: staged.append(name) or keep(df, name))
    assert {r.kind for r in q_identity.delete_vaccinations(spark, str(tmp_path)).collect()} == {"report", "master"}
    assert staged == ["linked"]


def test_bundles_read_the_columns_they_show(spark, tmp_path):
    tables(spark, str(tmp_path), [(1, 1, 1, 1, "1999-01-05"), (1, 2, 13, 1, "1999-01-05"), (1, 3, 2, 1, "1999-01-06"), (2, 1, 11, 1, "1999-01-05")])
    out = q_extracts.patient_bundle(spark, str(tmp_path))
    scans = [line for line in plan_of(out).split("\n") if "l_shipdate" in line and "ReadSchema" in line]
    assert scans and not [line for line in scans if "l_linestatus" in line]  # the completion status, which no bundle shows
    rows = {r.patient_id: r for r in out.collect()}
    assert {k: r.entries for k, r in rows.items()} == {1: 3, 2: 1, 3: 1}  # one report a day and vaccine, and no unknown code
    assert rows[1].bundle.count('"resourceType":"Immunization"') == 2 and '"code":"NDC-13"' in rows[1].bundle and '"code":"NDC-1"' not in rows[1].bundle
