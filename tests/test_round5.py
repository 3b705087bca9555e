"""Steps whose work grew faster than the tables, or that moved every row several times."""

import re

from vaxframe.functions import hl7text
from vaxframe.operators import codemap, hl7, identity, interchange, rules
from vaxframe.plans import fixtures, q_messages
from vaxframe.plans.fixtures import Registry

SF = "/root/testdata/sf0.001"


def moves(df):
    """Number of shuffles of the plan as it stands before it runs."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return plan.count("Exchange hashpartitioning")


def batch(spark, rows):
    """Events (arrival, org, mrn, link, lot) of one vaccine and day."""
    events = spark.createDataFrame(rows, "arrival string, org_id int, mrn string, vr_link string, lot string")
    some = [c for c in [*interchange.REPORT, *interchange.LOCATION, "name_last", "name_first"]
            if c not in ("lot", "cvx", "administered_date", "reported_date", "info_source")]
    return events.selectExpr("*", "arrival as msg_id", "'' as patient_ref", "'03' as cvx", "date '1999-01-01' as administered_date", "date '1999-02-01' as reported_date",
                             "'00' as info_source", "date '1990-01-01' as birth_date", *[f"'' as {c}" for c in some])


def test_reports_of_the_ingest_move_once(spark):
    known = spark.createDataFrame([(1, "M1"), (None, "M1")], "org_id int, mrn string")
    first = interchange.Ingest(interchange.empty_store(spark), batch(spark, [
        ("1", 1, "M1", "a", "L1"), ("2", 1, "M1", "a", "L2"), ("3", None, "M1", "n", ""), ("4", 1, "M1", "b", "L2")]), known).write()
    after = interchange.Ingest(first, batch(spark, [
        ("5", 1, "M1", "c", ""), ("6", None, "M1", "n", ""), ("7", 1, "M1", "a", "L9")]), known)
    got = {(r.org_id, r.vr_link, r.first_arrival): (r.lot, r.vaccination_master) for r in after.reports.collect()}
    # a and b share lot L2; c without a lot follows the first; a report without an organisation meets nothing
    assert got == {(1, "a", "1"): ("L9", "1"), (1, "b", "4"): ("L2", "1"), (1, "c", "5"): ("", "1"),
                   (None, "n", "3"): ("", "3"), (None, "n", "6"): ("", "6")}
    assert moves(after.reports) == 1


def test_masters_join_with_one_move(spark):
    rows = [("a", None, "L", None), ("b", None, "L", None), ("c", "g", "L", None), ("d", "g", "L", "old")]
    out = identity.join_masters(spark.createDataFrame(rows, "place string, grp string, lot string, given string"), ("grp",), "lot", "place", "given")
    assert moves(out) == 1
    assert {r.place: r.master_id for r in out.collect()} == {"a": "a", "b": "b", "c": "old", "d": "old"}


def test_doses_of_one_row_group_span_tasks(spark, tmp_path):
    lines = spark.range(4000).selectExpr(
        "id % 400 as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "1 as l_linenumber", "1.0d as l_quantity", "1.0d as l_extendedprice", "0.0d as l_discount",
        "'N' as l_returnflag", "'O' as l_linestatus", "timestamp '1999-01-01' as l_shipdate")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(400).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp '1999-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    settings = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # many splits, of which one holds the row group
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        registry = Registry(spark, str(tmp_path))
        sizes = [r["count"] for r in registry.vaccinations().selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
        people = spark.range(1, 400).selectExpr("id as patient_id", "concat('M', id) as mrn")
        mrns = [tuple(r) for r in registry.vaccinations(people).groupBy("patient_id", "mrn").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert sorted(mrns) == [(i, f"M{i}", 10) for i in range(1, 400)]


def test_code_tables_are_broadcast_whatever_the_size_of_part(spark, tmp_path):
    spark.range(50000).selectExpr("id as p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(50000).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        registry = Registry(spark, str(tmp_path))
        doses = spark.range(100000).selectExpr("concat('NDC-', id % 60) as ndc", "'' as cpt", "'' as cvx_sent", "cast(id % 25 as int) as org_id", "concat('FAC', id % 60) as facility_code")
        rows = codemap.resolve_cvx(doses, registry.codes(), registry.relations()).join(registry.locations(), ["org_id", "facility_code"], "left")
        assert moves(rows) == 0
        assert rows.where("ndc_known").count() == sum(n % 60 < 27 for n in range(100000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_orders_hold_what_is_asked(spark):
    orders = q_messages.validation(spark, SF).stage_orders("vr_link").orders
    assert {*orders.columns} == {*rules.Validation.COMMIT, "vr_link"}
    assert q_messages.validation(spark, SF).orders.count() == orders.count()


def test_message_texts_are_compiled(spark, capsys):
    orders = spark.range(200).selectExpr("nullif(id, 7) as o_orderkey", "id as o_custkey", "timestamp '1999-01-01' as o_orderdate")
    rows = fixtures.message_table(orders)
    rows.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM never compiles a larger method
    texts = {r.msg_id: r.message for r in rows.collect()}
    assert [texts[i].count("\rORC|") for i in (10, 11, 12, 13, 14)] == [1, 2, 3, 4, 5]
    assert texts[None].count("ORC|") == 0


def test_lines_written_out_are_those_of_the_lambda(spark):
    line, whole = "concat('k', k, case when n + k = 4 then null else '.' end)", "array_join(transform(sequence(1, n), k -> {}), char(13))"
    rows = spark.sql("select nullif(id, 0) as n from range(-3, 9)").selectExpr(
        f"{fixtures._written_out('n', 1, 5, 'k', line, whole.format(line))} as a", f"{whole.format(line)} as b")
    assert all(r.a == r.b for r in rows.collect())


def test_faults_are_those_of_the_long_conditions(spark):
    head = "MSH|^~\\&|A|B|C|D|20010101||VXU^V04|1|P|2.5.1"
    tails = ["", "PID|1", "PID", "PIDX", "pid|1", "P1|", "PID|\x01", "\x7f", "PID|\ufffd", "PID|\u00e9\U0001F600", "PID\u0085", "PID\u2028", "\u0085", "PID|\u0085", "\n\nPID|1\r\n",
             "MSH|", "MSH|^~", "PID|MSH|", "PID|MSH|^~", "MSH|^~\rPID|MSH|^~", " PID|1", "PID|1\tx\x0by", "ZZ9|", "99Z|", "NTE|\r" * 50000, "PID|\x00", "\u00c9ID|"]
    starts = ["", "\r", "\n", " ", "PID|1\r", "MSH|^~\rX"]
    texts = [None, "MSH|^~", "FHS|1\r" + head] + [f"{a}{h}\r{t}" for a in starts for h in (head, "MSH|1", "MSH|^~", "") for t in tails]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, message string")
    broken = "select -1L as msg_id, cast(concat(cast('MSH|^~|a|b|c|d|e|f|g|h|i|j|k' as binary), X'{}') as string) as message"
    for code in ("C3", "F09F", "0D504944C37C", "0DFF"):
        rows = rows.unionByName(spark.sql(broken.format(code)))
    old = ("case when coalesce(replace(m, '\\r', ''), '') = '' then 'empty' "
           f"when not is_valid_utf8(m) or contains(m, '\uFFFD') or m rlike '[{hl7.CONTROL}]' then 'binary' "
           "when n = 0 then 'no header' when cast((octet_length(m) - octet_length(replace(m, 'MSH|^~', ''))) / 6 as int) > n then 'nested header' "
           f"when octet_length(m) > {hl7.MOST_CHARS} and length(m) > {hl7.MOST_CHARS} then 'too large' when size(f) < 12 then 'truncated header' "
           "when m rlike '\\r(?![A-Z][A-Z0-9]{2}(\\\\||\\r|$))[^\\r]' then 'broken segment' end")
    want = (rows.selectExpr("msg_id", "concat('\\r', replace(message, '\\n', '\\r')) as m")
            .selectExpr("msg_id", "m", f"{hl7text.segment_count('m', 'MSH')} as n", f"{hl7text.split_fields(hl7text.segment_line('m', 'MSH'))} as f")
            .selectExpr("msg_id", "m", "coalesce(n, 0) as n", f"{old} as fault"))
    got = hl7.parse(rows).selectExpr("msg_id", "message as m", "n_msh as n", "fault")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r.fault for r in got.select("fault").distinct().collect()} >= {None, "empty", "binary", "no header", "nested header", "truncated header", "broken segment"}
