"""Messages are dealt evenly whatever the file's row groups; work that several branches need is done once."""

from vaxframe.operators import hl7
from vaxframe.plans import catalog
from vaxframe.plans.fixtures import Registry

SF = "/root/testdata/sf0.001"


def test_messages_of_one_row_group_span_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "date '1999-01-01' as o_orderdate")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits, of which one holds the row group
    try:
        messages = Registry(spark, str(tmp_path)).messages()
        sizes = [r["count"] for r in messages.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_binary_messages(spark):
    codes = [*range(0, 40), 126, 127, 128, 0xE9, 0xFFFC, 0xFFFD, 0x1F600]
    rows = [(c, "MSH|^~\\&|a|b|c|d|e|f|VXU|1|P|2.5\rPID|x" + chr(c)) for c in codes]
    got = hl7.parse(spark.createDataFrame(rows, "msg_id long, message string")).collect()
    binary = {*range(0, 9), *range(14, 32), 127, 0xFFFD}
    assert {r.msg_id for r in got if r.fault == "binary"} == binary
    broken = spark.sql("select 1L as msg_id, cast(concat(cast('MSH|^~\\\\&|a' as binary), x'C328') as string) as message")
    assert [r.fault for r in hl7.parse(broken).collect()] == ["binary"]


def test_deletes_start_from_written_reports(spark):
    catalog.load()
    files = catalog.QUERIES["delete_vaccinations"](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_answer_lines_are_written_by_kind(spark):
    catalog.load()
    files = catalog.QUERIES["response_lines"](spark, SF).inputFiles()
    assert files and all("/answer-lines-" in f for f in files)
