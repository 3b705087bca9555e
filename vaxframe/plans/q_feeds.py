"""Queries for sources, sinks, case calendar, availability and map points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance, feeds
from ..sources import files
from ..sources.scratch import new_path
from .catalog import ORACLES, query
from .fixtures import Registry, with_ctes
from .q_messages import ALL_F, FULL, LOG_SQL, validation

# ---------------------------------------------------------- sources and sinks


@query("scan_cases", with_ctes("fx_case", "select country_region, Date, count(*) as n, cast(round(sum(cast(round(cases * 100) as bigint))) as bigint) as cents from fx_case group by 1, 2"))
def scan_cases(spark, sf_dir):
    path = new_path(spark, "cases-csv")
    files.write_csv(Registry(spark, sf_dir).cases(), path)
    return files.read_cases(spark, path).groupBy("country_region", "Date").agg(
        F.count("*").alias("n"), F.expr("sum(cast(round(cases * 100) as bigint)) as cents"))


@query("land_json", with_ctes("fx_case", "select country_region, Date, cases from fx_case"))
def land_json(spark, sf_dir):
    source, target = new_path(spark, "cases-json"), new_path(spark, "cases-landed")
    Registry(spark, sf_dir).cases().write.json(source + "/upload")
    return files.land_json(spark, source, target, files.CASE_SCHEMA)


@query("land_csv_gz", with_ctes("fx_case", "select country_region, Date, cases from fx_case"))
def land_csv_gz(spark, sf_dir):
    source, target = new_path(spark, "cases-gz"), new_path(spark, "cases-landed")
    Registry(spark, sf_dir).cases().write.csv(source, header=True, compression="gzip")
    return files.land_csv_gz(spark, source, target)


@query("source_gate", """
    select distinct y as order_year, y in (select year(o_orderdate) from orders) as present from (select year(o_orderdate) as y from orders union select year(o_orderdate) + 1 from orders) t""")
def source_gate(spark, sf_dir):
    r = Registry(spark, sf_dir)
    path = new_path(spark, "orders-by-year")
    years = r.table("orders").selectExpr("o_orderkey", "year(o_orderdate) as order_year")
    years.hint("rebalance", F.col("order_year")).write.partitionBy("order_year").parquet(path)
    present = files.listing(spark, path).selectExpr("try_cast(regexp_extract(path, 'order_year=([0-9]+)', 1) as int) as order_year").where("order_year is not null")
    manifest = years.select("order_year").union(years.selectExpr("order_year + 1")).distinct()
    return files.source_gate(manifest, present, "order_year", strict=False)


CENTER = {
    "center_id": "l_suppkey",
    "name": "s_name",
    "state_name": "concat('State ', s_nationkey % 5)",
    "district_name": "concat('District ', s_nationkey)",
    "pincode": "834000 + s_suppkey % 10",
    "fee_type": "case when s_suppkey % 2 = 0 then 'Free' else 'Paid' end",
    "vaccine_fees": "concat(l_partkey % 5, '00')",
    "n_sessions": "cast(l_linenumber % 4 as int)",
    "age": "case when l_linenumber % 2 = 0 then 18 else 45 end",
    "cap": "cast(l_quantity as int)",
    "ship": "cast(l_shipdate as date)",
}
CENTERS_CTE = {"center": "select " + ", ".join(f"{e} as {n}" for n, e in CENTER.items()) + " from lineitem join supplier on l_suppkey = s_suppkey",
               "sess": "select *, i, cast(ship + cast(i as int) as date) as date, cast(cap + i as int) as available_capacity, cast(age as int) as min_age_limit from (select *, unnest(generate_series(1, n_sessions)) as i from center) t union all "
                       "select *, null, null, null, null, null from center where n_sessions = 0"}
CENTERS_CTE["sess"] = ("select center_id, name, state_name, district_name, pincode, fee_type, vaccine_fees, cast(ship + cast(i as int) as date) as date, cast(cap + i as int) as available_capacity, cast(age as int) as min_age_limit "
                       "from (select *, unnest(generate_series(1, n_sessions)) as i from center) t union all "
                       "select center_id, name, state_name, district_name, pincode, fee_type, vaccine_fees, null, null, null from center where n_sessions = 0")


def centers(spark, sf_dir):
    """Center rows with a nested session list; the list follows from the row, so nothing is grouped."""
    r = Registry(spark, sf_dir)
    joined = r.table("lineitem").join(r.table("supplier"), F.expr("l_suppkey = s_suppkey"))
    rows = Registry.project(joined, CENTER)
    session = "named_struct('min_age_limit', cast(age as int), 'available_capacity', cast(cap + i as int), 'date', date_add(ship, i))"
    return rows.selectExpr("center_id", "name", "state_name", "district_name", "cast(pincode as bigint) as pincode",
                           f"transform(filter(sequence(0, n_sessions), i -> i > 0), i -> {session}) as sessions", "fee_type", "vaccine_fees")


@query("scan_centers", with_ctes("", "select district_name, fee_type, count(*) as centers, cast(sum(n_sessions) as bigint) as sessions from center group by 1, 2", CENTERS_CTE))
def scan_centers(spark, sf_dir):
    path = new_path(spark, "centers-json")
    centers(spark, sf_dir).selectExpr("array(struct(*)) as centers").write.json(path)
    rows = files.read_centers(spark, path)
    return rows.groupBy("district_name", "fee_type").agg(F.count("*").alias("centers"), F.expr("sum(size(sessions)) as sessions"))


@query("scan_geo", """
    select 'geojson' as fmt, c_custkey as id, cast(c_custkey % 300 - 7450 as double) / 100 as lon, cast(c_custkey % 250 + 1750 as double) / 100 as lat, concat('apan/', 'img', c_custkey, '.jpg') as url from customer union all
    select 'kml', c_custkey, cast(c_custkey % 300 - 7450 as double) / 100, cast(c_custkey % 250 + 1750 as double) / 100, concat('img', c_custkey, '.jpg') from customer union all
    select 'osm', c_custkey, cast(c_custkey % 300 - 7450 as double) / 100, cast(c_custkey % 250 + 1750 as double) / 100, null from customer""")
def scan_geo(spark, sf_dir):
    points = Registry(spark, sf_dir).patients().selectExpr("patient_id as id", "lon", "lat", "concat('img', patient_id, '.jpg') as url")
    paths = {fmt: new_path(spark, f"layer-{fmt}") for fmt in ("geojson", "kml", "osm")}
    feature = ("named_struct('type', 'Feature', 'geometry', named_struct('type', 'Point', 'coordinates', array(lon, lat)), "
               "'properties', named_struct('id', id, 'description', '', 'url', url))")
    # lines of one collection each, an indented document and a broken one, in files of one folder
    lines = points.selectExpr("id", "'FeatureCollection' as type", f"array({feature}) as features")
    lines.where("id % 3 > 0").drop("id").write.json(paths["geojson"])
    indented = points.where("id % 3 = 0").selectExpr("pmod(id, 5) as doc", f"{feature} as f").groupBy("doc").agg(F.expr("collect_list(f) as features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"), {"pretty": "true"})
    indented.select(text.alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(paths["geojson"])
    spark.sql("select '{\"type\": \"FeatureCollection\", \"features\": [{\"type\": ' as value").write.mode("append").text(paths["geojson"])
    (points.selectExpr("id", "url as description", "named_struct('coordinates', concat(lon, ',', lat)) as Point")
     .write.format("xml").option("rowTag", "Placemark").option("rootTag", "kml").save(paths["kml"]))
    (points.selectExpr("id as _id", "lon as _lon", "lat as _lat", "'' as v")
     .write.format("xml").option("rowTag", "node").option("rootTag", "osm").save(paths["osm"]))
    out = None
    for fmt, base in (("geojson", "apan/"), ("kml", ""), ("osm", "")):
        layer = files.read_geo(spark, paths[fmt], fmt, base).selectExpr(f"'{fmt}' as fmt", "id", "lon", "lat", "url")
        out = layer if out is None else out.unionByName(layer)
    return out


@query("sink_csv", with_ctes("", "select district_name, count(*) as rows_written, cast(sum(available_capacity) as bigint) as capacity from sess group by 1", CENTERS_CTE))
def sink_csv(spark, sf_dir):
    path = new_path(spark, "sessions-csv")
    sessions = feeds.explode_sessions(centers(spark, sf_dir))
    files.write_csv(sessions, path)
    rows = spark.read.csv(path, header=True, schema=sessions.schema, enforceSchema=False)
    return rows.groupBy("district_name").agg(F.count("*").alias("rows_written"), F.sum("available_capacity").alias("capacity"))


@query("message_log", with_ctes(FULL, f"""
    select org_id, category_request, category_response, cast(year(received_date) as int) as year, count(*) as messages from ({LOG_SQL}) t group by 1, 2, 3, 4""", ALL_F))
def message_log(spark, sf_dir):
    path = new_path(spark, "message-log")
    rows = acceptance.update_categories(validation(spark, sf_dir).report)
    files.append_log(rows.selectExpr("*", "date_format(received_date, 'yyyy_MM') as reported_month"), path, "reported_month")
    return spark.read.parquet(path).groupBy("org_id", "category_request", "category_response", F.expr("year(received_date) as year")).agg(
        F.count("*").alias("messages"))


@query("sink_responses", with_ctes(FULL, """
    select fxm.msg_id, case when n is null then 'AA' else 'AE' end as status, coalesce(n, 0) as err_lines from fxm left join (select msg_id, count(*) as n from all_f group by 1) f on fxm.msg_id = f.msg_id""", ALL_F))
def sink_responses(spark, sf_dir):
    path = new_path(spark, "responses")
    files.write_responses(acceptance.build_ack(validation(spark, sf_dir).report), path, "ack")
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.selectExpr("cast(split_part(split_part(value, '\\r', 1), '|', 10) as bigint) as msg_id",
                           "split_part(split_part(value, '\\r', 2), '|', 2) as status",
                           "cast(size(filter(split(value, '\\r'), l -> startswith(l, 'ERR|'))) as bigint) as err_lines")


# ------------------------------------------------------------------ calendar


@query("cases_dedup", with_ctes("fx_case", "select distinct * from fx_case"))
def cases_dedup(spark, sf_dir):
    return Registry(spark, sf_dir).cases().dropDuplicates()


@query("country_dates", with_ctes("fx_case", "select distinct Date from fx_case where country_region = 'Brazil'"))
def country_dates(spark, sf_dir):
    return feeds.country_dates(Registry(spark, sf_dir).cases(), "Brazil")


@query("date_dim", with_ctes("fx_case", """
    select Date, d as Date_format, y as Year, cast(weekofyear(d) as int) as Week, m as Month, dd as Day, cast(dayofweek(d) + 1 as int) as Week_Day from (
      select Date, lpad(split_part(Date, '/', 1), 2, '0') as m, lpad(split_part(Date, '/', 2), 2, '0') as dd, lpad(split_part(Date, '/', 3), 4, '0') as y, cast(strptime(Date, '%m/%d/%Y') as date) as d
      from (select distinct Date from fx_case where country_region = 'Brazil') t) u"""))
def date_dim(spark, sf_dir):
    return feeds.date_dim(feeds.country_dates(Registry(spark, sf_dir).cases(), "Brazil"))


@query("preview", "select * from (" + ORACLES["date_dim"] + ") t order by Date_format, Date limit 10")
def preview(spark, sf_dir):
    """The first ten days of the calendar."""
    return feeds.preview(date_dim(spark, sf_dir), 10, "Date_format", "Date")


# -------------------------------------------------------------- availability


@query("union_districts", "select s_suppkey as district_id, s_name as district_name, s_nationkey as state_id, n_name as state_name from supplier join nation on s_nationkey = n_nationkey")
def union_districts(spark, sf_dir):
    r = Registry(spark, sf_dir)
    path = new_path(spark, "districts-json")
    rows = r.table("supplier").selectExpr("s_suppkey as district_id", "s_name as district_name", "s_nationkey as state_id")
    rows.hint("rebalance", F.col("state_id")).write.partitionBy("state_id").json(path)
    stacked = spark.read.schema("district_id bigint, district_name string, state_id int").json(path)
    states = r.table("nation").selectExpr("n_nationkey as state_id", "n_name as state_name")
    return feeds.union_districts(stacked, states)


@query("explode_sessions", with_ctes("", f"select {', '.join(feeds.SESSION_COLUMNS)} from sess", CENTERS_CTE))
def explode_sessions(spark, sf_dir):
    return feeds.explode_sessions(centers(spark, sf_dir)).select(*feeds.SESSION_COLUMNS)


@query("availability", with_ctes("", f"select {', '.join(feeds.SESSION_COLUMNS)} from sess where pincode = 834005", CENTERS_CTE))
def availability(spark, sf_dir):
    return feeds.availability(centers(spark, sf_dir), 834005)


@query("capacity_by_area", with_ctes("", """
    select district_name, date, min_age_limit, cast(sum(available_capacity) as bigint) as capacity, count(*) as sessions, cast(grouping(district_name, date, min_age_limit) as int) as level
    from sess group by rollup (district_name, date, min_age_limit)""", CENTERS_CTE))
def capacity_by_area(spark, sf_dir):
    return feeds.capacity_by_area(feeds.explode_sessions(centers(spark, sf_dir)))


# ----------------------------------------------------------------------- map

MX = f"(lon * {feeds.EXTENT} / 180.0)"
MY = f"(ln(tan((90.0 + lat) * pi() / 360.0)) / (pi() / 180.0) * {feeds.EXTENT} / 180.0)"


def _tiles(z):
    span = f"(cast({feeds.MAX_RESOLUTION / 2 ** z!r} as double) * 256)"
    return (f"select {z} as z, cast(floor(({MX} + {feeds.EXTENT}) / {span}) as bigint) as x, cast(floor(({feeds.EXTENT} - {MY}) / {span}) as bigint) as y, "
            "count(*) as points from fx_patient group by 1, 2, 3")


@query("tile_density", with_ctes("fx_patient", " union all ".join(_tiles(z) for z in (6, 9, 12))))
def tile_density(spark, sf_dir):
    return feeds.tile_density(Registry(spark, sf_dir).patients().select("lon", "lat"), [6, 9, 12])


@query("viewbox_filter", with_ctes("fx_patient", """
    select * from (select patient_id, lon * 1.04 as lon, lat * 1.1 as lat from fx_patient) t where lon between -76.24 and -69.2 and lat between 17 and 21"""))
def viewbox_filter(spark, sf_dir):
    points = Registry(spark, sf_dir).patients().selectExpr("patient_id", "lon * 1.04D as lon", "lat * 1.1D as lat")
    return feeds.in_viewbox(points)


@query("imagery_rank", with_ctes("fx_imagery", """
    select layer_id, name, shot_date, metres, row_number() over (order by shot_date desc nulls last, metres asc nulls last, name) as rank from (
      select *, cast(try_strptime(nullif(regexp_extract(date_text, '[0-9]{4}/[0-9]{2}/[0-9]{2}', 0), ''), '%Y/%m/%d') as date) as shot_date,
        try_cast(nullif(regexp_extract(resolution_text, '^[0-9]+([.][0-9]+)?', 0), '') as double) as metres from fx_imagery) t"""))
def imagery_rank(spark, sf_dir):
    return feeds.imagery_rank(Registry(spark, sf_dir).imagery()).select("layer_id", "name", "shot_date", "metres", "rank")


# the list of the map client and two hosts of the test tables
HOST_LIST = " union all ".join(
    f"select '{h}' as host" for h in [*feeds.ALLOWED_HOSTS, "www.cheap-pills.example.com", "blog.ththan.example.net"])


@query("allowed_hosts", f"""
    select page_id, url, split_part(url, '/', 3) as host from pages where (url like 'http://%' or url like 'https://%')
      and split_part(url, '/', 3) in (select host from ({HOST_LIST}) h)""")
def allowed_hosts(spark, sf_dir):
    pages = Registry(spark, sf_dir).table("pages").select("page_id", "url")
    return feeds.allowed_hosts(pages, spark.sql(HOST_LIST))
