"""Case calendar, appointment availability and map points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stage

# ------------------------------------------------------------------ calendar


def country_dates(cases: DataFrame, country: str, view: str = "global_data") -> DataFrame:
    """Distinct date texts of one country; the rows are also registered as a view."""
    cases.dropDuplicates().createOrReplaceTempView(view)
    return cases.sparkSession.sql(f"select distinct Date from {view} where country_region = :country", args={"country": country})


def date_dim(dates: DataFrame) -> DataFrame:
    """M/D/Y text -> calendar columns (ISO week, weekday 1 = Sunday)."""
    parts = dates.selectExpr("Date", "split(Date, '/') as p")
    rows = parts.selectExpr("Date", "lpad(get(p, 0), 2, '0') as Month", "lpad(get(p, 1), 2, '0') as Day", "lpad(get(p, 2), 4, '0') as Year")
    rows = rows.selectExpr("*", "cast(try_to_timestamp(concat_ws('-', Month, Day, Year), 'MM-dd-yyyy') as date) as Date_format")
    return rows.selectExpr("Date", "Date_format", "Year", "weekofyear(Date_format) as Week", "Month", "Day", "dayofweek(Date_format) as Week_Day")


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return df.orderBy(*order).limit(n)


# -------------------------------------------------------------- availability

CENTER_COLUMNS = ["name", "state_name", "district_name", "pincode", "sessions", "fee_type", "vaccine_fees"]
SESSION_COLUMNS = ["date", "available_capacity", "min_age_limit", "name", "state_name", "district_name", "pincode", "fee_type", "vaccine_fees"]


def union_districts(districts: DataFrame, states: DataFrame) -> DataFrame:
    """District rows of all states with the state's name, ordered by district."""
    return districts.join(states.select("state_id", "state_name"), "state_id").orderBy("district_name")


def explode_sessions(centers: DataFrame) -> DataFrame:
    """One row per session; a center without sessions keeps one row."""
    return (centers.select(*CENTER_COLUMNS).selectExpr(*[c for c in CENTER_COLUMNS if c != "sessions"], "explode_outer(sessions) as s")
            .selectExpr("s.date as date", "s.available_capacity as available_capacity", "s.min_age_limit as min_age_limit",
                        *[c for c in CENTER_COLUMNS if c != "sessions"]))


def availability(centers: DataFrame, pincode: int) -> DataFrame:
    """Sessions of one pin code."""
    return explode_sessions(centers).where(F.col("pincode") == pincode).select(*SESSION_COLUMNS)


def capacity_by_area(sessions: DataFrame) -> DataFrame:
    """Capacity by district, date and age limit, with subtotals."""
    return (sessions.rollup("district_name", "date", "min_age_limit")
            .agg(F.expr("cast(sum(available_capacity) as bigint) as capacity"), F.count("*").alias("sessions"),
                 F.expr("cast(grouping_id() as int) as level")))


# ----------------------------------------------------------------------- map

EXTENT = 20037508.34       # Fixed values: half width of the map in metres,
MAX_RESOLUTION = 156543.0339  # metres per pixel at zoom 0,
TILE = 256                 # pixels per tile,
VIEWBOX = (-76.24, 17.0, -69.2, 21.0)  # lon/lat box of the map.


def to_mercator(lon: str, lat: str) -> tuple[str, str]:
    """Web-mercator metres of a lon/lat pair, as expressions."""
    return (f"({lon} * {EXTENT} / 180.0)",
            f"(ln(tan((90.0 + {lat}) * pi() / 360.0)) / (pi() / 180.0) * {EXTENT} / 180.0)")


def tile_index(points: DataFrame, zoom: int) -> DataFrame:
    """Adds (x, y) of the tile at ``zoom``; points above or below the map are dropped, x wraps around."""
    mx, my = to_mercator("lon", "lat")
    span = f"({MAX_RESOLUTION / 2 ** zoom!r}D * {TILE})"
    return (points.selectExpr("*", f"cast(floor(({mx} + {EXTENT}) / {span}) as bigint) as tx",
                              f"cast(floor(({EXTENT} - {my}) / {span}) as bigint) as y")
            .where(f"y >= 0 and y < {2 ** zoom}")
            .selectExpr(*points.columns, f"pmod(tx, {2 ** zoom}) as x", "y"))


def tile_density(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Points per tile and zoom.

    The points are counted once, at the finest zoom; coarser tiles add up finer
    ones, since a tile covers four tiles of the next zoom.
    """
    top = max(zooms)
    finest = tile_index(points, top).groupBy("x", "y").agg(F.count("*").alias("n"))
    levels = ", ".join(str(top - z) for z in zooms)
    return (finest.selectExpr("x", "y", "n", f"explode(array({levels})) as up")
            .selectExpr(f"cast({top} - up as int) as z", "shiftright(x, up) as x", "shiftright(y, up) as y", "n")
            .groupBy("z", "x", "y").agg(F.sum("n").alias("points")))


def in_viewbox(points: DataFrame, box: tuple[float, float, float, float] = VIEWBOX) -> DataFrame:
    west, south, east, north = box
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def imagery_catalogue(layers: DataFrame) -> DataFrame:
    """Adds the first date and the metres per pixel of the catalogue texts (NULL when unknown)."""
    return layers.selectExpr(
        "*", "cast(try_to_timestamp(nullif(regexp_extract(date_text, '[0-9]{4}/[0-9]{2}/[0-9]{2}', 0), ''), 'yyyy/MM/dd') as date) as shot_date",
        "try_cast(nullif(regexp_extract(resolution_text, '^[0-9]+([.][0-9]+)?', 0), '') as double) as metres")


def imagery_rank(layers: DataFrame) -> DataFrame:
    """All layers with their rank, newest first, then finest.

    The layers are dealt out by ranges of the order; a rank is the place in the part
    plus the rows of the parts before it, so no task sees more than its part.
    """
    dealt = imagery_catalogue(layers).repartitionByRange(
        F.col("shot_date").desc_nulls_last(), F.col("metres").asc_nulls_last(), F.col("name"))
    rows = stage(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    before = rows.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part", "sum(n) over (order by part) - n as before")
    place = "row_number() over (partition by part order by shot_date desc nulls last, metres asc nulls last, name)"
    return (rows.selectExpr("*", f"{place} as place").join(before, "part")
            .selectExpr(*[c for c in rows.columns if c != "part"], "before + place as rank"))


# Hosts a map client may load from.
ALLOWED_HOSTS = [
    "www.openlayers.org", "openlayers.org", "labs.metacarta.com", "world.freemap.in", "prototype.openmnnd.org",
    "geo.openplans.org", "sigma.openplans.org", "demo.opengeo.org", "www.openstreetmap.org", "sample.avencia.com",
    "v-swe.uni-muenster.de:8080", "local.yahooapis.com", "ispatial.t-sciences.com", "haiti.sahanafoundation.org",
    "haiti.ushahidi.com", "ose.petschge.de", "openstreetbugs.appspot.com", "www.sharedgeo.org", "hurakan.ucsd.edu",
    "www.google.com", "hurakan.telascience.org", "cmapdemo.labs.metacarta.com",
]


def allowed_hosts(urls: DataFrame, hosts: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL is http(s) and whose host (with port) is in ``hosts``."""
    rows = urls.where(f"{column} rlike '^https?://'").selectExpr("*", f"get(split({column}, '/'), 2) as host")
    return rows.join(hosts.select("host").distinct(), "host", "left_semi")
