"""Scans and sinks: CSV, JSON, gzip CSV, HL7 text, GeoJSON, KML, OSM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "country_region string, Date string, cases double"
CENTER_SCHEMA = ("centers array<struct<center_id: bigint, name: string, state_name: string, district_name: string, pincode: bigint, "
                 "sessions: array<struct<min_age_limit: int, available_capacity: int, date: date>>, fee_type: string, vaccine_fees: string>>")
GEOJSON_SCHEMA = ("type string, features array<struct<type: string, geometry: struct<type: string, coordinates: array<double>>, "
                  "properties: struct<id: bigint, description: string, url: string>>>")


def read_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Header CSV with a given schema, so the files are read once."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


#: Envelope segments around the messages of a batch file.
ENVELOPE = r"(?:^|(?<=[\r\n]))(?:FHS|BHS|BTS|FTS)\|[^\r\n]*[\r\n]*"


def read_messages(spark: SparkSession, path: str, framing: str = "file", ending: str = "\r") -> DataFrame:
    """(source, message) of raw messages, and the partition columns of the path.

    * ``file``: one message per file.
    * ``msh``: batch files with any number of messages, each from its MSH segment to the next.  The files are cut
      wherever Spark splits them; ``ending`` is the character before MSH that a split can start at.  Files whose segments
      end in another way give the same messages, but are read in one piece.
    * ``mllp``: batch files of framed messages (0x0B ... 0x1C 0x0D), whatever they hold.

    File and batch envelopes (FHS, BHS, BTS, FTS) are left out, and a text without any MSH stays one message.
    """
    if framing == "file":
        return spark.read.text(path, wholetext=True).selectExpr("*", "_metadata.file_name as source").withColumnRenamed("value", "message")
    if framing not in ("msh", "mllp"):
        raise ValueError(f"unknown framing {framing}")
    rows = spark.read.option("lineSep", f"{ending}MSH|" if framing == "msh" else "\x1c\r").text(path)
    kept = [c for c in rows.columns if c != "value"]
    rows = rows.select(*kept, F.col("_metadata.file_name").alias("source"), "value")
    if framing == "msh":
        # the separator took the segment's name; only what starts a file still has its own
        headless = F.col("value").rlike(r"^[^A-Za-z0-9\s]{2,5}\|")
        whole = F.when(headless, F.concat(F.lit("MSH|"), "value")).otherwise(F.col("value"))
        rows = rows.select(*kept, "source", F.explode(F.split(whole, r"[\r\n]+(?=MSH\|)")).alias("value"))
    text = F.btrim(F.regexp_replace("value", ENVELOPE, ""), F.lit("\r\n\x0b\x1c"))
    return rows.select(*kept, "source", text.alias("message")).where("message <> ''")


def write_messages(df: DataFrame, path: str, framing: str, *by: str, column: str = "message") -> None:
    """Batch files that :func:`read_messages` reads, one folder per value of ``by``."""
    text = F.col(column) if framing == "msh" else F.concat(F.lit("\x0b"), column)
    end = "\r" if framing == "msh" else "\x1c\r"
    df.select(*by, text.alias("value")).write.partitionBy(*by).option("lineSep", end).text(path)


CODE_SCHEMA = "codeset string, value string, label string, status string, new_value string, valid_from date, valid_to date"
RELATION_SCHEMA = "from_set string, from_value string, to_cvx string"


def read_codes(spark: SparkSession, path: str, fmt: str = "csv", schema: str = CODE_SCHEMA) -> DataFrame:
    """Code table (or, with RELATION_SCHEMA, code relations) from files; an empty validity date is open.

    The table carries no broadcast hint: Spark knows the size of the files and broadcasts what is small.
    """
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return spark.read.format(fmt).schema(schema).load(path)


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """JSON answers with a list under ``centers``: one row per center."""
    return spark.read.schema(CENTER_SCHEMA).json(path).selectExpr("explode(centers) as c").selectExpr("c.*")


def read_geo(spark: SparkSession, path: str, fmt: str, base: str = "") -> DataFrame:
    """Point features as (id, lon, lat, url); ``url`` is the layer base and the attribute."""
    if fmt == "geojson":
        rows = read_collections(spark, path)[0].selectExpr("explode(features) as f").where("f.geometry.type = 'Point'")
        return rows.selectExpr("f.properties.id as id", "f.geometry.coordinates[0] as lon", "f.geometry.coordinates[1] as lat",
                               f"concat(coalesce('{base}', ''), f.properties.url) as url")
    if fmt == "kml":
        rows = spark.read.format("xml").option("rowTag", "Placemark").schema(
            "id bigint, description string, Point struct<coordinates: string>").load(path)
        return rows.selectExpr("id", "cast(split(Point.coordinates, ',')[0] as double) as lon",
                               "cast(split(Point.coordinates, ',')[1] as double) as lat", f"concat('{base}', description) as url")
    if fmt == "osm":
        rows = spark.read.format("xml").option("rowTag", "node").schema("_id bigint, _lon double, _lat double").load(path)
        return rows.selectExpr("_id as id", "_lon as lon", "_lat as lat", "cast(null as string) as url")
    raise ValueError(f"unknown layer format {fmt}")


def read_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(collections, unreadable) of GeoJSON files.

    A file with a collection on a line is read line by line, in as many splits as it has; its other lines are
    unreadable.  A file without one is read as one document, as an indented file must be; unreadable if that fails or
    if more than one begins in it.  ``unreadable`` has (file, line, reason), with the first 200 characters of the line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    parsed = lines.select("file", "value", F.from_json("value", GEOJSON_SCHEMA).alias("c"), F.expr("rtrim(value) like '%}'").alias("closed"))
    good = "coalesce(c.type = 'FeatureCollection' and c.features is not null and closed, false)"
    by_line = parsed.selectExpr("file", "value", "c", f"{good} as good")
    per_file = by_line.groupBy("file").agg(F.bool_or("good").alias("any"), F.count_if(F.col("value").rlike('"type"\\s*:\\s*"FeatureCollection"')).alias("begun"), F.min("value").alias("value"))
    others = per_file.where("not any").select("file", "begun").collect()  # names of files
    documents = [r.file for r in others if r.begun <= 1]
    single = by_line.where(~F.col("file").isin([r.file for r in others])) if others else by_line
    collections = single.where("good").selectExpr("file", "c.type as type", "c.features as features")
    unreadable = single.where("not good").selectExpr("file", "left(value, 200) as line", "'no collection' as reason").unionByName(
        per_file.where("not any and begun > 1").selectExpr("file", "left(value, 200) as line", "'several documents' as reason"))
    if documents:
        whole = (spark.read.schema(GEOJSON_SCHEMA + ", _corrupt_record string").option("multiLine", "true").json(documents)
                 .select(F.col("_metadata.file_path").alias("file"), "*"))
        read = "coalesce(type = 'FeatureCollection' and features is not null and _corrupt_record is null, false)"
        collections = collections.unionByName(whole.where(read).select("file", "type", "features"))
        unreadable = unreadable.unionByName(whole.where(f"not {read}").selectExpr(
            "file", "left(_corrupt_record, 200) as line", "case when _corrupt_record is null then 'no collection' else 'no document' end as reason"))
    return collections, unreadable


def sources_of(df: DataFrame) -> list[str]:
    """Datasets a frame reads: a single file, or the folder of its part files."""
    return sorted({f.rsplit("/", 1)[0] if f.rsplit("/", 1)[1].startswith("part-") else f for f in df.inputFiles()})


def land_json(spark: SparkSession, source: str, target: str, schema: str) -> DataFrame:
    """Copies the only JSON dataset under a prefix to a stable name, replacing it."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(source)
    found = sources_of(rows)
    if len(found) != 1:
        raise ValueError(f"expected one dataset under {source}, found {len(found)}")
    rows.write.mode("overwrite").json(target)
    return spark.read.schema(schema).json(target)


def land_csv_gz(spark: SparkSession, source: str, target: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Gzip CSV to parquet; a gzip file is one split, so its rows are spread before the write."""
    rows = spark.read.csv(source, header=True, schema=schema).hint("rebalance")
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files under a path (no contents are read)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def source_gate(manifest: DataFrame, present: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Manifest entries with their presence; with ``strict`` a missing one fails the run."""
    found = present.select(key).distinct().selectExpr(key, "true as __found")
    checked = manifest.join(found, key, "left").selectExpr(*manifest.columns, "__found is not null as present")
    if strict:
        missing = checked.where("not present").select(key).take(5)
        if missing:
            raise FileNotFoundError("missing sources: " + ", ".join(str(r[0]) for r in missing))
    return checked


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str, day: str = "reported_day") -> None:
    """Appends log rows, partitioned by ``day``; a day with very many rows is spread over several files."""
    df.hint("rebalance", F.col(day)).write.mode("append").partitionBy(day).parquet(path)


def write_responses(df: DataFrame, path: str, column: str = "response") -> None:
    """One response per line; segments inside a response end with CR."""
    df.select(column).write.mode("overwrite").text(path)
