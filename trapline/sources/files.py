"""File scans: sensor lines, JSON documents, nested session files, flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.schema import NESTED_EVENT, SENSOR_LINE

FILE_NAME = "_metadata.file_name"


def read_lines(
    spark: SparkSession, path: str | list[str], whole: bool = False, skip_unreadable: bool = False
) -> DataFrame:
    """Text lines (or whole documents) with the file name."""
    return spark.read.option("ignoreCorruptFiles", skip_unreadable).text(path, wholetext=whole).select(
        "value", F.col(FILE_NAME).alias("_source_file"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_place"))


CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def parse_lines(lines: DataFrame, schema: T.StructType = SENSOR_LINE) -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines held in ``value``; returns parsed rows and malformed lines.

    The parse sits behind a generator, so that later filters on parsed fields
    do not repeat it for every field they mention.
    """
    doc = F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": CORRUPT})
    keep = [c for c in lines.columns if c != "value"]
    parsed = lines.select("*", F.explode(F.array(doc)).alias("doc"))
    bad = F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull()
    good = parsed.filter(~bad).select(*keep, F.col("value").alias("raw"), "doc.*").drop(CORRUPT)
    # Blank lines parse to NULL; they are neither parsed nor malformed.
    return good, parsed.filter(bad & (F.length(F.trim("value")) > 0)).select(*keep, "value")


def read_sensor_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sensor files below ``path``, partitioned by ``service``: good and malformed lines."""
    return parse_lines(spark.read.text(path).select("value", "service"))


def read_json_any(
    spark: SparkSession, path: str | list[str], schema: T.StructType, documents: bool = False
) -> DataFrame:
    """JSON records tagged with their file; malformed ones are skipped, and listed by ``broken_json``.

    ``documents=False`` reads one object or array per line and keeps files
    splittable; ``documents=True`` reads each file as one object or array.
    """
    if documents:
        df = (spark.read.schema(schema).option("multiLine", True)
              .option("mode", "DROPMALFORMED").json(path))
        return df.select("*", F.col(FILE_NAME).alias("_source_file"))
    records = read_lines(spark, path).select(
        "_source_file", F.explode(F.from_json("value", T.ArrayType(schema))).alias("doc"))
    return records.filter("doc IS NOT NULL").select("doc.*", "_source_file")


def broken_json(spark: SparkSession, path: str | list[str], schema: T.StructType, documents: bool = False) -> DataFrame:
    """Lines, or whole files, that ``read_json_any`` skips wholly or in part, as they came, with file and reason.

    Blank ones are neither read nor broken.
    """
    records = F.from_json("value", T.ArrayType(schema))
    read = read_lines(spark, path, documents).select("_source_file", "value", F.explode(F.array(F.struct(
        F.try_parse_json("value").isNotNull().alias("json"), records.alias("records")))).alias("doc"))
    lost = F.col("doc.records").isNull() | F.exists("doc.records", lambda r: r.isNull())
    reason = F.when(~F.col("doc.json"), "not JSON").when(lost, "not records")
    return (read.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
            .select("_source_file", "value", reason.alias("reject_reason")).filter("reject_reason IS NOT NULL"))


SESSION_MAP = T.MapType(T.StringType(), T.ArrayType(NESTED_EVENT))
#: The same with every event as its JSON text.
SESSION_TEXTS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def _session_maps(sessions: T.MapType = SESSION_MAP) -> Column:
    """The session maps of the document in ``value``; null or a null entry where it cannot be read."""
    listed = F.from_json("value", T.ArrayType(sessions))
    single = F.array(F.from_json("value", sessions))
    return F.when(F.ltrim("value").startswith("{"), single).otherwise(listed)


def _unlisted(text: Column) -> Column:
    """The fields of an event that have no column, as JSON text of one object; null if there are none."""
    fields = F.map_filter(F.from_json(text, "map<string,variant>"), lambda name, _: ~name.isin(NESTED_EVENT.names))
    return F.when(F.size(fields) > 0, F.to_json(fields))


def read_nested(
    spark: SparkSession,
    path: str | list[str],
    whole: bool = False,
    max_events: int | None = None,
    skip_unreadable: bool = False,
    rest: bool = True,
) -> DataFrame:
    """Nested session files: lists or maps of session id to events.

    ``whole=True`` reads one document per file; otherwise each line holds one.
    ``max_events`` keeps the first ones by file path, line and position.
    ``rest`` holds the fields of an event that have no column, as JSON text with their own types; ``rest=False``
    leaves it out and parses each document once only. Documents that cannot be read give no events;
    ``broken_nested`` lists them.
    """
    docs = read_lines(spark, path, whole, skip_unreadable)
    place = ["_source_file", "_place"]
    if rest:
        # Maps and lists of both readings go side by side; events are those of the first.
        entries = docs.select(*place, _session_maps(SESSION_TEXTS).alias("texts"), F.posexplode(_session_maps()).alias("entry_pos", "entry")).select(
            *place, "entry_pos", F.map_entries(F.get("texts", F.col("entry_pos"))).alias("texts"),
            F.posexplode(F.map_entries("entry")).alias("at", "session"))
        events = entries.select(
            *place, "entry_pos", F.col("session.key").alias("entry_session"), F.get("texts", F.col("at"))["value"].alias("texts"),
            F.posexplode("session.value").alias("event_pos", "e"))
        events = events.withColumn("text", F.get("texts", F.col("event_pos")))
    else:
        entries = docs.select(*place, F.posexplode(_session_maps()).alias("entry_pos", "entry"))
        events = (entries.select(*place, "entry_pos", F.explode("entry").alias("entry_session", "events"))
                  .select(*place, "entry_pos", "entry_session", F.posexplode("events").alias("event_pos", "e")))
    # Position within the document: entry first, then event.
    order = F.shiftleft(F.col("entry_pos").cast("long"), 32) + F.col("event_pos")
    geo = F.col("e.geolocation_data")
    flat = events.select(
        *[F.col(f"e.{f.name}") for f in NESTED_EVENT.fields
          if f.name not in ("geolocation_data", "session_id")],
        F.coalesce("e.session_id", "entry_session").alias("session_id"),
        geo["country_name"].alias("geo_country"), geo["city_name"].alias("geo_city"),
        geo["region_name"].alias("geo_region"), geo["latitude"].alias("geo_latitude"),
        geo["longitude"].alias("geo_longitude"), geo["timezone"].alias("geo_timezone"),
        geo["location"]["lat"].alias("geo_loc_lat"), geo["location"]["lon"].alias("geo_loc_lon"),
        *([_unlisted(F.col("text")).alias("rest")] if rest else []),
        "_source_file", F.lit("cowrie").alias("source"), order.alias("ord"), "_place")
    first = flat if max_events is None else flat.orderBy("_place", "ord").limit(max_events)
    return first.drop("_place")


def broken_nested(
    spark: SparkSession, path: str | list[str], whole: bool = False, skip_unreadable: bool = False
) -> DataFrame:
    """Documents that ``read_nested`` cannot read wholly, as they came, with file and reason.

    Blank documents are neither read nor broken.
    """
    docs = read_lines(spark, path, whole, skip_unreadable).select("_source_file", "value", F.explode(F.array(
        F.struct(_session_maps().alias("maps")))).alias("doc"))
    maps = F.col("doc.maps")
    lost = F.exists(maps, lambda m: m.isNull() | F.exists(F.map_values(m), lambda events: events.isNull()))
    reason = (F.when(F.try_parse_json("value").isNull(), "not JSON")
              .when(maps.isNull() | lost, "not sessions with lists of events"))
    return (docs.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
            .select("_source_file", "value", reason.alias("reject_reason")).filter("reject_reason IS NOT NULL"))


def read_datasets(
    spark: SparkSession, folder: str, whole: bool = False, pattern: str = "*.json"
) -> DataFrame:
    """Every matching file of a folder, tagged with its file stem.

    Unreadable files are skipped; a folder without any raises at analysis.
    """
    return read_nested(spark, f"{folder}/{pattern}", whole, skip_unreadable=True).withColumn(
        "dataset", F.regexp_replace("_source_file", r"\.[a-z]+$", ""))


def with_source(events: DataFrame, name: str) -> DataFrame:
    """Tag a second source before it is united with others."""
    return events.withColumn("source", F.lit(name))


def unite(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_flow_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    underscores: bool = False,
) -> DataFrame:
    """Flow tables with a header; trimmed names and a file tag.

    Values stay text until the operators cast them leniently.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    names = [c.strip() for c in df.columns]
    if underscores:
        names = [c.replace(" ", "_") for c in names]
    file_tag = df.select("*", F.col(FILE_NAME).alias("_source_file"))
    return file_tag.toDF(*names, "_source_file")


def reduced(lines: DataFrame) -> DataFrame:
    """Timestamp, source and type only; an absent key reads ``unknown``.

    ``lines`` has one JSON text per row in ``value``. A key that is present
    with a null value stays NULL.
    """
    doc = F.from_json("value", "map<string,string>")

    def field(name: str):
        return F.when(F.map_contains_key(doc, name), F.element_at(doc, F.lit(name))).otherwise("unknown")

    return lines.filter(doc.isNotNull()).select(
        F.element_at(doc, F.lit("timestamp")).alias("timestamp"),
        field("src_ip").alias("source_ip"), field("eventid").alias("event_type"))
