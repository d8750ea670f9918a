"""Bike trips: 15 text columns with a header; each trip is an edge between its stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIP_COLUMNS = (
    "tripduration", "starttime", "stoptime", "start_station_id", "start_station_name", "start_station_latitude",
    "start_station_longitude", "end_station_id", "end_station_name", "end_station_latitude", "end_station_longitude",
    "bikeid", "usertype", "birth_year", "gender",
)
TRIP_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRIP_COLUMNS])


def read_trips(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Trip files at a path, or as they arrive there; no schema is inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(TRIP_SCHEMA).option("header", True).csv(path)


def _present(c: str) -> Column:
    """Text, or null where the file says NULL in any case."""
    return F.when(F.upper(F.trim(c)) != "NULL", F.col(c))


def trips_to_triples(trips: DataFrame) -> DataFrame:
    """One triple for each trip with a readable stop time, which is its event time (24-hour clock, session zone).

    Stations are vertices ``Station`` {name, lat, long}; the edge ``trip`` has the MD5 of bike, start and stop as its id. "NULL" or
    unreadable numbers are absent properties.
    """
    stop = F.try_to_timestamp(F.replace(F.col("stoptime"), F.lit('"'), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    timed = trips.withColumn("event_time", stop).where(F.col("event_time").isNotNull())

    def station(end: str) -> Column:
        number = lambda c: _present(f"{end}_station_{c}").try_cast("double")
        properties = F.struct(F.col(f"{end}_station_name").alias("name"), number("latitude").alias("lat"), number("longitude").alias("long"))
        return F.struct(F.col(f"{end}_station_id").alias("vertex_id"), F.lit("Station").alias("vertex_label"), properties.alias("vertex_properties"), "event_time")

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    properties = F.struct(
        _present("tripduration").try_cast("int").alias("tripduration"), "starttime", "stoptime",
        _present("birth_year").try_cast("int").alias("birth year"), _present("gender").try_cast("int").alias("gender"), "usertype", F.col("bikeid").alias("bikeId"),
    )
    return timed.select(
        F.md5(F.concat(text("bikeid"), text("starttime"), text("stoptime"))).alias("id"), "event_time", F.lit("trip").alias("label"), properties.alias("properties"),
        station("start").alias("source"), station("end").alias("target"),
    )
