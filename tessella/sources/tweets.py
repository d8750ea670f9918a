"""Tweets: lines of JSON; each tweet is an edge from itself to its user. A live feed is read as the files it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWEET_SCHEMA = (
    "id LONG, timestamp_ms STRING, created_at STRING, source STRING, lang STRING, place STRUCT<name: STRING, country: STRING>, "
    "coordinates STRUCT<coordinates: ARRAY<DOUBLE>>, "
    "user STRUCT<id: LONG, name: STRING, screen_name: STRING, location: STRING, followers_count: INT, friends_count: INT, statuses_count: INT>"
)
#: Longitude and latitude from south-west to north-east: Germany and its surroundings.
GERMANY = (5.779, 47.205, 15.161, 55.076)


def read_tweets(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines (column ``value``) of files at a path, or as they arrive there."""
    return (spark.readStream if stream else spark.read).text(path)


def in_box(longitude: Column, latitude: Column, box: tuple[float, float, float, float] = GERMANY) -> Column:
    """Whether a place lies in a bounding box."""
    west, south, east, north = box
    return longitude.between(west, east) & latitude.between(south, north)


def tweets_to_triples(lines: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(tweet)-[createdByUser]->(user) for each line that has a user and a time; empty and unreadable lines are passed over.

    ``box`` keeps tweets with coordinates in it. All vertices have the properties of both kinds, those of the other being absent.
    """
    t = lines.select(F.from_json("value", TWEET_SCHEMA).alias("t")).where(F.col("t.user.id").isNotNull() & F.col("t.timestamp_ms").isNotNull())
    if box is not None:
        t = t.where(in_box(F.col("t.coordinates.coordinates")[0], F.col("t.coordinates.coordinates")[1], box))
    t = t.withColumn("event_time", F.timestamp_millis(F.col("t.timestamp_ms").cast("long")))
    user = {"name": "string", "screen_name": "string", "location": "string", "followers_count": "int", "friends_count": "int", "statuses_count": "int"}
    tweet = {"source": "t.source", "lang": "t.lang", "city": "t.place.name", "country": "t.place.country"}
    absent = lambda kind, name: F.lit(None).cast(kind).alias(name)
    of_tweet = F.struct(*[F.col(c).alias(n) for n, c in tweet.items()], *[absent(k, n) for n, k in user.items()])
    of_user = F.struct(*[absent("string", n) for n in tweet], *[F.col(f"t.user.{n}").alias(n) for n in user])
    vertex = lambda i, label, p: F.struct(F.col(i).cast("string").alias("vertex_id"), F.lit(label).alias("vertex_label"), p.alias("vertex_properties"), "event_time")
    # "Wed Oct 10 20:19:24 +0000 2018"; the weekday says nothing more.
    created = F.try_to_timestamp(F.substring("t.created_at", 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return t.select(
        F.md5(F.concat_ws("-", "t.id", "t.user.id")).alias("id"), "event_time", F.lit("createdByUser").alias("label"), F.struct(created.alias("createdAt")).alias("properties"),
        vertex("t.id", "tweet", of_tweet).alias("source"), vertex("t.user.id", "user", of_user).alias("target"),
    )
