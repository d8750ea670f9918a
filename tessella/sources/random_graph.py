"""Random triples that a seed decides: draws are the first 28 bits of MD5, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _triples(numbered: DataFrame, vertex_labels: int, edge_labels: int, vertex_count: int, seed: int) -> DataFrame:
    """From (n, event_time). Labels are drawn for each occurrence, so one vertex may carry several."""
    bits = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long")
    draw = lambda what, size: F.pmod(bits(F.lit(what), F.col("n")), F.lit(size))
    letter = lambda c, at: F.chr((F.lit(97) + F.pmod(F.floor(bits(c) / 26**at), F.lit(26))).cast("int"))

    def label(what: str, size: int, kind: str) -> Column:
        c = F.concat(F.lit(kind), draw(what, size).cast("string"))
        return F.concat(*[letter(c, at) for at in range(3)])

    def vertex(end: str) -> Column:
        key = F.md5(F.concat_ws("-", F.lit(f"v{seed}"), draw(f"{end}-id", vertex_count).cast("string")))
        properties = F.struct(key.alias("vertex_id_prov"))
        return F.struct(key.alias("vertex_id"), label(f"{end}-label", vertex_labels, "v").alias("vertex_label"), properties.alias("vertex_properties"), "event_time")

    edge = F.md5(F.concat_ws("-", F.lit(f"e{seed}"), F.col("n").cast("string")))
    return numbered.select(
        edge.alias("id"), "event_time", label("edge-label", edge_labels, "e").alias("label"), F.struct(edge.alias("edge_id_prov")).alias("properties"),
        vertex("source").alias("source"), vertex("target").alias("target"),
    )


def random_triples(
    spark: SparkSession, count: int, per_second: int = 1000, start: str = "2024-01-01 00:00:00", vertex_labels: int = 10, edge_labels: int = 10, vertex_count: int = 10_000, seed: int = 42
) -> DataFrame:
    """``count`` triples, ``per_second`` of them in each second from ``start`` on."""
    begin = F.unix_micros(F.to_timestamp(F.lit(start)))
    numbered = spark.range(count).select(F.col("id").alias("n"), F.timestamp_micros(begin + F.floor(F.col("id") * (1_000_000 / per_second)).cast("long")).alias("event_time"))
    return _triples(numbered, vertex_labels, edge_labels, vertex_count, seed)


def random_stream(spark: SparkSession, per_second: int = 1000, vertex_labels: int = 10, edge_labels: int = 10, vertex_count: int = 10_000, seed: int = 42) -> DataFrame:
    """An unbounded stream of triples at a rate, with the time of their making."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return _triples(rate.select(F.col("value").alias("n"), F.col("timestamp").alias("event_time")), vertex_labels, edge_labels, vertex_count, seed)
