"""Triples from rows at hand."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def triples_schema(vertex_properties: T.DataType | str, edge_properties: T.DataType | str) -> T.StructType:
    """Schema of triples whose elements have the given properties (a struct or a map; DDL text is taken too)."""
    v, e = (x if isinstance(x, T.DataType) else T._parse_datatype_string(x) for x in (vertex_properties, edge_properties))
    s, time = T.StringType(), T.TimestampType()
    vertex = T.StructType([T.StructField("vertex_id", s), T.StructField("vertex_label", s), T.StructField("vertex_properties", v), T.StructField("event_time", time)])
    fields = [("id", s), ("event_time", time), ("label", s), ("properties", e), ("source", vertex), ("target", vertex)]
    return T.StructType([T.StructField(n, k) for n, k in fields])


def triples_from_rows(spark: SparkSession, rows: Iterable[tuple], vertex_properties: T.DataType | str, edge_properties: T.DataType | str) -> DataFrame:
    """Rows (id, time, label, properties, source, target); ends are (id, label, properties, time)."""
    return spark.createDataFrame(list(rows), triples_schema(vertex_properties, edge_properties))
