"""Identifiers of super elements and printable forms of graph elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def time_text(time: Column) -> Column:
    return F.date_format(time, TIME_FORMAT)


def element_id(parts: list[Column], scheme: str = "escaped") -> Column:
    """SHA-1 of the parts joined by dots.

    ``escaped`` tells every list of parts from every other: dots and percent signs are escaped and null has a sign of its own.
    ``plain`` skips nulls and escapes nothing, so (a, null, b) and (null, a, b) meet.
    """
    texts = [p.cast("string") for p in parts]
    if scheme == "escaped":
        texts = [F.coalesce(F.replace(F.replace(t, F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E")), F.lit("%00")) for t in texts]
    elif scheme != "plain":
        raise ValueError(f"id scheme must be escaped or plain, not {scheme!r}")
    return F.sha1(F.concat_ws(".", *texts))


def property_of(properties: Column, kind: T.DataType, key: str, cast: str | None = None) -> Column:
    """One property; null where it is absent. Properties are a struct, or a map whose values are cast to a declared type."""
    if isinstance(kind, T.StructType):
        value = properties.getField(key) if key in kind.names else F.lit(None).cast(cast or "string")
    elif isinstance(kind, T.MapType):
        value = properties[F.lit(key)]
    else:
        raise TypeError(f"properties must be a struct or a map, not {kind.simpleString()}")
    return value.cast(cast) if cast else value


def _properties_text(properties: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat_ws("=", e["key"].cast("string"), F.coalesce(e["value"].cast("string"), F.lit("NULL"))))
    else:
        pairs = F.array(*[F.concat(F.lit(f"{n}="), F.coalesce(properties.getField(n).cast("string"), F.lit("NULL"))) for n in kind.names]).cast("array<string>")
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def vertex_text(v: Column, kind: T.StructType) -> Column:
    """(id(t:time):label{key=value,...})"""
    properties = _properties_text(v["vertex_properties"], kind["vertex_properties"].dataType)
    return F.concat(F.lit("("), v["vertex_id"], F.lit("(t:"), time_text(v["event_time"]), F.lit("):"), v["vertex_label"], properties, F.lit(")"))


def edge_text(e: Column, kind: T.StructType, source: Column | None = None, target: Column | None = None) -> Column:
    """(source)-[t:time id:label{...}]->(target); ends are ids, or whole vertices where given."""
    ends = [x if x is not None else F.concat(F.lit("("), e[c], F.lit(")")) for x, c in ((source, "source_id"), (target, "target_id"))]
    properties = _properties_text(e["edge_properties"], kind["edge_properties"].dataType)
    return F.concat(ends[0], F.lit("-[t:"), time_text(e["event_time"]), F.lit(" "), e["edge_id"], F.lit(":"), e["edge_label"], properties, F.lit("]->"), ends[1])


def equal_without_id(a: Column, b: Column, element: str) -> Column:
    """Whether two vertices or edges (``element``) agree in label, properties and time, whatever their ids."""
    if element not in ("vertex", "edge"):
        raise ValueError("element must be vertex or edge")
    same = [a[c].eqNullSafe(b[c]) for c in (f"{element}_label", f"{element}_properties", "event_time")]
    return same[0] & same[1] & same[2]
