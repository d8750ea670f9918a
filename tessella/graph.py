"""The property graph: two tables, bounded or unbounded, and what can be done with them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import GraphConfig, WindowSpec
from .functions.aggregates import Aggregate
from .functions.ids import edge_text, vertex_text

VERTEX = ("vertex_id", "vertex_label", "vertex_properties", "event_time")
EDGE = ("edge_id", "edge_label", "edge_properties", "source_id", "target_id", "event_time")
TRIPLE = ("id", "event_time", "label", "properties", "source", "target")


def _table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    # Watermarks exist on TIMESTAMP only; times without zone are taken in the session's zone.
    time = F.col("event_time").cast("timestamp").alias("event_time") if dict(df.dtypes)["event_time"] != "timestamp" else F.col("event_time")
    return df.select(*[time if c == "event_time" else F.col(c) for c in columns])


@dataclass(frozen=True, eq=False)
class PropertyGraph:
    """``vertices`` (vertex_id, vertex_label, vertex_properties, event_time) and ``edges`` (edge_id, edge_label, edge_properties,
    source_id, target_id, event_time). Properties are a struct, an absent one being null, or a map. Both tables are plain
    DataFrames, for any further query."""

    vertices: DataFrame
    edges: DataFrame
    config: GraphConfig = field(default_factory=GraphConfig)
    source_triples: DataFrame | None = None
    watermarked: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "vertices", _table(self.vertices, VERTEX))
        object.__setattr__(self, "edges", _table(self.edges, EDGE))

    @classmethod
    def from_triples(cls, triples: DataFrame, config: GraphConfig | None = None) -> PropertyGraph:
        """From (id, event_time, label, properties, source, target); ends are structs of a vertex's columns. One pass makes both ends' vertices."""
        triples = _table(triples, TRIPLE)
        edges = triples.select(
            F.col("id").alias("edge_id"), F.col("label").alias("edge_label"), F.col("properties").alias("edge_properties"),
            F.col("source.vertex_id").alias("source_id"), F.col("target.vertex_id").alias("target_id"), "event_time",
        )
        vertices = triples.select(F.explode(F.array("source", "target")).alias("v")).select(*[F.col(f"v.{c}").alias(c) for c in VERTEX])
        return cls(vertices, edges, config or GraphConfig(), triples)

    @property
    def streaming(self) -> bool:
        return self.vertices.isStreaming or self.edges.isStreaming

    def apply(self, operator) -> PropertyGraph:
        """Run a graph operator; the result is a graph again."""
        return operator.execute(self)

    def group_by(
        self,
        vertex_keys: Iterable[str],
        vertex_aggregates: Iterable[Aggregate] = (),
        edge_keys: Iterable[str] = (),
        edge_aggregates: Iterable[Aggregate] = (),
        window: WindowSpec | None = None,
        **options,
    ) -> PropertyGraph:
        """Group by keys of vertices and edges in tumbling windows, 10 seconds unless given; ``options`` are those of ``GroupingSpec``."""
        from .operators.grouping import GraphGrouping
        from .plans.spec import GroupingSpec

        if vertex_keys is None:
            raise ValueError("vertex_keys must be given")
        return self.apply(GraphGrouping(GroupingSpec(tuple(vertex_keys), tuple(vertex_aggregates), tuple(edge_keys or ()), tuple(edge_aggregates or ()), window or WindowSpec(), **options)))

    def triples(self) -> DataFrame:
        """Edges with both their vertices of the same time; edges without them have no triple."""
        columns = [F.col("edge_id").alias("id"), "event_time", F.col("edge_label").alias("label"), F.col("edge_properties").alias("properties"), "source", "target"]
        side = self.vertices.select(F.col("vertex_id").alias("__v"), F.col("event_time").alias("__vt"), F.struct(*[F.col(c) for c in VERTEX]).alias("__end"))
        met = (F.col("__id") == F.col("__v")) & (F.col("event_time") == F.col("__vt"))
        if self.streaming:
            # One join for both ends: what one join of a stream hands to a second in the same batch would be late there.
            ends = self.edges.select("*", F.posexplode(F.array("source_id", "target_id")).alias("__at", "__id")).join(side, met)
            end = lambda at, name: F.first(F.when(F.col("__at") == at, F.col("__end")), ignorenulls=True).alias(name)
            both = ends.groupBy("event_time", *[c for c in EDGE if c != "event_time"]).agg(end(0, "source"), end(1, "target"))
            return both.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(*columns)
        out = self.edges
        for end in ("source", "target"):
            out = out.withColumn("__id", F.col(f"{end}_id")).join(side, met).withColumnRenamed("__end", end).drop("__id", "__v", "__vt")
        return out.select(*columns)

    # Printable lines, one for each element.

    def vertex_lines(self) -> DataFrame:
        whole = self.vertices.select(F.struct(*VERTEX).alias("v"))
        return whole.select(vertex_text(F.col("v"), whole.schema["v"].dataType).alias("value"))

    def edge_lines(self) -> DataFrame:
        whole = self.edges.select(F.struct(*EDGE).alias("e"))
        return whole.select(edge_text(F.col("e"), whole.schema["e"].dataType).alias("value"))

    def triple_lines(self) -> DataFrame:
        whole = self.triples().withColumnsRenamed({"id": "edge_id", "label": "edge_label", "properties": "edge_properties"})
        whole = whole.select(F.struct("edge_id", "edge_label", "edge_properties", "event_time").alias("e"), "source", "target")
        ends = [vertex_text(F.col(c), whole.schema[c].dataType) for c in ("source", "target")]
        return whole.select(edge_text(F.col("e"), whole.schema["e"].dataType, *ends).alias("value"))

    # Sinks. Bounded graphs are printed or written at once; for unbounded ones each returns the started query.

    def print(self, rows: int = 1000, **stream):
        from .streaming.sinks import print_lines

        return print_lines(self.triple_lines(), rows, **stream)

    def print_vertices(self, rows: int = 1000, **stream):
        from .streaming.sinks import print_lines

        return print_lines(self.vertex_lines(), rows, **stream)

    def print_edges(self, rows: int = 1000, **stream):
        from .streaming.sinks import print_lines

        return print_lines(self.edge_lines(), rows, **stream)

    def write_as_csv(self, path: str, checkpoint: str | None = None, **stream):
        """Printable lines of vertices to ``path``_V and of edges to ``path``_E."""
        from .streaming.sinks import write_lines

        return [write_lines(lines, f"{path}_{x}", checkpoint and f"{checkpoint}/{x}", **stream) for x, lines in (("V", self.vertex_lines()), ("E", self.edge_lines()))]
