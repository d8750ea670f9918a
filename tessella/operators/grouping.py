"""Windowed grouping of a property graph: one composition of DataFrame operations for bounded and unbounded input.

A super vertex's id is a function of a vertex row's own keys and window, so mapping vertices to super vertices needs no
join; edges meet the mapping by (vertex, window) twice. Internal columns begin with ``__``: ``__t`` is the window as its
last microsecond, which keeps the watermark of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import element_id, property_of, time_text
from ..graph import PropertyGraph
from ..plans.spec import GroupingSpec
from ..storage import written


class GraphGrouping:
    def __init__(self, spec: GroupingSpec):
        self.spec = spec

    # The steps, each usable alone.

    def _windowed(self, df: DataFrame, graph: PropertyGraph, columns: list[str], distinct: bool = True) -> DataFrame:
        size = self.spec.window.interval
        if not df.isStreaming:
            out = df.select(*columns, F.window_time(F.window("event_time", size)).alias("__t"))
            # Grouping, unlike distinct(), takes maps.
            return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("__n")).drop("__n") if distinct else out
        if not graph.watermarked:
            df = df.withWatermark("event_time", graph.config.watermark_delay)
        out = df.groupBy(F.window("event_time", size).alias("__w"), *columns).agg(F.count(F.lit(1)).alias("__n"))
        return out.select(*columns, F.window_time("__w").alias("__t"))

    def dedup_vertices(self, graph: PropertyGraph) -> DataFrame:
        """Distinct vertices (id, label, properties) of each window."""
        return self._windowed(graph.vertices, graph, ["vertex_id", "vertex_label", "vertex_properties"])

    def dedup_edges(self, graph: PropertyGraph) -> DataFrame:
        """Distinct edges of each window; all edges where the caller promises that none repeats."""
        columns = ["edge_id", "edge_label", "edge_properties", "source_id", "target_id"]
        return self._windowed(graph.edges, graph, columns, distinct=not self.spec.unique_edges)

    def _prepared(self, df: DataFrame, what: str, keep: list[str]) -> DataFrame:
        spec, properties, kind = self.spec, F.col(f"{what}_properties"), df.schema[f"{what}_properties"].dataType
        value = lambda key: property_of(properties, kind, key, spec.property_types.get(key))
        label = F.col(f"{what}_label") if spec.by_label(what) else F.lit("")
        keys = [k.alias(f"__k{i}") for i, k in enumerate(spec.values(what, F.col(f"{what}_label"), value))]
        aggregates = getattr(spec, f"{what}_aggregates")
        inputs = [value(a.property_key).alias(f"__a{i}") for i, a in enumerate(aggregates) if a.property_key is not None]
        return df.select(*keep, label.alias("__label"), *keys, *inputs)

    def prepare_vertices(self, deduped: DataFrame) -> DataFrame:
        """Label (or ''), grouping properties, aggregated properties and super id of each vertex version."""
        out = self._prepared(deduped, "vertex", ["vertex_id", "__t"])
        return out.withColumn("__super", element_id(self._identity("vertex"), self.spec.id_scheme))

    def _identity(self, what: str) -> list[Column]:
        keys = [F.col(f"__k{i}") for i in range(len(self.spec.properties(what)))]
        label = [F.col("__label")] if self.spec.by_label(what) or not keys else []
        return [*label, *keys, time_text(F.col("__t"))]

    def _grouped(self, df: DataFrame, what: str, ends: list[str]) -> DataFrame:
        spec = self.spec
        keys = [f"__k{i}" for i in range(len(spec.properties(what)))]
        aggregates = getattr(spec, f"{what}_aggregates")
        made = [a.column(None if a.property_key is None else F.col(f"__a{i}")).alias(f"__r{i}") for i, a in enumerate(aggregates)]
        # A window time keeps its window, so bounded input groups by it as it stands.
        window = F.window("__t", spec.window.interval).alias("__w") if df.isStreaming else F.col("__t")
        made = made or [F.count(F.lit(1)).alias("__n")]
        out = df.groupBy(window, *ends, "__label", *keys).agg(*made)
        return out.withColumn("__t", F.window_time("__w")) if df.isStreaming else out

    def _properties(self, what: str) -> Column:
        named = [F.col(f"__k{i}").alias(k) for i, k in enumerate(self.spec.properties(what))]
        named += [F.col(f"__r{i}").alias(a.output_key) for i, a in enumerate(getattr(self.spec, f"{what}_aggregates"))]
        return (F.struct(*named) if named else F.create_map().cast("map<string,string>")).alias(f"{what}_properties")

    def _time(self, df: DataFrame) -> Column:
        """End of the window less a millisecond; a stream keeps the microsecond, which its watermark hangs on."""
        return (F.col("__t") if df.isStreaming else F.date_trunc("MILLISECOND", "__t")).alias("event_time")

    def group_vertices(self, prepared: DataFrame) -> DataFrame:
        """Super vertices."""
        out = self._grouped(prepared, "vertex", [])
        super_id = element_id(self._identity("vertex"), self.spec.id_scheme)
        return out.select(super_id.alias("vertex_id"), F.col("__label").alias("vertex_label"), self._properties("vertex"), self._time(out))

    def mapping(self, prepared: DataFrame) -> DataFrame:
        """(vertex, window) -> super vertex."""
        out = prepared.select("vertex_id", "__t", "__super")
        if self.spec.mapping == "bag":
            return out
        # Versions of a vertex that fall into one super vertex map once; dealt as the joins with edges want them.
        return out if out.isStreaming else out.repartition("vertex_id", "__t").distinct()

    def stream_mapping(self, graph: PropertyGraph) -> DataFrame:
        """The mapping of a stream: vertices are deduplicated by what decides their super vertex, in one stateful step.

        Edges wait for the mapping no longer than their own deduplication does, so both sides of the join must be equally deep.
        """
        if self.spec.mapping == "bag":
            return self.mapping(self.prepare_vertices(self.dedup_vertices(graph)))
        keyed = self._prepared(graph.vertices, "vertex", ["vertex_id", "event_time"])
        keys = ["vertex_id", "__label", *[f"__k{i}" for i in range(len(self.spec.properties("vertex")))]]
        once = self._windowed(keyed.select(*keys, "event_time"), graph, keys)
        return once.select("vertex_id", "__t", element_id(self._identity("vertex"), self.spec.id_scheme).alias("__super"))

    def attach_super_endpoints(self, edges: DataFrame, mapping: DataFrame) -> DataFrame:
        """Edges between super vertices of their own window; an edge follows a vertex to each of its super vertices."""
        if edges.isStreaming:
            return self._attach_stream(edges, mapping)
        for end in ("target", "source"):
            side = mapping.select(F.col("vertex_id").alias("__v"), F.col("__t").alias("__vt"), F.col("__super").alias(f"__{end}"))
            edges = edges.join(side, (F.col(f"{end}_id") == F.col("__v")) & (F.col("__t") == F.col("__vt"))).drop("__v", "__vt")
        return edges.drop("source_id", "target_id").withColumnsRenamed({"__source": "source_id", "__target": "target_id"})

    def _attach_stream(self, edges: DataFrame, mapping: DataFrame) -> DataFrame:
        """The same with one join for both ends: Spark drops as late what one join of a stream hands to the next in a batch."""
        own = ["edge_id", "edge_label", "edge_properties", "source_id", "target_id"]
        side = mapping.select(F.col("vertex_id").alias("__v"), F.col("__t").alias("__vt"), "__super")
        ends = edges.select(*own, "__t", F.posexplode(F.array("source_id", "target_id")).alias("__at", "__end"))
        met = ends.join(side, (F.col("__end") == F.col("__v")) & (F.col("__t") == F.col("__vt")))
        gather = F.collect_list if self.spec.mapping == "bag" else F.collect_set
        both = met.groupBy(F.window("__t", self.spec.window.interval).alias("__w"), *own).agg(
            *[gather(F.when(F.col("__at") == at, F.col("__super"))).alias(f"__{end}") for at, end in ((0, "source"), (1, "target"))]
        )
        pairs = both.withColumn("__s", F.explode("__source")).withColumn("__d", F.explode("__target"))
        return pairs.select(*own[:3], F.window_time("__w").alias("__t"), F.col("__s").alias("source_id"), F.col("__d").alias("target_id"))

    def prepare_edges(self, edges: DataFrame) -> DataFrame:
        return self._prepared(edges, "edge", ["edge_id", "source_id", "target_id", "__t"])

    def group_edges(self, prepared: DataFrame) -> DataFrame:
        """Super edges."""
        out = self._grouped(prepared, "edge", ["source_id", "target_id"])
        super_id = element_id([F.col("source_id"), F.col("target_id"), *self._identity("edge")], self.spec.id_scheme)
        return out.select(super_id.alias("edge_id"), F.col("__label").alias("edge_label"), self._properties("edge"), "source_id", "target_id", self._time(out))

    def _inline(self, graph: PropertyGraph) -> DataFrame:
        """Edges with super endpoints computed from the vertices that their triples carry: no join."""
        if graph.source_triples is None:
            raise ValueError("consistent_vertices needs a graph made from triples")
        triples = graph.source_triples
        columns = [F.col("id").alias("edge_id"), F.col("label").alias("edge_label"), F.col("properties").alias("edge_properties"), "source", "target", "event_time"]
        edges = self._windowed(triples.select(*columns), graph, ["edge_id", "edge_label", "edge_properties", "source", "target"], distinct=not self.spec.unique_edges)
        for end in ("source", "target"):
            vertex, kind = F.col(end), edges.schema[end].dataType
            value = lambda k, of=vertex["vertex_properties"], kind=kind["vertex_properties"].dataType: property_of(of, kind, k, self.spec.property_types.get(k))
            keys = self.spec.values("vertex", vertex["vertex_label"], value)
            label = [vertex["vertex_label"] if self.spec.by_label("vertex") else F.lit("")] if self.spec.by_label("vertex") or not keys else []
            edges = edges.withColumn(f"{end}_id", element_id([*label, *keys, time_text(F.col("__t"))], self.spec.id_scheme))
        return edges.drop("source", "target")

    def execute(self, graph: PropertyGraph) -> PropertyGraph:
        vertices = self.prepare_vertices(self.dedup_vertices(graph))
        if self.spec.write_vertices and not graph.streaming:
            vertices = written(vertices)
        if self.spec.consistent_vertices:
            edges = self._inline(graph)
        else:
            mapping = self.stream_mapping(graph) if graph.streaming else self.mapping(vertices)
            edges = self.attach_super_endpoints(self.dedup_edges(graph), mapping)
        return PropertyGraph(self.group_vertices(vertices), self.group_edges(self.prepare_edges(edges)), graph.config, watermarked=graph.streaming)
