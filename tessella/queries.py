"""Queries over the driver's tables, one for each operator, and the same in DuckDB SQL.

Three views make graphs of the tables: activity (user -event-> kind of event), purchases (customer -placed-> order) and supply
(part -returnflag-> supplier). ``Case`` holds one grouping and writes both its Spark query and its SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import WindowSpec
from .functions import AvgProperty, Count, CustomAggregate, MaxProperty, MinProperty, SumProperty
from .graph import PropertyGraph
from .operators.grouping import GraphGrouping
from .plans.spec import LABEL, GroupingBuilder, GroupingKey, GroupingSpec
from .sources import random_triples, read_trips, read_tweets, triples_from_rows, trips_to_triples, tweets_to_triples
from .storage import remove, shared_folder
from .streaming import drain

Query = Callable[[SparkSession, str], DataFrame]
#: Moves means of cents off the halves, where two engines may round apart.
NUDGE = 0.0001


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vertex(vid: Column, label: Column, properties: Column, time: Column) -> Column:
    return F.struct(vid.cast("string").alias("vertex_id"), label.alias("vertex_label"), properties.alias("vertex_properties"), time.alias("event_time"))


def _props(kinds: dict[str, str], **given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _triples(df: DataFrame, eid: Column, label: Column, properties: Column, time: Column, source: tuple, target: tuple) -> DataFrame:
    ends = [_vertex(*x, time).alias(n) for n, x in (("source", source), ("target", target))]
    return df.select(eid.cast("string").alias("id"), time.alias("event_time"), label.alias("label"), properties.alias("properties"), *ends)


ACTIVITY_V, ACTIVITY_E = {"parity": "int"}, {"value": "double", "k": "int"}
PURCHASES_V, PURCHASES_E = {"segment": "string", "nation": "int", "acctbal": "double", "status": "string"}, {"totalprice": "double", "priority": "string"}
SUPPLY_V, SUPPLY_E = {"brand": "string", "size": "int", "nation": "int", "acctbal": "double"}, {"quantity": "double", "discount": "double"}


def activity_from(events: DataFrame) -> DataFrame:
    time = F.col("ts").cast("timestamp")
    user = (F.col("user_id"), F.lit("user"), _props(ACTIVITY_V, parity=F.pmod("user_id", F.lit(2))))
    kind = (F.col("event_type"), F.lit("etype"), _props(ACTIVITY_V))
    k = F.from_json("props", "k INT")["k"]
    return _triples(events, F.col("event_id"), F.col("event_type"), _props(ACTIVITY_E, value=F.col("value"), k=k), time, user, kind)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_from(_read(spark, sf_dir, "events"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    customer = _props(PURCHASES_V, segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"), acctbal=F.col("c_acctbal"))
    return _triples(
        both, F.col("o_orderkey"), F.lit("placed"), _props(PURCHASES_E, totalprice=F.col("o_totalprice"), priority=F.col("o_orderpriority")), F.col("o_orderdate").cast("timestamp"),
        (F.concat(F.lit("c"), F.col("c_custkey")), F.lit("customer"), customer), (F.concat(F.lit("o"), F.col("o_orderkey")), F.lit("order"), _props(PURCHASES_V, status=F.col("o_orderstatus"))),
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    eid = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return _triples(
        items, eid, F.col("l_returnflag"), _props(SUPPLY_E, quantity=F.col("l_quantity"), discount=F.col("l_discount")), F.col("l_shipdate").cast("timestamp"),
        (F.concat(F.lit("p"), F.col("p_partkey")), F.lit("part"), _props(SUPPLY_V, brand=F.col("p_brand"), size=F.col("p_size"))),
        (F.concat(F.lit("s"), F.col("s_suppkey")), F.lit("supplier"), _props(SUPPLY_V, nation=F.col("s_nationkey"), acctbal=F.col("s_acctbal"))),
    )


@dataclass(frozen=True)
class View:
    """A view and its SQL: columns eid, elabel, e_*, sid, slabel, s_*, tid, tlabel, t_*, ts."""

    make: Callable[[SparkSession, str], DataFrame]
    vertex: dict[str, str]
    edge: dict[str, str]
    sql: str


ACTIVITY = View(activity, ACTIVITY_V, ACTIVITY_E, """
SELECT CAST(event_id AS VARCHAR) AS eid, event_type AS elabel, value AS e_value, CAST(json_extract(props, '$.k') AS INT) AS e_k, CAST(user_id AS VARCHAR) AS sid,
       'user' AS slabel, CAST(user_id % 2 AS INT) AS s_parity, event_type AS tid, 'etype' AS tlabel, CAST(NULL AS INT) AS t_parity, ts FROM events""")  # fmt: skip
PURCHASES = View(purchases, PURCHASES_V, PURCHASES_E, """
SELECT CAST(o_orderkey AS VARCHAR) AS eid, 'placed' AS elabel, o_totalprice AS e_totalprice, o_orderpriority AS e_priority, 'c' || c_custkey AS sid,
       'customer' AS slabel, c_mktsegment AS s_segment, CAST(c_nationkey AS INT) AS s_nation, c_acctbal AS s_acctbal, CAST(NULL AS VARCHAR) AS s_status,
       'o' || o_orderkey AS tid, 'order' AS tlabel, CAST(NULL AS VARCHAR) AS t_segment, CAST(NULL AS INT) AS t_nation, CAST(NULL AS DOUBLE) AS t_acctbal,
       o_orderstatus AS t_status, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
SUPPLY = View(supply, SUPPLY_V, SUPPLY_E, """
SELECT l_orderkey || '-' || l_linenumber AS eid, l_returnflag AS elabel, l_quantity AS e_quantity, l_discount AS e_discount, 'p' || p_partkey AS sid,
       'part' AS slabel, p_brand AS s_brand, CAST(p_size AS INT) AS s_size, CAST(NULL AS INT) AS s_nation, CAST(NULL AS DOUBLE) AS s_acctbal, 's' || s_suppkey AS tid,
       'supplier' AS tlabel, CAST(NULL AS VARCHAR) AS t_brand, CAST(NULL AS INT) AS t_size, CAST(s_nationkey AS INT) AS t_nation, s_acctbal AS t_acctbal,
       l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")  # fmt: skip

_SQL_AGGREGATES = {Count: "count(*)", SumProperty: "sum({})", MinProperty: "min({})", MaxProperty: "max({})", AvgProperty: "avg({})"}


@dataclass(frozen=True)
class Case:
    """One grouping of one view."""

    view: View
    spec: GroupingSpec
    custom_sql: str = ""

    def graph(self, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        return PropertyGraph.from_triples(self.view.make(spark, sf_dir))

    def grouped(self, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        return self.graph(spark, sf_dir).apply(GraphGrouping(self.spec))

    def _out(self, what: str) -> list[str]:
        return [*self.spec.properties(what), *[a.output_key for a in getattr(self.spec, f"{what}_aggregates")]]

    def _rounded(self, df: DataFrame) -> DataFrame:
        """Doubles rounded; whole numbers that may be missing as doubles, so that both engines show them alike."""
        whole = {"time_ms"} | {f"{end}_{a.output_key}" for x, ends in (("vertex", ("v", "source", "target")), ("edge", ("e",))) for end in ends for a in getattr(self.spec, f"{x}_aggregates") if type(a) is Count}
        kinds = dict(df.dtypes)
        return df.select(*[F.round(F.col(c).cast("double") + NUDGE, 2).alias(c) if kinds[c] in ("double", "int", "bigint") and c not in whole else F.col(c) for c in df.columns])

    def vertices(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        v = self.grouped(spark, sf_dir).vertices
        return self._rounded(v.select(F.unix_millis("event_time").alias("time_ms"), "vertex_label", *[F.col("vertex_properties").getField(n).alias(f"v_{n}") for n in self._out("vertex")]))

    def triples(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.flat(self.grouped(spark, sf_dir))

    def flat(self, graph: PropertyGraph) -> DataFrame:
        t = graph.triples()
        ends = [
            c for end in ("source", "target")
            for c in (F.col(f"{end}.vertex_label").alias(f"{end}_label"), *[F.col(f"{end}.vertex_properties").getField(n).alias(f"{end}_{n}") for n in self._out("vertex")])
        ]
        return self._rounded(t.select(F.unix_millis("event_time").alias("time_ms"), F.col("label").alias("edge_label"), *[F.col("properties").getField(n).alias(f"e_{n}") for n in self._out("edge")], *ends))

    # The same in SQL.

    def steps(self, view_sql: str | None = None) -> str:
        s, view = self.spec, self.view
        vp = lambda end: ", ".join(f"{end}_{p} AS {p}" for p in view.vertex)
        label = lambda what, c: c if s.by_label(what) else "''"
        aggregate = lambda what: "".join(
            f", {(_SQL_AGGREGATES.get(type(a)) or self.custom_sql).format(a.property_key)} AS {a.output_key}" for a in getattr(s, f"{what}_aggregates")
        )
        vk, ek = s.properties("vertex"), s.properties("edge")
        keys = lambda ks, pre="", post="": "".join(f", {pre}{k}{post.format(k)}" for k in ks)
        end = lambda a, x: f"JOIN x {a} ON {a}.vid = e.{x}id AND {a}.w = e.w"
        return f"""
WITH raw AS ({view_sql or view.sql}),
t AS (SELECT *, time_bucket(INTERVAL '{s.window.interval}', ts, TIMESTAMP '1970-01-01') AS w FROM raw),
v AS (SELECT DISTINCT * FROM (SELECT sid AS vid, slabel AS vlabel, {vp('s')}, w FROM t UNION ALL SELECT tid, tlabel, {vp('t')}, w FROM t) u),
e AS (SELECT DISTINCT eid, elabel, {', '.join(f'e_{p} AS {p}' for p in view.edge)}, sid, tid, w FROM t),
sv AS (SELECT w, {label('vertex', 'vlabel')} AS l{keys(vk)}{aggregate('vertex')} FROM v GROUP BY w, {label('vertex', 'vlabel')}{keys(vk)}),
x AS (SELECT DISTINCT vid, w, {label('vertex', 'vlabel')} AS l{keys(vk)} FROM v),
e2 AS (SELECT e.*, a.l AS sl, b.l AS tl{keys(vk, 'a.', ' AS s__{}')}{keys(vk, 'b.', ' AS t__{}')} FROM e {end('a', 's')} {end('b', 't')}),
se AS (SELECT w, sl, tl{keys(vk, 's__')}{keys(vk, 't__')}, {label('edge', 'elabel')} AS l{keys(ek)}{aggregate('edge')}
       FROM e2 GROUP BY w, sl, tl{keys(vk, 's__')}{keys(vk, 't__')}, {label('edge', 'elabel')}{keys(ek)})"""

    @property
    def _ms(self) -> str:
        return f"epoch_ms({{}}w + INTERVAL '{self.spec.window.interval}') - 1 AS time_ms"

    def _sql_out(self, what: str, alias: str, prefix: str) -> str:
        kinds = getattr(self.view, what)
        given = {a.output_key: a for a in getattr(self.spec, f"{what}_aggregates")}

        def one(n: str) -> str:
            a = given.get(n)
            kind = kinds[n] if a is None else "count" if type(a) is Count else kinds.get(a.property_key)
            return f", round(CAST({alias}.{n} AS DOUBLE) + {NUDGE}, 2) AS {prefix}_{n}" if kind in ("double", "int") else f", {alias}.{n} AS {prefix}_{n}"

        return "".join(one(n) for n in self._out(what))

    def vertices_sql(self) -> str:
        return f"{self.steps()}\nSELECT {self._ms.format('sv.')}, sv.l AS vertex_label{self._sql_out('vertex', 'sv', 'v')} FROM sv"

    def triples_sql(self, view_sql: str | None = None) -> str:
        vk = self.spec.properties("vertex")
        end = lambda a, x: f"JOIN sv {a} ON {a}.w = se.w AND {a}.l = se.{x}l" + "".join(f" AND {a}.{k} IS NOT DISTINCT FROM se.{x}__{k}" for k in vk)
        return (
            f"{self.steps(view_sql)}\nSELECT {self._ms.format('se.')}, se.l AS edge_label{self._sql_out('edge', 'se', 'e')}, a.l AS source_label{self._sql_out('vertex', 'a', 'source')}, "
            f"b.l AS target_label{self._sql_out('vertex', 'b', 'target')} FROM se {end('a', 's')} {end('b', 't')}"
        )


def _spec(vertex: str = "", edge: str = "", va: tuple = (), ea: tuple = (), value: int = 1, unit: str = "days", **options) -> GroupingSpec:
    return GroupingSpec(tuple(vertex.split()), tuple(va), tuple(edge.split()), tuple(ea), WindowSpec(value, unit), **options)


_TOTALS = (Count(), SumProperty("totalprice"), MinProperty("totalprice"), MaxProperty("totalprice"), AvgProperty("totalprice"))
_SPREAD = CustomAggregate("spread", lambda v: F.max(v) - F.min(v), "acctbal")

VERTEX_CASES: dict[str, Case] = {
    "group_vertices_label": Case(ACTIVITY, _spec(LABEL, va=(Count(),))),
    "group_vertices_property": Case(PURCHASES, _spec("nation", va=(Count(), AvgProperty("acctbal")), value=60)),
    "group_vertices_label_property": Case(PURCHASES, _spec(f"{LABEL} segment", va=(Count(), SumProperty("acctbal")), value=30)),
    "group_vertices_all": Case(SUPPLY, _spec(va=(Count(),), value=30)),
    "agg_count": Case(SUPPLY, _spec(LABEL, va=(Count("elements"),), value=90)),
    "agg_sum": Case(SUPPLY, _spec("brand", va=(SumProperty("size"), SumProperty("acctbal")), value=90)),
    "agg_min": Case(PURCHASES, _spec("segment", va=(MinProperty("acctbal"),), value=30)),
    "agg_max": Case(PURCHASES, _spec("segment", va=(MaxProperty("acctbal"),), value=30)),
    "agg_avg": Case(SUPPLY, _spec("brand", va=(AvgProperty("size"),), value=90)),
    "agg_custom": Case(PURCHASES, _spec("segment", va=(_SPREAD,), value=30), "max({0}) - min({0})"),
    "multi_agg_same_property": Case(SUPPLY, _spec("nation", va=(Count(), SumProperty("acctbal"), MinProperty("acctbal"), MaxProperty("acctbal"), AvgProperty("acctbal")), value=365)),
    "missing_property_group": Case(ACTIVITY, _spec("parity", va=(Count(),), value=7)),
}
TRIPLE_CASES: dict[str, Case] = {
    "super_triples": Case(ACTIVITY, _spec(LABEL, LABEL, (Count(),), (Count(), SumProperty("value"), MaxProperty("value")), write_vertices=True)),
    "group_edges_label": Case(SUPPLY, _spec(LABEL, LABEL, ea=(Count(), SumProperty("quantity")), value=90)),
    "group_edges_property": Case(PURCHASES, _spec("segment", "priority", ea=(Count(),), value=90)),
    "group_edges_label_property": Case(PURCHASES, _spec(f"{LABEL} segment status", f"{LABEL} priority", (Count(),), _TOTALS, value=180)),
    "group_edges_all": Case(ACTIVITY, _spec("", "", (Count(),), (Count(), AvgProperty("value")))),
    "group_edges_missing_property": Case(ACTIVITY, _spec("parity", "k", (Count(),), (Count(),), value=7)),
    "default_window_group_by": Case(ACTIVITY, _spec(LABEL, LABEL, (Count(),), (Count(),), 10, "seconds")),
    "window_seconds": Case(ACTIVITY, _spec(LABEL, "", (Count(),), (Count(),), 45, "seconds")),
    "window_minutes": Case(ACTIVITY, _spec(LABEL, "", (Count(),), (Count(),), 30, "minutes")),
    "window_hours": Case(ACTIVITY, _spec(LABEL, "", (Count(),), (Count(),), 7, "hours")),
    "window_days": Case(ACTIVITY, _spec(LABEL, "", (Count(),), (Count(),), 15, "days")),
    "unique_edges": Case(SUPPLY, _spec("brand", LABEL, (Count(),), (Count(), MinProperty("discount")), value=180, unique_edges=True, write_vertices=True)),
    "join_free_grouping": Case(ACTIVITY, _spec(LABEL, LABEL, (Count(),), (Count(), SumProperty("value")), consistent_vertices=True)),
}


def _group_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = TRIPLE_CASES["default_window_group_by"]
    return case.flat(case.graph(spark, sf_dir).group_by([LABEL], [Count()], [LABEL], [Count()]))


_ms = lambda c="event_time": F.unix_millis(c).alias("time_ms")


def _doubled(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Activity with every triple of even event id twice."""
    triples = activity(spark, sf_dir)
    return PropertyGraph.from_triples(triples.unionAll(triples.where(F.col("id").cast("long") % 2 == 0)))


_DEDUP = Case(ACTIVITY, _spec(LABEL, LABEL))


def _dedup_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = GraphGrouping(_DEDUP.spec).dedup_vertices(_doubled(spark, sf_dir))
    return out.select("vertex_id", "vertex_label", F.col("vertex_properties.parity").cast("double").alias("parity"), _ms(F.date_trunc("MILLISECOND", "__t")))


def _dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = GraphGrouping(_DEDUP.spec).dedup_edges(_doubled(spark, sf_dir))
    return out.select("edge_id", "edge_label", F.col("edge_properties.value").alias("value"), F.col("edge_properties.k").alias("k"), "source_id", "target_id", _ms(F.date_trunc("MILLISECOND", "__t")))


def _split_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _doubled(spark, sf_dir).vertices
    return v.groupBy("vertex_id", "vertex_label", F.to_date("event_time").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(spark, sf_dir).edges.select("edge_id", "edge_label", "source_id", "target_id", _ms())


def _vertex_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = GraphGrouping(_spec(f"{LABEL} parity"))
    out = op.mapping(op.prepare_vertices(op.dedup_vertices(_DEDUP.graph(spark, sf_dir))))
    return out.select("vertex_id", _ms(F.date_trunc("MILLISECOND", "__t")), F.col("__super").alias("super_vertex_id"))


def _edges_super_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    op, graph = GraphGrouping(_spec(f"{LABEL} parity")), _DEDUP.graph(spark, sf_dir)
    out = op.attach_super_endpoints(op.dedup_edges(graph), op.mapping(op.prepare_vertices(op.dedup_vertices(graph))))
    return out.select("edge_id", "source_id", "target_id", _ms(F.date_trunc("MILLISECOND", "__t")))


def _super_vertex_id(spark: SparkSession, sf_dir: str, scheme: str = "escaped") -> DataFrame:
    out = _DEDUP.graph(spark, sf_dir).apply(GraphGrouping(_spec(f"{LABEL} parity", id_scheme=scheme))).vertices
    return out.select("vertex_id", "vertex_label", F.col("vertex_properties.parity").cast("double").alias("parity"), _ms())


def _super_edge_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _DEDUP.graph(spark, sf_dir).apply(GraphGrouping(_spec(LABEL, f"{LABEL} k"))).edges
    return out.select("edge_id", "source_id", "target_id", "edge_label", F.col("edge_properties.k").alias("k"), _ms())


def _prepared_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = GraphGrouping(_spec("segment", va=(SumProperty("acctbal"),), value=30))
    out = op.prepare_vertices(op.dedup_vertices(PropertyGraph.from_triples(purchases(spark, sf_dir))))
    return out.select("vertex_id", F.col("__label").alias("label"), F.col("__k0").alias("segment"), F.col("__a0").alias("acctbal"), _ms(F.date_trunc("MILLISECOND", "__t")))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _spec(f"{LABEL} parity", LABEL, (Count("n"),), (Count("n"), SumProperty("value")), 6, "hours")
    second = GroupingSpec((LABEL,), (Count("groups"), SumProperty("n", "members")), (), (Count("groups"), SumProperty("n", "edges")), WindowSpec(2, "days"))
    t = _DEDUP.graph(spark, sf_dir).apply(GraphGrouping(first)).apply(GraphGrouping(second)).triples()
    return t.select(
        _ms(), F.col("source.vertex_label").alias("source_label"), F.col("target.vertex_label").alias("target_label"), F.col("properties.groups").alias("edge_groups"), F.col("properties.edges").alias("edges"),
        F.col("source.vertex_properties.groups").alias("source_groups"), F.col("source.vertex_properties.members").alias("source_members"), F.col("target.vertex_properties.members").alias("target_members"),
    )


def _bag_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a version for each kind of event: a bag maps each version."""
    events = _read(spark, sf_dir, "events")
    time = F.col("ts").cast("timestamp")
    user = (F.col("user_id"), F.lit("user"), F.struct(F.col("event_type").alias("last")))
    kind = (F.col("event_type"), F.lit("etype"), F.struct(F.lit(None).cast("string").alias("last")))
    triples = _triples(events, F.col("event_id"), F.col("event_type"), F.struct(F.col("value")), time, user, kind)
    t = PropertyGraph.from_triples(triples).apply(GraphGrouping(_spec(LABEL, LABEL, (Count(),), (Count(),), mapping="bag"))).triples()
    return t.select(_ms(), F.col("label").alias("edge_label"), F.col("properties.count").alias("e_count"), F.col("source.vertex_properties.count").alias("source_count"))


def _dynamic_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties in a map of texts, with a declared type."""
    e = _read(spark, sf_dir, "events")
    time, none = F.col("ts").cast("timestamp"), F.create_map().cast("map<string,string>")
    own = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.from_json("props", "map<string,string>")["k"])
    triples = _triples(e, F.col("event_id"), F.col("event_type"), own, time, (F.col("user_id"), F.lit("user"), none), (F.col("event_type"), F.lit("etype"), none))
    spec = _spec(LABEL, "k", (Count(),), (Count(), MaxProperty("value"), MinProperty("k", "low")), 7, property_types={"value": "double", "k": "int"})
    t = PropertyGraph.from_triples(triples).apply(GraphGrouping(spec)).triples()
    return t.select(_ms(), *[F.col(f"properties.{c}").alias(f"e_{c}") for c in ("k", "count", "max_value", "low")])


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip rows of text made of line items."""
    return _read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") * 60).cast("int").cast("string").alias("tripduration"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("starttime"),
        F.date_format(F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=F.pmod("l_partkey", F.lit(24)).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("stoptime"),
        F.col("l_suppkey").cast("string").alias("start_station_id"), F.concat(F.lit("St "), "l_suppkey").alias("start_station_name"), F.lit("40.5").alias("start_station_latitude"),
        F.lit("-73.25").alias("start_station_longitude"), F.pmod("l_partkey", F.lit(50)).cast("string").alias("end_station_id"), F.lit("End").alias("end_station_name"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, "NULL").otherwise("41.5").alias("end_station_latitude"), F.lit("null").alias("end_station_longitude"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("bikeid"), F.lit("Subscriber").alias("usertype"),
        F.when(F.pmod("l_suppkey", F.lit(4)) == 0, "NULL").otherwise((F.pmod("l_suppkey", F.lit(60)) + 1940).cast("string")).alias("birth_year"), F.pmod("l_linenumber", F.lit(3)).cast("string").alias("gender"),
    )


def _trip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, written as CSV files with a header and read by the source."""
    folder = shared_folder(spark)
    _trips(spark, sf_dir).write.option("header", True).csv(f"{folder}/trips")
    return read_trips(spark, f"{folder}/trips")


def _trips_to_triples(spark: SparkSession, sf_dir: str, rows: Query = _trips) -> DataFrame:
    t = trips_to_triples(rows(spark, sf_dir))
    return t.select(
        "id", _ms(), F.col("properties.tripduration").alias("tripduration"), F.col("properties.birth year").cast("double").alias("birth_year"), F.col("properties.gender").alias("gender"),
        F.col("source.vertex_id").alias("source_id"), F.col("target.vertex_id").alias("target_id"), F.col("target.vertex_properties.lat").alias("target_lat"), F.col("target.vertex_properties.long").alias("target_long"),
    )


def _trips_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = PropertyGraph.from_triples(trips_to_triples(_trips(spark, sf_dir)))
    t = graph.group_by([LABEL], [Count()], ["gender", LABEL], [Count(), AvgProperty("tripduration")], WindowSpec(15, "days"), write_vertices=True).triples()
    return t.select(
        _ms(), F.col("properties.gender").alias("gender"), F.col("properties.count").alias("trips"), F.round("properties.avg_tripduration", 2).alias("avg_tripduration"), F.col("source.vertex_properties.count").alias("stations")
    )


_TRIPS_SQL = """SELECT md5(l_orderkey || '-' || l_linenumber || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || strftime(l_shipdate + to_hours(l_partkey % 24), '%Y-%m-%d %H:%M:%S')) AS id,
  l_shipdate + to_hours(l_partkey % 24) AS ts, CAST(l_quantity * 60 AS INT) AS tripduration,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 60 + 1940 AS DOUBLE) END AS birth_year, CAST(l_linenumber % 3 AS INT) AS gender, CAST(l_suppkey AS VARCHAR) AS source_id,
  CAST(l_partkey % 50 AS VARCHAR) AS target_id, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 41.5::DOUBLE END AS target_lat, CAST(NULL AS DOUBLE) AS target_long FROM lineitem"""


def _tweet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON made of events; some have no user, some are empty."""
    e = _read(spark, sf_dir, "events")
    user = F.when(F.pmod("event_id", F.lit(10)) != 3, F.struct(F.col("user_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("name"), (F.pmod("user_id", F.lit(50)) * 10).cast("int").alias("followers_count")))
    place = F.when(F.col("event_type") == "click", F.struct(F.lit("Bonn").alias("name"), F.lit("Germany").alias("country")))
    spot = F.struct(F.array(F.pmod("event_id", F.lit(30)).cast("double"), F.pmod("user_id", F.lit(70)).cast("double")).alias("coordinates"))
    whole = F.struct(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp_ms"), F.lit("Wed Oct 10 20:19:24 +0000 2018").alias("created_at"),
        F.col("event_type").alias("lang"), place.alias("place"), spot.alias("coordinates"), user.alias("user"),
    )
    return e.select(F.when(F.pmod("event_id", F.lit(17)) == 0, "").otherwise(F.to_json(whole)).alias("value"))


def _tweet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, written as text files and read by the source."""
    folder = shared_folder(spark)
    _tweet_lines(spark, sf_dir).write.text(f"{folder}/tweets")
    return read_tweets(spark, f"{folder}/tweets")


def _tweets_to_triples(spark: SparkSession, sf_dir: str, box=None, lines: Query = _tweet_lines) -> DataFrame:
    t = tweets_to_triples(lines(spark, sf_dir), box)
    return t.select(
        "id", _ms(), F.col("label").alias("edge_label"), F.unix_millis("properties.createdAt").alias("created_ms"), F.col("source.vertex_id").alias("tweet_id"),
        F.col("source.vertex_properties.country").alias("country"), F.col("target.vertex_id").alias("user_id"), F.col("target.vertex_properties.followers_count").alias("followers"),
    )


def _tweets_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = "followers_count"
    aggregates = [Count(), SumProperty(of), AvgProperty(of), MinProperty(of), MaxProperty(of)]
    graph = PropertyGraph.from_triples(tweets_to_triples(_tweet_lines(spark, sf_dir)))
    v = graph.group_by([LABEL, "country"], aggregates, [LABEL], [Count()], WindowSpec(20, "hours")).vertices
    return v.select(_ms(), "vertex_label", *[F.round(F.col("vertex_properties")[c], 2).alias(c) if "avg" in c else F.col("vertex_properties")[c].cast("string" if c == "country" else "long" if c == "count" else "double").alias(c) for c in ("country", "count", *[f"{a}_{of}" for a in ("sum", "avg", "min", "max")])])


_TWEETS_SQL = """SELECT md5(event_id || '-' || user_id) AS id, epoch_ns(ts) // 1000000 AS time_ms, 'createdByUser' AS edge_label, 1539202764000 AS created_ms, CAST(event_id AS VARCHAR) AS tweet_id,
  CASE WHEN event_type = 'click' THEN 'Germany' END AS country, CAST(user_id AS VARCHAR) AS user_id, CAST(user_id % 50 * 10 AS INT) AS followers
  FROM events WHERE event_id % 10 <> 3 AND event_id % 17 <> 0"""


_RANDOM = Case(ACTIVITY, _spec(LABEL, LABEL, (Count(),), (Count(),), 10, "seconds"))


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many random triples as there are events, grouped by label on both sides."""
    graph = PropertyGraph.from_triples(random_triples(spark, _read(spark, sf_dir, "events").count()))
    t = graph.apply(GraphGrouping(_RANDOM.spec)).triples()
    return t.select(_ms(), F.col("source.vertex_label").alias("source_label"), F.col("label").alias("edge_label"), F.col("target.vertex_label").alias("target_label"), F.col("properties.count").alias("n"))


def _random_sql() -> str:
    """The generator's rule in SQL, then the grouping's."""
    hexed = lambda text: " + ".join(f"(instr('0123456789abcdef', substr({text}, {i}, 1)) - 1) * {16 ** (7 - i)}" for i in range(1, 8))
    draw = lambda what, size: f"(({hexed(f'md5(concat_ws(chr(45), 42, {what!r}, n))')}) % {size})"
    label = lambda what, kind: "concat(" + ", ".join(f"chr(CAST(97 + (({hexed(f'md5(concat_ws(chr(45), 42, {kind!r} || {what}))')}) // {26**at}) % 26 AS INT))" for at in range(3)) + ")"
    drawn = ", ".join(f"{draw(w, size)} AS {name}" for w, size, name in (("source-id", 10_000, "si"), ("target-id", 10_000, "ti"), ("source-label", 10, "sl"), ("target-label", 10, "tl"), ("edge-label", 10, "el")))
    view = f"""SELECT md5('e42-' || n) AS eid, {label('el', 'e')} AS elabel, NULL AS e_value, NULL AS e_k, md5('v42-' || si) AS sid, {label('sl', 'v')} AS slabel, md5('v42-' || si) AS s_parity,
        md5('v42-' || ti) AS tid, {label('tl', 'v')} AS tlabel, md5('v42-' || ti) AS t_parity, TIMESTAMP '2024-01-01' + to_milliseconds(n) AS ts FROM (SELECT n, {drawn} FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS n))"""
    return f"SELECT time_ms, source_label, edge_label, target_label, e_count AS n FROM ({_RANDOM.triples_sql(view)})"


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small graph given as rows."""
    t = lambda s: F.timestamp_millis(F.lit(1_600_000_000_000 + 1000 * s))
    when = spark.range(1).select(*[t(s).alias(f"t{s}") for s in (0, 5, 12)]).first()
    a, b, c = (("a", "X", (1,), when.t0), ("b", "Y", (2,), when.t5), ("c", "X", (None,), when.t12))
    rows = [("e1", when.t0, "knows", (5,), a, b), ("e2", when.t5, "knows", (7,), a, b), ("e3", when.t12, "likes", (1,), c, c)]
    graph = PropertyGraph.from_triples(triples_from_rows(spark, rows, "size INT", "weight INT"))
    r = graph.group_by([LABEL], [SumProperty("size")], [LABEL], [SumProperty("weight")]).triples()
    return r.select(_ms(), F.col("label").alias("edge_label"), F.col("properties.sum_weight").alias("weight"), F.col("source.vertex_properties.sum_size").cast("double").alias("source_size"), F.col("target.vertex_properties.sum_size").cast("double").alias("target_size"))


def _lines(what: str) -> Query:
    """Printable lines of vertices, edges or triples."""
    return lambda spark, sf_dir: getattr(_DEDUP.graph(spark, sf_dir), f"{what}_lines")().withColumnRenamed("value", "line")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file sink has written of vertices and edges."""
    folder = shared_folder(spark)
    _DEDUP.graph(spark, sf_dir).write_as_csv(f"{folder}/graph")
    parts = [spark.read.text(f"{folder}/graph_{x}").select(F.lit(x).alias("file"), F.col("value").alias("line")) for x in "VE"]
    return parts[0].unionByName(parts[1])


_BUILT = Case(PURCHASES, _spec(f"{LABEL} segment", f"{LABEL} priority", (Count(), MaxProperty("acctbal")), (Count(), AvgProperty("totalprice")), 90))


def _with_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouping put together step by step."""
    b = GroupingBuilder().add_vertex_grouping_key(LABEL).add_vertex_grouping_keys(["segment"]).add_edge_grouping_keys([LABEL]).add_edge_grouping_key("priority")
    b = b.add_vertex_aggregate(Count()).add_vertex_aggregate(MaxProperty("acctbal")).add_edge_aggregate(Count()).add_edge_aggregate(AvgProperty("totalprice"))
    return _BUILT.flat(_BUILT.graph(spark, sf_dir).apply(b.set_window_size(90, "days").build()))


_BY_SIZE = GroupingKey("size", lambda label, value: F.floor(value("size") / 10).cast("int"))
_BY_HALF = GroupingKey("half", lambda label, value: F.concat(label, F.when(value("quantity") > 25, "+").otherwise("-")))
_DERIVED = Case(SUPPLY, GroupingSpec((LABEL, _BY_SIZE), (Count(), MaxProperty("acctbal")), (_BY_HALF,), (Count(), MaxProperty("discount")), WindowSpec(180, "days")))


def _derived_sql() -> str:
    """Keys as columns of the view, under names of their own in place of the properties that they are made of."""
    view = SUPPLY.sql.replace("CAST(p_size AS INT) AS s_size", "CAST(floor(p_size / 10) AS INT) AS s_size").replace("l_discount AS e_discount", "l_discount AS e_discount, l_returnflag || CASE WHEN l_quantity > 25 THEN '+' ELSE '-' END AS e_half")
    plain = GroupingSpec((LABEL, "size"), (Count(), MaxProperty("acctbal")), ("half",), (Count(), MaxProperty("discount")), WindowSpec(180, "days"))
    return Case(View(SUPPLY.make, SUPPLY_V, SUPPLY_E | {"half": "string"}, view), plain).triples_sql()


def _separate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph given as a table of vertices and one of edges."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    time = F.col("o_orderdate").cast("timestamp").alias("event_time")
    customer, order = F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("o"), F.col("o_orderkey"))
    met = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    of_customer = _props(PURCHASES_V, segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"), acctbal=F.col("c_acctbal"))
    vertices = met.select(customer.alias("vertex_id"), F.lit("customer").alias("vertex_label"), of_customer.alias("vertex_properties"), time)
    vertices = vertices.unionByName(met.select(order.alias("vertex_id"), F.lit("order").alias("vertex_label"), _props(PURCHASES_V, status=F.col("o_orderstatus")).alias("vertex_properties"), time))
    of_edge = _props(PURCHASES_E, totalprice=F.col("o_totalprice"), priority=F.col("o_orderpriority"))
    edges = orders.select(F.col("o_orderkey").cast("string").alias("edge_id"), F.lit("placed").alias("edge_label"), of_edge.alias("edge_properties"), customer.alias("source_id"), order.alias("target_id"), time)
    return _BUILT.flat(PropertyGraph(vertices, edges).apply(GraphGrouping(_BUILT.spec)))


def _activity_stream(spark: SparkSession, sf_dir: str, folder: str) -> PropertyGraph:
    """Activity as a stream, behind its events a row that closes all windows."""
    events = _read(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/in/batch=1")
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).withColumns({"ts": F.expr("ts + INTERVAL 400 DAYS"), "event_id": F.lit(-1).cast("long"), "event_type": F.lit("end")})
    last.write.parquet(f"{folder}/in/batch=2")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100_000).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    return PropertyGraph.from_triples(activity_from(source))


def _drained(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    out = drain(df, f"{folder}/out", f"{folder}/state")
    for part in ("in", "state"):
        remove(spark, f"{folder}/{part}")
    return out


_STREAM = Case(ACTIVITY, _spec(LABEL, LABEL, (Count(),), (Count(), MaxProperty("value"))))


def _streaming_super_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    graph = _activity_stream(spark, sf_dir, folder)
    return _drained(spark, _STREAM.flat(graph.apply(GraphGrouping(_STREAM.spec))), folder).where("edge_label <> 'end'")


def _streaming_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    v = _activity_stream(spark, sf_dir, folder).apply(GraphGrouping(_spec("parity", va=(Count(),)))).vertices
    return _drained(spark, v.select(_ms(), F.col("vertex_properties.parity").cast("double").alias("parity"), F.col("vertex_properties.count").alias("n")), folder)


_LATE = Case(ACTIVITY, _spec("parity", LABEL, (Count(),), (Count(), MinProperty("value")), 36, "hours"))


def _streaming_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose windows have closed come again under other ids and change nothing; the state of a first run knows that they are late."""
    folder = shared_folder(spark)
    flat = _LATE.flat(_activity_stream(spark, sf_dir, folder).apply(GraphGrouping(_LATE.spec)))
    drain(flat, f"{folder}/out", f"{folder}/state")
    late = _read(spark, sf_dir, "events").where("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") + 1_000_000_000, "value": F.lit(-1.0)})
    late.write.parquet(f"{folder}/in/batch=3")
    return _drained(spark, flat, folder).where("edge_label <> 'end'")


QUERIES: dict[str, Query] = {
    **{name: case.vertices for name, case in VERTEX_CASES.items()},
    **{name: case.triples for name, case in TRIPLE_CASES.items()},
    "default_window_group_by": _group_by_default,
    "triple_split_vertices": _split_vertices,
    "triple_split_edges": _split_edges,
    "dedup_vertices": _dedup_vertices,
    "dedup_edges": _dedup_edges,
    "prepare_vertices": _prepared_vertices,
    "vertex_mapping": _vertex_mapping,
    "edges_super_endpoints": _edges_super_endpoints,
    "super_vertex_id": _super_vertex_id,
    "super_vertex_id_plain": lambda spark, sf_dir: _super_vertex_id(spark, sf_dir, "plain"),
    "super_edge_id": _super_edge_id,
    "chained_grouping": _chained,
    "bag_mapping": _bag_mapping,
    "dynamic_properties": _dynamic_properties,
    "source_collection": _collection,
    "source_trips": _trips_to_triples,
    "trips_grouped": _trips_grouped,
    "source_tweets": _tweets_to_triples,
    "source_tweets_in_box": lambda spark, sf_dir: _tweets_to_triples(spark, sf_dir, (5.779, 47.205, 15.161, 55.076)),
    "tweets_grouped": _tweets_grouped,
    "source_random_grouped": _random,
    "source_trips_files": lambda spark, sf_dir: _trips_to_triples(spark, sf_dir, _trip_files),
    "source_tweets_files": lambda spark, sf_dir: _tweets_to_triples(spark, sf_dir, lines=_tweet_files),
    "vertex_lines": _lines("vertex"),
    "edge_lines": _lines("edge"),
    "triple_lines": _lines("triple"),
    "written_lines": _written,
    "grouping_builder": _with_builder,
    "separate_tables": _separate_tables,
    "derived_grouping_keys": _DERIVED.triples,
    "streaming_late_rows": _streaming_late_rows,
    "streaming_super_triples": _streaming_super_triples,
    "streaming_group_vertices": _streaming_vertices,
}

_W1 = "time_bucket(INTERVAL '1 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 days'"
_ESC = "coalesce(replace(replace(CAST({} AS VARCHAR), '%', '%25'), '.', '%2E'), '%00')"
_STAMP = f"strftime({_W1} - INTERVAL '1 millisecond', '%Y-%m-%dT%H:%M:%S') || '.999'"
_TIME = f"replace({_STAMP}, '.', '%2E')"
_EV = "(SELECT CAST(user_id AS VARCHAR) AS vid, 'user' AS l, CAST(user_id % 2 AS DOUBLE) AS parity, ts FROM events UNION ALL SELECT event_type, 'etype', NULL, ts FROM events)"
_LINE_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ns(ts) // 1000000 % 1000 AS VARCHAR), 3, '0')"
_USER = f"'(' || user_id || '(t:' || {_LINE_TIME} || '):user{{parity=' || user_id % 2 || '}})'"
_KIND = f"'(' || event_type || '(t:' || {_LINE_TIME} || '):etype{{parity=NULL}})'"
_MIDDLE = f"'-[t:' || {_LINE_TIME} || ' ' || event_id || ':' || event_type || '{{value=' || coalesce(CAST(value AS VARCHAR), 'NULL') || ',k=' || coalesce(CAST(CAST(json_extract(props, '$.k') AS INT) AS VARCHAR), 'NULL') || '}}]->'"
_EDGE_LINES = f"SELECT '(' || user_id || ')' || {_MIDDLE} || '(' || event_type || ')' AS line FROM events"
_SUPER = "sha1(l || '.' || " + _ESC.format("CAST(parity AS INT)") + " || '.' || " + _TIME + ")"
_TWICE = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0)"
_FIRST = Case(ACTIVITY, _spec(f"{LABEL} parity", LABEL, (Count("n"),), (Count("n"), SumProperty("value")), 6, "hours"))

ORACLE_SQL: dict[str, str] = {
    **{name: case.vertices_sql() for name, case in VERTEX_CASES.items()},
    **{name: case.triples_sql() for name, case in TRIPLE_CASES.items()},
    "triple_split_vertices": f"""SELECT vid AS vertex_id, l AS vertex_label, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n
        FROM {_EV.replace('FROM events', 'FROM ' + _TWICE + ' q')} GROUP BY ALL""",
    "triple_split_edges": f"SELECT CAST(event_id AS VARCHAR) AS edge_id, event_type AS edge_label, CAST(user_id AS VARCHAR) AS source_id, event_type AS target_id, epoch_ns(ts) // 1000000 AS time_ms FROM {_TWICE}",
    "dedup_vertices": f"SELECT DISTINCT vid AS vertex_id, l AS vertex_label, parity, epoch_ms({_W1}) - 1 AS time_ms FROM {_EV}",
    "dedup_edges": f"""SELECT CAST(event_id AS VARCHAR) AS edge_id, event_type AS edge_label, value, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(user_id AS VARCHAR) AS source_id,
        event_type AS target_id, epoch_ms({_W1}) - 1 AS time_ms FROM events""",
    "prepare_vertices": """SELECT DISTINCT vid AS vertex_id, '' AS label, segment, acctbal, epoch_ms(w + INTERVAL '30 days') - 1 AS time_ms FROM
        (SELECT 'c' || c_custkey AS vid, c_mktsegment AS segment, c_acctbal AS acctbal, time_bucket(INTERVAL '30 days', o_orderdate, TIMESTAMP '1970-01-01') AS w FROM orders JOIN customer ON o_custkey = c_custkey
         UNION ALL SELECT 'o' || o_orderkey, NULL, NULL, time_bucket(INTERVAL '30 days', o_orderdate, TIMESTAMP '1970-01-01') FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "vertex_mapping": f"SELECT DISTINCT vid AS vertex_id, epoch_ms({_W1}) - 1 AS time_ms, {_SUPER} AS super_vertex_id FROM {_EV}",
    "edges_super_endpoints": f"""SELECT CAST(event_id AS VARCHAR) AS edge_id, sha1('user.' || user_id % 2 || '.' || {_TIME}) AS source_id, sha1('etype.%00.' || {_TIME}) AS target_id,
        epoch_ms({_W1}) - 1 AS time_ms FROM events""",
    "super_vertex_id": f"SELECT DISTINCT {_SUPER} AS vertex_id, l AS vertex_label, parity, epoch_ms({_W1}) - 1 AS time_ms FROM {_EV}",
    "super_vertex_id_plain": f"SELECT DISTINCT sha1(concat_ws('.', l, CAST(parity AS INT), {_STAMP})) AS vertex_id, l AS vertex_label, parity, epoch_ms({_W1}) - 1 AS time_ms FROM {_EV}",
    "super_edge_id": f"""SELECT DISTINCT sha1(s || '.' || t || '.' || event_type || '.' || {_ESC.format('k')} || '.' || z) AS edge_id, s AS source_id, t AS target_id, event_type AS edge_label, k, ms AS time_ms
        FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, sha1('user.' || {_TIME}) AS s, sha1('etype.' || {_TIME}) AS t, {_TIME} AS z, epoch_ms({_W1}) - 1 AS ms FROM events)""",
    "chained_grouping": _FIRST.steps() + """,
        v2 AS (SELECT *, time_bucket(INTERVAL '2 days', w + INTERVAL '6 hours' - INTERVAL '1 millisecond', TIMESTAMP '1970-01-01') AS w2 FROM sv),
        s2 AS (SELECT w2, l, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members FROM v2 GROUP BY w2, l),
        e3 AS (SELECT time_bucket(INTERVAL '2 days', w + INTERVAL '6 hours' - INTERVAL '1 millisecond', TIMESTAMP '1970-01-01') AS w2, sl, tl, count(*) AS groups, CAST(sum(n) AS BIGINT) AS edges FROM se GROUP BY 1, 2, 3)
        SELECT epoch_ms(e3.w2 + INTERVAL '2 days') - 1 AS time_ms, e3.sl AS source_label, e3.tl AS target_label, e3.groups AS edge_groups, edges, a.groups AS source_groups, a.members AS source_members,
        b.members AS target_members FROM e3 JOIN s2 a ON a.w2 = e3.w2 AND a.l = e3.sl JOIN s2 b ON b.w2 = e3.w2 AND b.l = e3.tl""",
    "bag_mapping": f"""WITH t AS (SELECT *, epoch_ms({_W1}) - 1 AS ms FROM events), v AS (SELECT DISTINCT user_id, event_type, ms FROM t), n AS (SELECT user_id, ms, count(*) AS n FROM v GROUP BY ALL),
        c AS (SELECT ms, sum(n) AS c FROM n GROUP BY ms)
        SELECT t.ms AS time_ms, event_type AS edge_label, CAST(sum(n.n) AS BIGINT) AS e_count, CAST(any_value(c.c) AS BIGINT) AS source_count FROM t JOIN n USING (user_id, ms) JOIN c ON c.ms = t.ms GROUP BY t.ms, event_type""",
    "dynamic_properties": """SELECT epoch_ms(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '7 days') - 1 AS time_ms, CAST(json_extract(props, '$.k') AS INT) AS e_k, count(*) AS e_count,
        max(value) AS e_max_value, CAST(json_extract(props, '$.k') AS INT) AS e_low FROM events GROUP BY ALL""",
    "source_collection": """SELECT * FROM (VALUES (1600000009999::BIGINT, 'knows', 12::BIGINT, 1::DOUBLE, 2::DOUBLE), (1600000019999, 'likes', 1, NULL, NULL)) AS x(time_ms, edge_label, weight, source_size, target_size)""",
    "source_trips": f"SELECT id, epoch_ms(ts) AS time_ms, tripduration, birth_year, gender, source_id, target_id, target_lat, target_long FROM ({_TRIPS_SQL})",
    "trips_grouped": f"""WITH t AS (SELECT *, epoch_ms(time_bucket(INTERVAL '15 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '15 days') - 1 AS ms FROM ({_TRIPS_SQL})),
        v AS (SELECT ms, count(*) AS stations FROM (SELECT DISTINCT ms, source_id AS i, 'St ' || source_id AS n, 40.5::DOUBLE AS a, -73.25::DOUBLE AS o FROM t UNION SELECT ms, target_id, 'End', target_lat, target_long FROM t) GROUP BY ms)
        SELECT ms AS time_ms, gender, count(*) AS trips, round(avg(tripduration), 2) AS avg_tripduration, any_value(stations) AS stations FROM t JOIN v USING (ms) GROUP BY ms, gender""",
    "source_tweets": _TWEETS_SQL,
    "source_tweets_in_box": _TWEETS_SQL + " AND event_id % 30 BETWEEN 5.779 AND 15.161 AND user_id % 70 BETWEEN 47.205 AND 55.076",
    "tweets_grouped": f"""WITH t AS (SELECT *, time_ms - time_ms % 72000000 + 71999999 AS ms FROM ({_TWEETS_SQL})),
        v AS (SELECT DISTINCT ms, 'tweet' AS l, tweet_id AS i, country, NULL AS f FROM t UNION ALL SELECT DISTINCT ms, 'user', user_id, NULL, followers FROM t)
        SELECT ms AS time_ms, l AS vertex_label, country, count(*) AS count, CAST(sum(f) AS DOUBLE) AS sum_followers_count, round(avg(f), 2) AS avg_followers_count, CAST(min(f) AS DOUBLE) AS min_followers_count, CAST(max(f) AS DOUBLE) AS max_followers_count
        FROM v GROUP BY ms, l, country""",
    "source_random_grouped": _random_sql(),
    "source_trips_files": f"SELECT id, epoch_ms(ts) AS time_ms, tripduration, birth_year, gender, source_id, target_id, target_lat, target_long FROM ({_TRIPS_SQL})",
    "source_tweets_files": _TWEETS_SQL,
    "vertex_lines": f"SELECT {_USER} AS line FROM events UNION ALL SELECT {_KIND} FROM events",
    "edge_lines": _EDGE_LINES,
    "triple_lines": f"SELECT {_USER} || {_MIDDLE} || {_KIND} AS line FROM (SELECT e.* FROM events e JOIN events a ON a.user_id = e.user_id AND a.ts = e.ts JOIN events b ON b.event_type = e.event_type AND b.ts = e.ts)",
    "written_lines": f"SELECT 'V' AS file, {_USER} AS line FROM events UNION ALL SELECT 'V', {_KIND} FROM events UNION ALL SELECT 'E', line FROM ({_EDGE_LINES})",
    "grouping_builder": _BUILT.triples_sql(),
    "separate_tables": _BUILT.triples_sql(),
    "derived_grouping_keys": _derived_sql(),
    "streaming_super_triples": _STREAM.triples_sql(),
    "streaming_late_rows": _LATE.triples_sql(),
    "streaming_group_vertices": f"SELECT epoch_ms({_W1}) - 1 AS time_ms, parity, count(DISTINCT vid) AS n FROM {_EV} GROUP BY ALL",
}
