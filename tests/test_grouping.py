"""The grouping's steps and results on the small graphs, its decided semantics, and random graphs against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella import (
    LABEL, AvgProperty, Count, CustomAggregate, GraphGrouping, GroupingBuilder, GroupingKey, GroupingSpec, MaxProperty, MinProperty, PropertyGraph, SumProperty, WindowSpec,
)
from tessella.sources import triples_from_rows

from .graphs import E_KIND, V_KIND, at, demo_rows, unit_rows

T1, T2 = "2021-04-27 08:21:09.999", "2021-04-27 08:21:19.999"


@pytest.fixture(scope="module")
def unit(spark):
    return PropertyGraph.from_triples(triples_from_rows(spark, unit_rows(), V_KIND, E_KIND))


@pytest.fixture(scope="module")
def demo(spark):
    return PropertyGraph.from_triples(triples_from_rows(spark, demo_rows(), V_KIND, E_KIND))


def by_label(**more):
    return GroupingSpec((LABEL,), (SumProperty("Size"),), (LABEL,), (SumProperty("Weight"),), WindowSpec(10), **more)


def everything():
    return GroupingSpec((), (Count(),), (), (Count(),), WindowSpec(60))


def stamp(c="event_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


# The steps, for grouping by label and for grouping everything.


@pytest.mark.parametrize("spec", [by_label(), everything()])
def test_dedup_keeps_distinct_elements(unit, spec):
    op = GraphGrouping(spec)
    assert op.dedup_vertices(unit).count() == 8 and op.dedup_edges(unit).count() == 8
    assert unit.vertices.count() == 16


@pytest.mark.parametrize(("spec", "columns"), [(by_label(), ["vertex_id", "__t", "__label", "__a0", "__super"]), (everything(), ["vertex_id", "__t", "__label", "__super"])])
def test_prepared_vertices(unit, spec, columns):
    out = GraphGrouping(spec).prepare_vertices(GraphGrouping(spec).dedup_vertices(unit))
    assert out.columns == columns
    assert {r[0] for r in out.select("__label").distinct().collect()} == ({"A", "B"} if len(columns) == 5 else {""})


def test_grouped_vertices_by_label(unit):
    v = unit.apply(GraphGrouping(by_label())).vertices
    got = {(r.t, r.vertex_label): r.s for r in v.select(stamp().alias("t"), "vertex_label", F.col("vertex_properties.sum_Size").alias("s")).collect()}
    assert got == {(T1, "A"): 45, (T1, "B"): 15, (T2, "A"): 30, (T2, "B"): 15}
    assert v.select("vertex_id").distinct().count() == 4


def test_grouped_vertices_of_everything(unit):
    (row,) = unit.apply(GraphGrouping(everything())).vertices.select("vertex_label", "vertex_properties", stamp().alias("t")).collect()
    assert row.vertex_label == "" and row.vertex_properties.asDict() == {"count": 8} and row.t == "2021-04-27 08:21:59.999"


def test_super_properties_are_typed(unit):
    g = unit.apply(GraphGrouping(by_label()))
    assert g.vertices.schema["vertex_properties"].dataType.simpleString() == "struct<sum_Size:bigint>"
    assert g.edges.schema["edge_properties"].dataType.simpleString() == "struct<sum_Weight:bigint>"


def test_mapping(unit):
    op = GraphGrouping(by_label())
    m = {r.vertex_id: r["__super"] for r in op.mapping(op.prepare_vertices(op.dedup_vertices(unit))).collect()}
    assert m["v1"] == m["v3"] and m["v2"] == m["v4"] and m["v5"] == m["v7"] and m["v6"] == m["v8"] and len(set(m.values())) == 4
    op = GraphGrouping(everything())
    assert len({r["__super"] for r in op.mapping(op.prepare_vertices(op.dedup_vertices(unit))).collect()}) == 1


def test_edges_follow_the_mapping(unit):
    op = GraphGrouping(by_label())
    mapping = op.mapping(op.prepare_vertices(op.dedup_vertices(unit)))
    m = {r.vertex_id: r["__super"] for r in mapping.collect()}
    out = op.attach_super_endpoints(op.dedup_edges(unit), mapping)
    got = {r.edge_id: (r.source_id, r.target_id) for r in out.collect()}
    assert got == {r[0]: (m[r[4][0]], m[r[5][0]]) for r in unit_rows()}
    assert op.prepare_edges(out).columns == ["edge_id", "source_id", "target_id", "__t", "__label", "__a0"]


def test_grouped_edges_by_label(unit):
    e = unit.apply(GraphGrouping(by_label())).edges
    got = {(r.t, r.edge_label): r.s for r in e.select(stamp().alias("t"), "edge_label", F.col("edge_properties.sum_Weight").alias("s")).collect()}
    assert got == {(T1, "impacts"): 6, (T1, "calculates"): 3, (T2, "impacts"): 12, (T2, "calculates"): 3}


def test_grouped_edges_of_everything(unit):
    (row,) = unit.apply(GraphGrouping(everything())).edges.collect()
    assert row.edge_label == "" and row.edge_properties.asDict() == {"count": 8} and row.source_id == row.target_id


def test_wide_window(unit):
    spec = GroupingSpec((LABEL,), (Count(), SumProperty("Size")), (LABEL,), (Count(), SumProperty("Weight")), WindowSpec(60))
    t = unit.apply(GraphGrouping(spec)).triples().collect()
    assert {(r.label, *r.properties, *r.source.vertex_properties, *r.target.vertex_properties) for r in t} == {("impacts", 6, 18, 4, 75, 4, 30), ("calculates", 2, 6, 4, 75, 4, 30)}


def test_demo_graph_without_the_edge_whose_vertices_come_later(demo):
    t = demo.group_by([LABEL], [Count()], [LABEL], [Count()]).triples().select(stamp().alias("t"), "label", "properties.count", "source", "target").collect()
    assert {(r.t, r.label, r["count"]) for r in t} == {(T1, "impacts", 3), (T1, "calculates", 1), (T2, "impacts", 3), (T2, "calculates", 1)}
    assert all(r.source.vertex_label == "A" and r.target.vertex_label == "B" for r in t)  # the natural direction


# Decided semantics.


def make(spark, rows, v="a INT, b STRING", e="x DOUBLE"):
    return PropertyGraph.from_triples(triples_from_rows(spark, rows, v, e))


def test_missing_property_is_one_group_with_null(unit):
    v = unit.group_by(["Weekday"], [Count()], window=WindowSpec(60)).vertices
    assert {(r.vertex_properties.Weekday, r.vertex_properties["count"]) for r in v.collect()} == {("Monday", 4), ("Thursday", 2), (None, 2)}
    g = unit.group_by(["Weekday", "nowhere"], [Count()], window=WindowSpec(60))
    assert g.vertices.count() == 3 and g.triples().agg(F.count("*")).first()[0] > 0


def test_aggregates_of_zeros_negatives_and_nothing(spark):
    p = lambda i, a: (f"v{i}", "L" if a is not None else "N", (a, None), at(0))
    rows = [(f"e{i}", at(0), "E", (None,), p(i, a), p(i, a)) for i, a in enumerate([0, 0, -5, -7, None])]
    v = make(spark, rows).group_by([LABEL], [SumProperty("a"), MaxProperty("a"), MinProperty("a"), AvgProperty("a"), Count()]).vertices
    got = {r.vertex_label: tuple(r.vertex_properties) for r in v.collect()}
    assert got == {"L": (-12, 0, -7, -3.0, 4), "N": (None, None, None, None, 1)}


def test_versions_and_labels_of_a_vertex(spark):
    a, a2, other, b = ("a", "L", (1, None), at(0)), ("a", "L", (2, None), at(0)), ("a", "M", (1, None), at(0)), ("b", "L", (9, None), at(0))
    rows = [("e1", at(0), "E", (1.0,), a, b), ("e2", at(0), "E", (2.0,), a2, b)]
    count = lambda rows, **o: sorted((r.source.vertex_label, r.properties["count"], r.source.vertex_properties["count"]) for r in make(spark, rows).group_by([LABEL], [Count()], [LABEL], [Count()], **o).triples().collect())
    assert count(rows) == [("L", 2, 3)]
    assert count(rows, mapping="bag") == [("L", 4, 3)]
    assert count([*rows, ("e3", at(0), "E", (3.0,), other, b)]) == [("L", 3, 3), ("M", 3, 1)]  # fan-out to both super vertices


def test_duplicates_within_and_across_windows(spark):
    a, b = ("a", "L", (1, None), at(0)), ("b", "L", (1, None), at(0))
    row = ("e", at(0), "E", (1.0,), a, b)
    late = ("e", at(10_000), "E", (1.0,), (*a[:3], at(10_000)), (*b[:3], at(10_000)))
    t = make(spark, [row, row, late]).group_by([LABEL], [Count()], [LABEL], [Count()]).triples()
    assert sorted(r.properties["count"] for r in t.collect()) == [1, 1]
    assert make(spark, [row, row]).group_by([LABEL], (), [], [Count()], unique_edges=True).triples().first().properties["count"] == 2


def test_window_boundaries_self_loops_dots_and_empty(spark):
    v = lambda i, label, ms: (i, label, (None, "x.y"), at(ms))
    rows = [("e1", at(9999), "E", (None,), v("a", "p.q", 9999), v("a", "p.q", 9999)), ("e2", at(10_000), "E", (None,), v("a", "p.q", 10_000), v("a", "p.q", 10_000))]
    g = make(spark, rows).group_by([LABEL, "b"], [Count()], [LABEL], [Count()])
    assert g.triples().select(F.unix_millis("event_time")).distinct().count() == 2
    assert g.vertices.select("vertex_id").distinct().count() == 2
    assert make(spark, []).group_by([LABEL], [Count()]).triples().count() == 0


def test_ids_tell_nulls_apart(spark):
    rows = [("e", at(0), "E", (None,), ("a", "L", (None, "1"), at(0)), ("b", "L", (1, None), at(0)))]
    spec = lambda scheme: GroupingSpec(("a", "b"), (Count(),), (), (), id_scheme=scheme)
    assert make(spark, rows).apply(GraphGrouping(spec("escaped"))).vertices.select("vertex_id").distinct().count() == 2
    assert make(spark, rows).apply(GraphGrouping(spec("plain"))).vertices.select("vertex_id").distinct().count() == 1


def test_chained_custom_and_join_free(unit):
    spread = CustomAggregate("spread", lambda v: F.max(v) - F.min(v), "Size")
    g = unit.group_by([LABEL], [spread, Count()], [LABEL], [Count()])
    assert {r.vertex_properties.spread for r in g.vertices.collect()} == {15, 5, 0}
    again = g.group_by([], [SumProperty("count", "all")], [], [SumProperty("count", "all")], WindowSpec(1, "hours")).triples().first()
    assert again.properties["all"] == 8 and again.source.vertex_properties["all"] == 8
    plain = lambda g: sorted((r.label, r.properties["count"], str(r.event_time), r.source.vertex_id, r.target.vertex_id) for r in g.triples().collect())
    args = ([LABEL], [Count()], [LABEL], [Count()])
    assert plain(unit.group_by(*args)) == plain(unit.group_by(*args, consistent_vertices=True))
    with pytest.raises(ValueError):
        unit.group_by(*args).group_by(*args, consistent_vertices=True)


def test_builder_and_checks(unit):
    built = GroupingBuilder().add_vertex_grouping_key(LABEL).add_vertex_grouping_keys(["Weekday"]).add_edge_grouping_keys([LABEL]).add_vertex_aggregate(Count())
    built = built.add_edge_aggregate(MinProperty("Weight")).set_window_size(1, "minutes").options(unique_edges=True)
    spec = built.spec()
    assert spec.properties("vertex") == ["Weekday"] and spec.by_label("edge") and spec.window.interval == "1 minutes" and spec.unique_edges
    assert unit.apply(built.build()).vertices.count() == 3  # A Monday, B Thursday, B without
    for wrong in (
        lambda: GroupingBuilder().add_vertex_grouping_key(None), lambda: WindowSpec(0), lambda: WindowSpec(5, "weeks"), lambda: WindowSpec(True),
        lambda: GroupingSpec((LABEL, LABEL)), lambda: GroupingSpec(vertex_aggregates=(Count("x"), SumProperty("a", "x"))), lambda: GroupingSpec(("count",), (Count(),)),
        lambda: SumProperty(""), lambda: Count(""), lambda: GroupingSpec(("",)), lambda: unit.group_by(None), lambda: GroupingSpec(mapping="set"), lambda: GroupingSpec(id_scheme="md5"),
    ):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        GroupingSpec(vertex_aggregates=("count",))


def test_map_properties(spark):
    rows = [(f"e{i}", at(0), "E", {"x": str(i)}, ("a", "L", {"n": "10"}, at(0)), ("b", "L", {"n": "9"}, at(0))) for i in range(12)]
    g = make(spark, rows, "map<string,string>", "map<string,string>")
    t = g.group_by([LABEL], [MaxProperty("n")], [], [MaxProperty("x"), SumProperty("x")], property_types={"n": "int", "x": "int"}).triples().first()
    assert tuple(t.properties) == (11, 66) and t.source.vertex_properties.max_n == 10


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(12)
    for _ in range(3):
        draw = lambda ms: (f"v{rng.randint(0, 9)}", rng.choice("AB"), (rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])), at(ms))
        rows = []
        for i in range(60):
            ms = rng.randint(0, 30_000)
            rows.append((f"e{i}", at(ms), rng.choice("EF"), (float(rng.randint(-3, 3)),), draw(ms + rng.choice([0, 0, 4000])), draw(ms)))
        rows += rng.sample(rows, 10)
        keys, edge_keys = ([LABEL, "b"], [LABEL])
        window = lambda t: int(t.timestamp() * 1000) // 10_000
        vertices = {(window(v[3]), v[0], v[1], v[2]) for r in rows for v in (r[4], r[5])}
        groups = defaultdict(list)
        mapping = defaultdict(set)
        for w, i, label, p in vertices:
            groups[w, label, p[1]].append(p[0])
            mapping[w, i].add((label, p[1]))
        edges = {(window(r[1]), r[0], r[2], r[3], r[4][0], r[5][0]) for r in rows}
        grouped = defaultdict(list)
        for w, _, label, p, s, t in edges:
            for a in mapping[w, s]:
                for b in mapping[w, t]:
                    grouped[w, label, a, b].append(p[0])
        total = lambda x: sum(y for y in x if y is not None) if any(y is not None for y in x) else None
        want = sorted(str((w, label, a, b, len(x), sum(x), len(groups[w, *a]), total(groups[w, *b]))) for (w, label, a, b), x in grouped.items())
        out = make(spark, rows).group_by(keys, [Count(), SumProperty("a")], edge_keys, [Count(), SumProperty("x")]).triples().collect()
        end = lambda v: (v.vertex_label, v.vertex_properties.b)
        got = sorted(str((window(r.event_time.astimezone()), r.label, end(r.source), end(r.target), r.properties["count"], r.properties.sum_x, r.source.vertex_properties["count"], r.target.vertex_properties.sum_a)) for r in out)
        assert got == want


def test_computed_keys(demo):
    """Keys made of label and properties, also through the builder, with the vertices written and without the join."""
    size = GroupingKey("big", lambda label, value: F.coalesce(value("Size") > 12, F.lit(False)))
    both = GroupingKey("what", lambda label, value: F.concat(F.lower(label), F.coalesce(value("Weekday"), F.lit("-"))))
    spec = GroupingSpec((LABEL, size), (Count(),), (both,), (Count(),), WindowSpec(10))
    shown = lambda g: sorted((r.source.vertex_label, r.source.vertex_properties.big, r.properties.what, r.properties["count"], r.target.vertex_properties.big) for r in g.triples().collect())
    got = shown(demo.apply(GraphGrouping(spec)))
    built = GroupingBuilder().add_vertex_grouping_key(LABEL).add_vertex_grouping_key(size).add_vertex_aggregate(Count()).add_edge_grouping_keys([both]).add_edge_aggregate(Count()).set_window_size(10)
    assert got == shown(demo.apply(built.build())) == shown(demo.apply(GraphGrouping(GroupingSpec((LABEL, size), (Count(),), (both,), (Count(),), WindowSpec(10), write_vertices=True))))
    plain = GroupingSpec((LABEL, size), (Count(),), (both,), (Count(),), WindowSpec(10), consistent_vertices=True)
    assert {x[:3] for x in shown(demo.apply(GraphGrouping(plain)))} <= {x[:3] for x in got}
    assert {x[1] for x in got} <= {True, False} and all(x[2].startswith(("impacts", "calculates")) for x in got)
    with pytest.raises(ValueError):
        GroupingSpec((size, "big"))
