"""Sources, printable forms, sinks, and that a stream gives what a batch does."""

import json

import pytest
from pyspark.sql import functions as F

from tessella import LABEL, Count, GraphConfig, GraphOperator, PropertyGraph, SumProperty, WindowSpec
from tessella.functions.ids import equal_without_id
from tessella.sources import random_stream, random_triples, read_trips, read_tweets, triples_from_rows, trips_to_triples, tweets_to_triples
from tessella.streaming import drain

from .graphs import E_KIND, V_KIND, demo_rows

HEADER = "tripduration,starttime,stoptime,ssid,ssname,sslat,sslong,esid,esname,eslat,eslong,bikeid,usertype,birth year,gender"
TRIPS = [
    '634,2013-06-01 12:00:00,2013-06-01 12:10:34,444,Broadway,40.7,-73.9,434,9 Ave,40.74,-74.0,19678,Subscriber,1983,1',
    '1547,2013-06-01 00:00:08,2013-06-01 00:25:55,444,Broadway,40.7,-73.9,406,Hicks St,NULL,null,16649,Customer,NULL,0',
    '5,bad,not a time,1,A,1,1,2,B,2,2,3,Customer,NULL,0',
]


def test_trips(spark, tmp_path):
    (tmp_path / "trips.csv").write_text("\n".join([HEADER, *TRIPS]))
    t = trips_to_triples(read_trips(spark, str(tmp_path))).orderBy("event_time").collect()
    assert len(t) == 2
    assert t[0].properties["birth year"] is None and t[0].target.vertex_properties.asDict() == {"name": "Hicks St", "lat": None, "long": None}
    assert t[1].event_time.strftime("%H:%M:%S") in ("12:10:34",) or t[1].properties.tripduration == 634  # noon is no midnight
    assert t[1].properties.gender == 1 and t[1].source.vertex_id == "444" and t[1].label == "trip" and len(t[1].id) == 32
    hours = trips_to_triples(read_trips(spark, str(tmp_path))).select(F.hour("event_time")).collect()
    assert sorted(r[0] for r in hours) == [0, 12]
    graph = PropertyGraph.from_triples(trips_to_triples(read_trips(spark, str(tmp_path))))
    assert graph.group_by([LABEL], [Count()], ["gender", LABEL], [Count()], WindowSpec(15, "days")).triples().count() == 2


def tweet(i, user, **more):
    t = {"id": i, "timestamp_ms": str(1_600_000_000_000 + i), "created_at": "Wed Oct 10 20:19:24 +0000 2018", "source": "web", "lang": "en"} | more
    return json.dumps(t | ({"user": {"id": user, "name": f"n{user}", "screen_name": "s", "location": None, "followers_count": 5, "friends_count": 1, "statuses_count": 2}} if user else {}))


def test_tweets(spark, tmp_path):
    lines = [tweet(1, 10, place={"name": "Bonn", "country": "Germany"}, coordinates={"coordinates": [7.1, 50.7]}), "", "{broken", tweet(2, None), tweet(3, 10, coordinates={"coordinates": [-74.0, 40.0]})]
    (tmp_path / "t.json").write_text("\n".join(lines))
    t = tweets_to_triples(read_tweets(spark, str(tmp_path))).orderBy("event_time").collect()
    assert [r.source.vertex_id for r in t] == ["1", "3"] and t[0].source.vertex_properties.country == "Germany" and t[0].target.vertex_properties.followers_count == 5
    assert t[0].properties.createdAt is not None and t[0].label == "createdByUser"
    assert [r.source.vertex_id for r in tweets_to_triples(read_tweets(spark, str(tmp_path)), (5.779, 47.205, 15.161, 55.076)).collect()] == ["1"]
    v = PropertyGraph.from_triples(tweets_to_triples(read_tweets(spark, str(tmp_path)))).group_by([LABEL, "country"], [Count()], window=WindowSpec(20)).vertices
    assert {(r.vertex_label, r.vertex_properties.country, r.vertex_properties["count"]) for r in v.collect()} == {("tweet", "Germany", 1), ("tweet", None, 1), ("user", None, 1)}


def test_random(spark):
    one, two = random_triples(spark, 500, seed=1), random_triples(spark, 500, seed=1)
    assert one.exceptAll(two).count() == 0 and random_triples(spark, 500, seed=2).exceptAll(one).count() == 500
    assert one.select("label").distinct().count() <= 10 and one.select(F.length("source.vertex_label")).distinct().collect()[0][0] == 3
    assert one.agg(F.max("event_time").cast("double") - F.min("event_time").cast("double")).first()[0] == pytest.approx(0.499)
    assert random_stream(spark, 5).isStreaming


def demo(spark):
    return PropertyGraph.from_triples(triples_from_rows(spark, demo_rows(), V_KIND, E_KIND))


def test_lines_sinks_and_operators(spark, tmp_path, capsys):
    g = demo(spark).group_by([LABEL], [SumProperty("Size")], [LABEL], [Count()])
    lines = [r.value for r in g.vertex_lines().collect()]
    assert any(x.endswith("(t:2021-04-27T08:21:09.999):A{sum_Size=45})") for x in lines)
    assert all(x.startswith("(") and ":impacts{count=" in x or ":calculates{count=" in x for x in (r.value for r in g.edge_lines().collect()))
    assert all(")-[t:2021" in r.value and "]->(" in r.value for r in g.triple_lines().collect())
    g.write_as_csv(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out_V")).count() == 4 and spark.read.text(str(tmp_path / "out_E")).count() == 4
    g.print()
    g.print_vertices()
    g.print_edges()
    assert isinstance(__import__("tessella").GraphGrouping(None), GraphOperator)

    class Only:
        def execute(self, graph):
            return PropertyGraph(graph.vertices.where("vertex_label = 'A'"), graph.edges.limit(0), graph.config)

    assert g.apply(Only()).vertices.count() == 2
    with pytest.raises(ValueError):
        PropertyGraph(g.edges, g.vertices)


def test_equality_without_ids(spark):
    v = demo(spark).vertices.where("vertex_id in ('v2', 'v6')").drop("event_time").distinct().withColumn("event_time", F.lit(0).cast("timestamp"))
    pair = v.select(F.struct("*").alias("a")).crossJoin(v.select(F.struct("*").alias("b")))
    assert pair.where(equal_without_id(F.col("a"), F.col("b"), "vertex")).count() == 4


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    rows = demo_rows()
    schema = triples_from_rows(spark, [], V_KIND, E_KIND).schema
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in/a"))
    shift = lambda c, s: F.col(c) + F.make_dt_interval(secs=F.lit(s).cast("decimal(18,6)"))
    last = spark.createDataFrame(rows[:1], schema).withColumns({"event_time": shift("event_time", 9999), "label": F.lit("end")})
    last = last.withColumns({e: F.col(e).withField("event_time", shift(f"{e}.event_time", 9999)) for e in ("source", "target")})
    last.write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    args = ([LABEL], [Count(), SumProperty("Size")], [LABEL], [Count()])
    flat = lambda t: t.select(F.unix_millis("event_time").alias("t"), "label", "properties.count", F.col("source.vertex_properties.sum_Size").alias("s"), F.col("target.vertex_properties.count").alias("n"))
    graph = PropertyGraph.from_triples(source, GraphConfig("5 seconds"))
    got = drain(flat(graph.group_by(*args).triples()), str(tmp_path / "out"), str(tmp_path / "state"))
    want = flat(demo(spark).group_by(*args).triples())
    assert sorted(map(tuple, got.where("label <> 'end'").collect())) == sorted(map(tuple, want.collect()))

    # A row far behind the watermark, which the first run left in the checkpoint, changes nothing.
    late = spark.createDataFrame([r for r in rows if r[0] == "e1"], schema).withColumn("id", F.lit("late"))
    late.write.parquet(str(tmp_path / "in/c"))
    again = drain(flat(PropertyGraph.from_triples(source, GraphConfig("5 seconds")).group_by(*args).triples()), str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.where("label <> 'end'").count() == 4


def test_stream_sinks(spark, tmp_path):
    schema = triples_from_rows(spark, [], V_KIND, E_KIND).schema
    spark.createDataFrame(demo_rows(), schema).write.parquet(str(tmp_path / "in"))
    graph = PropertyGraph.from_triples(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    with pytest.raises(ValueError):
        graph.write_as_csv(str(tmp_path / "out"))
    for q in graph.write_as_csv(str(tmp_path / "out"), str(tmp_path / "state"), trigger={"availableNow": True}):
        q.awaitTermination()
    assert spark.read.text(str(tmp_path / "out_E")).count() == 9
    q = graph.print_vertices(trigger={"availableNow": True})
    q.awaitTermination()
