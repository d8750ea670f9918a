"""Sharding, line dedup and decontamination against brute force."""

import contextlib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, line_dedup, sharding

SP = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["  A Line of some Length %d \t" % i for i in range(9)] + ["short", "É UNICODE line ÀB long enough", ""]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    return [*out, (60, ""), (61, None), (62, "\n\n"), (63, "x" * 300_000 + "\n" + pool[0]), (5, out[5][1]), (5, out[5][1]), (None, pool[1]), (None, pool[1])]


def test_shards(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, bucket string, shard int")
    got = sharding.external_shuffle(df, n_shards=7, bucket_bytes=900).toPandas()
    assert set(got.columns) == {"doc_id", "text", "bucket", "shard", "slot"} and len(got) == len(rows)
    counts = got.groupby("shard").slot.agg(["min", "max", "count", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    key = lambda t: (str(t[0]), str(t[1]))
    ids = [(None if x != x else int(x), t) for x, t in zip(got.doc_id, got.text, strict=True)]
    assert sorted(ids, key=key) == sorted(rows, key=key)
    order = got.sort_values(["slot", "shard"]).doc_id.fillna(-1).tolist()
    assert order != sorted(order)
    again = sharding.external_shuffle(df, n_shards=7, bucket_bytes=900).toPandas().sort_values(["slot", "shard"]).doc_id.fillna(-1).tolist()
    assert again == order
    assert sharding.external_shuffle(df.limit(0)).count() == 0


@contextlib.contextmanager
def settings(spark, **values):
    names = {"partitions": "spark.sql.shuffle.partitions", "adaptive": "spark.sql.adaptive.enabled", "broadcast": "spark.sql.autoBroadcastJoinThreshold", "split": "spark.sql.files.maxPartitionBytes"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], str(v))
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_order_under_any_plan(spark, tmp_path):
    """The same deal whatever the partitions, the splits of the input, adaptive plans and joins."""
    made = spark.range(6000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    made.repartition(5).write.parquet(str(tmp_path / "d"))
    orders = []
    for n, adaptive, broadcast, split in [(4, True, "10MB", "128MB"), (4, True, "10MB", "128MB"), (7, True, "10MB", "128MB"), (13, False, -1, "20KB"), (2, False, "10MB", "128MB"), (7, True, -1, "50KB")]:
        with settings(spark, partitions=n, adaptive=str(adaptive).lower(), broadcast=broadcast, split=split):
            got = sharding.external_shuffle(spark.read.parquet(str(tmp_path / "d")), bucket_bytes=3000)
            orders.append([r.doc_id for r in got.orderBy("slot", "shard").select("doc_id").collect()])
    assert len(orders[0]) == 6000 and all(o == orders[0] for o in orders)
    # As far from sorted as chance is: neighbours differ by a third of the range on average.
    assert abs(sum(abs(a - b) for a, b in zip(orders[0], orders[0][1:], strict=False)) / 5999 - 2000) < 150
    other = sharding.external_shuffle(spark.read.parquet(str(tmp_path / "d")), bucket_bytes=3000, seed=18)
    assert [r.doc_id for r in other.orderBy("slot", "shard").select("doc_id").collect()] != orders[0]


def test_equal_rows_are_dealt_apart(spark):
    """100,000 equal rows without id: each keeps a slot, no bucket and no task takes them all."""
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    df = same.unionByName(spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"), F.create_map(F.lit("k"), F.col("id").cast("int")).alias("m")))
    with settings(spark, partitions=16):
        got = sharding.external_shuffle(df, n_shards=8, bucket_bytes=100_000)
        assert got.agg(F.count("*"), F.countDistinct("shard", "slot"), F.max("slot"), F.count("doc_id"), F.countDistinct("m.k")).first()[:] == (150_000, 150_000, 18_749, 50_000, 50_000)
        share = got.groupBy("shard", F.floor(F.col("slot") / 1000)).agg(F.avg(F.col("doc_id").isNull().cast("double")).alias("s")).agg(F.min("s"), F.max("s")).first()
        assert 0.5 < share[0] < share[1] < 0.85


def test_write_shards(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = sharding.external_shuffle(df, n_shards=3, bucket_bytes=900)
    sharding.write_shards(dealt, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r.shard, r.slot, str(r.doc_id), str(r.text))
    assert sorted(map(key, back.collect())) == sorted(map(key, dealt.collect()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["shard=0", "shard=1", "shard=2"]
    for k in range(3):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={k}")).coalesce(1).collect()]
        assert slots == sorted(slots) == list(range(len(slots)))


def test_many_lines_of_one_text(spark):
    """200,000 dropped lines of one text take seconds, as do equal rows without id."""
    lines = [f"this line number {i} is in all of them" for i in range(200_000)]
    docs = [(i, "\n".join([f"own {i}", *lines, "end"])) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(lines[0]).alias("text")))
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.where("doc_id is not null").collect()}
    assert got == {0: (200_002, 200_000, "own 0\nend"), 1: (200_002, 200_000, "own 1\nend"), 2: (200_002, 0, docs[2][1])}
    assert out.where("doc_id is null and n_dropped = 0 and n_lines = 1").count() == 20_000


def test_lines(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, line string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(SP))
    held: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(low(line)) >= 20:
                held.setdefault(low(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or low(x) not in held or len(held[low(x)]) < 3 or max(held[low(x)]) <= i]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 120])
def test_leaks(spark, part_bytes):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("ab Cd é9 x-y".split()) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 4, 5, 12, 14, 10, 30])] + [(7, None), (8, ""), (9, "?!"), (None, say(11)), (5, "zz zz")]
    docs = [(i, say(rng.randint(0, 200)).replace(" ", rng.choice([" ", "\n", ", "]))) for i in range(40)]
    docs += [(40, items[6][1]), (41, "q " * 50 + items[3][1].upper().replace("É", "é") + " q"), (42, None), (43, ""), (44, "zz ZZ"), (None, items[6][1]), (1, docs[1][1])]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    want = []
    for i, t in docs:
        w, hit, of = cut(t), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    of |= ids
        want.append((i, len(w), sorted(hit), sorted(of)))
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, [x for s in r.hit_spans for x in range(s.start, s.end)], r.item_ids) for r in decontam.find_leaks(df, bench, part_bytes=part_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.find_leaks(df, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_repeated_items_are_one(spark):
    """A benchmark of one item 30,000 times is one item in one part."""
    item = "these ten words are a whole item of the benchmark"
    bench = spark.range(30_000).select(F.lit(1).alias("item_id"), F.lit(item).alias("text"))
    got = decontam.find_leaks(spark.createDataFrame([(1, "so " + item), (2, "no")], "doc_id long, text string"), bench, part_bytes=1000).orderBy("doc_id").collect()
    assert [(r.n_words, [tuple(s) for s in r.hit_spans], r.item_ids) for r in got] == [(11, [(1, 11)], ["1"]), (1, [], [])]
