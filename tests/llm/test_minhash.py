"""MinHash near-dedup against brute force over all pairs; signatures against their definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import minhash_dedup
from tessella.llm.components import components
from tessella.llm.common import Scratch


def sets_of(rows, width):
    low = lambda t: (t or "").encode().lower().split()
    out = []
    for _, t in rows:
        w = low(t)
        out.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (k, _) in enumerate(rows[:a]):
            m = len(sets[a] & sets[b])
            if None not in (i, k) and sets[a] and sets[b] and 100 * m >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ñandú"]
    rows, n = [], 0
    for size in (4, 9, 30, 80, 80, 200):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(25):  # a chain of edits: neighbours are alike, ends aren't
            rows.append((n := n + 1, rng.choice([" ", "\n"]).join(base)))
            for _ in range(rng.randint(0, max(1, size // 40))):
                base[rng.randrange(size)] = rng.choice(vocab)
    rows += [(500 + i, rows[i][1].upper().replace("ñ", "Ñ") if i % 2 else rows[i][1]) for i in range(0, 60, 3)]
    rows += [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x y z " * 4000), (7, rows[6][1]), (7, rows[80][1]), (None, rows[3][1]), (None, rows[3][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, n string")
    got = minhash_dedup.near_duplicates(df, width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, width, percent)
    assert set(got[0].asDict()) == {"doc_id", "text", "n", "n_shingles", "component_id", "kept"}


def test_blocks_of_any_bounds(spark, monkeypatch):
    """Chains of edits, whose stars leave many components, in blocks of a few sets and shingles."""
    rng = random.Random(12)
    vocab, rows = [f"w{i}" for i in range(300)], []
    for n in (20, 40, 60):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(40):
            rows.append((len(rows), " ".join(base)))
            base = [w if rng.random() > 0.02 else rng.choice(vocab) for w in base]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, c) for i, _, c, _ in brute(rows, 3, 85)]
    for block, most, wide in ((200_000, 1024, 8192), (90, 1024, 8192), (200_000, 3, 8192), (200_000, 1024, 5)):
        monkeypatch.setattr(minhash_dedup, "WIDE", wide)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "ROWS", most)
        assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(df, width=3, percent=85).collect()) == sorted(want)


def test_common_phrases_dont_meet(spark, monkeypatch):
    """50,000 documents of two shingles that share one, and as many that share a phrase: no blocks for either."""
    compared = []
    put = Scratch.put

    def spy(self, df):
        out = put(self, df)
        if "oc" in df.columns:
            compared.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", spy)
    tiny = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one common phrase "), "id").alias("text"))
    phrase = F.lit(" that very many of the documents here share by chance ")
    long = spark.range(50_000, 70_000).select(F.col("id").alias("doc_id"), F.concat(F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)) for i in range(5)]), phrase).alias("text"))
    big = " ".join(f"v{i * i % 9973}" for i in range(200_000))
    some = spark.createDataFrame([(90_000, big), (90_001, big + " end"), (90_002, big[: len(big) // 2])], "doc_id long, text string")
    out = minhash_dedup.near_duplicates(tiny.union(long).union(some), width=3, percent=85)
    moved = {r.doc_id: r.component_id for r in out.where("doc_id <> component_id").collect()}
    assert moved in ({90_001: 90_000}, {90_001: 90_000, 90_002: 90_000}) and out.count() == 70_003
    assert sum(compared) < 100


def test_a_block_fits_in_memory():
    """The largest block that the bounds allow: 1024 sets of 195 shingles a side, most of them shared."""
    import resource
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(4000, 195, replace=False)).astype(np.int64) for _ in range(2048)]
    block = pa.table({"side": [i < 1024 for i in range(2048)], "comp": pa.array(range(2048), pa.int64()), "s": pa.array(sets, pa.list_(pa.int64()))})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = minhash_dedup._compare(2)(block)
    assert got.num_rows and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_empty(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_takes_the_least_of_each_bin_and_fills_the_others():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 3, 50, 2000)] + [np.zeros(0, np.uint64)]
    sig = minhash_dedup.signatures(sets, 40, minhash_dedup.jumps(40, 64))
    for s, row in zip(sets[:-1], sig, strict=False):
        own = {}
        for v in s.tolist():
            b = (v >> 32) * 40 >> 32
            own[b] = min(own.get(b, v), v)
        assert all(row[b] == v for b, v in own.items()) and set(row.tolist()) <= set(own.values())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
