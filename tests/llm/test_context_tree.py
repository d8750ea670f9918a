"""The context tree against a direct evaluation of its definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import context_tree


def brute(rows, depth):
    """log10 probability of each text: the recursion over nodes, straight from its definition, with exact block probabilities."""
    from collections import defaultdict

    steps = lambda b: [((1 << j) | (b >> (8 - j)), (b >> (7 - j)) & 1) for j in range(8)]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    pad = lambda t: bytes([255]) * depth + b" ".join((t or "").encode().lower().split()) + b"\xff"
    for text, train in rows:
        if train:
            s = pad(text)
            for i in range(depth, len(s)):
                for node, bit in steps(s[i]):
                    for d in range(depth + 1):
                        counts[s[i - d : i], node][bit] += 1
                        if d:
                            children[s[i - d + 1 : i], node].add(s[i - d : i])
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def pw(ctx, node):
        if (ctx, node) not in memo:
            own = pe(*counts[ctx, node])
            if len(ctx) < depth:
                longer = sum(pw(c, node) for c in children[ctx, node])
                m = max(own, longer)
                own = m + math.log(math.exp(own - m) + math.exp(longer - m)) - math.log(2)
            memo[ctx, node] = own
        return memo[ctx, node]

    def p(ctx, hist, node, bit):
        if (ctx, node) not in counts:
            return 0.5
        a = counts[ctx, node]
        kt = (a[bit] + 0.5) / (sum(a) + 1)
        if len(ctx) == depth:
            return kt
        stop = math.exp(pe(*a) - pw(ctx, node)) / 2
        return stop * kt + (1 - stop) * p(hist[len(hist) - len(ctx) - 1 :], hist, node, bit)

    out = []
    for text, _ in rows:
        s = pad(text)
        out.append(sum(math.log10(p(b"", s[i - depth : i], node, bit)) for i in range(depth, len(s)) for node, bit in steps(s[i])))
    return out


@pytest.mark.parametrize("depth", [1, 3])
def test_against_definition(spark, depth):
    rng = random.Random(depth)
    words = "the The of Ñu étre a, b.\n zz".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(30)] + ["", None, "日本", "x" * 500, "the"]
    rows = [(t, i % 7 != 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, tr, "z") for i, (t, tr) in enumerate(rows)] + [(None, "the of", True, "z"), (3, texts[3], True, "y")], "doc_id long, text string, train boolean, score string")
    rows += [("the of", True), (texts[3], True)]
    got = context_tree.score_documents(df, F.col("train"), depth=depth, block_bytes=200)
    assert got.columns == ["doc_id", "text", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    got = got.collect()
    want = brute(rows, depth)
    count, total = {}, 0
    for t, tr in rows:
        if tr:
            for w in [*(t or "").encode().lower().split(), None]:
                count[w] = count.get(w, 0) + 1
                total += 1
    expected = []
    for (t, _), s in zip(rows, want, strict=True):
        w = [*(t or "").encode().lower().split(), None]
        expected.append((t, len(w), sum(x in count for x in w), total, round(sum(math.log10((count.get(x, 0) + 1) / (total + len(count) + 1)) for x in w), 6), round(s, 2)))
    assert sorted(((r.text, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in got), key=str) == sorted(expected, key=str)


def test_packs_of_many_levels(spark, monkeypatch):
    """The same scores when packs are merged and priced over several levels, with equal rows folded or not."""
    rng = random.Random(2)
    words = "the of and étre a, b. zz".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["folded and folded again"] * 40
    df = spark.createDataFrame([(i if i < 60 else None, t, i % 7 != 2 or i >= 60) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    shown = lambda **o: sorted((str(r.doc_id), r.text, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in context_tree.score_documents(df, F.col("train"), depth=3, **o).collect())
    want = shown(block_bytes=1 << 20)
    monkeypatch.setattr(context_tree, "FAN", 2)
    assert shown(block_bytes=400) == want
    monkeypatch.setattr(context_tree, "COPIES", 10)
    assert shown(block_bytes=400) == want and len(want) == 100


def test_equal_rows_are_one(spark):
    """100,000 equal rows without id: counted by their number, scored once, returned each."""
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("ab ab").alias("text"))
    got = context_tree.score_documents(same.unionByName(spark.createDataFrame([(1, "ab")], "doc_id long, text string")), F.lit(True), block_bytes=1 << 16)
    rows = got.groupBy("doc_id", "n_tokens", "n_known", "train_tokens", "score").count().collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r["count"]) for r in rows} == {(None, 3, 3, 300_002, 100_000), (1, 2, 2, 300_002, 1)}
    # After "ab" at the start, 100,000 times a space and once the end.
    assert all(abs(r.score - (0 if r.doc_id is None else -5)) < 0.2 for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all 256 symbols behind a context, seen or not, at every depth."""
    depth, rng = 3, random.Random(6)
    texts = ["".join(rng.choice("abc d") for _ in range(30)).encode() for _ in range(8)]
    keys, _ = context_tree.contexts(texts, depth)
    count: dict[int, int] = {}
    for k in keys.tolist():
        count[k] = count.get(k, 0) + 1
    asked = sorted({k >> 8 for k in count})[::7] + [int.from_bytes(c, "big") for c in (b"abz", b"zzb", b"xyz")]
    rows = {c << 8 | s: 0 for c in asked for s in range(256)} | count
    df = spark.createDataFrame(list(rows.items()), "gram long, n long")
    got = {r.gram: r.lp for r in context_tree.weigh(df, depth, context_tree.Scratch(spark, "test")).collect()}
    sums = [sum(10 ** got[c << 8 | s] for s in range(256)) for c in asked]
    assert len(sums) > 10 and all(abs(x - 1) < 1e-5 for x in sums), sums


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "ab", False)], "doc_id long, text string, train boolean")
    r = context_tree.score_documents(df, F.col("train")).first()
    assert abs(r.bits_per_byte - 8) < 1e-5 and r.train_tokens == 0 and r.n_known == 0
    assert context_tree.score_documents(df.limit(0), F.col("train")).count() == 0
