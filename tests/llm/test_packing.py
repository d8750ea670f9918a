"""Packing against the tokenizer itself and against the bound that token counts give."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import packing
from tessella.llm.queries import tokenizer_path

TEXTS = ["", None, "Hello, world's END 12,3", "a b\x1cć ́d\x85e f \x0b\x0c g", "É ß ÑANDÚ ό ΣΑΣ ς", "x" * 9000, "w " * 9000, "<|endoftext|> it's 日本 語"]


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(8)
    letters = [chr(c) for c in range(32, 0x300) if not 0x7F <= c < 0xA0] + list("\u0301\u030c\u0345\u1e9e\u2126\u212bﬁĲ日本کا\U0001d400") + list("'s'tdmrel.,!?…") * 9
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["J\u030c j\u030c Ĵ İ I\u0307 don't DON'T l'été, L'ÉTÉ!! x'', can't've ª.º ²a a² «b».", "a.b,c.. 12.5 a1.,b", "e\u0301, É. \u00a0x\u00a0,"]
    assert e.ids([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert e.ids([None, b""]) == [b"", b""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (2, TEXTS[2], "again"), (2, TEXTS[2], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string")


def test_ids_and_places(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), capacity=256, keep_ids=True).toPandas()
    for i, text in enumerate(TEXTS):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        mine = got[got.doc_id == i].sort_values(["piece", "sequence_id"])
        if i != 2:
            assert [x for a in mine.ids for x in a] == want
            assert list(mine.start) == list(range(0, len(want), 256))
            assert list(mine.ids_crc32) == [zlib.crc32(np.array(want[a : a + 256], "<u4").tobytes()) for a in range(0, len(want), 256)]
    assert (got[got.doc_id == 2].piece == 0).sum() == 3 and got.doc_id.isna().sum() == 1
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(docs, tokenizer_path(), capacity=256, keep_ids=True)
    whole = packing.sequences(packed)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_empty(docs):
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 512): rng.randint(1, 40) for _ in range(rng.randint(1, 300))}
    places, n = packing.plan(counts, 512)
    filled: dict[int, list] = {}
    seen = {k: 0 for k in counts}
    for length, a, b, first, offset in places.tolist():
        assert a == seen[length]
        seen[length] = b
        for k in range(b - a):
            filled.setdefault(first + k, []).append((offset, length))
    assert seen == counts and len(filled) == n
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 512
    bins: list[int] = []
    for k in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= k), None)
        if at is None:
            bins.append(512 - k)
        else:
            bins[at] -= k
    assert -(-sum(k * c for k, c in counts.items()) // 512) <= n <= len(bins) + 1


def plainly(counts, capacity):
    """Best two fit with lists of pieces, one bin and one piece at a time."""
    left = sorted(n for n, c in counts.items() for _ in range(c))
    short, bins = capacity // 6, []

    def fill(items, least):
        while ok := [n for n in left if least < n <= capacity - sum(items)]:
            items.append(ok[-1])
            left.remove(ok[-1])

    while left:
        items = []
        fill(items, short)
        if items and sum(items) < capacity:
            room = capacity - sum(items) + items[-1]
            pairs = [(a + b, min(a, b)) for i, a in enumerate(left) for b in left[:i] if min(a, b) > short and a + b <= room]
            if pairs and max(pairs)[0] > items[-1]:
                total = max(pairs)[0]
                small = min(b for t, b in pairs if t == total)
                given = items.pop()
                left.remove(small)
                left.remove(total - small)
                left = sorted([*left, given])
                items = sorted([*items, small, total - small], reverse=True)
        fill(items, 0)
        bins.append(sorted(items))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_against_a_plain_version(seed):
    rng = random.Random(100 + seed)
    counts = {rng.randint(1, 64 if seed % 2 else 20): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}
    places, n = packing.plan(counts, 64)
    filled = [[] for _ in range(n)]
    for length, a, b, first, _ in places.tolist():
        for k in range(b - a):
            filled[first + k].append(length)
    assert sorted(map(sorted, filled)) == sorted(plainly(counts, 64))


def test_equal_rows_are_spread(spark):
    """30,000 equal rows without id: each has its place."""
    df = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack(df, tokenizer_path(), capacity=64)
    n = got.first().length
    assert got.agg(F.count("*"), F.countDistinct("sequence_id", "offset"), F.countDistinct("sequence_id")).first()[:] == (30_000, 30_000, -(-30_000 // (64 // n)))


def test_two_replace_one():
    places, n = packing.plan({8: 1, 5: 1, 3: 2}, 14)  # 8 + 5 leaves 1; 3 + 3 fills the gap of 6
    assert {(x[0], x[3]) for x in places.tolist()} == {(8, 0), (3, 0), (5, 1)}
