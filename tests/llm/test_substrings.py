"""Substring dedup and rolling hashes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import substring_dedup
from tessella.llm.wordhash import BASES, rolling, sliding_min


def brute(rows, window):
    cut = lambda t: (t or "").encode().split()
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = cut(t)
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            if i is not None:
                first[p] = min(first.get(p, i), i)
    out = []
    for i, t in rows:
        w = cut(t)
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), sorted(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 6, 25])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    say = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice("a B é xx yy 1 2 3 4".split()) for _ in range(n))
    shared = [say(n) for n in (5, 6, 7, 30, 60, 200)]
    rows = [(i, " ".join([say(rng.randint(0, 40)), rng.choice(shared), say(rng.randint(0, 9)), rng.choice(shared)])) for i in range(70)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(3, rows[3][1]), (3, rows[9][1]), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "q w " * 3000), (204, "q w " * 3000 + "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    got = substring_dedup.dedup_substrings(df, window=window).collect()
    mine = [(r.doc_id, r.n_words, [x for s in r.removed for x in range(s.start, s.end)], r.kept_text) for r in got]
    assert sorted(mine, key=str) == brute(rows, window)
    for r in got:  # intervals are maximal
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert set(got[0].asDict()) == {"doc_id", "text", "id", "n_words", "removed", "kept_text"}


def test_empty(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_chunks():
    """A chunk of one short text, as the last of a batch or a table of one row may be, never fails a task."""
    for n in range(61):
        text = pa.array([" ".join(f"w{i}" for i in range(n)).encode()], pa.binary())
        one = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), text], ["id", "th", "text"])
        anchors = [b.column("anchor") for b in substring_dedup._anchors(50, 20)(iter([one]))]
        assert sum(map(len, anchors)) >= (n >= 50) and (n >= 50 or not sum(map(len, anchors)))
        marked = one.append_column("anchors", pa.array([[x for a in anchors for x in a.to_pylist()]], pa.list_(pa.int64())))
        assert sum(b.num_rows for b in substring_dedup._windows(50, 20)(iter([marked]))) == max(0, n - 49)
    for n in range(40):
        v = np.arange(n)[::-1]
        for w in (1, 2, 3, 8, 31):
            assert sliding_min(v, w).tolist() == [min(v[i : i + w]) for i in range(n - w + 1)]


@pytest.mark.parametrize("n", [42, 45, 48, 50])
def test_one_document(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    got = substring_dedup.dedup_substrings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.n_words, r.removed, r.kept_text) for r in got] == [(n, [], text)]


def test_hashes():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5, 300).astype(np.uint64)
    h = rolling(v, 7, BASES[0])
    same = {}
    for i in range(294):
        same.setdefault(tuple(v[i : i + 7].tolist()), set()).add(int(h[i]))
    assert all(len(x) == 1 for x in same.values()) and len(set(map(int, h))) == len(same)
    assert len(rolling(v[:3], 7, BASES[0])) == 0
    for w in (1, 2, 3, 8, 31):
        assert (sliding_min(v, w) == [min(v[i : i + w]) for i in range(301 - w)]).all()
