"""Embedding near-dedup against all cosines."""

import numpy as np

from tessella.llm import embedding_dedup


def test_against_all_cosines(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n := n + 1, (centre + rng.standard_normal(16) * rng.choice([0, 0.02, 0.08, 0.15])).astype("f4").tolist(), label))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [], 1)]
    rows += [(906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1), (908, [1e300] * 16, 2), (909, [1e-300] * 16, 2), (910, rows[0][1], 1), (911, rows[0][1], 2), (1, rows[0][1], 1)]
    rng.shuffle(rows)
    rows = [(int(a), b, None if c is None else int(c)) for a, b, c in rows]

    def unit(v, label):
        if label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v, label) for _, v, label in rows]
    near = [[i != k and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[k][2] and a @ b >= 0.98 for k, b in enumerate(units)] for i, a in enumerate(units)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i]] + [group[k] for k in range(len(rows)) if near[i][k]]) for i in range(len(rows))]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group}
    want = sorted((r[0], sum(x), least[g], least[g] == r[0]) for r, x, g in zip(rows, near, group, strict=True))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = embedding_dedup.near_vectors(df)
    assert set(got.columns) == {"vec_id", "embedding", "label", "n", "n_links", "component_id", "kept"}
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def planted(rng, clusters, size, dims, noise):
    """Clusters of vectors at cosines around the limit."""
    centres = rng.standard_normal((clusters, dims))
    return np.concatenate([c + rng.standard_normal((size, dims)) * noise * np.linalg.norm(c) / dims**0.5 for c in centres]).astype("f4")


def exact(x, labels):
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    return near & ~np.eye(len(x), dtype=bool)


def test_recall(spark):
    """Links found among dense planted vectors, most of them at cosines of 0.98 to 0.99: the share and the groups."""
    rng = np.random.default_rng(9)
    x = np.concatenate([planted(rng, 60, 12, 64, s) for s in (0.08, 0.11, 0.13, 0.14)])
    labels = rng.integers(0, 3, len(x) // 12).repeat(12)
    near = exact(x, labels)
    got = np.array([r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")).orderBy("vec_id").collect()])
    print("links", got.sum(), "of", near.sum())
    assert near.sum() > 10_000 and (got <= near.sum(axis=1)).all() and got.sum() >= 0.999 * near.sum()


def test_one_cluster_of_many_blocks(spark, monkeypatch):
    """A tight cluster that shares its buckets in many tables, and a loose one; blocks and slices of a few vectors."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "SLICE", 5)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 7)
    rng = np.random.default_rng(3)
    x = np.concatenate([planted(rng, 1, 90, 32, 0.005), planted(rng, 1, 60, 32, 0.12)])
    near = exact(x, np.zeros(len(x)))
    got = [(r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).orderBy("vec_id").collect()]
    assert [g[0] for g in got] == near.sum(axis=1).tolist() and all(g[1] == 0 for g in got[:90])


def test_vectors_without_ids_or_values(spark):
    """Many unusable rows without id are joined with nothing; a group without ids has a null component."""
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (None, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.unionByName(spark.range(5000).selectExpr("cast(null as long) as vec_id", "cast(null as array<double>) as embedding", "1 as label"))
    got = embedding_dedup.near_vectors(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, None, True, 2), (2, 7, False, 2), (2, 7, True, 1), (0, None, True, 5000)}


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    x = (centre + rng.standard_normal((60, 8)) * 0.05).astype("f4")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    want = ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = [r.n_links for r in embedding_dedup.near_vectors(df).orderBy("vec_id").collect()]
    assert sum(got) >= 0.99 * sum(want) and all(a <= b for a, b in zip(got, want, strict=True))
