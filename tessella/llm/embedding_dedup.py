"""Embedding near-dedup by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .wordhash import column, mix, signed

#: Vectors of one side of a block of comparisons, those multiplied at once, and pairs looked at together.
BLOCK, SLICE, PAIRS = 4096, 512, 100_000


def _hash(tables: int, projections: int, width: float, seed: int):
    """Normalised vectors with one bucket for each table: quantised random projections, hashed with label and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        salt, power = mix(np.arange(tables, dtype=np.uint64) + np.uint64(11)), mix(np.arange(projections, dtype=np.uint64) + np.uint64(13)) | np.uint64(1)
        for batch in batches:
            lists = column(batch, "v")
            values, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            dims, label = np.diff(ends), column(batch, "label").to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = values[ends[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                if d not in planes:
                    rng = np.random.default_rng([seed, d])
                    planes[d] = rng.standard_normal((d, tables * projections)), rng.uniform(0, width, tables * projections)
                a, b = planes[d]
                cell = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
                own = np.array([xxhash.xxh64_intdigest(f"{d}:{label[i]}") for i in at], np.uint64)
                sig = mix((mix(cell) * power).sum(axis=2, dtype=np.uint64) + salt + own[:, None])
                lists_of = lambda m, make: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), make(np.ascontiguousarray(m).reshape(-1)))
                keep = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[column(batch, c).take(keep) for c in ("k1", "k2", "n")], lists_of(x, pa.array), lists_of(sig, signed)], ["k1", "k2", "n", "v", "sig"])

    return run


def _block(least: float):
    """Cosines of a block. A pair counts in the first table that it shares, so each counts once; edges span the block's components."""

    def run(block: pa.Table) -> pa.Table:
        at = lambda c: block.column(c).combine_chunks()
        rows = block.num_rows
        n, chunk = at("n").to_numpy(), at("chunk").to_numpy()
        x, sig = at("v").flatten().to_numpy().reshape(rows, -1), at("sig").flatten().to_numpy().reshape(rows, -1)
        table, i, j = (at(c)[0].as_py() for c in ("t", "i", "j"))
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        links, root, a, b = np.zeros(rows, np.int64), list(range(rows)), [], []

        def find(y: int) -> int:
            while root[y] != y:
                root[y] = y = root[root[y]]
            return y

        for start in range(0, len(left), SLICE):
            part = left[start : start + SLICE]
            p, q = np.nonzero(x[part] @ x[right].T >= least)
            if i == j:
                p, q = p[p + start > q], q[p + start > q]
            for lo in range(0, len(p), PAIRS):
                l, r = part[p[lo : lo + PAIRS]], right[q[lo : lo + PAIRS]]  # noqa: E741
                new = ~(sig[l, :table] == sig[r, :table]).any(axis=1)
                l, r = l[new], r[new]  # noqa: E741
                links += np.bincount(l, n[r], rows).astype(np.int64) + np.bincount(r, n[l], rows).astype(np.int64)
                for u, w in zip(l.tolist(), r.tolist(), strict=True):
                    y, z = find(u), find(w)
                    if y != z:
                        root[y] = z
                        a.append(u)
                        b.append(w)
        m = np.flatnonzero(links)
        first, second = np.r_[m, np.array(a, np.int64)], np.r_[m, np.array(b, np.int64)]
        node = at("node")
        return pa.table({"a": node.take(pa.array(first)), "b": node.take(pa.array(second)), "links": np.r_[links[m], np.zeros(len(a), np.int64)]})

    return run


def near_vectors(
    df: DataFrame,
    least: float = 0.98,
    tables: int = 40,
    projections: int = 12,
    width: float = 1.2,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors of equal label whose cosine, in double precision, is ``least`` or more.

    Equal vectors form a class. A pair at distance c shares one of the ``projections`` cells of ``width`` with the
    p-stable probability p(c), so with the defaults a pair at cosine 0.98 (c = 0.2, p = 0.87) is missed by all tables with
    probability 4e-4, and closer pairs with less, while unrelated vectors (c = 1.4, p = 0.32) meet with 1e-6 a table. All
    pairs of a bucket are checked in blocks of ``BLOCK`` vectors a side, inside tasks: no bucket is cut and no list of pairs is
    made. Buckets of several tables with the same members, as a tight cluster has, are checked once.

    Returns the columns of ``df`` but those named ``n_links`` long, ``component_id`` and ``kept``, which are added. A
    vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links with nothing;
    vectors of different dimension don't link. Repeated rows are separate vectors; rows with
    equal ids are linked only by their vectors. A null id takes part in links; its component is the smallest id reached, null if none.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    kept = [c for c in df.columns if c not in ("n_links", "component_id", "kept")]
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & (F.size(v) > 0)
    usable &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keys = [F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.lit(s), F.col(label_col), v)) for s in (1, 2)]
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), keys[0].alias("k1"), keys[1].alias("k2"))
    rows = rows.where("k1 is not null")
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("label").alias("label"), F.min("v").alias("v"))
    # A class is known by its least id first, so that the least of a component's nodes holds the component's least id.
    node = F.struct(F.col("first").isNull().alias("none"), "first", "k1", "k2").alias("node")
    classes = scratch.put(classes.select(node, "k1", "k2", "n", "label", "v"))
    hashed = scratch.put(classes.select("k1", "k2", "n", "label", "v").mapInArrow(_hash(tables, projections, width, seed), "k1 long, k2 long, n long, v array<double>, sig array<long>"))

    spread = hashed.select("k1", "k2", F.posexplode("sig").alias("t", "bucket"))
    shared = spread.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("k1", "k2").cast("decimal(38,0)")).alias("who")).where("m > 1")
    shared = shared.groupBy("m", "who").agg(F.min(F.struct("t", "bucket")).alias("x"))
    shared = scratch.put(shared.select("x.t", "x.bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks")))
    members = spread.join(shared, ["t", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = scratch.put(cells.select("k1", "k2", "t", "bucket", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    named = hashed.join(classes.select("k1", "k2", "node"), ["k1", "k2"])
    blocks = cells.join(named, ["k1", "k2"]).groupBy("t", "bucket", "i", "j")
    kind = classes.schema["node"].dataType.simpleString()
    found = scratch.put(blocks.applyInArrow(_block(least), f"a {kind}, b {kind}, links long"))
    groups = scratch.put(components(found.where("links = 0").select("a", "b"), scratch))
    links = found.where("links > 0").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))

    per_class = classes.select("node", "n").join(groups.select(F.col("node").alias("in"), "component"), F.col("node") == F.col("in"), "left")
    per_class = per_class.join(links, F.col("node") == F.col("of"), "left")
    # A class without links has its own least id; a null one, as all ids of the class are null, stays null.
    component_id = F.coalesce(F.col("component.first"), F.col("node.first")).alias("component_id")
    per_class = per_class.select(F.col("node.k1").alias("c1"), F.col("node.k2").alias("c2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), component_id)
    per_class = scratch.put(per_class)
    scratch.drop_all_but(per_class)

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    docs = df.select(row, F.col(id_col).alias("id"), keys[0].alias("k1"), keys[1].alias("k2"))
    out = docs.where("k1 is not null").join(per_class, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    out = out.select("row", "id", "links", "component_id").unionByName(docs.where("k1 is null").select("row", "id", F.lit(0).alias("links"), F.col("id").alias("component_id")))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
