"""MinHash near-dedup: one-permutation hashing with optimal densification, bands and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .wordhash import BASES, WordHashes, column, distinct, mix, rolling, signed, spans, text_chunks

#: Shingles and sets of one side of a block of comparisons, and shingles compared in one matrix product.
BLOCK, ROWS, SLICE = 200_000, 1024, 8192
#: Open buckets of more sets that may be similar to others are compared by their rare shingles.
WIDE = 8 * ROWS


def jumps(bins: int, tries: int, seed: int = 1) -> np.ndarray:
    """Where an empty bin looks on each try: hashed, the same for all documents, never itself first."""
    grid = np.arange(bins, dtype=np.uint64)[None, :] + (np.arange(1, tries + 1, dtype=np.uint64) * np.uint64(1 << 20))[:, None]
    return ((mix(grid + np.uint64(seed << 50)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int, table: np.ndarray) -> np.ndarray:
    """One-permutation signatures of sorted, distinct hashes; an empty bin takes the value of the bin that its hashed jumps meet first."""
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, u in enumerate(sets):
        at = ((u >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(u), bool)
        first[1:] = at[1:] != at[:-1]
        sig[i, at[first]] = u[first]  # sorted hashes: the first of a bin is its least
        full[i, at[first]] = True
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(len(table)):
        to = table[t, col]
        ok = full[row, to]
        sig[row[ok], col[ok]] = sig[row[ok], to[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):  # next full bin, after so many tries
        filled = np.flatnonzero(full[r])
        sig[r, c] = sig[r, filled[np.searchsorted(filled, c) % len(filled)]]
    return sig


def shingle_sets(words: list[list[bytes]], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each document; a short document is one shingle, an empty one has none."""
    row, inside = spans(words, width)
    values = hashes.of(words)
    all_of = rolling(values, width, BASES[0])
    at = np.searchsorted(row, np.arange(len(words) + 1))
    out = []
    for i, w in enumerate(words):
        lo = at[i]
        if len(w) >= width:
            out.append(distinct(all_of[lo : lo + len(w) - width + 1]))
        else:
            out.append(rolling(values[lo : lo + len(w)], len(w), BASES[1]) if w else np.zeros(0, np.uint64))
    return out


def _profile(width: int, bands: int, rows: int):
    """Set size, 128-bit set key and band hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), jumps(bands * rows, 64)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        power = mix(np.arange(rows, dtype=np.uint64) + np.uint64(999)) | np.uint64(1)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for a, b in text_chunks(texts):
                sets = shingle_sets([(t or b"").lower().split() for t in texts[a:b]], hashes, width)
                sig = signatures(sets, bands * rows, table).reshape(len(sets), bands, rows)
                band = mix((sig * power).sum(axis=2, dtype=np.uint64) + salt)
                keys = [[int((mix(s ^ np.uint64(k))).sum(dtype=np.uint64)) if len(s) else 0 for s in sets] for k in (3, 5)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), signed(np.ascontiguousarray(band).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, c).slice(a, b - a) for c in ("id", "th")], pa.array([len(s) for s in sets], pa.int64()), *[signed(np.array(k, np.uint64)) for k in keys], lists],
                    ["id", "th", "n", "k1", "k2", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for a, b in text_chunks(texts):
                sets = shingle_sets([(t or b"").lower().split() for t in texts[a:b]], hashes, width)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(a, b - a), lists], ["id", "s"])

    return run


def _counts(width: int, names: list[str]):
    """The size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = column(batch, "__text").to_pylist()
            sizes = [len(x) for a, b in text_chunks(texts) for x in shingle_sets([(t or b"").lower().split() for t in texts[a:b]], hashes, width)]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(sizes, pa.int64())], [*names, "n"])

    return run


def _compare(percent: int):
    """Exact similarity of every row of one side with every row of the other; pairs of components that a link joins."""

    def run(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy().astype(bool)
        comp = block.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        lists = block.column("s").combine_chunks()
        values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        place = np.zeros(len(sizes), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        vocab, word = np.unique(values, return_inverse=True)
        here = side[row]
        both = (np.bincount(word[here], minlength=len(vocab)) > 0) & (np.bincount(word[~here], minlength=len(vocab)) > 0)
        ids = np.where(both, np.cumsum(both) - 1, -1)[word]
        order = np.argsort(ids, kind="stable")
        ids, row, here = ids[order], row[order], here[order]
        meet = np.zeros((len(left), len(right)), np.int32)
        for lo in range(0, int(both.sum()), SLICE):
            a, b = np.searchsorted(ids, (lo, lo + SLICE))
            grids = [np.zeros((len(x), SLICE), np.float32) for x in (left, right)]
            for grid, mine in zip(grids, (here[a:b], ~here[a:b]), strict=True):
                grid[place[row[a:b][mine]], ids[a:b][mine] - lo] = 1
            meet += (grids[0] @ grids[1].T).astype(np.int32)  # whole numbers of at most SLICE, exact
        # 100 * meet >= percent * union, in whole numbers
        good = (100 + percent) * meet.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right][None, :])
        good &= comp[left][:, None] != comp[right][None, :]
        root = list(range(int(comp.max(initial=-1)) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out_a, out_b = [], []
        for i, k in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            x, y = find(int(comp[left[i]])), find(int(comp[right[k]]))
            if x != y:
                root[x] = y
                out_a.append(left[i])
                out_b.append(right[k])
        of = block.column("comp").combine_chunks()
        return pa.table({"a": of.take(pa.array(out_a, pa.int64())), "b": of.take(pa.array(out_b, pa.int64()))})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets have Jaccard similarity of ``percent`` hundredths or more."""
    left = pairs.join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y")
    both = left.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x")
    meet = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - meet
    return both.where(F.lit(100) * meet >= F.lit(percent) * union).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _rare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, comp): the rarest shingles of each set, as many as two similar sets can't both do without.

    Similar sets share ``percent`` hundredths of either, so the n - ceil(n * percent / 100) + 1 first shingles of each, in one
    order of all shingles, have one in common. In the order from the rarest to the commonest among ``members`` a phrase
    that many share brings none of them together. Shingles of one component alone are left out.
    """
    own = members.join(sets, members["rep"] == sets["id"]).select("rep", "comp", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("sid"), "s")
    each = own.select("rep", "comp", "n", "sid", F.explode("s").alias("g"))
    held = each.groupBy("g").agg(F.count(F.lit(1)).alias("d"), (F.min("comp") < F.max("comp")).alias("live"))
    first = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")
    order = each.join(held, "g").groupBy("rep", "comp", "n", "sid").agg(F.array_sort(F.collect_list(F.struct("d", "g", "live"))).alias("gs"))
    return order.select("rep", "n", "comp", F.explode(F.slice("gs", F.lit(1), first)).alias("x")).where("x.live").select(F.col("x.g").alias("token"), "rep", "n", "comp")


def near_duplicates(
    df: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 25,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Equal sets form a class, known by a 128-bit key; its least id stands for it. One-permutation signatures of
    ``bands`` x ``rows`` bins put representatives into buckets (a pair at 0.8 is missed by all 25 bands of 5 with
    probability 5e-5, at 0.85 with 4e-7); sets too small to be similar to any other set stay out. In a bucket candidates form
    a star around its least id; every candidate is confirmed on full sets. Where that leaves a bucket in several
    components, those of its members that share a rare shingle with another component (``_rare``) are compared on full sets, those
    outside the largest component with all, in blocks bounded in sets and shingles, so the stars lose no component. A bucket with more
    than ``WIDE`` such members is compared by rare shingles, in place of as a whole.

    Returns the columns of ``df`` but those named ``n_shingles`` long, ``component_id`` and ``kept``, which are added.
    A document without words has an empty set and is linked with nothing; one with fewer words than a shingle is one
    shingle. Rows that share an id are one document for links. A row with a null id is linked with nothing, has a null
    component and is kept.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    added = ("n_shingles", "component_id", "kept")
    kept = [c for c in df.columns if c not in added]
    kind = df.schema[id_col].dataType.simpleString()
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = df.select(F.col(id_col).alias("id"), text_key.alias("th"), F.col(text_col).cast("binary").alias("text"))
    profile = scratch.put(texts.mapInArrow(_profile(width, bands, rows), f"id {kind}, th long, n long, k1 long, k2 long, bands array<long>"))
    of_class = F.min(F.struct("id", "bands", "n"))
    classes = profile.where("id is not null and n > 0").groupBy("n", "k1", "k2").agg(of_class.alias("m"))
    classes = scratch.put(classes.select("n", "k1", "k2", F.col("m.id").alias("rep"), F.col("m.bands").alias("bands")))

    member = profile.where("id is not null and n > 0").select("id", "n", "k1", "k2").distinct().join(classes.drop("bands"), ["n", "k1", "k2"])
    member = scratch.put(member.select("id", "rep"))
    # An id with several texts joins their classes.
    several = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id")
    tied = member.join(scratch.put(several), "id").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # The next larger set is the most similar other one that a set of n can have.
    banded = classes.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n") + 1)).select("rep", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hubs = scratch.put(hubs.select("band", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n")))
    buckets = scratch.put(banded.join(hubs, "band"))
    # Sets of such different sizes can't be similar enough.
    fits = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    pairs = buckets.where((F.col("rep") > F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("x"), F.col("rep").alias("y")).distinct()
    pairs = scratch.put(pairs)
    members = buckets.select(F.col("rep").alias("id")).distinct()
    mine = texts.join(members, "id").dropDuplicates(["id", "th"])
    sets = scratch.put(mine.mapInArrow(_sets(width), f"id {kind}, s array<long>").where(F.size("s") > 0))
    links = scratch.put(_verified(pairs, sets, percent).unionByName(tied))
    groups = scratch.put(components(links, scratch))

    # Buckets that their stars left in several components.
    labelled = buckets.where("rep <> hub").join(groups, F.col("rep") == F.col("node"), "left")
    labelled = scratch.put(labelled.select("band", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    open_bands = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    inside = scratch.put(labelled.join(open_bands, "band"))
    rare = scratch.put(_rare(inside.select("rep", "comp").distinct(), sets, percent))
    near = scratch.put(inside.join(rare.select("rep").distinct(), "rep", "left_semi"))
    wide = scratch.put(near.groupBy("band").agg((F.count(F.lit(1)) > WIDE).alias("wide"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "wide"))
    whole = near.join(wide.where("not wide"), "band").select(F.lit(0).alias("by"), F.col("band").alias("key"), "rep", "n", "comp")
    split = near.join(wide.where("wide"), "band").select("rep").distinct()
    split = rare.join(split, "rep").select(F.lit(1).alias("by"), F.col("token").alias("key"), "rep", "n", "comp")
    placed = scratch.put(whole.unionByName(split))
    parts = placed.groupBy("by", "key", "comp").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("c")).groupBy("by", "key")
    parts = parts.agg(F.max(F.struct("of", "c", "comp")).alias("most"), F.sum("of").alias("all"), F.sum("c").alias("rows"), F.count(F.lit(1)).alias("k")).where("k > 1")
    chunks = lambda size, rows: F.ceil(F.greatest(size / BLOCK, rows / ROWS)).cast("int")
    outs, alls = chunks(F.col("all") - F.col("most.of"), F.col("rows") - F.col("most.c")), chunks(F.col("all"), F.col("rows"))
    parts = scratch.put(parts.select("by", "key", F.col("most.comp").alias("main"), outs.alias("outs"), alls.alias("alls")))
    rest = placed.join(parts, ["by", "key"]).withColumn("h", F.xxhash64("rep", F.lit(9)))
    outer = rest.where("comp <> main").withColumn("oc", F.pmod("h", "outs")).withColumn("mc", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)))
    inner = rest.withColumn("mc", F.pmod("h", "alls")).withColumn("oc", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    cells = [x.select("by", "key", F.col("oc").cast("long").alias("oc"), F.col("mc").cast("long").alias("mc"), "rep", "comp", F.lit(side).alias("side")) for x, side in ((outer, True), (inner, False))]
    cells = scratch.put(cells[0].unionByName(cells[1]))
    filled = cells.join(sets, cells["rep"] == sets["id"]).select("by", "key", "oc", "mc", "comp", "side", "s")
    more = scratch.put(filled.groupBy("by", "key", "oc", "mc").applyInArrow(_compare(percent), f"a {kind}, b {kind}"))
    # Components are known by their least member, and so are components of components.
    joined = scratch.put(components(more, scratch)).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    by_id = member.join(groups, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("part"))
    by_id = by_id.join(joined, "part", "left").groupBy("id").agg(F.min(F.coalesce("whole", "part")).alias("component"))
    by_row = profile.where("id is not null").groupBy("id", "th").agg(F.max("n").alias("n")).join(by_id, "id", "left")
    by_row = scratch.put(by_row.select(F.col("id").alias("row_id"), F.col("th").alias("row_th"), "n", F.coalesce("component", "id").alias("component")))
    scratch.drop_all_but(by_row)

    docs = df.where(F.col(id_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(id_col).alias("id"), text_key.alias("th"))
    out = docs.join(by_row.hint("shuffle_hash"), (F.col("id") == F.col("row_id")) & (F.col("th") == F.col("row_th")), "left")
    out = out.select(*[F.col("row").getField(c).alias(c) for c in kept], *_result(F.col("n"), F.col("component"), F.col("id").eqNullSafe(F.col("component"))))
    # Rows without an id are joined with nothing.
    places = [f"c{i}" for i in range(len(kept))]
    alone = df.where(F.col(id_col).isNull()).select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, places, strict=True)], F.col(text_col).cast("binary").alias("__text"))
    schema = "".join(f"{i} {df.schema[c].dataType.simpleString()}, " for c, i in zip(kept, places, strict=True))
    alone = alone.mapInArrow(_counts(width, places), f"{schema}n long")
    return out.unionByName(alone.select(*[F.col(i).alias(c) for c, i in zip(kept, places, strict=True)], *_result(F.col("n"), F.lit(None).cast(kind), F.lit(True))))


def _result(n: Column, component: Column, kept: Column) -> list[Column]:
    return [n.alias("n_shingles"), component.alias("component_id"), kept.alias("kept")]
