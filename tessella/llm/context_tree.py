"""LM scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks_for, fold_copies, row_hash, unfold_copies
from .wordhash import distinct as distinct_values
from .wordhash import mix

#: Stands before and behind each text; no byte of UTF-8.
EDGE = 0xFF
#: So many packs a block deals its counts into, and so many packs of a part are merged at once; a power of two.
FAN = 64
#: Rows that occur more often are counted and scored as one.
COPIES = 1024


def plain(text: bytes | None) -> bytes:
    """What is scored: words with A-Z lower-cased, a space between two; the end stands behind the last."""
    return b" ".join((text or b"").lower().split())


def contexts(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text, and its end, the ``depth`` bytes before it and itself as one number; first place of each text."""
    edge = bytes([EDGE])
    joined = np.frombuffer(edge * depth + b"".join(chain.from_iterable((t, edge * depth) for t in texts)), np.uint8).astype(np.int64)
    n = len(joined) - depth
    keys = np.zeros(n, np.int64)
    for j in range(depth + 1):
        keys |= joined[j : j + n] << (8 * (depth - j))
    # After each end come depth - 1 more edges; they are padding of the next text.
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(lengths + depth)[:-1]] if len(texts) else np.zeros(0, np.int64)
    keep = np.arange((lengths + 1).sum()) + np.repeat(starts - np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(texts) else starts, lengths + 1)
    return keys[keep], np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(texts) else starts


def by_part(keys: np.ndarray, parts: int) -> tuple[list[int], np.ndarray, list[int]]:
    """Parts of sorted distinct keys, the keys' order by part, and where each part begins; the same wherever it is asked."""
    part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return part[first].tolist(), order, [*first.tolist(), len(part)]


def word_keys(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def _count(depth: int):
    """Distinct contexts (kind 0) and hashed words (kind 1) of a block with their numbers in training texts, in a pack for each part."""

    def run(block: pa.Table) -> pa.Table:
        texts = [plain(t) for t in block.column("text").to_pylist()]
        weight = block.column("train").to_numpy() * block.column("copies").to_numpy()
        keys, starts = contexts(texts, depth)
        each = np.repeat(weight, np.diff(np.r_[starts, len(keys)]))
        if weight.max(initial=0) < 2:
            both = np.sort(keys << 1 | each)
            keys, each = both >> 1, both & 1
        else:
            order = np.argsort(keys, kind="stable")
            keys, each = keys[order], each[order]
        words: Counter[bytes] = Counter()
        other: set[bytes] = set()
        for text, n in zip(texts, weight.tolist(), strict=True):
            if n == 1:
                words.update(text.split())
            elif n:
                words.update({w: c * n for w, c in Counter(text.split()).items()})
            else:
                other.update(text.split())
        tokens = [*words, *other.difference(words)]
        hashes, counts = word_keys(tokens), np.array([*words.values(), *[0] * (len(tokens) - len(words))], np.int64)
        order = np.argsort(hashes, kind="stable")
        number = block.column("block")[0].as_py()
        rows = [r for kind, (k, n) in enumerate((_summed(keys, each), _summed(hashes[order], counts[order]))) for r in _packs(number, kind, k, n, FAN)]
        rows.append((number, 2, 0, b"", np.array([weight.sum()], "<i8").tobytes()))
        return _table(rows)

    return run


def _packs(number: int, kind: int, keys: np.ndarray, seen: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of sorted distinct keys and their counts, one for each part that has some."""
    part, order, edges = by_part(keys, parts)
    packed = [x[order].astype("<i8").tobytes() for x in (keys, seen)]
    for p, a, b in zip(part, edges, edges[1:], strict=False):
        yield number, kind, p, *[x[8 * a : 8 * b] for x in packed]


def _table(rows: list[tuple]) -> pa.Table:
    number, kind, part, keys, seen = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table({"block": pa.array(number, pa.int64()), "kind": pa.array(kind, pa.int64()), "part": pa.array(part, pa.int64()), "keys": pa.array(keys, pa.binary()), "seen": pa.array(seen, pa.binary())})


def _summed(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over equal neighbours."""
    if not len(keys):
        return keys, seen
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(seen, first)


def _sums(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, seen = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<i8") for c in ("keys", "seen"))
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], seen[order])


def _combine(parts: int):
    """Sums of one part's counts over ``FAN`` blocks, dealt anew into finer parts."""

    def run(group: pa.Table) -> pa.Table:
        return _table(list(_packs(group.column("up")[0].as_py(), group.column("kind")[0].as_py(), *_sums(group), parts)))

    return run


def _merge(group: pa.Table) -> pa.Table:
    """Sums of one part's counts over all blocks, a row for each key."""
    keys, seen = _sums(group)
    return pa.table({"kind": pa.array([group.column("kind")[0].as_py()] * len(keys), pa.int64()), "part": pa.array([group.column("part")[0].as_py()] * len(keys), pa.int64()), "gram": pa.array(keys), "n": pa.array(seen)})


def _form(kind: int) -> str:
    """Prices travel in single precision, counts of words whole."""
    return "<f4" if kind == 0 else "<f8"


def _price(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Values of one part's keys for each pack that asks, in the order asked."""
    form = _form(known.column("kind")[0].as_py())
    if "gram" in known.column_names:
        gram, value = known.column("gram").to_numpy(), known.column("value").to_numpy()
    else:
        gram, value = (np.frombuffer(b"".join(known.column(c).to_pylist()), f) for c, f in (("keys", "<i8"), ("given", form)))
    order = np.argsort(gram)
    gram, value = gram[order], value[order].astype(form)
    out = [value[np.searchsorted(gram, np.frombuffer(g, "<i8"))].tobytes() for g in asked.column("keys").to_pylist()]
    return pa.table({**{c: asked.column(c) for c in ("block", "kind", "part", "keys")}, "given": pa.array(out, pa.binary())})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, led back by the recurrence."""
    y, product = x + 8.0, x.copy()
    for i in range(1, 8):
        product *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _level(full: bool):
    """One depth of the tree, for whole contexts: the shares of the mixture that stop here and that go on.

    A byte is eight decisions; a node is a context with the bits before a decision. Its Krichevsky-Trofimov block
    probability Pe and the product of the weighted ones of contexts a byte longer give Pw = (Pe + product) / 2; at full
    depth Pw = Pe. A path stops with weight Pe / 2 Pw. The bytes of a context that share a node are neighbours in the
    order of grams, and the first of them carries the node's ln Pw upwards.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("gram")
        gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
        out: dict[str, pa.Array] = {"gram": pa.array(gram), "n": pa.array(n)}
        shares = np.empty((len(gram), 16), "<f4")
        for j in range(8):
            node, bit = gram >> (8 - j), gram >> (7 - j) & 1
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(gram)]))
            ones, both = np.add.reduceat(n * bit, first), np.add.reduceat(n, first)
            pe = log_gamma(ones + 0.5) + log_gamma(both - ones + 0.5) - log_gamma(both + 1.0) - math.log(math.pi)
            pe[both == 0] = 0
            if full:
                pw, stop, on = pe, np.ones(len(first)), np.zeros(len(first))
            else:
                longer = np.add.reduceat(rows.column(f"m{j}").to_numpy(), first)
                pw = np.logaddexp(pe, longer) - math.log(2)
                stop, on = np.exp(pe - pw - math.log(2)), np.exp(longer - pw - math.log(2))
            counted = np.where(bit == 1, ones[of], both[of] - ones[of])
            shares[:, j] = np.where(both[of] == 0, 0.5, stop[of] * (counted + 0.5) / (both[of] + 1.0))  # never seen: 1/2
            shares[:, 8 + j] = np.where(both[of] == 0, 0, on[of])
            up = np.zeros(len(gram))
            up[first] = pw
            out[f"m{j}"] = pa.array(up)
        out["shares"] = pa.array([r.tobytes() for r in shares], pa.binary())
        return pa.table(out)

    return run


def _mix(full: bool):
    """The mixture so far, and its rest, carried on by one depth; at full depth the rest is 0 and the logarithm is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            so_far, shares = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<f4").reshape(-1, 16) for i in (1, 2))
            p = so_far[:, :8] + so_far[:, 8:] * shares[:, :8]
            out = np.concatenate([p, so_far[:, 8:] * shares[:, 8:]], axis=1).astype("<f4")
            lp = np.log10(p.astype("f8")).sum(axis=1) if full else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in out], pa.binary()), pa.array(lp)], ["gram", "shares", "lp"])

    return run


def weigh(grams: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(gram, n) -> (gram, lp): log10 probability of the byte after its context, mixed over depths 0 to ``depth``.

    Upwards, one depth after the other is weighted in groups of whole contexts by hash; a context has 256 rows at most,
    so groups are of even size. Downwards each gram takes up the mixture of the gram a byte shorter.
    """
    sums, levels = [f"m{j}" for j in range(8)], []
    now = grams
    for d in range(depth, -1, -1):
        if d < depth:
            shorter = F.col("gram").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("gram")
            now = scratch.put(now.groupBy(shorter).agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in sums]))
        buckets = max(1, -(-now.count() // 50_000))
        keyed = now.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("gram", 8)), F.lit(buckets)))
        made = keyed.groupBy("bucket").applyInArrow(_drop_key(_level(d == depth)), "gram long, n long, " + "".join(f"{m} double, " for m in sums) + "shares binary")
        made = scratch.put(made)
        if d < depth:
            scratch.drop(now)
        now = made
        levels.append(made.select("gram", "shares"))
    mixed = levels.pop()
    while levels:
        own, d = levels.pop(), depth - len(levels)
        shorter = mixed.select(F.col("gram").alias("up"), F.col("shares").alias("so_far"))
        both = own.join(shorter, F.col("gram").bitwiseAND((1 << (8 * d)) - 1) == F.col("up")).select("gram", "so_far", "shares")
        mixed = scratch.put(both.mapInArrow(_mix(not levels), "gram long, shares binary, lp double"))
    return mixed.select("gram", "lp")


def _drop_key(run):
    return lambda rows: run(rows.drop_columns(["bucket"]))


def _score(depth: int, total: int, distinct: int, ends: int, keep_text: bool):
    """Sums over the texts of a block; its contexts and words come priced with it."""

    def run(docs: pa.Table, prices: pa.Table) -> pa.Table:
        texts = [plain(t) for t in docs.column("text").to_pylist()]
        keys, starts = contexts(texts, depth)
        prices = prices.sort_by([("kind", "ascending"), ("part", "ascending")])
        given = lambda kind: np.frombuffer(b"".join(prices.filter(pc.equal(prices.column("kind"), kind)).column("given").to_pylist()), _form(kind))
        gram = distinct_values(keys)
        lp = np.zeros(len(gram))
        lp[by_part(gram, FAN)[1]] = given(0)
        score = np.add.reduceat(lp[pd.Index(gram).get_indexer(keys)], starts) if len(texts) else np.zeros(0)
        cut = [t.split() for t in texts]
        flat = list(chain.from_iterable(cut))
        code = dict.fromkeys(flat)
        tokens = list(code)
        code.update(zip(tokens, range(len(tokens)), strict=True))
        hashes = word_keys(tokens)
        known = distinct_values(hashes)
        counts = np.zeros(len(known), np.int64)
        counts[by_part(known, FAN)[1]] = given(1).astype(np.int64)
        count = counts[np.searchsorted(known, hashes)]
        scale = total + distinct + 1
        price = np.log10((count + 1) / scale)
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        codes, row = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(cut)), n_words)
        n_known = np.bincount(row, count[codes] > 0, len(cut)).astype(np.int64) + (ends > 0)
        base = np.bincount(row, price[codes], len(cut)) + math.log10((ends + 1) / scale)
        size = np.fromiter(map(len, texts), np.float64, len(texts)) + 1
        return pa.table(
            ({"text": docs.column("text")} if keep_text else {})
            | {
                **{c: docs.column(c) for c in ("h1", "copies", "row")},
                "n_tokens": pa.array(n_words + 1, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(-score * math.log2(10) / size, pa.float64()),
            }
        )

    return run


def score_documents(
    df: DataFrame,
    train: Column,
    depth: int = 5,
    block_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """Learn a context tree from the rows where ``train`` is true and score every whole text.

    Texts are scored as their words, A-Z lower-cased, with a space between two and the end behind the last: the events that the
    unigram base scores, so kind and amount of white space are no part of either. They are dealt into blocks of about
    ``block_bytes``; a row that occurs more than ``COPIES`` times is counted and scored once, with its number. Each block counts its
    distinct contexts of ``depth`` bytes and its words, by 64 bits of hash, into ``FAN`` packs by hash. Packs of ``FAN`` blocks
    are merged and dealt into ``FAN`` finer parts, again and again until one step is left for all blocks: so packs keep
    their size, their number grows with the blocks and a task's input doesn't. The tree is weighted depth by depth
    in groups by hash, and the prices go back the same way, each block getting those of its own contexts, in single
    precision. The model is spread over the cluster and grows with the corpus; only totals reach the driver.

    Returns the columns of ``df`` (its text only with ``keep_text``) but the following, which are added: ``n_tokens`` (words and one end), ``n_known`` (those
    seen in training), ``train_tokens`` long, ``base_score`` (add-one unigrams, log10), ``score`` (log10 probability of the
    text and its end) and ``bits_per_byte`` double. Null counts as empty text; a null ``train`` as true; rows with equal or
    null ids are separate texts; without training rows all contexts have their prior, 1/2 for each bit.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    spark = df.sparkSession
    scratch = Scratch(spark, "tree")
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    kept = [c for c in df.columns if c not in added]
    df = df.withColumn("__train", F.coalesce(train, F.lit(True)).cast("long"))
    whole = df.select(*[F.col(f"`{c}`") for c in kept], "__train")
    hashes = row_hash(whole, 1).alias("h1"), row_hash(whole, 2).alias("h2")
    seen = whole.select(*hashes, F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("size"))
    seen = scratch.put(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    blocks = blocks_for(seen.agg(F.sum("size")).first()[0], block_bytes)
    row = F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col] or [F.lit(0).alias("none")])
    dealt, folded = fold_copies(whole.select(*hashes, row.alias("row"), F.col("__train").alias("train"), F.col(f"`{text_col}`").cast("binary").alias("text")), seen, COPIES)
    dealt = dealt.withColumn("block", F.pmod("h1", F.lit(blocks)))

    schema = "block long, kind long, part long, keys binary, seen binary"
    packed = [scratch.put(dealt.select("block", "train", "copies", "text").groupBy("block").applyInArrow(_count(depth), schema))]
    scratch.drop(seen) if not folded else None
    up = F.floor(F.col("block") / FAN)
    while FAN ** len(packed) < blocks:
        finer = packed[-1].where("kind < 2").withColumn("up", up).groupBy("kind", "up", "part")
        packed.append(scratch.put(finer.applyInArrow(_combine(FAN ** (len(packed) + 1)), schema)))
    parts = FAN ** len(packed)
    merged = packed[-1].where("kind < 2").groupBy("kind", "part").applyInArrow(_merge, "kind long, part long, gram long, n long")
    merged = scratch.put(merged)
    words = merged.where("kind = 1")
    ends = sum(struct.unpack("<q", bytes(r["seen"]))[0] * r["n"] for r in packed[0].where("kind = 2").groupBy("seen").agg(F.count(F.lit(1)).alias("n")).collect())
    t = words.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = (t[0] or 0) + ends, t[1] + (ends > 0)

    priced = weigh(merged.where("kind = 0").select("gram", "n"), depth, scratch)
    of_part = lambda batches: (pa.RecordBatch.from_arrays([pa.array((mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)), *b.columns], ["part", "gram", "value"]) for b in batches)
    values = priced.select("gram", "lp").mapInArrow(of_part, "part long, gram long, value double").withColumn("kind", F.lit(0).cast("long"))
    values = values.unionByName(words.select("part", "gram", F.col("n").cast("double").alias("value"), "kind"))
    schema = "block long, kind long, part long, keys binary, given binary"
    asking = lambda i: packed[i].where("kind < 2").select("block", "kind", "part", "keys")
    prices = scratch.put(asking(-1).groupBy("kind", "part").cogroup(values.groupBy("kind", "part")).applyInArrow(_price, schema))
    for i in range(len(packed) - 2, -1, -1):
        known = prices.withColumn("of", F.pmod("part", F.lit(FAN ** (i + 1)))).groupBy("kind", "block", "of")
        prices = scratch.put(asking(i).withColumn("up", up).groupBy("kind", "up", "part").cogroup(known).applyInArrow(_price, schema))
    scratch.drop_all_but(prices, *[seen] * folded)
    kind = dealt.schema["row"].dataType.simpleString()
    schema = "text binary, " * keep_text + f"h1 long, copies long, row {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = dealt.select("block", "h1", "copies", "row", "text").groupBy("block").cogroup(prices.select("block", "kind", "part", "given").groupBy("block")).applyInArrow(_score(depth, total, distinct, ends, keep_text), schema)
    if folded:
        out = unfold_copies(scratch.put(out))
    columns = [F.col("text").cast("string").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept if keep_text or c != text_col]
    return out.select(*columns, *added)
