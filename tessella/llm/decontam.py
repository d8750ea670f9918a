"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Scratch, blocks_for
from .wordhash import column

#: Words are runs of ASCII letters, digits and all non-ASCII bytes; everything else divides them.
WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class WuManber:
    """Search for patterns of one length, in words.

    ``shift`` says for a block of two words how far the window's end may move on; a block that ends a pattern has
    shift 0 and its own bucket of patterns, with which the words are compared directly.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.buckets.setdefault(p[-self.block :], {})[p] = items

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """First words of all occurrences with the items of each."""
        shift, far, n, m, two, end = self.shift.get, self.far, len(text), self.length, self.block == 2, self.length
        while end <= n:
            last = (text[end - 2], text[end - 1]) if two else (text[end - 1],)
            step = shift(last, far)
            if not step:
                if items := self.buckets[last].get(tuple(text[end - m : end])):
                    yield end - m, items
                step = 1
            end += step


def machines(rows: list[tuple[object, bytes | None]], window: int) -> list[WuManber]:
    """One searcher for each pattern length: windows, and items too short for one."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in rows:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    return [WuManber(n, p) for n, p in sorted(by_length.items())]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
HITS = [StructField("n_words", LongType()), StructField("hit_spans", ArrayType(SPAN)), StructField("item_ids", ArrayType(StringType()))]


def _batch(batch: pa.RecordBatch, kept: list[str], n_words: list[int], spans: list, ids: list) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    made = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span), pa.array(ids, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], *made], [*kept, "n_words", "hit_spans", "item_ids"])


def _search(found, window: int, text_col: str, kept: list[str]):
    """The words, merged hits and items of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = machines(found.value, window)
        for batch in batches:
            n_words, spans, ids = [], [], []
            for text in column(batch, text_col).cast(pa.binary()).to_pylist():
                w, hits, of = words(text), [], set()
                for m in searchers:
                    for start, which in m.find(w):
                        hits.append((start, start + m.length))
                        of |= which
                n_words.append(len(w))
                spans.append(_merge(hits))
                ids.append(sorted(of))
            yield _batch(batch, kept, n_words, spans, ids)

    return run


def _merged(text_col: str, kept: list[str]):
    """The hits of all parts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(words(t)) for t in column(batch, text_col).cast(pa.binary()).to_pylist()]
            spans = [_merge([(s["start"], s["end"]) for s in x]) for x in column(batch, "__spans").to_pylist()]
            yield _batch(batch, kept, n_words, spans, column(batch, "__ids").to_pylist())

    return run


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    part_bytes: int = 4 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Mark the words of every document that lie in an occurrence of a benchmark window.

    The benchmark's distinct items are measured first. They are searched in parts of about ``part_bytes`` of text, one
    broadcast part at a time, so that memory stays bounded for any benchmark. Beyond one part, a pass over the documents
    writes only the hits of those that have some, by hash of the text; the hits are merged and joined back.

    Returns the columns of ``df`` with ``n_words`` long, ``hit_spans`` array of (start, end) in words, merged and sorted, and
    ``item_ids``, the sorted ids as strings. Null, empty or wordless texts have no words and no hits; items without words
    match nothing; a null item id hits words but isn't listed; repeated items count once; an empty benchmark hits
    nothing. Columns of ``df`` with the three output names are replaced.
    """
    spark = df.sparkSession
    added = ("n_words", "hit_spans", "item_ids")
    kept = [c for c in df.columns if c not in added]
    docs = df.select(*[F.col(f"`{c}`") for c in kept])
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null").distinct()
    parts = blocks_for(items.agg(F.sum(F.octet_length("text"))).first()[0], part_bytes)

    def part(k: int):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        return spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in mine.collect()])

    if parts == 1:
        return docs.mapInArrow(_search(part(0), window, text_col, kept), StructType([*[df.schema[c] for c in kept], *HITS]))

    scratch = Scratch(spark, "leaks")
    texts = docs.select(F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"), F.col(text_col).alias("text"))
    keys = [StructField("t1", LongType()), StructField("t2", LongType())]
    found = [scratch.put(texts.mapInArrow(_search(part(k), window, "text", ["t1", "t2"]), StructType([*keys, *HITS])).where(F.size("hit_spans") > 0).distinct()) for k in range(parts)]
    every = functools.reduce(DataFrame.unionByName, found).groupBy("t1", "t2")
    hits = every.agg(F.flatten(F.collect_list("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    hits = scratch.put(hits.select("t1", "t2", F.array_sort("spans").alias("hit_spans"), "item_ids"))
    scratch.drop(*found)
    # A copied text's hits reach each of its rows: rows of one text are many, its hits one row, and a hot side can be split.
    none = StructType(HITS)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"))
    joined = own.join(hits, ["t1", "t2"], "left")
    flat = [F.col("row").getField(c).alias(c) for c in kept]
    return joined.select(*flat, F.coalesce("hit_spans", F.array().cast(none["hit_spans"].dataType)).alias("__spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("__ids")).mapInArrow(
        _merged(text_col, kept), StructType([*[df.schema[c] for c in kept], *HITS])
    )
