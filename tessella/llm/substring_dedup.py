"""Substring dedup: words in windows that also start in an earlier document go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .wordhash import BASES, WordHashes, column, rolling, signed, sliding_min, spans, text_chunks

#: Words of the short runs whose least hash stands for a window while candidates are sought; any number up to the window's does.
GRAM = 20


def _anchors(window: int, gram: int):
    """For each text the distinct least hashes of short runs, over all its windows: equal windows have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for a, b in text_chunks(texts):
                words = [t.split() for t in texts[a:b]]
                row, inside = spans(words, window)
                least = sliding_min(rolling(hashes.of(words), gram, BASES[0]), window - gram + 1)[: len(inside)]
                row, least = row[: len(inside)][inside], least[inside]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                at = pa.array(row[new] + a)
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(at), column(batch, "th").take(at), signed(least[new])], ["id", "th", "anchor"])

    return run


def _windows(window: int, gram: int):
    """Two Rabin-Karp hashes of every window whose anchor is shared with another text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts, shared = column(batch, "text").to_pylist(), column(batch, "anchors")
            for a, b in text_chunks(texts):
                words = [t.split() for t in texts[a:b]]
                row, inside = spans(words, window)
                values = hashes.of(words)
                least = sliding_min(rolling(values, gram, BASES[0]), window - gram + 1)[: len(inside)]
                first, second = (rolling(values, window, x)[: len(inside)] for x in BASES)
                row, edges = row[: len(inside)], np.searchsorted(row[: len(inside)], np.arange(b - a + 1))
                for i in range(b - a):
                    lo, hi = edges[i], edges[i + 1]
                    inside[lo:hi] &= np.isin(least[lo:hi], shared[a + i].values.to_numpy().view(np.uint64))
                at = pa.array(row[inside] + a)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id").take(at), column(batch, "th").take(at), signed(first[inside]), pa.array((second[inside] >> np.uint64(33)).astype("i4"))], ["id", "th", "h", "g"]
                )

    return run


def _cut(window: int, names: list[str]):
    """Texts without the words of their repeated windows, with the removed intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            texts, copies, gone = column(batch, "text").to_pylist(), column(batch, "copy").to_pylist(), column(batch, "gone")
            n_words, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                n, cut = len(words), []
                if n >= window and copies[i]:
                    cut, words = [(0, n)], []
                elif n >= window and gone[i].is_valid:
                    hit = np.isin(rolling(hashes.of([words]), window, BASES[0]), gone[i].values.to_numpy().view(np.uint64)) if len(gone[i]) else none
                    at = np.flatnonzero(hit)
                    if len(at):
                        breaks = np.flatnonzero(np.diff(at) > window)  # windows that touch or overlap are one interval
                        cut = list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + window).tolist(), strict=True))
                        left, end = [], 0
                        for x, y in cut:
                            left += words[end:x]
                            end = y
                        words = left + words[end:]
                n_words.append(n)
                removed.append([{"start": x, "end": y} for x, y in cut])
                kept.append(b" ".join(words))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(n_words, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], *made], [*names, "n_words", "removed", "kept_text"])

    return run


def dedup_substrings(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Rabin-Karp hashes of the windows are counted in Spark. Before that, windows that can't repeat are put aside without
    loss: equal windows have equal least hashes of their runs of ``GRAM`` words, so a window counts only if another text
    has its least hash. Copies of a whole text are decided by the text's hash. Repeated windows merge into maximal
    intervals.

    Returns the columns of ``df`` but those named ``n_words`` long, ``removed`` array of (start, end) in words and
    ``kept_text``, which are added: the words left, joined by a space. Null and empty texts have no words; texts shorter
    than a window keep all; rows that repeat an id never remove from each other; rows with a null id keep all words and
    remove none.
    """
    spark, gram = df.sparkSession, min(GRAM, window)
    scratch = Scratch(spark, "substrings")
    kept = [c for c in df.columns if c not in ("n_words", "removed", "kept_text")]
    text_key = F.xxhash64(F.col(text_col), F.octet_length(text_col))
    keyed = df.select(F.col(id_col).alias("id"), text_key.alias("th"), F.col(text_col).cast("binary").alias("text"))
    keyed = keyed.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = df.schema[id_col].dataType.simpleString()

    anchors = scratch.put(keyed.mapInArrow(_anchors(window, gram), f"id {kind}, th long, anchor long"))
    shared = anchors.groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("anchor")
    shared = scratch.put(shared)
    firsts = scratch.put(keyed.groupBy("th").agg(F.min("id").alias("first")))
    marks = anchors.join(shared, "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors"))
    marks = scratch.put(marks)
    scratch.drop(anchors, shared)
    # By id and text hash, never by the hash alone, so that the copies of one text are spread.
    marks_first = marks.join(firsts.withColumnRenamed("first", "id"), ["id", "th"]).select("id", "th", "anchors")
    found = keyed.join(marks_first.hint("shuffle_hash"), ["id", "th"]).mapInArrow(_windows(window, gram), f"id {kind}, th long, h long, g int")
    found = scratch.put(found)
    scratch.drop(marks)
    mins = scratch.put(found.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "g", "lo"))
    gone = found.join(mins, ["h", "g"]).where(F.col("lo") < F.col("id")).groupBy("id", "th").agg(F.collect_set("h").alias("gone"))
    gone = scratch.put(gone)
    scratch.drop(found, mins)

    copies = keyed.select("id", "th").distinct().join(firsts.withColumnRenamed("first", "id"), ["id", "th"], "left_anti")
    flags = copies.select("id", "th", F.lit(True).alias("copy"), F.lit(None).cast("array<long>").alias("gone"))
    flags = scratch.put(flags.unionByName(gone.select("id", "th", F.lit(False).alias("copy"), "gone")))
    scratch.drop(firsts, gone)
    names = [f"c{i}" for i in range(len(kept))]
    docs = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(id_col).alias("id"), text_key.alias("th"))
    out = docs.where(F.col("id").isNotNull()).join(flags.hint("shuffle_hash"), ["id", "th"], "left")
    out = out.unionByName(docs.where(F.col("id").isNull()), allowMissingColumns=True)
    text = names[kept.index(text_col)]
    out = out.select(*names, F.col(text).cast("binary").alias("text"), "copy", "gone")
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, kept, strict=True))
    done = out.mapInArrow(_cut(window, names), f"{schema}, n_words long, removed array<struct<start:long,end:long>>, kept_text string")
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], "n_words", "removed", "kept_text")
