"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .wordhash import text_chunks

#: Encoded chunks that a worker remembers; a full memory is emptied, results don't depend on it.
REMEMBERED = 400_000


#: ASCII signs that never join a letter before them in one pre-token (the apostrophe does), and bytes of what may compose with its neighbours.
SIGNS, COMPOSING = rb"!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~", re.compile(rb"[\xcc-\xf4]")


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    return {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in plain)}


class Known(dict):
    """Packed ids of each chunk, made when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


class Encoder:
    """Ids of whole texts, little-endian 32-bit, as the lower-casing word-level BPE tokenizer at ``path`` gives them.

    It never joins across ASCII white space, so each chunk between is encoded once. Words of letters below U+0300, alone
    or before signs, need no normalisation but lower case and go to the model directly; all else goes through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), Known(self.chunk), byte_letters()
        self.model = self.tokenizer.model
        self.packed = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]

    @staticmethod
    def of_worker(path: str) -> Encoder:
        """The encoder of this Python worker, which outlives a task."""
        memory = sys.modules.setdefault("tessella_worker_memory", ModuleType("tessella_worker_memory"))
        if path not in memory.__dict__:
            memory.__dict__[path] = Encoder(path)
        return memory.__dict__[path]

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters stand for themselves
            return self.word(chunk.lower().decode())
        word = chunk.rstrip(SIGNS)
        if len(word) < len(chunk):
            if word.isalpha() or _simple(word.decode()):
                return self.known[word] + self.known[chunk[len(word) :]]
        elif _simple(text := chunk.decode()):
            return self.word(text.lower().encode().decode("latin-1").translate(self.letters))
        return b"".join([self.packed[i] for i in self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids])

    def word(self, letters: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [((t or b"") if COMPOSING.search(t or b"") else (t or b"").lower()).split() for t in texts]
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]


def _simple(text: str) -> bool:
    """Letters that need no normalisation but lower case."""
    return text.isalpha() and max(text) < "\u0300" and "\u0130" not in text


def tokenise(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only documents longer than that are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of_worker(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for i, got in enumerate(chain.from_iterable(encoder.ids(texts[a:b]) for a, b in text_chunks(texts))):
                got += end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best two fit, from the numbers of pieces of each length: rows (length, first rank, last rank + 1, first sequence, offset), and the number of sequences.

    A bin takes the longest piece left, then again and again the longest that fits; pieces of a sixth of the capacity
    or less wait. If a gap remains, the smallest piece gives way to the two unpacked pieces that together fill the
    expanded gap best, if that is tighter. The short pieces then fill what is left in the same way.

    Equal bins are made at once, as many as the counts allow, so the work depends on the number of distinct lengths
    (``capacity`` at most) and not on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes, used, out, sequences = sorted(left), dict.fromkeys(left, 0), [], 0
    short = capacity // 6

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            sizes.pop(bisect_left(sizes, n))

    def give(n: int) -> None:
        if not left[n]:
            insort(sizes, n)
        left[n] += 1

    def fill(items: list[int], least: int) -> None:
        gap = capacity - sum(items)
        while sizes and (k := bisect_right(sizes, gap)) and sizes[k - 1] > least:
            items.append(n := sizes[k - 1])
            take(n)
            gap -= n

    def swap(items: list[int], room: int) -> list[int]:
        """``items`` with two unpacked pieces in place of the smallest, those that fill ``room`` best, if that is tighter."""
        smallest = items[-1]
        a = np.array(sizes[bisect_right(sizes, short) : bisect_right(sizes, room)], "i8")
        if not len(a):
            return items
        at = np.searchsorted(a, room - a, "right") - 1  # the longest partner of each
        alone = np.array([left[n] < 2 for n in a.tolist()])
        at = np.where((at == np.arange(len(a))) & alone, at - 1, at)
        both = np.where(at >= 0, a + a[np.maximum(at, 0)], 0)
        best = int(both.argmax())
        if both[best] <= smallest:
            return items
        pair = int(a[best]), int(a[at[best]])
        for n in pair:
            take(n)
        give(smallest)
        return sorted([*items[:-1], *pair], reverse=True)

    while sizes:
        items: list[int] = []
        fill(items, short)
        if items and (gap := capacity - sum(items)):
            items = swap(items, gap + items[-1])
        fill(items, 0)
        need = {n: items.count(n) for n in items}
        times = 1 + min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            if left[n] and left[n] == (times - 1) * k:
                sizes.pop(bisect_left(sizes, n))
            left[n] -= (times - 1) * k
        offset = 0
        for n in items:
            out.append((n, used[n], used[n] + times, sequences, offset))
            used[n] += times
            offset += n
        sequences += times
    return np.array(sorted(out), "i8").reshape(-1, 5), sequences


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenise all documents and place every piece in a sequence of at most ``capacity`` ids.

    Only the counts of each length (``capacity`` numbers at most) reach the driver. Pieces of one length are
    interchangeable: each gets its rank among them, over groups of numbers drawn when the pieces are written, so that
    equal rows are spread as well, and the plan turns ranks into places.

    Returns one row for each piece: ``id_col``, ``piece`` int, ``start``, ``length``, ``ids_crc32`` long,
    ``sequence_id``, ``offset`` long and, with ``keep_ids``, ``ids``. A null or empty text is the end id alone; rows with
    equal or null ids are separate documents; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    # Drawn once, with the table: whoever reads it sees the same numbers.
    deal = F.xxhash64(F.lit(5), F.monotonically_increasing_id()).alias("deal")
    pieces = scratch.put(tokenise(df, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids).select("*", deal))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(16, -(-sum(counts.values()) // 100_000))
    salted = pieces.withColumn("salt", F.pmod("deal", F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("deal")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("base")).cast("long")).drop("salt", "base", "deal")

    places, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(places)  # a few rows for each distinct length, whatever the corpus
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, n << 48 | rank, "right") - 1]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    placed = ranked.mapInArrow(run, schema)
    order = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.select(F.col("id").alias(id_col), *order)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, from ``pack(..., keep_ids=True)``; a group holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
