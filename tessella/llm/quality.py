"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .context_tree import log_gamma
from .decontam import WORDS
from .wordhash import WordHashes, column, distinct, mix, sliding_min, spans, text_chunks

#: Slices in which counts of the buckets travel.
SLICES = 64
#: So many times a word at once are n-grams of their own, whatever the word.
RUNS = tuple(range(2, 9))
#: Bytes whose n-grams are made at once.
SPAN = 1 << 18
#: What a document's labels make of it, if anything; also its row in the table of log ratios.
TARGET, BAD = 1, 2
#: A for ASCII capitals, 0 for digits, a for other letters and all bytes beyond ASCII; signs and white space stay.
SHAPES = bytes(65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if c >= 128 or 97 <= c <= 122 else c for c in range(256))


class ShapedHashes(WordHashes):
    """32 bits of each word's hash, and of its shape's above them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) | xxhash.xxh32_intdigest(word.translate(SHAPES), 1) << 32
        return h


def features(texts: list[bytes | None], hashes: ShapedHashes, bits: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct n-grams of texts.

    They are words as written, words by shape (kinds of letters, digits and signs), one word again and
    again (``RUNS`` times) whatever it is, and runs of ``width`` bytes of the lower-case words with a space around each.
    What a document repeats counts once: in a sum over all its places a name that one text uses thirty times would
    weigh as much as thirty texts with it.
    """
    shift = np.uint64(64 - bits)
    cut = [(t or b"").split() for t in texts]
    row, _ = spans(cut, 1)
    values = hashes.of(cut)
    found = [(row, mix(values & np.uint64(0xFFFFFFFF)) >> shift), (row, mix(values >> np.uint64(32)) >> shift)]
    same = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
    for n in RUNS:
        again = row[:-n][sliding_min(same, n)] if len(row) > n else row[:0]
        found.append((again, mix(np.full(len(again), n, np.uint64)) >> shift))
    low = [b" " + b" ".join((t or b"").translate(WORDS).split()) + b" " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    data, place, ends = np.frombuffer(b"".join(low), np.uint8), np.repeat(np.arange(len(low), dtype=np.int32), size), np.cumsum(size)
    marked = lambda r, b: r.astype(np.uint64) << np.uint64(bits) | b
    runs = [distinct(np.concatenate([marked(r, b) for r, b in found]))]
    for a in range(0, len(data) - width + 1, SPAN):
        part = data[a : a + SPAN + width - 1].astype(np.uint64)
        n = len(part) - width + 1
        grams = np.zeros(n, np.uint64)
        for j in range(width):
            grams |= part[j : j + n] << np.uint64(8 * j)
        own = place[a : a + n]
        inside = np.arange(a + width, a + width + n) <= ends[own]
        runs.append(distinct(marked(own[inside], mix(grams[inside]) >> shift)))
    both = distinct(np.concatenate(runs))
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _document_counts(bits: int):
    """Documents that hold each bucket: all, targets and bad ones; once for each task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, any_text = ShapedHashes(), np.zeros((3, 1 << bits), np.int64), False
        for batch in batches:
            texts, said = column(batch, "text").to_pylist(), column(batch, "said").to_numpy()
            any_text |= len(texts) > 0
            for a, b in text_chunks(texts):
                row, bucket = features(texts[a:b], hashes, bits)
                of = said[a:b][row]
                for n, mine in zip(counts, (of >= 0, of == TARGET, of == BAD), strict=True):
                    n += np.bincount(bucket[mine], minlength=1 << bits)
        if any_text:
            parts = [p.astype("<i8").tobytes() for p in np.split(counts, SLICES, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of one slice, one task's at a time."""
    total = None
    for batch in batches:
        for c in batch.column("counts"):
            c = np.frombuffer(c.as_py(), "<i8")
            total = c.copy() if total is None else total + c
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def _evidence(seen: np.ndarray, expected: np.ndarray, shape: float) -> np.ndarray:
    """Log odds that ``seen`` came of a rate of its own (Gamma of that ``shape`` around the expected) rather than of the expected one."""
    return log_gamma(seen + shape) - math.lgamma(shape) + shape * math.log(shape) - (seen + shape) * np.log(expected + shape) + expected


def log_ratios(raw: np.ndarray, target: np.ndarray, bad: np.ndarray, share: float = 0.005, shape: float = 0.5) -> np.ndarray:
    """ln p(bucket | target) - ln p(bucket | raw) for two models that each sum to 1 over the buckets: for documents without a label, targets, bad ones.

    The raw model is the buckets' shares of all n-grams. The target's is the raw one times a ratio for each bucket and
    scaled to sum to 1; the ratio is the posterior mean when a ``share`` of the buckets have ratios of their own, spread as a Gamma
    of that ``shape``, and the others 1. So a bucket's counts move its ratio as far as they are evidence, the counts among
    labelled bad documents counting as such too, and none is set to 0. Without targets all ratios are 1. A labelled
    document is judged as if it had no label: its own one is taken off its buckets' counts (of the totals it is next to nothing).
    """
    totals = [float(x.sum()) for x in (raw, target, bad)]
    if not totals[0] or not totals[1]:
        return np.zeros((3, len(raw)))
    expected = raw * (totals[1] / totals[0])

    def ratio(target: np.ndarray, bad: np.ndarray) -> np.ndarray:
        evidence = _evidence(target, expected, shape)
        if totals[2]:
            evidence = evidence + _evidence(bad, raw * (totals[2] / totals[0]), shape)
        own = 1 / (1 + (1 - share) / share * np.exp(-np.clip(evidence, -700, 700)))
        return 1 - own + own * (target + shape) / (expected + shape)

    known = ratio(target, bad)
    scale = math.log((raw * known).sum() / totals[0])
    return np.log(np.stack([known, ratio(np.maximum(target - 1, 0), bad), ratio(target, np.maximum(bad - 1, 0))])) - scale


def fit(texts: DataFrame, bits: int) -> np.ndarray:
    """Log ratios of 2**``bits`` buckets from (said, text); all documents are counted, and the model's size doesn't grow with them."""
    parts = texts.mapInArrow(_document_counts(bits), "slice int, counts binary")
    parts = parts.withColumn("fan", F.pmod(F.xxhash64("counts"), F.lit(64)))
    for keys in (("slice", "fan"), ("slice",)):  # in two steps, so that no task reads the counts of all others
        parts = parts.groupBy(*keys).applyInArrow(_add, "slice int, counts binary")
    got = sorted((r["slice"], bytes(r["counts"])) for r in parts.collect())
    if not got:
        return np.zeros((3, 1 << bits), np.float32)
    counts = np.concatenate([np.frombuffer(c, "<i8").reshape(3, -1) for _, c in got], axis=1)
    return log_ratios(*counts).astype(np.float32)


def _labels(df: DataFrame, target_ids: DataFrame, bad_ids: DataFrame | None, id_col: str, at_most: int) -> DataFrame:
    """(id, said), at most ``at_most`` targets and as many bad ones, by hash; a target that is also bad is a target."""
    kind = df.schema[id_col].dataType

    def some(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col(ids.columns[0]).try_cast(kind).alias("id")).where("id is not null").distinct()
        n = ids.count()
        if n <= at_most:
            return ids
        # A share by hash that is very nearly at_most and hardly ever more; the limit holds in any case.
        share = at_most / n * (1 - 4 / math.sqrt(max(at_most, 17)))
        return ids.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 31)) < int(share * (1 << 31))).limit(at_most)

    said = some(target_ids).select("id", F.lit(TARGET).alias("said"))
    if bad_ids is not None:
        said = said.unionByName(some(bad_ids).select("id", F.lit(BAD).alias("said")))
    return said.groupBy("id").agg(F.min("said").alias("said"))


def _weights(bits: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = ShapedHashes(), model.value
        for batch in batches:
            texts, said, out = column(batch, "__text").to_pylist(), column(batch, "said").to_numpy(), []
            for a, b in text_chunks(texts):
                row, bucket = features(texts[a:b], hashes, bits)
                out.append(np.bincount(row, ratio[said[a:b][row], bucket], minlength=b - a))
            names = [c for c in batch.schema.names if c != "__text"]
            cols = [column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, "log_weight"])

    return run


def largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of a column of numbers, exactly; None: there are no more than k.

    Counts of 65,536 equal bins lead to the bin that holds it, whose own least and largest are the next bounds, until they meet.
    """
    x = keys.columns[0]
    keys = keys.select(F.col(x).alias("x"))
    n, lo, hi = keys.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if k >= n:
        return None
    if k <= 0:
        return math.inf
    while lo < hi:
        wide = max((hi - lo) / 65536, 5e-324)
        inside = keys.where(F.col("x").between(lo, hi))
        bins = inside.groupBy(F.floor((F.col("x") - lo) / wide).alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["lo"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def resample(
    df: DataFrame,
    target_ids: DataFrame,
    k: int | None = None,
    recall: float = 0.995,
    temperature: float = 1.0,
    seed: int = 11,
    bits: int = 20,
    max_labelled: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
    bad_ids: DataFrame | None = None,
) -> DataFrame:
    """Draw documents by their importance for the target, the labelled good documents, without replacement.

    The log weight of a document is the sum over its hashed n-grams of the log ratio of the target's to the raw text's
    model (``log_ratios``). The ``k`` largest of log weight / ``temperature`` + Gumbel noise are, at temperature 1, a sample of k
    by these weights. Without ``k``, k is the least number of draws that holds the share ``recall`` of the targets, each weighed
    without its own label. The noise is a hash of id and text,
    so a rerun draws the same. The k-th largest key is found exactly. All documents are counted and weighed; labels of at most
    ``max_labelled`` targets and as many bad documents (``bad_ids``), by hash, are used.

    Returns the columns of ``df`` (its text only with ``keep_text``) but those named ``log_weight``, ``draw_key`` double and ``kept`` boolean, which are added.
    Null and empty texts weigh 0; ids of any type; rows with null ids are never targets; equal rows have equal keys, and a tie at the cut
    is kept as a whole; without target labels all weights are 0, and without ``k`` all documents are drawn;
    an empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "quality")
    added = ("log_weight", "draw_key", "kept")
    names = [c for c in df.columns if c not in added]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    # Bounded: max_labelled ids of each kind.
    said = F.broadcast(scratch.put(_labels(df, target_ids, bad_ids, id_col, max_labelled)))
    id_of = lambda x: F.col(f"`{id_col}`").alias(x)
    flag = F.coalesce("said", F.lit(0)).alias("said")
    texts = df.select(id_of("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).join(said, "id", "left").select(flag, "text")
    model = spark.sparkContext.broadcast(fit(texts, bits))
    inner = [f"c{i}" for i in range(len(names))]
    place = dict(zip(names, inner, strict=True))

    out = [c for c in names if keep_text or c != text_col]
    own = df.select(*[F.col(f"`{c}`").alias(place[c]) for c in out], id_of("id"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    own = own.join(said, "id", "left").select(*[place[c] for c in out], flag, "h", "__text")
    schema = "".join(f"{place[c]} {df.schema[c].dataType.simpleString()}, " for c in out)
    weighed = own.mapInArrow(_weights(bits, model), f"{schema}said int, h long, log_weight double")
    uniform = (F.shiftright("h", 11) + float(1 << 52) + 0.5) / float(1 << 53)
    drawn = scratch.put(weighed.withColumn("draw_key", F.col("log_weight") / temperature - F.log(-F.log(uniform))))
    if k is None:
        least = drawn.where(F.col("said") == TARGET).agg(F.expr(f"percentile_disc({1 - recall!r}) WITHIN GROUP (ORDER BY draw_key)")).first()[0]
        k = drawn.where(F.col("draw_key") >= (-math.inf if least is None else least)).count()
    cut = largest(drawn.select("draw_key"), k)
    kept = F.lit(True) if cut is None else F.col("draw_key") >= cut
    return drawn.select(*[F.col(place[c]).alias(c) for c in out], "log_weight", "draw_key", kept.alias("kept"))


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good quality and not toxic."""
    by_id = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return by_id.where("q = 1 and t = 0").select("doc_id")


def bad_ids(labels: DataFrame) -> DataFrame:
    """Ids of which some label says bad quality or toxic."""
    return labels.where("quality = 0 or toxic = 1").select("doc_id").distinct()
