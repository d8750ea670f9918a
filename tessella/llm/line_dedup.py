"""Line dedup over the whole corpus, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower, text_of


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _without(lines: Column, gone: Column) -> Column:
    """Lines without those at the places ``gone``: marks and lines are sorted by place, and a line behind its mark goes."""
    marks = F.transform(gone, lambda p: F.struct(p.alias("at"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), x.alias("line")))
    order = F.array_sort(F.concat(marks, placed))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(1).alias("kind"), F.lit("").alias("line"))), order)
    # ``before`` is one longer: its last has no partner, and that pair, whose x is null, doesn't pass the filter.
    pairs = F.zip_with(order, before, lambda x, y: F.struct(x.alias("x"), ((y["kind"] == 0) & (y["at"] == x["at"])).alias("marked")))
    return F.transform(F.filter(pairs, lambda p: (p["x"]["kind"] == 1) & ~p["marked"]), lambda p: p["x"]["line"])


def dedup_lines(df: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key many documents hold; the largest id that holds a key keeps its lines.

    Lines are exploded with their place and 128 bits of their key's hash, documents are counted for each hash, and the
    lines of keys of at least ``min_chars`` code points in at least ``min_docs`` documents go, by place. The rest is
    reassembled in the order of the places, in one sort of the text's lines however many go.

    Returns the columns of ``df``, its text replaced by what is left, with ``n_lines`` and ``n_dropped`` long. Null
    and empty texts are one empty line. A document is a distinct id: rows that repeat an id count once. Rows with a
    null id are counted nowhere, joined with nothing and keep all lines. Columns of ``df`` with the two output names are replaced.
    """
    scratch = Scratch(df.sparkSession, "lines")
    text = lambda: text_of(text_col)
    # Rows of one id with other texts have lines of their own.
    held = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text()).alias("th"), text().alias("text"))
    # The hash is taken below the explosion; above it, it would be taken again for each line.
    held = held.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    held = held.withColumn("k", line_key(F.col("line"))).where(F.length("k") >= min_chars)
    held = scratch.put(held.select("id", "th", "at", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b")))
    pairs = held.select("id", "a", "b").distinct()  # each document once for each key
    common = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    common = scratch.put(common.select("a", "b", "keeper"))
    # Both sides come straight from an exchange, so a hot key's partition can be split at run time.
    drops = held.join(common, ["a", "b"]).where(F.col("id") < F.col("keeper"))
    drops = drops.groupBy("id", "th").agg(F.collect_set("at").alias("gone"))

    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    docs = df.where(F.col(id_col).isNotNull()).select(row, F.col(id_col).alias("id"), F.xxhash64(text()).alias("th"))
    joined = docs.join(drops.hint("shuffle_hash"), ["id", "th"], "left").select("row", "gone")
    joined = joined.unionByName(df.where(F.col(id_col).isNull()).select(row, F.lit(None).cast("array<int>").alias("gone")))
    lines = F.split(text_of(F.col("row").getField(text_col)), "\n", -1)
    left = F.when(F.col("gone").isNull(), text_of(F.col("row").getField(text_col))).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    out = [left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept]
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
