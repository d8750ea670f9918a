"""Two-pass external shuffle into shards, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, blocks_for, fold_copies, row_hash, text_of, unfold_copies

#: Buckets whose running counts are summed together, and those whose permutations one partition draws.
FAN, DRAWN = 2048, 256


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, n, start): how many rows stand in the buckets before, by sums over groups of ``FAN`` buckets."""
    counts = counts.withColumn("fan", F.floor(F.col("bucket") / FAN))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    fans = counts.groupBy("fan").agg(F.sum("n").alias("m"))
    fans = fans.select("fan", F.coalesce(F.sum("m").over(before.orderBy("fan")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("fan").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("off", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(fans, "fan")
    return summed.select("bucket", "n", (F.col("base") + F.col("off")).alias("start"))


def external_shuffle(
    df: DataFrame,
    n_shards: int = 16,
    seed: int = 17,
    bucket_bytes: int = 4 << 20,
    text_col: str = "text",
) -> DataFrame:
    """Deal all rows into ``n_shards`` shards in one random order.

    Pass 1 scatters rows by a seeded hash of all their columns into buckets of about ``bucket_bytes``; a row that occurs
    more often than a bucket has rows is scattered by its copies' numbers as well. Pass 2 places each bucket's rows, in
    hash order, by a Fisher-Yates permutation (the built-in ``shuffle``) behind the buckets before it. The permutations
    are drawn in partitions numbered by bucket, with the bucket counts alone, so the order depends on the rows, ``seed`` and
    ``bucket_bytes`` and neither on the plan nor on the number of partitions or files. Place p of the whole order is slot
    p div n of shard p mod n: shard sizes differ by one row at most and slots have no gaps.

    Returns the columns of ``df`` with ``shard`` int, ``slot`` long. A null text counts as empty; a null id is an id
    like others; equal ids, equal texts and wholly equal rows each keep a slot of their own; an empty table gives no
    rows. A column of ``df`` named ``shard`` or ``slot`` is replaced.
    """
    scratch = Scratch(df.sparkSession, "shards")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    size = (F.octet_length(text_of(text_col)) + F.lit(64)).cast("long").alias("size")
    keyed = df.select(row_hash(df, seed).alias("h1"), row_hash(df, seed + 1).alias("h2"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    seen = df.select(row_hash(df, seed).alias("h1"), row_hash(df, seed + 1).alias("h2"), size)
    seen = scratch.put(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    total, rows = seen.agg(F.sum("size"), F.sum("n")).first()
    n_buckets = blocks_for(total, bucket_bytes)
    limit = max(16, (rows or 0) // n_buckets)

    scattered = F.pmod(F.when(F.col("many"), F.xxhash64("h1", "h2", "copy")).otherwise(F.col("h1")), F.lit(n_buckets)).cast("int").alias("bucket")
    dealt = unfold_copies(fold_copies(keyed, seen, limit)[0].withColumn("many", F.col("copies") > 1)).select("h1", "h2", "copy", scattered, "row")
    few = seen.where(F.col("n") <= limit).select(F.col("n"), F.lit(False).alias("many"), F.lit(0).cast("long").alias("copy"), "h1", "h2")
    many = unfold_copies(seen.where(F.col("n") > limit).withColumnRenamed("n", "copies")).select(F.lit(1).cast("long").alias("n"), F.lit(True).alias("many"), "copy", "h1", "h2")
    counts = few.unionByName(many).select(scattered, "n").groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = scratch.put(_starts(counts))
    drawn = starts.repartitionById(-(-n_buckets // DRAWN), F.floor(F.col("bucket") / DRAWN).cast("int")).sortWithinPartitions("bucket")
    drawn = drawn.select(F.col("bucket").alias("of"), "start", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(seed)).alias("to"))
    drawn = scratch.put(drawn)

    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("h1", "h2", "copy")))
    placed = ranked.join(drawn.hint("merge"), F.col("bucket") == F.col("of")).select("row", (F.col("start") + F.element_at("to", F.col("rank"))).alias("place"))
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
    )


def write_shards(dealt: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write the result of ``external_shuffle`` with one folder for each shard, files in slot order."""
    step = 1 << 17  # slots in one file at most, so that no task holds a whole shard
    dealt.repartition("shard", F.floor(F.col("slot") / step)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
