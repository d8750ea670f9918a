"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space code points, and A-Z with their lower-case forms.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of this machine's only under a local master, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

    #: Spark's switches for deleting the shuffle files of a plan once it has run, and for tables of few files: partitions
    #: of the advised size in place of one for each core, however little each holds.
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/tessella-{tag}-{uuid.uuid4().hex[:12]}", 0
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read back. No other plan reads the shuffle files of the write, so they go with its end."""
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        try:
            for k, v in self.SETTINGS.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        if self.n == 1:
            self._file_system(path)[1].deleteOnExit(self._file_system(self.base)[0])  # with the driver, whatever is left goes
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def _file_system(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            for path in [p for x, p in self.tables if x is t]:
                where, system = self._file_system(path)
                system.delete(where, True)
        self.tables = [(x, p) for x, p in self.tables if not any(x is t for t in tables)]

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[x for x, _ in self.tables if not any(x is k for k in kept)])


def text_of(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def blocks_for(n_bytes: int | None, block_bytes: int) -> int:
    """So many blocks that each holds about ``block_bytes``; the size of a block never grows with the input."""
    return max(1, math.ceil((n_bytes or 0) / block_bytes))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of a whole row; types that can't be hashed count by their JSON."""
    odd = lambda c: any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(f"`{c}`")) if odd(c) else F.col(f"`{c}`") for c in df.columns])


#: Copies in one part of a folded row that is expanded again.
STRETCH = 4096


def fold_copies(df: DataFrame, counts: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Rows of ``df`` (with ``h1``, ``h2``, 128 bits of the rest) plus ``copies`` long; what occurs more than ``limit`` times is one row.

    ``counts`` (h1, h2, n) says how often each row occurs. Copies are added up before the shuffle, so a row that is a third
    of the table is one row for each task and then one. There are at most 1 / ``limit`` of the rows to fold. Also says whether there are any.
    """
    hot = counts.where(F.col("n") > limit).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    one = df.withColumn("copies", F.lit(1).cast("long"))
    if hot.isEmpty():
        return one, False
    met = (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    rest = [c for c in df.columns if c not in ("h1", "h2")]
    many = df.join(hot, met, "left_semi").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("copies"))
    return one.join(hot, met, "left_anti").unionByName(many), True


def unfold_copies(df: DataFrame) -> DataFrame:
    """Each row ``copies`` times, with ``copy`` long from 0; many copies are made by many tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRETCH))
    few, many = df.where(F.col("copies") <= STRETCH), df.where(F.col("copies") > STRETCH)
    spread = many.withColumn("part", F.explode(parts)).repartition(F.col("h1"), F.col("part"))
    both = few.withColumn("part", F.lit(0).cast("long")).unionByName(spread)
    first = F.col("part") * STRETCH
    return both.withColumn("copy", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("copies")) - 1))).drop("part", "copies")
