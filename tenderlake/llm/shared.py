"""What the operators of this package share: column hygiene and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words by white space alone, and words of letters, digits and non-ASCII characters once A-Z are lower-cased.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone under new names, so that other columns of the input can't clash with ours."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def ascii_lower(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session without one gets its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: computed once, lineage cut, safe from lost executors.

    Its shuffle files go once it is written.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}/{name}", spark.conf.get(cleanup)
    spark.conf.set(cleanup, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def in_parts(parts: int, part: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The rows of ``part(0)``, ``part(1)`` and so on, each written before the next, so that only one has shuffle files at a time."""
    return reduce(DataFrame.union, [written(part(i), name) for i in range(parts)])


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that is computed from them is written itself."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small(ids: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored table of a few short columns, to be broadcast if it has at most ``most`` rows; else Spark joins it as any other."""
    return F.broadcast(ids) if ids.count() <= most else ids


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n", share: int = 1000) -> DataFrame:
    """``rows`` joined to ``groups``, a stored table of a row per key with its number of rows; both without null keys.

    Keys that have one in ``share`` of all rows or more are at most ``share``, so they are broadcast and their rows stay where
    they are. No hot key goes through a shuffle.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]  # one row
    most = max(2, -(-total // share))
    hot = F.broadcast(groups.where(F.col(size) >= most))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(size) < most), keys))


def with_partners(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key`` others have too, with their number as ``name``. Rows are dealt by key once.

    The count keeps a maximum of every column, as Spark would else deal rows without them once more.
    """
    dealt = rows.repartition("key")
    others = [c for c in rows.columns if c != "key"]
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias(name), *(F.max(c).alias(f"_{c}") for c in others))
    counts = counts.where((F.col(name) > 1) & F.coalesce(*(F.col(f"_{c}").cast("string") for c in others)).isNotNull()).select("key", name)
    return dealt.join(counts.hint("shuffle_hash"), "key")
