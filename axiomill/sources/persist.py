"""A knowledge base on disk: one Parquet table per frame, partitioned where removals are by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save(frames: dict[str, DataFrame], path: str, by_file: tuple[str, ...] = ("statements",)) -> None:
    """Write all frames under ``path``; those in ``by_file`` are partitioned by their file."""
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("file") if name in by_file and "file" in df.columns else w).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The frames of a saved base. Frames are immutable, so the same dictionary serves as a fork."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def reconcile(spark: SparkSession, path: str, name: str, rows: DataFrame) -> None:
    """Replace only the files that ``rows`` has rows of."""
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("file").parquet(f"{path}/{name}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, mtime, size, content_hash`` of files, from their bytes."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.col("path").alias("file"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.xxhash64("content").alias("content_hash"))


def freshness(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``file, state``: new, gone, changed, touched (only the time differs) or fresh, of two listings (file, mtime, content_hash)."""
    a = stored.select("file", F.col("mtime").alias("m0"), F.col("content_hash").alias("h0"), F.lit(True).alias("had"))
    b = now.select("file", F.col("mtime").alias("m1"), F.col("content_hash").alias("h1"), F.lit(True).alias("has"))
    state = (
        F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "gone").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed").when(~F.col("m0").eqNullSafe(F.col("m1")), "touched").otherwise("fresh")
    )
    return a.join(b, "file", "full").select("file", state.alias("state"))
