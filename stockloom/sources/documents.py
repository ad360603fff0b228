"""Readers of the domain's files: truth documents, view truth, catalogues, summaries, and a detection cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRUTH = (
    "affine array<array<double>>, holds array<array<double>>, pause array<double>, frame_size array<int>, fps int, px_per_m double, "
    "objects array<struct<id: int, cls: string, sku: string, box: array<int>>>"
)
VIEW_TRUTH = "commit int, class string, count int"


def truth_document(spark: SparkSession, path: str) -> DataFrame:
    """The document of a synthetic walk as one nested row."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def truth_objects(doc: DataFrame) -> DataFrame:
    """One row for each object: id, cls, sku and the box's corners."""
    o = doc.select(F.explode("objects").alias("o"))
    return o.select(F.col("o.id").alias("id"), F.col("o.cls").alias("cls"), F.col("o.sku").alias("sku"), *(F.col("o.box")[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def truth_affines(doc: DataFrame) -> DataFrame:
    """One row for each frame: frame and its six numbers."""
    return doc.select(F.posexplode("affine").alias("frame", "m"))


def truth_holds(doc: DataFrame) -> DataFrame:
    return doc.select(F.posexplode("holds").alias("hold", "h")).select("hold", F.col("h")[0].alias("t_from"), F.col("h")[1].alias("t_to"))


def view_truth(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each view and class; classes are trimmed, and of several rows for a key the last line of the last file (by
    path) counts. Lines of a file keep their order: its blocks are read in order of their start."""
    raw = spark.read.option("header", True).schema(VIEW_TRUTH).csv(path).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    named = raw.withColumn("class", F.trim("class"))
    last = F.row_number().over(Window.partitionBy("commit", "class").orderBy(F.desc("_f"), F.desc("_b"), F.desc("_n")))
    return named.withColumn("_r", last).where("_r = 1").select("commit", "class", "count")


def catalogue(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """A catalogue file with its columns renamed by ``columns`` (theirs -> ours); all text, with ``duplicate`` for repeated codes."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*(F.trim(F.col(f"`{theirs}`")).alias(ours) for theirs, ours in columns.items())).withColumn("duplicate", F.count("*").over(Window.partitionBy("code")) > 1)


def summary_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def missing_frames(frames: DataFrame, cache: DataFrame, video: str, detector: str, shown: float) -> DataFrame:
    """Frames that a detection cache does not have for this video, detector and threshold: an anti join."""
    have = cache.where((F.col("video") == video) & (F.col("detector") == detector) & (F.col("shown") == shown)).select("frame").distinct()
    return frames.join(have, "frame", "left_anti")


def write_cache(dets: DataFrame, path: str) -> None:
    """Appends detections partitioned by video, detector and threshold, so that a lookup prunes to one folder."""
    dets.write.mode("append").partitionBy("video", "detector", "shown").parquet(path)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder and their bytes together; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
