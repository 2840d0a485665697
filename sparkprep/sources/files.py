"""Labelled file folders and modality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension

BODY_CAP = 5000

# File extensions per kind of data.
EXTENSIONS = {
    "vision": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"],
    "text": [".txt", ".csv", ".json", ".md"],
    "audio": [".wav", ".mp3", ".flac", ".ogg"],
    "video": [".mp4", ".avi", ".mov", ".mkv"],
}
# Shorter lists of the presence check, in order of priority.
PRESENT = {
    "vision": [".jpg", ".png", ".jpeg"],
    "audio": [".wav", ".mp3"],
    "text": [".txt", ".json"],
    "video": [".mp4", ".avi"],
}


def _root(spark: SparkSession, path: str) -> str:
    """The 'train' child when the folder is laid out as train / test / val, else the folder itself."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    children = {s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()}
    return f"{path.rstrip('/')}/train" if "train" in children else path.rstrip("/")


def scan_labeled_files(spark: SparkSession, path: str, exts: Sequence[str]) -> DataFrame:
    """(path, label, content): label is the parent folder, 'unknown' for files in the root itself."""
    root = _root(spark, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    label = F.when(parent.endswith(root.split(":", 1)[-1]), "unknown").otherwise(F.element_at(parts, -2))
    return found.where(extension(F.col("path")).isin(list(exts))).select("path", label.alias("label"), "content")


def read_text_bodies(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(path, text) of every file below a folder. Whole texts by default; BODY_CAP is the usual cap."""
    raw = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.coalesce("value", F.lit("")).alias("text"))
    )
    return raw if cap is None else raw.withColumn("text", F.substring("text", 1, cap))


def modality_of(ext: Column) -> Column:
    out = F.when(ext.isNull(), "unknown")
    for kind, exts in EXTENSIONS.items():
        out = out.when(ext.isin(exts), kind)
    return out.otherwise("tabular")


def detect_modality(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kind of data of each folder by its most common extension (the smaller one on ties)."""
    counts = paths.withColumn("ext", extension(F.col("path"))).groupBy(*by, "ext").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by("ext", F.struct(-F.col("n"), F.col("ext"))).alias("ext")).select(
        *by, modality_of(F.col("ext")).alias("modality"))


def modality_present(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kind of data by presence: vision, audio, text, video in this order, else tabular."""
    ext = extension(F.col("path"))
    seen = paths.groupBy(*by).agg(*[F.bool_or(ext.isin(exts)).alias(kind) for kind, exts in PRESENT.items()])
    out = None
    for kind in PRESENT:
        out = F.when(F.col(kind), kind) if out is None else out.when(F.col(kind), kind)
    return seen.select(*by, out.otherwise("tabular").alias("modality"))
