"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.clean import nan_to_null


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, nan_is_null: bool = True) -> DataFrame:
    """CSV with a header, JSON lines, ORC or Parquet, chosen by the extension; NaN becomes NULL.

    Give a schema for CSV and JSON: inference reads the data once more.
    """
    df = _read(spark, path, schema)
    return nan_to_null(df) if nan_is_null else df


def _read(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    ext = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    reader = spark.read
    if ext == "csv":
        reader = reader.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if ext in ("json", "jsonl"):
        return (reader.schema(schema) if schema else reader).json(path)
    if ext in ("parquet", "orc"):
        return reader.format(ext).load(path)
    raise ValueError(f"Unsupported file format '.{ext}'. Use .csv, .json, .orc or .parquet.")


def write_metrics(df: DataFrame, path: str) -> None:
    """Overwrite a CSV table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log table."""
    df.write.mode("append").parquet(path)


def save_memory(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new version of a memory table, nested fields and vectors included."""
    df.write.mode("overwrite").format(fmt).save(path)


def load_memory(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def save_fingerprints(df: DataFrame, path: str) -> None:
    """Fingerprint rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved network search results: a JSON list of dataset, best_params and accuracy."""
    schema = (
        "dataset string, best_params struct<dl_num_layers: int, dl_hidden_dim: int, dl_dropout: double, "
        "dl_lr: double, dl_batch_size: int>, accuracy double"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)
