"""Labelled tables in, results out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "target"


def load_table(spark: SparkSession, path: str, schema: str | None = None, target: str = TARGET) -> DataFrame:
    """Features and a boolean label from a CSV or Parquet table with a target column."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    elif kind == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    elif kind in ("h5", "hdf", "hdf5"):
        raise ValueError("Spark reads no HDF5: convert the table to Parquet")
    else:
        raise ValueError(f"unsupported file type {kind!r}: use .csv or .parquet")
    return with_label(df, target)


def with_label(df: DataFrame, target: str = TARGET, label: str = "label") -> DataFrame:
    if target not in df.columns:
        raise ValueError(f"the table has no column {target!r}")
    return df.withColumn(label, F.col(target).cast("boolean")).drop(*([target] if target != label else []))


def from_arrays(spark: SparkSession, data, labels, label: str = "label") -> DataFrame:
    """A table from a pandas frame or a matrix, and labels."""
    frame = pd.DataFrame(data).copy()
    frame.columns = [str(c) for c in frame.columns]
    if len(frame) != len(labels):
        raise ValueError("as many labels as rows")
    frame[label] = pd.Series(labels).astype(bool).to_numpy()
    return spark.createDataFrame(frame)


PAYSIM = "step int, type string, amount float, nameOrig string, oldbalanceOrg float, newbalanceOrig float, nameDest string, oldbalanceDest float, newbalanceDest float, isFraud int, isFlaggedFraud int"


def load_payments(spark: SparkSession, path: str) -> DataFrame:
    """A simulated payments log, typed and pruned at the scan: see payments()."""
    return payments(spark.read.option("header", True).schema(PAYSIM).csv(path))


def payments(log: DataFrame) -> DataFrame:
    """The columns of a payments log that rules use, the target, and whether each party is outside the bank (no balance before or after)."""
    outside = lambda a, b: (F.col(a) == 0) & (F.col(b) == 0)
    kept = ["type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
    target = F.col("isFraud").cast("boolean").alias(TARGET)
    parties = [outside("oldbalanceOrg", "newbalanceOrig").alias("externalOrig"), outside("oldbalanceDest", "newbalanceDest").alias("externalDest")]
    return log.select(*kept, target, *parties)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A results table (a row for each data set or run) as one CSV file."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, columns=("dataset", "mean_test_score")) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path).select(*columns)


def binary_datasets(catalogue: DataFrame) -> DataFrame:
    """Names of the data sets with two classes."""
    return catalogue.where("n_classes = 2").select("dataset")
