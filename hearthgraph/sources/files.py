"""Reading snapshots and nested reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_listings(df: DataFrame) -> DataFrame:
    """All rows, newest first; unique_id settles ties."""
    return df.orderBy(F.desc("first_seen"), "unique_id")


def load_snapshots(spark: SparkSession, paths: list[str], schema: str, key: str = "unique_id", lines: bool = False) -> DataFrame:
    """JSON snapshot files (arrays of records, or a record a line) merged; of equal keys the first
    file's wins."""
    df = spark.read.schema(schema).json(paths, multiLine=not lines).withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    w = Window.partitionBy(key).orderBy("_file", "_at")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_file", "_at", "_n")


def cached_files(spark: SparkSession, root: str) -> DataFrame:
    """folder and cache_name of each file under root/<folder>/; only paths are read. In folder
    names the colon of an id is written as an underscore."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.split("path", "/").alias("p"))
    return paths.select(F.replace(F.element_at("p", -2), F.lit("_"), F.lit(":")).alias("folder"), F.element_at("p", -1).alias("cache_name"))


def load_dim(df: DataFrame, column: str, outer: str, inner: str, value: str, kind: str = "int") -> DataFrame:
    """A nested JSON dictionary {outer: {inner: value}} -> rows."""
    rows = df.select(F.explode(F.from_json(column, f"map<string,map<string,{kind}>>")).alias(outer, "_m"))
    return rows.select(outer, F.explode("_m").alias(inner, value))
