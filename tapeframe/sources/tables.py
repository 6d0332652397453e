"""Readers of landed files and writers of published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeframe.operators.ranking import first_per_key
from tapeframe.runtime import new_path
from tapeframe.sources.files import read_pointer, replace_pointer
from tapeframe.sources.loads import content


def write_ticker_files(rows: DataFrame, name: str, fmt: str = "csv") -> str:
    """One folder per ticker, as landing jobs leave them.

    A folder costs far more than its rows, so the number of tasks is a given one: Spark would choose it by bytes, and one
    task would write the folders of all tickers.
    """
    spark = rows.sparkSession
    path = new_path(spark, name)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = rows.withColumn("folder", F.col("ticker")).repartition(tasks, "folder")
    # Tasks move their own files: the folder is new and nobody reads it yet, and the driver would move one folder after the other.
    writer = out.drop("ticker").write.partitionBy("folder").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.csv(path, header=True) if fmt == "csv" else writer.json(path))
    return path


def read_ticker_files(spark: SparkSession, path: str, schema: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """All ticker folders in one scan; the ticker comes from the folder name, which is kept as ``folder`` for multi-line objects."""
    reader = spark.read.schema(schema).option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", "true")
    if multi_line:
        folder = F.regexp_extract("_metadata.file_path", "folder=([^/]+)/", 1)
        return reader.json(path, multiLine=True).select(F.upper(F.trim(folder)).alias("ticker"), folder.alias("folder"), "*")
    rows = reader.csv(path, header=True) if fmt == "csv" else reader.json(path)
    return rows.select(F.upper(F.regexp_extract("_metadata.file_path", "folder=([^/]+)/", 1)).alias("ticker"), "*")


def last_per_ticker(rows: DataFrame) -> DataFrame:
    """The row of the last folder, in order of its name, of each ticker."""
    return first_per_key(rows, ["ticker"], [F.col("folder").desc()]).drop("folder")


def completed_universe(rows: DataFrame, completed: DataFrame, active: DataFrame) -> DataFrame:
    return rows.join(completed.select("ticker"), "ticker", "left_semi").join(active.select("ticker"), "ticker", "left_semi")


def optional_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table if it exists, else an empty frame of the same shape."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def align_columns(rows: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of the schema, in its order; missing ones are null, extra ones go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def publish(rows: DataFrame, root: str, name: str, version: str) -> None:
    """Write a version beside the old ones; the pointer is replaced only when it is complete."""
    rows.write.parquet(f"{root}/{name}/version={version}", compression="zstd")
    replace_pointer(rows.sparkSession, f"{root}/_current/{name}", version)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = read_pointer(spark, f"{root}/_current/{name}")
    if version is None:
        raise FileNotFoundError(f"{name} was never published under {root}")
    return read_version(spark, root, name, version)


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={version}")


def typed_export(rows: DataFrame) -> DataFrame:
    """Dates as text, booleans as 0/1, NaN as null: what a row store takes."""
    out = {}
    for f in rows.schema:
        kind = f.dataType.simpleString()
        if kind == "date":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "timestamp":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "boolean":
            out[f.name] = F.col(f.name).cast("int").cast("long")
        elif kind in ("double", "float"):
            out[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        else:
            out[f.name] = F.col(f.name)
    return rows.select(*[v.alias(k) for k, v in out.items()])


def append_keep_last(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """History plus new rows, the newest row per key."""
    both = history.withColumn("_gen", F.lit(0)).unionByName(rows.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, keys, [F.col("_gen").desc()]).drop("_gen")


def write_chunked_csv(rows: DataFrame, name: str, chunk_rows: int) -> str:
    """Gzip CSV parts of bounded length, each with a header."""
    path = new_path(rows.sparkSession, name)
    rows.write.option("maxRecordsPerFile", chunk_rows).csv(path, header=True, compression="gzip")
    return path


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and digest of each part; parts are bounded, so is a task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def part_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Name, rows, size and digest of each part."""
    rows = spark.read.csv(path, header=True, schema=schema).groupBy(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file")).agg(F.count("*").alias("rows"))
    return file_manifest(spark, path).join(rows, "file", "left").fillna(0, ["rows"]).select("file", "rows", "bytes", "sha256")


def digest(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and a digest of two sums of row hashes."""
    return content(rows, [])


def surrogate_ids(names: DataFrame, column: str) -> DataFrame:
    """1-based ids over a sorted vocabulary (sources, item codes, action types), short by nature."""
    return names.filter(F.col(column).isNotNull()).select(column).distinct().withColumn(
        "id", F.row_number().over(Window.orderBy(column)).cast("long"))
