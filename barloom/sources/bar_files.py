"""Raw bar files, stored bar tables and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.cleaning import PRICE_COLUMNS, TIME_FORMATS, file_formats, parse_time

RAW_COLUMNS = ("time", *PRICE_COLUMNS)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS],
    ]
)
# Where a raw row stood: rows of one file sort by these in line order.
FILE_ORDER = ("file", "file_start", "line")


def discover_bar_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """Path and length of the raw files, empty ones included; an error if there is none.

    Scans leave empty files out, so the names are those of Spark's own file index, which lies on
    the driver; nothing but names passes through it.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    found = reader.option("recursiveFileLookup", True).load(directory)
    names = found.inputFiles()
    if not names:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    files = spark.createDataFrame([(path,) for path in names], "file string")
    files = files.select(plain_path(F.col("file")).alias("file"))
    sizes = found.select(plain_path(F.col("path")).alias("file"), "length")
    return files.join(sizes, "file", "left").na.fill(0, ["length"])


def checked_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """The raw files with ``readable``: whether they can be read to their end.

    A reader that goes on after an error returns what it had read of the file before, so the bytes
    that its lines hold are compared with the file's length (the last line may lack its break).
    """
    lines = (
        spark.read.option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("lineSep", "\n")
        .text(directory)
        .select(plain_path(F.col("_metadata.file_path")).alias("file"), F.octet_length("value").alias("n"))
    )
    read = lines.groupBy("file").agg(F.sum(F.col("n") + 1).alias("bytes"))
    files = discover_bar_files(spark, directory, pattern).join(read, "file", "left")
    over = F.coalesce("bytes", F.lit(0)) - F.col("length")
    return files.select("file", "length", ((over == 0) | (over == 1)).alias("readable"))


def only_readable(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Raw rows of files that could be read to their end; none of a file that could not."""
    return raw.join(files.where("readable").select("file"), "file", "left_semi").select(*raw.columns)


def plain_path(path: Column) -> Column:
    """One slash after the scheme, which Spark writes in two ways."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def read_raw_bars(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """All raw files of a directory and its folders as text columns, with the series taken from the file name.

    Columns are taken by position; more of them are ignored and missing ones are NULL. A heading
    is an ordinary row here: its time cannot be parsed, so cleaning removes it. A file that fails
    on the way does not stop the others; ``checked_files`` tells which, and ``only_readable`` takes
    out the rows that were read of it.
    """
    rows = (
        spark.read.schema(RAW_SCHEMA)
        .option("sep", "\t")
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .csv(directory)
    )
    path = F.col("_metadata.file_path")
    return rows.select(
        symbol_of(path).alias("symbol"),
        timeframe_of(path).alias("timeframe"),
        *RAW_COLUMNS,
        plain_path(path).alias("file"),
        F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("line"),
    )


# Symbol and timeframe in the name of a file, or of a folder of files, such as XXXYYY_H1.csv.
SERIES_NAME = r"([A-Za-z]+)_([A-Za-z0-9]+)[^/]*\.csv"


def symbol_of(path: Column) -> Column:
    return F.regexp_extract(path, SERIES_NAME, 1)


def timeframe_of(path: Column) -> Column:
    return F.regexp_extract(path, SERIES_NAME, 2)


def cleaned_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.csv", "_cleaned.csv")


def rejected_rows(
    raw: DataFrame,
    files: DataFrame | None = None,
    fmt: str | Sequence[str] = TIME_FORMATS,
    name: str = "file",
    order: Sequence[str] = FILE_ORDER,
) -> DataFrame:
    """Per file: rows, rows without a readable time, and whether nothing readable is in it.

    A file that cannot be read shows up here while the others go on. With ``files``, the result of
    ``discover_bar_files`` or ``checked_files``, empty files are listed too, and a file that fails
    on the way is unreadable whatever was read of it.
    """
    heading = F.coalesce(F.col("time").startswith("Time"), F.lit(False))
    rows = raw.select(name, *[c for c in order if c != name], "time", heading.alias("_heading"))
    if isinstance(fmt, str):
        rows = rows.withColumn("_time", parse_time(F.col("time"), fmt))
    else:
        rows = rows.join(file_formats(rows, order, [name], fmt), name, "left")
        fits = [F.when(F.col("time_format") == n, parse_time(F.col("time"), f)) for n, f in enumerate(fmt)]
        rows = rows.withColumn("_time", F.coalesce(*fits))
    counts = rows.groupBy(name).agg(
        F.count_if(~F.col("_heading")).alias("rows"),
        F.count_if(F.col("_time").isNull() & ~F.col("_heading")).alias("rejected"),
    )
    unreadable = F.col("rejected") == F.col("rows")
    if files is not None:
        counts = files.join(counts, name, "left").na.fill(0, ["rows", "rejected"])
        if "readable" in files.columns:
            unreadable = unreadable | ~F.col("readable")
    return counts.select(name, "rows", "rejected", unreadable.alias("unreadable"))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def optional_source(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one where it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    replace: str = "all",
) -> None:
    """Overwrite one product; rows are sorted inside files so that time filters skip row groups.

    With ``partition_by`` and a sort the rows are range-partitioned first: a large partition
    value is spread over many writers, and each writer opens few directories. ``replace`` "parts"
    replaces only the partitions that ``df`` has rows of, such as one year, and leaves the files of
    the others alone; new files are staged beside them and take their places when all are written,
    so a write that breaks off leaves the old rows.
    """
    if replace not in ("all", "parts") or (replace == "parts" and not partition_by):
        raise ValueError(f"cannot replace {replace} of a product with partitions {list(partition_by)}")
    if sort_by:
        df = df.repartitionByRange(*partition_by, *sort_by)
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    mode = "dynamic" if replace == "parts" else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)
