"""URL tables: labelled CSV, one-URL-per-line feeds, prepared splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

from lurewatch.workspace import path_exists

# Quotes inside a quoted field are doubled, a field may hold line breaks, blanks at its ends count, and an empty
# field is null while a quoted empty one is an empty text.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = CSV_OPTIONS | {"emptyValue": "", "nullValue": "\x01"}  # what the parser puts in place of an empty field


def _reader(spark: SparkSession, line_breaks: bool) -> DataFrameReader:
    """A file whose fields hold line breaks has to be read whole by one task; any other is cut into parts."""
    return spark.read.options(**CSV_READ | {"multiLine": str(line_breaks).lower()})


def read_labelled_csv(spark: SparkSession, path: str, url: str = "URL", label: str = "label",
                      schema: str | None = None, line_breaks: bool = True) -> DataFrame:
    """Two columns of a wide CSV with header; the parser only materialises the selected columns.

    ``schema`` declares all columns; without it they are taken from the header, as text. Say ``line_breaks=False``
    of files in which every record is one line: they are split among tasks.
    """
    reader = _reader(spark, line_breaks)
    raw = (reader.schema(schema) if schema else reader).csv(path)
    return raw.select(F.col(url).alias("url"), F.col(label).cast("int").alias("source_label"))


def read_wide_csv(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> DataFrame:
    """All columns under a declared schema; ``line_breaks`` as in ``read_labelled_csv``."""
    return _reader(spark, line_breaks).schema(schema).csv(path)


def clean_feed(lines: DataFrame) -> DataFrame:
    """Lines that start with http, stripped. The test is on the line as it is, so indented lines go."""
    return (lines.where(F.col("value").startswith("http"))
            .select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("url")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return clean_feed(spark.read.text(path))


def write_splits(df: DataFrame, path: str) -> None:
    """One table partitioned by ``split``; reading one split touches only its folder."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, augmented_path: str | None = None) -> DataFrame:
    """One split of a prepared table; the augmented variant when it exists, else the plain one."""
    if augmented_path is not None and split == "train":
        if path_exists(spark, augmented_path):
            return spark.read.parquet(augmented_path).where(F.col("split") == split)
    return spark.read.parquet(path).where(F.col("split") == split)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result tables as parquet, CSV with header, or JSON lines."""
    df.write.mode("overwrite").format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {})).save(path)
