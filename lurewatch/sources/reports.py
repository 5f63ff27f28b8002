"""Reports as JSON tables of metrics, and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.fixed.rules import DETECTED_VERDICTS

REPORT_SCHEMA = "section string, item string, metric string, value double"


def metric_rows(table: DataFrame, section: str, item: str, metrics: list[str]) -> DataFrame:
    """A metrics table as report rows: one row per item and metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (table.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"),
                         F.explode(pairs).alias("_p")).select("section", "item", "_p.*"))


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_nested_report(table: DataFrame, path: str) -> None:
    """A record with nested structs (findings, search results) as JSON."""
    table.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def pick_item(report: DataFrame, section: str, item: str) -> DataFrame:
    """All metrics of one item, for instance of one model."""
    return report.where((F.col("section") == section) & (F.col("item") == item))


def read_nested_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_weights(report: DataFrame, models: list[str], section: str = "weights") -> tuple[float, ...]:
    """The stored weight of each model, in the order of ``models``; a missing one is an error."""
    found = {r["item"]: r["value"] for r in report.where(
        (F.col("section") == section) & (F.col("metric") == "weight") & F.col("item").isin(models)).collect()}
    return tuple(found[m] for m in models)


def detection_rate(results: DataFrame) -> DataFrame:
    """Share of stored hold-out results without error that carry a detecting verdict."""
    valid, found = F.count_if(F.col("verdict") != "ERROR"), F.count_if(F.col("verdict").isin(DETECTED_VERDICTS))
    return results.agg(valid.alias("n"), F.round(found * 100.0 / valid, 2).alias("pct")).select(F.lit("detection").alias("rate"), "n", "pct")


def retention_rate(results: DataFrame) -> DataFrame:
    """Share of stored variants of detected URLs that are still detected."""
    before, after = F.count_if("detected_before"), F.count_if(F.col("detected_before") & F.col("detected_after"))
    return results.agg(before.alias("n"), F.round(after * 100.0 / before, 2).alias("pct")).select(F.lit("retention").alias("rate"), "n", "pct")


def results_summary(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
