"""Exports and reports.

Writes are distributed (one file per partition, JSON Lines / CSV with a
header); a single pretty-printed file is a driver-side convenience the
reference has and we do not build.  Exports go to a fresh folder; an input
path is never overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregates import report_summary

# Spark's CSV writer and reader trim whitespace by default; exports keep text as is.
CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

EXPORT_COLUMNS = ["title", "url", "content", "source", "date", "category", "sentiment_score"]
REPORT_DETAIL_COLUMNS = ["title", "source", "category", "sentiment_score"]


def export_json(df: DataFrame, path: str, columns=None) -> None:
    """JSON Lines, NULL fields kept as ``null``."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(df: DataFrame, path: str, columns=None) -> bool:
    """CSV with header; nothing is written for an empty input.
    Returns whether files were written."""
    out = df.select(*columns) if columns else df
    if out.isEmpty():
        return False
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return True


def report_detail(df: DataFrame) -> DataFrame:
    """The detail columns, plus ``date`` when the frame has one."""
    cols = REPORT_DETAIL_COLUMNS + (["date"] if "date" in df.columns else [])
    return df.select(*cols)


def daily_report(df: DataFrame, prefix: str, report_date: str, digits: int = 4) -> bool:
    """``{prefix}_{date}`` JSON summary and ``{prefix}_details_{date}``
    CSV; an empty input writes nothing and returns False."""
    summary = report_summary(df, report_date, digits=digits, nested=True)
    if summary.isEmpty():
        return False
    summary.coalesce(1).write.mode("overwrite").json(f"{prefix}_{report_date}")  # one row
    report_detail(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{prefix}_details_{report_date}")
    return True


def read_report_detail(spark, path: str) -> DataFrame:
    return (spark.read.options(**CSV_OPTIONS)
            .schema("title string, source string, category string, sentiment_score double, date timestamp")
            .csv(path))


__all__ = ["export_json", "export_csv", "daily_report", "report_detail", "read_report_detail"]
