"""Findings and masked text as views, for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import detect, mask


def register_views(spark: SparkSession, table: str, ids: list[str], text_col: str = "text", tiers: str = "all") -> None:
    """Temporary views ``<table>_findings`` (one row for each finding, with the columns ``ids``) and ``<table>_masked`` (with ``masked`` and ``hits``).

    A view is a plan: what a query does not select is not computed, and filters reach the scan.
    """
    rows = spark.table(table)
    detect.findings(rows, ids, text_col, tiers).createOrReplaceTempView(f"{table}_findings")
    mask.mask_shapes(rows, text_col).createOrReplaceTempView(f"{table}_masked")
