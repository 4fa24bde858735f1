"""Matrices as rows (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry(matrix: DataFrame, row, col) -> DataFrame:
    return matrix.filter((F.col("row") == row) & (F.col("col") == col))


def row(matrix: DataFrame, name) -> DataFrame:
    return matrix.filter(F.col("row") == name).select("col", "value")


def column(matrix: DataFrame, name) -> DataFrame:
    return matrix.filter(F.col("col") == name).select("row", "value")


def diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.col("row") == F.col("col")).select(F.col("row").alias("at"), "value")


def with_cells(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """With the cells of a new row or column; cells that are there already give way."""
    key = ["row", "col"]
    return matrix.join(cells.select(key), key, "left_anti").unionByName(cells)


def without_row(matrix: DataFrame, name) -> DataFrame:
    return matrix.filter(F.col("row") != name)


def without_column(matrix: DataFrame, name) -> DataFrame:
    return matrix.filter(F.col("col") != name)


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
