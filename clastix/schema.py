"""Checks of column names and types, without a job, and the results that have several parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, *columns: str, kind: type[T.DataType] | tuple[type[T.DataType], ...] | None = None) -> None:
    """All columns are there and, if kind is given, of that type."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"no column {c!r} among {df.columns}")
        if kind is not None and not isinstance(df.schema[c].dataType, kind):
            raise TypeError(f"column {c!r} is {df.schema[c].dataType.simpleString()}")


def require_text(df: DataFrame, *columns: str) -> None:
    require(df, *columns, kind=(T.StringType, T.VarcharType, T.CharType))


def require_number(df: DataFrame, *columns: str) -> None:
    require(df, *columns, kind=T.NumericType)


def assert_ranges(df: DataFrame, srt: str, end: str) -> None:
    """One job: no null ages and no range that ends before it starts."""
    bad = df.agg(
        F.count_if(F.col(srt).isNull() | F.col(end).isNull()).alias("nulls"),
        F.count_if(F.col(srt) < F.col(end)).alias("reversed"),
    ).first()
    if bad["nulls"]:
        raise ValueError(f"{bad['nulls']} rows without an age in {srt} or {end}")
    if bad["reversed"]:
        raise ValueError(f"{bad['reversed']} rows whose {srt} is below {end}")


@dataclass(frozen=True)
class FlagResult:
    taxon: DataFrame
    occurrence: DataFrame


@dataclass(frozen=True)
class RevisionResult:
    collection: DataFrame
    occurrence: DataFrame


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    vertices: DataFrame


@dataclass(frozen=True)
class ThresholdResult:
    data: DataFrame
    matrix: DataFrame
    peaks: DataFrame
    comparison: DataFrame


@dataclass(frozen=True)
class TaxonomyResult:
    data: DataFrame
    formatting: DataFrame
    synonyms: DataFrame
    ranks: DataFrame
    duplicates: DataFrame
