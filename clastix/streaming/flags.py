"""The row-wise operators over streams: they are column expressions and joins with static tables, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import flag_occurrences, reference_ranges
from ..schema import require


def flag_stream(stream: DataFrame, reference: DataFrame, xcols: tuple[str, str, str], ycols: tuple[str, str, str] | None = None, flag_diff: list[float] | None = None) -> DataFrame:
    """Occurrences of a stream with their codes against the ranges of a static table (append mode)."""
    require(stream, *xcols)
    return flag_occurrences(stream, reference_ranges(reference, ycols or xcols), xcols, flag_diff or [5.0])


def range_stream(stream: DataFrame, taxon: str = "genus", srt: str = "max_ma", end: str = "min_ma") -> DataFrame:
    """The widest range of each taxon so far (update or complete mode)."""
    require(stream, taxon, srt, end)
    return stream.where(F.col(taxon).isNotNull()).groupBy(F.col(taxon).alias("taxon")).agg(F.max(srt).alias("FAD"), F.min(end).alias("LAD"))
