"""What the text operators share: tables in the cluster's shared folder, joins of a checked size, Arrow batches of few bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import collected, drop, fresh, shared_dir, written

__all__ = ["bounded", "collected", "drop", "fresh", "row_key", "shared_dir", "sized", "written"]

#: A side of a join is broadcast up to so many bytes of values; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its values have at most limit bytes, else as it is, so that the join shuffles; a value of a fixed size counts as 8."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    each = sum(wide, F.lit(8 * (len(small.columns) - len(wide))))
    n = small.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(small) if n <= limit else small


def bounded(df: DataFrame, megabytes: int = 8) -> DataFrame:
    """df, its session set to hand Arrow batches of so many megabytes at most to Python: texts are long, and a batch is in memory on both sides.

    A lazy result is planned when it runs, so the setting stays; a size that the session was given by name is left alone.
    """
    session = df.sparkSession
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20
    have = session.conf.get(name)
    given = session.sparkContext.getConf().contains(name)
    if not given and (not re.fullmatch(r"\d+b?", have) or int(have.rstrip("b")) > most):
        session.conf.set(name, str(most))
    return df


def row_key(*columns: Column | str) -> Column:
    """A 64-bit key of these columns; a null differs from every value."""
    return F.xxhash64(*columns)
