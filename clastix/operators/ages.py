"""Range tables, ages of named intervals, and kingdoms of phyla."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import assert_ranges, require, require_number, require_text
from ..shared import fresh

MODES = ("max", "min", "bounds")
#: Added to starts before endpoints are ordered, so that a start comes before an end of the same age.
SHIFT = 0.1


def _ranges(df: DataFrame, taxon: str, srt: str, end: str, mode: str) -> DataFrame:
    rows = df.select(F.col(taxon).cast("string").alias("taxon"), F.col(srt).cast("double").alias("s"), F.col(end).cast("double").alias("e")).dropna()
    if mode == "max":
        return rows.groupBy("taxon").agg(F.max("s").alias("FAD"), F.min("e").alias("LAD"))
    # an end comes after its own start and a start before its own end, but in a row the wrong way round: of the others the
    # oldest end and the youngest start are enough, so that one endpoint of a row is sorted, not both
    s, e = F.col("s"), F.col("e")
    start = lambda c: F.struct((c + SHIFT).alias("adj"), F.lit(1).alias("start"), c.alias("age"))
    stop = lambda c: F.struct(c.alias("adj"), F.lit(0).alias("start"), c.alias("age"))
    wrong = e > s + SHIFT
    edge = rows.groupBy("taxon").agg(F.max("e").alias("e"), F.min("s").alias("s"))
    old = rows.select("taxon", F.inline(F.when(wrong, F.array(start(s), stop(e))).otherwise(F.array(start(s))))).unionByName(edge.select("taxon", F.inline(F.array(stop(e)))))
    young = rows.select("taxon", F.inline(F.when(wrong, F.array(start(s), stop(e))).otherwise(F.array(stop(e))))).unionByName(edge.select("taxon", F.inline(F.array(start(s)))))
    taxon = Window.partitionBy("taxon")
    # equal endpoints have one rank; ranks up to 2 are cut off before the shuffle
    first = old.withColumn("k", F.dense_rank().over(taxon.orderBy(F.desc("adj"), F.desc("start"), F.desc("age")))).where("k <= 2").select("taxon", "k", "age")
    last = young.withColumn("k", F.dense_rank().over(taxon.orderBy("adj", "start", "age"))).where("k <= 2").select("taxon", (-F.col("k")).alias("k"), "age")
    place = lambda k, name: F.max(F.when(F.col("k") == k, F.col("age"))).alias(name)
    out = first.unionByName(last).groupBy("taxon").agg(place(1, "FAD_early"), place(2, "FAD_late"), place(-2, "LAD_early"), place(-1, "LAD_late"))
    if mode == "bounds":
        return out
    return out.select("taxon", F.col("FAD_late").alias("FAD"), F.col("LAD_early").alias("LAD"))


def age_ranges(df: DataFrame, taxonomy: str | list[str] = "genus", srt: str = "max_ma", end: str = "min_ma", mode: str = "max", validate: bool = True) -> DataFrame:
    """One row per taxon of each taxonomy column: taxon, FAD, LAD, level.

    max: the oldest start and the youngest end. min: the second and the second-last of all distinct
    endpoints, from old to young, starts before ends of one age; bounds: FAD_early, FAD_late, LAD_early,
    LAD_late, the first two and the last two of them. Rows without a taxon or an age don't count; with
    validate a null age or a start below its end is an error (one job).
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    levels = [taxonomy] if isinstance(taxonomy, str) else list(taxonomy)
    require(df, *levels)
    require_number(df, srt, end)
    if validate:
        assert_ranges(df, srt, end)
    return reduce(DataFrame.unionByName, [_ranges(df, x, srt, end, mode).withColumn("level", F.lit(x)) for x in levels])


def check_scale(tscale: DataFrame) -> None:
    """A time scale has Interval, FAD and LAD, without nulls, of ages from 0 on, with FAD above LAD (one job)."""
    require(tscale, "Interval", "FAD", "LAD")
    require_number(tscale, "FAD", "LAD")
    bad = tscale.agg(
        F.count_if(F.col("Interval").isNull() | F.col("FAD").isNull() | F.col("LAD").isNull()).alias("nulls"),
        F.count_if((F.col("LAD") < 0) | (F.col("FAD") <= F.col("LAD"))).alias("ages"),
    ).first()
    if bad["nulls"] or bad["ages"]:
        raise ValueError(f"time scale: {bad['nulls']} rows with nulls, {bad['ages']} with impossible ages")


def _lookup(tscale: DataFrame, key: str, name: str, age: str) -> DataFrame:
    """Each interval once: of repeated ones the row of the highest FAD, then LAD."""
    one = tscale.groupBy(F.col("Interval").alias(key)).agg(F.max(F.struct("FAD", "LAD")).alias("r"))
    return one.select(key, F.col(f"r.{age}").cast("double").alias(name))


def chrono_scale(df: DataFrame, tscale: DataFrame, srt: str = "early_interval", end: str = "late_interval", max_ma: str | None = None, min_ma: str | None = None, validate: bool = False) -> DataFrame:
    """df with newFAD and newLAD, the ages of its named intervals.

    The late interval defaults to the early one. Unknown names take the ages of max_ma and min_ma, if
    given (both or neither), else null; both are null unless both are known, and are put in order. A null
    early interval is an unknown name. Rows are dated each, repeated ones alike; an empty table stays empty. Columns of df stay; a result whose name df
    has already gets underscores behind it.
    """
    if (max_ma is None) != (min_ma is None):
        raise ValueError("give both of max_ma and min_ma, or neither")
    require_text(df, srt, end)
    if validate:
        check_scale(tscale)
    i, j, x, y = fresh(df, "i", "j", "x", "y")
    a, b = _lookup(tscale, i, x, "FAD"), _lookup(tscale, j, y, "LAD")
    out = df.join(a, F.col(srt) == F.col(i), "left").join(b, F.coalesce(F.col(end), F.col(srt)) == F.col(j), "left")
    fad, lad = F.col(x), F.col(y)
    if max_ma is not None:
        fad, lad = F.coalesce(fad, F.col(max_ma)), F.coalesce(lad, F.col(min_ma))
    both = fad.isNotNull() & lad.isNotNull()
    new = dict(zip(fresh(df, "newFAD", "newLAD"), (F.when(both, F.greatest(fad, lad)), F.when(both, F.least(fad, lad)))))
    return out.withColumns(new).drop(i, j, x, y)


def unmatched_intervals(df: DataFrame, tscale: DataFrame, srt: str = "early_interval", end: str = "late_interval") -> DataFrame:
    """(interval): the names in either column that the time scale lacks."""
    names = df.select(F.explode(F.array(srt, end)).alias("interval")).where(F.col("interval").isNotNull()).distinct()
    return names.join(tscale.select(F.col("Interval").alias("interval")), "interval", "left_anti")


#: Phyla that are a kingdom's own, after those of the lookup, in the order in which they override it.
OWN = (("Pezizomycotina", "Fungi"), ("Cyanobacteria", "Bacteria"))
ORDER = ("Protista", "Plantae", "Animalia")


def kingdom(phylum: Column, animals: list[str], plants: list[str], protists: list[str]) -> Column:
    """The kingdom of a phylum by lists: of several the last in the order animals, plants, protists, own names."""
    out = F.lit(None).cast("string")
    for names, value in ((animals, "Animalia"), (plants, "Plantae"), (protists, "Protista"), *(([p], k) for p, k in OWN)):
        out = F.when(phylum.isin(*names), F.lit(value)).otherwise(out) if names else out
    return out


def add_kingdoms(df: DataFrame, kingdoms: dict[str, list[str]] | DataFrame, phylum: str = "phylum", insert_left: bool = True) -> DataFrame:
    """df with a kingdom column, left of phylum or last. kingdoms: lists by kingdom, or a table (phylum, kingdom) that is joined.

    A df that has a kingdom column already is an error. A phylum that is null or in no list has no kingdom.
    """
    require_text(df, phylum)
    if "kingdom" in df.columns:
        raise ValueError("there is a kingdom column already")
    if isinstance(kingdoms, dict):
        out = df.withColumn("kingdom", kingdom(F.col(phylum), *(list(kingdoms.get(k, [])) for k in ("Animalia", "Plantae", "Protista"))))
    else:
        level = F.coalesce(F.array_position(F.array(*map(F.lit, reversed(ORDER))), F.col("kingdom")), F.lit(0))
        name, found = fresh(df, "name", "found")
        one = kingdoms.groupBy(F.col("phylum").alias(name)).agg(F.max_by("kingdom", level).alias(found))
        own = F.coalesce(*[F.when(F.col(phylum) == p, F.lit(k)) for p, k in reversed(OWN)], F.col(found))
        out = df.join(one, F.col(phylum) == F.col(name), "left").withColumn("kingdom", own).drop(name, found)
    if not insert_left:
        return out
    at = df.columns.index(phylum)
    return out.select(*df.columns[:at], "kingdom", *df.columns[at:])
